"""Hidden Markov language model: Baum-Welch training over partitions, exact likelihoods by the scaled forward recursion.

States emit words, each with its own probability in every state. The start and move probabilities have a fixed size; the
counts by (word, state) grow with the corpus and never leave the executors.

1. One scan turns texts into blocks of about ``block_tokens`` tokens: a row holds its documents, the hashes of its
   distinct words, and all tokens as numbers of those words. A long text stays whole in one block.
2. A block deals numbers for its words to parts by the words' hashes, a row a part. A part sums them by word over all
   blocks and answers each block with the sums of its words: rows are pairs of block and part, not words or tokens.
   This first gives the words' counts.
3. Each Baum-Welch iteration runs forward and backward over all documents of a block side by side. Expected counts by
   (word, state) go through the parts; those of starts, moves and states are summed over the tasks.
4. The last pass scores each document with its block's counts and the trained model.

A word's count in a state is raised by 1 / states, so that its counts in all states are raised by 1 as in the base score.
Words are compared by 64-bit hashes of their bytes. Expected counts travel as 16-bit logarithms, right to 0.04 %; sums,
counts of words and recursions have full precision.
"""

from __future__ import annotations

import contextlib
import gc
import math
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvid.llm.common import drop_shared, shared_dir, write_shared
from corvid.llm.quality import held_out

#: The hash that stands for the end of a text.
END = -1


class _Numbers(dict):
    """Numbers of a block's words, from 1 on in order of their first place; 0 is the end."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self) + 1
        return n


@dataclass
class HMM:
    start: np.ndarray
    move: np.ndarray
    emit: np.ndarray


def first_moves(states: int, stay: float = 0.98) -> tuple[np.ndarray, np.ndarray]:
    """Even starts and sticky moves."""
    move = np.full((states, states), (1 - stay) / max(states - 1, 1))
    np.fill_diagonal(move, stay if states > 1 else 1.0)
    return np.full(states, 1 / states), move


def smoothed(x: np.ndarray) -> np.ndarray:
    return (x + 0.1) / (x + 0.1).sum(-1, keepdims=True)


def noise(vocabulary: np.ndarray, states: int, seed: int) -> np.ndarray:
    """A number of a gamma distribution of shape 2 for each state and word, by seed and the word's hash."""
    out = np.zeros((states, len(vocabulary)))
    for k in range(2 * states):
        x = vocabulary.astype(np.int64).view(np.uint64) + np.uint64(((k + 1 + (seed << 32)) * 0x9E3779B97F4A7C15) % (1 << 64))
        for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(by)
        out[k % states] -= np.log((((x ^ (x >> np.uint64(31))) >> np.uint64(11)).astype(float) + 0.5) / (1 << 53))
    return out


@dataclass
class Emissions:
    """How words' counts become probabilities. ``by_state``: the sum of each state's counts over all training words."""

    states: int
    seed: int
    distinct: int
    by_state: np.ndarray

    def first(self, vocabulary: np.ndarray, c: np.ndarray, kind=np.float64) -> np.ndarray:
        """Smoothed counts times seeded noise; a row a word here and below."""
        x = noise(vocabulary, self.states, self.seed)
        x *= c + 1
        x[:, c == 0] = 2.0
        return np.ascontiguousarray((x / (self.by_state[:, None] + 2.0)).T, kind)

    def trained(self, expected: np.ndarray) -> np.ndarray:
        """Of expected counts by word and state, in their place; the unknown word has none."""
        expected += expected.dtype.type(1 / self.states)
        expected /= (self.by_state + (self.distinct + 1) / self.states).astype(expected.dtype)
        return expected


class _Sequences:
    """Tokens of many documents in time order: all first tokens, then all second ones, longest documents first."""

    def __init__(self, lens: np.ndarray, begin: np.ndarray | None = None):
        """``begin``: where each document begins; one after another where not given."""
        self.order = np.argsort(-lens, kind="stable")
        size = lens[self.order]
        self.longest = int(size[0])
        self.active = len(size) - np.searchsorted(size[::-1], np.arange(self.longest), "right")
        self.at = np.concatenate([[0], np.cumsum(self.active)])
        begin = (np.cumsum(lens) - lens if begin is None else begin)[self.order]
        step = np.repeat(np.arange(self.longest), self.active)
        rank = np.arange(self.at[-1]) - self.at[step]
        self.source = begin[rank] + step
        self.rank, self.step = rank, step

    def forward(self, model: HMM, classes: np.ndarray, kind=np.float64) -> tuple[np.ndarray, np.ndarray]:
        """Scaled forward probabilities, and the scale of each token: the probability of its class given those before."""
        return self._forward(model, model.emit.T.astype(kind, copy=False)[classes])

    def _forward(self, model: HMM, alpha: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """In place of the tokens' emissions."""
        kind, at = alpha.dtype, self.at
        scale, move, ones = np.empty(len(alpha), kind), model.move.astype(kind), np.ones(alpha.shape[1], kind)
        alpha[: at[1]] *= model.start.astype(kind)
        for t in range(self.longest):
            now = alpha[at[t] : at[t + 1]]
            if t:
                now *= alpha[at[t - 1] : at[t - 1] + len(now)] @ move
            s = now @ ones
            now /= s[:, None]
            scale[at[t] : at[t + 1]] = s
        return alpha, scale

    def counts(self, model: HMM, classes: np.ndarray, into: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Expected counts of starts, moves and emissions, the latter added to ``into`` (a row a word) where it is given."""
        kind = np.float32
        right = model.emit.T.astype(kind, copy=False)[classes]
        alpha, scale = self._forward(model, right.copy())
        back, move, at = np.ones_like(alpha), np.ascontiguousarray(model.move.astype(kind).T), self.at
        right /= scale[:, None]
        for t in range(self.longest - 1, 0, -1):
            now = right[at[t] : at[t + 1]]
            now *= back[at[t] : at[t + 1]]
            back[at[t - 1] : at[t - 1] + len(now)] = now @ move
        later, moves = np.flatnonzero(self.step > 0), np.zeros_like(model.move)
        for some in np.split(later, range(100_000, len(later), 100_000)):
            before = alpha[at[self.step[some] - 1] + self.rank[some]]
            moves += model.move * (before.T @ right[some])
        del right
        gamma = back
        gamma *= alpha
        gamma /= (gamma @ np.ones(gamma.shape[1], kind))[:, None]
        into = np.zeros((model.emit.shape[1], gamma.shape[1])) if into is None else into
        _add_rows(into, classes, gamma)
        return gamma[: at[1]].sum(0, dtype=np.float64), moves, into.T


def _add_rows(into: np.ndarray, rows: np.ndarray, x: np.ndarray, common: int = 1 << 15) -> None:
    """Add each row of ``x`` to a row of ``into``; the first ``common`` rows, which most go to, by counting in a small space."""
    often = rows < common
    few, y = rows[often], np.ascontiguousarray(x[often].T)
    n = min(common, len(into))
    for k in range(len(y)):
        into[:n, k] += np.bincount(few, y[k], n)
    rest = np.flatnonzero(~often)
    if len(rest):
        rest = rest[np.argsort(rows[rest], kind="stable")]
        row = rows[rest]
        first = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
        into[row[first]] += np.add.reduceat(x[rest].astype(np.float64), first, axis=0)


def _pack(x: np.ndarray) -> bytes:
    """Numbers below 2 ** 31 as compressed byte planes."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(x.astype("<u4", copy=False).view(np.uint8).reshape(-1, 4).T))


def _unpack(x: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(x), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<i4").ravel()


def _shrink(x: np.ndarray) -> bytes:
    """Numbers as compressed byte planes."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(np.ascontiguousarray(x).view(np.uint8).reshape(-1, x.itemsize).T))


def _grown(x: bytes, kind: str) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(x), np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


_STEPS, _LEAST = 1023.0, -30.0


def _coded(x: np.ndarray) -> np.ndarray:
    """Expected counts as 16-bit logarithms; what is below 2 ** -30 is 0."""
    out = np.zeros(x.shape, "<u2")
    there = x >= 2.0**_LEAST
    out[there] = np.clip(np.rint((np.log2(x[there]) - _LEAST) * _STEPS) + 1, 1, 65_535)
    return out


def _decoded(code: np.ndarray, kind) -> np.ndarray:
    out = np.exp2((code.astype(kind) - kind(1)) * kind(1 / _STEPS) + kind(_LEAST))
    out[code == 0] = 0
    return out


def _pieces(lens: np.ndarray, which: np.ndarray, most: int = 250_000) -> Iterator[np.ndarray]:
    """The documents ``which`` in runs of about ``most`` tokens and like lengths: memory doesn't grow with a block, and few steps are short."""
    order = which[np.argsort(-lens[which], kind="stable")]
    before = np.cumsum(lens[order]) - lens[order]
    yield from np.split(order, np.flatnonzero(np.diff(before // most)) + 1)


def _blocks(block_tokens: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, serial = _Numbers(), TaskContext.get().partitionId() << 24
        ids, held, tokens, total = [], [], [], 0

        def out() -> pa.RecordBatch:
            lens, number = [len(x) for x in tokens], np.concatenate(tokens)
            tokens.clear()
            vocabulary = np.empty(len(numbers) + 1, np.int64)
            vocabulary[0] = END
            vocabulary[1:] = np.fromiter(map(xxhash.xxh3_64_intdigest, numbers), np.uint64, len(numbers)).view(np.int64)
            numbers.clear()
            order = np.argsort(-np.bincount(number, minlength=len(vocabulary)), kind="stable")
            place = np.empty(len(order), "<u4")
            place[order] = np.arange(len(order))
            row = [[serial], [ids], [held], [lens], [vocabulary[order].astype("<i8").tobytes()], [_pack(place[number])]]
            kinds = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.int32()), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(row, kinds)], ["block", "ids", "held", "lens", "vocabulary", "tokens"])

        for batch in batches:
            for i, h, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                words = (text.as_py() or "").encode("utf-8", "surrogatepass").lower().split()
                x = np.zeros(len(words) + 1, np.int32)
                x[:-1] = np.fromiter(map(numbers.__getitem__, words), np.int32, len(words))
                ids.append(i)
                held.append(h)
                tokens.append(x)
                total += len(x)
                if total >= block_tokens:
                    yield out()
                    ids, held, tokens, total, serial = [], [], [], 0, serial + 1
        if ids:
            yield out()

    return run


def _row(batch: pa.RecordBatch, r: int) -> tuple:
    """Block, ids, held, lens, vocabulary, tokens of a row."""
    block, ids, held, lens = (batch.column(k)[r].as_py() for k in range(4))
    return block, ids, np.array(held), np.array(lens), np.frombuffer(batch.column(4)[r].as_buffer(), "<i8"), _unpack(batch.column(5)[r].as_buffer())


_SENT = "part int, block long, words binary, x binary, stats array<double>"
_ANSWER = "block long, part int, x binary, stats array<double>"


def _part(vocabulary: np.ndarray, parts: int) -> np.ndarray:
    return (vocabulary.astype(np.int64).view(np.uint64) % np.uint64(parts)).astype(np.int32)


def _dealt(vocabulary: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """The words ordered by their part, and where each part begins and ends."""
    part = _part(vocabulary, parts)
    order = np.argsort(part, kind="stable")
    return order, np.searchsorted(part[order], np.arange(parts + 1))


def _send(block: int, vocabulary: np.ndarray, x: np.ndarray, parts: int) -> pa.RecordBatch:
    """``x``, a row a word, as rows of :data:`_SENT`."""
    order, at = _dealt(vocabulary, parts)
    words, x, full = vocabulary[order], x[order], np.flatnonzero(np.diff(at))
    cut = lambda y, f: pa.array([f(y[at[k] : at[k + 1]]) for k in full], pa.binary())
    return _sent([full.astype(np.int32), np.full(len(full), block), cut(words, np.ndarray.tobytes), cut(x, _shrink), pa.nulls(len(full), pa.list_(pa.float64()))])


def _sent(columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c) if isinstance(c, np.ndarray) else c for c in columns], ["part", "block", "words", "x", "stats"])


def _answered(found: pa.Scalar, vocabulary: np.ndarray, parts: int, kind: str) -> np.ndarray:
    """What the parts answered to a block, a row a word of its vocabulary."""
    order, _ = _dealt(vocabulary, parts)
    parts_of, sent = found.values.field("part"), found.values.field("x")
    out, at = None, 0
    for k in np.argsort(parts_of.to_numpy(), kind="stable"):
        x = _grown(sent[int(k)].as_buffer(), kind)
        if out is None:
            n = len(x) // int(np.searchsorted(part_of := _part(vocabulary, parts)[order], part_of[0], "right")) if len(x) else 1
            out = np.empty((len(order), n), kind)
        rows = len(x) // out.shape[1]
        out[order[at : at + rows]] = x.reshape(rows, -1)
        at += rows
    return out


def _summed(kind: str, states: int, seed: int):
    """Sums the numbers of a part's words and answers each block, with sums by state; for counts, also tokens and words.

    Part -1 is what tasks summed: a row a task.
    """

    def run(table: pa.Table) -> pa.Table:
        if table["stats"].null_count == 0:
            return out([[None, -1, None, list(np.sum(table["stats"].to_pylist(), 0))]])
        table = table.sort_by("block")
        words = [np.frombuffer(w, "<i8") for w in table["words"].to_pylist()]
        distinct, number = np.unique(np.concatenate(words), return_inverse=True)
        x = np.concatenate([_grown(y, kind) for y in table["x"].to_pylist()]).reshape(len(number), -1)
        total = np.stack([np.bincount(number, column if kind == "<f8" else _decoded(column, np.float64), len(distinct)) for column in x.T], 1)
        told = total if kind == "<f8" else _coded(total)
        back, at = told[number], np.cumsum([0, *map(len, words)])
        rows = [[b, p, _shrink(back[at[k] : at[k + 1]]), None] for k, (b, p) in enumerate(zip(table["block"].to_pylist(), table["part"].to_pylist()))]
        if kind == "<f8":
            c = total[:, 0]
            there = c > 0
            rows.append([None, rows[0][1], None, [c.sum(), there.sum(), *(noise(distinct[there], states, seed) * (c[there] + 1)).sum(1)]])
        else:
            # Sums by state are of the numbers as the blocks read them, so that each state's emissions add up to 1.
            rows.append([None, rows[0][1], None, [*np.zeros(states + states**2), *_decoded(told, np.float64).sum(0)]])
        return out(rows)

    def out(rows: list[list]) -> pa.Table:
        kinds = [pa.int64(), pa.int32(), pa.binary(), pa.list_(pa.float64())]
        return pa.table([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], ["block", "part", "x", "stats"])

    return run


def _counted(parts: int):
    """How often a block's training documents hold its words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(len(batch)):
                block, _, held, lens, vocabulary, tokens = _row(batch, r)
                yield _send(block, vocabulary, np.bincount(tokens[np.repeat(~held, lens)], minlength=len(vocabulary)).astype("<f8"), parts)

    return run


def _emitted(batch: pa.RecordBatch, r: int, vocabulary: np.ndarray, emissions: Emissions, parts: int, kind) -> tuple[np.ndarray | None, np.ndarray]:
    """Training counts, where given, and emission probabilities of a block's words, a row a word; before the first iteration there is no eighth column."""
    c = _answered(batch.column(6)[r], vocabulary, parts, "<f8")[:, 0] if batch.column(6)[r].is_valid else None
    if batch.num_columns == 7:
        return c, emissions.first(vocabulary, c, kind)
    return c, emissions.trained(_decoded(_answered(batch.column(7)[r], vocabulary, parts, "<u2"), kind))


def _expected(start: np.ndarray, move: np.ndarray, emissions: Emissions, parts: int):
    def block_of(batch: pa.RecordBatch, r: int, row: tuple, stats: np.ndarray) -> pa.RecordBatch:
        block, _, held, lens, vocabulary, tokens = row
        e = np.zeros((len(vocabulary), len(start)))
        if not held.all():
            model = HMM(start, move, _emitted(batch, r, vocabulary, emissions, parts, np.float32)[1].T)
            begin = np.cumsum(lens) - lens
            for docs in _pieces(lens, np.flatnonzero(~held)):
                seq = _Sequences(lens[docs], begin[docs])
                s, m, _ = seq.counts(model, tokens[seq.source], e)
                stats[: -len(start)] += np.concatenate([s, m.ravel()])
                del seq
            del model
        return _send(block, vocabulary, _coded(e), parts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stats = np.zeros(2 * len(start) + move.size)
        for batch in batches:
            for r in range(len(batch)):
                yield block_of(batch, r, _row(batch, r), stats)
        yield _sent([np.full(1, -1, np.int32), pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.nulls(1, pa.binary()), pa.array([stats])])

    return run


def _scores(start: np.ndarray, move: np.ndarray, emissions: Emissions, parts: int, total: int):
    def block_of(batch: pa.RecordBatch, r: int, row: tuple) -> pa.RecordBatch:
        _, ids, held, lens, vocabulary, tokens = row
        c, emit = _emitted(batch, r, vocabulary, emissions, parts, np.float64)
        doc = np.repeat(np.arange(len(lens)), lens)
        sum_by_doc = lambda x: np.bincount(doc, x, len(lens))
        base = sum_by_doc(np.log10((c + 1) / (total + emissions.distinct + 1))[tokens])
        known = sum_by_doc((c > 0).astype(float)[tokens]).astype(np.int64)
        del doc
        markov, begin = np.empty(len(lens)), np.cumsum(lens) - lens
        for docs in _pieces(lens, np.arange(len(lens))):
            seq = _Sequences(lens[docs], begin[docs])
            _, scale = seq.forward(HMM(start, move, emit.T), tokens[seq.source])
            markov[docs[seq.order]] = np.bincount(seq.rank, np.log10(scale), len(lens[docs]))
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(held), pa.array(lens.astype(np.int64)), pa.array(known), pa.array(base), pa.array(markov)], ["id", "held_out", "n_tokens", "n_known", "base_score", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(len(batch)):
                yield block_of(batch, r, _row(batch, r))

    return run


def _sums(df: DataFrame, size: int) -> np.ndarray:
    got = df.filter("stats is not null").select(F.posexplode("stats").alias("at", "x")).groupBy("at").agg(F.sum("x").alias("x")).collect()
    flat = np.zeros(size)
    for r in got:
        flat[r["at"]] = r["x"]
    return flat


def _free_shuffles(spark: SparkSession) -> None:
    """Spark drops the shuffle files of a finished query once the driver has collected its plan."""
    gc.collect()
    spark._jvm.System.gc()


@contextlib.contextmanager
def _small_batches(spark: SparkSession, size: str = "4m") -> Iterator[None]:
    """A row of a block or two at a time goes to Python."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key, None)
    spark.conf.set(key, size)
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def score_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", states: int = 8, iterations: int = 4, block_tokens: int = 2_000_000, modulus: int = 7, remainder: int = 2, seed: int = 3, part_words: int = 250_000) -> DataFrame:
    """One row per row of ``docs``: id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10 probabilities).

    Rows with crc32(id) mod ``modulus`` = ``remainder`` teach nothing; a null id is never held out. A null or empty
    text is its end alone. Repeated rows all count. Without training rows every token is unknown. Other columns are
    ignored, whatever their names. A part sums about ``part_words`` numbers, one for each word of each block.
    """
    with _small_batches(docs.sparkSession):
        scored, total = _scored(docs, id_col, text_col, states, iterations, block_tokens, modulus, remainder, seed, part_words)
    return scored.select(F.col("id").alias(id_col), "held_out", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score")


def _scored(docs: DataFrame, id_col: str, text_col: str, states: int, iterations: int, block_tokens: int, modulus: int, remainder: int, seed: int, part_words: int) -> tuple[DataFrame, int]:
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("id"), held_out(F.col(id_col), modulus, remainder).alias("held"), F.col(text_col).cast("string").alias("t"))
    columns = ["block", "ids", "held", "lens", "vocabulary", "tokens"]
    raw, raw_path = write_shared(rows.mapInArrow(_blocks(block_tokens), "block long, ids array<long>, held array<boolean>, lens array<int>, vocabulary binary, tokens binary"), "blocks")
    size = raw.agg(F.sum(F.length("vocabulary")) / 8).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(size / part_words))

    def answers(sent: DataFrame, kind: str) -> DataFrame:
        return sent.groupBy("part").applyInArrow(_summed(kind, states, seed), _ANSWER)

    def by_block(answer: DataFrame, name: str) -> DataFrame:
        return answer.filter("block is not null").groupBy("block").agg(F.collect_list(F.struct("part", "x")).alias(name))

    counts, counts_path = write_shared(answers(raw.mapInArrow(_counted(parts), _SENT), "<f8"), "counts")
    flat = _sums(counts, 2 + states)
    total, distinct = int(flat[0]), int(flat[1])
    # In buckets by block, so that blocks are not shuffled again in each iteration.
    blocks_path, name = f"{shared_dir(spark)}/corvid/bucketed-{uuid.uuid4().hex[:12]}", f"corvid_blocks_{uuid.uuid4().hex[:12]}"
    raw.join(by_block(counts, "counted"), "block").select(*columns, "counted").write.format("parquet").bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), "block").option("path", blocks_path).saveAsTable(name)
    blocks = spark.table(name)
    drop_shared(spark, raw_path, counts_path)
    _free_shuffles(spark)

    (start, move), emissions, ready, old = first_moves(states), Emissions(states, seed, distinct, flat[2:]), blocks, []
    for k in range(iterations if total else 0):
        summed, path = write_shared(answers(ready.mapInArrow(_expected(start, move, emissions, parts), _SENT), "<u2"), "expected")
        drop_shared(spark, *old)
        flat, old = _sums(summed, 2 * states + states**2), [path]
        start, move = smoothed(flat[:states]), smoothed(flat[states:-states].reshape(states, states))
        emissions = Emissions(states, seed, distinct, flat[-states:])
        ready = blocks.join(by_block(summed, "expected"), "block")
        if k < iterations - 1:  # only the scores need the counts again
            ready = ready.withColumn("counted", F.lit(None).cast(blocks.schema["counted"].dataType))
        ready = ready.select(*columns, "counted", "expected")
        _free_shuffles(spark)

    scored, _ = write_shared(ready.mapInArrow(_scores(start, move, emissions, parts, total), "id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"), "scores")
    spark.sql(f"DROP TABLE {name}")
    drop_shared(spark, blocks_path, *old)
    return scored, total
