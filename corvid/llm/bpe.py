"""Byte-level BPE with the ranks of a vocabulary file, merged and decoded by DuckDB queries inside each partition.

A task splits its texts by the vocabulary's pattern and hands DuckDB the distinct words it has not met. There, rows
(word, position, token) join the merge table (left, right, rank); a recursive query contracts in every word the
leftmost pair of minimum rank until no pair is left, and an ordered aggregation joins the tokens' bytes again.
Where all pairs that a merged token can form rank higher than itself, its other occurrences in the word would be
next one by one, so one step contracts them all, from the left and without overlap.

Words of ``LONG`` bytes and more are cut into pieces, encoded as words, and joined two by two. A row of tokens is the
encoding of its bytes exactly if each two neighbours are the encoding of theirs, so a joint is right when its two
tokens, encoded as one word, come back; else a window around it is encoded again and doubled until its ends are right.
The work grows with the length times its logarithm.

Words are the unit of work: a Python worker remembers ``remember`` of them, from one task of a job to the next, and encodes
``at_once`` bytes in one query. Long words are not remembered, so memory stays bounded by the texts at hand. Workers live on
and serve other jobs, so one that has had no such task for ``IDLE`` seconds forgets all.
"""

from __future__ import annotations

import base64
import hashlib
import sys
import threading
import types
import uuid
from collections.abc import Callable, Iterator

import duckdb
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words of this many bytes and more are encoded in pieces of ``PIECE`` bytes; windows that long keep one state instead of one a step.
LONG, PIECE = 200, 128
#: Characters of texts whose words are held at once; a longer text is alone.
GROUP = 2_000_000
#: Seconds after its last task in which a worker keeps its codec and words.
IDLE = 3
#: Tokens on either side of a joint that are encoded again first.
WINDOW = 8

_STEP = """
  live AS (SELECT w, pos, t, lead(pos) OVER p AS npos, lead(t) OVER p AS nt FROM {state} WINDOW p AS (PARTITION BY w ORDER BY pos)),
  pairs AS (SELECT w, pos, npos, rank, lone FROM live JOIN merges ON l = t AND r = nt),
  best AS (SELECT w, min(rank) AS rank, arg_min(pos, (rank, pos)) AS lead_pos FROM pairs GROUP BY w),
  same AS (SELECT p.w, p.pos, p.npos, p.rank, lone, lead_pos, lag(p.npos) OVER (PARTITION BY p.w ORDER BY p.pos) IS DISTINCT FROM p.pos AS head
           FROM pairs p JOIN best b ON p.w = b.w AND p.rank = b.rank),
  runs AS (SELECT *, sum(head::INT) OVER (PARTITION BY w ORDER BY pos ROWS UNBOUNDED PRECEDING) AS run FROM same),
  odd AS (SELECT *, row_number() OVER (PARTITION BY w, run ORDER BY pos) AS k FROM runs),
  picked AS (SELECT w, pos, npos, rank FROM odd WHERE CASE WHEN lone THEN pos = lead_pos ELSE k % 2 = 1 END)
"""
#: A row holds a token, the next one, where that stands, and the rank of the two together.
_SHORT_SQL = """
WITH RECURSIVE s(step, w, pos, t, nt, npos, rank) AS (
  SELECT 0, w, pos, t, nt, npos, m.rank FROM start LEFT JOIN merges m ON m.l = t AND m.r = nt
  UNION ALL
  (WITH best AS (SELECT w, min(rank) AS rank, arg_min(pos, rank * 256 + pos) AS pos, arg_min(npos, rank * 256 + pos) AS npos FROM s WHERE rank IS NOT NULL GROUP BY w),
  picked AS (SELECT b.w, b.pos, b.npos, b.rank, q.nt AS nnt, q.npos AS nnpos FROM best b JOIN s q ON q.w = b.w AND q.pos = b.npos),
  next AS (SELECT s.step + 1 AS step, s.w, s.pos,
      CASE WHEN s.pos = p.pos THEN p.rank ELSE s.t END AS t,
      CASE WHEN s.pos = p.pos THEN p.nnt WHEN s.npos = p.pos THEN p.rank ELSE s.nt END AS nt,
      CASE WHEN s.pos = p.pos THEN p.nnpos ELSE s.npos END AS npos
    FROM s JOIN picked p ON p.w = s.w AND s.pos <> p.npos)
  SELECT step, w, pos, t, nt, npos, m.rank FROM next LEFT JOIN merges m ON m.l = t AND m.r = nt)
),
ends AS (SELECT w, max(step) AS step FROM s GROUP BY w)
SELECT w, pos, t FROM s JOIN ends USING (w, step)
"""
_LONG_SQL = (
    """
WITH RECURSIVE s(w, pos, t) USING KEY (w, pos) AS (
  SELECT w, pos, t FROM start
  UNION
  (WITH """
    + _STEP.format(state="(FROM recurring.s WHERE t >= 0)")
    + """
  SELECT w, pos, rank FROM picked UNION ALL SELECT w, npos, -1 FROM picked)
)
SELECT w, pos, t FROM s WHERE t >= 0
"""
)
_RESULT_SQL = """
SELECT w, string_agg(t::VARCHAR, ' ' ORDER BY pos) AS ids, string_agg(hex(bytes), '' ORDER BY pos) AS decoded
FROM ({tokens}) JOIN vocabulary ON id = t GROUP BY w
"""


class WordCodec:
    """Encodes and decodes words by DuckDB; a word's answer is (its ids as text, the bytes of those ids)."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.db = duckdb.connect(config={"threads": 1})
        merges = [(self.ranks[x[:k]], self.ranks[x[k:]], i) for x, i in self.ranks.items() for k in range(1, len(x)) if x[:k] in self.ranks and x[k:] in self.ranks]
        lone = {side for left, right, i in merges for side in (left, right) if i < side}
        vocabulary = pa.table({"id": pa.array(self.ranks.values(), pa.int32()), "bytes": pa.array(self.ranks.keys(), pa.binary())})
        merge_rows = pa.table({"l": pa.array([m[0] for m in merges], pa.int32()), "r": pa.array([m[1] for m in merges], pa.int32()), "rank": pa.array([m[2] for m in merges], pa.int32()), "lone": pa.array([m[2] in lone for m in merges])})
        for name, rows in (("vocabulary", vocabulary), ("merges", merge_rows)):
            self.db.register("given", rows)
            self.db.execute(f"CREATE TABLE {name} AS SELECT * FROM given")
            self.db.unregister("given")
        self.first = [self.ranks[bytes([b])] for b in range(256)]

    def _run(self, words: list[bytes], sql: str, whole_words: bool = True) -> list[tuple[int, str, str]]:
        w, pos, t, nt, npos = [], [], [], [], []
        for i, x in enumerate(words):
            whole = self.ranks.get(x) if whole_words else None
            tokens = [whole] if whole is not None else [self.first[b] for b in x]
            w += [i] * len(tokens)
            pos += range(len(tokens))
            t += tokens
            nt += tokens[1:]
            nt.append(None)
            npos += range(1, len(tokens))
            npos.append(None)
        self.db.register("start", pa.table({k: pa.array(v, pa.int32()) for k, v in (("w", w), ("pos", pos), ("t", t), ("nt", nt), ("npos", npos))}))
        out = self.db.execute(_RESULT_SQL.format(tokens=sql)).fetchall()
        self.db.unregister("start")
        return out

    def merged(self, words: list[bytes], at_once: int, whole_words: bool = True) -> list[tuple[str, bytes]]:
        """Answers by the recursive queries alone; ``whole_words``: a word in the vocabulary is its own token, merged or not."""
        out: list = [None] * len(words)
        for sql, which in ((_SHORT_SQL, [i for i, x in enumerate(words) if len(x) < LONG]), (_LONG_SQL, [i for i, x in enumerate(words) if len(x) >= LONG])):
            k = 0
            while k < len(which):
                chunk, size = [], 0
                while k < len(which) and (not chunk or size < at_once):
                    chunk.append(which[k])
                    size += len(words[which[k]])
                    k += 1
                for i, ids, decoded in self._run([words[j] for j in chunk], sql, whole_words):
                    out[chunk[i]] = (ids, bytes.fromhex(decoded))
        return out

    def encode(self, words: list[bytes], at_once: int) -> list[tuple[str, bytes]]:
        long = [i for i, x in enumerate(words) if len(x) >= LONG and x not in self.ranks]
        if not long:
            return self.merged(words, at_once)
        short = sorted({*range(len(words))}.difference(long))
        out = dict(zip(short, self.merged([words[i] for i in short], at_once)))
        out |= zip(long, self._in_pieces([words[i] for i in long], at_once))
        return [out[i] for i in range(len(words))]

    def _in_pieces(self, words: list[bytes], at_once: int) -> list[tuple[str, bytes]]:
        token, parts = {i: x for x, i in self.ranks.items()}, {}
        known: dict[bytes, list[int]] = {}

        def ask(wanted: list[bytes]) -> None:
            todo = list(dict.fromkeys(x for x in wanted if x not in known))
            for x, (ids, _) in zip(todo, self.merged(todo, at_once, whole_words=False)):
                known[x] = list(map(int, ids.split()))

        cut = [[x[k : k + PIECE] for k in range(0, len(x), PIECE)] for x in words]
        ask([p for pieces in cut for p in pieces])
        parts = [[known[p] for p in pieces] for pieces in cut]
        while any(len(p) > 1 for p in parts):
            joints = [[p[2 * k], p[2 * k + 1], 0, None] for p in parts for k in range(len(p) // 2)]  # left, right, window, joined
            todo = joints
            while todo:
                raw = lambda ids: b"".join(map(token.__getitem__, ids))
                known.clear()
                ask([raw(a[len(a) - k :] + b[:k]) for a, b, k, _ in todo if k])
                middle = [known[raw(a[len(a) - k :] + b[:k])] if k else [] for a, b, k, _ in todo]
                rows = [(a[: len(a) - k], m, b[k:]) for (a, b, k, _), m in zip(todo, middle)]
                ends = [[(x[-1], y[0]) for x, y in ((a, m or b), (m, b if m else [])) if x and y] for a, m, b in rows]
                ask([token[x] + token[y] for e in ends for x, y in e])
                for joint, (a, m, b), e in zip(todo, rows, ends):
                    if all(known[token[x] + token[y]] == [x, y] for x, y in e):
                        joint[3] = a + m + b
                    else:
                        joint[2] = min(2 * joint[2], max(len(joint[0]), len(joint[1]))) or WINDOW
                todo = [joint for joint in todo if joint[3] is None]
            done = iter(joints)
            parts = [[next(done)[3] for _ in range(len(p) // 2)] + p[len(p) - len(p) % 2 :] for p in parts]
        decoded = self.db.cursor()
        flat = [(i, k, t) for i, (ids,) in enumerate(parts) for k, t in enumerate(ids)]
        decoded.register("held", pa.table({name: pa.array([r[c] for r in flat], pa.int32()) for c, name in enumerate(("w", "pos", "t"))}))
        return [(ids, bytes.fromhex(x)) for _, ids, x in sorted(decoded.execute(_RESULT_SQL.format(tokens="SELECT w, pos, t FROM held")).fetchall())]


def _once(name: str, key: str, make: Callable):
    """What ``make`` gives, made once in a Python worker and kept under ``name`` for its later tasks with this ``key``. Functions travel by value, so no module of ours can hold it."""
    kept = sys.modules.setdefault("corvid_worker", types.ModuleType("corvid_worker")).__dict__
    found = kept.get(name)
    if found is None or found[0] != key:
        found = kept[name] = key, make()
    return found[1]


def _keep(seconds: float | None) -> None:
    """Let the worker forget what :func:`_once` kept after so many seconds, or not at all, whatever was said before."""
    kept = sys.modules.setdefault("corvid_worker", types.ModuleType("corvid_worker")).__dict__
    if kept.get("timer"):
        kept["timer"].cancel()
    kept["timer"] = None
    if seconds is not None:

        def forget() -> None:
            for name in ("codec", "words"):
                kept.pop(name, None)

        kept["timer"] = threading.Timer(seconds, forget)
        kept["timer"].daemon = True
        kept["timer"].start()


class _Memory:
    """Answers to words: ids, and decoded bytes where they are not the word's own. When there are more than ``remember``, those met again since the last time stay."""

    def __init__(self, remember: int):
        self.remember, self.ids, self.bytes, self.again = remember, {}, {}, set()

    def room_for(self, new: set, distinct: set) -> set:
        """The words to encode: ``new``, and all of ``distinct`` that had to go."""
        self.again |= distinct - new
        if len(self.ids) + len(new) <= self.remember:
            return new
        keep = self.again if len(self.again) + len(new) <= self.remember else distinct - new
        self.ids, self.bytes = {x: self.ids[x] for x in keep}, {x: self.bytes[x] for x in keep if x in self.bytes}
        self.again = set()
        return distinct.difference(self.ids)

    def forget_long(self, words: set) -> None:
        for x in words:
            if len(x) >= LONG:
                del self.ids[x]
                self.bytes.pop(x, None)

    def put(self, word: str, raw: bytes, ids: str, decoded: bytes) -> None:
        self.ids[word] = ids
        if decoded != raw:
            self.bytes[word] = decoded

    def decoded(self, word: str) -> bytes:
        return self.bytes[word] if word in self.bytes else word.encode("utf-8", "surrogatepass")


def _codec_rows(path: str, pattern: str, remember: int, at_once: int, texts: bool):
    job = uuid.uuid4().hex  # words are remembered within a job only

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = regex.compile(pattern).findall
        codec, memory = _once("codec", path, lambda: WordCodec(path)), _once("words", job, lambda: _Memory(remember))
        for batch in batches:
            found, k = [], 0
            column = batch.column(1)
            while k < len(batch):
                group, distinct, size = [], set(), 0
                while k < len(batch) and (not group or size < GROUP):
                    text = column[k].as_py() or ""
                    words = split(text)
                    group.append(words)
                    size += len(text)
                    distinct.update(words)
                    k += 1
                new = memory.room_for(distinct.difference(memory.ids), distinct)
                todo = list(new)
                raw = [x.encode("utf-8", "surrogatepass") for x in todo]
                for x, y, (ids, decoded) in zip(todo, raw, codec.encode(raw, at_once)):
                    memory.put(x, y, ids, decoded)
                for words in group:
                    ids = " ".join(map(memory.ids.__getitem__, words))
                    decoded = b"".join(map(memory.decoded, words))
                    if texts:
                        found.append((ids.count(" ") + 1 if ids else 0, list(map(int, ids.split())), decoded.decode("utf-8", "replace")))
                    else:
                        found.append((ids.count(" ") + 1 if ids else 0, hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(decoded).hexdigest()))
                memory.forget_long(new)
            kinds = (pa.int64(), pa.list_(pa.int32()) if texts else pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array([x[c] for x in found], kind) for c, kind in enumerate(kinds)]], ["id", "n_tokens", "a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _keep(None)
        try:
            yield from rows(batches)
        finally:
            _keep(IDLE)

    return run


def bpe_round_trip(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", remember: int = 600_000, at_once: int = 300_000) -> DataFrame:
    """One row per row of ``docs``: id, n_tokens, ids (array<int>), decoded (the text of those ids).

    A null or empty text has no tokens and decodes to the empty text. Special tokens are ordinary text. Repeated
    rows and null ids each get their row; other columns are ignored, whatever their names.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("t"))
    out = rows.mapInArrow(_codec_rows(path, pattern, remember, at_once, True), "id long, n_tokens long, a array<int>, b string")
    return out.select(F.col("id").alias(id_col), "n_tokens", F.col("a").alias("ids"), F.col("b").alias("decoded"))


def bpe_digests(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", remember: int = 600_000, at_once: int = 300_000) -> DataFrame:
    """As :func:`bpe_round_trip`, with SHA-256 digests (of the decimal ids joined by spaces, of the decoded bytes) in place of ids and text."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("t"))
    out = rows.mapInArrow(_codec_rows(path, pattern, remember, at_once, False), "id long, n_tokens long, a string, b string")
    return out.select(F.col("id").alias(id_col), "n_tokens", F.col("a").alias("ids_sha256"), F.col("b").alias("decoded_sha256"))
