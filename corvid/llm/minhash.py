"""MinHash near-deduplication on word shingles, with fast similarity sketching, banding and exact verification.

1. Each text's distinct shingles fill a sketch of ``rows * bands`` coordinates: in each of the first t rounds every
   shingle hashes to a bin and a value, and later rounds fill only bins still empty; from round t on, all shingles
   hash to one given bin a round, so no bin stays empty. The total value of a coordinate is (round, value).
2. Documents with equal shingle sets form a class; its smallest id stands for it.
3. Runs of ``rows`` coordinates are bucket keys. At similarity s a pair shares no bucket with probability
   (1 - s ** rows) ** bands: 1.3e-7 at 0.8 with 5 and 40.
4. In each bucket every member is verified against the smallest id on the full sets: pairs grow with documents,
   not with the square of a bucket. The members of all buckets with one smallest id form its star. Those in another
   component than that id are then compared with the whole star, in blocks of ``BLOCK`` on each side: an inverted
   list of a block's shingles gives the exact intersections of one set with all others at once, and a block returns
   one link for each two components it joins.
5. Components by alternating stars, in tables of the shared folder.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvid.llm.common import blocks_of_stars, bucket_components, drop_shared, lookup, sifted, spread_join, write_shared

_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_FREE = np.uint64(0xFFFFFFFFFFFFFFFF)
#: Words whose hashes a task remembers, and shingles that are sketched at once.
_WORDS, _AT_ONCE = 400_000, 400_000


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _B
    x = (x ^ (x >> np.uint64(27))) * _C
    return x ^ (x >> np.uint64(31))


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= _WORDS:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


class Shingler:
    """Sorted distinct 64-bit hashes of a text's shingles of ``width`` words (ASCII white space, A-Z lowered)."""

    def __init__(self, width: int):
        self.width, self.hashes = width, _Hashes()

    def __call__(self, text: str | None) -> np.ndarray:
        words = (text or "").encode("utf-8", "surrogatepass").lower().split()
        if not words:
            return np.empty(0, np.uint64)
        h = np.array(list(map(self.hashes.__getitem__, words)), np.uint64)
        w = min(self.width, len(h))
        n = len(h) - w + 1
        x = h[:n] + np.uint64(w)
        for k in range(1, w):
            x = _mix(x * _A + h[k : k + n])
        return np.unique(x)


def sketch(sets: list[np.ndarray], t: int) -> np.ndarray:
    """``(len(sets), t)`` coordinates; every set must have an element."""
    size = np.array([len(s) for s in sets])
    flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), size)
    out, open_ = np.full(len(sets) * t, _FREE, np.uint64), np.arange(len(sets))
    low, n = np.uint64(0xFFFFFFFF), np.uint64(t)
    for i in range(2 * t):
        x = _mix(flat + np.uint64((i + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
        bins = ((x >> np.uint64(32)) * n >> np.uint64(32)).astype(np.int64) if i < t else i - t
        key = owner * t + bins
        free = out[key] == _FREE
        np.minimum.at(out, key[free], (x[free] & low) | np.uint64(i << 32))
        filled = (out.reshape(-1, t)[open_] != _FREE).all(1)
        if filled.any():
            done = np.zeros(len(sets), bool)
            done[open_[filled]] = True
            open_ = open_[~filled]
            if not len(open_):
                break
            rest = ~done[owner]
            flat, owner = flat[rest], owner[rest]
    return out.reshape(-1, t)


def band_keys(coordinates: np.ndarray, rows: int, bands: int) -> np.ndarray:
    x = coordinates.reshape(len(coordinates), bands, rows)
    key = np.broadcast_to(_mix(np.arange(1, bands + 1, dtype=np.uint64) * _A), x.shape[:2])
    for k in range(rows):
        key = _mix(key * _A + x[:, :, k])
    return key.view(np.int64)


def _sketches(width: int, rows: int, bands: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle = Shingler(width)

        def out(ids: list, sets: list) -> pa.RecordBatch:
            full = [i for i, s in enumerate(sets) if len(s)]
            keys = [None] * len(sets)
            if full:
                for i, k in zip(full, band_keys(sketch([sets[i] for i in full], rows * bands), rows, bands)):
                    keys[i] = k
            sig = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array(sig, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], ["id", "n", "sig", "keys"])

        for batch in batches:
            ids, sets, total = [], [], 0
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids.append(i)
                sets.append(shingle(text.as_py()))
                total += len(sets[-1])
                if total >= _AT_ONCE:
                    yield out(ids, sets)
                    ids, sets, total = [], [], 0
            if ids:
                yield out(ids, sets)

    return run


def _confirmed(width: int, percent: int):
    """Pairs (a, b) whose full sets have 100 * intersection >= percent * union."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle, recent = Shingler(width), {}

        def full(i: int, text: pa.Scalar) -> np.ndarray:
            if i not in recent:
                if len(recent) >= 16:
                    recent.clear()
                recent[i] = shingle(text.as_py())
            return recent[i]

        for batch in batches:
            a, b = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            keep = []
            for k in range(len(a)):
                x, y = shingle(batch.column(2)[k].as_py()), full(b[k], batch.column(3)[k])
                both = len(np.intersect1d(x, y, assume_unique=True))
                if 100 * both >= percent * (len(x) + len(y) - both):
                    keep.append(k)
            yield pa.RecordBatch.from_arrays([pa.array([a[k] for k in keep], pa.int64()), pa.array([b[k] for k in keep], pa.int64())], ["a", "b"])

    return run


#: Documents on each side of a task that compares parts of a star.
BLOCK = 1000


def _joining(width: int, percent: int):
    """Links between components of each star (lead): every odd member (side 1) against the members (side 0)."""

    def run(part: pd.DataFrame) -> pd.DataFrame:
        shingle, sets, found = Shingler(width), {}, []
        for i, text in zip(part["id"], part["t"]):
            if i not in sets:
                sets[i] = shingle(text)
        for _, rows in part.groupby("lead", sort=False):
            group = {c: c for c in rows["c"]}

            def root(c: int, group: dict = group) -> int:
                while group[c] != c:
                    group[c] = c = group[group[c]]
                return c

            members, odd = rows[rows["side"] == 0], rows[rows["side"] == 1]
            ids, own = members["id"].to_numpy(), members["c"].to_numpy()
            size = np.array([len(sets[i]) for i in ids])
            flat = np.concatenate([sets[i] for i in ids])
            order = np.argsort(flat, kind="stable")
            flat, owner = flat[order], np.repeat(np.arange(len(ids)), size)[order]
            for y, c in zip(odd["id"], odd["c"]):
                low, high = np.searchsorted(flat, sets[y], "left"), np.searchsorted(flat, sets[y], "right")
                n = high - low
                at = np.arange(n.sum()) + np.repeat(low - (np.cumsum(n) - n), n)
                both = np.bincount(owner[at], minlength=len(ids))
                hits = np.flatnonzero((100 * both >= percent * (size + len(sets[y]) - both)) & (own != c))
                for k in hits[np.unique(own[hits], return_index=True)[1]]:
                    a, b = root(own[k]), root(c)
                    if a != b:
                        group[max(a, b)] = min(a, b)
                        found.append((max(y, ids[k]), min(y, ids[k])))
        return pd.DataFrame(found, columns=["a", "b"], dtype="int64")

    return run


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80, rows: int = 5, bands: int = 40) -> DataFrame:
    """One row per row of ``docs``: id, n_shingles, component_id (smallest id reachable by links), kept.

    A text with fewer than ``width`` words has its whole sequence as its one shingle; null and wordless texts have
    none and link with nothing. Ids are expected to be unique or to repeat with the same text; repeated rows each
    get their row. A row with a null id links with nothing: its component_id is null and it is kept. Other columns
    are ignored, whatever their names. No rows give no rows.
    """
    spark = docs.sparkSession
    rows_in = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("t"))
    sketches, _ = write_shared(rows_in.mapInArrow(_sketches(width, rows, bands), "id long, n long, sig binary, keys array<long>"), "sketches")
    classes = sketches.filter("sig is not null and id is not null").groupBy("sig").agg(F.min("id").alias("rep"), F.count("*").alias("copies"))

    reps = sketches.join(classes.select(F.col("rep").alias("id"), F.col("sig").alias("s")), "id", "inner").filter("sig = s").dropDuplicates(["id"])
    keyed = reps.select(F.explode("keys").alias("key"), "id")
    made: dict = {}

    def texts_of(members: DataFrame) -> DataFrame:
        if "texts" not in made:
            wanted = members.select(F.col("id").alias("w"))
            made["texts"] = write_shared(sifted(rows_in, "id", wanted, "w").join(wanted, F.col("id") == F.col("w"), "left_semi").dropDuplicates(["id"]), "texts")
        return made["texts"][0]

    def confirm(pairs: DataFrame, members: DataFrame, counts: DataFrame, n: int) -> DataFrame:
        texts = texts_of(members)
        x = spread_join(pairs, texts.select(F.col("id").alias("l"), F.col("t").alias("tb")), "b", "l", counts, n, "a")
        x = x.join(texts.select(F.col("id").alias("a"), F.col("t").alias("ta")), "a").select("a", "b", "ta", "tb")
        return x.mapInArrow(_confirmed(width, percent), "a long, b long")

    def across(stars: DataFrame, members: DataFrame) -> DataFrame:
        blocks, made["sizes"] = blocks_of_stars(stars, BLOCK)
        return blocks.join(texts_of(members), "id").groupBy("cell", "i", "j").applyInPandas(_joining(width, percent), "a long, b long")

    of, _ = bucket_components(keyed, confirm, across)
    drop_shared(spark, made["texts"][1], made["sizes"])

    named, _ = write_shared(classes.join(of.select(F.col("id").alias("rep"), "component_id"), "rep", "left").select("sig", "copies", F.coalesce("component_id", "rep").alias("found")), "classes")
    out = lookup(sketches.select("id", "n", F.when(F.col("id").isNotNull(), F.col("sig")).alias("sig")), named, ["sig"], "copies", ["found"])
    out = out.withColumn("component_id", F.coalesce("found", "id"))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **params) -> DataFrame:
    """The rows of ``docs``, all columns, that :func:`near_dedup` keeps: one document of each component."""
    kept = near_dedup(docs, id_col, text_col, **params).filter("kept").select(F.col(id_col).alias("__kept")).distinct()
    return docs.join(kept, F.col(id_col).cast("long").eqNullSafe(F.col("__kept")), "left_semi")
