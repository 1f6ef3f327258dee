"""Near-duplicate embeddings by randomised-rotation binary codes with stored correction factors.

A random rotation P turns a unit vector x into signs, the code; the stored factor is f = <sign(Px) / sqrt(D), Px>. For
another unit vector y, <sign(Px) / sqrt(D), Py> / f is an unbiased estimate of <x, y>, off by at most
``sigmas * sqrt((1 - f * f) / f / f) / sqrt(D - 1)`` but with a probability that falls as exp(-sigmas ** 2 / 2). Pairs
whose upper bound misses the threshold are done; all others are recomputed exactly in double precision.

1. Equal vectors form a class; the smallest id stands for it. Its code (a bit a dimension), factor and turned vector
   (single precision) are written once.
2. Runs of code bits are bucket keys. They lengthen with the logarithm of the number of vectors, so that chance pairs
   stay a share of the vectors; the number of runs makes a pair at the threshold meet with probability 1 - ``miss``.
3. Each member meets its buckets' first ids: its stored code and factor with their turned vectors. Only pairs inside the
   bound fetch the vectors themselves. Members in another component than a first id meet its whole star in blocks.
4. Links join members of one component only, so they are counted there: blocks of a component meet pairwise and give
   one count a vector, never a row a pair.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvid.llm.common import blocks_of_stars, bucket_components, drop_shared, lookup, spread_join, write_shared

BLOCK = 256


def rotation(d: int, seed: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng([seed, d]).standard_normal((d, d)))
    return q * np.sign(np.diag(r))


def codes(unit: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rotated vectors, codes (+-1 / sqrt(D)) and correction factors."""
    turned = unit @ rotation(unit.shape[1], seed).T
    code = np.where(turned >= 0, 1.0, -1.0) / math.sqrt(unit.shape[1])
    return turned, code, np.einsum("ij,ij->i", code, turned)


def slack(factor: np.ndarray, d: int, sigmas: float) -> np.ndarray:
    return sigmas * np.sqrt(np.maximum(1 - factor**2, 0)) / factor / math.sqrt(max(d - 1, 1))


def cosines(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.einsum("ij,ij->i", x, y) / (np.sqrt(np.einsum("ij,ij->i", x, x)) * np.sqrt(np.einsum("ij,ij->i", y, y)))


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


#: What single precision may take from an estimate.
ROUNDING = 1e-5


def packed(turned: np.ndarray) -> list[bytes]:
    return [x.tobytes() for x in np.packbits(turned >= 0, axis=1)]


def unpacked(code: list[bytes], d: int) -> np.ndarray:
    bits = np.unpackbits(np.frombuffer(b"".join(code), np.uint8).reshape(len(code), -1), axis=1, count=d)
    return (2.0 * bits - 1) / math.sqrt(d)


def exactly(x: np.ndarray, y: np.ndarray, threshold: float) -> np.ndarray:
    return cosines(x / np.abs(x).max(1, keepdims=True), y / np.abs(y).max(1, keepdims=True)) >= threshold


def _by_size(vectors: list) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    sizes = np.array([len(v) for v in vectors])
    for d in np.unique(sizes):
        which = np.flatnonzero(sizes == d)
        yield which, np.array([vectors[i] for i in which], float)


def _coded(bits: int, bands: int, seed: int):
    """Bucket keys, code, factor and turned vector of each class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = 1 << np.arange(bits, dtype=np.int64)
        for batch in batches:
            ids = np.array(batch.column(0).to_pylist(), np.int64)
            for which, x in _by_size(batch.column(1).to_pylist()):
                d, turns = x.shape[1], math.ceil(bits * bands / x.shape[1])
                unit = _unit(x)
                signs = np.concatenate([unit @ rotation(d, seed + 1 + k).T >= 0 for k in range(turns)], 1)[:, : bits * bands]
                keys = (signs.reshape(len(x), bands, bits) @ place * bands + np.arange(bands)) * 4096 + d % 4096
                turned, _, factor = codes(unit, seed)
                row = [pa.array(ids[which]), pa.array(np.full(len(x), d, np.int32)), pa.array(list(keys), pa.list_(pa.int64())), pa.array(packed(turned), pa.binary()), pa.array(factor), pa.array([t.tobytes() for t in turned.astype("<f4")], pa.binary())]
                yield pa.RecordBatch.from_arrays(row, ["id", "d", "keys", "code", "factor", "turned"])

    return run


def _likely(threshold: float, sigmas: float):
    """Pairs whose estimate's upper bound reaches the threshold, from a's code and factor and b's turned vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d, code, factor, turned = np.array(batch.column(2)), batch.column(3).to_pylist(), np.array(batch.column(4)), batch.column(5).to_pylist()
            near = np.zeros(len(d), bool)
            for size in np.unique(d):
                which = np.flatnonzero((d == size) & (np.array([len(t) for t in turned]) == 4 * size))
                if len(which):
                    y = np.frombuffer(b"".join(turned[i] for i in which), "<f4").reshape(-1, size)
                    estimate = np.einsum("ij,ij->i", unpacked([code[i] for i in which], size), y) / factor[which]
                    near[which] = estimate + slack(factor[which], size, sigmas) + ROUNDING >= threshold
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(near)), batch.column(1).filter(pa.array(near))], ["a", "b"])

    return run


def _confirmed(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            y, keep = batch.column(3).to_pylist(), np.zeros(len(batch), bool)
            for which, x in _by_size(batch.column(2).to_pylist()):
                keep[which] = exactly(x, np.array([y[i] for i in which], float), threshold)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(keep)), batch.column(1).filter(pa.array(keep))], ["a", "b"])

    return run


def _near(left: pd.DataFrame, right: pd.DataFrame, threshold: float, sigmas: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of a row of ``left`` and one of ``right``, of vectors of one length, within the threshold."""
    d = int(left["d"].iloc[0])
    factor, turned = left["factor"].to_numpy(), np.frombuffer(b"".join(right["turned"]), "<f4").reshape(-1, d)
    near = unpacked(list(left["code"]), d) @ turned.T.astype(float) / factor[:, None] + slack(factor, d, sigmas)[:, None] + ROUNDING >= threshold
    a, b = np.nonzero(near)
    x, y, hit = np.stack(left["v"].to_numpy()).astype(float), np.stack(right["v"].to_numpy()).astype(float), np.zeros(len(a), bool)
    for k in range(0, len(a), 65_536):
        s = slice(k, k + 65_536)
        hit[s] = exactly(x[a[s]], y[b[s]], threshold)
    return a[hit], b[hit]


def _joining(threshold: float, sigmas: float):
    """Links between components of each star (lead): every odd member (side 1) against the members (side 0), one for each two components."""

    def run(part: pd.DataFrame) -> pd.DataFrame:
        found = []
        for _, rows in part.groupby(["lead", "d"], sort=False):
            group = {c: c for c in rows["c"]}

            def root(c: int, group: dict = group) -> int:
                while group[c] != c:
                    group[c] = c = group[group[c]]
                return c

            members, odd = rows[rows["side"] == 0], rows[rows["side"] == 1]
            if len(members) and len(odd):
                for k, j in zip(*_near(members, odd, threshold, sigmas)):
                    x, y = members.iloc[k], odd.iloc[j]
                    a, b = root(x["c"]), root(y["c"])
                    if a != b:
                        group[max(a, b)] = min(a, b)
                        found.append((max(x["id"], y["id"]), min(x["id"], y["id"])))
        return pd.DataFrame(found, columns=["a", "b"], dtype="int64")

    return run


def _degrees(threshold: float, sigmas: float):
    """Links of each member to others in blocks (i, j) of one component, or in whole small components."""

    def run(part: pd.DataFrame) -> pd.DataFrame:
        ids, counts = [], []
        for _, rows in part.groupby(["component_id"], sort=False):
            i, j = int(rows["i"].iloc[0]), int(rows["j"].iloc[0])
            copies, block = rows["copies"].to_numpy(), rows["block"].to_numpy()
            left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
            if len(left) and len(right):
                a, b = _near(rows.iloc[left], rows.iloc[right], threshold, sigmas)
                a, b = left[a], right[b]
                a, b = (a[a < b], b[a < b]) if i == j else (a, b)
                ids.append(rows["id"].to_numpy())
                counts.append(np.bincount(a, copies[b], len(rows)) + np.bincount(b, copies[a], len(rows)))
        return pd.DataFrame({"id": np.concatenate(ids) if ids else np.empty(0, np.int64), "links": np.concatenate(counts).astype(np.int64) if ids else np.empty(0, np.int64)})

    return run


def near_embeddings(rows: DataFrame, threshold: float = 0.95, id_col: str = "vec_id", vector_col: str = "embedding", miss: float = 1e-6, seed: int = 5, sigmas: float = 6.0) -> DataFrame:
    """One row per row of ``rows``: id, n_links (other rows within the threshold), component_id, kept.

    Null, empty and zero vectors and those with null or non-finite components link with nothing, nor do vectors of
    different lengths with each other. Ids are expected to be unique; rows with a null id have no links, a null
    component_id and are kept. Other columns are ignored, whatever their names. No rows give no rows.
    """
    v = F.transform(F.col(vector_col), lambda x: x.cast("double") + F.lit(0.0))
    good = F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0), F.lit(False)) & F.col(id_col).isNotNull()
    known = rows.select(F.col(id_col).cast("long").alias("id"), F.when(good, v).alias("v"))
    classes, _ = write_shared(known.filter("v is not null").groupBy("v").agg(F.min("id").alias("rep"), F.count("*").alias("copies")), "vectors")

    bits = max(8, math.ceil(math.log2(max(classes.count(), 1))) + 5)
    agree = (1 - math.acos(threshold) / math.pi) ** bits
    bands = math.ceil(math.log(miss) / math.log1p(-agree))
    reps = classes.select(F.col("rep").alias("id"), "v")
    coded, _ = write_shared(reps.mapInArrow(_coded(bits, bands, seed), "id long, d int, keys array<long>, code binary, factor double, turned binary"), "codes")
    keyed = coded.select(F.explode("keys").alias("key"), "id")
    full = coded.drop("keys").join(reps, "id")
    used = []

    def confirm(pairs: DataFrame, members: DataFrame, counts: DataFrame, n: int) -> DataFrame:
        x = spread_join(pairs, coded.select(F.col("id").alias("l"), "turned"), "b", "l", counts, n, "a")
        x = x.join(coded.select(F.col("id").alias("a"), "d", "code", "factor"), "a").select("a", "b", "d", "code", "factor", "turned")
        near, path = write_shared(x.mapInArrow(_likely(threshold, sigmas), "a long, b long"), "near")
        used.append(path)
        x = spread_join(near, reps.select(F.col("id").alias("l"), F.col("v").alias("vb")), "b", "l", counts, n, "a")
        return x.join(reps.select(F.col("id").alias("a"), F.col("v").alias("va")), "a").select("a", "b", "va", "vb").mapInArrow(_confirmed(threshold), "a long, b long")

    def across(stars: DataFrame, members: DataFrame) -> DataFrame:
        blocks, path = blocks_of_stars(stars, BLOCK)
        used.append(path)
        return blocks.join(full, "id").groupBy("cell", "i", "j").applyInPandas(_joining(threshold, sigmas), "a long, b long")

    of, _ = bucket_components(keyed, confirm, across)
    drop_shared(rows.sparkSession, *used)
    sizes = of.groupBy("component_id").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"), F.count("*").alias("n"))
    total = of.count()
    cells = max(1, total // BLOCK)
    members = spread_join(of, sizes.select(F.col("component_id").alias("k"), "blocks"), "component_id", "k", sizes, total, "id").drop("k").join(full, "id").join(classes.select(F.col("rep").alias("id"), "copies"), "id").withColumn("block", F.pmod(F.xxhash64("id"), "blocks").cast("int"))
    members = members.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other"))
    members = members.withColumn("cell", F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("component_id"), F.lit(cells))).otherwise(-1 - F.col("component_id")))
    counted = members.select("cell", "component_id", "i", "j", "block", "id", "d", "v", "code", "factor", "turned", "copies").groupBy("cell", "i", "j").applyInPandas(_degrees(threshold, sigmas), "id long, links long")
    links = counted.groupBy("id").agg(F.sum("links").alias("links"))

    named = classes.join(links, F.col("rep") == F.col("id"), "left").drop("id").join(of.withColumnRenamed("id", "rep"), "rep", "left")
    named, _ = write_shared(named.select("v", "copies", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component_id", "rep").alias("component_id")), "classes")
    out = lookup(known, named, ["v"], "copies", ["n_links", "component_id"])
    out = out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "id").alias("component_id"))
    return out.withColumn("kept", F.col(id_col).eqNullSafe(F.col("component_id")))


ORACLE_SQL = """
WITH RECURSIVE good AS (
  SELECT vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (SELECT a.id AS a, b.id AS b FROM good a JOIN good b ON a.id <> b.id AND len(a.v) = len(b.v) AND list_cosine_similarity(a.v, b.v) >= 0.95),
reach(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
SELECT vec_id, (SELECT count(*) FROM links WHERE a = vec_id) AS n_links,
  least(vec_id, coalesce((SELECT min(b) FROM reach WHERE a = vec_id), vec_id)) AS component_id,
  vec_id = least(vec_id, coalesce((SELECT min(b) FROM reach WHERE a = vec_id), vec_id)) AS kept
FROM embeddings
"""
