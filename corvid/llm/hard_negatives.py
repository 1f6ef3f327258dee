"""Hard negatives by product quantisation with stored residual norms, completed by an exact integer rerank.

1. Components become floor(256 * x). Codebooks (a dimension pair each, ``centroids`` whole-number centroids) are fitted by
   k-means on ``fit_rows`` rows of least id hash; every row is coded. A block of rows has vectors, codes and the norms of
   what the codes leave over.
2. Query rows (``vec_id`` divisible by ``every``) form blocks of their own; each meets every block of rows once, by an
   equi-join on slots that blocks are dealt to, and never leaves more than k rows a query and block.
3. In a pair of blocks, table lookups add up to an estimate of each inner product, off by |query| * |residual| at most.
   The exact scores of the k best estimates give a floor; rows whose upper bound misses it, or whose lower bound lies
   above the window, are out. All others are scored exactly, in whole numbers.
4. Positives (the first ``n_positives`` rows of the query's label) come first; each opens a window of scores, which the
   same search fills with rows of other labels.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvid.llm.common import drop_shared, write_shared

EXACT = float(1 << 53)
LONG = (1 << 63) - 1
BLOCKS = "d int, ids binary, labels binary, vectors binary, codes binary, residuals binary"


def centroids_of(points: np.ndarray, k: int, rounds: int = 6) -> np.ndarray:
    """Whole-number centroids of ``points`` by k-means, from distinct points spread over their order; at least one."""
    distinct = np.unique(points, axis=0)
    c = distinct[np.linspace(0, len(distinct) - 1, min(k, len(distinct))).astype(int)]
    for _ in range(rounds if len(distinct) > k else 0):
        near = nearest(points, c)
        n = np.bincount(near, minlength=len(c))
        sums = np.stack([np.bincount(near, points[:, j], len(c)) for j in range(points.shape[1])], 1)
        c = np.where(n[:, None] > 0, np.rint(sums / np.maximum(n, 1)[:, None]), c)
    return c


def nearest(points: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Which centroid to code a point by. Any choice is right, as what it leaves over is measured; this one leaves little."""
    scale = max(1.0, np.abs(points).max(initial=0), np.abs(c).max(initial=0))
    p, q = points / scale, c / scale
    out = [np.argmin((q**2).sum(1) - 2 * (p[k : k + 8192] @ q.T), 1) for k in range(0, len(p), 8192)]
    return np.concatenate(out) if out else np.empty(0, int)


class Codebooks:
    """Centroids of dimension pairs, by vector length; a length that was not fitted has none, and its estimates are 0."""

    def __init__(self, sample: list[list[float]], centroids: int = 256):
        by: dict[int, list] = {}
        for v in sample:
            by.setdefault(len(v), []).append(v)
        self.of = {d: [centroids_of(np.array(rows)[:, k : k + 2], centroids) for k in range(0, d, 2)] for d, rows in by.items()}

    def code(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes (a column a dimension pair) and norms of residuals, rounded up."""
        books = self.of.get(x.shape[1], [])
        codes = np.stack([nearest(x[:, 2 * k : 2 * k + 2], c) for k, c in enumerate(books)], 1).astype(np.uint8) if books else np.empty((len(x), 0), np.uint8)
        rest = x - np.concatenate([c[codes[:, k]] for k, c in enumerate(books)], 1) if books else x
        return codes, norms(rest)


def norms(x: np.ndarray) -> np.ndarray:
    """Euclidean norms, not below the true ones."""
    scale = np.maximum(np.abs(x).max(1, initial=0), 1.0)
    return np.sqrt(((x / scale[:, None]) ** 2).sum(1)) * scale * (1 + 1e-12)


def estimates(q: np.ndarray, codes: np.ndarray, books: list[np.ndarray]) -> tuple[np.ndarray, float]:
    """Table lookups added up, a row a coded row and a column a query, and what rounding may take from them."""
    if not books or codes.shape[1] == 0:
        return np.zeros((len(codes), len(q)), np.float32), 0.0
    most = sum(float(np.abs(c).max()) * float(np.abs(q[:, 2 * k : 2 * k + 2]).max()) * c.shape[1] for k, c in enumerate(books))
    kind = np.float32 if most < 1 << 24 else np.float64
    out = np.zeros((len(codes), len(q)), kind)
    for k, c in enumerate(books):
        table = (c @ q[:, 2 * k : 2 * k + 2].T).astype(kind)
        out += table[codes[:, k]]
    return out, 0.0 if most < EXACT else most * 1e-12


def exact(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products of rows of q with rows of x as whole numbers: int64 where all fit, else Python's, held to 64 bits."""
    most = float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * max(q.shape[1], 1)
    if most < EXACT:
        return np.einsum("ij,ij->i", q, x).astype(np.int64)
    return np.array([max(-LONG - 1, min(LONG, sum(int(a) * int(b) for a, b in zip(u, v)))) for u, v in zip(q, x)], np.int64)


def best(q: np.ndarray, x: np.ndarray, ids: np.ndarray, est: np.ndarray, slack: np.ndarray, allowed: np.ndarray, low: np.ndarray, high: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row, score) of the first k rows a query with low <= score <= high, by score downwards and then id.

    ``est`` (query, row) is off by ``slack`` (query, row) at most. The k best estimates among rows surely not above the
    window are scored first; if all k lie in it, the least of them is the floor, else the window's lower end is.
    """
    none = (np.empty(0, int), np.empty(0, int), np.empty(0, np.int64))
    if not len(q) or not len(x):
        return none
    top, bottom = est + slack, est - slack
    floor = low.copy()
    sure = np.where(allowed & (top <= high[:, None]), est, -np.inf)
    if len(x) > k:
        seeds = np.argpartition(-sure, k - 1, axis=1)[:, :k]
        full = np.flatnonzero(np.isfinite(np.take_along_axis(sure, seeds, 1)).all(1))
        if len(full):
            scores = exact(np.repeat(q[full], k, 0), x[seeds[full].ravel()]).reshape(-1, k)
            floor[full] = np.maximum(floor[full], scores.min(1).astype(float) * (1 - 1e-15 * np.sign(scores.min(1))))
    a, b = np.nonzero(allowed & (top >= floor[:, None]) & (bottom <= high[:, None]))
    found = []
    for s in range(0, len(a), 1 << 16):
        i, j = a[s : s + (1 << 16)], b[s : s + (1 << 16)]
        score = exact(q[i], x[j])
        keep = (score >= low[i]) & (score <= high[i])
        found.append((i[keep], j[keep], score[keep]))
    if not found:
        return none
    i, j, score = (np.concatenate(c) for c in zip(*found))
    order = np.lexsort((ids[j], -score.astype(float), i)) if np.abs(score).max(initial=0) < EXACT else np.array(sorted(range(len(i)), key=lambda n: (i[n], -int(score[n]), ids[j[n]])), int)
    i, j, score = i[order], j[order], score[order]
    place = np.arange(len(i)) - np.searchsorted(i, i)
    return i[place < k], j[place < k], score[place < k]


def _packed(codebooks: Codebooks, rows_a_block: int):
    """Blocks of rows of one length, as they come in a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: dict[int, list[tuple]] = {}
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                rows = waiting.setdefault(len(row[2]), [])
                rows.append(row)
                if len(rows) == rows_a_block or sum(map(len, waiting.values())) > 4 * rows_a_block:
                    d = max(waiting, key=lambda k: len(waiting[k]))
                    yield block(waiting.pop(d), d)
        for d, rows in waiting.items():
            yield block(rows, d)

    def block(rows: list[tuple], d: int) -> pa.RecordBatch:
        x = np.array([r[2] for r in rows], float).reshape(len(rows), d)
        small = np.abs(x).max(initial=0) < 32768
        codes, rest = codebooks.code(x)
        row = [d, np.array([r[0] for r in rows], "<i8").tobytes(), np.array([r[1] for r in rows], "<i8").tobytes(), (b"h" + x.astype("<i2").tobytes()) if small else (b"d" + x.astype("<f8").tobytes()), codes.tobytes(), rest.astype("<f8").tobytes()]
        kinds = [pa.int32(), *[pa.binary()] * 5]
        return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds)], ["d", "ids", "labels", "vectors", "codes", "residuals"])

    return run


def _longs(b: bytes) -> np.ndarray:
    return np.frombuffer(b, "<i8")


def _vectors(b: bytes, d: int, n: int) -> np.ndarray:
    return np.frombuffer(b, "<i2" if b[:1] == b"h" else "<f8", offset=1).reshape(n, d).astype(float) if b[:1] == b"h" else np.frombuffer(b[1:], "<f8").reshape(n, d)


def window(positive: int, low: int, high: int) -> tuple[int, int]:
    """The whole numbers n with low * positive <= 100 * n <= high * positive."""
    return -((-low * positive) // 100), (high * positive) // 100


def _searched(codebooks: Codebooks, k: int, percents: tuple[int, int] | None):
    """The first k rows of each query of a block in a block of rows: of its label, or (with ``percents``) of other labels in the window of each of its positives."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                numbers, labels, q_ids = _longs(r["q_numbers"]), _longs(r["q_labels"]), _longs(r["q_ids"])
                ids, other, d = _longs(r["ids"]), _longs(r["labels"]), r["d"]
                q, x = _vectors(r["q_vectors"], d, len(q_ids)), _vectors(r["vectors"], d, len(ids))
                codes = np.frombuffer(r["codes"], np.uint8).reshape(len(ids), -1)
                rest, books = np.frombuffer(r["residuals"], "<f8"), codebooks.of.get(d, [])
                est, lost = estimates(q, codes, books)
                est, slack = est.T, norms(q)[:, None] * rest[None, :] * (1 + 1e-9) + lost + 0.5
                if percents is None:
                    allowed = (labels[:, None] == other[None, :]) & (q_ids[:, None] != ids[None, :])
                    ends = np.full(len(q), np.inf)
                    i, j, score = best(q, x, ids, est, slack, allowed, -ends, ends, k)
                    yield out(numbers[i], np.zeros(len(i), np.int64), ids[j], score)
                else:
                    allowed = labels[:, None] != other[None, :]
                    for place, scores in enumerate(np.frombuffer(r["q_scores"], "<i8").reshape(-1, len(q)), 1):
                        has = np.flatnonzero(np.frombuffer(r["q_counts"], "<i8") >= place)
                        ends = np.array([window(int(s), *percents) for s in scores[has]], float).reshape(-1, 2)
                        i, j, score = best(q[has], x, ids, est[has], slack[has], allowed[has], ends[:, 0], ends[:, 1], k)
                        yield out(numbers[has][i], np.full(len(i), place), ids[j], score)

    def out(query: np.ndarray, place: np.ndarray, ids: np.ndarray, score: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(query, pa.int64()), pa.array(place, pa.int32()), pa.array(ids, pa.int64()), pa.array(score, pa.int64())], ["query", "place", "id", "score"])

    return run


def _query_blocks(rows: pd.DataFrame) -> pd.DataFrame:
    """Queries (query, id, label, d, v, scores) of one group as one row."""
    most = max((len(s) for s in rows["scores"]), default=0)
    scores = np.zeros((most, len(rows)), "<i8")
    for j, found in enumerate(rows["scores"]):
        scores[: len(found), j] = found
    v = np.array([list(x) for x in rows["v"]], float).reshape(len(rows), -1)
    packed = (b"h" + v.astype("<i2").tobytes()) if np.abs(v).max(initial=0) < 32768 else (b"d" + v.astype("<f8").tobytes())
    row = [int(rows["d"].iloc[0]), rows["query"].to_numpy("<i8").tobytes(), rows["id"].to_numpy("<i8").tobytes(), rows["label"].to_numpy("<i8").tobytes(), packed, scores.tobytes(), np.array([len(s) for s in rows["scores"]], "<i8").tobytes()]
    return pd.DataFrame([row], columns=["q_d", "q_numbers", "q_ids", "q_labels", "q_vectors", "q_scores", "q_counts"])


def hard_negatives(rows: DataFrame, n_positives: int = 5, n_negatives: int = 10, low: int = 30, high: int = 90, every: int = 100, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", fit_rows: int = 4096, block_rows: int = 4096, query_rows: int = 512) -> DataFrame:
    """Rows (anchor_id, positive_id, rank, negative_id, positive_score, negative_score), for anchors whose id ``every`` divides.

    Rows with a null id, label, vector or component, or with a non-finite one, take no part. Vectors of different
    lengths never meet. Where ids repeat, rows count one by one, but none is another's positive under one id. Scores
    beyond 64 bits count as the nearest such number. Other columns are ignored, whatever their names. An anchor without
    positives, and a positive without rows in its window, give no rows; nor does an empty table.
    """
    spark = rows.sparkSession
    v = F.transform(F.col(vector_col), lambda x: F.lit(256.0) * x.cast("double"))
    x = rows.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), v.alias("v"))
    x = x.filter(F.col("id").isNotNull() & F.col("label").isNotNull() & F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))))
    x, path = write_shared(x.select("id", "label", F.transform("v", lambda c: c - F.pmod(c, F.lit(1.0))).alias("v")), "vectors")
    return _mined(spark, x, path, n_positives, n_negatives, low, high, every, fit_rows, block_rows, query_rows)


def _mined(spark, x: DataFrame, path: str, n_positives: int, n_negatives: int, low: int, high: int, every: int, fit_rows: int, block_rows: int, query_rows: int) -> DataFrame:
    sample = x.orderBy(F.xxhash64("id"), "id").limit(fit_rows).select("v").collect()
    codebooks = Codebooks([r["v"] for r in sample])
    blocks, blocks_path = write_shared(x.mapInArrow(_packed(codebooks, block_rows), BLOCKS).withColumn("number", F.monotonically_increasing_id()), "blocks")
    slots = max(1, blocks.count())
    blocks = blocks.withColumn("slot", F.pmod(F.xxhash64("number"), F.lit(slots)))
    queries, queries_path = write_shared(x.filter(F.col("id") % every == 0).withColumn("query", F.monotonically_increasing_id()).withColumn("d", F.size("v")), "queries")
    n = queries.count()
    group = F.pmod(F.xxhash64("query"), F.lit(max(1, math.ceil(n / query_rows))))

    def search(asked: DataFrame, k: int, percents: tuple[int, int] | None, name: str) -> tuple[DataFrame, str]:
        packed, packed_path = write_shared(asked.groupBy(group.alias("g"), "d").applyInPandas(_query_blocks, "q_d int, q_numbers binary, q_ids binary, q_labels binary, q_vectors binary, q_scores binary, q_counts binary"), "query-blocks")
        met = packed.withColumn("slot", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(slots - 1).cast("long")))).join(blocks, "slot").filter("q_d = d")
        found = met.mapInArrow(_searched(codebooks, k, percents), "query long, place int, id long, score long")
        first = Window.partitionBy("query", "place").orderBy(F.desc("score"), "id")
        out = write_shared(found.withColumn("rank", F.row_number().over(first)).filter(F.col("rank") <= k), name)
        drop_shared(spark, packed_path)
        return out

    positives, _ = search(queries.withColumn("scores", F.array().cast("array<long>")), n_positives, None, "positives")
    scores = positives.groupBy("query").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "score"))), lambda p: p["score"]).alias("scores"))
    negatives, _ = search(queries.join(scores, "query"), n_negatives, (low, high), "negatives")
    drop_shared(spark, path, blocks_path)
    named = positives.select("query", F.col("rank").alias("place"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    out = negatives.join(named, ["query", "place"]).join(queries.select("query", F.col("id").alias("anchor_id")), "query")
    return out.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


ORACLE_SQL = """
WITH good AS (
  SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label::BIGINT + 1) % 10 ELSE label::BIGINT END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
met AS (SELECT a.id AS anchor, b.id, a.label = b.label AS same, list_inner_product(a.v, b.v)::BIGINT AS score FROM good a JOIN good b ON a.id % 100 = 0 AND a.id <> b.id AND len(a.v) = len(b.v)),
positives AS (SELECT anchor, id, score FROM met WHERE same QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY score DESC, id) <= 5)
SELECT p.anchor AS anchor_id, p.id AS positive_id, row_number() OVER (PARTITION BY p.anchor, p.id ORDER BY n.score DESC, n.id)::INTEGER AS rank, n.id AS negative_id, p.score AS positive_score, n.score AS negative_score
FROM positives p JOIN met n ON p.anchor = n.anchor AND NOT n.same AND 30 * p.score <= 100 * n.score AND 100 * n.score <= 90 * p.score
QUALIFY rank <= 10
"""
