"""Vector search: batches of queries against a whole collection, in blocks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvid.sources.shared import drop_shared, write_shared

BLOCK = 2048


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (id, v, category) as blocks of up to BLOCK unit vectors of one length; vectors without direction are left out."""
    waiting: dict[int, tuple[list, list, np.ndarray]] = {}

    def out(ids: list, categories: list, x: np.ndarray) -> pa.RecordBatch:
        x = x / np.linalg.norm(x, axis=1, keepdims=True)
        return pa.RecordBatch.from_arrays([pa.array([ids], pa.list_(pa.int64())), pa.array([categories], pa.list_(pa.int64())), pa.array([x.tobytes()], pa.binary()), pa.array([x.shape[1]], pa.int32())], ["ids", "categories", "data", "d"])

    for batch in batches:
        for d, at, x in _finite(batch.column(0), batch.column(1)):
            ids, categories = (batch.column(k).take(pa.array(at)).to_pylist() for k in (0, 2))
            if d in waiting:
                before = waiting[d]
                ids, categories, x = before[0] + ids, before[1] + categories, np.concatenate([before[2], x])
            while len(ids) >= BLOCK:
                yield out(ids[:BLOCK], categories[:BLOCK], x[:BLOCK])
                ids, categories, x = ids[BLOCK:], categories[BLOCK:], x[BLOCK:]
            waiting[d] = ids, categories, x
    for ids, categories, x in waiting.values():
        if ids:
            yield out(ids, categories, x)


def _finite(ids: pa.Array, vectors: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """By length of vector: the places of rows with an id and a finite vector that is not zero, and these vectors."""
    lengths = np.where(ids.is_valid().to_numpy(False), pc.fill_null(pc.list_value_length(vectors), 0).to_numpy(False), 0)
    for d in np.unique(lengths[lengths > 0]):
        at = np.flatnonzero(lengths == d)
        # A null component becomes NaN.
        x = vectors.take(pa.array(at)).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, d)
        good = np.isfinite(x).all(1) & x.any(1)
        if good.any():
            yield int(d), at[good], x[good]


def _scored(k: int | None, same_category: bool, exclude_self: bool, earlier: bool, least: float | None):
    """Per query the k best items of a block, or all with a score of ``least`` or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(len(batch)):
                q_ids, q_cat, q, i_ids, i_cat, x, d = (batch.column(n)[r].as_py() for n in ("q_ids", "q_categories", "q_data", "ids", "categories", "data", "d"))
                q, x = np.frombuffer(q).reshape(-1, d), np.frombuffer(x).reshape(-1, d)
                q_ids, i_ids = np.array(q_ids), np.array(i_ids)
                scores = q @ x.T
                if same_category:
                    a, b = (np.array([np.nan if c is None else c for c in z], float) for z in (q_cat, i_cat))
                    scores[a[:, None] != b[None, :]] = -np.inf
                if exclude_self:
                    scores[q_ids[:, None] == i_ids[None, :]] = -np.inf
                if earlier:
                    scores[q_ids[:, None] <= i_ids[None, :]] = -np.inf
                n = scores.shape[1]
                cut = np.full(len(q), -np.inf) if k is None or k >= n else np.partition(scores, n - k, axis=1)[:, n - k]
                cut = cut if least is None else np.maximum(cut, least)
                for s in range(0, len(q), 256):
                    a, b = np.nonzero((scores[s : s + 256] >= cut[s : s + 256, None] - 1e-9) & np.isfinite(scores[s : s + 256]))
                    a += s
                    # A product of matrices may round equal pairs differently; a sum by row does not.
                    exact = (q[a] * x[b]).sum(1)
                    order = np.lexsort((i_ids[b], -exact, a))
                    a, b, exact = a[order], b[order], exact[order]
                    keep = np.ones(len(a), bool) if k is None else np.arange(len(a)) - np.searchsorted(a, a, "left") < k
                    keep &= True if least is None else exact >= least
                    yield pa.RecordBatch.from_arrays([pa.array(q_ids[a[keep]]), pa.array(i_ids[b[keep]]), pa.array(exact[keep])], ["query_id", "item_id", "score"])

    return run


def top_k(queries: DataFrame, items: DataFrame, k: int, id_col: str = "vec_id", vector_col: str = "embedding", category_col: str | None = None, same_category: bool = False, threshold: float | None = None, exclude_self: bool = True, earlier: bool = False) -> DataFrame:
    """(query_id, item_id, score, rank) of each query's k nearest items by cosine; ties go to the smaller id.

    Queries meet items as blocks of packed vectors: a pair of blocks is one matrix product that returns at most k rows
    a query, and a rank over those gives the answer. The category filter applies before the top k, ``threshold`` after.
    ``earlier``: only items with a smaller id than the query's. Scores are not rounded.
    """
    found = _blocks(queries, items, _scored(k, same_category, exclude_self, earlier, None), id_col, vector_col, category_col)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "item_id"))
    out = found.withColumn("rank", rank).filter(F.col("rank") <= k)
    return out if threshold is None else out.filter(F.col("score") >= threshold)


def pairs_within(queries: DataFrame, items: DataFrame, least: float, id_col: str = "vec_id", vector_col: str = "embedding", earlier: bool = False) -> DataFrame:
    """(query_id, item_id, score) of all pairs with a score of ``least`` or more, in the same blocks."""
    return _blocks(queries, items, _scored(None, False, True, earlier, least), id_col, vector_col, None)


def _blocks(queries: DataFrame, items: DataFrame, scored, id_col: str, vector_col: str, category_col: str | None) -> DataFrame:
    pick = lambda df: df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v"), (F.col(category_col) if category_col else F.lit(None)).cast("long").alias("category"))
    schema = "ids array<long>, categories array<long>, data binary, d int"
    n_items = items.select(id_col).count()
    n_queries = n_items if queries is items else queries.select(id_col).count()
    by_q, by_x = _grid(n_queries, n_items, int(items.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    slot = lambda n: F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(n).cast("long"))
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    # Fewer rows than a block in a partition would make more pairs of blocks than the rows need.
    packed = lambda df, n: pick(df).coalesce(max(1, -(-n // BLOCK))).mapInArrow(_packed, schema)
    q = packed(queries, n_queries).select(F.col("ids").alias("q_ids"), F.col("categories").alias("q_categories"), F.col("data").alias("q_data"), F.col("d").alias("q_d"))
    q = q.withColumn("q_slot", slot(by_q)).withColumn("slot", each(by_x))
    x = packed(items, n_items).withColumn("slot", slot(by_x)).withColumn("q_slot", each(by_q))
    # Both sides are files to the planner, of a few MB: without the hint it sends all copies of one through the driver.
    pairs = x.hint("merge").join(q, ["slot", "q_slot"]).filter("d = q_d")
    return pairs.mapInArrow(scored, "query_id long, item_id long, score double")


def _grid(queries: int, items: int, tasks: int) -> tuple[int, int]:
    """Slots that the blocks of queries and of items are dealt to. A pair of slots is a task, and each side is sent once a slot of the other.

    Of the grids with at least half as many tasks as there may be (``tasks``, and the pairs of full blocks), the one that sends
    least: what is sent grows with the rows, and not with ``tasks`` times the queries.
    """
    blocks_q, blocks_x = (max(1, -(-n // BLOCK)) for n in (queries, items))
    grids = [(a, min(blocks_x, max(1, tasks // a))) for a in range(1, min(blocks_q, tasks) + 1)]
    most = max(a * b for a, b in grids)
    return min((g for g in grids if 2 * g[0] * g[1] >= most), key=lambda g: (queries * g[1] + items * g[0], g))


def dedup_hits(hits: DataFrame, key: str, per: str = "query_id") -> DataFrame:
    """Of a query's hits with one content key, the best ranked; applied after the top k, so fewer may be left."""
    return hits.withColumn("__n", F.row_number().over(Window.partitionBy(per, key).orderBy("rank"))).filter("__n = 1").drop("__n")


def lookup(items: DataFrame, ids: DataFrame, id_col: str) -> DataFrame:
    """Rows by id, with the fixed score 1."""
    return items.join(ids.select(id_col).distinct(), id_col, "left_semi").withColumn("score", F.lit(1.0))


def near_duplicates(queries: DataFrame, items: DataFrame, n: int = 3, least: float = 0.85, **columns) -> DataFrame:
    """Of each query's n nearest items those within ``least``: what to look at before a pair is added."""
    return top_k(queries, items, n, threshold=least, **columns)


def near_duplicate_gate(new: DataFrame, existing: DataFrame | None = None, threshold: float = 0.9, id_col: str = "vec_id", vector_col: str = "embedding", first: int = 1024) -> DataFrame:
    """(query_id, best_id, best_score, inserted) of rows that arrive by id and go in if nothing there reaches the threshold.

    A row meets the collection and the earlier rows that went in. Rows come in batches of doubling size: those near a row
    that went in before are turned away at once, so a dense cluster is never written as pairs; only what is left of a batch
    is compared with itself and settled by :func:`settled`.
    """
    spark, of = new.sparkSession, {"id_col": id_col, "vector_col": vector_col}
    ids = new.select(F.col(id_col).cast("long").alias("query_id")).filter("query_id is not null").distinct()
    n = ids.count()
    shares = [first * 2**k / n for k in range(1, 64) if first * 2**k < n] if n > first else []
    cuts = [ids.orderBy("query_id").limit(first).agg(F.max("query_id")).first()[0]] if n > first else []
    cuts = sorted({*cuts, *(ids.agg(F.percentile_approx("query_id", shares, 100_000)).first()[0] if shares else [])})
    inside, path, low = ids.limit(0).select("query_id"), None, None
    for high in [*cuts, None]:
        here = new.filter((F.col(id_col) > low) if low is not None else F.lit(True)).filter((F.col(id_col) <= high) if high is not None else F.lit(True)).filter(F.col(id_col).isNotNull())
        before = new.join(inside, F.col(id_col) == F.col("query_id"), "left_semi") if path else None
        for there in (t for t in (existing, before) if t is not None):
            near = top_k(here, there, 1, exclude_self=False, threshold=threshold, **of).select(F.col("query_id").alias("__near"))
            here = here.join(near, F.col(id_col) == F.col("__near"), "left_anti")
        left, left_path = write_shared(here.select(*[F.col(c) for c in (id_col, vector_col)]), "left")
        pairs, pairs_path = write_shared(pairs_within(left, left, threshold, earlier=True, **of).select("query_id", "item_id"), "edges")
        went, used = settled(left.select(F.col(id_col).cast("long").alias("query_id")), pairs)
        now, now_path = write_shared(inside.union(went), "inside")
        drop_shared(spark, left_path, pairs_path, *used, *([path] if path else []))
        inside, path, low = now, now_path, high
    there = new.join(inside, F.col(id_col) == F.col("query_id"), "left_semi")
    best = top_k(new, there, 1, earlier=True, **of)
    if existing is not None:
        best = best.unionByName(top_k(new, existing, 1, exclude_self=False, **of)).groupBy("query_id").agg(F.max_by(F.struct("score", "item_id"), F.struct(F.col("score"), -F.col("item_id"))).alias("b")).select("query_id", "b.*")
    state = new.select(F.col(id_col).cast("long").alias("query_id")).join(inside.withColumn("inserted", F.lit(True)), "query_id", "left")
    return state.join(best.select("query_id", F.col("item_id").alias("best_id"), F.col("score").alias("best_score")), "query_id", "left").select("query_id", "best_id", "best_score", F.coalesce("inserted", F.lit(False)).alias("inserted"))


def settled(rows: DataFrame, pairs: DataFrame, counts: dict | None = None) -> tuple[DataFrame, list[str]]:
    """(query_id) of ``rows`` that stay when each goes by id and stays if no earlier one of its ``pairs`` (query_id, item_id) did.

    In a round, rows next to a row that stayed go, and rows without an open neighbour stay. A row that waits for one
    earlier row alone takes the opposite of it; such waits are doubled each round, from the row to what that one waits
    for, so that a chain of n rows is settled in about log2(n) rounds. Also the paths of the tables the result rests on.
    """
    spark = rows.sparkSession
    met = pairs.select("query_id").union(pairs.select("item_id")).distinct()
    state, state_path = write_shared(met.select("query_id", F.lit(None).cast("boolean").alias("stays")), "gate")
    # same: the row does what the other does, instead of the opposite.
    waits, waits_path = write_shared(pairs.distinct().select("query_id", "item_id", F.lit(False).alias("same")), "waits")
    rounds = 0
    while not waits.isEmpty():
        rounds += 1
        known = waits.join(state.select(F.col("query_id").alias("item_id"), F.col("stays").alias("there")), "item_id")
        per = known.groupBy("query_id").agg(F.bool_or(F.col("there") & ~F.col("same")).alias("met"), F.bool_or(F.col("there") & F.col("same")).alias("joined"), F.bool_or(F.col("same")).alias("same"), F.count_if(F.col("there").isNull()).alias("open"))
        # A doubled wait is a row's only one: it does what the other does. Plain waits all count against it.
        follows = F.when(F.col("open") > 0, F.lit(None).cast("boolean")).otherwise(F.coalesce("joined", F.lit(False)))
        alone = F.when(F.coalesce("met", F.lit(False)), False).when(F.col("open") > 0, F.lit(None).cast("boolean")).otherwise(True)
        value = F.when(F.col("per.query_id").isNull(), True).when(F.col("per.same"), follows).otherwise(alone)
        new_state, new_path = write_shared(state.alias("s").join(per.alias("per"), F.col("s.query_id") == F.col("per.query_id"), "left").select("s.query_id", F.coalesce("s.stays", value).alias("stays")), "gate")
        open_ = new_state.filter("stays is null").select("query_id")
        live = waits.join(open_, "query_id", "left_semi").join(new_state.select(F.col("query_id").alias("item_id"), F.col("stays").alias("there")), "item_id").filter("there is null or there or same").drop("there")
        live, live_path = write_shared(live, "waits")
        single = live.groupBy("query_id").agg(F.count("*").alias("n"), F.first("item_id").alias("item_id"), F.first("same").alias("same")).filter("n = 1").drop("n")
        beyond = single.select(F.col("query_id").alias("k"), F.col("item_id").alias("to"), F.col("same").alias("same2"))
        doubled = live.join(single.select("query_id").withColumn("__one", F.lit(True)), "query_id", "left").join(beyond, (F.col("item_id") == F.col("k")) & F.col("__one"), "left")
        doubled = doubled.select("query_id", F.coalesce("to", "item_id").alias("item_id"), F.when(F.col("to").isNotNull(), F.col("same") == F.col("same2")).otherwise(F.col("same")).alias("same"))
        doubled, doubled_path = write_shared(doubled, "waits")
        drop_shared(spark, state_path, waits_path, live_path)
        state, state_path, waits, waits_path = new_state, new_path, doubled, doubled_path
    if counts is not None:
        counts["rounds"] = rounds
    drop_shared(spark, waits_path)
    # Open rows that wait for nothing any more stay.
    return rows.distinct().join(state.filter("not stays").select("query_id"), "query_id", "left_anti"), [state_path]


def approximate_pairs(queries: DataFrame, items: DataFrame, least: float, id_col: str = "vec_id", vector_col: str = "embedding", bucket: float = 0.5, tables: int = 8, seed: int = 1) -> DataFrame:
    """(query_id, item_id, score) of pairs with cosine >= ``least`` by random projections: an opt-in that may miss pairs; :func:`top_k` is exact."""
    from pyspark.ml.feature import BucketedRandomProjectionLSH, Normalizer
    from pyspark.ml.functions import array_to_vector

    unit = Normalizer(inputCol="__v", outputCol="__u")
    pick = lambda df: unit.transform(df.select(F.col(id_col).alias("id"), array_to_vector(F.col(vector_col)).alias("__v")))
    model = BucketedRandomProjectionLSH(inputCol="__u", outputCol="__h", bucketLength=bucket, numHashTables=tables, seed=seed).fit(pick(items))
    far = (2 - 2 * least) ** 0.5 + 1e-9
    pairs = model.approxSimilarityJoin(pick(queries), pick(items), far, "__d")
    score = F.round(1 - F.col("__d") * F.col("__d") / 2, 6)
    return pairs.select(F.col("datasetA.id").alias("query_id"), F.col("datasetB.id").alias("item_id"), score.alias("score")).filter(F.col("score") >= least)
