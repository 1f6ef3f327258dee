"""An index of unit vectors on shared files: cells around pivots, blocks with bounds, residual codes; searched exactly or by cell.

Fit: pivots are k-means centres of at most ``fit_rows`` rows (those of least id hash), whatever the collection's size.
Every row is then in the cell of its nearest pivot. A block holds up to ``BLOCK`` rows of a cell, with its own centre and
radius (the largest angle to it), and each row's code: one signed byte a dimension of what it differs from the pivot, with
the norm of what the code leaves over.

Search: a query first meets the cells nearest to it; its k-th best score there is a floor. An exact search then asks for
each block whether the triangle inequality of angles leaves room above the floor (angle to the centre less the radius);
pairs of a query and a block without room are never joined to the block's rows. In a pair that is, the codes give an
upper bound of each score, and only rows that reach the floor are scored with their vectors. An approximate search stops
at the nearest cells: so many that the fitted rows find ``recall`` of their neighbours.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvid.sources.shared import drop_shared, write_shared

BLOCK, QUERIES = 2048, 256
#: Blocks in a piece of a cell, and blocks whose bounds share a slot.
PIECE, BOUNDS = 4, 64
#: What sums in double precision may be off by.
SLACK = 1e-9


def _units(vectors: list, d: int) -> np.ndarray:
    x = np.array(vectors, float).reshape(-1, d)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _good(v) -> bool:
    return bool(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)


def pivots_of(x: np.ndarray, n: int, rounds: int = 8) -> np.ndarray:
    """Unit centres of ``x`` by k-means on directions, from distinct rows spread over their order."""
    distinct = np.unique(x, axis=0)
    c = distinct[np.linspace(0, len(distinct) - 1, min(n, len(distinct))).astype(int)]
    for _ in range(rounds):
        near = (x @ c.T).argmax(1)
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        c = np.where(size > 1e-12, sums / np.where(size > 1e-12, size, 1), c)
    return c


def probes_for(x: np.ndarray, pivots: np.ndarray, recall: float, k: int = 10, asked: int = 256) -> int:
    """How many nearest cells hold ``recall`` of the k nearest rows of some rows of ``x``, among all of them."""
    q = x[np.linspace(0, len(x) - 1, min(asked, len(x))).astype(int)]
    score = q @ x.T
    k = min(k + 1, len(x))
    near = np.argpartition(-score, k - 1, axis=1)[:, :k]
    cell = (x @ pivots.T).argmax(1)
    order = np.argsort(np.argsort(-(q @ pivots.T), axis=1, kind="stable"), axis=1, kind="stable")
    place = np.sort(np.take_along_axis(order, cell[near], 1).ravel())
    return int(place[min(len(place) - 1, math.ceil(recall * len(place)) - 1)]) + 1 if len(place) else 1


@dataclass
class Index:
    """Blocks (number, cell, n, centre, radius, ids, codes, scales, rests, vectors) of one vector length, and the pivots."""

    spark: SparkSession
    path: str
    d: int
    pivots: np.ndarray
    sample: np.ndarray

    def blocks(self) -> DataFrame:
        return self.spark.read.schema(SCHEMA).parquet(self.path)

    def drop(self) -> None:
        drop_shared(self.spark, self.path)


SCHEMA = "number long, cell int, n int, centre binary, radius double, ids binary, codes binary, scales binary, rests binary, vectors binary"


def _assigned(pivots: np.ndarray, d: int, pieces: np.ndarray):
    """Rows with their cell and one of its ``pieces``, by a hash of the id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(i, v) for i, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) if i is not None and _good(v) and len(v) == d]
            if rows:
                x = _units([v for _, v in rows], d)
                cell, ids = (x @ pivots.T).argmax(1).astype(np.int32), np.array([i for i, _ in rows], np.int64)
                piece = (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)) % pieces[cell].astype(np.uint64)
                yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(piece.astype(np.int32)), pa.array(ids), pa.array([r.tobytes() for r in x], pa.binary())], ["cell", "piece", "id", "u"])

    return run


def _blocked(pivots: np.ndarray, d: int, rows_a_block: int):
    """Rows (cell, id, u), together by cell in a task, as blocks."""

    def block(cell: int, ids: list, data: list) -> tuple:
        x = np.frombuffer(b"".join(data)).reshape(-1, d)
        centre = x.sum(0)
        size = np.linalg.norm(centre)
        centre = centre / size if size > 1e-12 else x[0]
        radius = float(np.arccos(np.clip(x @ centre, -1, 1)).max()) + 1e-7
        rest = x - pivots[cell]
        scale = np.maximum(np.abs(rest).max(1, initial=0) / 127, 1e-30)
        codes = np.rint(rest / scale[:, None]).astype(np.int8)
        left = np.linalg.norm(rest - codes * scale[:, None], axis=1) * (1 + 1e-9)
        return cell, len(ids), centre.tobytes(), radius, np.array(ids, "<i8").tobytes(), codes.tobytes(), scale.tobytes(), left.tobytes(), x.tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ids, data = None, [], []
        for batch in batches:
            for cell, i, u in zip(*(c.to_pylist() for c in batch.columns)):
                if ids and (cell != now or len(ids) == rows_a_block):
                    yield out(block(now, ids, data))
                    ids, data = [], []
                now = cell
                ids.append(i)
                data.append(u)
        if ids:
            yield out(block(now, ids, data))

    def out(row: tuple) -> pa.RecordBatch:
        kinds = [pa.int32(), pa.int32(), pa.binary(), pa.float64(), *[pa.binary()] * 5]
        return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds)], ["cell", "n", "centre", "radius", "ids", "codes", "scales", "rests", "vectors"])

    return run


def build(items: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", cells: int | None = None, fit_rows: int = 8192, rows_a_block: int = BLOCK) -> Index | None:
    """The index of ``items``; null without a usable vector.

    Vectors that are null, zero, not finite or of another length than the first of the fitted rows are not in it. ``cells``
    is four times the root of the rows by default, and at most an eighth of the fitted ones.
    """
    spark = items.sparkSession
    x = items.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v"))
    known = F.col("id").isNotNull() & F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & F.exists("v", lambda c: c != 0)
    found = [r["v"] for r in x.filter(known).orderBy(F.xxhash64("id"), "id").limit(fit_rows).select("v").collect()]
    if not found:
        return None
    d = len(found[0])
    sample = _units([v for v in found if len(v) == d], d)
    n = cells or min(int(4 * math.sqrt(x.count())) + 1, max(1, len(sample) // 8))
    pivots = pivots_of(sample, n)
    # A cell may hold a third of all rows, and a block needs no whole cell: it is dealt in pieces of a few blocks by the
    # id's hash. Smaller cells stay whole, as what a search sends grows with the number of blocks.
    assigned = lambda pieces: x.mapInArrow(_assigned(pivots, d, pieces), "cell int, piece int, id long, u binary")
    pieces = np.ones(len(pivots), np.int64)
    for r in assigned(pieces).groupBy("cell").count().collect():
        pieces[r["cell"]] += r["count"] // (PIECE * rows_a_block)
    dealt = assigned(pieces).repartition("cell", "piece").sortWithinPartitions("cell").select("cell", "id", "u")
    blocks = dealt.mapInArrow(_blocked(pivots, d, rows_a_block), SCHEMA.removeprefix("number long, ")).select(F.monotonically_increasing_id().alias("number"), "*")
    _, path = write_shared(blocks, "index")
    return Index(spark, path, d, pivots, sample)


def _query_blocks(d: int, pivots: np.ndarray, most: int):
    """Queries (id, v) of one group as rows of up to QUERIES: their unit vectors and, of each, the nearest cells."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[tuple] = []
        for batch in batches:
            for i, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if i is not None and _good(v) and len(v) == d:
                    waiting.append((i, v))
                    if len(waiting) == QUERIES:
                        yield out(waiting)
                        waiting = []
        if waiting:
            yield out(waiting)

    def out(rows: list[tuple]) -> pa.RecordBatch:
        q = _units([v for _, v in rows], d)
        cells = np.argsort(-(q @ pivots.T), axis=1, kind="stable")[:, :most].astype("<i4")
        return pa.RecordBatch.from_arrays([pa.array([np.array([i for i, _ in rows], "<i8").tobytes()], pa.binary()), pa.array([q.tobytes()], pa.binary()), pa.array([cells.tobytes()], pa.binary())], ["q_ids", "q", "cells"])

    return run


def _cells_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(g, cell, places): which queries of a block ask for a cell."""
    for batch in batches:
        for g, ids, cells in zip(*(batch.column(k).to_pylist() for k in range(3))):
            table = np.frombuffer(cells, "<i4").reshape(len(ids) // 8, -1)
            place = np.repeat(np.arange(len(table)), table.shape[1])
            order = np.argsort(table.ravel(), kind="stable")
            found, starts = np.unique(table.ravel()[order], return_index=True)
            parts = np.split(place[order], starts[1:])
            yield pa.RecordBatch.from_arrays([pa.array([g] * len(found), pa.int64()), pa.array(found, pa.int32()), pa.array([p.astype("<i4").tobytes() for p in parts], pa.binary())], ["g", "cell", "places"])


def _roomy(d: int):
    """(g, number, places) of the pairs of a query block and a block's bounds: the queries whose floor the block may reach."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                q, floor = np.frombuffer(r["q"]).reshape(-1, d), np.frombuffer(r["floors"])
                angle = np.arccos(np.clip(q @ np.frombuffer(r["centre"]), -1, 1)) - r["radius"]
                places = np.flatnonzero(np.cos(np.maximum(angle, 0)) + SLACK >= floor)
                if len(places):
                    rows.append((r["g"], r["number"], places.astype("<i4").tobytes()))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), (pa.int64(), pa.int64(), pa.binary()))], ["g", "number", "places"])

    return run


def _in_slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(g, pairs) with the pairs (slot, number, places) of a slot as one: its number, the places of all, and ``wanted``, by block its places and where they stand among these."""
    part = pa.struct([("number", pa.int64()), ("places", pa.binary()), ("at", pa.binary())])
    kind = pa.list_(pa.struct([("number", pa.int64()), ("places", pa.binary()), ("wanted", pa.list_(part))]))
    for batch in batches:
        for g, pairs in zip(*(c.to_pylist() for c in batch.columns)):
            slots: dict[int, list] = {}
            for p in pairs:
                slots.setdefault(p["slot"], []).append((p["number"], np.frombuffer(p["places"], "<i4")))
            out = []
            for slot, asked in slots.items():
                here = np.unique(np.concatenate([places for _, places in asked]))
                wanted = [{"number": k, "places": places.tobytes(), "at": np.searchsorted(here, places).astype("<i4").tobytes()} for k, places in asked]
                out.append({"number": slot, "places": here.tobytes(), "wanted": wanted})
            yield pa.RecordBatch.from_arrays([pa.array([g], pa.int64()), pa.array([out], kind)], ["g", "pairs"])


def _asking(d: int):
    """(g, number, places, q_ids, q, floors, wanted) of query blocks with a list of pairs (number, places, wanted): of each pair, the queries that ask for its block or slot, and no others."""
    names = ["g", "number", "places", "q_ids", "q", "floors", "wanted"]
    kinds = [pa.int64(), pa.int64(), *[pa.binary()] * 4, pa.list_(pa.struct([("number", pa.int64()), ("places", pa.binary()), ("at", pa.binary())]))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n in range(len(batch)):
                g, q_ids, q, floors, pairs = (c[n].as_py() for c in batch.columns)
                q, q_ids = np.frombuffer(q).reshape(-1, d), np.frombuffer(q_ids, "<i8")
                floors = None if floors is None else np.frombuffer(floors)
                for s in range(0, len(pairs), 64):
                    rows = []
                    for p in pairs[s : s + 64]:
                        at = np.frombuffer(p["places"], "<i4")
                        rows.append((g, p["number"], p["places"], q_ids[at].tobytes(), q[at].tobytes(), None if floors is None else floors[at].tobytes(), p.get("wanted")))
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    return run


def _met(pivots: np.ndarray, d: int, k: int, exclude_self: bool):
    """Of the pairs of queries and a block, each query's k best rows that reach its floor, and how many rows were scored with their vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                places, at = np.frombuffer(r["places"], "<i4"), np.frombuffer(r["at"], "<i4")
                q, q_ids = np.frombuffer(r["q"]).reshape(-1, d)[at], np.frombuffer(r["q_ids"], "<i8")[at]
                floor = np.frombuffer(r["floors"])[at] if r["floors"] else np.full(len(places), -np.inf)
                ids, x = np.frombuffer(r["ids"], "<i8"), np.frombuffer(r["vectors"]).reshape(-1, d)
                codes = np.frombuffer(r["codes"], np.int8).reshape(-1, d).astype(float)
                est = (q @ pivots[r["cell"]])[:, None] + (q @ codes.T) * np.frombuffer(r["scales"])[None, :]
                left = np.frombuffer(r["rests"])[None, :] + SLACK
                other = q_ids[:, None] != ids[None, :] if exclude_self else np.ones(est.shape, bool)
                if len(ids) > k + 1:
                    sure = np.where(other, est - left, -np.inf)
                    floor = np.maximum(floor, -np.partition(-sure, k - 1, axis=1)[:, k - 1])
                a, b = np.nonzero(other & (est + left >= floor[:, None]))
                score = (q[a] * x[b]).sum(1)
                order = np.lexsort((ids[b], -score, a))
                a, b, score = a[order], b[order], score[order]
                keep = np.arange(len(a)) - np.searchsorted(a, a, "left") < k
                yield pa.RecordBatch.from_arrays([pa.array(np.full(int(keep.sum()), r["g"]), pa.int64()), pa.array(places[a[keep]], pa.int32()), pa.array(q_ids[a[keep]]), pa.array(ids[b[keep]]), pa.array(score[keep]), pa.array(np.where(np.arange(int(keep.sum())) == 0, len(a), 0), pa.int64())], ["g", "place", "query_id", "item_id", "score", "scored"])

    return run


_WANTED = "array<struct<number:long,places:binary,at:binary>>"
_HITS = "g long, place int, query_id long, item_id long, score double, scored long"


def search(index: Index, queries: DataFrame, k: int, id_col: str = "vec_id", vector_col: str = "embedding", recall: float | None = None, exclude_self: bool = True, seeds: int = 2, counts: dict | None = None) -> DataFrame:
    """(query_id, item_id, score, rank) of each query's k nearest items by cosine; ties go to the smaller id.

    Exact without ``recall``; with it, the search stops at as many nearest cells as the fitted rows need to find that share
    of their neighbours. Queries without a usable vector have no rows; ids of queries may repeat, and each is answered.
    ``counts`` gets how many pairs there are, were joined to a block's rows, and were scored with their vectors.
    """
    spark, d, used = index.spark, index.d, []
    probes = seeds if recall is None else probes_for(index.sample, index.pivots, recall, k)
    asked = queries.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v"))
    asked, path = write_shared(asked.mapInArrow(_query_blocks(d, index.pivots, min(probes, len(index.pivots))), "q_ids binary, q binary, cells binary").select(F.monotonically_increasing_id().alias("g"), "*"), "queries")
    used.append(path)
    blocks = index.blocks()
    bounds = blocks.select("number", "cell", "n", "centre", "radius")
    tasks, n_blocks = int(spark.conf.get("spark.sql.shuffle.partitions")), blocks.count()
    # A query is sent once to each slot that holds a block it asks for, however many these are: what is sent grows with the queries alone.
    shared = F.pmod(F.xxhash64("number"), F.lit(max(1, min(n_blocks, tasks // 4))).cast("long"))

    def answered(pairs: DataFrame, floors: DataFrame | None, name: str) -> DataFrame:
        payload = asked.select("g", "q_ids", "q")
        payload = payload.withColumn("floors", F.lit(None).cast("binary")) if floors is None else payload.join(floors, "g")
        listed = pairs.groupBy("g").agg(F.collect_list(F.struct(shared.alias("slot"), "number", "places")).alias("pairs"))
        listed = listed.mapInArrow(_in_slots, f"g long, pairs array<struct<number:long,places:binary,wanted:{_WANTED}>>")
        sent = payload.join(listed, "g").select("g", "q_ids", "q", "floors", "pairs").mapInArrow(_asking(d), f"g long, number long, places binary, q_ids binary, q binary, floors binary, wanted {_WANTED}")
        sent = sent.drop("places").withColumnRenamed("number", "slot")
        # Queries are files of a few MB to the planner: without the hint it sends what all slots get through the driver.
        x = blocks.drop("n", "centre", "radius").withColumn("slot", shared).hint("merge").join(sent, "slot").withColumn("__w", F.get(F.filter("wanted", lambda w: w["number"] == F.col("number")), F.lit(0))).filter("__w is not null")
        x = x.select("g", "cell", "ids", "codes", "scales", "rests", "vectors", "q_ids", "q", "floors", "__w.places", "__w.at")
        hits, path = write_shared(x.mapInArrow(_met(index.pivots, d, k, exclude_self), _HITS), name)
        used.append(path)
        return hits

    near = asked.select("g", "q_ids", "cells").mapInArrow(_cells_of, "g long, cell int, places binary")
    pairs, path = write_shared(near.join(bounds.select("cell", "number"), "cell").select("g", "number", "places"), "pairs")
    used.append(path)
    hits = answered(pairs, None, "hits")
    if recall is None:
        floors, path = write_shared(_floors(hits, asked, k), "floors")
        used.append(path)
        # A slot holds the bounds of some blocks, and each query block visits every slot.
        slots = min(tasks, n_blocks // BOUNDS + 1)
        met = bounds.select("number", "centre", "radius", F.pmod(F.xxhash64("number"), F.lit(slots)).alias("slot"))
        dealt = asked.select("g", "q").join(floors, "g").withColumn("slot", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(slots - 1).cast("long"))))
        pairs, path = write_shared(met.join(dealt, "slot").select("g", "number", "q", "floors", "centre", "radius").mapInArrow(_roomy(d), "g long, number long, places binary"), "pairs")
        used.append(path)
        hits = answered(pairs, floors, "hits")
    if counts is not None:
        sizes = blocks.select("number", "n")
        total = asked.agg(F.sum(F.length("q_ids") / 8)).first()[0] or 0
        counts["pairs"] = int(total * (sizes.agg(F.sum("n")).first()[0] or 0))
        counts["joined"] = int(pairs.join(sizes, "number").agg(F.sum(F.length("places") / 4 * F.col("n"))).first()[0] or 0)
        counts["scored"] = int(hits.agg(F.sum("scored")).first()[0] or 0)
    best = F.row_number().over(Window.partitionBy("g", "place").orderBy(F.desc("score"), "item_id"))
    out, _ = write_shared(hits.withColumn("rank", best).filter(F.col("rank") <= k).select("query_id", "item_id", "score", "rank"), "found")
    drop_shared(spark, *used)
    return out


def _floors(hits: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """(g, floors): of each query of a block its k-th best score so far, or less than any score."""
    best = F.row_number().over(Window.partitionBy("g", "place").orderBy(F.desc("score"), "item_id"))
    kth = hits.withColumn("rank", best).filter(F.col("rank") == k).groupBy("g").agg(F.map_from_entries(F.collect_list(F.struct("place", "score"))).alias("m"))
    x = asked.select("g", (F.length("q_ids") / 8).cast("int").alias("n")).join(kth, "g", "left")
    listed = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda p: F.coalesce(F.try_element_at("m", p), F.lit(-2.0)))
    return x.select("g", listed.alias("l")).mapInArrow(_as_bytes, "g long, floors binary")


def _as_bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([np.array(v, float).tobytes() for v in batch.column(1).to_pylist()], pa.binary())], ["g", "floors"])
