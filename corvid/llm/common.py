"""Helpers that several corpus operators share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors see, from ``spark.checkpoint.dir``; where it is unset, a temporary one if all executors are threads of this process."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = _own.setdefault(spark.sparkContext.applicationId, tempfile.mkdtemp(prefix="corvid-"))
    return found.rstrip("/")


def write_shared(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Write ``df`` as Parquet to the shared folder and read it back: lineage ends there, and lost executors lose nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/corvid/{name}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def drop_shared(spark: SparkSession, *paths: str) -> None:
    """Delete tables of :func:`write_shared` that no later plan reads."""
    for p in paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def lookup(left: DataFrame, index: DataFrame, keys: list[str], weight: str, values: list[str], share: int = 1000) -> DataFrame:
    """``left`` left-joined with ``index``, which has one row per ``keys`` and counts in ``weight`` the rows of ``left`` with that key.

    Keys that hold at least 1/``share`` of all rows (so ``share`` of them at most) are broadcast and
    never shuffled; rows they match get a random key on the shuffled side, so that no task gets them together.
    The result has the columns of ``left`` and ``values``; null keys match nothing.
    """
    n = index.agg(F.sum(weight)).first()[0] or 0
    hot = index.filter(F.col(weight) * share >= n).select(*[F.col(k).alias(f"__h{i}") for i, k in enumerate(keys)], *[F.col(v).alias(f"__hv{i}") for i, v in enumerate(values)], F.lit(True).alias("__hot"))
    rest = index.filter(F.col(weight) * share < n).select(*[F.col(k).alias(f"__r{i}") for i, k in enumerate(keys)], F.xxhash64(*keys).alias("__r"), *[F.col(v).alias(f"__rv{i}") for i, v in enumerate(values)])
    on_hot = [F.col(k) == F.col(f"__h{i}") for i, k in enumerate(keys)]
    d = left.join(F.broadcast(hot), on_hot, "left")
    done = F.col("__hot").isNotNull() | F.col(keys[0]).isNull()
    d = d.withColumn("__salt", F.when(done, (F.rand(7) * (1 << 62)).cast("long")).otherwise(F.xxhash64(*keys)))
    d = d.join(rest, [F.col("__salt") == F.col("__r"), *[F.col(k) == F.col(f"__r{i}") for i, k in enumerate(keys)]], "left")
    return d.select(*[F.col(c) for c in left.columns], *[F.coalesce(f"__hv{i}", f"__rv{i}").alias(v) for i, v in enumerate(values)])


def may_be_among(rows: DataFrame, column: str, ids: DataFrame, id_col: str, name: str, bits: int | None = None) -> DataFrame:
    """``rows`` with a boolean ``name``: true where ``column`` is among ``ids``, and by chance elsewhere; nulls count as absent.

    A bitmap of the ids' hashes is broadcast: 16 to 32 bits an id, but no more than 2 ** 27 (16 MB), where it lets more pass.
    """
    bits = bits or min(1 << 27, max(1 << 16, 1 << (16 * ids.count()).bit_length()))
    at = lambda c: F.pmod(F.xxhash64(c), F.lit(bits))
    marks = ids.select(at(id_col).alias("h")).groupBy(F.bitmap_bucket_number("h").alias("__bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("h")).alias("__bitmap"))
    x = rows.withColumn("__at", at(column)).withColumn("__pos", F.bitmap_bit_position("__at"))
    x = x.join(F.broadcast(marks), F.bitmap_bucket_number("__at") == F.col("__bucket"), "left")
    bit = F.expr("shiftright(cast(conv(hex(substring(__bitmap, cast(__pos div 8 as int) + 1, 1)), 16, 10) as int), cast(__pos % 8 as int)) & 1 = 1")
    return x.select(*rows.columns, (F.col(column).isNotNull() & F.coalesce(bit, F.lit(False))).alias(name))


def sifted(rows: DataFrame, column: str, ids: DataFrame, id_col: str, bits: int | None = None) -> DataFrame:
    """``rows`` without most of those whose ``column`` is not among ``ids``, ahead of a join on it; no row that the join needs goes."""
    return may_be_among(rows, column, ids, id_col, "__may", bits).filter("__may").drop("__may")


def spread_join(left: DataFrame, right: DataFrame, key: str, on: str, counts: DataFrame, rows: int, spread: str, share: int = 1000, least: int = 1000) -> DataFrame:
    """``left`` joined with ``right``, which has one row per ``on``, on ``key`` = ``on``.

    ``counts`` has (key, n), the rows of ``left`` by key, and ``rows`` is their sum. A key with more than a ``share``-th
    of all rows (and ``least``; so ``share`` keys at most, which the driver gets and broadcasts) is cut into pieces of
    about so many by the hash of ``spread``, and its row of ``right`` is repeated once a piece. Without such a key it is
    a plain join.
    """
    most = max(rows // share, least)
    found = counts.filter(F.col("n") > most).select(F.col(key).alias("__hot"), F.ceil(F.col("n") / most).cast("int").alias("__pieces")) if rows > most else None
    listed = found.collect() if found is not None else []
    if not listed:
        return left.join(right, F.col(key) == F.col(on))
    hot = F.broadcast(left.sparkSession.createDataFrame(listed, found.schema))
    x = left.join(hot, F.col(key) == F.col("__hot"), "left").withColumn("__piece", F.coalesce(F.pmod(F.xxhash64(spread), "__pieces").cast("int"), F.lit(0))).drop("__hot", "__pieces")
    y = right.join(hot, F.col(on) == F.col("__hot"), "left").withColumn("__at", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("__pieces"), F.lit(1)) - 1))).drop("__hot", "__pieces")
    return x.join(y, (F.col(key) == F.col(on)) & (F.col("__piece") == F.col("__at"))).drop("__piece", "__at")


def components(edges: DataFrame) -> tuple[DataFrame, list[str]]:
    """Connected components of ``edges(a, b)`` by alternating large-star and small-star until nothing changes.

    Returns ``(id, component_id)`` for every id on an edge, ``component_id`` being the smallest id reachable, and
    the paths of the tables it rests on. Every round reads and writes tables in the shared folder. The rows of a hub
    are spread over tasks.
    """
    spark = edges.sparkSession
    e, path = write_shared(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    mark = e.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
    while True:
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
        large = spread_join(both, low.select(F.col("a").alias("u"), F.least("a", "m").alias("m")), "a", "u", low, 2 * mark[0], "b").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
        small = spread_join(large, low.select(F.col("a").alias("u"), "m"), "a", "u", low, mark[0], "b").select(F.explode(F.array(F.struct("a", "m"), F.struct(F.col("b").alias("a"), "m"))).alias("x")).select("x.a", F.col("x.m").alias("b")).filter("a <> b").distinct()
        new, new_path = write_shared(small, "edges")
        now = new.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        drop_shared(spark, path)
        e, path = new, new_path
        if now == mark:
            break
        mark = now
    hubs = e.select(F.col("b").alias("id")).distinct().select("id", F.col("id").alias("component_id"))
    return e.select(F.col("a").alias("id"), F.col("b").alias("component_id")).union(hubs), [path]


def blocks_of_stars(stars: DataFrame, block: int) -> tuple[DataFrame, str]:
    """Stars (id, lead, c, lc) that have members in another component than their lead, cut into pairs of blocks.

    Rows (cell, i, j, lead, id, c, side): side 1 has the members outside the lead's component, side 0 all members. A
    group (cell, i, j) has about ``block`` rows of a star on each side, or whole small stars; every member of side 1
    meets every one of side 0 in one group. Also the path of a table it rests on.
    """
    sizes = stars.groupBy("lead").agg(F.count("*").alias("m"), F.count_if(F.col("c") != F.col("lc")).alias("o")).filter("m > 1 and o > 0")
    sizes, path = write_shared(sizes.select("lead", "m", F.ceil(F.col("m") / block).cast("int").alias("js"), F.ceil(F.col("o") / block).cast("int").alias("is")), "sizes")
    whole = sizes.agg(F.sum("m").alias("all"), F.sum(F.expr("case when js = 1 and is = 1 then m end")).alias("few")).first()
    cells = max(1, (whole["few"] or 0) // block)
    x = spread_join(stars, sizes.withColumnRenamed("lead", "of"), "lead", "of", sizes.select("lead", F.col("m").alias("n")), whole["all"] or 0, "id").drop("of")
    x = x.withColumn("cell", F.when(F.expr("js = 1 and is = 1"), F.pmod(F.xxhash64("lead"), F.lit(cells))).otherwise(-1 - F.col("lead")))
    all_ = x.select("cell", "lead", "id", "c", F.lit(0).alias("side"), F.explode(F.expr("sequence(0, is - 1)")).alias("i"), F.expr("cast(pmod(xxhash64(id), js) as int)").alias("j"))
    odd = x.filter("c <> lc").select("cell", "lead", "id", "c", F.lit(1).alias("side"), F.expr("cast(pmod(xxhash64(id, 1), is) as int)").alias("i"), F.explode(F.expr("sequence(0, js - 1)")).alias("j"))
    return all_.union(odd), path


def bucket_components(keyed: DataFrame, confirm, across) -> tuple[DataFrame, list[str]]:
    """Components of ids that share buckets ``keyed(key, id)`` and that ``confirm`` and ``across`` find linked.

    Every member is confirmed against the smallest id of each of its buckets, by ``confirm(pairs(a, b), members(id),
    counts(b, n), rows)``; pairs have a > b, each once, n is a lead's number of pairs and ``rows`` that of all. The
    members of all buckets with one smallest id are its star. Those in another component than that id are then compared
    with the whole star by ``across(stars(id, lead, c, lc), members)``, with the components c of the id and lc of the
    lead. So no link between components that a bucket shows is lost, and no bucket is expanded into all its pairs.
    Returns what :func:`components` does.
    """
    spark = keyed.sparkSession
    first = keyed.groupBy("key").agg(F.min("id").alias("lead"), F.count("*").alias("n")).filter("n > 1")
    first, first_path = write_shared(first, "leads")
    rows = first.agg(F.sum("n")).first()[0] or 0
    shared = spread_join(keyed, first.select(F.col("key").alias("k"), "lead"), "key", "k", first.select("key", "n"), rows, "id")
    starred, starred_path = write_shared(shared.filter("id <> lead").select(F.col("id").alias("a"), F.col("lead").alias("b")).distinct(), "pairs")
    members = starred.select(F.col("a").alias("id")).union(starred.select("b")).distinct()
    counts, counts_path = write_shared(starred.groupBy("b").agg(F.count("*").alias("n")), "counts")
    pairs = counts.agg(F.sum("n")).first()[0] or 0
    links, links_path = write_shared(confirm(starred, members, counts, pairs), "links")
    of, paths = components(links)

    known = of.select(F.col("id").alias("w"), F.col("component_id").alias("c"))
    stars = starred.select(F.col("a").alias("id"), F.col("b").alias("lead")).join(known, F.col("id") == F.col("w"), "left").withColumn("c", F.coalesce("c", "id")).drop("w")
    leads = counts.select(F.col("b").alias("l")).join(known.withColumnRenamed("c", "lc"), F.col("l") == F.col("w"), "left").select("l", F.coalesce("lc", "l").alias("lc"))
    stars = spread_join(stars, leads, "lead", "l", counts.withColumnRenamed("b", "lead"), pairs, "id").drop("l")
    stars, stars_path = write_shared(stars.select("id", "lead", "c", "lc"), "stars")
    more, more_path = write_shared(across(stars, members), "links")
    if not more.isEmpty():
        drop_shared(spark, *paths)
        of, paths = components(links.union(more))
    drop_shared(spark, first_path, starred_path, counts_path, links_path, stars_path, more_path)
    return of, paths
