"""Exact deduplication by an extendible-hash index on shared files, in DataFrame operations only.

1. Tasks combine their copies of a text, and copies meet in ``SALT`` parts by the id's hash: a group of any size leaves
   ``SALT`` entries (hash, text, largest id, rows) at most.
2. The directory starts with a bucket for each ``capacity`` entries and doubles while one is overfull: a bucket over
   ``capacity`` entries splits on its next hash bit until it fits or holds one hash alone. The depth has no limit.
3. Owner tasks take ranges of buckets. An owner gets its buckets' entries, with the text wherever the hash may have come
   more than once; it merges entries of one hash whose texts are equal byte by byte, and chains those that differ
   (``chain_no`` of ``chain_len``). What stays and how many rows there were is decided here. The owners write the index to
   the shared folder.
4. A row finds its entry by its hash; where the chain is longer than one, by its text in the chain, byte by byte. Entries
   with a large share of the rows are broadcast, by hash and without text.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvid.llm.common import lookup, may_be_among, write_shared

#: Parts in which copies of a text are combined before they reach their owner.
SALT = 4


def _hash(text, bits: int):
    """The upper ``bits`` bits of a 64-bit hash; fewer than 64 serve to test collisions."""
    h = F.xxhash64(text)
    return h if bits >= 64 else F.shiftleft(F.shiftrightunsigned(h, 64 - bits), 64 - bits)


def _bucket(depth) -> str:
    """The first ``depth`` bits of a hash, moved so that buckets order as the hashes in them do."""
    return f"case when {depth} = 0 then 0L else shiftleft(shiftright(hash, 64 - {depth}), 64 - {depth}) end"


def _rows(docs: DataFrame, id_col: str, text_col: str, hash_bits: int) -> DataFrame:
    return docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("t")).withColumn("hash", _hash(F.col("t"), hash_bits))


def _entries(rows: DataFrame) -> DataFrame:
    """Entries of the texts, up to ``SALT`` for one."""
    part = F.pmod(F.xxhash64("id"), F.lit(SALT))
    found = rows.groupBy("hash", "t", part.alias("part")).agg(F.max("id").alias("keep_id"), F.count("*").alias("group_size"))
    return found.select("hash", "t", F.sha2("t", 256).alias("text_sha256"), "keep_id", "group_size")


def directory(entries: DataFrame, capacity: int, levels: int = 4) -> DataFrame:
    """(hash, depth, bucket) of each hash of ``entries``: the shortest prefix that holds ``capacity`` entries at most."""
    left, out = entries.groupBy("hash").agg(F.count("*").alias("n")), None
    low = max(0, math.floor(math.log2(max(1, entries.count() / capacity))))
    while True:
        high = min(64, low + levels)
        cells = left.groupBy(F.expr(_bucket(high)).alias("cell")).agg(F.sum("n").alias("n"), F.count("*").alias("hashes"))
        tried = cells.withColumnRenamed("cell", "hash").withColumn("depth", F.explode(F.sequence(F.lit(low), F.lit(high)))).withColumn("bucket", F.expr(_bucket("depth")))
        full = tried.groupBy("depth", "bucket").agg(F.sum("n").alias("total"), F.sum("hashes").alias("hashes"), F.collect_list("hash").alias("cells"))
        found = full.filter((F.col("total") <= capacity) | (F.col("depth") == high)).select(F.explode("cells").alias("cell"), "depth", "bucket", ((F.col("total") <= capacity) | (F.col("hashes") == 1)).alias("fits"))
        found = found.groupBy("cell").agg(F.min("depth").alias("depth"), F.min_by("bucket", "depth").alias("bucket"), F.min_by("fits", "depth").alias("fits"))
        placed, _ = write_shared(left.withColumn("cell", F.expr(_bucket(high))).join(found, "cell").select("hash", "n", "depth", "bucket", "fits"), "directory")
        rest = placed.filter("not fits")
        done = placed if high == 64 else placed.filter("fits")
        out = done if out is None else out.union(done)
        if high == 64 or rest.isEmpty():
            return out.select("hash", "depth", "bucket")
        left, low = rest.select("hash", "n"), high + 1


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hash_bits: int = 64, capacity: int = 64) -> DataFrame:
    """One row per distinct text: bucket, depth, hash, chain_no, chain_len, chain_size (rows of the whole chain), keep_id, group_size, text_sha256, and the text where its hash may have come more than once."""
    entries, _ = write_shared(_entries(_rows(docs, id_col, text_col, hash_bits)), "entries")
    places = directory(entries, capacity)
    again = entries.groupBy("hash").agg(F.count("*").alias("n")).filter("n > 1")
    sent = may_be_among(entries, "hash", again, "hash", "again").withColumn("t", F.when(F.col("again"), F.col("t"))).drop("again")
    owned = sent.join(places, "hash").repartitionByRange("bucket")
    # The owner's merge: within a bucket, entries of one hash are one text if their bytes are equal. A hash that came once has no text.
    merged = owned.groupBy("bucket", "depth", "hash", "t").agg(F.max("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"), F.first("text_sha256").alias("text_sha256"))
    chain = Window.partitionBy("bucket", "hash")
    merged = merged.withColumn("chain_no", F.row_number().over(chain.orderBy("text_sha256"))).withColumn("chain_len", F.count("*").over(chain)).withColumn("chain_size", F.sum("group_size").over(chain))
    return write_shared(merged.select("bucket", "depth", "hash", "chain_no", "chain_len", "chain_size", "keep_id", "group_size", "text_sha256", "t").sortWithinPartitions("bucket", "hash", "chain_no"), "index")[0]


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hash_bits: int = 64, capacity: int = 64) -> DataFrame:
    """One row per row of ``docs``: id, keep_id (the group's largest id), group_size, kept, text_sha256.

    A null text counts as empty; empty texts form a group like any other. Rows that repeat an id and its text all
    count in group_size and are all kept. A null id is never a keep_id unless its whole group has null ids; such
    rows are kept. Other columns of ``docs`` are ignored, whatever their names. No rows give no rows.
    """
    index = build_index(docs, id_col, text_col, hash_bits, capacity)
    rows = _rows(docs, id_col, text_col, hash_bits)
    heads = index.filter("chain_no = 1").withColumn("alone", F.col("chain_len") == 1)
    found = lookup(rows.select("id", "hash"), heads, ["hash"], "chain_size", ["keep_id", "group_size", "text_sha256", "alone"])
    out = found.filter("alone").drop("hash", "alone")
    chained = index.filter("chain_len > 1").select("hash").distinct()
    if not chained.isEmpty():
        collided = rows.join(chained, "hash", "left_semi")
        out = out.union(lookup(collided.select("id", "hash", "t"), index.filter("chain_len > 1"), ["hash", "t"], "group_size", ["keep_id", "group_size", "text_sha256"]).drop("hash", "t"))
    return out.select(F.col("id").alias(id_col), "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **params) -> DataFrame:
    """The rows of ``docs``, all columns, whose text has no equal with a larger id. Rows with a null id stay if all of their group have one."""
    index = build_index(docs, id_col, text_col, **params)
    keys = index.select(F.col("keep_id").alias("__keep"), F.col("text_sha256").alias("__sha"))
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.join(keys, F.col(id_col).eqNullSafe(F.col("__keep")) & (F.sha2(text, 256) == F.col("__sha")), "left_semi")


ORACLE_SQL = """
SELECT doc_id,
       max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id,
       count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
"""
