"""Incremental ingest: keyed state across micro-batches decides what is new, and a collection takes each batch once."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from corvid import schemas
from corvid.operators.ingest import faq_id, valid_pairs
from corvid.sources.collection import Collection

TEXTS = [c.split()[0] for c in schemas.FAQ.split(", ")]
_ROWS = "id string, " + schemas.FAQ + ", file string, start long, n long, copies long"
_OUT = "id string, " + schemas.FAQ + ", file string, start long, n long, copies long, known boolean"


def _first_of_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The first row of each id in an Arrow batch, numbered by its place in the partition, with how many there were."""
    place = 0
    for batch in batches:
        seen: dict[str, list] = {}
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            place += 1
            if row[0] in seen:
                seen[row[0]][-1] += 1
            else:
                seen[row[0]] = [*row, place, 1]
        if seen:
            kinds = [*[pa.string()] * (len(TEXTS) + 2), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*seen.values()), kinds)], ["id", *TEXTS, "file", "start", "n", "copies"])


def _keep_first(expire_ms: int | None):
    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        best, copies = None, 0
        for part in parts:
            copies += int(part["copies"].sum())
            top = part.sort_values(["file", "start", "n"]).iloc[:1]
            if best is None or tuple(top[["file", "start", "n"]].iloc[0]) < tuple(best[["file", "start", "n"]].iloc[0]):
                best = top
        if best is not None:
            known = state.exists
            state.update((copies + (state.get[0] if known else 0),))
            if expire_ms is not None:
                state.setTimeoutDuration(expire_ms)
            yield best.assign(copies=copies, known=known)

    return run


def first_rows(stream: DataFrame, expire_ms: int | None = None) -> DataFrame:
    """Of each micro-batch a row an id: its first row by file name and place, how many copies came, and whether an earlier batch had it.

    A task hands on one row an id and Arrow batch, so a hot id sends few rows. An id's state is forgotten ``expire_ms``
    after its last row; without it, it is kept.
    """
    rows = valid_pairs(stream, "question", "answer").withColumn("id", faq_id(F.col("question"), F.col("answer")))
    rows = rows.select("id", *TEXTS, "file", "start").mapInArrow(_first_of_partition, _ROWS)
    timeout = GroupStateTimeout.NoTimeout if expire_ms is None else GroupStateTimeout.ProcessingTimeTimeout
    return rows.groupBy("id").applyInPandasWithState(_keep_first(expire_ms), _OUT, "seen long", "append", timeout)


def stream_faq(spark: SparkSession, folder: str, collection: Collection, checkpoint: str, name: str | None = None, expire_ms: int | None = None, files_a_batch: int = 1000, counters: list | None = None) -> StreamingQuery:
    """Question-answer pairs from JSON lines that appear in ``folder``; runs over what is there and ends.

    The state says which ids earlier batches had, so only rows that other writers added are looked through, unless
    states expire. A batch that runs again (after a failure) finds itself in the collection's log and changes nothing.
    ``name`` names the stream there, by default its checkpoint. ``counters`` gets a dict a batch: rows, added, skipped.
    """
    source = name or checkpoint

    def add(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        try:
            rows = batch.agg(F.sum("copies")).first()[0] or 0  # runs every task of the batch, as its state must be committed even where nothing is new
            before = collection.manifest()["batches"].get(source, -1)
            new = batch.filter("not known").withColumn("pos", F.struct("file", "start", "n"))
            version = collection.add(new, "pos", source, number, own=expire_ms is None)
            if counters is not None and before < number:
                added = next((a["rows"] for a in collection.manifest(version)["adds"] if a["version"] == version), 0) if version else 0
                counters.append({"batch": number, "rows": rows, "added": added, "skipped": rows - added})
        finally:
            batch.unpersist()

    stream = spark.readStream.schema(schemas.FAQ).option("maxFilesPerTrigger", files_a_batch).json(folder)
    stream = stream.select("*", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))
    return first_rows(stream, expire_ms).writeStream.foreachBatch(add).outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latency_windows(events: DataFrame, ts: str = "ts", value: str = "value", width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts and means by time window and type, with a watermark for late rows; works on streams and tables."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.avg(value).alias("mean_value")).select(F.col("w.start").alias("start"), "event_type", "n", "mean_value")
