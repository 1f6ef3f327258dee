"""Model calls as a stage: prompts once each, in batches, with retries, and answers that are kept.

A cluster that loses executors repeats no finished call: prompts are made distinct by their hash, what a store has already
is not asked again, and the answers of a task are files before anything reads them. A call that fails is an error of its
row, never of the job.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvid.sources.collection import Collection
from corvid.sources.shared import write_shared

ANSWERS = "id string, answer string, error string, attempts int"


def _asked(call: Callable[[list[str]], list], batch: int, retries: int, delay: float, backoff: float, valid: Callable[[str], bool] | None):
    """Answers of rows (id, prompt). What fails in a batch is tried again, later each time, and alone in the last round."""

    def attempt(prompts: list[str]) -> list[tuple]:
        try:
            got = list(call(prompts))
        except Exception as e:  # a model may raise anything; the row tells it
            return [(None, f"{type(e).__name__}: {e}")] * len(prompts)
        if len(got) != len(prompts):
            return [(None, f"{len(got)} answers to {len(prompts)} prompts")] * len(prompts)
        return [(None, "no answer") if a is None else (a, "invalid answer") if valid and not valid(a) else (a, None) for a in got]

    def answered(rows: list[tuple]) -> list[tuple]:
        out, left, wait = {}, list(range(len(rows))), delay
        for n in range(retries + 1):
            if n:
                time.sleep(wait)
                wait *= backoff
            groups = [[k] for k in left] if n and n == retries else [left]
            for group in groups:
                for k, (answer, error) in zip(group, attempt([rows[k][1] for k in group])):
                    out[k] = (rows[k][0], answer, error, n + 1)
            left = [k for k in left if out[k][2] is not None]
            if not left:
                break
        return [out[k] for k in range(len(rows))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = list(zip(b.column(0).to_pylist(), b.column(1).to_pylist()))
            for k in range(0, len(rows), batch):
                ids, answers, errors, attempts = zip(*answered(rows[k : k + batch]))
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(answers, pa.string()), pa.array(errors, pa.string()), pa.array(attempts, pa.int32())], ["id", "answer", "error", "attempts"])

    return run


class Model:
    """A model behind ``call`` (prompts to answers, in order; it may raise), with what it answered so far in ``store``.

    ``valid`` says whether an answer can be used; one that can't is asked for again, and given with the error
    ``invalid answer`` after the last try. In the last retry prompts go alone; without retries a batch fails whole. ``delay`` seconds pass before the first retry, ``backoff`` times more before each
    next one. Only answers without an error are kept.
    """

    def __init__(self, call: Callable[[list[str]], list], store: str | None = None, batch: int = 32, retries: int = 2, delay: float = 1.0, backoff: float = 2.0, valid: Callable[[str], bool] | None = None, tasks: int | None = None):
        self.call, self.store, self.tasks = call, store, tasks
        self.run = _asked(call, batch, retries, delay, backoff, valid)

    def ask(self, rows: DataFrame, prompt: str, answer: str = "answer", error: str = "error") -> DataFrame:
        """``rows`` with the columns ``answer`` and ``error``; null prompts have neither."""
        spark = rows.sparkSession
        rows = rows.withColumn("__id", F.sha2(prompt, 256))
        prompts = rows.filter(F.col(prompt).isNotNull()).groupBy(F.col("__id").alias("id")).agg(F.first(prompt).alias("prompt"))
        kept = Collection(spark, self.store, ANSWERS) if self.store else None
        if kept is not None:
            prompts = prompts.join(kept.scan().select("id"), "id", "left_anti")
        if self.tasks:
            prompts = prompts.repartition(self.tasks, "id")
        found, _ = write_shared(prompts.select("id", "prompt").mapInArrow(self.run, ANSWERS), "answers")
        if kept is not None:
            kept.add(found.filter("error is null").withColumn("__pos", F.lit(0)), "__pos")
            found = kept.scan().unionByName(found.filter("error is not null"))
        got = found.select(F.col("id").alias("__of"), F.col("answer").alias("__answer"), F.col("error").alias("__error"))
        return rows.join(got, F.col("__id") == F.col("__of"), "left").drop("__id", "__of").withColumnsRenamed({"__answer": answer, "__error": error})


def rerank_scores(candidates: DataFrame, model: Model, query: str, text: str, score: str = "rerank_score") -> DataFrame:
    """``candidates`` with the model's score of each (query, text); null where the call failed or the answer is no number, so that the order before stays."""
    x = model.ask(candidates.withColumn("__pair", F.to_json(F.struct(F.col(query).alias("query"), F.col(text).alias("text")))), "__pair", "__score", "__failed")
    return x.withColumn(score, F.when(F.col("__failed").isNull(), F.col("__score").try_cast("double"))).drop("__pair", "__score", "__failed")
