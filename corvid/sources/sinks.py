"""Writers of results and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvid.sources.shared import drop_shared, write_shared


def csv_rows(cases: DataFrame) -> DataFrame:
    """Report rows: questions cut at 100 characters, scores with four digits, latencies with one."""
    four = lambda c: F.format_string("%.4f", F.bround(F.col(c), 4))
    return cases.select("case_id", F.substring("question", 1, 100).alias("question"), "category", four("similarity").alias("similarity"), four("bleu").alias("bleu"), four("faithfulness").alias("faithfulness"), F.format_string("%.1f", F.bround(F.col("latency_ms"), 1)).alias("latency_ms"))


def write_csv(cases: DataFrame, path: str) -> None:
    csv_rows(cases).write.mode("overwrite").option("header", True).csv(path)


def write_json(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def slug(name: Column, stamp: str) -> Column:
    """File name of a model's results."""
    return F.concat(F.lit("eval_"), F.lit(stamp), F.lit("_"), F.regexp_replace(F.lower(name), r"[^a-z0-9]+", "_"))


def _one_object(head: DataFrame, rows: DataFrame, name: str, path: str) -> None:
    """The one row of ``head`` and a list ``name`` of all ``rows`` as one JSON object in one file, a row a line.

    The rows are written once; then one task streams their lines in order, so that none holds them all.
    """
    lines, lines_path = write_shared(rows.select(F.to_json(F.struct(*rows.columns)).alias("line")).select(F.monotonically_increasing_id().alias("n"), "line"), "lines")
    first = lines.agg(F.min("n")).first()[0]
    body = lines.select(F.lit(1).alias("part"), "n", F.concat(F.when(F.col("n") == F.lit(first), "").otherwise(","), "line").alias("value"))
    text = F.to_json(F.struct(*head.columns))
    start = head.select(F.lit(0).alias("part"), F.lit(0).cast("long").alias("n"), F.concat(text.substr(F.lit(1), F.length(text) - 1), F.lit(f', "{name}": [')).alias("value"))
    end = head.sparkSession.range(1).select(F.lit(2).alias("part"), F.col("id").alias("n"), F.lit("]}").alias("value"))
    start.union(body).union(end).repartition(1).sortWithinPartitions("part", "n").select("value").write.mode("overwrite").text(path)
    drop_shared(head.sparkSession, lines_path)


def write_dataset(items: DataFrame, path: str, model: str, provider: str, as_of: str, version: str = "1.0") -> None:
    """A versioned dataset as one JSON object in one file."""
    head = [F.lit(v).alias(k) for k, v in (("version", version), ("generator_model", model), ("generator_provider", provider), ("generation_timestamp", as_of))]
    _one_object(items.sparkSession.range(1).select(*head), items, "items", path)


def write_results(summary: DataFrame, cases: DataFrame, folder: str, model: str, stamp: str) -> str:
    """A model's summary with its cases in one JSON file of a folder named after model and time; returns its path."""
    name = summary.sparkSession.range(1).select(slug(F.lit(model), stamp)).first()[0]
    _one_object(summary.withColumn("model_name", F.lit(model)), cases, "case_results", f"{folder.rstrip('/')}/{name}")
    return f"{folder.rstrip('/')}/{name}"


def markdown(models: DataFrame, categories: DataFrame, title: str = "Evaluation") -> str:
    """A report of one row a model and one a model and category, both small by their meaning."""
    lines = [f"# {title}", "", "| Model | Similarity | BLEU | Faithfulness | Latency (ms) | Verified |", "|---|---|---|---|---|---|"]
    for m in models.orderBy("model").collect():
        lines.append(f"| {m['model']} | {m['mean_similarity']:.3f} | {m['mean_bleu']:.3f} | {m['mean_faithfulness']:.3f} | {m['mean_latency_ms']:.1f} | {m['verification_rate'] * 100:.1f}% |")
    lines += ["", "| Category | Model | Similarity | BLEU | Count |", "|---|---|---|---|---|"]
    for c in categories.orderBy("category", "model").collect():
        lines.append(f"| {c['category']} | {c['model']} | {c['mean_similarity']:.3f} | {c['mean_bleu']:.3f} | {c['n']} |")
    return "\n".join(lines) + "\n"
