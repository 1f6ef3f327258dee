"""Aggregates over evaluated cases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def safe_mean(c: Column) -> Column:
    return F.coalesce(F.avg(c), F.lit(0.0))


def safe_std(c: Column) -> Column:
    """Population standard deviation; 0 without rows."""
    return F.coalesce(F.stddev_pop(c), F.lit(0.0))


def mean_where(condition: Column, c: Column) -> Column:
    return safe_mean(F.when(condition, c))


def category(c: Column) -> Column:
    return F.when(F.coalesce(c, F.lit("")) == "", "unknown").otherwise(c)


def summary(cases: DataFrame, by: list[Column] | None = None) -> DataFrame:
    """Counts, means, deviations and the verification rate of cases (similarity, bleu, faithfulness, latency_ms, verified, judge, recall, evaluated)."""
    n = F.count("*")
    return cases.groupBy(*(by or [])).agg(
        n.alias("n"),
        safe_mean(F.col("similarity")).alias("mean_similarity"),
        safe_mean(F.col("bleu")).alias("mean_bleu"),
        safe_mean(F.col("faithfulness")).alias("mean_faithfulness"),
        safe_mean(F.col("latency_ms")).alias("mean_latency_ms"),
        safe_std(F.col("similarity")).alias("std_similarity"),
        safe_std(F.col("bleu")).alias("std_bleu"),
        F.coalesce(F.try_divide(F.count_if("verified"), n), F.lit(0.0)).alias("verification_rate"),
        mean_where(F.col("evaluated"), F.col("recall")).alias("mean_recall"),
        mean_where(F.col("judge") > 0, F.col("judge")).alias("mean_judge"),
    )


def by_category(cases: DataFrame) -> DataFrame:
    """Per category: count and means; zero judge scores count here, unlike in :func:`summary`."""
    return cases.groupBy(category(F.col("category")).alias("category")).agg(F.count("*").alias("n"), safe_mean(F.col("similarity")).alias("mean_similarity"), safe_mean(F.col("bleu")).alias("mean_bleu"), safe_mean(F.col("faithfulness")).alias("mean_faithfulness"), safe_mean(F.col("judge")).alias("mean_judge"))
