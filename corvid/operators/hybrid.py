"""Hybrid ranking: weighted scores, optional reranking with a blend, filling, explanations."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvid import models
from corvid.functions.text import fixed, or_empty
from corvid.operators import rules, search, triplets


@dataclass(frozen=True)
class Weights:
    """Shares of the three scores, scaled to 1 if they are off by more than 0.01, and the share of a reranker."""

    vector: float = 0.5
    rule: float = 0.3
    triplet: float = 0.2
    rerank: float = 0.3

    def __post_init__(self):
        total = self.vector + self.rule + self.triplet
        if total <= 0:
            raise ValueError("weights must add up to more than 0")
        if not 0 <= self.rerank <= 1:
            raise ValueError("the reranker's weight must be from 0 to 1")
        if abs(total - 1) > 0.01:
            for k in ("vector", "rule", "triplet"):
                object.__setattr__(self, k, getattr(self, k) / total)


@dataclass(frozen=True)
class Config:
    """Weights, and whether and how much to rerank; :func:`corvid.sources.config.hybrid_config` reads it from a file."""

    weights: Weights = Weights()
    rerank_enabled: bool = False
    rerank_candidates: int = 20
    rerank_top_k: int | None = None
    rerank_model: str = ""
    rerank_batch_size: int = 32
    rerank_max_length: int | None = None


def overfetch(n: int, rerank_candidates: int | None = None) -> int:
    return max(3 * n, rerank_candidates or 0)


def combined(weights: Weights, vector: Column, rule: Column, triplet: Column) -> Column:
    return weights.vector * F.coalesce(vector, F.lit(0.0)) + weights.rule * F.coalesce(rule, F.lit(0.0)) + weights.triplet * F.coalesce(triplet, F.lit(0.0))


def rank_by(score: str, per: str, tie: str) -> Column:
    return F.row_number().over(Window.partitionBy(per).orderBy(F.desc(score), tie))


def rerank_blend(rows: DataFrame, weight: float, per: str, combined_col: str = "combined_score", rerank_col: str = "rerank_score") -> DataFrame:
    """final_score of the reranked rows: min-max of finite rerank scores within a query (0.5 if all are equal), blended; else the combined score."""
    score = F.col(rerank_col)
    finite = F.when(score.isNotNull() & ~F.isnan(score) & (F.abs(score) < float("inf")), score)
    by = Window.partitionBy(per)
    low, high = F.min(finite).over(by), F.max(finite).over(by)
    scaled = F.when(high == low, 0.5).otherwise((finite - low) / (high - low))
    return rows.withColumn("final_score", F.when(finite.isNull(), F.col(combined_col)).otherwise((1 - weight) * F.col(combined_col) + weight * scaled))


def rerank_and_fill(rows: DataFrame, n: int, top: int, weight: float, per: str, tie: str) -> DataFrame:
    """The ``top`` rows by rerank score, blended and sorted, then the others by combined score, cut at n a query.

    Blocks are not sorted together; rows that fill keep their combined score as the final one. Rows with equal scores, or
    without any where the reranker failed, stay in the order of their combined scores.
    """
    order = F.coalesce(F.col("rerank_score"), F.lit(float("-inf")))
    x = rows.withColumn("__r", F.row_number().over(Window.partitionBy(per).orderBy(F.desc(order), F.desc("combined_score"), tie)))
    # Rows beyond ``top`` are blended without a score: one plan for both blocks, or the candidates are searched for each.
    x = rerank_blend(x.withColumn("__s", F.when(F.col("__r") <= top, F.col("rerank_score"))), weight, per, rerank_col="__s")
    x = x.withColumn("block", F.when(F.col("__r") <= top, 0).otherwise(1))
    place = F.row_number().over(Window.partitionBy(per).orderBy("block", F.desc("final_score"), tie))
    return x.drop("__r", "__s").withColumn("rank", place).filter(F.col("rank") <= n)


def candidates(queries: DataFrame, chunks: DataFrame, stored: DataFrame | None, weights: Weights, k: int, words: dict[str, float] | None = None, **columns) -> DataFrame:
    """The k nearest chunks of each query with all scores.

    ``queries`` has id, query and vector; ``chunks`` id, vector, section_title and section_content (category too, to
    search the query's own with ``same_category``). Triplet scores are sums over the candidates alone, as a share of the query's largest.
    """
    hits = search.top_k(queries, chunks, k, "id", "vector", exclude_self=False, **columns)
    x = hits.join(chunks.drop("vector").withColumnRenamed("id", "item_id"), "item_id").join(queries.select(F.col("id").alias("query_id"), "query"), "query_id")
    text = F.concat(or_empty("section_title"), F.lit("\n"), or_empty("section_content"))
    x = x.withColumn("section_match", rules.section_match(rules.section_reference(F.col("query")), or_empty("section_title"))).withColumn("__k", rules.matched_keywords(F.col("query"), text, words))
    x = x.withColumn("rule_score", rules.rule_score(F.col("section_match"), rules.keyword_score(F.col("__k")))).withColumn("matched_keywords", F.transform("__k", lambda m: m["word"])).drop("__k")
    if stored is None:
        return _combined(x.withColumn("triplet_score", F.lit(0.0)).withColumn("matched_triplets", F.array().cast("array<string>")), weights)
    found = triplets.search_within(x.select("query_id", "item_id", "query"), stored).select("query_id", "item_id", F.col("score").alias("s"), F.concat_ws("-", "__t.subject", "__t.predicate", "__t.object").alias("t"), "__t.triplet_id")
    own = found.groupBy("query_id", "item_id")
    own = own.agg(F.sum("s").alias("total"), F.array_sort(F.collect_list(F.struct("triplet_id", "t"))).alias("ts"))
    own = own.withColumn("triplet_score", F.col("total") / F.max("total").over(Window.partitionBy("query_id"))).withColumn("matched_triplets", F.transform("ts", lambda t: t["t"])).drop("total", "ts")
    x = x.join(own, ["query_id", "item_id"], "left").withColumn("triplet_score", F.coalesce("triplet_score", F.lit(0.0))).withColumn("matched_triplets", F.coalesce("matched_triplets", F.array().cast("array<string>")))
    return _combined(x, weights)


def _combined(x: DataFrame, weights: Weights) -> DataFrame:
    return x.withColumnRenamed("score", "vector_score").withColumn("combined_score", combined(weights, F.col("vector_score"), F.col("rule_score"), F.col("triplet_score")))


def hybrid_search(queries: DataFrame, chunks: DataFrame, stored: DataFrame | None, config: Config | None = None, n: int = 5, rerank=None, words: dict[str, float] | None = None, enabled: bool = True, **columns) -> DataFrame:
    """The n best chunks of each query, by all scores, or by vectors alone where ``enabled`` is off.

    ``rerank(query, text)`` gives a column of scores for the best candidates where the config wants it; a
    :class:`corvid.models.Model` is asked for the best candidates' scores in a stage of its own.
    """
    config = config or Config()
    if not enabled:
        x = candidates(queries, chunks, None, Weights(1.0, 0.0, 0.0), n, words, **columns)
        return x.withColumn("rerank_score", F.lit(None).cast("double")).withColumn("final_score", F.col("vector_score"))
    wanted = rerank is not None and config.rerank_enabled
    x = candidates(queries, chunks, stored, config.weights, overfetch(n, config.rerank_candidates if wanted else None), words, **columns)
    x = x.withColumn("rank", rank_by("combined_score", "query_id", "item_id"))
    if not wanted:
        return x.filter(F.col("rank") <= n).withColumn("rerank_score", F.lit(None).cast("double")).withColumn("final_score", F.col("combined_score"))
    pool = max(config.rerank_candidates, n)
    text = F.when(or_empty("section_title") != "", F.concat(F.col("section_title"), F.lit("\n"), or_empty("section_content"))).otherwise(or_empty("section_content"))
    if isinstance(rerank, models.Model):
        best = models.rerank_scores(x.filter(F.col("rank") <= pool).withColumn("__text", text), rerank, "query", "__text").drop("__text")
        x = best.unionByName(x.filter(F.col("rank") > pool), allowMissingColumns=True)
    else:
        x = x.withColumn("rerank_score", F.when(F.col("rank") <= pool, rerank(F.col("query"), text)))
    top = min(pool, n, config.rerank_top_k or n)
    return rerank_and_fill(x, n, top, config.weights.rerank, "query_id", "item_id").drop("block")


def explanation(vector: Column, rule: Column, section: Column, words: Column, triplet: Column, first_triplet: Column, rerank: Column, final: Column, combined_score: Column) -> Column:
    """The parts of a hit's score as text."""
    two = lambda c: fixed(c, 2)
    rules = F.concat(F.lit("규칙 매칭: "), two(rule), F.when(section, " (조항 일치)").otherwise(""), F.when(F.size(words) > 0, F.concat(F.lit(" (키워드: "), F.array_join(words, ", "), F.lit(")"))).otherwise(""))
    relation = F.concat(F.lit("관계 매칭: "), two(triplet), F.coalesce(F.concat(F.lit(" ("), first_triplet, F.lit(")")), F.lit("")))
    return F.concat_ws(
        " | ",
        F.concat(F.lit("벡터 유사도: "), two(vector)),
        F.when(rule > 0, rules),
        F.when(triplet > 0, relation),
        F.when(rerank.isNotNull(), F.concat(F.lit("재랭킹: "), two(rerank))),
        F.when(final.isNotNull(), F.concat(F.lit("재랭킹 반영: "), two(final))),
        F.concat(F.lit("최종 점수: "), two(F.coalesce(final, combined_score))),
    )
