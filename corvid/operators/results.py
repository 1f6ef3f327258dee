"""Search results as responses, contexts and tools show them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvid.functions.text import or_empty

# Characters of content in a context, sources and triplets shown, results a tool may ask for, and decimals it shows.
CONTENT, CITED, TRIPLETS, MOST_RESULTS, DECIMALS = 500, 2, 5, 10, 3
SCORES = ["combined_score", "final_score", "rerank_score", "vector_score", "rule_score", "triplet_score"]


def _with(rows: DataFrame, names: dict[str, Column]) -> DataFrame:
    """``rows`` with the columns it lacks."""
    return rows.withColumns({c: d for c, d in names.items() if c not in rows.columns})


def faq_results(rows: DataFrame) -> DataFrame:
    """Hits of pairs under fixed names; a missing source is FAQ, other missing texts are empty."""
    x = _with(rows, {"source": F.lit("FAQ"), **{c: F.lit("") for c in ("source_url", "category", "sub_category", "id")}})
    return x.withColumns({c: or_empty(c) for c in ("question", "answer", "category", "sub_category", "source_url")}).withColumn("source", F.coalesce("source", F.lit("FAQ")))


def section_results(rows: DataFrame) -> DataFrame:
    """Hits of sections with one score: the final one, else the combined, else their own, else 0."""
    null = F.lit(None).cast("double")
    x = _with(rows, {**{c: null for c in SCORES}, "score": null, **{c: F.lit("") for c in ("category", "parent_content", "effective_date", "source_url")}})
    texts = ("document_title", "section_title", "section_content", "category", "parent_content", "effective_date", "source_url")
    x = x.withColumn("score", F.coalesce("final_score", "combined_score", "score", F.lit(0.0))).withColumns({c: or_empty(c) for c in texts})
    return x.withColumns({c: F.coalesce(c, F.lit(0.0)) for c in ("vector_score", "rule_score", "triplet_score")})


def public(rows: DataFrame, kind: str) -> DataFrame:
    """The few columns that callers see."""
    return rows.select("query_id", "rank", "question", "answer", "category", "score") if kind == "faq" else rows.select("query_id", "rank", "document_title", "section_title", "section_content", "score")


def for_tool(rows: DataFrame, n: int) -> DataFrame:
    """At most ten results a query, however many are asked for."""
    return rows.filter(F.col("rank") <= min(n, MOST_RESULTS))


def context_items(hits: Column) -> Column:
    """Hits as a context keeps them: content cut at 500 characters, and a map of the scores that there are."""

    def one(h: Column) -> Column:
        there = F.map_filter(F.map_from_arrays(F.array(*[F.lit(c) for c in SCORES]), F.array(*[h[c] for c in SCORES])), lambda _, v: v.isNotNull())
        return F.struct(or_empty(h["document_title"]).alias("document_title"), or_empty(h["section_title"]).alias("section_title"), F.substring(or_empty(h["section_content"]), 1, CONTENT).alias("section_content"), F.coalesce(h["score"], F.lit(0.0)).alias("score"), there.alias("scores"))

    return F.transform(hits, one)


def cut(hits: Column) -> Column:
    """Hits with contents cut as a context keeps them."""
    return F.transform(hits, lambda h: h.withField("section_content", F.substring(h["section_content"], 1, CONTENT)))


def verification_items(context: Column) -> Column:
    return F.transform(context, lambda c: F.struct(or_empty(c["section_title"]).alias("title"), or_empty(c["section_content"]).alias("content")))


def section_context(hits: Column) -> Column:
    """Hits as the context of a prompt: document, section if it has a title, content."""
    title = lambda h: F.when(or_empty(h["section_title"]) != "", F.concat(h["section_title"], F.lit("\n"))).otherwise("")
    return F.array_join(F.transform(hits, lambda h: F.concat(F.lit("["), or_empty(h["document_title"]), F.lit("]\n"), title(h), or_empty(h["section_content"]))), "\n\n---\n\n")


def section_metadata(hits: Column, reference: Column, limited: Column) -> Column:
    """struct of the section asked for, the band, and the words and first five triplets that hits matched by."""
    return F.struct(
        reference.alias("section_reference"),
        F.when(limited, "mid").alias("confidence_band"),
        F.array_sort(F.array_distinct(F.flatten(F.transform(hits, lambda h: h["matched_keywords"])))).alias("matched_keywords"),
        F.slice(F.flatten(F.transform(hits, lambda h: h["matched_triplets"])), 1, TRIPLETS).alias("matched_triplets"),
    )


def section_confidence(hits: Column) -> Column:
    """The mean of all hits' scores; 0 without hits."""
    return F.when(F.size(hits) > 0, F.aggregate(hits, F.lit(0.0), lambda s, h: s + F.coalesce(h["score"], F.lit(0.0))) / F.size(hits)).otherwise(0.0)


def no_answer(score: Column, low: float = 0.40) -> Column:
    """struct of the response without context: a question back in the low band, else a handover to a person."""
    asked = score >= low
    return F.struct(F.lit("no_context").alias("source"), F.when(asked, score).otherwise(0.0).alias("confidence"), F.when(asked, "clarification").otherwise("handoff").alias("response_mode"), F.when(asked, "low").alias("confidence_band"), F.when(asked, "sections_low").otherwise("no_context").alias("route"))


def response(row: DataFrame) -> DataFrame:
    """Rows with every column of a response; what is missing takes its default."""
    empty = F.array().cast("array<string>")
    defaults = {"answer": F.lit(""), "source": F.lit("no_context"), "confidence": F.lit(0.0), "response_mode": F.lit("answer"), "citations": empty, "verified": F.lit(True), "verification_score": F.lit(1.0), "verification_issues": empty}
    x = _with(row, defaults)
    return x.withColumns({c: F.coalesce(c, d) for c, d in defaults.items()}).select("id", "query", *defaults)


def asked(responses: DataFrame) -> DataFrame:
    """Responses as the question tool returns them, scores with three decimals."""
    return responses.withColumns({c: F.round(c, DECIMALS) for c in ("confidence", "verification_score")})


def section_or_best(hits: DataFrame) -> DataFrame:
    """Of each request's hits (request, section, rank, document_title, section_title) the first whose title holds the section, else the best one with a note."""
    own = F.when(F.contains(or_empty("section_title"), "section"), F.struct("rank", "document_title", "section_title"))
    x = hits.groupBy("request").agg(F.min(own).alias("own"), F.min(F.struct("rank", "document_title", "section_title")).alias("best"))
    pick = F.coalesce("own", "best")
    return x.select("request", pick["document_title"].alias("document_title"), pick["section_title"].alias("section_title"), F.when(F.col("own").isNull(), "Exact section not found, returning best match").alias("note"))


def source_ids(items: Column) -> Column:
    """Each item's document, id or source, else its section; items without any go."""
    known = F.transform(items, lambda c: F.coalesce(F.nullif(c["doc_id"], F.lit("")), F.nullif(c["id"], F.lit("")), F.nullif(c["source"], F.lit("")), c["section_title"]))
    return F.filter(known, lambda x: x.isNotNull())


def retrieved_ids(items: Column) -> Column:
    """The set of all items' documents, ids or sources, and sections, for comparison with expected sources."""
    first = F.transform(items, lambda c: F.coalesce(F.nullif(c["doc_id"], F.lit("")), F.nullif(c["id"], F.lit("")), F.nullif(c["source"], F.lit(""))))
    both = F.concat(first, F.transform(items, lambda c: c["section_title"]))
    return F.array_distinct(F.filter(both, lambda x: x.isNotNull()))
