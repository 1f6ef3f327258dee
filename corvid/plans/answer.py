"""From queries to responses in stages: search pairs, route, search sections for what is undecided, route, generate, verify.

The first search is written once, to the shared folder; both branches read it, and the sections' search (vectors, rules,
relations, reranking) sees the undecided queries only. A model is asked once a query, for its answer, and once more for
each answer from sections.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvid.functions.text import or_empty
from corvid.functions.vectors import unit
from corvid.operators import cases, hybrid, results, routing, rules, search, verification
from corvid.providers import Providers
from corvid.sources.shared import write_shared

# What a model is told where there is no context.
TOO_LITTLE, NOTHING = "관련 근거가 부족합니다.", "관련 정보를 찾을 수 없습니다."
#: What a model is asked for, by route.
SYSTEM = {
    "faq_ok": "Answer from these questions and answers; add nothing.",
    "faq_mid": "These questions and answers are only similar. Answer as far as they go, say what is uncertain, and ask for what is missing.",
    "section_ok": "Answer from these sections alone, and name each as [참조: document section].",
    "section_mid": "These sections match in part. Answer as far as they go, say what is uncertain, and name each as [참조: document section].",
    "section_low": "Say that the question is too vague to be answered, and ask for one or two details.",
    "none": "Say that nothing was found, and how to reach a person.",
}
ITEM = "struct<rank:int,score:double,id:string,source:string,question:string,answer:string,category:string,sub_category:string,document_title:string,section_title:string,section_content:string,scores:map<string,double>,matched_keywords:array<string>,matched_triplets:array<string>>"


def _items(rows: DataFrame, **columns: Column) -> DataFrame:
    """(query_id, hits): each query's hits by rank, fields that ``columns`` doesn't name null."""
    fields = [f.split(":", 1) for f in ITEM.removeprefix("struct<").removesuffix(">").replace("map<string,double>", "map<string;double>").split(",")]
    hit = F.struct(*[columns.get(n, F.col(n) if n in ("rank", "score") else F.lit(None)).cast(k.replace(";", ",")).alias(n) for n, k in fields])
    return rows.groupBy("query_id").agg(F.array_sort(F.collect_list(hit), lambda a, b: a["rank"] - b["rank"]).alias("hits"))


def _with_hits(queries: DataFrame, hits: DataFrame) -> DataFrame:
    x = queries.join(hits, F.col("id") == F.col("query_id"), "left").drop("query_id").withColumn("hits", F.coalesce("hits", F.array().cast(f"array<{ITEM}>")))
    return x.withColumn("top", F.coalesce(F.get("hits", F.lit(0))["score"], F.lit(0.0)))


def faq_context(hits: Column) -> Column:
    return F.array_join(F.transform(hits, lambda h: F.concat(F.lit("Q: "), or_empty(h["question"]), F.lit("\nA: "), or_empty(h["answer"]))), "\n\n")


def answers(queries: DataFrame, faq: DataFrame, sections: DataFrame, bands: routing.Bands = routing.Bands(), providers: Providers = Providers(), k: int = 5, stored: DataFrame | None = None, config: hybrid.Config | None = None, words: dict[str, float] | None = None, use_hybrid: bool = True, verify: bool = True, threshold: float = verification.THRESHOLD) -> DataFrame:
    """(id, query, answer, source, confidence, response_mode, context, citations, verified, verification_score, verification_issues, metadata, error) of queries (id, query, vector).

    ``faq`` has id, vector, question, answer (category, sub_category); ``sections`` id, vector, document_title,
    section_title, section_content; ``stored`` their relations. Ids of queries must be unique. metadata has the route,
    the band of middle and low scores, thresholds, and what a route tells of its hits. ``error`` says why a model gave no
    answer; the answer is empty then.
    """
    has = lambda df, c: F.col(c) if c in df.columns else F.lit("")
    pairs = faq.select(F.col("id").alias("item_id"), "question", "answer", has(faq, "category").alias("category"), has(faq, "sub_category").alias("sub_category"))
    found = search.top_k(queries, faq, k, "id", "vector", exclude_self=False).join(pairs, "item_id")
    hits = _items(found, id=F.col("item_id").cast("string"), source=F.lit("FAQ"), **{c: or_empty(c) for c in ("question", "answer", "category", "sub_category")})
    first, _ = write_shared(_with_hits(queries.select("id", "query", "vector"), hits).withColumn("route", routing.route_faq(F.col("top"), bands)), "first-search")

    undecided = first.filter("route = 'sections'").select("id", "query", "vector")
    rerank = providers.rerank if config is not None and config.rerank_enabled else None
    ranked = results.section_results(hybrid.hybrid_search(undecided, sections, stored, config, k, rerank, words, enabled=use_hybrid))
    scores = F.map_filter(F.map_from_arrays(F.array(*[F.lit(c) for c in results.SCORES]), F.array(*[F.col(c).cast("double") for c in results.SCORES])), lambda _, v: v.isNotNull())
    hits = _items(ranked, scores=scores, **{c: F.col(c) for c in ("document_title", "section_title", "section_content", "matched_keywords", "matched_triplets")})
    second = _with_hits(undecided, hits).withColumn("route", routing.route_sections(F.col("top"), bands))

    x = first.filter("route <> 'sections'").unionByName(second).drop("vector")
    direct, told = F.col("route").startswith("faq"), F.col("route").isin("section_ok", "section_mid")
    near = F.when(F.col("route") == "faq_ok", routing.relevant(F.col("hits"), bands.faq)).when(F.col("route") == "faq_mid", routing.relevant(F.col("hits"), bands.faq_mid)).when(told, F.col("hits"))
    x = x.withColumn("hits", F.coalesce(near, F.array().cast(f"array<{ITEM}>")))
    text = F.when(direct, faq_context(F.col("hits"))).when(told, results.section_context(F.col("hits"))).when(F.col("route") == "section_low", TOO_LITTLE).otherwise(NOTHING)
    x = x.withColumn("__text", text).withColumn("__asked", routing.prompt_of(SYSTEM, F.col("route"), F.col("__text"), F.col("query")))
    if providers.model is not None:
        x = providers.model.ask(x, "__asked", "answer", "error").withColumn("answer", or_empty("answer"))
    else:
        x = x.withColumn("answer", or_empty(providers.generate(F.col("__asked"), F.col("__text")))).withColumn("error", F.lit(None).cast("string"))
    x = x.withColumn("source", F.when(direct, "faq").when(told, "sections").otherwise("no_context"))
    x = x.withColumn("confidence", F.when(told, results.section_confidence(F.col("hits"))).when(F.col("route") == "none", 0.0).otherwise(F.col("top")))
    x = x.withColumn("response_mode", F.when(F.col("route").isin("faq_ok", "section_ok"), "answer").when(F.col("route").isin("faq_mid", "section_mid"), "limited_answer").when(F.col("route") == "section_low", "clarification").otherwise("handoff"))
    best = F.get("hits", F.lit(0))
    none = F.array().cast("array<string>")
    cited = routing.citations_or_titles(F.col("answer"), F.transform("hits", lambda h: F.struct(h["document_title"].alias("document"), h["section_title"].alias("title"))))
    x = x.withColumn("citations", F.when(direct & (F.size("hits") > 0), F.array(F.concat(F.lit("FAQ: "), best["question"]))).when(told, cited).otherwise(none))

    titles = F.transform("hits", lambda h: or_empty(h["section_title"]))
    gate = F.lit(verify) & verification.gated(F.col("source"), F.col("response_mode"), F.lit(True), False)
    to_check = verification.check_prompt(F.col("query"), F.col("answer"), results.verification_items(results.cut(F.col("hits"))))
    reply = providers.check(to_check) if providers.check else None
    if providers.checker is not None:
        # A check that fails leaves the answer to the rules.
        x, reply = providers.checker.ask(x.withColumn("__check", F.when(gate, to_check)), "__check", "__reply", "__check_error"), F.col("__reply")
    x = x.withColumn("__v", F.when(gate, verification.verify(F.col("answer"), titles, reply, True, threshold)))
    x = x.withColumns({"verified": F.coalesce("__v.verified", F.lit(True)), "verification_score": F.coalesce("__v.confidence", F.lit(1.0)), "verification_issues": F.coalesce("__v.issues", none)})

    limits = lambda *names: F.create_map(*[v for n in names for v in (F.lit(n), F.lit(float(getattr(bands, n))))])
    thresholds = F.when(F.col("route") == "faq_mid", limits("faq", "faq_mid")).when(F.col("route") == "section_mid", limits("section", "section_mid")).when(F.col("route") == "section_low", limits("section", "section_mid", "section_low"))
    band = F.when(F.col("route").isin("faq_mid", "section_mid"), "mid").when(F.col("route") == "section_low", "low")
    told_by = lambda c: F.when(told & F.lit(use_hybrid), c)
    usage = providers.usage(F.col("__asked"), F.col("answer")) if providers.usage else F.lit(None).cast("map<string,int>")
    metadata = F.struct(
        "route",
        band.alias("confidence_band"),
        thresholds.alias("thresholds"),
        F.when(direct, or_empty(best["question"])).alias("matched_question"),
        F.when(direct, or_empty(best["category"])).alias("category"),
        F.when(direct, or_empty(best["sub_category"])).alias("sub_category"),
        F.when(told, rules.loose_reference(F.col("query"))).alias("section_reference"),
        told_by(F.lit(True)).alias("hybrid_search"),
        told_by(F.array_sort(F.array_distinct(F.flatten(F.transform("hits", lambda h: h["matched_keywords"]))))).alias("matched_keywords"),
        told_by(F.slice(F.flatten(F.transform("hits", lambda h: h["matched_triplets"])), 1, results.TRIPLETS)).alias("matched_triplets"),
        usage.alias("usage"),
        F.col("__v.reasoning").alias("verification_reasoning"),
    )
    return x.select("id", "query", "answer", "source", "confidence", "response_mode", results.cut(F.col("hits")).alias("context"), "citations", "verified", "verification_score", "verification_issues", metadata.alias("metadata"), "error")


def evaluated_answers(rows: DataFrame, pipeline: Callable[[DataFrame], DataFrame], embed: Callable[[Column], Column] | None = None, judge: Column | None = None) -> DataFrame:
    """Measures of ``rows`` (id, question, expected_answer, category; optional expected_sources) as ``pipeline`` answers them.

    ``pipeline`` takes (id, query, ..) and returns what :func:`answers` does, with an ``error`` where a query failed; a
    query it returns no row for failed, too. ``embed`` gives the vectors that the similarity compares.
    """
    asked = pipeline(rows.withColumnRenamed("question", "query"))
    error = F.col("error") if "error" in asked.columns else F.lit(None).cast("string")
    context = F.transform("context", lambda c: F.struct(F.lit(None).cast("string").alias("doc_id"), c["id"].alias("id"), c["source"].alias("source"), c["section_title"].alias("section_title"), F.coalesce(c["question"], c["document_title"]).alias("title"), F.coalesce(c["answer"], c["section_content"]).alias("content")))
    got = asked.select("id", "answer", error.alias("error"), context.alias("context"), F.col("metadata.usage").alias("usage"), "source", "response_mode", F.lit(True).alias("__there"))
    x = rows.join(got, "id", "left").withColumn("error", F.when(F.col("__there").isNull(), "no response").otherwise(F.col("error"))).drop("__there")
    x = cases.answered(x, lambda c: c)
    if embed is not None:
        x = x.withColumn("expected_vector", unit(embed(or_empty("expected_answer")))).withColumn("generated_vector", unit(embed(F.col("generated"))))
    return cases.evaluated(x.withColumn("metadata", F.col("usage")), judge=judge)
