"""Queries of responses, verification, metrics and aggregates."""

from __future__ import annotations

from pyspark.sql import functions as F

from corvid.functions import morphs
from corvid.functions.jsons import field, lenient
from corvid import providers
from corvid.operators import aggregates, cases, judging, metrics, results, routing, search, verification
from corvid.plans import fixtures as fx
from corvid.plans.fixtures import table
from corvid.plans.search_queries import hits_sql
from corvid.sources import sinks


def _faq(spark, d):
    """User turns with the assistant turn that follows."""
    rows = table(spark, d, "conversations").withColumn("answer", F.expr("lead(text) over (partition by conv_id order by turn)")).withColumn("next_role", F.expr("lead(role) over (partition by conv_id order by turn)"))
    return rows.filter("role = 'user' and next_role = 'assistant'").select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("question"), F.coalesce("answer", F.lit("")).alias("answer"))


FAQ_SQL = """faq AS (SELECT conv_id, turn, coalesce(text, '') AS question, coalesce(answer, '') AS answer FROM (
  SELECT *, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS answer, lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS next_role FROM conversations) WHERE role = 'user' AND next_role = 'assistant')"""


def _hits(spark, d):
    """Each query vector's five nearest documents as a list of hits."""
    v = table(spark, d, "embeddings")
    hits = search.top_k(v.filter("vec_id % 100 = 0"), v, 5).join(table(spark, d, "documents").select(F.col("doc_id").alias("item_id"), "source", "lang", "text"), "item_id")
    hit = F.struct("rank", F.round("score", 6).alias("score"), F.col("source").alias("document"), F.col("lang").alias("title"), F.coalesce("text", F.lit("")).alias("content"))
    return hits.groupBy("query_id").agg(F.array_sort(F.collect_list(hit)).alias("hits"))


def response_assembly(spark, d):
    x = _hits(spark, d).withColumn("kept", routing.relevant(F.col("hits"), 0.5))
    answer = F.when(F.col("query_id") % 200 == 0, "답변 [참조: 제1조]").otherwise("답변")
    return x.select("query_id", F.md5(routing.context_text(F.col("kept")).cast("binary")).alias("context_md5"), F.round(routing.mean_score(F.col("hits")), 6).alias("confidence"), F.size("kept").alias("n_context"), F.array_join(routing.citations_or_titles(answer, F.col("hits")), ";").alias("citations"), F.lit("faq").alias("source"))


SECTION_HIT = "query_id int, rank int, document_title string, section_title string, section_content string, score double, combined_score double, final_score double, rerank_score double, words array<string>"
SECTION_HITS = [
    (1, 1, "약관", "제1조(목적)", "가" * 600, 0.5, 0.6, 0.75, 2.5, ["해지", "환불"]), (1, 2, "약관", "제2조(해지)", "짧다", 0.5, 0.25, None, None, ["환불"]), (1, 3, None, None, None, None, None, None, None, []),
    (2, 1, "정보", "", "내용", 0.375, None, None, None, ["동의"]),
]


def _section_hits(spark):
    return results.section_results(fx.rows(spark, SECTION_HIT, SECTION_HITS))


def section_results(spark, d):
    return _section_hits(spark).select("query_id", "rank", "document_title", "section_title", "category", "score", "vector_score", "combined_score")


def section_response(spark, d):
    """Context, items, confidence and metadata of the hits of a query."""
    x = _section_hits(spark).withColumn("matched_keywords", F.col("words")).withColumn("matched_triplets", F.transform("words", lambda w: F.concat(w, F.lit("-t"))))
    x = x.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "document_title", "section_title", "section_content", "score", *results.SCORES, "matched_keywords", "matched_triplets"))).alias("hits"))
    m = results.section_metadata(F.col("hits"), F.lit("제1조"), F.col("query_id") == 2)
    items = results.context_items(F.col("hits"))
    return x.select("query_id", results.section_context(F.col("hits")).alias("context"), F.round(results.section_confidence(F.col("hits")), 6).alias("confidence"), F.array_join(F.transform(items, lambda i: F.length(i["section_content"]).cast("string")), ",").alias("n_chars"), F.array_join(F.transform(items, lambda i: F.size(i["scores"]).cast("string")), ",").alias("n_scores"),
                    F.size(results.verification_items(items)).alias("n_items"), m["confidence_band"].alias("band"), F.array_join(m["matched_keywords"], ",").alias("words"), F.array_join(m["matched_triplets"], ",").alias("triplets"))


def faq_results(spark, d):
    """Pairs under the fixed names of results, as the search tool returns them when 20 are asked for."""
    x = _faq(spark, d).select(F.col("conv_id").alias("query_id"), F.col("turn").alias("rank"), "question", "answer", (F.col("turn") / 64).alias("score"), F.when(F.col("turn") % 4 == 0, "web").alias("source"))
    return results.for_tool(results.faq_results(x), 20).select("query_id", "rank", F.md5(F.col("question").cast("binary")).alias("question_md5"), "category", "source", "score")


def responses(spark, d):
    """Responses with all their columns, rounded as the question tool does; low scores ask back or hand over."""
    x = fx.rows(spark, fx.BAND_SCHEMA, fx.BANDS).withColumn("s", F.coalesce("score", F.lit(0.0))).withColumn("n", results.no_answer(F.col("s")))
    x = x.select("id", F.lit("q").alias("query"), F.when(F.col("s") < 0.55, F.col("n.source")).alias("source"), F.when(F.col("s") < 0.55, F.col("n.confidence")).otherwise(F.col("s")).alias("confidence"), F.when(F.col("s") < 0.55, F.col("n.response_mode")).alias("response_mode"))
    return results.asked(results.response(x)).drop("citations", "verification_issues")


def evaluated_cases(spark, d):
    """All pairs as cases: the question as the expected answer, the answer as the generated one, a context of one item."""
    item = F.struct(F.concat(F.lit("c"), F.col("conv_id").cast("string")).alias("doc_id"), F.lit(None).cast("string").alias("id"), F.lit("s").alias("source"), F.lit("제1조(목적)").alias("section_title"), F.lit("t").alias("title"), F.lit("x").alias("content"))
    wanted = F.when(F.col("turn") % 4 == 0, F.array(F.concat(F.lit("c"), F.col("conv_id").cast("string")))).when(F.col("turn") % 4 == 2, F.array().cast("array<string>"))
    x = _faq(spark, d).select("conv_id", "turn", "question", F.col("question").alias("expected_answer"), "answer", F.when(F.col("turn") % 8 == 6, "timeout").alias("error"), F.array(item).alias("context"), wanted.alias("expected_sources"))
    x = cases.evaluated(cases.answered(x, lambda c: c))
    return x.select("conv_id", "turn", F.round("bleu", 6).alias("bleu"), "faithfulness", "verified", F.size("issues").alias("n_issues"), "evaluated", "recall", "precision", "judge", "output_tokens")


def eval_subset(spark, d):
    """The first cases of two categories that have a question and an expected answer."""
    x = cases.usable(_cases(spark, d).withColumn("expected_answer", F.when(F.col("case_id") % 7 > 0, F.col("question"))))
    return cases.limited(cases.in_categories(x, ["en", "fr"]), "case_id", 20).select("case_id", "category")


def golden_items(spark, d):
    """Items for all questions; the stand-in generator answers with its context, and fails on a few."""
    item = F.struct(F.when(F.col("turn") % 4 == 0, F.concat(F.lit("c"), F.col("conv_id").cast("string"))).alias("doc_id"), F.lit("").alias("id"), F.lit(None).cast("string").alias("source"), F.lit("제1조").alias("section_title"), F.when(F.col("turn") % 4 == 0, F.col("answer")).alias("content"), F.col("question").alias("question"), F.col("answer").alias("answer"))
    x = _faq(spark, d).select("question", F.lit(None).cast("string").alias("category"), F.when(F.col("turn") % 8 == 6, "odd").when(F.col("turn") % 8 == 2, "easy").alias("difficulty"), F.array(item).alias("context"))
    x = cases.golden_items(x, lambda prompt, context: F.concat(F.lit(" "), context, F.length(prompt).cast("string")), "2026-02-01T00:00:00")
    return x.select("id", F.md5(F.col("golden_answer").cast("binary")).alias("answer_md5"), "category", "difficulty", F.array_join("expected_sources", ",").alias("sources")).distinct()


def retrieval_union(spark, d):
    v = table(spark, d, "embeddings")
    q = v.filter("vec_id % 100 = 0")
    return cases.retrieval_union(search.top_k(q, v, 3, category_col="label", same_category=True), search.top_k(q, v, 5))


def golden_sets(spark, d):
    rows = [r for kind in ("sections", "adversarial") for r in cases.golden_set(kind)]
    return fx.rows(spark, "id string, question string, expected_answer string, category string", rows).groupBy("category").agg(F.count("*").alias("n"), F.count_distinct("question").alias("n_questions"), F.min("id").alias("first_id"))


def judge_per_criterion(spark, d):
    x = fx.rows(spark, "id int, a string, b string, context string", [(1, '{"score": 4}', "```json\n{\"score\": 2.5, \"reasoning\": \"r\"}\n```", None), (2, "broken", '{"reasoning": "{}"}', None), (3, 'says {"score": 7} here', None, None)])
    s = judging.per_criterion({"correctness": F.col("a"), "fluency": F.col("b")})
    return x.select("id", s["correctness"].alias("correctness"), s["fluency"].alias("fluency"), s["overall"].alias("overall"))


def judge_columns(spark, d):
    """Scores with a context, and neutral ones where the judge failed."""
    x = fx.rows(spark, "id int, reply string, error string", [(1, '{"context_faithfulness": {"score": 5}, "correctness": {"score": 4}, "overall_score": 5}', None), (2, None, "timeout")])
    s = judging.judged_or_neutral(judging.judge_scores(F.col("reply"), judging.CONTEXT_CRITERIA), F.col("error"), judging.CONTEXT_CRITERIA)
    return x.withColumn("s", s).select("id", *[c.alias(n) for n, c in judging.judge_columns(F.col("s"), context=True).items()])


def embed_forms(spark, d):
    """Documents and queries as an embedding model of the prefixed kind gets them."""
    t = F.coalesce("text", F.lit(""))
    return table(spark, d, "documents").select("doc_id", F.md5(providers.passage(t).cast("binary")).alias("passage_md5"), F.md5(providers.query(t).cast("binary")).alias("query_md5"))


def citations(spark, d):
    x = fx.rows(spark, fx.ANSWER_SCHEMA, fx.ANSWERS)
    return x.select("id", F.array_join(verification.cited(F.col("answer")), ";").alias("cited"), F.array_join(routing.citations(F.col("answer")), ";").alias("own"), verification.citations_valid(F.col("answer"), F.col("titles")).alias("valid"))


def verify_rules(spark, d):
    x = fx.rows(spark, fx.ANSWER_SCHEMA, fx.ANSWERS).withColumn("valid", verification.citations_valid(F.col("answer"), F.col("titles"))).withColumn("signs", verification.hedges(F.col("answer")))
    x = x.withColumn("confidence", verification.confidence(F.col("valid"), F.col("signs"), F.col("model_confidence")))
    return x.select("id", "valid", F.size("signs").alias("n_signs"), F.round("confidence", 6).alias("confidence"), verification.verified(F.col("confidence"), verification.issues(F.col("valid"), F.col("signs"))).alias("verified"), verification.reasoning(F.col("valid"), F.col("signs")).alias("reasoning"))


def verify_documents(spark, d):
    """Hedges of the driver's documents: the length rule alone can hit."""
    x = table(spark, d, "documents").select("lang", F.size(verification.hedges(F.coalesce("text", F.lit("")))).alias("n"))
    return x.groupBy("lang").agg(F.count("*").alias("n_docs"), F.sum("n").alias("n_signs"))


def json_lenient(spark, d):
    x = fx.rows(spark, fx.REPLY_SCHEMA, fx.REPLIES).withColumn("v", lenient(F.col("reply")))
    return x.select("id", field(F.col("v"), "$.confidence", "double").alias("confidence"), field(F.col("v"), "$.verified", "boolean").alias("verified"))


def event_properties(spark, d):
    e = table(spark, d, "events")
    keys = F.json_object_keys("props")
    return e.groupBy("event_type").agg(F.count("*").alias("n"), F.count(F.when(keys.isNotNull(), 1)).alias("n_objects"), F.round(F.avg(F.size(F.coalesce(keys, F.array().cast("array<string>")))), 6).alias("mean_keys"))


def bleu4(spark, d):
    x = _faq(spark, d)
    return x.select("conv_id", "turn", F.round(metrics.bleu(F.col("question"), F.col("answer")), 6).alias("bleu"), F.round(metrics.bleu(F.col("answer"), F.col("answer")), 6).alias("self_bleu"))


def bleu_morphs(spark, d):
    """BLEU over morphological tokens, and how many there are."""
    cut = morphs.tokenizer()
    x = _faq(spark, d)
    return x.select("conv_id", "turn", F.size(cut(F.col("answer"))).alias("n_tokens"), F.round(metrics.bleu(F.col("question"), F.col("answer"), tokenizer=cut), 6).alias("bleu"))


def context_overlap(spark, d):
    recall, precision = metrics.overlap(F.col("got"), F.col("want"))
    return fx.rows(spark, fx.CASE_SCHEMA, fx.CASES).select("id", F.round(recall, 6).alias("recall"), F.round(precision, 6).alias("precision"))


def _cases(spark, d):
    """Evaluated cases made of labelled documents: integers over powers of two, so that sums are exact in any order."""
    docs = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id")
    k = F.col("doc_id")
    return docs.select(
        k.alias("case_id"), F.coalesce("text", F.lit("")).alias("question"), F.when(k % 11 == 0, "").otherwise(F.col("lang")).alias("category"), F.concat(F.lit("model"), (k % 3).cast("string")).alias("model"),
        ((k % 64) / 64).alias("similarity"), ((k % 32) / 32).alias("bleu"), F.col("quality").cast("double").alias("faithfulness"), (F.col("n_chars") / 8).alias("latency_ms"), (F.col("toxic") == 0).alias("verified"),
        (k % 6).cast("double").alias("judge"), (k % 4 / 4).alias("recall"), (k % 5 != 0).alias("evaluated"),
    )


CASES_SQL = """cases AS (SELECT doc_id AS case_id, coalesce(text, '') AS question, CASE WHEN doc_id % 11 = 0 THEN '' ELSE lang END AS category, 'model' || (doc_id % 3) AS model,
  (doc_id % 64) / 64 AS similarity, (doc_id % 32) / 32 AS bleu, quality::DOUBLE AS faithfulness, n_chars / 8 AS latency_ms, toxic = 0 AS verified, (doc_id % 6)::DOUBLE AS judge, (doc_id % 4) / 4 AS recall, doc_id % 5 <> 0 AS evaluated
  FROM documents JOIN labels USING (doc_id))"""
SUMMARY_SQL = """count(*) AS n, coalesce(avg(similarity), 0) AS mean_similarity, coalesce(avg(bleu), 0) AS mean_bleu, coalesce(avg(faithfulness), 0) AS mean_faithfulness, coalesce(avg(latency_ms), 0) AS mean_latency_ms,
  round(coalesce(stddev_pop(similarity), 0), 6) AS std_similarity, round(coalesce(stddev_pop(bleu), 0), 6) AS std_bleu, count(*) FILTER (verified) / count(*) AS verification_rate,
  coalesce(avg(recall) FILTER (evaluated), 0) AS mean_recall, coalesce(avg(judge) FILTER (judge > 0), 0) AS mean_judge"""


def _rounded(x):
    return x.withColumns({c: F.round(c, 6) for c in ("std_similarity", "std_bleu")})


def eval_global(spark, d):
    return _rounded(aggregates.summary(_cases(spark, d)))


def eval_by_category(spark, d):
    return aggregates.by_category(_cases(spark, d))


def model_category_report(spark, d):
    return _rounded(aggregates.summary(_cases(spark, d), [F.col("model"), aggregates.category(F.col("category")).alias("category")]))


def csv_report_rows(spark, d):
    return sinks.csv_rows(_cases(spark, d))


def judge_normalise(spark, d):
    return fx.rows(spark, fx.JUDGE_SCHEMA, fx.JUDGES).select("id", metrics.normalised(F.col("score")).alias("normalised"))


def _told(*missing: str, by_pattern: bool = False) -> str:
    warnings = ["Scores extracted via regex fallback"] * by_pattern + [f"Missing {c}, using default 3.0" for c in missing]
    return f"[Parse warnings: {'; '.join(warnings)}]"


JUDGED = [
    (1, '{"correctness": {"score": 4, "reasoning": "r"}, "helpfulness": {"score": 9}, "fluency": 2}'),
    (2, "```json\n{\"overall_score\": 4.5, \"correctness\": {\"score\": 5}, \"summary\": \"good\"}\n```"),
    (3, "no json"),
    (4, None),
    (5, 'Broken {"correctness": {"score": 4, "reasoning": "say "yes""}, "Helpfulness_level": {"note": "x", "score": 2.5}, fluency: {score: 0}, "overall_score": 4'),
    (6, 'Deep {"correctness": {"score": "3.5", "why": {"a": {"b": "c"}}}, "helpfulness": {}, "faithfulness": {"score": "high"}, "fluency": {"score": 1}} end }'),
    (7, "```\n{\"correctness\": {\"score\": 2}, \"helpfulness\": {\"score\": 2}, \"faithfulness\": {\"score\": 2}, \"fluency\": {\"score\": 2}}\n```"),
]
_ALL = ("correctness", "helpfulness", "faithfulness", "fluency")
JUDGED_RIGHT = [
    (1, 4.0, 5.0, 3.0, 3.0, 3.75, _told("faithfulness", "fluency")), (2, 5.0, 3.0, 3.0, 3.0, 4.5, "good " + _told(*_ALL[1:])), (3, 3.0, 3.0, 3.0, 3.0, 3.0, _told(*_ALL)), (4, 3.0, 3.0, 3.0, 3.0, 3.0, _told(*_ALL)),
    (5, 4.0, 2.5, 3.0, 1.0, 4.0, _told("faithfulness", by_pattern=True)), (6, 3.5, 3.0, 3.0, 1.0, 2.625, _told("faithfulness")), (7, 2.0, 2.0, 2.0, 2.0, 2.0, ""),
]


def judge_parse(spark, d):
    s = judging.judge_scores(F.col("reply"))
    return fx.rows(spark, "id int, reply string", JUDGED).withColumn("s", s).select("id", "s.correctness", "s.helpfulness", "s.faithfulness", "s.fluency", "s.overall", "s.summary")


def model_diversity(spark, d):
    """Each generator's judge: its own pair, else its provider's, else the default; never the generator itself."""
    pairs, fall = fx.rows(spark, fx.PAIR_SCHEMA, fx.PAIRS), fx.rows(spark, fx.PROVIDER_SCHEMA, fx.PROVIDER_JUDGES)
    return judging.judges_of(fx.rows(spark, fx.MODEL_SCHEMA, fx.MODELS), pairs, fall).select("id", "judge", "diverse")


def token_usage(spark, d):
    rows = [(1, {}, {"prompt_tokens": 3, "completion_tokens": 4}), (2, {"input_tokens": 2}, {"total_tokens": 9}), (3, {}, {"tokens_used": 5, "input_tokens": 8}), (4, {}, {}), (5, None, None), (6, {"completion_tokens": 7}, {"total_tokens": 9, "prompt_tokens": 1}), (7, {"output_tokens": 1}, {"completion_tokens": 4})]
    put, got = metrics.token_counts(F.col("usage"), F.col("metadata"))
    return fx.rows(spark, "id int, usage map<string,int>, metadata map<string,int>", rows).select("id", put.alias("input_tokens"), got.alias("output_tokens"))


def sequence_ratio(spark, d):
    m = metrics.lightweight(F.col("question"), F.col("answer"))
    return _faq(spark, d).select("conv_id", "turn", F.round(m["string_similarity"], 6).alias("ratio"), m["exact_match"].alias("exact"))


def latency_by_hour(spark, d):
    from corvid.streaming.ingest import latency_windows

    x = latency_windows(table(spark, d, "events"))
    return x.select("start", "event_type", "n", F.round("mean_value", 6).alias("mean_value"))


def order_totals(spark, d):
    """Plain relational work beside the retrieval operators: revenue by nation and year, joins left to the optimizer."""
    li, o, c, n = (table(spark, d, t) for t in ("lineitem", "orders", "customer", "nation"))
    x = li.join(o, li.l_orderkey == o.o_orderkey).join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey)
    return x.groupBy("n_name", F.year("o_orderdate").alias("year")).agg(F.count("*").alias("n"), F.round(F.sum(F.col("l_quantity")), 2).alias("quantity"))


QUERIES = {f.__name__: f for f in (
    section_results, section_response, faq_results, responses, evaluated_cases, eval_subset, golden_items, retrieval_union, golden_sets, judge_per_criterion, judge_columns, embed_forms,
    response_assembly, citations, verify_rules, verify_documents, json_lenient, event_properties, bleu4, bleu_morphs, context_overlap, eval_global, eval_by_category, model_category_report, csv_report_rows,
    judge_normalise, judge_parse, model_diversity, token_usage, sequence_ratio, latency_by_hour, order_totals,
)}

V = verification
ANSWERS_SQL = f"""a AS (SELECT *, list_transform(list_zip(regexp_extract_all(answer, '{V.CITATION}', 1), regexp_extract_all(answer, '{V.CITATION}', 2)), lambda m: CASE WHEN m[1] <> '' THEN m[1] ELSE m[2] END) AS refs,
  list_distinct(titles || list_filter(list_transform(titles, lambda t: regexp_extract(t, '{V.ARTICLE}', 0)), lambda t: t <> '')) AS known FROM {fx.sql(fx.ANSWER_SCHEMA, fx.ANSWERS)}),
v AS (SELECT *, len(refs) > 0 AND len(list_filter(refs, lambda r: NOT (len(list_filter(known, lambda k: contains(k, trim(r)) OR contains(trim(r), k))) > 0 OR regexp_extract(r, '{V.ARTICLE}', 0) = ''
  OR contains(array_to_string(known, chr(10)), regexp_extract(r, '{V.ARTICLE}', 0))))) = 0 AS valid,
  {" + ".join(f"contains(answer, '{h}')::INT" for h in V.HEDGES)} + (length(answer) > 500 AND NOT regexp_matches(answer, '{V.CITATION}'))::INT AS n_signs FROM a),
s AS (SELECT *, 1.0::DOUBLE - CASE WHEN valid THEN 0 ELSE 0.3 END - n_signs * 0.15 AS own FROM v),
w AS (SELECT *, greatest(0, least(1, CASE WHEN model_confidence IS NULL THEN own ELSE (own + model_confidence) / 2 END))::DOUBLE AS confidence FROM s)"""
REASONING_SQL = "CASE WHEN valid THEN '✓ 출처 인용이 유효합니다' ELSE '✗ 출처 인용에 문제가 있습니다' END || ' | ' || CASE WHEN n_signs = 0 THEN '✓ 불확실한 표현이 감지되지 않았습니다' ELSE '✗ ' || n_signs || '개의 주의 표현이 감지되었습니다' END"
SECTION_HITS_SQL = fx.sql(SECTION_HIT, SECTION_HITS)
SPLIT = "list_filter(regexp_split_to_array(regexp_replace({0}, '[^\\p{{L}}\\p{{N}}\\p{{M}}_\\s가-힣]', ' ', 'g'), '\\s+'), lambda x: x <> '')"

#: The driver's texts hold no Hangul, so that runs of letters and of digits are all there is.
MORPHS = "regexp_extract_all({0}, '[\\p{{L}}\\p{{M}}_]+|\\p{{Nd}}+')"


def _grams_sql(x: str) -> str:
    return ", ".join(f"list_transform(generate_series(1, len({x}) - {n - 1}), lambda i: array_to_string(list_slice({x}, i, i + {n - 1}), ' ')) AS {x}{n}" for n in (1, 2, 3, 4))


def _shares_sql(r: str, c: str, name: str) -> str:
    return ", ".join(f"CASE WHEN len({c}) < {n} THEN 0.0 ELSE len(list_filter({c}{n}, lambda g: list_contains({r}{n}, g))) / (len({c}) - {n - 1}) END AS {name}{n}" for n in (1, 2, 3, 4))


def _bleu_sql(r: str, c: str, p: str) -> str:
    ps = [f"{p}{n}" for n in (1, 2, 3, 4)]
    mean = " + ".join(f"ln(greatest({x}, 1e-10))" for x in ps)
    return f"round(CASE WHEN len({r}) = 0 OR len({c}) = 0 OR greatest({', '.join(ps)}) = 0 THEN 0.0 ELSE exp(({mean}) / 4) * CASE WHEN len({c}) >= len({r}) THEN 1 ELSE exp(1 - len({r}) / len({c})) END END, 6)::DOUBLE"


ORACLE_SQL = {
    "response_assembly": f"""{hits_sql()}, h AS (SELECT query_id, rank, score, source, lang, coalesce(text, '') AS content, count(*) FILTER (score >= 0.45) OVER (PARTITION BY query_id) AS near, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS place FROM hits JOIN documents ON doc_id = item_id)
SELECT query_id, md5(string_agg('[' || lang || ']' || chr(10) || content, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY rank) FILTER (score >= 0.45 OR near = 0 AND place = 1)) AS context_md5, round(avg(score), 6) AS confidence, greatest(any_value(near), 1)::INT AS n_context,
  CASE WHEN query_id % 200 = 0 THEN '제1조' ELSE string_agg(source || ' - ' || lang, ';' ORDER BY rank) FILTER (place <= 2) END AS citations, 'faq' AS source FROM h GROUP BY query_id""",
    "section_results": f"""SELECT query_id, rank, coalesce(document_title, '') AS document_title, coalesce(section_title, '') AS section_title, '' AS category, coalesce(final_score, combined_score, score, 0)::DOUBLE AS score, 0.0::DOUBLE AS vector_score, combined_score FROM {SECTION_HITS_SQL}""",
    "section_response": f"""WITH h AS (SELECT query_id, rank, coalesce(document_title, '') AS d, coalesce(section_title, '') AS t, coalesce(section_content, '') AS c, coalesce(final_score, combined_score, score, 0)::DOUBLE AS s, words, 3 + (combined_score IS NOT NULL)::INT + (final_score IS NOT NULL)::INT + (rerank_score IS NOT NULL)::INT AS n FROM {SECTION_HITS_SQL})
SELECT query_id, string_agg('[' || d || ']' || chr(10) || CASE WHEN t <> '' THEN t || chr(10) ELSE '' END || c, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY rank) AS context, round(avg(s), 6) AS confidence, string_agg(least(length(c), 500)::VARCHAR, ',' ORDER BY rank) AS n_chars, string_agg(n::VARCHAR, ',' ORDER BY rank) AS n_scores,
  count(*)::INT AS n_items, CASE WHEN query_id = 2 THEN 'mid' END AS band, array_to_string(list_sort(list_distinct(flatten(list(words ORDER BY rank)))), ',') AS words, array_to_string(list_transform(flatten(list(words ORDER BY rank)), lambda w: w || '-t')[:5], ',') AS triplets FROM h GROUP BY query_id""",
    "faq_results": f"WITH {FAQ_SQL} SELECT conv_id AS query_id, turn AS rank, md5(question) AS question_md5, '' AS category, CASE WHEN turn % 4 = 0 THEN 'web' ELSE 'FAQ' END AS source, turn / 64 AS score FROM faq WHERE turn <= 10",
    "responses": f"""WITH b AS (SELECT id, coalesce(score, 0)::DOUBLE AS s FROM {fx.sql(fx.BAND_SCHEMA, fx.BANDS)}) SELECT id, 'q' AS query, '' AS answer, 'no_context' AS source, round(CASE WHEN s >= 0.4 THEN s ELSE 0 END, 3)::DOUBLE AS confidence,
  CASE WHEN s >= 0.55 THEN 'answer' WHEN s >= 0.4 THEN 'clarification' ELSE 'handoff' END AS response_mode, true AS verified, 1.0::DOUBLE AS verification_score FROM b""",
    "evaluated_cases": f"""WITH {FAQ_SQL}, e AS (SELECT conv_id, turn, question, CASE WHEN turn % 8 = 6 THEN '[Error: timeout]' ELSE answer END AS answer FROM faq), k AS (SELECT *, {SPLIT.format('question')} AS q, {SPLIT.format('answer')} AS a FROM e), g AS (SELECT *, {_grams_sql('q')}, {_grams_sql('a')} FROM k),
p AS (SELECT *, {_shares_sql('q', 'a', 'p')} FROM g), s AS (SELECT *, (length(answer) > 500)::INT AS n, NOT regexp_matches(answer, '{V.CITATION}') AS uncited FROM p)
SELECT conv_id, turn, {_bleu_sql('q', 'a', 'p')} AS bleu, 1 - CASE WHEN uncited THEN 0.3::DOUBLE ELSE 0 END - 0.15::DOUBLE * n AS faithfulness, n = 0 AND NOT uncited AS verified, n + uncited::INT AS n_issues, turn % 4 = 0 AS evaluated, CASE WHEN turn % 4 = 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS recall, CASE WHEN turn % 4 = 0 THEN 0.5 ELSE 0.0 END::DOUBLE AS precision, 0.0::DOUBLE AS judge, 0 AS output_tokens FROM s""",
    "eval_subset": f"WITH {CASES_SQL} SELECT case_id, category FROM cases WHERE question <> '' AND case_id % 7 > 0 AND category IN ('en', 'fr') ORDER BY case_id LIMIT 20",
    "golden_items": f"""WITH {FAQ_SQL}, c AS (SELECT *, CASE WHEN turn % 4 = 0 THEN answer ELSE 'Q: ' || question || chr(10) || 'A: ' || answer END AS context FROM faq WHERE turn % 8 <> 6)
SELECT DISTINCT substr(sha256(question || '_2026-02-01T00:00:00'), 1, 12) AS id, md5(trim(' ' || context || length('[참고 정보]' || chr(10) || CASE WHEN context <> '' THEN context ELSE '(없음)' END || chr(10) || chr(10) || '[질문]' || chr(10) || question || chr(10) || chr(10) || '[답변]' || chr(10)))) AS answer_md5,
  '' AS category, CASE WHEN turn % 8 = 2 THEN 'easy' ELSE 'medium' END AS difficulty, CASE WHEN turn % 4 = 0 THEN 'c' || conv_id ELSE '제1조' END AS sources FROM c""",
    "retrieval_union": f"""SELECT query_id, 0 AS kind, rank::INT AS rank, item_id FROM ({hits_sql("AND q.label = i.label", 3)} SELECT * FROM hits) UNION ALL SELECT query_id, 1, rank::INT, item_id FROM ({hits_sql(k=3)} SELECT * FROM hits)""",
    "golden_sets": """SELECT * FROM (VALUES ('해지', 5, 5, 'sections_1'), ('환불', 5, 5, 'sections_10'), ('면책', 5, 5, 'sections_11'), ('수수료', 5, 5, 'sections_16'), ('개인정보', 5, 5, 'sections_21'), ('손해배상', 5, 5, 'sections_26'), ('약관 변경', 5, 5, 'sections_31'),
  ('invented article', 5, 5, 'adversarial_1'), ('other company', 5, 5, 'adversarial_10'), ('forecast', 5, 5, 'adversarial_11'), ('override', 5, 5, 'adversarial_16'), ('mixed', 5, 5, 'adversarial_21'), ('vague', 5, 5, 'adversarial_26'), ('false premise', 5, 5, 'adversarial_31'), ('private', 5, 5, 'adversarial_36')) AS t(category, n, n_questions, first_id)""",
    "judge_per_criterion": "SELECT * FROM (VALUES (1, 4.0::DOUBLE, 2.5::DOUBLE, 3.25::DOUBLE), (2, 3.0, 3.0, 3.0), (3, 7.0, 3.0, 5.0)) AS t(id, correctness, fluency, overall)",
    "judge_columns": f"""SELECT * FROM (VALUES (1, 5.0::DOUBLE, 1.0::DOUBLE, 4.0::DOUBLE, 3.0::DOUBLE, 5.0::DOUBLE, 3.0::DOUBLE, '{_told("helpfulness", "fluency")}'), (2, 3.0, 0.5, 3.0, 3.0, 3.0, 3.0, 'Evaluation error: timeout')) AS t(id, judge, judge_normalised, judge_correctness, judge_helpfulness, judge_faithfulness, judge_fluency, judge_summary)""",
    "judge_parse": f"SELECT * FROM {fx.sql('id int, correctness double, helpfulness double, faithfulness double, fluency double, overall double, summary string', JUDGED_RIGHT)}",
    "token_usage": "SELECT * FROM (VALUES (1, 3, 4), (2, 2, 7), (3, 8, 0), (4, 0, 0), (5, 0, 0), (6, 1, 7), (7, 0, 1)) AS t(id, input_tokens, output_tokens)",
    "embed_forms": "SELECT doc_id, md5('passage: ' || coalesce(text, '')) AS passage_md5, md5('query: ' || coalesce(text, '')) AS query_md5 FROM documents",
    "citations": f"WITH {ANSWERS_SQL} SELECT id, array_to_string(refs, ';') AS cited, array_to_string(regexp_extract_all(answer, '\\[참조:\\s*([^\\]]+)\\]', 1), ';') AS own, valid FROM w",
    "verify_rules": f"""WITH {ANSWERS_SQL} SELECT id, valid, n_signs, round(confidence, 6) AS confidence, confidence >= 0.7 AND valid AND n_signs = 0 AS verified,
  {REASONING_SQL} AS reasoning FROM w""",
    "verify_documents": f"SELECT lang, count(*) AS n_docs, sum((length(text) > 500 AND NOT regexp_matches(text, '{V.CITATION}'))::INT)::BIGINT AS n_signs FROM documents GROUP BY lang",
    "json_lenient": f"""WITH r AS (SELECT id, coalesce(try_cast(reply AS JSON), try_cast(regexp_extract(reply, '```(?:json)?\\s*(\\{{[\\s\\S]*?\\}})\\s*```', 1) AS JSON), try_cast(regexp_extract(reply, '\\{{(?:[^{{}}]|\\{{[^{{}}]*\\}})*\\}}', 0) AS JSON)) AS v
  FROM {fx.sql(fx.REPLY_SCHEMA, fx.REPLIES)}) SELECT id, try_cast(v->>'$.confidence' AS DOUBLE) AS confidence, try_cast(v->>'$.verified' AS BOOLEAN) AS verified FROM r""",
    "event_properties": "SELECT event_type, count(*) AS n, count(json_keys(props)) AS n_objects, round(avg(coalesce(len(json_keys(props)), 0)), 6) AS mean_keys FROM events GROUP BY event_type",
    "bleu_morphs": f"""WITH {FAQ_SQL}, k AS (SELECT conv_id, turn, {MORPHS.format('question')} AS q, {MORPHS.format('answer')} AS a FROM faq), g AS (SELECT *, {_grams_sql('q')}, {_grams_sql('a')} FROM k),
p AS (SELECT *, {_shares_sql('q', 'a', 'p')} FROM g) SELECT conv_id, turn, len(a)::INTEGER AS n_tokens, {_bleu_sql('q', 'a', 'p')} AS bleu FROM p""",
    "bleu4": f"""WITH {FAQ_SQL}, k AS (SELECT conv_id, turn, {SPLIT.format('question')} AS q, {SPLIT.format('answer')} AS a FROM faq), g AS (SELECT *, {_grams_sql('q')}, {_grams_sql('a')} FROM k),
p AS (SELECT *, {_shares_sql('q', 'a', 'p')}, {_shares_sql('a', 'a', 's')} FROM g) SELECT conv_id, turn, {_bleu_sql('q', 'a', 'p')} AS bleu, {_bleu_sql('a', 'a', 's')} AS self_bleu FROM p""",
    "context_overlap": f"""WITH c AS (SELECT id, list_distinct(got) AS g, list_distinct(want) AS w FROM {fx.sql(fx.CASE_SCHEMA, fx.CASES)})
SELECT id, round(CASE WHEN len(w) = 0 THEN 1 WHEN len(g) = 0 THEN 0 ELSE len(list_intersect(g, w)) / len(w) END, 6)::DOUBLE AS recall, round(CASE WHEN len(w) = 0 THEN 1 WHEN len(g) = 0 THEN 0 ELSE len(list_intersect(g, w)) / len(g) END, 6)::DOUBLE AS precision FROM c""",
    "eval_global": f"WITH {CASES_SQL} SELECT {SUMMARY_SQL} FROM cases",
    "eval_by_category": f"""WITH {CASES_SQL} SELECT CASE WHEN coalesce(category, '') = '' THEN 'unknown' ELSE category END AS category, count(*) AS n, avg(similarity) AS mean_similarity, avg(bleu) AS mean_bleu, avg(faithfulness) AS mean_faithfulness, avg(judge) AS mean_judge FROM cases GROUP BY 1""",
    "model_category_report": f"WITH {CASES_SQL} SELECT model, CASE WHEN coalesce(category, '') = '' THEN 'unknown' ELSE category END AS category, {SUMMARY_SQL} FROM cases GROUP BY 1, 2",
    "csv_report_rows": f"WITH {CASES_SQL} SELECT case_id, substr(question, 1, 100) AS question, category, printf('%.4f', similarity) AS similarity, printf('%.4f', bleu) AS bleu, printf('%.4f', faithfulness) AS faithfulness, printf('%.1f', latency_ms) AS latency_ms FROM cases",
    "judge_normalise": f"SELECT id, CASE WHEN score <= 0 THEN 0.0 ELSE (score - 1) / 4 END::DOUBLE AS normalised FROM {fx.sql(fx.JUDGE_SCHEMA, fx.JUDGES)}",
    "model_diversity": f"""WITH m AS (SELECT id, generator, coalesce(p.judge, f.fallback, 'judge-default') AS judge FROM {fx.sql(fx.MODEL_SCHEMA, fx.MODELS)} m
  LEFT JOIN {fx.sql(fx.PAIR_SCHEMA, fx.PAIRS)} p ON replace(replace(lower(p.generator), '-', ''), '_', '') = replace(replace(lower(m.generator), '-', ''), '_', '') LEFT JOIN {fx.sql(fx.PROVIDER_SCHEMA, fx.PROVIDER_JUDGES)} f USING (provider))
SELECT id, judge, replace(replace(lower(judge), '-', ''), '_', '') <> replace(replace(lower(generator), '-', ''), '_', '') AS diverse FROM m""".replace("SELECT id, generator, coalesce(p", "SELECT id, m.generator, coalesce(p"),
    "latency_by_hour": "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(avg(value), 6) AS mean_value FROM events GROUP BY 1, 2",
    "order_totals": "SELECT n_name, year(o_orderdate)::INT AS year, count(*) AS n, round(sum(l_quantity), 2) AS quantity FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2",
}
