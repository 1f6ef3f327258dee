"""Queries of the question run and of its evaluation, over the driver's tables, with stand-ins for the models."""

from __future__ import annotations

from pyspark.sql import functions as F

from corvid.operators import hybrid, routing, verification
from corvid.plans import answer, eval_queries, search_queries
from corvid.plans import fixtures as fx
from corvid.plans.fixtures import table
from corvid.providers import Providers

#: Low enough for the driver's vectors to take every route.
BANDS = routing.Bands(0.9, 0.8, 0.5, 0.45, 0.4)
CONFIG = hybrid.Config(rerank_enabled=True, rerank_top_k=4)
SEPARATOR = "\n\n---\n\n"
VERDICTS = ['{"verified": true, "confidence": 0.9}', 'no {"other": 1} but {"verified": false, "confidence": 0.9, "issues": ["unsupported", "vague"], "reasoning": "왜냐"}', "```json\n{\"confidence\": 0.25}\n```", "none", None]
ENDINGS = ["", " [참조: 제1조(en)]", " [참조: 제99조]", " 아마도 [출처: 제2조(en)]"]


def _of(values: list[str | None], n):
    """The value at place n."""
    return F.element_at(F.array(*[F.lit(v).cast("string") for v in values]), n.cast("int") + 1)


def _of_sql(values: list[str | None], n: str) -> str:
    return "[" + ", ".join("NULL" if v is None else "'" + v.replace("'", "''") + "'" for v in values) + f"][1 + ({n})]"


def _generate(prompt, context):
    return F.concat(F.substring_index(context, SEPARATOR, 1), _of(ENDINGS, F.length(prompt) % len(ENDINGS)))


PROVIDERS = Providers(
    rerank=search_queries._length_rerank,
    generate=_generate,
    check=lambda prompt: _of(VERDICTS, F.length(prompt) % len(VERDICTS)),
    usage=lambda prompt, answer_: F.create_map(F.lit("prompt_tokens"), F.length(prompt), F.lit("completion_tokens"), F.length(answer_)),
)


def _tables(spark, d):
    """Queries (one a conversation, its vector between two rows of the table), pairs and sections that have a vector."""
    pairs = eval_queries._faq(spark, d)
    first = pairs.groupBy("conv_id").agg(F.min_by(F.struct("question", "answer"), "turn").alias("p")).select(F.col("conv_id").alias("id"), "p.question", "p.answer")
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    faq = first.join(v, "id").withColumn("category", F.concat(F.lit("c"), (F.col("id") % 3).cast("string")))
    beside = v.select((F.col("id") - 7).alias("id"), F.col("vector").alias("other"))
    mixed = F.zip_with("vector", "other", lambda a, b: a.cast("double") + (F.col("id") % 10) / 4 * b.cast("double"))
    asked = first.join(v, "id").join(beside, "id").select("id", F.col("question").alias("query"), mixed.alias("vector"), F.col("answer").alias("expected_answer"))
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("document_title"), F.concat(F.lit("제"), (F.col("doc_id") % 9 + 1).cast("string"), F.lit("조("), "lang", F.lit(")")).alias("section_title"), F.coalesce("text", F.lit("")).alias("section_content"))
    return asked, faq, docs.join(v, "id")


def _answers(spark, d, asked, faq, sections):
    return answer.answers(asked.select("id", "query", "vector"), faq, sections, BANDS, PROVIDERS, stored=search_queries._document_triplets(spark, d), config=CONFIG, words=search_queries.WEIGHTS)


def answer_run(spark, d):
    """Every conversation's first question, from search to verified answer."""
    x = _answers(spark, d, *_tables(spark, d))
    m = F.col("metadata")
    listed = lambda c: F.array_join(c, "; ")
    return x.select(
        "id", F.md5(F.col("answer").cast("binary")).alias("answer_md5"), "source", F.round("confidence", 6).alias("confidence"), "response_mode", F.size("context").alias("n_context"), listed("citations").alias("citations"), "verified",
        F.round("verification_score", 6).alias("verification_score"), listed("verification_issues").alias("issues"), m["route"].alias("route"), m["confidence_band"].alias("band"), F.size(F.map_keys(m["thresholds"])).alias("n_thresholds"), m["category"].alias("category"),
        m["hybrid_search"].alias("hybrid_search"), listed(m["matched_keywords"]).alias("words"), listed(m["matched_triplets"]).alias("triplets"), m["usage"]["prompt_tokens"].alias("prompt_tokens"), m["verification_reasoning"].alias("reasoning"),
    )


def _letters(text):
    """A stand-in for an embedding: how often some letters occur."""
    return F.array(*[F.length(text) - F.length(F.replace(text, F.lit(c), F.lit(""))) + F.lit(0.5) for c in LETTERS])


LETTERS = "aeinst"


def evaluate_run(spark, d):
    """The measures of every conversation's first question, answered by the run; some fail, and some name their sources."""
    asked, faq, sections = _tables(spark, d)
    number = F.col("id").cast("string")
    wanted = F.when(F.col("id") % 3 == 0, F.array(number)).when(F.col("id") % 3 == 1, F.array(F.lit("제1조(en)"), F.lit("제2조(en)")))
    rows = asked.select("id", F.col("query").alias("question"), "expected_answer", F.lit("c").alias("category"), wanted.alias("expected_sources"), "vector")

    def pipeline(x):
        return _answers(spark, d, x, faq, sections).withColumn("error", F.when(F.col("id") % 11 == 5, "timeout"))

    x = answer.evaluated_answers(rows, pipeline, _letters)
    return x.select("id", "source", F.round("bleu", 6).alias("bleu"), F.round("similarity", 6).alias("similarity"), F.round("faithfulness", 6).alias("faithfulness"), "verified", F.size("issues").alias("n_issues"), "evaluated", F.round("recall", 6).alias("recall"), F.round("precision", 6).alias("precision"), "input_tokens", "output_tokens")


def model_verdicts(spark, d):
    """Rules and a model's reply together, and the rules alone, on all pairs with citations and doubts added."""
    x = eval_queries._faq(spark, d).withColumn("said", F.concat("answer", _of(ENDINGS, F.col("conv_id") % len(ENDINGS)))).withColumn("reply", _of(VERDICTS, (F.col("conv_id") + F.col("turn")) % len(VERDICTS)))
    titles = F.array(F.lit("제1조(en)"), F.lit("제2조(en)"))
    v = verification.verify(F.col("said"), titles, F.col("reply"))
    return x.withColumn("v", v).select("conv_id", "turn", F.col("v.verified").alias("verified"), F.round("v.confidence", 6).alias("confidence"), F.array_join("v.issues", "; ").alias("issues"), F.col("v.reasoning").alias("reasoning"), verification.quick_verdict(F.col("said"), titles).alias("quick"))


QUERIES = {f.__name__: f for f in (answer_run, evaluate_run, model_verdicts)}

V = verification
NL = "chr(10)"


def rules_sql(source: str, answer_: str, titles: str, name: str = "w") -> str:
    """``source`` with refs, valid, signs and own (the confidence by the rules) of the column ``answer_`` and the list ``titles``."""
    hedges = ", ".join(f"CASE WHEN contains({answer_}, '{h}') THEN '{V.HEDGE_SIGN.format(h).replace(chr(39), chr(39) * 2)}' END" for h in V.HEDGES)
    return f"""{name}a AS (SELECT *, list_transform(list_zip(regexp_extract_all({answer_}, '{V.CITATION}', 1), regexp_extract_all({answer_}, '{V.CITATION}', 2)), lambda m: trim(CASE WHEN m[1] <> '' THEN m[1] ELSE m[2] END)) AS refs,
  list_distinct({titles} || list_filter(list_transform({titles}, lambda t: regexp_extract(t, '{V.ARTICLE}', 0)), lambda t: t <> '')) AS known,
  list_filter([{hedges}, CASE WHEN length({answer_}) > 500 AND NOT regexp_matches({answer_}, '{V.CITATION}') THEN '{V.LONG_SIGN}' END], lambda s: s IS NOT NULL) AS signs FROM {source}),
{name}v AS (SELECT *, len(refs) > 0 AND len(list_filter(refs, lambda r: NOT (len(list_filter(known, lambda k: contains(k, r) OR contains(r, k))) > 0 OR regexp_extract(r, '{V.ARTICLE}', 0) = ''
  OR contains(array_to_string(known, {NL}), regexp_extract(r, '{V.ARTICLE}', 0))))) = 0 AS valid FROM {name}a),
{name} AS (SELECT *, 1.0::DOUBLE - CASE WHEN valid THEN 0 ELSE 0.3 END - len(signs) * 0.15::DOUBLE AS own FROM {name}v)"""


#: What the stand-in replies say: whether they can be read, pass, their confidence, issues and reasons, by place.
SAID_SQL = {"ok": "[true, false, true, NULL, NULL]", "passed": "[true, false, false, NULL, NULL]", "c": "[0.9, 0.9, 0.25, NULL, NULL]", "more": "[[], ['unsupported', 'vague'], [], [], []]", "why": "['', '왜냐', '', '', '']"}


def verdict_sql(source: str, place: str, name: str) -> str:
    """``source`` of :func:`rules_sql` with issues, confidence, verified and reasoning by the reply at ``place``."""
    said = {k: f"{v}[1 + ({place})]" for k, v in SAID_SQL.items()}
    return f"""{name}i AS (SELECT *, CASE WHEN valid THEN [] ELSE ['{V.UNCITED}'] END || signs || CASE WHEN {said["ok"]} IS NULL THEN [] ELSE {said["more"]} END AS issues,
  greatest(0, least(1, CASE WHEN {said["ok"]} IS NULL THEN own ELSE (own + {said["c"]}::DOUBLE) / 2 END))::DOUBLE AS sure,
  CASE WHEN valid THEN '✓ 출처 인용이 유효합니다' ELSE '✗ 출처 인용에 문제가 있습니다' END || ' | ' || CASE WHEN len(signs) = 0 THEN '✓ 불확실한 표현이 감지되지 않았습니다' ELSE '✗ ' || len(signs) || '개의 주의 표현이 감지되었습니다' END
    || CASE WHEN {said["passed"]} THEN ' | ✓ LLM 검증 통과' WHEN NOT {said["passed"]} THEN ' | ✗ LLM 검증 실패: ' || {said["why"]} ELSE '' END AS reasoning FROM {source}),
{name} AS (SELECT *, sure >= 0.7 AND len(issues) = 0 AS passed FROM {name}i)"""


def case_sql(names: dict[str, str], default: str = "''") -> str:
    return "CASE route " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in names.items()) + f" ELSE {default} END"


WORDS_SQL = search_queries.WEIGHTS_SQL
COMMON_SQL = f"""{eval_queries.FAQ_SQL}, first AS (SELECT conv_id AS id, arg_min(question, turn) AS question, arg_min(answer, turn) AS answer FROM faq GROUP BY conv_id),
v AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings),
asked AS (SELECT f.id, f.question AS query, f.answer AS expected_answer, list_transform(list_zip(a.v, b.v), lambda x: x[1] + (f.id % 10) / 4::DOUBLE * x[2]) AS q FROM first f JOIN v a ON a.id = f.id JOIN v b ON b.id = f.id + 7),
fh AS (SELECT a.id, f.id AS item, f.question, f.answer, list_cosine_similarity(a.q, v.v) AS s, row_number() OVER (PARTITION BY a.id ORDER BY list_cosine_similarity(a.q, v.v) DESC, f.id) AS rank FROM asked a, first f JOIN v ON v.id = f.id QUALIFY rank <= 5),
one AS (SELECT id, query, expected_answer, q, coalesce(max(s), 0) AS top FROM asked LEFT JOIN fh USING (id) GROUP BY ALL),
r1 AS (SELECT *, CASE WHEN top >= {BANDS.faq} THEN 'faq_ok' WHEN top >= {BANDS.faq_mid} THEN 'faq_mid' ELSE 'sections' END AS route FROM one),
sec AS (SELECT d.doc_id AS item, source AS document, '제' || (d.doc_id % 9 + 1) || '조(' || lang || ')' AS title, coalesce(text, '') AS content, v.v FROM documents d JOIN v ON v.id = d.doc_id),
near AS (SELECT a.id, a.query, s.item, document, title, content, list_cosine_similarity(a.q, s.v) AS vec FROM r1 a, sec s WHERE a.route = 'sections' QUALIFY row_number() OVER (PARTITION BY a.id ORDER BY vec DESC, s.item) <= 20),
kw AS (SELECT id, item, least(1.0, sum(weight) / count(*)) * 0.5::DOUBLE AS rule, list(word) AS words FROM near JOIN {WORDS_SQL} ON contains(lower(title || {NL} || content), word) AND contains(lower(query), word) GROUP BY ALL),
{search_queries.TRIPLETS_SQL},
tm AS (SELECT id, item, triplet_id, concat_ws('-', subject, predicate, object) AS triplet, {", ".join(f"CASE WHEN contains(lower({f}), lower(query)) OR contains(lower(query), lower({f})) THEN length(query) / greatest(length({f}), length(query)) END AS {f[0]}" for f in ("subject", "predicate", "object"))} FROM near JOIN t ON chunk_id = item WHERE query <> ''),
ts AS (SELECT id, item, sum(coalesce(s, p, o)) AS total, list(triplet ORDER BY triplet_id) AS triplets FROM tm WHERE coalesce(s, p, o) IS NOT NULL GROUP BY ALL),
tt AS (SELECT *, total / max(total) OVER (PARTITION BY id) AS share FROM ts),
comb AS (SELECT n.*, words, triplets, 0.5::DOUBLE * vec + 0.3::DOUBLE * coalesce(rule, 0)::DOUBLE + 0.2::DOUBLE * coalesce(share, 0)::DOUBLE AS combined FROM near n LEFT JOIN kw USING (id, item) LEFT JOIN tt USING (id, item)),
rr AS (SELECT *, (length(title || {NL} || content) * 7 % 13) / 13.0::DOUBLE AS rerank, row_number() OVER (PARTITION BY id ORDER BY rerank DESC, combined DESC, item) AS place FROM comb),
lo AS (SELECT *, min(rerank) OVER (PARTITION BY id, place <= 4) AS low, max(rerank) OVER (PARTITION BY id, place <= 4) AS high FROM rr),
fin AS (SELECT *, CASE WHEN place <= 4 THEN 0.7::DOUBLE * combined + 0.3::DOUBLE * CASE WHEN high = low THEN 0.5 ELSE (rerank - low) / (high - low) END ELSE combined END AS score FROM lo),
sh AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY place > 4, score DESC, item) AS rank FROM fin QUALIFY rank <= 5),
two AS (SELECT a.id, coalesce(arg_min(score, rank), 0) AS top, avg(score) AS mean, count(item) AS n, string_agg('[' || document || ']' || {NL} || CASE WHEN title <> '' THEN title || {NL} ELSE '' END || content, '{SEPARATOR}' ORDER BY rank) AS text, list(title ORDER BY rank) FILTER (title IS NOT NULL) AS titles,
  list_sort(list_distinct(flatten(list(words) FILTER (words IS NOT NULL)))) AS words, flatten(list(triplets ORDER BY rank) FILTER (triplets IS NOT NULL))[:5] AS triplets, list(document || ' - ' || title ORDER BY rank)[:2] AS named,
  string_agg('[' || title || ']' || {NL} || substr(content, 1, 500), {NL} || {NL} ORDER BY rank) AS shown FROM r1 a LEFT JOIN sh USING (id) WHERE a.route = 'sections' GROUP BY a.id),
routed AS (
  SELECT id, query, expected_answer, route, top, NULL AS mean FROM r1 WHERE route <> 'sections' UNION ALL
  SELECT id, query, expected_answer, CASE WHEN two.top >= {BANDS.section} THEN 'section_ok' WHEN two.top >= {BANDS.section_mid} THEN 'section_mid' WHEN two.top >= {BANDS.section_low} THEN 'section_low' ELSE 'none' END, two.top, mean FROM r1 JOIN two USING (id)),
fk AS (SELECT h.*, r.route FROM fh h JOIN routed r USING (id) WHERE r.route LIKE 'faq%' QUALIFY s >= 0.9 * CASE route WHEN 'faq_ok' THEN {BANDS.faq} ELSE {BANDS.faq_mid} END OR (rank = 1 AND max(s) OVER (PARTITION BY id) < 0.9 * CASE route WHEN 'faq_ok' THEN {BANDS.faq} ELSE {BANDS.faq_mid} END)),
fc AS (SELECT id, string_agg('Q: ' || question || {NL} || 'A: ' || answer, {NL} || {NL} ORDER BY rank) AS text, count(*) AS n, arg_min(question, rank) AS best, arg_min(item, rank) AS best_id, list(item::VARCHAR ORDER BY rank) AS ids FROM fk GROUP BY id),
ctx AS (SELECT r.*, fc.best, fc.best_id, fc.ids, CASE WHEN r.route LIKE 'faq%' THEN fc.text WHEN r.route IN ('section_ok', 'section_mid') THEN two.text WHEN r.route = 'section_low' THEN '{answer.TOO_LITTLE}' ELSE '{answer.NOTHING}' END AS text,
  CASE WHEN r.route LIKE 'faq%' THEN fc.n WHEN r.route IN ('section_ok', 'section_mid') THEN two.n ELSE 0 END::INTEGER AS n_context, CASE WHEN r.route IN ('section_ok', 'section_mid') THEN two.titles ELSE [] END AS titles, two.words, two.triplets, two.named, two.shown FROM routed r LEFT JOIN fc USING (id) LEFT JOIN two USING (id)),
prompted AS (SELECT *, {case_sql(answer.SYSTEM)} || {NL} || {NL} || text || {NL} || {NL} || query AS prompt FROM ctx),
said AS (SELECT *, split_part(text, '{SEPARATOR}', 1) || {_of_sql(ENDINGS, f"length(prompt) % {len(ENDINGS)}")} AS answer FROM prompted),
{rules_sql("said", "answer", "titles")},
pl AS (SELECT *, length('Sources:' || {NL} || coalesce(shown, '') || {NL} || {NL} || 'Question: ' || query || {NL} || 'Answer: ' || answer || {NL} || {NL} || 'Does every statement of the answer follow from the sources? Reply as {{"verified": true or false, "confidence": 0 to 1, "issues": ["..."], "reasoning": "..."}}.') % {len(VERDICTS)} AS place FROM w),
{verdict_sql("pl", "place", "done")},
told AS (SELECT *, route IN ('section_ok', 'section_mid') AS sec FROM done)"""
ORACLE_SQL = {
    "answer_run": f"""WITH {COMMON_SQL}
SELECT id, md5(answer) AS answer_md5, CASE WHEN route LIKE 'faq%' THEN 'faq' WHEN sec THEN 'sections' ELSE 'no_context' END AS source, round(CASE WHEN sec THEN mean WHEN route = 'none' THEN 0 ELSE top END, 6)::DOUBLE AS confidence,
  CASE WHEN route IN ('faq_ok', 'section_ok') THEN 'answer' WHEN route IN ('faq_mid', 'section_mid') THEN 'limited_answer' WHEN route = 'section_low' THEN 'clarification' ELSE 'handoff' END AS response_mode, n_context,
  CASE WHEN route LIKE 'faq%' THEN 'FAQ: ' || best WHEN sec THEN CASE WHEN contains(answer, '[참조:') THEN array_to_string(regexp_extract_all(answer, '\\[참조:\\s*([^\\]]+)\\]', 1), '; ') ELSE array_to_string(named, '; ') END ELSE '' END AS citations,
  CASE WHEN sec THEN passed ELSE true END AS verified, CASE WHEN sec THEN round(sure, 6) ELSE 1 END::DOUBLE AS verification_score, CASE WHEN sec THEN array_to_string(issues, '; ') ELSE '' END AS issues, route,
  CASE WHEN route IN ('faq_mid', 'section_mid') THEN 'mid' WHEN route = 'section_low' THEN 'low' END AS band, CASE route WHEN 'faq_mid' THEN 2 WHEN 'section_mid' THEN 2 WHEN 'section_low' THEN 3 END AS n_thresholds, CASE WHEN route LIKE 'faq%' THEN 'c' || best_id % 3 END AS category,
  CASE WHEN sec THEN true END AS hybrid_search, CASE WHEN sec THEN array_to_string(coalesce(words, []), '; ') END AS words, CASE WHEN sec THEN array_to_string(coalesce(triplets, []), '; ') END AS triplets, length(prompt)::INTEGER AS prompt_tokens, CASE WHEN sec THEN reasoning END AS reasoning FROM told""",
    "evaluate_run": f"""WITH {COMMON_SQL}, g AS (SELECT id, route, sec, n_context, titles, expected_answer, CASE WHEN id % 11 = 5 THEN '[Error: timeout]' ELSE answer END AS said, length(prompt)::INTEGER AS input_tokens, length(answer)::INTEGER AS output_tokens,
  CASE WHEN sec THEN titles ELSE ids END AS got, CASE id % 3 WHEN 0 THEN [id::VARCHAR] WHEN 1 THEN ['제1조(en)', '제2조(en)'] END AS want FROM told),
{rules_sql("g", "said", "titles", "e")},
k AS (SELECT *, {eval_queries.SPLIT.format('expected_answer')} AS x, {eval_queries.SPLIT.format('said')} AS a FROM e), gr AS (SELECT *, {eval_queries._grams_sql('x')}, {eval_queries._grams_sql('a')} FROM k), p AS (SELECT *, {eval_queries._shares_sql('x', 'a', 'p')} FROM gr),
m AS (SELECT *, {eval_queries._bleu_sql('x', 'a', 'p')} AS bleu, [{", ".join(f"length(expected_answer) - length(replace(expected_answer, '{c}', '')) + 0.5::DOUBLE" for c in LETTERS)}] AS ev, [{", ".join(f"length(said) - length(replace(said, '{c}', '')) + 0.5::DOUBLE" for c in LETTERS)}] AS sv,
  list_distinct(coalesce(got, [])) AS g2, len(list_intersect(list_distinct(coalesce(got, [])), coalesce(want, []))) AS both_, greatest(0, least(1, own)) AS sure, CASE WHEN valid THEN 0 ELSE 1 END + len(signs) AS n FROM p)
SELECT id, CASE WHEN route LIKE 'faq%' THEN 'faq' WHEN sec THEN 'sections' ELSE 'no_context' END AS source, bleu, round(list_cosine_similarity(ev, sv), 6) AS similarity, round(sure, 6)::DOUBLE AS faithfulness, sure >= 0.7 AND n = 0 AS verified, n::INTEGER AS n_issues, want IS NOT NULL AS evaluated,
  CASE WHEN want IS NULL OR len(g2) = 0 THEN 0 ELSE round(both_ / len(want), 6) END::DOUBLE AS recall, CASE WHEN want IS NULL OR len(g2) = 0 THEN 0 ELSE round(both_ / len(g2), 6) END::DOUBLE AS precision, input_tokens, output_tokens FROM m""",
    "model_verdicts": f"""WITH {eval_queries.FAQ_SQL}, x AS (SELECT conv_id, turn, answer || {_of_sql(ENDINGS, f"conv_id % {len(ENDINGS)}")} AS said, ['제1조(en)', '제2조(en)'] AS titles FROM faq),
{rules_sql("x", "said", "titles")}, {verdict_sql("w", f"(conv_id + turn) % {len(VERDICTS)}", "done")}
SELECT conv_id, turn, passed AS verified, round(sure, 6) AS confidence, array_to_string(issues, '; ') AS issues, reasoning, valid AND len(signs) = 0 AS quick FROM done""",
}
