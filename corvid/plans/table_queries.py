"""Rules for references, relations, parents, judging and paging, on texts made of the driver's rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from corvid.operators import ingest, judging, pages, results, rules, tree, triplets
from corvid.plans import eval_queries
from corvid.plans.fixtures import table

NL = "chr(10)"
SUFFIX = ["", " 2항", "(목적)", "（정의） 3항 4호", " 12 항"]
TITLE_FORMS = ["(목적)", " (정의)", "（해지）", " 목적", "(목적과 정의)"]


def _nth(values: list[str], n):
    return F.element_at(F.array(*map(F.lit, values)), n.cast("int") + 1)


def _nth_sql(values: list[str], n: str) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + f"][1 + ({n})]"


def _asked(spark, d):
    """A question about an article for each user's turn; some name none."""
    x = eval_queries._faq(spark, d)
    ref = F.concat(F.lit("제 "), (F.col("conv_id") % 17 + 1).cast("string"), F.lit(" 조"), _nth(SUFFIX, F.col("turn") % 5))
    return x.select("conv_id", "turn", F.concat(F.col("question"), F.when(F.col("conv_id") % 4 < 3, F.concat(F.lit(" "), ref)).otherwise(" 1 조 2 항"), F.lit(" 환불은?")).alias("query"))


def section_references(spark, d):
    """What each question refers to, strictly and loosely, and how many documents' titles match it."""
    x = _asked(spark, d).withColumn("ref", rules.section_reference(F.col("query")))
    titles = table(spark, d, "documents").select(F.concat(F.lit("제"), (F.col("doc_id") % 17 + 1).cast("string"), F.lit("조"), _nth(TITLE_FORMS, F.col("doc_id") % 5)).alias("title"))
    titles = titles.groupBy("title").agg(F.count("*").alias("n")).withColumn("number", F.regexp_extract("title", r"제(\d+)조", 1).cast("int"))
    # The article's number joins; the rule itself decides.
    met = x.select("conv_id", "turn", "ref", F.col("ref.article").alias("number")).join(titles, "number").filter(rules.section_match(F.col("ref"), F.col("title"))).groupBy("conv_id", "turn").agg(F.sum("n").alias("n_titles"))
    shown = x.join(met, ["conv_id", "turn"], "left")
    return shown.select("conv_id", "turn", F.col("ref.article").alias("article"), F.col("ref.title").alias("title"), F.col("ref.clause").alias("clause"), F.col("ref.subclause").alias("subclause"), rules.reference_text(F.col("ref")).alias("text"), rules.loose_reference(F.col("query")).alias("loose"), F.coalesce("n_titles", F.lit(0)).alias("n_titles"))


SUBJECTS, VERBS = ["회사", "고객", "이용자"], ["할 수 있", "하여야 하", "거부할 수 있", "제한할 수 있"]


def clause_relations(spark, d):
    """Relations of clauses about each document's source and language, told in five forms, as the store keeps them."""
    n, word = F.col("doc_id"), F.concat(F.col("source"), F.lit(" "), F.col("lang"))
    who = _nth(SUBJECTS, n % 3)
    forms = [
        F.concat(who, F.lit("는 "), word, F.lit(" 자료를 "), _nth(VERBS, n % 4), F.lit("다.")),
        F.concat(F.lit('"'), word, F.lit('"라 함은 자료 번호 '), (n % 50).cast("string"), F.lit("를 말한다")),
        F.concat(who, F.lit("는 자료 공개를 하여서는 아니 된다.")),
        F.concat(F.lit("회사는 통신  장애에 대하여 책임을 지지 아니합니다. "), word),
        F.concat(word, F.lit(" 아무 관계도 없다")),
    ]
    text = forms[-1]
    for k in range(3, -1, -1):
        text = F.when(n % 5 == k, forms[k]).otherwise(text)
    docs = table(spark, d, "documents").select("doc_id", F.coalesce("source", F.lit("")).alias("source"), F.coalesce("lang", F.lit("")).alias("lang")).withColumn("text", text)
    return triplets.store(triplets.extract_all(docs, "doc_id", F.col("text"))).select("triplet_id", "subject", "predicate", "object", "chunk_id")


def chunk_parents(spark, d):
    """Documents as two articles and a whole: the second one's parent is the first, a whole has none."""
    text = F.coalesce("text", F.lit(""))
    body = F.when(F.col("doc_id") % 3 == 0, text).otherwise(F.concat(F.lit("제1조(목적)\n"), F.regexp_replace(text, "\n", " "), F.lit("\n제2조(정의)\n이 항목은 정의를 정한다.")))
    docs = table(spark, d, "documents").select("doc_id", F.concat(F.lit("제9조(문서"), F.col("doc_id").cast("string"), F.lit(")")).alias("name"), body.alias("body"))
    x = ingest.chunks(docs, "name", "body")
    return x.select("doc_id", "section_title", F.length("section_content").alias("n_content"), F.md5(F.col("parent_content").cast("binary")).alias("parent_md5"))


def section_lookup(spark, d):
    """For each language and article asked for: the document of least id with that article in its title, else the first one with a note."""
    docs = table(spark, d, "documents").select("doc_id", F.coalesce("lang", F.lit("")).alias("lang"), F.col("source").alias("document_title"), F.concat(F.lit("제"), (F.col("doc_id") % 90 + 1).cast("string"), F.lit("조(가)")).alias("section_title"))
    asked = table(spark, d, "events").select((F.col("event_id") % 120 + 1).alias("n")).distinct()
    # Of a title only the first document counts, and the first of all for those that ask in vain.
    first = docs.groupBy("lang", "section_title").agg(F.min(F.struct("doc_id", "document_title")).alias("f"))
    requests = docs.select("lang").distinct().join(F.broadcast(asked.groupBy().agg(F.collect_set("n").alias("ns"))), F.lit(True)).select("lang", F.explode("ns").alias("n"))
    section = F.concat(F.lit("제"), F.col("n").cast("string"), F.lit("조"))
    own = requests.withColumn("section", section).withColumn("section_title", F.concat("section", F.lit("(가)"))).join(first, ["lang", "section_title"])
    any_ = requests.withColumn("section", section).join(first.groupBy("lang").agg(F.min(F.struct("f", "section_title")).alias("b")), "lang")
    hits = own.select("lang", "section", F.col("f.doc_id").alias("rank"), F.col("f.document_title").alias("document_title"), "section_title").union(any_.select("lang", "section", "b.f.doc_id", "b.f.document_title", "b.section_title"))
    hits = hits.withColumn("request", F.concat_ws("/", "lang", "section")).dropDuplicates(["request", "rank"])
    return results.section_or_best(hits)


REPLIES = [
    '{{"correctness": {{"score": {a}}}, "helpfulness": {{"score": "{b}"}}, "faithfulness": {{"score": 7}}, "fluency": {{"reason": "x"}}, "overall_score": {a}, "summary": "s{b}"}}',
    "```json\n{{\"correctness\": {{\"score\": {b}}}, \"fluency\": {{\"score\": 0}}}}\n```",
    'broken {{"correctness": {{"note": 1, "score": {a}, "helpfulness: {{"score": {b}}} overall_score: {a}',
    "no scores",
]


def judged_cases(spark, d):
    """Judges' replies to all pairs, whole, fenced, broken and empty, as the columns of a case; a few judges fail.

    In a broken reply the first name takes the last score of its open brace.
    """
    x = eval_queries._faq(spark, d)
    a, b = (F.col("conv_id") % 6).cast("string"), (F.col("turn") % 5 + 1).cast("string")
    fill = lambda form: F.replace(F.replace(F.lit(form.replace("{{", "{").replace("}}", "}")), F.lit("{a}"), a), F.lit("{b}"), b)
    kind = (F.col("conv_id") + F.col("turn")) % 4
    reply = fill(REPLIES[3])
    for k in range(2, -1, -1):
        reply = F.when(kind == k, fill(REPLIES[k])).otherwise(reply)
    error = F.when(F.col("conv_id") % 9 == 8, F.lit("timeout"))
    x = x.withColumn("s", judging.judged_or_neutral(judging.judge_scores(reply), error)).select("conv_id", "turn", "s")
    columns = judging.judge_columns(F.col("s"))
    return x.select("conv_id", "turn", *[F.round(c, 6).alias(n) if n != "judge_summary" else c.alias(n) for n, c in columns.items()])


def judge_choice(spark, d):
    """Judges of models named after the documents' sources, by pair, provider (their language) and default."""
    made = table(spark, d, "documents").select(F.initcap(F.coalesce("source", F.lit(""))).alias("generator"), F.coalesce("lang", F.lit("")).alias("provider")).distinct()
    own = table(spark, d, "documents").select(F.concat(F.lit("SRC-"), (F.col("doc_id") % 12).cast("string")).alias("generator"), F.concat(F.lit("src_"), (F.col("doc_id") % 12 * F.col("doc_id") % 12 % 7).cast("string")).alias("judge")).groupBy("generator").agg(F.min("judge").alias("judge"))
    fall = table(spark, d, "documents").groupBy(F.coalesce("lang", F.lit("")).alias("provider")).agg(F.min(F.coalesce("source", F.lit(""))).alias("fallback")).filter("provider <> 'es'")
    return judging.judges_of(made, own, fall)


CODES = {"0": "zero", "1": "one"}


def page_numbers(spark, d):
    """Each conversation's list page with paging links by text, target and handler: the last page, and the code's name."""
    x = table(spark, d, "conversations").groupBy("conv_id").agg(F.count("*").alias("n"), F.max("turn").alias("t"))
    html = F.concat(F.lit("<a>999</a><div class=pager>"), F.lit("<a href=\"javascript:goPage("), F.col("t").cast("string"), F.lit(")\">next<a> "), F.col("n").cast("string"), F.lit(" </a><a onclick=\"goPage('"), (F.col("conv_id") % 13).cast("string"), F.lit("')\">x</a></div>"))
    code = (F.col("conv_id") % 3).cast("string")
    return tree.extract(x.select("conv_id", pages.named(code, CODES).alias("category"), html.alias("html")), "html", "pages long", lambda root: [(tree.last_page(root),)])


QUERIES = {f.__name__: f for f in (section_references, clause_relations, chunk_parents, section_lookup, judged_cases, judge_choice, page_numbers)}

R = rules.REFERENCE
WARN = lambda *names: " || ".join(f"CASE WHEN {n} IS NULL THEN '; Missing {n}, using default 3.0' ELSE '' END" for n in names)
CRITERIA = judging.CRITERIA
ORACLE_SQL = {
    "section_references": f"""WITH {eval_queries.FAQ_SQL}, q AS (SELECT conv_id, turn, question || CASE WHEN conv_id % 4 < 3 THEN ' 제 ' || (conv_id % 17 + 1) || ' 조' || {_nth_sql(SUFFIX, "turn % 5")} ELSE ' 1 조 2 항' END || ' 환불은?' AS query FROM faq),
r AS (SELECT conv_id, turn, query, try_cast(regexp_extract(query, '{R}', 1) AS INT) AS article, nullif(regexp_extract(query, '{R}', 2), '') AS title, try_cast(regexp_extract(query, '{R}', 3) AS INT) AS clause, try_cast(regexp_extract(query, '{R}', 4) AS INT) AS subclause FROM q),
t AS (SELECT '제' || (doc_id % 17 + 1) || '조' || {_nth_sql(TITLE_FORMS, "doc_id % 5")} AS t FROM documents), tn AS (SELECT t, try_cast(regexp_extract(t, '{ingest.HEADER}', 1) AS INT) AS n, count(*) AS c FROM t GROUP BY ALL)
SELECT conv_id, turn, article, title, clause, subclause, '제' || article || '조' || coalesce('(' || title || ')', '') || coalesce(' ' || clause || '항', '') || coalesce(' ' || subclause || '호', '') AS text,
  CASE WHEN regexp_matches(query, '{rules.LOOSE}') THEN '제' || regexp_extract(query, '{rules.LOOSE}', 1) || '조' || coalesce(' 제' || nullif(regexp_extract(query, '{rules.LOOSE}', 2), '') || '항', '') END AS loose,
  coalesce((SELECT sum(c) FROM tn WHERE n = article AND (title IS NULL OR contains(tn.t, title))), 0)::BIGINT AS n_titles FROM r""",
    "clause_relations": f"""WITH x AS (SELECT doc_id AS n, coalesce(source, '') || ' ' || coalesce(lang, '') AS word, {_nth_sql(SUBJECTS, "doc_id % 3")} AS who FROM documents),
t AS (SELECT n, who AS subject, {_nth_sql(["가능", "의무", "거부_가능", "제한_가능"], "n % 4")} AS predicate, word || ' 자료' AS object FROM x WHERE n % 5 = 0
  UNION ALL SELECT n, word, '정의', '자료 번호 ' || n % 50 FROM x WHERE n % 5 = 1 UNION ALL SELECT n, who, '금지', '자료 공개' FROM x WHERE n % 5 = 2 UNION ALL SELECT n, '회사', '면책', '통신  장애' FROM x WHERE n % 5 = 3),
c AS (SELECT n, {", ".join(f"trim(regexp_replace(regexp_replace(trim({f}), '\\s+', ' ', 'g'), '[{triplets.PARTICLES}]$', '')) AS {f}" for f in ("subject", "predicate", "object"))} FROM t)
SELECT substr(md5(concat_ws(':', subject, predicate, object)), 1, 12) AS triplet_id, subject, predicate, object, min(n) AS chunk_id FROM c GROUP BY subject, predicate, object""",
    "chunk_parents": """WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), f AS (SELECT doc_id, '제1조(목적)' || chr(10) || replace(t, chr(10), ' ') || chr(10) || '제2조(정의)' || chr(10) || '이 항목은 정의를 정한다.' AS body, trim(replace(t, chr(10), ' '), ' ' || chr(9) || chr(13)) AS c FROM d WHERE doc_id % 3 > 0)
SELECT doc_id, '제9조(문서' || doc_id || ')' AS section_title, least(length(t), 2000)::INTEGER AS n_content, md5('') AS parent_md5 FROM d WHERE doc_id % 3 = 0 AND t <> ''
UNION ALL SELECT doc_id, '제1조(목적)', least(length(c), 2000)::INTEGER, md5('') FROM f WHERE length('제1조(목적)' || c) >= 9
UNION ALL SELECT doc_id, '제2조(정의)', length('이 항목은 정의를 정한다.')::INTEGER, md5(substr(body, 1, 500)) FROM f""",
    "section_lookup": """WITH d AS (SELECT doc_id, coalesce(lang, '') AS lang, source, '제' || (doc_id % 90 + 1) || '조(가)' AS title FROM documents), a AS (SELECT DISTINCT event_id % 120 + 1 AS n FROM events), l AS (SELECT DISTINCT lang FROM d)
SELECT lang || '/제' || n || '조' AS request, document_title, section_title, note FROM (
  SELECT l.lang, n, coalesce(arg_min(source, doc_id) FILTER (contains(title, '제' || n || '조')), arg_min(source, doc_id)) AS document_title, coalesce(arg_min(title, doc_id) FILTER (contains(title, '제' || n || '조')), arg_min(title, doc_id)) AS section_title,
    CASE WHEN count(*) FILTER (contains(title, '제' || n || '조')) = 0 THEN 'Exact section not found, returning best match' END AS note FROM l, a JOIN d ON true WHERE d.lang = l.lang GROUP BY l.lang, n)""",
    "judged_cases": f"""WITH {eval_queries.FAQ_SQL}, k AS (SELECT conv_id, turn, (conv_id + turn) % 4 AS kind, (conv_id % 6)::DOUBLE AS a, (turn % 5 + 1)::DOUBLE AS b, conv_id % 9 = 8 AS failed FROM faq),
c AS (SELECT *, CASE kind WHEN 0 THEN greatest(1, least(5, a)) WHEN 1 THEN b WHEN 2 THEN b END AS correctness, CASE kind WHEN 0 THEN b END AS helpfulness, CASE kind WHEN 0 THEN 5.0 END AS faithfulness, CASE kind WHEN 0 THEN 3.0 WHEN 1 THEN 1.0 END AS fluency,
  CASE kind WHEN 0 THEN greatest(1, least(5, a)) WHEN 2 THEN greatest(1, least(5, a)) END AS named, CASE kind WHEN 0 THEN 's' || (turn % 5 + 1) ELSE '' END AS told FROM k),
f AS (SELECT *, CASE WHEN failed THEN 3.0 ELSE coalesce(named, (coalesce(correctness, 3) + coalesce(helpfulness, 3) + coalesce(faithfulness, 3) + coalesce(fluency, 3)) / 4) END::DOUBLE AS overall,
  (CASE WHEN kind = 2 THEN '; Scores extracted via regex fallback' ELSE '' END || {WARN(*CRITERIA)})[3:] AS warnings FROM c)
SELECT conv_id, turn, round(overall, 6) AS judge, round((overall - 1) / 4, 6) AS judge_normalised, {", ".join(f"CASE WHEN failed THEN 3.0 ELSE coalesce({c}, 3.0) END::DOUBLE AS judge_{c}" for c in CRITERIA)},
  CASE WHEN failed THEN 'Evaluation error: timeout' WHEN warnings <> '' THEN CASE WHEN told <> '' THEN told || ' ' ELSE '' END || '[Parse warnings: ' || warnings || ']' ELSE told END AS judge_summary FROM f""",
    "judge_choice": """WITH m AS (SELECT DISTINCT upper(coalesce(source, '')[1]) || lower(coalesce(source, '')[2:]) AS generator, coalesce(lang, '') AS provider FROM documents),
p AS (SELECT 'src' || doc_id % 12 AS g, min('src_' || (doc_id % 12 * doc_id % 12) % 7) AS own FROM documents GROUP BY 1), f AS (SELECT coalesce(lang, '') AS provider, min(coalesce(source, '')) AS fallback FROM documents GROUP BY 1 HAVING coalesce(lang, '') <> 'es')
SELECT generator, provider, coalesce(own, fallback, 'judge-default') AS judge, replace(replace(lower(coalesce(own, fallback, 'judge-default')), '-', ''), '_', '') <> lower(generator) AS diverse FROM m LEFT JOIN p ON g = lower(generator) LEFT JOIN f USING (provider)""",
    "page_numbers": "SELECT conv_id, CASE conv_id % 3 WHEN 0 THEN 'zero' WHEN 1 THEN 'one' ELSE '2' END AS category, greatest(1, count(*), max(turn), any_value(conv_id % 13))::BIGINT AS pages FROM conversations GROUP BY conv_id",
}
