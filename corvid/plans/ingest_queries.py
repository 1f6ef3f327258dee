"""Queries of ingest, chunking and page extraction."""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import functions as F

from corvid.functions.text import ustrip
from corvid.operators import ingest, pages, tree
from corvid.plans import fixtures as fx
from corvid.plans.fixtures import table
from corvid.sources.collection import Collection
from corvid.sources.shared import shared_dir

#: In the driver's documents a line of one word with a full stop serves as a header.
HEADER = r"^[^\s]+\.$"


def _documents(spark, d):
    docs = table(spark, d, "documents").withColumn("text", F.coalesce("text", F.lit("")))
    return docs.withColumn("id", ingest.chunk_id(F.col("source"), F.col("lang"), F.col("text")))


def content_id_dedup(spark, d):
    return ingest.first_wins(_documents(spark, d), "id", "doc_id").select("id", "doc_id")


def _halves(spark, d):
    docs = _documents(spark, d)
    return docs.filter("source in ('src1', 'src2', 'src3', 'src4')"), docs.filter("source not in ('src1', 'src2', 'src3', 'src4')")


def ingest_anti_existing(spark, d):
    """Four sources arrive in a collection that holds the others; ids here are of the text alone."""
    new, old = _halves(spark, d)
    by_text = lambda x: x.withColumn("id", ingest.chunk_id(F.lit("doc"), F.lit("part"), F.col("text")))
    return ingest.skip_existing(ingest.first_wins(by_text(new), "id", "doc_id"), by_text(old), "id").select("id", "doc_id")


def ingest_counters(spark, d):
    new, old = _halves(spark, d)
    by_text = lambda x: x.withColumn("id", ingest.chunk_id(F.lit("doc"), F.lit("part"), F.col("text")))
    return ingest.ingest_status(by_text(new), by_text(old), "id", "doc_id").groupBy("status").agg(F.count("*").alias("n"))


def line_sections(spark, d):
    docs = _documents(spark, d)
    x = docs.select("doc_id", F.posexplode(ingest.sections(F.col("text"), HEADER)).alias("pos", "s"))
    return x.select("doc_id", (F.col("pos") + 1).alias("section_no"), F.col("s.title").alias("title"), F.length("s.content").alias("n_chars"), F.md5(F.col("s.content").cast("binary")).alias("content_md5"))


def chunk_filter_truncate(spark, d):
    x = ingest.chunks(_documents(spark, d).select("doc_id", "source", "text"), "source", "text", header=HEADER)
    return x.select("doc_id", "section_title", F.length("section_content").alias("n_chars"), "chunk_id")


def stored_chunks(spark, d):
    x = ingest.stored_chunks(ingest.chunks(_documents(spark, d).select("doc_id", "source", "text"), "source", "text", header=HEADER))
    return x.select("doc_id", "chunk_id", F.md5(F.col("embed_text").cast("binary")).alias("embed_md5"), F.length("section_content").alias("n_stored"))


def _turns(spark, d):
    """User turns with the next turn as the answer; agents and sessions made of ids."""
    rows = table(spark, d, "conversations").withColumn("answer", F.expr("lead(text) over (partition by conv_id order by turn)")).filter("role = 'user'")
    session = F.when(F.col("turn") % 4 == 0, F.concat(F.lit("s"), F.col("conv_id").cast("string")))
    return rows.select("conv_id", "turn", F.col("text").alias("question"), "answer", session.alias("session_id"), F.when(F.col("conv_id") % 3 > 0, "2026-01-28T10:30:00").alias("created_at"))


AS_OF = "2026-02-01T00:00:00"


def pair_ids(spark, d):
    """The ids of a pair: in a batch, by itself, as an agent's answer, as an evaluation item."""
    q, a, now = F.coalesce("question", F.lit("")), F.coalesce("answer", F.lit("")), F.lit(AS_OF)
    return _turns(spark, d).select("conv_id", "turn", ingest.faq_id(q, a).alias("batch_id"), ingest.single_faq_id(q, now).alias("single_id"), ingest.agent_answer_id(q, F.col("session_id"), now).alias("agent_id"), ingest.item_id(q, now).alias("item_id"))


def agent_answers(spark, d):
    return ingest.agent_answers(_turns(spark, d), AS_OF).select("conv_id", "turn", "status", "id", "source")


ANSWER_ROW = "pos int, question string, answer string, session_id string, created_at string, error string"
ANSWER_ROWS = [(0, " q ", "a", None, None, None), (1, "", "a", None, None, None), (2, None, None, None, None, "JSON 파싱 오류"), (3, "r", " \t", "s", None, None), (4, "r", "b", "s", "2026-01-01", None)] + [(5 + k, None, None, None, None, f"error {k}") for k in range(6)]


def backfill_summary(spark, d):
    x = ingest.backfill_summary(ingest.agent_answers(fx.rows(spark, ANSWER_ROW, ANSWER_ROWS), AS_OF))
    return x.select("success", "added_count", "skipped_count", "error_count", F.array_join("errors", ";").alias("errors"))


def validation_message(spark, d):
    """The first five invalid cases of the conversations, in order, and how many more there are."""
    x = ingest.validate(_turns(spark, d).withColumn("place", F.concat_ws("-", F.lpad(F.col("conv_id").cast("string"), 9, "0"), F.lpad(F.col("turn").cast("string"), 4, "0"))), ["question", "answer"])
    return ingest.validation_message(x.withColumn("error", F.concat(F.col("place"), F.lit(" "), F.col("error"))), "place")


def valid_cases(spark, d):
    return ingest.valid_or_all(ingest.validate(_turns(spark, d), ["question", "answer"])).groupBy("session_id").agg(F.count("*").alias("n"))


PAGE_SCHEMA = "category string, html string"
PAGE_ROWS = [
    ("01", '<dl><dt class="question">질문 [결제] 환불은?</dt><dd class="answer">답변  7일  안에</dd></dl><a href="#" onclick="goPage(3)">3</a>'),
    ("01", '<dt class="question"> 질문 해지는 </dt><dd class="answer">답변 <b>언제든</b></dd><dt class="question">끝</dt>'),
    ("99", '<div class="question">[a] b</div> <div class="answer">c</div><a>12</a><a>다음</a>'),
    ("02", "<p>없음</p>"),
]


def faq_scan(spark, d):
    return pages.faq_scan(fx.rows(spark, PAGE_SCHEMA, PAGE_ROWS), {"01": "요금", "02": "가입"})


def page_counts(spark, d):
    return fx.rows(spark, PAGE_SCHEMA, PAGE_ROWS).select("html", pages.page_count(F.col("html")).alias("by_handler"), pages.table_page_count(F.col("html")).alias("by_link"))


LIST_HTML = "<table><tr><th>분류</th><th>제목</th></tr><tr><td>약관</td><td><a onclick=\"doView('78','1')\">이용 약관</a></td><td><a onclick=\"doFile('/f/78.pdf')\">pdf</a></td></tr><tr><td>약관</td><td><a onclick=\"doView('79','2')\">개인 정보</a></td></tr><tr><td>약관</td><td>링크 없음</td></tr><tr><td><a onclick=\"doView('80','3')\">한 칸</a></td></tr><tr><td>기타</td><td><a>번호 없음</a></td></tr></table>"
DETAIL_SCHEMA = "num string, html string, frame string"
DETAILS = [
    ("78", "<h1>이용 약관</h1><p>밖</p>", "<h2>제1조(목적)</h2><p>이 약관은 2024년 1월 5일부터 시행</p><h2>제2조</h2><span>x</span><h2>제3조(환불)</h2><ul><li>개정 2023.3.1</li><li>제정 2020.1.2</li></ul>"),
    ("77", "<h1>다른 것</h1>", None), ("80", "<h1>한 칸</h1>", ""),
]


def table_list(spark, d):
    x = fx.rows(spark, "html string", [(LIST_HTML,)]).select(F.explode(pages.table_rows(F.col("html"))).alias("r"))
    p = pages.view_parameters(F.col("r.onclick"))
    return x.select(F.col("r.cells")[0].alias("category"), F.col("r.cells")[1].alias("title"), p["num"].alias("num"), p["row_num"].alias("row_num"))


def document_details(spark, d):
    listed = table_list(spark, d)
    x = pages.listed_details(listed, fx.rows(spark, DETAIL_SCHEMA, DETAILS))
    return x.select("num", "title", F.col("detail.title").alias("heading"), F.col("detail.content").alias("content"), F.array_join(F.transform("detail.sections", lambda s: F.concat_ws("=", s["title"], s["content"])), ";").alias("sections"), F.col("detail.effective_date").alias("effective_date"), F.array_join("detail.revision_history", ",").alias("revisions"))


SECTIONS_SQL = """
lines AS (SELECT doc_id, source, pos, trim(line, ' ' || chr(9) || chr(13)) AS line FROM (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents)),
marked AS (SELECT *, regexp_matches(line, '^[^\\s]+\\.$') AS head FROM lines WHERE line <> ''),
numbered AS (SELECT *, sum(head::INT) OVER (PARTITION BY doc_id ORDER BY pos) AS section_no FROM marked),
sections AS (SELECT doc_id, any_value(source) AS source, section_no, min(line) FILTER (head) AS title, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT head), '') AS content FROM numbered WHERE section_no > 0 GROUP BY doc_id, section_no)"""

PARENT_SCHEMA = "id int, title string, full string"
PARENTS = [(1, "제2조(정의)", "제1조(목적) 이 약관은 목적을 정한다. 제2조(정의) 말을 정한다."), (2, "제1조(목적)", "제1조(목적) 이 약관은"), (3, "제5조(해지)", "제3조(가) 제5조(해지)"), (4, "부칙", "제1조"), (5, "제3조 (환불)", "제 2 조 (요금) " + "나" * 600), (6, "제2조(환불)", "이 규정은 제1조에 따라 한다.\n제1조(목적) 목적"), (7, "제2조(환불)", "제1조에 따라 한다.")]


def parent_context(spark, d):
    return fx.rows(spark, PARENT_SCHEMA, PARENTS).select("id", ingest.parent_context(F.col("title"), F.col("full")).alias("parent"))


def effective_date(spark, d):
    return fx.rows(spark, fx.TEXT_SCHEMA, fx.DATES).select("id", pages.effective_date(F.col("text")).alias("effective_date"))


def revision_history(spark, d):
    return fx.rows(spark, fx.TEXT_SCHEMA, fx.DATES).select("id", F.array_join(pages.revisions(F.col("text")), ",").alias("revisions"))


def handler_parse(spark, d):
    p = pages.view_parameters(F.col("onclick"))
    return fx.rows(spark, fx.CLICK_SCHEMA, fx.CLICKS).select("id", p["num"].alias("num"), p["row_num"].alias("row_num"), pages.file_url(F.col("onclick")).alias("file_url"), pages.page_count(F.col("onclick")).alias("pages"))


def html_title_headings(spark, d):
    return table(spark, d, "pages").select("page_id", pages.first_text(F.col("html"), "title").alias("title"), pages.first_text(F.col("html"), "h1").alias("heading"))


def html_sections(spark, d):
    x = table(spark, d, "pages").select("page_id", F.posexplode(pages.heading_sections(F.col("html"), "h1", ("p",))).alias("pos", "s"))
    return x.select("page_id", "pos", F.col("s.title").alias("title"), F.md5(F.col("s.content").cast("binary")).alias("content_md5"))


def html_links(spark, d):
    x = table(spark, d, "pages").select("page_id", F.explode(pages.link_targets(F.col("html"))).alias("target"))
    return x.groupBy("target").agg(F.count("*").alias("n"), F.count_distinct("page_id").alias("n_pages"))


def html_pages(spark, d):
    x = table(spark, d, "pages").select(F.regexp_extract("url", r"^https?://([^/?#]+)", 1).alias("host"), F.size(F.regexp_extract_all("html", F.lit("<p>"), F.lit(0))).alias("paragraphs"))
    return x.groupBy("host").agg(F.count("*").alias("n"), F.sum("paragraphs").alias("paragraphs"))


def dataset_merge(spark, d):
    own = table(spark, d, "benchmark").select(F.concat(F.lit("b"), F.col("item_id").cast("string")).alias("id"), F.col("text").alias("question"))
    more = table(spark, d, "conversations").filter("role = 'user'").select(F.concat_ws("_", F.lit("c"), "conv_id", "turn").alias("id"), F.col("text").alias("question"), F.lit("talk").alias("category"))
    return own.unionByName(more, allowMissingColumns=True)


def dataset_validate(spark, d):
    rows = table(spark, d, "conversations").withColumn("next", F.expr("lead(text) over (partition by conv_id order by turn)"))
    x = ingest.validate(rows.filter("role = 'user'"), ["text", "next"])
    return x.groupBy("error").agg(F.count("*").alias("n"))


def deterministic_sample(spark, d):
    return ingest.seeded_sample(table(spark, d, "documents"), "doc_id", 50, 7).select("doc_id", "source")


LABELS = [(1, "[결제] 질문 환불은?"), (2, "질문  어떻게   하나요"), (3, ""), (4, "[a][b] c"), (5, "  질문질문 x ")]


def subcategory_label(spark, d):
    rows = fx.rows(spark, fx.TEXT_SCHEMA, LABELS)
    return rows.select("id", pages.subcategory(F.col("text")).alias("sub_category"), pages.without_label(F.col("text"), "질문").alias("question"), pages.named(F.col("text"), {"": "none"}).alias("name"), ustrip(F.col("text")).alias("stripped"))


def _escaped(c):
    return F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit('"'), F.lit("&#34;"))


def _pairs(spark, d):
    x = table(spark, d, "conversations").withColumn("answer", F.expr("lead(text) over (partition by conv_id order by turn)")).filter("role = 'user'")
    return x.select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("question"), F.coalesce("answer", F.lit("")).alias("answer"))


def _placed_items(root, items=tree.faq_items):
    return [(k, *r) for k, r in enumerate(items(root))]


def faq_pages(spark, d):
    """Each conversation's pairs as a list page with nested and unclosed elements, and the pairs that its tree gives back."""
    answer = F.concat(F.lit('<div class="faq_a open">답변 '), F.regexp_replace(_escaped(F.col("answer")), "\n", "<br>\n"), F.lit("<script>if (a < b) {}</script>"))
    ask = F.when(F.col("turn") % 4 == 1, F.lit("<b>no question</b>")).otherwise(F.concat(F.lit('<span><a href=# class="faq_q">질문 '), F.when(F.col("turn") % 4 == 0, F.lit("[a &amp; b] ")).otherwise(""), _escaped(F.col("question")), F.lit("</a></span>")))
    item = F.concat(F.lit("<li>"), ask, answer, F.when(F.col("turn") % 3 == 0, "</div></li>").otherwise(""))
    page = F.concat(F.lit('<ul class="other"><li><a class="faq_q">not this</a></ul><ul class="x faq_list">'), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", item.alias("h")))), lambda x: x["h"]), "\n"), F.lit("</ul><p>end"))
    return tree.extract(_pairs(spark, d).groupBy("conv_id").agg(page.alias("html")), "html", "place int, question string, answer string, sub_category string", _placed_items)


def terms_pages(spark, d):
    """Documents as list pages of up to 50 a source and a detail page each; the lists' rows joined with what the details' trees give."""
    docs = table(spark, d, "documents").select("doc_id", F.coalesce("source", F.lit("")).alias("source"), F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    link = F.format_string("<tr><td>%s<td><a href=\"javascript:doView('%d','%d')\">T <i>%d</i></a><td><a onclick=\"doFile('/f/%d.pdf')\">pdf</a>", _escaped(F.col("lang")), F.col("doc_id"), F.col("doc_id") % 10, F.col("doc_id"), F.col("doc_id"))
    row = F.when(F.col("doc_id") % 9 == 0, F.lit("<tr><td>x<td>no link")).when(F.col("doc_id") % 9 == 1, F.lit("<tr><td><a>one cell</a>")).otherwise(link)
    lists = docs.groupBy("source", F.floor(F.col("doc_id") / 50).alias("page")).agg(F.concat(F.lit('<div class="tableDefault"><table><thead><tr><th>a<th>b</thead><tbody>'), F.array_join(F.array_sort(F.collect_list(row)), ""), F.lit("</table></div>")).alias("html"))
    listed = tree.extract(lists, "html", "category string, title string, num string, row_num string, pdf_url string", tree.listed)
    inner = F.concat(F.lit("<h2>제1조(<b>"), _escaped(F.col("lang")), F.lit("</b>)</h2> loose <p>"), _escaped(F.col("text")), F.lit("<h2></h2><h2>제2조</h2><span>x</span><h2>제3조</h2><ul><li>개정 2023.3."), (F.col("doc_id") % 28 + 1).cast("string"), F.lit("<li>2024년 1월 5일부터 시행</ul>"))
    details = tree.extract(docs.select(F.col("doc_id").cast("string").alias("num"), inner.alias("html")), "html", "content string, sections array<struct<title:string,content:string>>", lambda root: [(root.shown(), [dict(zip(("title", "content"), s)) for s in tree.sections(root)])])
    x = pages.with_details(listed, details, "num")
    titles = lambda c: F.array_join(F.transform("sections", lambda s: s[c]), ";")
    return x.select("source", "category", "title", "num", "row_num", "pdf_url", F.md5(F.col("sections")[0]["content"].cast("binary")).alias("first_md5"), titles("title").alias("titles"), F.size("sections").alias("n_sections"), pages.effective_date(F.col("content")).alias("effective_date"), F.array_join(pages.revisions(F.col("content")), ",").alias("revisions"))


def page_outline(spark, d):
    """Every page's headings, each with a digest of what follows, its links, and its list items, by its tree."""
    def of(root):
        head = root.first("title")
        return [(head.text().strip() if head else "", [t for t, _ in tree.sections(root, "h1")], hashlib.md5("|".join(c for _, c in tree.sections(root, "h1")).encode()).hexdigest(), [a.attrs["href"] for a in root.select("a") if "href" in a.attrs], len(root.select("nav li")), len(root.select("article > p")))]

    return tree.extract(table(spark, d, "pages").select("page_id", "html"), "html", "title string, headings array<string>, follow_md5 string, links array<string>, n_nav long, n_paragraphs long", of)


def collection_log(spark, d):
    """A collection that takes the pairs of even conversations, then all pairs, loses every fifth conversation's, gets every tenth's back, and is compacted in between."""
    pairs = table(spark, d, "conversations").withColumn("answer", F.expr("lead(text) over (partition by conv_id order by turn)"))
    pairs = pairs.filter("role = 'user'").select("conv_id", "turn", F.col("text").alias("question"), "answer", F.col("conv_id").cast("string").alias("category"))
    c = Collection(spark, f"{shared_dir(spark)}/corvid/collection-{uuid.uuid4().hex[:12]}", "id string, question string, answer string, category string")
    put = lambda rows, source: c.add_pairs(rows.withColumn("category", F.concat(F.lit(source), "category")).withColumn("pos", F.struct("conv_id", "turn")), "pos")
    put(pairs.filter("conv_id % 2 = 0"), "even-")
    put(pairs, "all-")
    c.compact()
    gone = ingest.valid_pairs(pairs, "question", "answer").filter("conv_id % 5 = 0").select(ingest.faq_id(F.col("question"), F.col("answer")).alias("id"))
    c.delete(gone)
    put(pairs.filter("conv_id % 10 = 0"), "back-")
    return c.scan().select("id", "category", F.length("question").alias("n_question"), F.length("answer").alias("n_answer"))


QUERIES = {f.__name__: f for f in (
    collection_log, faq_pages, terms_pages, page_outline,
    stored_chunks, pair_ids, agent_answers, backfill_summary, validation_message, valid_cases, faq_scan, page_counts, table_list, document_details, content_id_dedup, ingest_anti_existing, ingest_counters, line_sections, chunk_filter_truncate, parent_context, effective_date, revision_history, handler_parse,
    html_title_headings, html_sections, html_links, html_pages, dataset_merge, dataset_validate, deterministic_sample, subcategory_label,
)}

TEXT_ID = "substr(sha256('doc_part_' || substr(coalesce(text, ''), 1, 500)), 1, 16)"
NEW = "source IN ('src1', 'src2', 'src3', 'src4')"
E1, E2 = pages.EFFECTIVE
TAG_TEXT = "trim(regexp_replace(regexp_replace(regexp_extract(html, '(?s)<{0}\\b[^>]*>(.*?)</{0}>', 1), '<[^>]*>', ' ', 'g'), '\\s+', ' ', 'g'))"
H1 = r"(?s)<h1\b[^>]*>(.*?)</h1>\s*(<p\b[^>]*>.*?</p>)"
PLAIN = "trim(regexp_replace(regexp_replace({0}, '<[^>]*>', ' ', 'g'), '\\s+', ' ', 'g'))"
BLANK = "' ' || chr(9) || chr(10) || chr(13)"
CHUNKS_SQL = """ok AS (SELECT * FROM sections WHERE length(title || chr(10) || trim(content)) >= 10),
c AS (SELECT doc_id, source, title AS section_title, substr(content, 1, 2000) AS content FROM ok UNION ALL
  SELECT doc_id, source, source, substr(text, 1, 2000) FROM documents d WHERE coalesce(text, '') <> '' AND NOT EXISTS (FROM ok WHERE ok.doc_id = d.doc_id))"""
CHUNK_ID = "substr(sha256(source || '_' || section_title || '_' || substr(content, 1, 500)), 1, 16)"
TURNS_SQL = """turns AS (SELECT conv_id, turn, coalesce(text, '') AS q, coalesce(answer, '') AS a, CASE WHEN turn % 4 = 0 THEN 's' || conv_id END AS session_id, CASE WHEN conv_id % 3 > 0 THEN '2026-01-28T10:30:00' END AS created_at
  FROM (SELECT *, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS answer FROM conversations) WHERE role = 'user')"""
NOW = f"q || '_{AS_OF}'"


def ID(parts: str, n: int = 16) -> str:
    return f"substr(sha256({parts}), 1, {n})"


ORACLE_SQL = {
    "faq_pages": """WITH p AS (SELECT conv_id, turn, coalesce(text, '') AS question, coalesce(lead(text) OVER (PARTITION BY conv_id ORDER BY turn), '') AS answer, role FROM conversations)
SELECT conv_id, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1)::INTEGER AS place, trim(CASE WHEN turn % 4 = 0 THEN '[a & b] ' ELSE '' END || question) AS question, trim(regexp_replace(answer, '\\s+', ' ', 'g')) AS answer, CASE WHEN turn % 4 = 0 THEN 'a & b' ELSE regexp_extract(question, '^\\[([^\\]]+)\\]', 1) END AS sub_category FROM p WHERE role = 'user' AND turn % 4 <> 1""",
    "terms_pages": """SELECT coalesce(source, '') AS source, coalesce(lang, '') AS category, 'T ' || doc_id AS title, doc_id::VARCHAR AS num, (doc_id % 10)::VARCHAR AS row_num, '/f/' || doc_id || '.pdf' AS pdf_url, md5(trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g'))) AS first_md5,
  '제1조(' || coalesce(lang, '') || ');제2조;제3조' AS titles, 3 AS n_sections, '2024-01-05' AS effective_date, '2023-03-' || lpad((doc_id % 28 + 1)::VARCHAR, 2, '0') AS revisions FROM documents WHERE doc_id % 9 > 1""",
    "collection_log": """WITH p AS (SELECT conv_id, turn, text AS question, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS answer, role FROM conversations),
v AS (SELECT *, substr(sha256(question || '_' || substr(answer, 1, 200)), 1, 16) AS id FROM p WHERE role = 'user' AND coalesce(question, '') <> '' AND coalesce(answer, '') <> ''),
puts AS (SELECT 1 AS k, 'even-' AS source, * FROM v WHERE conv_id % 2 = 0 UNION ALL SELECT 2, 'all-', * FROM v),
kept AS (SELECT * FROM puts QUALIFY row_number() OVER (PARTITION BY id ORDER BY k, conv_id, turn) = 1),
left_ AS (SELECT * FROM kept WHERE id NOT IN (SELECT id FROM v WHERE conv_id % 5 = 0)),
back AS (SELECT 3 AS k, 'back-' AS source, * FROM v WHERE conv_id % 10 = 0 AND id NOT IN (SELECT id FROM left_) QUALIFY row_number() OVER (PARTITION BY id ORDER BY conv_id, turn) = 1)
SELECT id, source || conv_id AS category, length(question)::INTEGER AS n_question, length(answer)::INTEGER AS n_answer FROM (SELECT * FROM left_ UNION ALL SELECT * FROM back)""",
    "content_id_dedup": "SELECT substr(sha256(source || '_' || lang || '_' || substr(coalesce(text, ''), 1, 500)), 1, 16) AS id, min(doc_id) AS doc_id FROM documents GROUP BY 1",
    "ingest_anti_existing": f"SELECT {TEXT_ID} AS id, min(doc_id) AS doc_id FROM documents WHERE {NEW} GROUP BY 1 HAVING id NOT IN (SELECT {TEXT_ID} FROM documents WHERE NOT {NEW})",
    "ingest_counters": f"""WITH n AS (SELECT {TEXT_ID} AS id, doc_id, row_number() OVER (PARTITION BY {TEXT_ID} ORDER BY doc_id) AS k FROM documents WHERE {NEW}), o AS (SELECT DISTINCT {TEXT_ID} AS id FROM documents WHERE NOT {NEW})
SELECT CASE WHEN k > 1 THEN 'skipped_duplicate' WHEN id IN (SELECT id FROM o) THEN 'skipped_existing' ELSE 'added' END AS status, count(*) AS n FROM n GROUP BY 1""",
    "line_sections": f"WITH {SECTIONS_SQL} SELECT doc_id, section_no, title, length(content) AS n_chars, md5(content) AS content_md5 FROM sections",
    "chunk_filter_truncate": f"WITH {SECTIONS_SQL}, {CHUNKS_SQL} SELECT doc_id, section_title, length(content) AS n_chars, {CHUNK_ID} AS chunk_id FROM c",
    "stored_chunks": f"""WITH {SECTIONS_SQL}, {CHUNKS_SQL} SELECT doc_id, {CHUNK_ID} AS chunk_id, md5(trim(section_title || chr(10) || content, {BLANK})) AS embed_md5, least(length(content), 1000) AS n_stored
FROM c WHERE trim(section_title || chr(10) || content, {BLANK}) <> ''""",
    "pair_ids": f"""WITH {TURNS_SQL} SELECT conv_id, turn, {ID("q || '_' || substr(a, 1, 200)")} AS batch_id, {ID(NOW)} AS single_id, CASE WHEN session_id IS NULL THEN {ID(NOW)} ELSE {ID(f"q || '_' || session_id || '_{AS_OF}'")} END AS agent_id, {ID(NOW, 12)} AS item_id FROM turns""",
    "agent_answers": f"""WITH {TURNS_SQL}, s AS (SELECT *, trim(q, {BLANK}) AS sq, trim(a, {BLANK}) AS sa, coalesce(created_at, '{AS_OF}') AS stamp FROM turns)
SELECT conv_id, turn, CASE WHEN sq = '' OR sa = '' THEN 'skipped' ELSE 'added' END AS status, CASE WHEN sq <> '' AND sa <> '' THEN {ID("sq || '_' || coalesce(session_id || '_', '') || stamp")} END AS id, 'human_agent' AS source FROM s""",
    "backfill_summary": "SELECT false AS success, 2::BIGINT AS added_count, 2::BIGINT AS skipped_count, 7::BIGINT AS error_count, 'JSON 파싱 오류;error 0;error 1;error 2;error 3' AS errors",
    "validation_message": f"""WITH {TURNS_SQL}, bad AS (SELECT lpad(conv_id::VARCHAR, 9, '0') || '-' || lpad(turn::VARCHAR, 4, '0') AS place, CASE WHEN trim(q, {BLANK}) = '' THEN 'question: empty' ELSE 'answer: empty' END AS error FROM turns WHERE trim(q, {BLANK}) = '' OR trim(a, {BLANK}) = ''),
first AS (SELECT * FROM bad ORDER BY place LIMIT 5)
SELECT CASE WHEN (SELECT count(*) FROM bad) > 0 THEN 'Dataset validation failed: ' || (SELECT string_agg(place || ' ' || error, '; ' ORDER BY place) FROM first) || CASE WHEN (SELECT count(*) FROM bad) > 5 THEN ' (and ' || ((SELECT count(*) FROM bad) - 5) || ' more)' ELSE '' END END AS message""",
    "valid_cases": f"WITH {TURNS_SQL} SELECT session_id, count(*) AS n FROM turns WHERE trim(q, {BLANK}) <> '' AND trim(a, {BLANK}) <> '' GROUP BY session_id",
    "faq_scan": """SELECT * FROM (VALUES ('요금', '[결제] 환불은?', '7일 안에', '결제'), ('요금', '해지는', '언제든', ''), ('99', '[a] b', 'c', 'a')) AS t(category, question, answer, sub_category)""",
    "page_counts": f"""SELECT html, greatest(1, coalesce(list_max(list_transform(regexp_extract_all(html, 'goPage\\((\\d+)\\)', 1), lambda x: x::INT)), 1)) AS by_handler,
  greatest(1, coalesce(list_max(list_transform(regexp_extract_all(html, 'goPage\\((\\d+)\\)', 1) || regexp_extract_all(html, '<a[^>]*>(\\d+)</a>', 1), lambda x: x::INT)), 1)) AS by_link FROM {fx.sql(PAGE_SCHEMA, PAGE_ROWS)}""",
    "table_list": "SELECT * FROM (VALUES ('약관', '이용 약관', '78', '1'), ('약관', '개인 정보', '79', '2'), ('기타', '번호 없음', '', '')) AS t(category, title, num, row_num)",
    "document_details": """SELECT '78' AS num, '이용 약관' AS title, '이용 약관' AS heading, '제1조(목적) 이 약관은 2024년 1월 5일부터 시행 제2조 x 제3조(환불) 개정 2023.3.1 제정 2020.1.2' AS content,
  '제1조(목적)=이 약관은 2024년 1월 5일부터 시행;제3조(환불)=개정 2023.3.1 제정 2020.1.2' AS sections, '2024-01-05' AS effective_date, '2020-01-02,2023-03-01' AS revisions""",
    "handler_parse": f"""SELECT id, regexp_extract(onclick, 'doView\\(\\s*''([^'']*)''\\s*,\\s*''([^'']*)''\\s*\\)', 1) AS num, regexp_extract(onclick, 'doView\\(\\s*''([^'']*)''\\s*,\\s*''([^'']*)''\\s*\\)', 2) AS row_num,
  nullif(regexp_extract(onclick, 'doFile\\(\\s*''([^'']*)''\\s*\\)', 1), '') AS file_url, coalesce(list_max(list_transform(regexp_extract_all(onclick, 'goPage\\([''"]?(\\d+)', 1), lambda x: x::INT)), 1) AS pages FROM {fx.sql(fx.CLICK_SCHEMA, fx.CLICKS)}""",
    "subcategory_label": f"""SELECT id, regexp_extract(text, '^\\[([^\\]]+)\\]', 1) AS sub_category, trim(regexp_replace(regexp_replace(trim(text), '\\s+', ' ', 'g'), '^질문\\s*', '')) AS question, CASE text WHEN '' THEN 'none' ELSE text END AS name, trim(text) AS stripped FROM {fx.sql(fx.TEXT_SCHEMA, LABELS)}""",
    "parent_context": f"""WITH p AS (SELECT id, "full", try_cast(regexp_extract(title, '{ingest.HEADER}', 1) AS INT) AS n FROM {fx.sql(PARENT_SCHEMA.replace("full", '"full"'), PARENTS)}),
f AS (SELECT *, strpos("full", nullif(regexp_extract("full", '제\\s*' || (n - 1) || '\\s*조\\s*[\\(（][^)）]+[\\)）]', 0), '')) AS place FROM p) SELECT id, CASE WHEN n > 1 AND place > 0 THEN substr("full", place, 500) ELSE '' END AS parent FROM f""",
    "effective_date": f"""SELECT id, coalesce({", ".join(f"CASE WHEN regexp_matches(text, '{p}') THEN regexp_extract(text, '{p}', 1) || '-' || lpad(regexp_extract(text, '{p}', 2), 2, '0') || '-' || lpad(regexp_extract(text, '{p}', 3), 2, '0') END" for p in (E1, E2))}, '') AS effective_date FROM {fx.sql(fx.TEXT_SCHEMA, fx.DATES)}""",
    "revision_history": f"""WITH r AS (SELECT id, {", ".join(f"unnest(regexp_extract_all(text, '{pages.REVISION}', {g})) AS g{g}" for g in (1, 2, 3))} FROM {fx.sql(fx.TEXT_SCHEMA, fx.DATES)}),
l AS (SELECT id, string_agg(DISTINCT d, ',' ORDER BY d) AS revisions FROM (SELECT id, g1 || '-' || lpad(g2, 2, '0') || '-' || lpad(g3, 2, '0') AS d FROM r) GROUP BY id)
SELECT id, coalesce(revisions, '') AS revisions FROM {fx.sql(fx.TEXT_SCHEMA, fx.DATES)} LEFT JOIN l USING (id)""",
    "html_title_headings": f"SELECT page_id, {TAG_TEXT.format('title')} AS title, {TAG_TEXT.format('h1')} AS heading FROM pages",
    "html_sections": f"""WITH s AS (SELECT page_id, unnest(regexp_extract_all(html, '{H1}', 1)) AS a, unnest(regexp_extract_all(html, '{H1}', 2)) AS b FROM pages)
SELECT page_id, (row_number() OVER (PARTITION BY page_id) - 1)::INT AS pos, {PLAIN.format('a')} AS title, md5({PLAIN.format('b')}) AS content_md5 FROM s""",
    "html_links": """WITH l AS (SELECT page_id, unnest(regexp_extract_all(html, '<a\\s[^>]*href="([^"]*)"', 1)) AS target FROM pages) SELECT target, count(*) AS n, count(DISTINCT page_id) AS n_pages FROM l GROUP BY target""",
    "html_pages": "SELECT regexp_extract(url, '^https?://([^/?#]+)', 1) AS host, count(*) AS n, sum(len(regexp_extract_all(html, '<p>')))::BIGINT AS paragraphs FROM pages GROUP BY 1",
    "dataset_merge": "SELECT 'b' || item_id AS id, text AS question, NULL::VARCHAR AS category FROM benchmark UNION ALL SELECT 'c_' || conv_id || '_' || turn, text, 'talk' FROM conversations WHERE role = 'user'",
    "dataset_validate": """WITH n AS (SELECT *, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS next FROM conversations)
SELECT CASE WHEN trim(coalesce(text, '')) = '' THEN 'text: empty' WHEN trim(coalesce(next, '')) = '' THEN 'next: empty' END AS error, count(*) AS n FROM n WHERE role = 'user' GROUP BY 1""",
    "deterministic_sample": "SELECT doc_id, source FROM documents ORDER BY md5('7:' || doc_id), doc_id LIMIT 50",
}
