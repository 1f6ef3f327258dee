"""Queries of search, rules, relations and hybrid ranking."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvid.operators import hybrid, index, ingest, results, routing, rules, search, triplets
from corvid.plans import fixtures as fx
from corvid.plans.fixtures import table

#: Keyword weights in the languages of the driver's documents.
WEIGHTS = {"the": 0.9, "of": 0.8, "and": 0.7, "nicht": 0.9, "pour": 0.8, "que": 0.6, "other": 0.5, "then": 0.5}
QUERY = "The way of things and other: nicht, pour que"
#: Also a word that relations have.
ASKED = "the"
K = 5
#: What the nearest of the driver's vectors reach, and the recall that the index is asked for.
NEAR, RECALL = 0.36, 0.99


def _queries(v: DataFrame) -> DataFrame:
    """The query set of a search: every row whose id is divisible by 100."""
    return v.filter("vec_id % 100 = 0")


def vector_topk_multi(spark, d):
    v = table(spark, d, "embeddings")
    return _shown(search.top_k(_queries(v), v, K))


def _shown(hits: DataFrame) -> DataFrame:
    return hits.withColumn("score", F.round("score", 6))


def vector_topk_filtered(spark, d):
    v = table(spark, d, "embeddings")
    return _shown(search.top_k(_queries(v), v, K, category_col="label", same_category=True))


def vector_topk_threshold(spark, d):
    v = table(spark, d, "embeddings")
    return _shown(search.top_k(_queries(v), v, K, threshold=0.4))


def vector_lookup(spark, d):
    v = table(spark, d, "embeddings")
    return search.lookup(v, _queries(v), "vec_id").select("vec_id", "label", "score")


def near_dup_gate(spark, d):
    """All vectors, arriving by id in an empty collection, at a threshold that some of the driver's vectors reach."""
    return search.near_duplicate_gate(table(spark, d, "embeddings"), threshold=NEAR).withColumn("best_score", F.round("best_score", 6))


def near_duplicates(spark, d):
    v = table(spark, d, "embeddings")
    return _shown(search.near_duplicates(_queries(v), v, least=NEAR))


def index_topk(spark, d):
    """What vector_topk_multi gives, by the index."""
    v = table(spark, d, "embeddings")
    return _shown(index.search(index.build(v), _queries(v), K))


def index_recall(spark, d):
    """Whether a search of the nearest cells finds nine tenths of what the exact one does, in fewer pairs than there are."""
    v, counts = table(spark, d, "embeddings"), {}
    found = index.search(index.build(v), _queries(v), K, recall=RECALL, counts=counts)
    both = vector_topk_multi(spark, d).select("query_id", "item_id").join(found.select("query_id", "item_id", F.lit(1).alias("hit")), ["query_id", "item_id"], "left")
    return both.agg(F.count("*").alias("wanted"), (F.count("hit") >= 0.9 * F.count("*")).alias("found")).withColumn("fewer", F.lit(counts["joined"] < counts["pairs"]))


def search_dedup(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("item_id"), F.sha2(F.concat_ws("_", "source", F.substring("text", 1, 200)), 256).alias("content_key"))
    hits = vector_topk_multi(spark, d).join(docs, "item_id")
    return search.dedup_hits(hits, "content_key").select("query_id", "item_id", "score", "rank")


HITS_SQL = """hits AS (
  SELECT query_id, item_id, s, round(s, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, item_id) AS rank FROM (
    SELECT q.vec_id AS query_id, i.vec_id AS item_id, list_cosine_similarity(q.embedding::DOUBLE[], i.embedding::DOUBLE[]) AS s
    FROM embeddings q JOIN embeddings i ON q.vec_id <> i.vec_id {on} WHERE q.vec_id % 100 = 0) QUALIFY rank <= {k})"""


def hits_sql(on: str = "", k: int = K) -> str:
    return "WITH " + HITS_SQL.format(on=on, k=k)


def keyword_score(spark, d):
    docs = table(spark, d, "documents")
    m = rules.matched_keywords(F.lit(QUERY), F.coalesce("text", F.lit("")), WEIGHTS)
    return docs.select("doc_id", m.alias("m")).select("doc_id", F.array_join(F.transform("m", lambda k: k["word"]), ",").alias("matched"), F.round(rules.keyword_score(F.col("m")), 6).alias("score"))


WEIGHTS_SQL = "(SELECT * FROM (VALUES " + ", ".join(f"({n}, '{w}', {x}::DOUBLE)" for n, (w, x) in enumerate(WEIGHTS.items())) + ") AS t(n, word, weight))"
KEYWORD_SQL = f"""m AS (SELECT doc_id, string_agg(word, ',' ORDER BY n) AS matched, least(1.0, sum(weight) / count(*)) AS score
  FROM documents JOIN {WEIGHTS_SQL} ON contains(lower(coalesce(text, '')), word) AND contains(lower('{QUERY}'), word) GROUP BY doc_id)"""


def section_ref_parse(spark, d):
    ref = rules.section_reference(F.col("query"))
    return fx.rows(spark, fx.REF_SCHEMA, fx.REFS).select("id", ref["article"].alias("article"), ref["clause"].alias("clause"), ref["subclause"].alias("subclause"), ref["title"].alias("title"), rules.reference_text(ref).alias("shown"), rules.loose_reference(F.col("query")).alias("loose"))


REF_SQL = rules.REFERENCE.replace("'", "''")
REFS_SQL = f"""refs AS (SELECT id, query, try_cast(regexp_extract(query, '{REF_SQL}', 1) AS INT) AS article, nullif(regexp_extract(query, '{REF_SQL}', 2), '') AS title,
  try_cast(regexp_extract(query, '{REF_SQL}', 3) AS INT) AS clause, try_cast(regexp_extract(query, '{REF_SQL}', 4) AS INT) AS subclause FROM {fx.sql(fx.REF_SCHEMA, fx.REFS)})"""


def section_match(spark, d):
    q = fx.rows(spark, fx.REF_SCHEMA, fx.REFS).withColumn("ref", rules.section_reference(F.col("query"))).filter("ref is not null")
    t = fx.rows(spark, fx.TITLE_SCHEMA, fx.TITLES)
    return t.join(q, rules.section_match(F.col("ref"), F.col("title"))).select("id", "tid")


def rule_match(spark, d):
    docs = table(spark, d, "documents").withColumn("text", F.coalesce("text", F.lit("")))
    return rules.rule_match(docs, F.lit(QUERY), "source", "text", "doc_id", WEIGHTS).select("doc_id", F.round("rule_score", 6).alias("rule_score"), "matched_words")


def rule_boost(spark, d):
    q = fx.rows(spark, fx.REF_SCHEMA, fx.REFS).withColumn("ref", rules.section_reference(F.col("query")))
    t = fx.rows(spark, fx.TITLE_SCHEMA, fx.TITLES).withColumn("content", F.lit("환불과 손해배상 책임"))
    x = t.join(q, F.lit(True)).withColumn("ask", F.concat("query", F.lit(" 환불 손해배상")))
    kw = rules.keyword_score(rules.matched_keywords(F.col("ask"), F.concat_ws("\n", "title", "content")))
    return x.select("id", "tid", F.round(rules.rule_score(rules.section_match(F.col("ref"), F.col("title")), kw), 6).alias("rule_score"))


def triplet_extract(spark, d):
    rows = triplets.extract_all(fx.rows(spark, fx.CHUNK_SCHEMA, fx.CHUNKS), "chunk_id", F.col("text"))
    return triplets.store(rows).select("triplet_id", "subject", "predicate", "object", "chunk_id")


#: A relation that the driver's documents can have: two words around "is".
ENGLISH = [triplets.Pattern(r"\b([A-Za-z]+) is ([A-Za-z]+)", 1, "is", 2)]


def _document_triplets(spark, d) -> DataFrame:
    return triplets.store(triplets.extract_all(table(spark, d, "documents"), "doc_id", F.coalesce("text", F.lit("")), ENGLISH))


def triplet_extract_documents(spark, d):
    return _document_triplets(spark, d).select("triplet_id", "subject", "predicate", "object", "chunk_id")


RE_IS = r"\b([A-Za-z]+) is ([A-Za-z]+)"
TRIPLETS_SQL = f"""t AS (SELECT substr(md5(concat_ws(':', subject, 'is', object)), 1, 12) AS triplet_id, subject, 'is' AS predicate, object, min(doc_id) AS chunk_id FROM (
  SELECT doc_id, unnest(regexp_extract_all(text, '{RE_IS}', 1)) AS subject, unnest(regexp_extract_all(text, '{RE_IS}', 2)) AS object FROM documents) GROUP BY ALL)"""
ASK = ["the", "is", "and", "thing"]


def _triplet_hits(spark, d) -> DataFrame:
    asked = fx.rows(spark, "query string", [(q,) for q in ASK])
    return triplets.search(asked, _document_triplets(spark, d))


def triplet_search(spark, d):
    return _triplet_hits(spark, d).select("query", "triplet_id", "match_type", F.round("score", 6).alias("score"))


ASK_SQL = fx.sql("query string", [(q,) for q in ASK])
TRIPLET_HITS_SQL = f"""h AS (SELECT query, triplet_id, chunk_id, CASE WHEN s IS NOT NULL THEN 'subject' WHEN p IS NOT NULL THEN 'predicate' ELSE 'object' END AS match_type, coalesce(s, p, o) AS score FROM (
  SELECT *, {", ".join(f"CASE WHEN contains(lower({f}), query) OR contains(query, lower({f})) THEN length(query) / greatest(length({f}), length(query)) END AS {f[0]}" for f in ("subject", "predicate", "object"))}
  FROM t, {ASK_SQL} q) WHERE coalesce(s, p, o) IS NOT NULL)"""


def triplet_chunk_score(spark, d):
    return triplets.chunk_scores(_triplet_hits(spark, d), ["query"]).select("query", "chunk_id", F.round("total", 6).alias("total"), F.round("triplet_score", 6).alias("triplet_score"))


def _chunks(spark, d) -> DataFrame:
    """Documents that have a vector, as chunks."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.lit("").alias("section_title"), F.coalesce("text", F.lit("")).alias("section_content"))
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector")).join(docs, "id", "left")


def _asking(spark, d) -> DataFrame:
    return _queries(table(spark, d, "embeddings")).select(F.col("vec_id").alias("id"), F.lit(ASKED).alias("query"), F.col("embedding").alias("vector"))


def _candidates(spark, d) -> DataFrame:
    """Over-fetched hits with their rule and relation scores, one query text for all."""
    x = hybrid.candidates(_asking(spark, d), _chunks(spark, d), _document_triplets(spark, d), hybrid.Weights(), hybrid.overfetch(K), WEIGHTS)
    return x.withColumn("combined_score", F.round("combined_score", 9)).withColumn("rerank_score", F.when(F.col("item_id") % 7 != 0, (F.col("item_id") * 37 % 101) / 10.0))


def hybrid_combined(spark, d):
    x = _candidates(spark, d).withColumn("place", hybrid.rank_by("combined_score", "query_id", "item_id"))
    return x.filter(F.col("place") <= K).select("query_id", "item_id", F.round("vector_score", 6).alias("score"), F.round("rule_score", 6).alias("rule_score"), F.round("triplet_score", 6).alias("triplet_score"), "combined_score", "place")


ASKED_SQL = f"""am AS (SELECT doc_id, string_agg(word, ', ' ORDER BY n) AS matched, least(1.0, sum(weight) / count(*)) AS score
  FROM documents JOIN {WEIGHTS_SQL} ON contains(lower(coalesce(text, '')), word) AND contains('{ASKED}', word) GROUP BY doc_id)"""


def candidates_sql(k: int, rerank: str) -> str:
    return f"""{hits_sql(k=k).replace("q.vec_id <> i.vec_id", "true")}, {ASKED_SQL}, {TRIPLETS_SQL},
rel AS (SELECT chunk_id AS item_id, triplet_id, concat_ws('-', subject, predicate, object) AS triplet, CASE WHEN contains(lower(subject), 'the') OR contains('the', lower(subject)) THEN 3 / greatest(length(subject), 3) WHEN contains('the', 'is') THEN 1.0
  WHEN contains(lower(object), 'the') OR contains('the', lower(object)) THEN 3 / greatest(length(object), 3) END AS s FROM t),
own AS (SELECT query_id, item_id, sum(rel.s) AS total, arg_min(triplet, triplet_id) AS triplet FROM hits JOIN rel USING (item_id) WHERE rel.s IS NOT NULL GROUP BY ALL),
share AS (SELECT query_id, item_id, triplet, total / max(total) OVER (PARTITION BY query_id) AS triplet_score FROM own),
c AS (SELECT query_id, item_id, h.s AS vector_score, h.score, coalesce(am.score, 0)::DOUBLE * 0.5 AS rule_score, am.matched, triplet, coalesce(triplet_score, 0) AS triplet_score,
  round(0.5::DOUBLE * h.s + 0.3::DOUBLE * (coalesce(am.score, 0)::DOUBLE * 0.5::DOUBLE) + 0.2::DOUBLE * coalesce(triplet_score, 0)::DOUBLE, 9) AS combined_score,
  {rerank} AS rerank_score, length(coalesce(text, '')) AS n_text
  FROM hits h LEFT JOIN documents d ON d.doc_id = item_id LEFT JOIN am ON am.doc_id = item_id LEFT JOIN share USING (query_id, item_id))"""


CANDIDATES_SQL = candidates_sql(3 * K, "CASE WHEN item_id % 7 <> 0 THEN (item_id * 37 % 101) / 10.0::DOUBLE END")


def hybrid_rerank_blend(spark, d):
    x = hybrid.rerank_blend(_candidates(spark, d), 0.3, "query_id")
    return x.select("query_id", "item_id", "combined_score", "rerank_score", F.round("final_score", 9).alias("final_score"))


BLEND = "CASE WHEN rerank_score IS NULL THEN combined_score ELSE 0.7 * combined_score + 0.3 * CASE WHEN hi = lo THEN 0.5 ELSE (rerank_score - lo) / (hi - lo) END END"


def hybrid_fill(spark, d):
    x = hybrid.rerank_and_fill(_candidates(spark, d), 8, 4, 0.3, "query_id", "item_id")
    return x.select("query_id", "item_id", "block", F.round("final_score", 5).alias("final_score"))


def search_explanation(spark, d):
    """Only hits with a rerank score have a final one told."""
    x = hybrid.rerank_blend(_candidates(spark, d), 0.3, "query_id")
    final = F.when(F.col("rerank_score").isNotNull(), F.round("final_score", 6))
    text = hybrid.explanation(F.round("vector_score", 6), F.col("rule_score"), F.col("section_match"), F.col("matched_keywords"), F.round("triplet_score", 6), F.get("matched_triplets", F.lit(0)), F.col("rerank_score"), final, F.round("combined_score", 6))
    return x.select("query_id", "item_id", text.alias("explanation"))


def _length_rerank(query, text):
    return (F.length(text) * 7 % 13) / 13.0


def hybrid_entry(spark, d):
    """The whole search with reranking: the best 20 candidates are scored, the best 4 by that score go first."""
    x = hybrid.hybrid_search(_asking(spark, d), _chunks(spark, d), _document_triplets(spark, d), hybrid.Config(rerank_enabled=True, rerank_top_k=4), K, _length_rerank, WEIGHTS)
    return x.select("query_id", "item_id", "rank", F.round("combined_score", 6).alias("combined_score"), F.round("rerank_score", 6).alias("rerank_score"), F.round("final_score", 6).alias("final_score"))


def hybrid_off(spark, d):
    x = hybrid.hybrid_search(_asking(spark, d), _chunks(spark, d), None, n=K, enabled=False)
    return x.select("query_id", "item_id", "rank", F.round("final_score", 6).alias("final_score"))


def rule_match_category(spark, d):
    docs = table(spark, d, "documents").withColumn("text", F.coalesce("text", F.lit("")))
    return rules.rule_match(docs, F.lit(QUERY), "source", "text", "doc_id", WEIGHTS, ("lang", "en")).select("doc_id", F.round("rule_score", 6).alias("rule_score"), "matched_words")


def triplet_search_exact(spark, d):
    asked = fx.rows(spark, "query string", [(q,) for q in ASK])
    return triplets.search(asked, _document_triplets(spark, d), fuzzy=False).select("query", "triplet_id", "match_type", "score")


def triplet_index(spark, d):
    """How many triplets a collection's index takes in, and how many of those are distinct."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "lang", "text")
    return triplets.build_index(docs, ENGLISH, "id", "lang", "text")[1]


def triplets_of_chunk(spark, d):
    """Of each chunk with relations those it is the first to have."""
    kept = triplets.build_index(table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.lit("").alias("t"), "text"), ENGLISH, "id", "t", "text")[0]
    return kept.groupBy("chunk_id").agg(F.count("*").alias("n"), F.min("triplet_id").alias("first_id"))


def route_bands(spark, d):
    x = fx.rows(spark, fx.BAND_SCHEMA, fx.BANDS).withColumn("s", F.coalesce("score", F.lit(0.0)))
    return x.select("id", routing.route_faq(F.col("s")).alias("faq_route"), routing.route_sections(F.col("s")).alias("section_route"))


def route_search(spark, d):
    v = table(spark, d, "embeddings")
    top = search.top_k(_queries(v), v, 1).select("query_id", "score")
    bands = routing.Bands(0.6, 0.5, 0.45, 0.4, 0.35)
    return top.select("query_id", F.when(routing.route_faq(F.col("score"), bands) != "sections", routing.route_faq(F.col("score"), bands)).otherwise(routing.route_sections(F.col("score"), bands)).alias("route"))


SECTION_SCHEMA = "id long, document_title string, section_title string, vector array<double>"
SECTIONS = [(1, "서비스 약관", "제1조(목적)", [1.0, 0.0]), (2, "서비스 약관", "제2조(해지)", [0.9, 0.1]), (3, "서비스 약관", "제3조(환불)", [0.8, 0.3]), (4, "개인정보", "제1조(목적)", [0.7, 0.7]), (5, "개인정보", "제2조(동의)", [0.1, 1.0]), (6, "개인정보", None, [0.0, 1.0]), (7, "부칙", "제9조(시행)", [-1.0, 0.0])]
REQUEST_SCHEMA = "id long, document string, section string, vector array<double>"
REQUESTS = [(1, "서비스 약관", "제3조", [1.0, 0.05]), (2, "개인정보", "제1조", [0.3, 1.0]), (3, "개인정보", "제9조", [0.2, 1.0]), (4, "서비스 약관", "제9조", [1.0, 0.0])]


def get_section(spark, d):
    """Of the five nearest sections the first whose title holds what is asked for, else the nearest with a note."""
    asked, sections = fx.rows(spark, REQUEST_SCHEMA, REQUESTS), fx.rows(spark, SECTION_SCHEMA, SECTIONS)
    hits = search.top_k(asked, sections, 5, "id", "vector", exclude_self=False).join(asked.select(F.col("id").alias("query_id"), F.col("section")), "query_id")
    hits = hits.join(sections.select(F.col("id").alias("item_id"), "document_title", "section_title"), "item_id")
    return results.section_or_best(hits.withColumnRenamed("query_id", "request"))


def word_section(spark, d):
    """For each language and word of the query: the first document by id whose text holds it, else the first one with a note."""
    words = fx.rows(spark, "word string", [(w,) for w in WEIGHTS])
    docs = table(spark, d, "documents").select("lang", "doc_id", F.lower(F.coalesce("text", F.lit(""))).alias("t"))
    x = docs.join(words, F.lit(True)).groupBy("lang", "word").agg(F.min(F.when(F.col("t").contains(F.col("word")), F.col("doc_id"))).alias("hit"), F.min("doc_id").alias("first"))
    return x.select("lang", "word", F.coalesce("hit", "first").alias("doc_id"), F.col("hit").isNull().alias("inexact"))


def list_documents(spark, d):
    return table(spark, d, "documents").groupBy("source").agg(F.count("*").alias("n"), F.count_distinct("lang").alias("n_langs"))


QUERIES = {f.__name__: f for f in (
    vector_topk_multi, vector_topk_filtered, vector_topk_threshold, vector_lookup, near_dup_gate, search_dedup, keyword_score, section_ref_parse, section_match, rule_match, rule_boost,
    triplet_extract, triplet_extract_documents, triplet_search, triplet_chunk_score, hybrid_combined, hybrid_rerank_blend, hybrid_fill, search_explanation, route_bands, route_search, get_section, list_documents,
    near_duplicates, index_topk, index_recall, hybrid_entry, hybrid_off, rule_match_category, triplet_search_exact, triplet_index, triplets_of_chunk, word_section,
)}

HEADER_SQL = ingest.HEADER
SHOWN = "query_id, item_id, score, rank"
LENGTH_RERANK = "((length(chr(10) || coalesce(text, '')) - 1) * 7 % 13) / 13.0::DOUBLE"
ORACLE_SQL = {
    "vector_topk_multi": hits_sql() + f" SELECT {SHOWN} FROM hits",
    "vector_topk_filtered": hits_sql("AND q.label = i.label") + f" SELECT {SHOWN} FROM hits",
    "vector_topk_threshold": hits_sql() + f" SELECT {SHOWN} FROM hits WHERE s >= 0.4",
    "vector_lookup": "SELECT vec_id, label, 1.0::DOUBLE AS score FROM embeddings WHERE vec_id % 100 = 0",
    "near_dup_gate": f"""WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e, row_number() OVER (ORDER BY vec_id) AS n FROM embeddings),
pairs AS (SELECT a.n AS n, b.n AS m, b.vec_id AS id, list_cosine_similarity(a.e, b.e) AS s FROM v a JOIN v b ON b.n < a.n),
near AS (SELECT n, list(m) AS ms FROM pairs WHERE s >= {NEAR} GROUP BY n),
step(n, inside) AS (SELECT 0::BIGINT, []::BIGINT[] UNION ALL
  SELECT step.n + 1, CASE WHEN list_has_any(inside, coalesce(ms, [])) THEN inside ELSE list_append(inside, step.n + 1) END FROM step LEFT JOIN near ON near.n = step.n + 1 WHERE step.n < (SELECT max(n) FROM v)),
went AS (SELECT unnest(inside) AS m FROM step WHERE n = (SELECT max(n) FROM v)),
best AS (SELECT n, id, s FROM pairs JOIN went USING (m) QUALIFY row_number() OVER (PARTITION BY n ORDER BY s DESC, id) = 1)
SELECT vec_id AS query_id, id AS best_id, round(s, 6) AS best_score, n IN (SELECT m FROM went) AS inserted FROM v LEFT JOIN best USING (n)""",
    "near_duplicates": hits_sql(k=3) + f" SELECT {SHOWN} FROM hits WHERE s >= {NEAR}",
    "index_topk": hits_sql() + f" SELECT {SHOWN} FROM hits",
    "index_recall": hits_sql() + " SELECT count(*) AS wanted, true AS found, true AS fewer FROM hits",
    "hybrid_entry": f"""{candidates_sql(20, LENGTH_RERANK)}, p AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, combined_score DESC, item_id) AS rr FROM c),
l AS (SELECT *, min(rerank_score) OVER (PARTITION BY query_id, rr <= 4) AS lo, max(rerank_score) OVER (PARTITION BY query_id, rr <= 4) AS hi FROM p),
f AS (SELECT *, rr > 4 AS filled, CASE WHEN rr <= 4 THEN 0.7 * combined_score + 0.3 * CASE WHEN hi = lo THEN 0.5 ELSE (rerank_score - lo) / (hi - lo) END ELSE combined_score END AS final_score FROM l)
SELECT query_id, item_id, row_number() OVER (PARTITION BY query_id ORDER BY filled, f.final_score DESC, item_id) AS rank, round(combined_score, 6)::DOUBLE AS combined_score, round(rerank_score, 6)::DOUBLE AS rerank_score, round(f.final_score, 6)::DOUBLE AS final_score FROM f QUALIFY rank <= {K}""",
    "hybrid_off": hits_sql().replace("q.vec_id <> i.vec_id", "true") + " SELECT query_id, item_id, rank, score AS final_score FROM hits",
    "rule_match_category": f"WITH {KEYWORD_SQL} SELECT doc_id, round(score * 0.5, 6)::DOUBLE AS rule_score, matched AS matched_words FROM m JOIN documents USING (doc_id) WHERE lang = 'en'",
    "triplet_search_exact": f"""WITH {TRIPLETS_SQL} SELECT query, triplet_id, CASE WHEN lower(subject) = query THEN 'subject' WHEN predicate = query THEN 'predicate' ELSE 'object' END AS match_type, 1.0::DOUBLE AS score
FROM t JOIN {ASK_SQL} q ON query IN (lower(subject), predicate, lower(object))""",
    "triplet_index": f"""WITH e AS (SELECT doc_id, unnest(regexp_extract_all(lang || chr(10) || coalesce(text, ''), '{RE_IS}', 1)) AS s, unnest(regexp_extract_all(lang || chr(10) || coalesce(text, ''), '{RE_IS}', 2)) AS o FROM documents)
SELECT (SELECT count(*) FROM (SELECT DISTINCT * FROM e)) AS extracted, (SELECT count(*) FROM (SELECT DISTINCT s, o FROM e)) AS stored""",
    "triplets_of_chunk": f"WITH {TRIPLETS_SQL} SELECT chunk_id, count(*) AS n, min(triplet_id) AS first_id FROM t GROUP BY chunk_id",
    "search_dedup": hits_sql() + """ SELECT query_id, item_id, score, rank FROM hits JOIN documents ON doc_id = item_id
QUALIFY row_number() OVER (PARTITION BY query_id, source || '_' || substr(text, 1, 200) ORDER BY rank) = 1""",
    "keyword_score": f"WITH {KEYWORD_SQL} SELECT doc_id, coalesce(matched, '') AS matched, round(coalesce(score, 0)::DOUBLE, 6) AS score FROM documents LEFT JOIN m USING (doc_id)",
    "section_ref_parse": f"""WITH {REFS_SQL} SELECT id, article, clause, subclause, title, '제' || article || '조' || coalesce('(' || title || ')', '') || coalesce(' ' || clause || '항', '') || coalesce(' ' || subclause || '호', '') AS shown,
  CASE WHEN regexp_matches(query, '{rules.LOOSE}') THEN '제' || regexp_extract(query, '{rules.LOOSE}', 1) || '조' || coalesce(' 제' || nullif(regexp_extract(query, '{rules.LOOSE}', 2), '') || '항', '') END AS loose FROM refs""",
    "section_match": f"""WITH {REFS_SQL}, titles AS (SELECT tid, title AS t, try_cast(regexp_extract(title, '{HEADER_SQL}', 1) AS INT) AS n FROM {fx.sql(fx.TITLE_SCHEMA, fx.TITLES)})
SELECT id, tid FROM refs JOIN titles ON n = article AND (title IS NULL OR contains(t, title))""",
    "rule_match": f"WITH {KEYWORD_SQL} SELECT doc_id, round(score * 0.5, 6)::DOUBLE AS rule_score, matched AS matched_words FROM m",
    "rule_boost": f"""WITH {REFS_SQL}, titles AS (SELECT tid, title AS t, try_cast(regexp_extract(title, '{HEADER_SQL}', 1) AS INT) AS n FROM {fx.sql(fx.TITLE_SCHEMA, fx.TITLES)})
SELECT id, tid, CASE WHEN coalesce(n = article AND (title IS NULL OR contains(t, title)), false) THEN 1.0 ELSE round((0.9 + 0.8 + 0.7) / 3 * 0.5, 6) END::DOUBLE AS rule_score FROM refs, titles""",
    "get_section": f"""WITH s AS (SELECT id, document_title, section_title, vector::DOUBLE[] AS v FROM {fx.sql(SECTION_SCHEMA, SECTIONS)}), r AS (SELECT id AS request, section, vector::DOUBLE[] AS v FROM {fx.sql(REQUEST_SCHEMA, REQUESTS)}),
h AS (SELECT request, section, document_title, section_title, row_number() OVER (PARTITION BY request ORDER BY list_cosine_similarity(r.v, s.v) DESC, id) AS rank FROM r, s QUALIFY rank <= 5),
p AS (SELECT *, contains(coalesce(section_title, ''), section) AS own FROM h)
SELECT request, document_title, section_title, CASE WHEN NOT own THEN 'Exact section not found, returning best match' END AS note FROM p QUALIFY row_number() OVER (PARTITION BY request ORDER BY NOT own, rank) = 1""",
    "triplet_extract": """SELECT substr(md5(concat_ws(':', subject, predicate, object)), 1, 12) AS triplet_id, * FROM (VALUES ('회사', '제한_가능', '서비스 이용', 'c1'), ('이용자', '의무', '요금', 'c2'), ('회사', '면책', '천재지변', 'c3'), ('이용자', '정', '서비스에 접속하는 자', 'c4'),
  ('고객', '금지', '타인의 정보 도용', 'c6'), ('회사', '면책', '통신 장애', 'c8'), ('당사', '면책', '정전', 'c8')) AS t(subject, predicate, object, chunk_id)""",
    "triplet_extract_documents": f"WITH {TRIPLETS_SQL} SELECT * FROM t",
    "triplet_search": f"WITH {TRIPLETS_SQL}, {TRIPLET_HITS_SQL} SELECT query, triplet_id, match_type, round(score, 6) AS score FROM h",
    "triplet_chunk_score": f"""WITH {TRIPLETS_SQL}, {TRIPLET_HITS_SQL}, s AS (SELECT query, chunk_id, sum(score) AS total FROM h GROUP BY ALL)
SELECT query, chunk_id, round(total, 6) AS total, round(total / max(total) OVER (PARTITION BY query), 6) AS triplet_score FROM s""",
    "hybrid_combined": f"""{CANDIDATES_SQL} SELECT query_id, item_id, score, round(rule_score, 6)::DOUBLE AS rule_score, round(triplet_score, 6)::DOUBLE AS triplet_score, combined_score::DOUBLE AS combined_score,
  row_number() OVER (PARTITION BY query_id ORDER BY combined_score DESC, item_id) AS place FROM c QUALIFY place <= {K}""",
    "hybrid_rerank_blend": f"{CANDIDATES_SQL}, l AS (SELECT *, min(rerank_score) OVER (PARTITION BY query_id) AS lo, max(rerank_score) OVER (PARTITION BY query_id) AS hi FROM c) SELECT query_id, item_id, combined_score::DOUBLE AS combined_score, rerank_score, round({BLEND}, 9)::DOUBLE AS final_score FROM l",
    "hybrid_fill": f"""{CANDIDATES_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY coalesce(rerank_score, '-inf'::DOUBLE) DESC, combined_score DESC, item_id) AS rr FROM c),
l AS (SELECT *, min(rerank_score) OVER (PARTITION BY query_id, rr <= 4) AS lo, max(rerank_score) OVER (PARTITION BY query_id, rr <= 4) AS hi FROM r),
f AS (SELECT *, CASE WHEN rr <= 4 THEN 0 ELSE 1 END AS block, CASE WHEN rr <= 4 THEN {BLEND} ELSE combined_score END AS final_score FROM l)
SELECT query_id, item_id, block, round(final_score, 5)::DOUBLE AS final_score FROM f QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY block, f.final_score DESC, item_id) <= 8""",
    "search_explanation": f"""{CANDIDATES_SQL}, l AS (SELECT *, min(rerank_score) OVER (PARTITION BY query_id) AS lo, max(rerank_score) OVER (PARTITION BY query_id) AS hi FROM c),
f AS (SELECT *, CASE WHEN rerank_score IS NOT NULL THEN round({BLEND}, 6)::DOUBLE END AS final FROM l)
SELECT query_id, item_id, concat_ws(' | ', '벡터 유사도: ' || printf('%.2f', round(vector_score, 6)::DOUBLE), CASE WHEN rule_score > 0 THEN '규칙 매칭: ' || printf('%.2f', rule_score::DOUBLE) || ' (키워드: ' || matched || ')' END,
  CASE WHEN triplet_score > 0 THEN '관계 매칭: ' || printf('%.2f', round(triplet_score, 6)::DOUBLE) || ' (' || triplet || ')' END, '재랭킹: ' || printf('%.2f', rerank_score::DOUBLE), '재랭킹 반영: ' || printf('%.2f', final),
  '최종 점수: ' || printf('%.2f', coalesce(final, round(combined_score, 6))::DOUBLE)) AS explanation FROM f""",
    "route_bands": f"""SELECT id, CASE WHEN s >= 0.8 THEN 'faq_ok' WHEN s >= 0.7 THEN 'faq_mid' ELSE 'sections' END AS faq_route,
  CASE WHEN s >= 0.65 THEN 'section_ok' WHEN s >= 0.55 THEN 'section_mid' WHEN s >= 0.4 THEN 'section_low' ELSE 'none' END AS section_route FROM (SELECT id, coalesce(score, 0) AS s FROM {fx.sql(fx.BAND_SCHEMA, fx.BANDS)})""",
    "route_search": hits_sql() + " SELECT query_id, CASE WHEN s >= 0.6 THEN 'faq_ok' WHEN s >= 0.5 THEN 'faq_mid' WHEN s >= 0.45 THEN 'section_ok' WHEN s >= 0.4 THEN 'section_mid' WHEN s >= 0.35 THEN 'section_low' ELSE 'none' END AS route FROM hits WHERE rank = 1",
    "word_section": f"""SELECT lang, word, coalesce(min(doc_id) FILTER (contains(lower(coalesce(text, '')), word)), min(doc_id)) AS doc_id, min(doc_id) FILTER (contains(lower(coalesce(text, '')), word)) IS NULL AS inexact
FROM documents, {WEIGHTS_SQL} w GROUP BY lang, word""",
    "list_documents": "SELECT source, count(*) AS n, count(DISTINCT lang) AS n_langs FROM documents GROUP BY source",
}
