"""Rules and operators on literal rows."""

import difflib
import hashlib
import json
import math
import os
import random
import re
import threading
import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corvid.functions import morphs
from corvid.functions.text import fixed, sha_id, tokens, ustrip
from corvid.functions.vectors import clamp, cosine, unit
from corvid import models, providers
from corvid.operators import cases, hybrid, index, ingest, judging, metrics, pages, results, routing, rules, search, tree, triplets, verification
from corvid.plans import answer
from corvid.plans import fixtures as fx
from corvid.providers import Providers
from corvid.sources import config, files, sinks
from corvid.sources.collection import Collection
from corvid.streaming.ingest import stream_faq


def one(spark, schema, rows, column):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(column).collect()]


def test_chunks_fall_back_from_given_to_parsed_to_whole(spark):
    schema = "title string, content string, sections array<struct<title:string,content:string>>"
    parsed = "머리말\n\n제1조(목적)\n이 약관은 목적을 정한다.\n 제2조 (환불)\n환불은 된다. 길게 쓴다."
    rows = [("a", parsed, None), ("b", parsed, [("s", "given content here")]), ("c", "no header at all", []), ("d", parsed, [(None, ""), ("", "x")]), ("e", None, None), ("f", "x" * 3000, None)]
    got = {}
    for r in ingest.chunks(spark.createDataFrame(rows, schema), "title", "content", "sections").collect():
        got.setdefault(r["title"], []).append((r["section_title"], r["section_content"], r["parent_content"]))
    assert [x[0] for x in got["a"]] == ["제1조(목적)", "제2조 (환불)"] == [x[0] for x in got["d"]]
    assert got["a"][0][2] == "" and got["a"][1][2].startswith("제1조(목적)")
    assert [x[:2] for x in got["b"]] == [("s", "given content here")]
    assert got["c"] == [("c", "no header at all", "")]
    assert "e" not in got and len(got["f"][0][1]) == 2000


def test_ids_ignore_what_lies_beyond_their_prefix(spark):
    rows = [("q", "a" * 200 + "x"), ("q", "a" * 200 + "y"), ("q", "b")]
    ids = one(spark, "q string, a string", rows, ingest.faq_id(F.col("q"), F.col("a")))
    assert ids[0] == ids[1] != ids[2] and all(len(i) == 16 for i in ids)


def test_collection_is_idempotent(spark, tmp_path):
    c = Collection(spark, str(tmp_path / "faq"), "id string, question string")
    rows = spark.createDataFrame([("1", "a", 0), ("1", "b", 1), ("2", "c", 2)], "id string, question string, pos long")
    c.add(rows, "pos")
    c.add(rows, "pos")
    assert sorted(map(tuple, c.scan().collect())) == [("1", "a"), ("2", "c")]
    c.delete(spark.createDataFrame([("1",)], "id string"))
    assert c.count() == 1
    c.clear()
    assert c.count() == 0


def test_stream_adds_each_pair_once(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    pair = {"question": "q", "answer": "a"}
    (folder / "1.json").write_text("\n".join(map(json.dumps, [pair, pair, {"question": "", "answer": "a"}])))
    c = Collection(spark, str(tmp_path / "faq"), "id string, question string, answer string")
    stream_faq(spark, str(folder), c, str(tmp_path / "check")).awaitTermination()
    (folder / "2.json").write_text(json.dumps(pair) + "\n" + json.dumps({"question": "r", "answer": "b"}))
    stream_faq(spark, str(folder), c, str(tmp_path / "check")).awaitTermination()
    assert sorted(r["question"] for r in c.scan().collect()) == ["q", "r"]


def test_files(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([{"question": "q", "answer": "a"}, {"question": "r"}]))
    assert [r["question"] for r in files.read_faq(spark, str(tmp_path / "a.json")).orderBy("pos").collect()] == ["q", "r"]
    assert files.diagnose(spark, str(tmp_path / "none.json"), "question string")[1] == "missing"
    (tmp_path / "b.json").write_text("{not json")
    assert files.diagnose(spark, str(tmp_path / "b.json"), "question string")[1] == "invalid"
    (tmp_path / "c.json").write_text(json.dumps({"version": "1", "items": [{"question": "q1", "id": "x"}, {"question": "q2"}]}))
    assert sorted(r["id"] for r in files.read_cases(spark, str(tmp_path / "c.json")).collect()) == ["legacy_1", "x"]


def test_weights():
    w = hybrid.Weights(1, 1, 2)
    assert (w.vector, w.rule, w.triplet) == (0.25, 0.25, 0.5)
    with pytest.raises(ValueError):
        hybrid.Weights(0, 0, 0)
    with pytest.raises(ValueError):
        hybrid.Weights(rerank=1.5)
    with pytest.raises(ValueError):
        routing.Bands(0.5, 0.7)
    for bands in ((5, 3, 2, 1.5, 1), (0.8, 0.7, 0.6, 0.5, -0.1)):
        with pytest.raises(ValueError):
            routing.Bands(*bands)


def test_rerank_blend_edges(spark):
    rows = [(1, 1, 0.5, 2.0), (1, 2, 0.4, 4.0), (1, 3, 0.3, float("nan")), (1, 4, 0.2, float("inf")), (1, 5, 0.1, None), (2, 1, 0.6, 1.0), (2, 2, 0.2, 1.0)]
    df = spark.createDataFrame(rows, "q int, item int, combined_score double, rerank_score double")
    got = {(r["q"], r["item"]): round(r["final_score"], 6) for r in hybrid.rerank_blend(df, 0.3, "q").collect()}
    assert got == {(1, 1): 0.35, (1, 2): 0.58, (1, 3): 0.3, (1, 4): 0.2, (1, 5): 0.1, (2, 1): 0.57, (2, 2): 0.29}


def test_bleu_matches_a_restatement(spark):
    def words(t):
        return [w for w in re.sub(r"[^\w\s가-힣]", " ", t).split() if w]

    def bleu(r, c):
        r, c = words(r), words(c)
        if not r or not c:
            return 0.0
        p = []
        for n in range(1, 5):
            want = [r[k : k + n] for k in range(len(r) - n + 1)]
            have = [c[k : k + n] for k in range(len(c) - n + 1)]
            p.append(sum(g in want for g in have) / len(have) if have else 0.0)
        return 0.0 if not any(p) else math.exp(sum(math.log(max(x, 1e-10)) for x in p) / 4) * (1 if len(c) >= len(r) else math.exp(1 - len(r) / len(c)))

    rows = [("a b c d e", "a b c d e"), ("a b c d e", "a b c"), ("a b", "x y z w v"), ("", "a"), ("a", ""), ("가 나 다 라 마 바", "가 나, 다 라 사"), ("a b c d e f g h", "a b c d x y")]
    got = one(spark, "r string, c string", rows, metrics.bleu(F.col("r"), F.col("c")))
    assert all(math.isclose(x, bleu(r, c), abs_tol=1e-12) for x, (r, c) in zip(got, rows))


def test_missing_scores_are_neutral(spark):
    s = judging.judge_scores(F.col("r"))
    assert one(spark, "r string", [("none",)], s["overall"]) == [3.0]
    assert one(spark, "x double", [(None,), (7.0,), (-1.0,)], clamp(F.col("x"))) == [None, 1.0, 0.0]
    assert one(spark, "a array<double>, b array<double>", [(None, [1.0])], metrics.similarity(F.col("a"), F.col("b"))) == [0.0]


def test_keyword_inside_a_keyword_counts_twice(spark):
    m = rules.matched_keywords(F.col("q"), F.col("c"))
    assert one(spark, "q string, c string", [("손해배상", "손해배상 책임"), ("x", "y")], F.round(rules.keyword_score(m), 6)) == [0.75, 0.0]


def test_triplets(spark):
    rows = triplets.store(triplets.extract_all(fx.rows(spark, fx.CHUNK_SCHEMA, fx.CHUNKS), "chunk_id", F.col("text"))).collect()
    found = {(r["subject"], r["predicate"], r["object"]): r["chunk_id"] for r in rows}
    assert found[("회사", "제한_가능", "서비스 이용")] == "c1" and ("회사", "면책", "천재지변") in found
    exact = triplets.search(spark.createDataFrame([("회사",)], "query string"), spark.createDataFrame(rows), fuzzy=False).collect()
    assert exact and {r["match_type"] for r in exact} == {"subject"} and {r["score"] for r in exact} == {1.0}


def test_full_width_digits(spark):
    assert one(spark, "q string", [("제５조",)], rules.section_reference(F.col("q"))["article"]) == [5]
    assert one(spark, "q string", [("　a ",)], ustrip(F.col("q"))) == ["a"]
    assert one(spark, "q string", [("a.b, c",)], tokens(F.col("q"))) == [["a", "b", "c"]]


def test_citations_and_gate(spark):
    valid = verification.citations_valid(F.col("a"), F.col("t"), required=False)
    assert one(spark, "a string, t array<string>", [("x", []), ("[참조: 제9조]", ["제3조(가)"]), ("[출처: FAQ]", ["제3조(가)"])], valid) == [True, False, True]
    assert one(spark, "s string, m string", [("faq", "answer"), ("sections", "answer")], verification.gated(F.col("s"), F.col("m"), F.lit(0.2), 1.0)) == [1.0, 0.2]


def test_dates_and_handlers(spark):
    assert one(spark, "t string", [("시행일: 2023.5.7",)], pages.effective_date(F.col("t"))) == ["2023-05-07"]
    assert one(spark, "t string", [("doView('78','1')",), ("x",)], pages.view_parameters(F.col("t"))["num"]) == ["78", ""]


def test_page_parts(spark):
    page = "<h2>A &b</h2> <p>one <b>two</b></p><h2>C</h2><span>x</span><table><tr><td>1</td><td><a onclick=\"doView('7','2')\">t</a></td></tr><tr><td>1</td><td>2</td></tr><tr><td><a>3</a></td></tr></table>"
    page += '<dt class="question">질문 왜?</dt><dd class="answer">답변  그래서</dd>'
    h = F.col("h")
    assert one(spark, "h string", [(page,)], pages.heading_sections(h)) == [[("A &b", "one two")]]
    assert [[(list(r["cells"]), r["onclick"]) for r in x] for x in one(spark, "h string", [(page,)], pages.table_rows(h))] == [[(["1", "t"], "doView('7','2')")]]
    assert one(spark, "h string", [(page,)], pages.faq_items(h)) == [[("왜?", "그래서")]]


def test_approximate_pairs_are_true_pairs(spark):
    v = spark.createDataFrame([(k, [float(k % 3 == j) + 0.01 * k * (j == 1) for j in range(3)]) for k in range(9)], "vec_id long, embedding array<double>")
    got = {(r["query_id"], r["item_id"]): r["score"] for r in search.approximate_pairs(v, v, 0.99).collect()}
    exact = {(r["query_id"], r["item_id"]): r["score"] for r in search.top_k(v, v, 9, exclude_self=False, threshold=0.99).collect()}
    assert got and all(abs(exact[k] - s) < 1e-5 for k, s in got.items())


def test_top_k_edges(spark):
    rows = [(1, [1.0, 0.0], 1), (2, [1.0, 0.0], 2), (3, [0.0, 1.0], 1), (4, None, 1), (5, [0.0, 0.0], 1), (6, [1.0], 1)]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = [(r["query_id"], r["item_id"], r["score"]) for r in search.top_k(v, v, 1).orderBy("query_id").collect()]
    assert got == [(1, 2, 1.0), (2, 1, 1.0), (3, 1, 0.0)]
    assert search.top_k(v.limit(0), v, 1).count() == 0
    assert one(spark, "a array<double>", [([3.0, 4.0],)], F.round(cosine(F.col("a"), F.col("a")), 9)) == [1.0]


def answering(spark):
    q = spark.createDataFrame([(1, "a", [1.0, 0.0]), (2, "b", [0.0, 1.0]), (3, "c", [-1.0, 0.0])], "id long, query string, vector array<double>")
    faq = spark.createDataFrame([(10, [1.0, 0.01], "question", "reply"), (11, [1.0, 0.3], "other", "more")], "id long, vector array<double>, question string, answer string")
    sections = spark.createDataFrame([(20, [0.1, 1.0], "d", "제1조(가)", "text")], "id long, vector array<double>, document_title string, section_title string, section_content string")
    return q, faq, sections


def test_answers_route_and_verify(spark):
    q, faq, sections = answering(spark)
    x = answer.answers(q, faq, sections, use_hybrid=False)
    got = {r["id"]: r for r in x.collect()}
    assert {i: (r["source"], r["response_mode"]) for i, r in got.items()} == {1: ("faq", "answer"), 2: ("sections", "answer"), 3: ("no_context", "handoff")}
    assert got[1]["citations"] == ["FAQ: question"] and got[1]["answer"] == "Q: question\nA: reply\n\nQ: other\nA: more"
    assert got[2]["citations"] == ["d - 제1조(가)"] and got[3]["answer"] == answer.NOTHING
    # An answer from sections must cite; those from pairs are not checked.
    assert [(got[i]["verified"], got[i]["verification_score"], got[i]["verification_issues"]) for i in (1, 2)] == [(True, 1.0, []), (False, 0.7, [verification.UNCITED])]
    x = answer.answers(q.withColumn("query", F.lit("3조 2항")), faq, sections, use_hybrid=False)
    first, second, third = (r["metadata"] for r in x.orderBy("id").collect())
    assert (first["route"], first["confidence_band"], second["section_reference"], second["hybrid_search"], third["route"]) == ("faq_ok", None, "제3조 제2항", None, "none")


def test_sections_go_through_the_hybrid_search(spark):
    q, faq, sections = answering(spark)
    more = sections.union(spark.createDataFrame([(21, [0.3, 1.0], "d", "제2조(나)", "x")], sections.schema))
    r = answer.answers(q.filter("id = 2").withColumn("query", F.lit("제2조 설명")), faq, more, bands=routing.Bands(section=0.6)).first()
    assert [h["section_title"] for h in r["context"]] == ["제2조(나)", "제1조(가)"] and r["metadata"]["hybrid_search"] is True and round(r["context"][0]["scores"]["rule_score"], 6) == 1.0


def test_answers_without_items_or_verification(spark):
    q, faq, sections = answering(spark)
    none = answer.answers(q, faq.limit(0), sections.limit(0)).collect()
    assert {(r["source"], r["confidence"], r["metadata"]["route"]) for r in none} == {("no_context", 0.0, "none")} and len(none) == 3
    assert answer.answers(q.limit(0), faq, sections).count() == 0
    off = answer.answers(q.filter("id = 2"), faq, sections, verify=False, use_hybrid=False).first()
    assert (off["verified"], off["verification_score"], off["verification_issues"], off["metadata"]["verification_reasoning"]) == (True, 1.0, [], None)


def test_a_model_is_asked_once_a_query(spark):
    """The first search and the answers are computed once, whichever branches a query takes."""
    q, faq, sections = answering(spark)
    asked = spark.sparkContext.accumulator(0)

    def counting(texts):
        for t in texts:
            asked.add(len(t))
            yield t

    model = F.pandas_udf(counting, "string", F.PandasUDFType.SCALAR_ITER)
    answer.answers(q, faq, sections, providers=Providers(generate=lambda prompt, context: model(context)), use_hybrid=False).collect()
    assert asked.value == 3


def test_a_refused_answer_is_not_verified(spark):
    v = verification.verify(F.col("a"), F.array(F.lit("제1조(가)")), F.col("r"))
    rows = [("x [참조: 제1조]", '{"verified": false, "confidence": 0.9, "issues": ["unsupported"]}'), ("x", '{"verified": true, "confidence": 1.0}'), ("x [참조: 제1조]", '{"confidence": 0.6, "issues": ["not counted"]}'), ("x [참조: 제1조]", "{}")]
    got = [(r["verified"], round(r["confidence"], 6), r["issues"]) for r in one(spark, "a string, r string", rows, v)]
    assert got == [(False, 0.95, ["unsupported"]), (False, 0.85, [verification.UNCITED]), (True, 0.8, []), (True, 1.0, [])]


def test_evaluation_of_failed_and_missing_answers(spark):
    q, faq, sections = answering(spark)
    rows = q.select("id", F.col("query").alias("question"), F.lit("Q question A reply").alias("expected_answer"), F.lit("c").alias("category"), "vector")
    x = answer.evaluated_answers(rows, lambda c: answer.answers(c, faq, sections, use_hybrid=False).filter("id < 3").withColumn("error", F.when(F.col("id") == 2, "down")))
    got = {r["id"]: r for r in x.collect()}
    assert got[2]["generated"] == "[Error: down]" and got[3]["generated"] == "[Error: no response]" and got[1]["bleu"] > got[2]["bleu"] == 0.0


def test_report(spark):
    models = spark.createDataFrame([("m", 0.5, 0.25, 1.0, 2.0, 1.0)], "model string, mean_similarity double, mean_bleu double, mean_faithfulness double, mean_latency_ms double, verification_rate double")
    cats = spark.createDataFrame([("c", "m", 0.5, 0.25, 3)], "category string, model string, mean_similarity double, mean_bleu double, n int")
    assert "| m | 0.500 | 0.250 | 1.000 | 2.0 | 100.0% |" in sinks.markdown(models, cats)
    assert one(spark, "a string, b string", [("x", "y")], F.length(sha_id(F.col("a"), F.col("b")))) == [16]


def test_chunk_ids_tell_titles_apart(spark):
    rows = [("d", "제1조(가)", "x"), ("d", "제2조(나)", "x"), ("d", "제1조(가)", "x")]
    ids = one(spark, "d string, t string, c string", rows, ingest.chunk_id(F.col("d"), F.col("t"), F.col("c")))
    assert ids[0] == ids[2] != ids[1]
    assert ids[0] == hashlib.sha256("d_제1조(가)_x".encode()).hexdigest()[:16]


def test_long_documents_keep_their_sections(spark):
    text = "\n".join(line for k in range(1, 1501) for line in (f"제{k}조(항목)", f"내용 {k}", "", "둘째 줄"))
    got = one(spark, "t string", [(text,), ("없음",), ("",), ("제1조(가)",)], ingest.sections(F.col("t")))
    assert [(s["title"], s["content"]) for s in got[0]] == [(f"제{k}조(항목)", f"내용 {k}\n둘째 줄") for k in range(1, 1501)]
    assert got[1:3] == [[], []] and [(s["title"], s["content"]) for s in got[3]] == [("제1조(가)", "")]


def test_fixed_digits_round_as_c_does(spark):
    r = random.Random(1)
    values = [0.125, 0.375, 2.675, 0.425, 0.0, 1.0, 0.005, 0.015, -0.125, -0.001, 99999.995, 0.445, 123456.789] + [r.random() * 10 ** r.randrange(-3, 6) for _ in range(300)]
    for digits in (1, 2, 4):
        want = [f"{v:.{digits}f}" for v in values]
        want = [w.removeprefix("-") if float(w) == 0 else w for w in want]
        assert one(spark, "x double", [(v,) for v in values], fixed(F.col("x"), digits)) == want


def test_equal_vectors_tie_by_id(spark):
    """Equal pairs get equal scores wherever they stand in a block."""
    r = random.Random(2)
    base = [[r.gauss(0, 1) for _ in range(33)] for _ in range(7)]
    v = spark.createDataFrame([(k, base[k % 7]) for k in range(700)], "vec_id long, embedding array<double>")
    for row in search.top_k(v.filter("vec_id < 7"), v, 5).collect():
        assert row["item_id"] == row["query_id"] + 7 * row["rank"]


def test_scores_meet_thresholds_unrounded(spark):
    a, b = [1.0, 0.0], [0.8999996, math.sqrt(1 - 0.8999996**2)]
    v = spark.createDataFrame([(1, a), (2, b)], "vec_id long, embedding array<double>")
    assert {r["query_id"]: r["inserted"] for r in search.near_duplicate_gate(v, threshold=0.9).collect()} == {1: True, 2: True}


def test_gate_is_sequential(spark):
    """A row that was turned away blocks no later one."""
    at = lambda degrees: [math.cos(math.radians(degrees)), math.sin(math.radians(degrees))]
    v = spark.createDataFrame([(k, at(20.0 * k)) for k in range(6)] + [(6, None), (7, at(0.0))], "vec_id long, embedding array<double>")
    got = {r["query_id"]: (r["best_id"], r["inserted"]) for r in search.near_duplicate_gate(v, threshold=0.9).collect()}
    assert got == {0: (None, True), 1: (0, False), 2: (0, True), 3: (2, False), 4: (2, True), 5: (4, False), 6: (None, True), 7: (0, False)}
    old = spark.createDataFrame([(100, at(60.0))], "vec_id long, embedding array<double>")
    got = {r["query_id"]: r["inserted"] for r in search.near_duplicate_gate(v, old, 0.9).collect()}
    assert got == {0: True, 1: False, 2: False, 3: False, 4: False, 5: True, 6: True, 7: False}


def test_question_files(spark, tmp_path):
    forms = [[{"question": "a"}, {"q": "b", "difficulty": "hard"}], {"questions": [{"question": "a"}, {"question": "b"}]}, {"items": [{"question": "a", "category": "c", "difficulty": "hard"}, {"question": "b"}]}]
    for k, form in enumerate(forms):
        (tmp_path / f"{k}.json").write_text(json.dumps(form))
        rows = files.read_questions(spark, str(tmp_path / f"{k}.json")).orderBy("n").collect()
        assert [r["question"] for r in rows] == ["a", "b"] and [r["difficulty"] for r in rows] == ["medium", "hard" if k == 0 else "medium"]
    (tmp_path / "bad.json").write_text(json.dumps({"other": 1}))
    with pytest.raises(Exception, match="no list of questions"):
        files.read_questions(spark, str(tmp_path / "bad.json")).collect()


def test_legacy_cases_are_numbered_by_place(spark, tmp_path):
    (tmp_path / "list.json").write_text(json.dumps([{"question": f"q{k}", "expected_answer": "a" if k % 2 else ""} for k in range(50)]))
    rows = files.read_cases(spark, str(tmp_path / "list.json")).orderBy("n").collect()
    assert [(r["id"], r["question"]) for r in rows] == [(f"legacy_{k}", f"q{k}") for k in range(50)]
    assert files.read_usable_cases(spark, str(tmp_path / "list.json")).count() == 25
    (tmp_path / "object.json").write_text("{}")
    with pytest.raises(Exception, match="a list of cases"):
        files.read_usable_cases(spark, str(tmp_path / "object.json")).collect()


def test_agent_answer_files(spark, tmp_path):
    (tmp_path / "good.json").write_text(json.dumps([{"question": " q ", "answer": "a", "session_id": "s", "created_at": "t"}, {"question": "", "answer": "a"}, {"question": "r", "answer": "b"}]))
    (tmp_path / "broken.json").write_text("[{")
    (tmp_path / "object.json").write_text("{}")
    got = lambda name: tuple(files.agent_answers_or_error(spark, str(tmp_path / name), "now").collect()[0])
    assert got("good.json") == (True, 2, 1, 0, [])
    assert got("broken.json") == (False, 0, 0, 1, ["JSON 파싱 오류"]) and got("object.json") == (False, 0, 0, 1, ["JSON 형식 오류: 배열이 아닙니다."])
    assert not got("none.json")[0] and "none.json" in got("none.json")[4][0]
    rows = ingest.agent_answers(files.read_agent_answers(spark, str(tmp_path / "good.json")), "now").orderBy("pos").collect()
    assert [r["id"] for r in rows] == [hashlib.sha256(b"q_s_t").hexdigest()[:16], None, hashlib.sha256(b"r_now").hexdigest()[:16]]


def test_results_files(spark, tmp_path):
    (tmp_path / "r.json").write_text(json.dumps({"model_name": "m", "total_cases": 3, "metrics": {"mean_bleu": 0.5}, "verification": {"verified_count": 2}, "category_scores": {"c": {"n": 1.0}}}))
    (tmp_path / "s.json").write_text("{}")
    rows = files.read_results(spark, str(tmp_path)).orderBy(F.desc("total_cases")).collect()
    assert [(r["model"], r["total_cases"], r["mean_bleu"], r["mean_similarity"], r["verified_count"]) for r in rows] == [("m", 3, 0.5, 0.0, 2), ("unknown", 0, 0.0, 0.0, 0)]


def test_datasets_round_trip(spark, tmp_path):
    q = spark.createDataFrame([("why?", "c", "hard", [("d1", None, None, None, "because", None, None)]), ("how?", None, None, None), ("odd", None, "none", None)], "question string, category string, difficulty string, context array<struct<doc_id:string,id:string,source:string,section_title:string,content:string,question:string,answer:string>>")
    items = cases.golden_items(q, lambda prompt, context: F.when(context != "", context).otherwise("unknown"), "now")
    sinks.write_dataset(items, str(tmp_path / "set"), "m", "p", "now")
    back = {r["question"]: r for r in files.read_cases(spark, str(tmp_path / "set")).collect()}
    assert set(back) == {"why?", "how?"} and back["why?"]["id"] == hashlib.sha256(b"why?_now").hexdigest()[:12] and back["why?"]["expected_sources"] == ["d1"]
    assert sorted(tuple(r) for r in cases.legacy(items).collect()) == [("how?", "unknown", ""), ("why?", "because", "c")]
    assert len(cases.golden_set("sections")) == 35 and len(cases.golden_set("adversarial")) == 40


def test_triplet_files(spark, tmp_path):
    rows = fx.rows(spark, "id string, section_title string, section_content string", [(c, "", t) for c, t in fx.CHUNKS])
    kept, counts = triplets.build_index(rows)
    triplets.save(kept, str(tmp_path / "t"))
    assert sorted(map(tuple, triplets.load(spark, str(tmp_path / "t")).select(*kept.columns).collect())) == sorted(map(tuple, kept.collect()))
    n = counts.first()
    assert n["extracted"] > n["stored"] == kept.count() and triplets.by_chunk(kept, "c1").count() == 1 and triplets.by_chunk(kept, "c5").count() == 0
    triplets.clear(spark, str(tmp_path / "t"))
    assert triplets.load(spark, str(tmp_path / "t")).count() == 0


def test_configuration(tmp_path):
    pytest.importorskip("yaml")
    path = str(tmp_path / "c.yaml")
    with open(path, "w") as f:
        f.write("default_model: a\nmodels:\n  a: {name: model-a, dimension: 768, other: 1}\nreranker:\n  enabled: true\n  candidates: 7\n  weight: 0.4\n  default_model: r\n  models:\n    r: {name: rank, max_seq_length: 128}\nlimit: 5\nvalidate: false\n")
    assert config.embedding_config(path) == config.Embedding("model-a", 768) and config.embedding_config(None) == config.Embedding()
    with pytest.raises(ValueError):
        config.embedding_config(path, "z")
    h = config.hybrid_config(path)
    assert (h.rerank_enabled, h.rerank_candidates, h.weights.rerank, h.rerank_model, h.rerank_max_length) == (True, 7, 0.4, "rank", 128)
    e = config.evaluation_config(path, {"CORVID_LIMIT": "9", "CORVID_USE_JUDGE": "yes"})
    assert (e.limit, e.validate, e.use_judge) == (9, False, True) and config.shared_evaluation_config(path) is config.shared_evaluation_config(path)


def test_search_without_reranker_or_triplets(spark):
    q = spark.createDataFrame([(1, "제2조 환불", [1.0, 0.2])], "id long, query string, vector array<double>")
    c = spark.createDataFrame([(10, [1.0, 0.0], "제1조(목적)", "환불 약관"), (11, [0.0, 1.0], "제2조(환불)", "그 밖"), (12, [0.9, 0.1], None, None)], "id long, vector array<double>, section_title string, section_content string")
    got = hybrid.hybrid_search(q, c, None, n=3).orderBy("rank").collect()
    assert {r["item_id"]: round(r["rule_score"], 6) for r in got} == {10: 0.45, 11: 1.0, 12: 0.0} and all(r["final_score"] == r["combined_score"] and r["rerank_score"] is None for r in got)
    off = hybrid.hybrid_search(q, c, None, n=2, enabled=False).orderBy("rank").collect()
    assert [r["item_id"] for r in off] == [12, 10] and all(r["final_score"] == r["vector_score"] for r in off)


def test_tokens_plug_in(spark):
    stems = lambda c: F.transform(tokens(c), lambda w: F.substring(w, 1, 3))
    assert one(spark, "a string, b string", [("running walked talking jumped", "runner walker talker jumper")], F.round(metrics.bleu(F.col("a"), F.col("b"), tokenizer=stems), 6)) == [1.0]
    assert one(spark, "a string", [("x",)], providers.passage(F.col("a"))) == ["passage: x"] and one(spark, "a string", [("x",)], providers.query(F.col("a"))) == ["query: x"]


def test_sequence_ratio(spark):
    rows = [("abcd", "bcde"), (" same ", "same"), ("", ""), (None, "x"), ("가나다라", "나다")]
    m = metrics.lightweight(F.col("a"), F.col("b"))
    got = spark.createDataFrame(rows, "a string, b string").select(m["string_similarity"], m["exact_match"]).collect()
    strip = [((a or "").strip(), (b or "").strip()) for a, b in rows]
    assert [tuple(r) for r in got] == [(difflib.SequenceMatcher(None, a, b).ratio(), a == b) for a, b in strip]


def test_verifier_errors_and_absence(spark):
    f = cases.faithfulness(F.col("a"), F.lit(None).cast(f"array<{cases.ITEM}>"), error=F.col("e"))
    got = one(spark, "a string, e string", [("x", "down"), ("[참조: 없음]", None)], f)
    assert [tuple(r) for r in got] == [(0.5, False, ["down"]), (1.0, True, [])]
    assert tuple(one(spark, "a string", [("x",)], cases.faithfulness(F.col("a"), None, verifier=False))[0]) == (1.0, True, [])


def test_shared_folder_must_be_named_on_a_cluster():
    from corvid.sources import shared

    class Cluster:
        class conf:
            get = staticmethod(lambda key, default: default)

        class sparkContext:
            master, applicationId = "spark://host:7077", "a"

    with pytest.raises(ValueError):
        shared.shared_dir(Cluster)


def test_containments_equal_all_pairs(spark):
    r = random.Random(4)
    word = lambda: "".join(r.choice("ab회") for _ in range(r.randrange(0, 7)))
    q, k = {word() for _ in range(60)}, {word() for _ in range(200)}
    got = {(x["q"], x["k"]): x["score"] for x in triplets.containments(spark.createDataFrame([(x,) for x in q], "q string"), spark.createDataFrame([(x,) for x in k], "k string")).collect()}
    assert got == {(a, b): len(a) / max(len(a), len(b)) for a in q for b in k if a and b and (a in b or b in a)}


def test_first_field_that_matches_counts(spark):
    t = spark.createDataFrame([("1", "Alpha beta", "is", "alpha"), ("2", "x", "alphabet", "alpha"), ("3", None, "is", "ALPHA"), ("4", "x", "y", "z")], "triplet_id string, subject string, predicate string, object string")
    got = {(r["query"], r["triplet_id"]): (r["match_type"], round(r["score"], 6)) for r in triplets.search(spark.createDataFrame([("alpha",), ("is",)], "query string"), t).collect()}
    assert got == {("alpha", "1"): ("subject", 0.5), ("alpha", "2"): ("predicate", 0.625), ("alpha", "3"): ("object", 1.0), ("is", "1"): ("predicate", 1.0), ("is", "3"): ("predicate", 1.0)}


def test_a_collection_is_a_log(spark, tmp_path):
    path = str(tmp_path / "faq")
    c = Collection(spark, path, "id string, question string")
    put = lambda rows: spark.createDataFrame([(i, q, k) for k, (i, q) in enumerate(rows)], "id string, question string, pos int")
    assert c.count() == 0 and c.delete(put([("a", "")])) is None and c.compact() is None
    assert c.add(put([("a", "1"), ("b", "2"), ("a", "3")]), "pos") == 1
    first = sorted(os.listdir(path))
    assert c.add(put([("a", "4"), ("c", "5")]), "pos") == 2
    # An add writes its own rows and nothing else.
    new = [d for d in os.listdir(path) if d not in first]
    assert len(new) == 1 and spark.read.parquet(f"{path}/{new[0]}").collect()[0][0] == "c"
    assert c.add(put([("a", "6")]), "pos") is None and c.versions() == [1, 2]
    c.delete(put([("a", ""), ("zzz", "")]))
    assert sorted(map(tuple, c.scan().collect())) == [("b", "2"), ("c", "5")]
    c.add(put([("a", "7")]), "pos")
    assert sorted(map(tuple, c.scan().collect())) == [("a", "7"), ("b", "2"), ("c", "5")]
    assert sorted(map(tuple, c.scan(2).collect())) == [("a", "1"), ("b", "2"), ("c", "5")]
    c.compact()
    m = c.manifest()
    assert len(m["adds"]) == 1 and m["deletes"] == [] and sorted(map(tuple, c.scan().collect())) == [("a", "7"), ("b", "2"), ("c", "5")]
    c.delete(put([("c", "")]))
    assert sorted(map(tuple, c.scan().collect())) == [("a", "7"), ("b", "2")]
    c.clear()
    assert c.count() == 0
    c.add(put([("a", "8")]), "pos")
    assert [tuple(r) for r in c.scan().collect()] == [("a", "8")]


def test_writers_at_once_lose_nothing(spark, tmp_path):
    """Each writer adds ten keys of its own and five that all want; compaction and deletes run beside them."""
    path, seen = str(tmp_path / "faq"), []

    def write(w):
        c = Collection(spark, path, "id string, writer int")
        for k in range(2):
            rows = [(f"{w}-{k}-{n}", w, n) for n in range(5)] + [(f"all-{n}", w, 9) for n in range(5)]
            seen.append(c.add(spark.createDataFrame(rows, "id string, writer int, pos int"), "pos"))
        if w == 0:
            c.compact()
        if w == 1:
            c.delete(spark.createDataFrame([("1-0-0",)], "id string"))

    threads = [threading.Thread(target=write, args=(w,)) for w in range(4)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    got = [r["id"] for r in Collection(spark, path, "id string, writer int").scan().collect()]
    assert sorted(got) == sorted({f"{w}-{k}-{n}" for w in range(4) for k in range(2) for n in range(5)} - {"1-0-0"} | {f"all-{n}" for n in range(5)})
    assert len(set(seen)) == 8


def test_many_keys_are_joined_and_a_batch_happens_once(spark, tmp_path):
    c = Collection(spark, str(tmp_path / "faq"), "id string, n long")
    rows = spark.range(3000).select(F.col("id").cast("string").alias("id"), F.col("id").alias("n"))
    c.add(rows, "n", "s", 0)
    assert c.add(rows.union(spark.createDataFrame([("x", 1)], "id string, n long")), "n", "s", 0) is None and c.count() == 3000
    assert c.add(rows.union(spark.createDataFrame([("x", 1)], "id string, n long")), "n", "s", 1) == 2 and c.count() == 3001
    assert c.manifest()["adds"][-1]["rows"] == 1 and c.manifest()["batches"] == {"s": 1}


def test_stream_state_survives_restarts_and_replays(spark, tmp_path):
    folder, check = tmp_path / "in", tmp_path / "check"
    folder.mkdir()
    c = Collection(spark, str(tmp_path / "faq"), "id string, question string, answer string, category string")
    c.add(spark.createDataFrame([("q0", "a0", 0)], "question string, answer string, pos int").withColumn("id", ingest.faq_id(F.col("question"), F.col("answer"))), "pos")
    r, lines, counters = random.Random(3), [], []

    def drop(name, rows):
        (folder / name).write_text("".join(json.dumps({"question": q, "answer": a, "category": k}) + "\n" for q, a, k in rows))
        lines.extend(rows)

    def run():
        stream_faq(spark, str(folder), c, str(check), counters=counters, files_a_batch=1).awaitTermination()

    some = lambda k: [(f"q{r.randrange(12)}", f"a{r.randrange(2)}", f"{k}-{n}") for n in range(30)] + [("q0", "a0", "hot")] * 40 + [("", "a", "bad")]
    for k in range(2):
        drop(f"{k}.json", some(k))
        time.sleep(1.1)
    run()
    before = c.manifest()["version"]
    run()
    assert c.manifest()["version"] == before
    drop("2.json", some(2))
    run()
    # The last batch runs again as if the stream had died before it was marked done.
    last = sorted((check / "commits").glob("[0-9]*"), key=lambda p: int(p.name))[-1]
    for p in (last, last.with_name(f".{last.name}.crc")):
        p.unlink(missing_ok=True)
    run()
    want = {("q0", "a0"): None}
    for q, a, k in lines:
        if q and a:
            want.setdefault((q, a), k)
    assert {(x["question"], x["answer"]): x["category"] for x in c.scan().collect()} == want and c.count() == len(want)
    good = sum(1 for q, a, _ in lines if q and a)
    assert sum(x["rows"] for x in counters) == good and sum(x["added"] for x in counters) == len(want) - 1
    batch = spark.createDataFrame([(q, a, n) for n, (q, a, _) in enumerate(lines)], "question string, answer string, pos int").filter("question <> ''").withColumn("id", ingest.faq_id(F.col("question"), F.col("answer")))
    known = spark.createDataFrame([("q0", "a0")], "question string, answer string").select(ingest.faq_id(F.col("question"), F.col("answer")).alias("id"))
    status = {x["status"]: x["count"] for x in ingest.ingest_status(batch, known, "id", "pos").groupBy("status").count().collect()}
    assert sum(x["added"] for x in counters) == status["added"] and sum(x["skipped"] for x in counters) == good - status["added"]


def test_files_are_read_by_name(spark, tmp_path):
    """Spark packs large files first; the first pair still is that of the file whose name comes first."""
    (tmp_path / "a.json").write_text(json.dumps([{"question": "q", "answer": "x" * 200, "category": "first"}, {"question": "p", "answer": "y", "category": "second"}]))
    (tmp_path / "b.json").write_text(json.dumps([{"question": "q", "answer": "x" * 200, "category": "late"}] + [{"question": f"q{k}", "answer": "z" * 50, "category": "b"} for k in range(3000)]))
    rows = files.read_faq(spark, str(tmp_path)).filter("_corrupt_record is null")
    assert [r["category"] for r in rows.orderBy("pos").limit(3).collect()] == ["first", "second", "late"]
    c = Collection(spark, str(tmp_path / "faq"), "id string, question string, answer string, category string")
    c.add_pairs(rows, "pos")
    assert c.scan().filter("question = 'q'").first()["category"] == "first"


def test_single_pairs_and_documents_enter_a_collection(spark, tmp_path):
    c = Collection(spark, str(tmp_path / "faq"), "id string, question string, answer string, created_at string, source string")
    one_id = c.add_pair("q", "a", "t", source="web")
    assert one_id == hashlib.sha256(b"q_t").hexdigest()[:16] and c.add_pair("q", "b", "t") == one_id and c.add_pair("q", "a", "t", "own") == "own"
    c.add_pairs(spark.createDataFrame([("q", "a", 0), ("q", "a", 1), ("", "a", 2)], "question string, answer string, pos int").withColumns({"created_at": F.lit("t"), "source": F.lit("x")}), "pos")
    assert sorted(r["answer"] for r in c.scan().collect()) == ["a", "a", "a"]
    d = Collection(spark, str(tmp_path / "terms"), "id string, document_title string, section_title string, section_content string, parent_content string")
    docs = spark.createDataFrame([("약관", "제1조(목적)\n" + "가" * 1500 + "\n제2조(해지)\n해지는 된다. 언제든지.")], "title string, content string")
    d.add_documents(docs, "title", "content")
    d.add_documents(docs, "title", "content")
    rows = sorted((r["section_title"], len(r["section_content"]), r["parent_content"][:5]) for r in d.scan().collect())
    assert rows == [("제1조(목적)", 1000, ""), ("제2조(해지)", 13, "제1조(목")]


def test_result_files_are_named_by_model_and_time(spark, tmp_path):
    summary = spark.createDataFrame([(2, 0.5)], "total_cases long, mean_bleu double")
    path = sinks.write_results(summary, spark.createDataFrame([("c1", 1.0)], "case_id string, bleu double"), str(tmp_path), "Model X.1", "20260201")
    assert path.endswith("eval_20260201_model_x_1")
    back = spark.read.option("multiLine", True).json(path).first()
    assert back["model_name"] == "Model X.1" and back["case_results"][0]["case_id"] == "c1" and back["mean_bleu"] == 0.5


def test_many_cases_are_written_line_by_line(spark, tmp_path):
    cases_ = spark.range(500).select(F.concat(F.lit("c"), F.col("id").cast("string")).alias("case_id"), F.when(F.col("id") % 2 == 0, "a \"b\"").alias("note")).repartition(7)
    for rows, n in ((cases_, 500), (cases_.limit(0), 0)):
        path = sinks.write_results(spark.createDataFrame([(n,)], "total_cases long"), rows, str(tmp_path / str(n)), "m", "1")
        files_ = [f for f in os.listdir(path) if f.startswith("part-") and os.path.getsize(f"{path}/{f}")]
        with open(f"{path}/{files_[0]}") as f:
            text = f.read()
        assert len(files_) == 1 and len(text.splitlines()) == n + 2
        back = json.loads(text)
        assert back["total_cases"] == n and {c["case_id"] for c in back["case_results"]} == {f"c{k}" for k in range(n)}


def test_status_of_a_hot_key(spark):
    new = spark.createDataFrame([("hot", k) for k in range(50)] + [("old", 60), ("old", 61), (None, 70), (None, 71)], "id string, pos int").repartition(5)
    got = {(r["id"], r["pos"]): r["status"] for r in ingest.ingest_status(new, spark.createDataFrame([("old",)], "id string"), "id", "pos").collect()}
    assert got == {("hot", 0): "added", **{("hot", k): "skipped_duplicate" for k in range(1, 50)}, ("old", 60): "skipped_existing", ("old", 61): "skipped_duplicate", (None, 70): "added", (None, 71): "skipped_duplicate"}


def test_recall_of_approximate_pairs(spark):
    r = random.Random(9)
    base = [[r.gauss(0, 1) for _ in range(16)] for _ in range(40)]
    v = spark.createDataFrame([(k, [x + r.gauss(0, 0.1) for x in base[k % 40]]) for k in range(400)], "vec_id long, embedding array<double>")
    found = {(x["query_id"], x["item_id"]) for x in search.approximate_pairs(v, v, 0.95).collect()}
    exact = {(x["query_id"], x["item_id"]) for x in search.pairs_within(v, v, 0.95).collect()}
    assert len(exact) > 500 and len(exact & found) / len(exact) > 0.9


def greedy(n, pairs):
    """Of 0..n-1 those that stay, one after another."""
    earlier = {}
    for a, b in pairs:
        earlier.setdefault(a, []).append(b)
    stay = set()
    for k in range(n):
        if not any(b in stay for b in earlier.get(k, [])):
            stay.add(k)
    return stay


@pytest.mark.parametrize("kind", ["chain", "random", "tree"])
def test_gate_settles_chains_in_few_rounds(spark, kind):
    r, n = random.Random(6), 300
    pairs = {"chain": [(k, k - 1) for k in range(1, n)], "random": [(k, r.randrange(k)) for k in range(1, n) for _ in range(r.randrange(4))], "tree": [(k, r.randrange(k)) for k in range(1, n)]}[kind]
    counts = {}
    got, _ = search.settled(spark.range(n).select(F.col("id").alias("query_id")), spark.createDataFrame(pairs, "query_id long, item_id long"), counts)
    assert {x["query_id"] for x in got.collect()} == greedy(n, pairs)
    assert counts["rounds"] <= (11 if kind != "random" else 20)


@pytest.mark.parametrize("first", [20, 1000])
def test_gate_turns_near_rows_away(spark, first):
    r = random.Random(2)
    base = [[r.gauss(0, 1) for _ in range(6)] for _ in range(12)]
    rows = [(k * 3, [x + r.gauss(0, 0.25) for x in base[r.randrange(12)]]) for k in range(150)]
    near = lambda a, b: sum(x * y for x, y in zip(a, b)) / math.hypot(*a) / math.hypot(*b)
    old = [(7, base[0]), (9, base[1])]
    v = lambda x: spark.createDataFrame(x, "vec_id long, embedding array<double>")
    for existing in ([], old):
        inside, want = [w for _, w in existing], {}
        for i, w in rows:
            want[i] = not any(near(w, x) >= 0.95 for x in inside)
            inside += [w] if want[i] else []
        got = search.near_duplicate_gate(v(rows), v(existing) if existing else None, 0.95, first=first).collect()
        assert {x["query_id"]: x["inserted"] for x in got} == want and 20 < sum(want.values()) < 140
        assert all((x["best_score"] or -1) < 0.95 for x in got if x["inserted"]) and all(x["best_score"] >= 0.95 for x in got if not x["inserted"])
    assert search.near_duplicate_gate(v([]), None, 0.9).count() == 0


def clustered(spark):
    r = random.Random(5)
    base = [[r.gauss(0, 1) for _ in range(12)] for _ in range(30)]
    rows = [(k, [x + r.gauss(0, 0.1) for x in base[k % 30]]) for k in range(2000)]
    rows += [(5000, None), (5001, [0.0] * 12), (5002, [1.0, None] + [0.0] * 10), (None, [1.0] * 12), (5003, [1.0]), (5004, rows[0][1]), (5005, rows[0][1]), (5006, [float("nan")] * 12)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)


def test_index_search_is_exact_and_skips_blocks(spark):
    v = clustered(spark)
    q = v.filter("vec_id % 40 = 0 or vec_id between 5000 and 5006")
    ix = index.build(v, rows_a_block=64)
    shown = lambda hits: sorted((r["query_id"], r["rank"], r["item_id"], round(r["score"], 9)) for r in hits.collect())
    counts = {}
    assert shown(index.search(ix, q, 5, counts=counts)) == shown(search.top_k(q.filter("vec_id <> 5003"), v, 5))
    assert 0 < counts["scored"] < counts["joined"] < 0.2 * counts["pairs"]
    assert shown(index.search(ix, q, 5, exclude_self=False)) == shown(search.top_k(q.filter("vec_id <> 5003"), v, 5, exclude_self=False))
    assert index.search(ix, q.limit(0), 5).count() == 0 and index.build(v.filter("vec_id between 5000 and 5002")) is None
    ix.drop()


def test_index_of_few_and_equal_rows(spark):
    v = spark.createDataFrame([(k, [1.0, 2.0]) for k in range(7)] + [(8, [-1.0, -2.0])], "vec_id long, embedding array<double>")
    ix = index.build(v, rows_a_block=2)
    got = index.search(ix, v, 3).collect()
    assert {r["query_id"]: [x["item_id"] for x in sorted(got, key=lambda x: x["rank"]) if x["query_id"] == r["query_id"]] for r in got}[4] == [0, 1, 2] and len(got) == 24
    assert index.search(ix, v, 50).count() == 8 * 7


def test_index_finds_the_recall_it_is_asked_for(spark):
    v = clustered(spark)
    q = v.filter("vec_id % 20 = 0")
    exact = {(r["query_id"], r["item_id"]) for r in search.top_k(q, v, 5).collect()}
    counts = {}
    found = {(r["query_id"], r["item_id"]) for r in index.search(index.build(v), q, 5, recall=0.95, counts=counts).collect()}
    assert len(exact & found) >= 0.9 * len(exact) and counts["joined"] < 0.2 * counts["pairs"]


PAGE = """<div class="tableDefault x"><table><tbody><tr><td>약관<td><a onclick="doView('78','1')">이용 <b>약관</b></a><td><a onclick="doFile('/f')">p</a><tr><td>only</table></div>
<h2>A</h2> text <p>one
 two<p>three<h2>B<i>b</i></h2><span>x</span><h2>C</h2><ul><li>1<ul><li>n</ul><li>2</ul><h2></h2>
<ul class="faq_list y"><li><a class=faq_q>질문 [a] q &amp; r?</a><div class="faq_a">답변 x<script>no</script><br>y<p>z</div><li>no<li><div><a class="faq_q">질문 r</a></div></ul></h3>
<div class="pager"><a>3</a><a href="javascript:goPage(12)">n</a></div><a>99</a><p id=1>never closed<!-- <p>hidden"""


def test_trees_of_nested_and_unclosed_elements():
    root = tree.parse(PAGE)
    assert tree.listed(root) == [("약관", "이용 약관", "78", "1", "/f")]
    assert tree.sections(root) == [("A", "one two"), ("Bb", ""), ("C", "1\nn\n2")]
    assert tree.faq_items(root) == [("[a] q & r?", "x y z", "a"), ("r", "", "")]
    assert tree.last_page(root) == 12
    assert [n.text() for n in root.select("ul > li > ul li")] == ["n"] and [n.attrs.get("id") for n in root.select("p")] == [None, None, None, "1"]
    assert tree.parse("a < b <3 </ x></> c").text() == "a < b <3  c"
    assert [n.attrs for n in tree.parse("<A HREF='x>y' b=\"1\" c d=e/f G>").select("a")] == [{"href": "x>y", "b": "1", "c": "", "d": "e/f", "g": ""}]
    assert tree.parse("<title>a<b</title><p>x").select("p")[0].text() == "x" and tree.parse("").select("p") == []


@pytest.mark.parametrize("piece", ["<a x=", "<title>", "<div>", "<!--", "<li>", "<p>", "<td>", "</p>", "<a href='", "<ul><li>", "<", "&"])
def test_pages_take_linear_time(piece):
    def took(n):
        t = time.process_time()
        root = tree.parse(piece * n)
        root.select(".a > b c"), root.shown(), tree.sections(root, "p")
        return time.process_time() - t

    took(100)
    assert took(40_000) < 8 * took(10_000) + 0.5


def test_trees_run_in_arrow_batches(spark):
    df = spark.createDataFrame([(1, PAGE, "k"), (2, None, "l"), (3, "", None)], "id int, html string, key string")
    got = tree.extract(df, "html", "title string, content string", tree.sections).collect()
    assert [tuple(r) for r in got] == [(1, "k", "A", "one two"), (1, "k", "Bb", ""), (1, "k", "C", "1\nn\n2")]


def flaky(spark, fails, answer_=lambda p: p.upper()):
    """A stand-in that counts what it is asked, and fails as ``fails(prompt, how often it was asked in this task)`` says."""
    calls, seen = spark.sparkContext.accumulator(0), {}

    def call(prompts):
        for p in prompts:
            calls.add(1)
            seen[p] = seen.get(p, 0) + 1
        bad = [p for p in prompts if fails(p, seen[p])]
        if bad:
            raise TimeoutError(bad[0])
        return [answer_(p) for p in prompts]

    return call, calls


def test_model_calls_are_retried_kept_and_made_once(spark, tmp_path):
    call, calls = flaky(spark, lambda p, n: p == "broken" or (p == "slow" and n == 1))
    model = models.Model(call, str(tmp_path / "kept"), retries=2, delay=0.01, tasks=1)
    rows = spark.createDataFrame([(1, "a"), (2, "slow"), (3, "broken"), (4, None), (5, "a"), (6, "a"), (7, "")], "id int, prompt string").repartition(3)
    got = {r["id"]: (r["answer"], r["error"]) for r in model.ask(rows, "prompt").collect()}
    assert got == {1: ("A", None), 2: ("SLOW", None), 3: (None, "TimeoutError: broken"), 4: (None, None), 5: ("A", None), 6: ("A", None), 7: ("", None)}
    assert calls.value == 4 * 3  # four prompts, in two batches and then alone
    again, more = flaky(spark, lambda p, n: False)
    got = {r["id"]: (r["answer"], r["error"]) for r in models.Model(again, str(tmp_path / "kept"), delay=0.01).ask(rows.union(spark.createDataFrame([(8, "new")], rows.schema)), "prompt").collect()}
    assert more.value == 2 and got[3] == ("BROKEN", None) and got[8] == ("NEW", None) and got[1] == ("A", None)


def test_answers_that_cannot_be_used_are_asked_for_again(spark):
    tries = spark.sparkContext.accumulator(0)

    def call(prompts):
        tries.add(1)
        return ["nothing" if p == "odd" else '{"score": 4}' for p in prompts]

    waits, model = [], models.Model(call, retries=1, delay=0.01, valid=lambda a: "score" in a, tasks=1)
    got = {r["prompt"]: (r["answer"], r["error"]) for r in model.ask(spark.createDataFrame([("odd",), ("even",)], "prompt string"), "prompt").collect()}
    assert got == {"odd": ("nothing", "invalid answer"), "even": ('{"score": 4}', None)} and tries.value == 2
    short = models.Model(lambda prompts: ["x"], retries=0, tasks=1).ask(spark.createDataFrame([("a",), ("b",)], "prompt string"), "prompt")
    assert {r["error"] for r in short.collect()} == {"1 answers to 2 prompts"}
    run = models._asked(call, 8, 3, 0.5, 2.0, lambda a: False)
    import pyarrow as pa

    real, models.time.sleep = models.time.sleep, waits.append
    try:
        list(run(iter([pa.RecordBatch.from_pydict({"id": ["1"], "prompt": ["x"]})])))
    finally:
        models.time.sleep = real
    assert waits == [0.5, 1.0, 2.0]


def test_a_reranker_that_fails_leaves_the_order(spark):
    rows = [(k, [1.0, k / 10]) for k in (3, 1, 2, 4)]
    chunks = spark.createDataFrame(rows, "id long, vector array<double>").withColumns({"section_title": F.lit(""), "section_content": F.concat(F.lit("t"), F.col("id").cast("string"))})
    q = spark.createDataFrame([(1, "ask", [1.0, 0.0]), (2, "down", [1.0, 0.0])], "id long, query string, vector array<double>")
    call, _ = flaky(spark, lambda p, n: "down" in p, lambda p: p.rsplit("t", 1)[1][0])
    x = hybrid.hybrid_search(q, chunks, None, hybrid.Config(rerank_enabled=True), 3, models.Model(call, retries=1, delay=0.01))
    got = {i: [r["item_id"] for r in sorted(x.collect(), key=lambda r: r["rank"]) if r["query_id"] == i] for i in (1, 2)}
    assert got[2] == [1, 2, 3] and got[1] != got[2] and 4 not in got[2]


def test_the_run_asks_models_in_stages(spark, tmp_path):
    q, faq, sections = answering(spark)
    nothing_found = answer.SYSTEM["none"]
    call, calls = flaky(spark, lambda p, n: p.startswith(nothing_found), lambda p: "said [참조: 제1조]")
    check, checks = flaky(spark, lambda p, n: False, lambda p: '{"verified": false, "confidence": 0.9, "issues": ["no"]}')
    p = Providers(model=models.Model(call, str(tmp_path / "said"), retries=1, delay=0.01), checker=models.Model(check, retries=0))
    got = {r["id"]: r for r in answer.answers(q, faq, sections, providers=p, use_hybrid=False).collect()}
    assert (got[1]["answer"], got[1]["error"], got[1]["verified"]) == ("said [참조: 제1조]", None, True)
    assert got[2]["verification_issues"] == ["no"] and not got[2]["verified"] and got[2]["citations"] == ["제1조"]
    assert got[3]["answer"] == "" and got[3]["error"].startswith("TimeoutError") and checks.value == 1
    before = calls.value
    answer.answers(q.filter("id < 3"), faq, sections, providers=p, use_hybrid=False).collect()
    assert calls.value == before


def paths(lexicon, piece, at=0, last="^"):
    """Every path over a piece with its cost and entries, without a table."""
    if at == len(piece):
        yield 0.0, 0, []
    else:
        for end, tag, cost in lexicon.edges(piece, at):
            joined = 0.0 if tag in morphs.DROPPED or last in morphs.DROPPED else lexicon.joins.get((last, tag), lexicon.other)
            for rest, n, forms in paths(lexicon, piece, end, tag):
                yield joined + cost + rest, n + 1, [(piece[at:end], tag), *forms]


def test_best_paths_equal_enumeration():
    r = random.Random(8)
    own = morphs.Lexicon(entries=tuple((f, t, c) for f, t, c in [("가", "NN", 1.0), ("가나", "JX", 0.5), ("나", "EF", 0.5), ("나다", "NN", 0.25), ("다", "JX", 1.5), ("x", "NN", 0.1), ("xy", "EF", 0.2)]), joins={("^", "NN"): 0.0, ("NN", "JX"): 0.25, ("NN", "EF"): 0.5, ("JX", "NN"): 1.0}, other=2.0)
    for lexicon in (own, morphs.Lexicon()):
        for _ in range(300):
            piece = "".join(r.choice("가나다는을xy1.이") for _ in range(r.randrange(1, 8)))
            every = [(round(c, 9), n) for c, n, _ in paths(lexicon, piece)]
            found = lexicon.path(piece)
            cost = [round(c, 9) for c, n, f in paths(lexicon, piece) if f == found]
            assert "".join(f for f, _ in found) == piece and (cost[0], len(found)) == min(every)


def test_morphological_tokens(spark):
    got = morphs.tokens_of("고객은 카드를 해지했습니다. (환불은 7일까지!) OK-bank에서 3.5%", morphs.Lexicon())
    assert got == ["고객", "은", "카드", "를", "해지", "했", "습니다", "환불", "은", "7", "일", "까지", "OK", "bank", "에서", "3", "5"]
    assert morphs.tokens_of("우대금리는", morphs.Lexicon(entries=(*morphs.Lexicon().entries, *morphs.words(["우대", "금리"], cost=0.1)))) == ["우대", "금리", "는"]
    assert morphs.tokens_of("", morphs.Lexicon()) == [] and len(morphs.tokens_of("가" * 20_000, morphs.Lexicon())) > 1000
    cut = morphs.tokenizer()
    assert one(spark, "a string", [("집이 크다.",), (None,)], cut(F.col("a")))[1] == []
    plain, own = (one(spark, "a string, b string", [("환불은 됩니다", "환불을 됩니다")], metrics.bleu(F.col("a"), F.col("b"), n=1, tokenizer=t))[0] for t in (tokens, cut))
    assert own > plain


def test_relations_of_candidates_are_met_by_their_chunk(spark):
    """A word that most queries and relations share must not pair all queries with all relations."""
    rng = random.Random(5)
    words = ["it", "The", "that", "alpha", "Beta", "", "gamma delta"]
    stored = [(f"t{n}", rng.choice(words), "is", rng.choice(words), rng.randrange(12)) for n in range(200)]
    t = spark.createDataFrame(stored, "triplet_id string, subject string, predicate string, object string, chunk_id long")
    asked = [(q, i, text) for q, text in enumerate(["what is the alpha of it", "Gamma", "", "delta", None]) for i in range(0, 12, 2)]
    pairs = spark.createDataFrame(asked, "query_id long, item_id long, query string")
    got = triplets.search_within(pairs, t).select("query_id", "item_id", "__t.triplet_id", "score")
    want = triplets.search(pairs.select("query").distinct(), t).join(pairs, "query").filter("chunk_id = item_id").select("query_id", "item_id", "triplet_id", "score")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.count() > 20
    queries = pairs.select(F.col("query_id").alias("id"), "query", F.array(F.lit(1.0), F.col("query_id") + 0.5).alias("vector")).distinct()
    chunks = spark.range(12).select("id", F.array(F.lit(1.0), F.col("id") / 2).alias("vector"), F.lit("").alias("section_title"), F.lit("x").alias("section_content"))
    plan = hybrid.candidates(queries, chunks, t, hybrid.Weights(), 3)._jdf.queryExecution().optimizedPlan().toString()
    assert "__t" in plan and "__key" not in plan


def test_index_blocks_hold_whole_cells(spark):
    """Small cells stay whole; what a search sends grows with the number of blocks. Large ones are cut."""
    v = spark.range(3000).select(F.col("id").alias("vec_id"), F.array(*[F.sin(F.col("id") * k + k) for k in (1.0, 2.3, 3.7, 5.1)]).alias("embedding"))
    built = index.build(v, cells=20)
    sizes = [r["n"] for r in built.blocks().collect()]
    assert sum(sizes) == 3000 and len(sizes) <= 20
    cut = [r["n"] for r in index.build(v, cells=2, rows_a_block=100).blocks().collect()]
    assert sum(cut) == 3000 and max(cut) <= 100
    counts = {}
    q = v.filter("vec_id % 100 = 0")
    got = index.search(built, q, 3, counts=counts)
    want = search.top_k(q, v, 3)
    assert sorted((r["query_id"], r["rank"], r["item_id"]) for r in got.collect()) == sorted((r["query_id"], r["rank"], r["item_id"]) for r in want.collect())


def test_index_sends_a_block_the_queries_that_ask_for_it():
    import numpy as np
    import pyarrow as pa

    q = np.arange(12.0).reshape(6, 2)
    places = [np.array(p, "<i4").tobytes() for p in ([1, 4], [0])]
    batch = pa.RecordBatch.from_arrays([pa.array([7]), pa.array([np.arange(10, 16).astype("<i8").tobytes()]), pa.array([q.tobytes()]), pa.array([np.arange(6.0).tobytes()]), pa.array([[{"number": 3, "places": places[0]}, {"number": 5, "places": places[1]}]])], ["g", "q_ids", "q", "floors", "pairs"])
    rows = [r for b in index._asking(2)(iter([batch])) for r in b.to_pylist()]
    assert [(r["g"], r["number"], np.frombuffer(r["q_ids"], "<i8").tolist(), np.frombuffer(r["q"]).tolist(), np.frombuffer(r["floors"]).tolist()) for r in rows] == [(7, 3, [11, 14], [2.0, 3.0, 8.0, 9.0], [1.0, 4.0]), (7, 5, [10], [0.0, 1.0], [0.0])]


def test_blocks_of_vectors_are_not_sent_once_a_partition(spark, monkeypatch):
    monkeypatch.setattr(search, "BLOCK", 8)
    rng = random.Random(7)
    rows = [(i, [rng.gauss(0, 1) for _ in range(4)]) for i in range(100)]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    partitions = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "200")
    try:
        for queries in (v, v.filter("vec_id % 10 = 0")):
            found = search.top_k(queries, v, 3)
            plan = found._jdf.queryExecution().executedPlan().toString()
            assert "BroadcastExchange" not in plan and plan.count("SortMergeJoin") == 1
            got = {}
            for r in found.collect():
                got.setdefault(r["query_id"], {})[r["rank"]] = r["item_id"]
            assert len(got) == queries.count()
            unit = {i: [x / math.hypot(*u) for x in u] for i, u in rows}
            for i, ranks in got.items():
                near = sorted((j for j in unit if j != i), key=lambda j: (-sum(a * b for a, b in zip(unit[i], unit[j])), j))
                assert [ranks[k] for k in (1, 2, 3)] == near[:3]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
    assert search._grid(100, 100_000, 200)[0] == 1
    for tasks in (12, 200, 2000):
        a, b = search._grid(600_000, 600_000, tasks)
        assert tasks // 2 <= a * b <= tasks and a + b <= 3 * math.sqrt(tasks)
    assert search._grid(0, 0, 200) == (1, 1)


def test_a_unit_vector_is_of_one_value(spark):
    """The norm was computed anew for every component, from the vector's whole expression."""
    got = spark.range(20).select(unit(F.array(F.rand(1) + 0.1, F.rand(2), F.rand(3))).alias("v")).collect()
    assert all(math.isclose(sum(x * x for x in r["v"]), 1.0) for r in got)


def test_candidates_are_read_once_for_both_blocks(spark):
    rows = spark.range(12).select((F.col("id") % 2).alias("q"), F.col("id").alias("item"), (F.col("id") / 12).alias("combined_score"), F.when(F.col("id") < 9, F.col("id") * 5 % 7).cast("double").alias("rerank_score"))
    x = hybrid.rerank_and_fill(rows, 5, 2, 0.5, "q", "item")
    assert x._jdf.queryExecution().optimizedPlan().toString().count("Range (") == 1
    got = {q: [(r["item"], round(r["final_score"], 4), r["block"]) for r in sorted(x.collect(), key=lambda r: r["rank"]) if r["q"] == q] for q in (0, 1)}
    assert got == {0: [(4, 0.6667, 0), (8, 0.3333, 0), (10, 0.8333, 1), (6, 0.5, 1), (2, 0.1667, 1)], 1: [(1, 0.5417, 0), (5, 0.2083, 0), (11, 0.9167, 1), (9, 0.75, 1), (7, 0.5833, 1)]}


def test_bleu_counts_repeated_runs(spark):
    """None in common, none repeated, some repeated: each is counted in its own way."""
    rows = [("a b c", "x x y"), ("a b c d", "a b c d"), ("a b a b c", "a b a b a b"), ("a", "a a a a")]
    got = one(spark, "r string, c string", rows, F.round(metrics.bleu(F.col("r"), F.col("c"), n=2), 6))
    assert got == [0.0, 1.0, 1.0, 0.00001]


def test_blocks_hold_finite_vectors_in_order():
    ids = pa.array([1, None, 3, 4, 5, 6, 7, 8], pa.int64())
    vectors = pa.array([[9.0, 9.0], [1.0, 0.0], None, [1.0, None], [float("nan"), 1.0], [0.0, 0.0], [3.0, 4.0], [2.0]], pa.list_(pa.float32()))
    batch = pa.RecordBatch.from_arrays([ids, vectors, pa.array([1, 2, 3, 4, 5, 6, None, 8], pa.int64())], ["id", "v", "category"])
    got = [r for b in search._packed(iter([batch, batch.slice(6)])) for r in b.to_pylist()]
    assert {r["d"]: (r["ids"], r["categories"]) for r in got} == {2: ([1, 7, 7], [1, None, None]), 1: ([8, 8], [8, 8])}
    assert [tuple(round(x, 6) for x in v) for r in got if r["d"] == 2 for v in np.frombuffer(r["data"]).reshape(-1, 2).tolist()] == [(0.707107, 0.707107), (0.6, 0.8), (0.6, 0.8)]


def test_a_query_is_sent_once_to_blocks_that_share_a_slot():
    at = lambda *n: np.array(n, "<i4").tobytes()
    pairs = [{"slot": s, "number": k, "places": at(*n)} for s, k, n in ((0, 7, [0, 2]), (0, 8, [2]), (0, 9, [0, 2]), (1, 10, [1]))]
    listed = next(index._in_slots(iter([pa.RecordBatch.from_pylist([{"g": 5, "pairs": pairs}])])))
    block = pa.RecordBatch.from_arrays([listed.column(0), pa.array([np.array([10, 11, 12], "<i8").tobytes()]), pa.array([np.eye(3).tobytes()]), pa.array([np.array([0.1, 0.2, 0.3]).tobytes()]), listed.column(1)], ["g", "q_ids", "q", "floors", "pairs"])
    got = {r["number"]: r for b in index._asking(3)(iter([block])) for r in b.to_pylist()}
    assert {s: (np.frombuffer(r["q_ids"], "<i8").tolist(), np.frombuffer(r["floors"]).tolist(), len(r["q"])) for s, r in got.items()} == {0: ([10, 12], [0.1, 0.3], 48), 1: ([11], [0.2], 24)}
    assert [(w["number"], w["places"], w["at"]) for w in got[0]["wanted"]] == [(7, at(0, 2), at(0, 1)), (8, at(2), at(1)), (9, at(0, 2), at(0, 1))]
