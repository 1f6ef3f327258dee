"""The registered queries against their SQL, and the pipeline against its stages by hand."""

import base64
import hashlib
import os
from collections import defaultdict

import corpus_pipeline
import duckdb
import public_tokenizers
import pytest
import tiktoken

from corvid.llm import minhash, quality, registry

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    df = registry.QUERIES[name](spark, SF)
    found = con.execute(registry.ORACLE_SQL[name])
    names = [c[0] for c in found.description]
    assert sorted(names) == sorted(df.columns)
    assert sorted(tuple(r) for r in df.select(*names).collect()) == sorted(tuple(r) for r in found.fetchall())


def test_pipeline(spark):
    rows = {r["doc_id"]: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    scores = {r["doc_id"]: r["score"] for r in quality.score_quality(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")).collect()}
    good = [i for i in rows if scores[i] >= 0.7]
    last = {}
    for i in sorted(good):
        last[rows[i]["text"]] = i
    shingle = minhash.Shingler(5)
    sets = {i: set(shingle(rows[i]["text"]).tolist()) for i in last.values()}
    near = defaultdict(set)
    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                near[a].add(b)
                near[b].add(a)
    kept, seen = set(), set()
    for i in sorted(sets):
        if i not in seen:
            kept.add(i)
            todo = [i]
            while todo:
                x = todo.pop()
                if x not in seen:
                    seen.add(x)
                    todo += near[x]
    con = duckdb.connect()
    con.register("kept", __import__("pandas").DataFrame({"doc_id": sorted(kept)}))
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet' WHERE doc_id IN (SELECT doc_id FROM kept)")
    from corvid.llm.mixing import oracle_sql

    chosen = {r[0] for r in con.execute(f"SELECT doc_id FROM ({oracle_sql(corpus_pipeline.MIX)}) WHERE copies > 0").fetchall()}
    got = {r["doc_id"]: r for r in corpus_pipeline.run(spark, SF).collect()}
    assert set(got) == chosen
    assert all(r["decoded_sha256"] == hashlib.sha256(rows[i]["text"].encode()).hexdigest() for i, r in got.items())
    with open(public_tokenizers.path(corpus_pipeline.TOKENIZER), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for i, r in got.items():
        ids = enc.encode_ordinary(rows[i]["text"])
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())


def test_pipeline_stages_on_nulls_and_nothing(spark, tmp_path):
    """Null texts, ids and sources, repeated ids, and no rows pass every stage; all but the last keep the columns."""
    good = [r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").filter("n_chars between 200 and 900").limit(6).collect()]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(k, t, "en", "src1", len(t)) for k, t in enumerate(good)] + [(None, good[0] + " x", None, None, 1), (0, good[0], "en", "src1", 1), (90, None, "en", "src2", None), (91, "", None, "src12", 0)]
    for name, data in (("some", rows), ("none", [])):
        docs = spark.createDataFrame(data, schema)
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, SF)
            assert out.columns == docs.columns and out.count() <= docs.count()
        last = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
        assert last.count() == len(data) and last.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]


def test_quality_of_held_out_documents(spark):
    """Labels of the driver's documents that were not learned from."""
    d = "/root/testdata/sf0.01"
    if not os.path.isdir(d):
        pytest.skip("needs the driver's tables")
    scored = registry.QUERIES["op8_quality"](spark, d).filter("held_out").join(spark.read.parquet(f"{d}/labels.parquet").filter("quality is not null"), "doc_id")
    rows = scored.select("predicted", "quality").collect()
    assert len(rows) > 30 and sum(r["predicted"] == r["quality"] for r in rows) / len(rows) > 0.95
