"""Each corpus operator against a plain restatement, on rows with nulls, empty and long texts, ties, repeats and clashing columns."""

import base64
import functools
import hashlib
import math
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from tests.llm.pages import PAGES

from corvid.llm import bpe, common, embedding_dedup, exact_dedup, html_text, licenses, lm, minhash, mixing, quality, suffix_dedup

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, t int, hash string, keep_id int, block int, key string, v int, n int"
RND = random.Random(4)
WORDS = ["w%d" % k for k in range(300)]


def sentence(n):
    return " ".join(RND.choice(WORDS) for _ in range(n))


@functools.cache
def documents():
    base = sentence(120)
    out = [(1, base), (2, base), (3, base + " more"), (4, base.replace("w1", "W1", 3)), (5, None), (6, ""), (7, "one"), (8, "One"), (9, "  \t\n"), (10, "x" * 5000), (11, sentence(30_000))]
    out += [(12 + k, " ".join(w if RND.random() > 0.02 else "new" for w in base.split())) for k in range(6)]
    passage = sentence(40)
    out += [(30 + k, sentence(20) + " " + passage + " " + sentence(20)) for k in range(5)]
    out += [(40 + k, sentence(60)) for k in range(5)] + [(7, "one"), (None, base), (None, "alone here"), (50, "Été über naïve €100"), (51, "released under the MIT License. cc by. gnu general public license")]
    langs = ["en", "fr", None]
    return [(i, text, langs[k % 3], f"src{k % 4}" if k % 5 else None, len(text or ""), "x", 1, "h", 2, 3, "k", 4, 5) for k, (i, text) in enumerate(out)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(documents(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def components_of(ids, linked):
    parent = {i: i for i in ids}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in linked:
        p, q = root(a), root(b)
        parent[max(p, q)] = min(p, q)
    return {i: root(i) for i in ids}


# Suffix deduplication


def cut_by_hand(rows, length):
    first = {}
    texts = [(i, (t or "").encode()) for i, t in rows]
    order = lambda i: math.inf if i is None else i
    for i, b in texts:
        for k in range(len(b) - length + 1):
            w = b[k : k + length]
            first[w] = min(first.get(w, math.inf), order(i))
    out = []
    for i, b in texts:
        gone = [False] * len(b)
        for k in range(len(b) - length + 1):
            if first[b[k : k + length]] < order(i):
                gone[k : k + length] = [True] * length
        spans = sum(g and (k == 0 or not gone[k - 1]) for k, g in enumerate(gone))
        left = bytes(c for c, g in zip(b, gone) if not g)
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(left).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("block_bytes, hot_blocks", [(2_000, 256), (2_000, 2), (500, 0), (2_000_000, 256)])
def test_cut_repeats(docs, block_bytes, hot_blocks):
    got = rows_of(suffix_dedup.cut_repeats(docs, block_bytes=block_bytes, shard_bytes=3 * block_bytes, hot_blocks=hot_blocks).drop("kept"))
    assert got == cut_by_hand([(r[0], r[1]) for r in documents()], 50)


def test_cut_repeats_at_the_edges_of_hot_passages(spark):
    """One passage in many documents, at their ends, behind other text, and cut short."""
    r = random.Random(7)
    noise = lambda n: "".join(r.choice("abcdefgh ") for _ in range(n))
    passage = noise(130)
    rows = [(k, noise(r.randrange(0, 40)) + passage[r.choice([0, 0, 17, 60]) :][: r.choice([130, 130, 49, 50, 51])] + noise(r.randrange(0, 40))) for k in range(60)] + [(60, passage), (None, passage), (7, passage)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    for hot_blocks in (0, 5, 256):
        assert rows_of(suffix_dedup.cut_repeats(df, block_bytes=400, shard_bytes=1500, hot_blocks=hot_blocks).drop("kept")) == cut_by_hand(rows, 50)


def test_cut_repeats_without_rows(none):
    assert suffix_dedup.cut_repeats(none).count() == 0


def test_kept_bytes(docs):
    for r in suffix_dedup.cut_repeats(docs).collect():
        assert hashlib.sha256(bytes(r["kept"])).hexdigest() == r["kept_sha256"] and len(r["kept"]) == r["n_bytes"] - r["n_removed"]


def test_suffix_sort_with_long_ties():
    r = np.random.default_rng(1)
    rows = r.integers(97, 99, (700, 50)).astype(np.uint8)
    rows[:, :20] = 97
    rows[350:] = rows[:350]
    order, lcp = suffix_dedup.suffix_sort(rows)
    s = [rows[k].tobytes() for k in order]
    assert s == sorted(s)
    assert all(lcp[k] == next((j for j in range(50) if s[k][j] != s[k - 1][j]), 50) for k in range(1, 700))


# Near-duplicates


def sets_by_hand(text, width):
    w = (text or "").encode().lower().split()
    return {tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))} if w else set()


@pytest.mark.parametrize("width", [2, 5])
def test_near_dedup(docs, width):
    rows = [(r[0], sets_by_hand(r[1], width)) for r in documents()]
    known = [(i, s) for i, s in rows if i is not None and s]
    linked = [(a, b) for a, x in known for b, y in known if a < b and 100 * len(x & y) >= 80 * len(x | y)]
    of = components_of({i for i, _ in rows if i is not None}, linked)
    expected = sorted(((i, len(s), of.get(i), i == of.get(i)) for i, s in rows), key=repr)
    assert rows_of(minhash.near_dedup(docs, width=width)) == expected


def test_near_dedup_chain_and_hub(spark, monkeypatch):
    """Links only through a middle text, found although the bucket's first id links with few of them."""
    monkeypatch.setattr(minhash, "BLOCK", 3)
    base = [f"b{k}" for k in range(200)]
    rows = [(100 + j, " ".join("z%d_%d" % (j, k) if k % 20 == j % 20 and k >= 100 else w for k, w in enumerate(base))) for j in range(20)]
    rows += [(k, " ".join(f"q{k}_{j}" if j % 9 == k else w for j, w in enumerate(base))) for k in range(1, 4)] + [(500, " ".join(base))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    sets = [(i, sets_by_hand(t, 1)) for i, t in rows]
    of = components_of([i for i, _ in rows], [(a, b) for a, x in sets for b, y in sets if a < b and 100 * len(x & y) >= 80 * len(x | y)])
    assert {r[0]: r[2] for r in minhash.near_dedup(df, width=1).collect()} == of


def test_near_dedup_without_rows(none):
    assert minhash.near_dedup(none).count() == 0


def test_sketch_estimates_similarity():
    a = np.random.default_rng(9).integers(0, 1 << 63, 1000).astype(np.uint64)
    one, two = minhash.sketch([a[:900], a[100:]], 1000)
    assert abs((one == two).mean() - 0.8) < 0.06
    assert (minhash.sketch([a[:1]], 64) != minhash._FREE).all()


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(200)] + [(500, 501), (501, 500), (7, 7)], "a long, b long")
    got = dict(tuple(r) for r in common.components(edges)[0].collect())
    assert got == {k: 0 for k in range(201)} | {500: 500, 501: 500}


# Licenses


def test_scan_licenses(docs):
    got = {(r[0], r[1], r[2], r[3], r[4]) for r in licenses.scan_licenses(docs).collect()}
    expected = set()
    for i, text, *_ in documents():
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        places = sorted(k for p in licenses.PHRASES for k in range(len(w)) if w[k : k + len(p.split())] == p.split())
        expected.add((i, len(w), len(places), places[0] if places else None, places[-1] if places else None))
    assert got == expected


def test_license_blocks_equal_brute_force(spark):
    texts = [" ".join(RND.choice("a b c d e f the license under mit x y z".split()) for _ in range(RND.randrange(0, 80))) for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    templates = [("one", "under the mit license"), ("two", "a b c d e f the"), ("three", "x")]
    for r in licenses.scan_licenses(df, templates=templates, containment=0.75).collect():
        w = texts[r["doc_id"]].split()
        expected = set()
        for label, t in templates:
            m, s = len(t.split()), set(t.split())
            for k in range(0, len(w), m):
                c = len(s & set(w[k : k + 2 * m])) / len(s)
                if c >= 0.75:
                    expected.add((label, k, c))
        assert {tuple(b) for b in r["blocks"]} == expected


def test_license_windows_equal_brute_force_at_every_word(spark):
    loose = "released under terms of the well known mit style license"
    texts = ["x " * k + loose + " y" * 9 for k in range(12)] + [" ".join(RND.choice("a b c d e f the license under mit x y z".split()) for _ in range(RND.randrange(0, 80))) for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    templates = [("mit", "released under the mit license"), ("two", "a b c d e f the"), ("three", "x"), ("four", "the mit the a")]
    for r in licenses.scan_licenses(df, templates=templates, phrases={}, containment=0.8).collect():
        w = texts[r["doc_id"]].split()
        expected = set()
        for label, t in templates:
            m, s = len(t.split()), set(t.split())
            for k in range(len(w)):
                c = len(s & set(w[k : k + 2 * m])) / len(s)
                if c >= 0.8:
                    expected.add((label, k, c))
        got = [(b["label"], k, b["containment"]) for b in r["windows"] for k in range(b["first_start"], b["last_start"] + 1)]
        assert len(got) == len(set(got)) and set(got) == expected
        assert r["labels"] == ",".join(sorted({x[0] for x in expected})) and r["score"] == max((x[2] for x in expected), default=0.0)
        assert r["doc_id"] >= 12 or "mit" in r["labels"].split(",")


def test_licenses_are_told_apart(spark):
    texts = {
        "released under the bsd license": "bsd", "released under the apache license": "apache", "licensed under the eclipse license version 2 0": "", "licensed under cc by 3 0": "cc-by", "licensed under cc by sa 4 0": "cc-by",
        "you may use this file in agreement with the license": "", "released under the MIT license": "mit", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.": "cc-by-sa",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.": "lgpl",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated docs": "mit",
    }
    for pad in (0, 3, 50):
        rows = [(k, "zeta " * pad + t + " omega" * pad) for k, t in enumerate(texts)]
        got = {r["doc_id"]: r["labels"] for r in licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
        assert [got[k] for k in range(len(texts))] == list(texts.values())


def test_license_windows_with_required_and_excluded_words(spark):
    r = random.Random(3)
    texts = [" ".join(r.choice("a b c d e must never x y z".split()) for _ in range(r.randrange(0, 60))) for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    templates = [("one", "a b must c", "must", "never"), ("two", "a b c d e", "a must", ""), ("three", "d e", "", "never z")]
    for row in licenses.scan_licenses(df, templates=templates, phrases={}, containment=0.6).collect():
        w = texts[row["doc_id"]].split()
        expected = set()
        for label, t, must, never in templates:
            m, s = len(t.split()), set(t.split())
            for k in range(len(w)):
                window = set(w[k : k + 2 * m])
                if len(s & window) / len(s) >= 0.6 and set(must.split()) <= window and not set(never.split()) & window:
                    expected.add((label, k, len(s & window) / len(s)))
        got = [(b["label"], k, b["containment"]) for b in row["windows"] for k in range(b["first_start"], b["last_start"] + 1)]
        assert len(got) == len(set(got)) and set(got) == expected


def test_licenses_without_rows(none):
    assert licenses.scan_licenses(none).count() == 0


# Language model


def test_base_scores(docs):
    def folds(i):
        return i is not None and zlib.crc32(str(i).encode()) % 7 == 2

    texts = [(i, (t or "").encode().lower().split() + [None]) for i, t, *_ in documents()]
    c = Counter(w for i, ws in texts if not folds(i) for w in ws)
    total, v = sum(c.values()), len(c)
    got = sorted((tuple(r)[:6] for r in lm.score_texts(docs, iterations=1, block_tokens=5_000).collect()), key=repr)
    want = sorted(((i, folds(i), len(ws), sum(c[w] > 0 for w in ws), total, sum(math.log10((c[w] + 1) / (total + v + 1)) for w in ws)) for i, ws in texts), key=repr)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert np.allclose([g[5] for g in got], [w[5] for w in want])


def test_forward_recursion_and_counts_equal_enumeration():
    r = np.random.default_rng(2)
    norm = lambda x: x / x.sum(-1, keepdims=True)
    model = lm.HMM(norm(r.random(3)), norm(r.random((3, 3))), norm(r.random((3, 4))))
    texts = [[0, 1, 2, 3, 0], [2], [3, 3, 1]]
    lens = np.array([len(t) for t in texts])
    seq, flat = lm._Sequences(lens), np.concatenate(texts)
    _, scale = seq.forward(model, flat[seq.source])
    got = np.empty(3)
    got[seq.order] = np.bincount(seq.rank, np.log(scale), 3)
    start, moves, emits = np.zeros(3), np.zeros((3, 3)), np.zeros((3, 4))
    for k, t in enumerate(texts):
        total = 0.0
        paths = []
        for path in np.ndindex(*[3] * len(t)):
            p = model.start[path[0]] * np.prod([model.emit[s, c] for s, c in zip(path, t)]) * np.prod([model.move[a, b] for a, b in zip(path, path[1:])])
            total += p
            paths.append((path, p))
        assert math.isclose(got[k], math.log(total))
        for path, p in paths:
            start[path[0]] += p / total
            for a, b in zip(path, path[1:]):
                moves[a, b] += p / total
            for s, c in zip(path, t):
                emits[s, c] += p / total
    s, m, e = seq.counts(model, flat[seq.source])
    assert np.allclose(s, start, atol=1e-4) and np.allclose(m, moves, atol=1e-4) and np.allclose(e, emits, atol=1e-4)


def test_model_beats_unigrams_on_held_out_texts(spark):
    a, b = [f"a{k}" for k in range(50)], [f"b{k}" for k in range(50)]
    rows = [(k, " ".join(RND.choice(a if k % 2 else b) for _ in range(60))) for k in range(300)]
    got = [r for r in lm.score_texts(spark.createDataFrame(rows, "doc_id long, text string"), states=2, iterations=6).collect() if r["held_out"]]
    assert sum(r["score"] for r in got) > sum(r["base_score"] for r in got) + 0.2 * sum(r["n_tokens"] for r in got)


def test_states_tell_words_of_equal_low_hash_bits_apart(spark):
    by_class = {}
    for k in range(3000):
        by_class.setdefault(lm.xxhash.xxh3_64_intdigest(b"v%d" % k) & 4095, []).append(f"v{k}")
    a, b = zip(*[x[:2] for x in by_class.values() if len(x) > 1][:50])
    rows = [(k, " ".join(RND.choice(a if k % 2 else b) for _ in range(60))) for k in range(300)]
    got = [r for r in lm.score_texts(spark.createDataFrame(rows, "doc_id long, text string"), states=2, iterations=6).collect() if r["held_out"]]
    assert len(a) == 50 and sum(r["score"] for r in got) > sum(r["base_score"] for r in got) + 0.2 * sum(r["n_tokens"] for r in got)


def test_scores_equal_baum_welch_over_words(spark):
    rows = [(k, sentence(RND.randrange(0, 30)) if k % 9 else None) for k in range(120)]
    got = {r["doc_id"]: r["score"] for r in lm.score_texts(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), states=3, iterations=3, block_tokens=200, part_words=50).collect()}
    texts = {i: [*(t or "").encode().split(), None] for i, t in rows}
    taught = [ws for i, ws in texts.items() if zlib.crc32(str(i).encode()) % 7 != 2]
    c = Counter(w for ws in taught for w in ws)
    words = sorted(c, key=repr)
    at = {w: k for k, w in enumerate(words)}
    number = np.array([-1 if w is None else int(np.uint64(lm.xxhash.xxh3_64_intdigest(w)).astype(np.int64)) for w in words])
    emit = np.concatenate([(np.array([c[w] for w in words]) + 1) * lm.noise(number, 3, 3), np.full((3, 1), 2.0)], 1)
    start, move, emit = np.full(3, 1 / 3), np.array([[0.98 if a == b else 0.01 for b in range(3)] for a in range(3)]), emit / emit.sum(1, keepdims=True)

    def forward(x):
        alpha = [start * emit[:, x[0]]]
        for w in x[1:]:
            alpha.append(alpha[-1] @ move * emit[:, w])
        return alpha

    for _ in range(3):
        s, m, e = np.zeros(3), np.zeros((3, 3)), np.zeros((3, len(words) + 1))
        for ws in taught:
            x = [at[w] for w in ws]
            alpha, beta = forward(x), [np.ones(3)]
            for w in x[:0:-1]:
                beta.insert(0, move @ (emit[:, w] * beta[0]))
            p = alpha[-1].sum()
            s += alpha[0] * beta[0] / p
            for t, w in enumerate(x):
                e[:, w] += alpha[t] * beta[t] / p
                if t:
                    m += move * np.outer(alpha[t - 1], emit[:, w] * beta[t]) / p
        start, move, emit = [(y + z) / (y + z).sum(-1, keepdims=True) for y, z in ((s, 0.1), (m, 0.1), (e, 1 / 3))]
    for i, ws in texts.items():
        assert math.isclose(got[i], math.log10(forward([at.get(w, len(words)) for w in ws])[-1].sum()), rel_tol=1e-4)


def test_emissions_add_up_to_one_as_blocks_read_them():
    """Blocks get rounded counts; the sums by state are of those, whichever blocks a word is in."""
    rnd, states = np.random.default_rng(1), 3
    blocks = [(b, np.sort(rnd.choice(500, 200, replace=False)).astype("<i8")) for b in range(4)]
    sent = [(7, b, w.tobytes(), lm._shrink(lm._coded(rnd.exponential(0.01, (len(w), states)) * rnd.exponential(9, (len(w), 1)))), None) for b, w in blocks]
    import pyarrow as pa

    table = pa.table({n: pa.array(c, k) for (n, k), c in zip((("part", pa.int32()), ("block", pa.int64()), ("words", pa.binary()), ("x", pa.binary()), ("stats", pa.list_(pa.float64()))), zip(*sent))})
    rows = lm._summed("<u2", states, 3)(table).to_pylist()
    seen = {}
    for (b, words), r in zip(blocks, rows):
        for w, x in zip(words, lm._decoded(lm._grown(r["x"], "<u2").reshape(-1, states), np.float64)):
            assert seen.setdefault(int(w), tuple(x)) == tuple(x)
    by_state = np.array(rows[-1]["stats"])[-states:]
    emit = lm.Emissions(states, 3, len(seen), by_state).trained(np.array([*seen.values(), (0.0,) * states]))
    assert np.allclose(emit.sum(0), 1, atol=1e-12)


def test_language_model_without_rows(none):
    assert lm.score_texts(none).count() == 0


# Exact deduplication


@pytest.mark.parametrize("hash_bits", [64, 3])
def test_exact_dedup(docs, hash_bits):
    groups = {}
    for i, t, *_ in documents():
        groups.setdefault(t or "", []).append(i)
    keep = {t: max((i for i in g if i is not None), default=None) for t, g in groups.items()}
    expected = sorted(((i, keep[t or ""], len(groups[t or ""]), i == keep[t or ""], hashlib.sha256((t or "").encode()).hexdigest()) for i, t, *_ in documents()), key=repr)
    assert rows_of(exact_dedup.exact_dedup(docs, hash_bits=hash_bits, capacity=2)) == expected


def test_a_broken_directory_breaks_the_result(docs, monkeypatch):
    """The owners of buckets decide: what the directory sends to no bucket, or to two, is answered wrongly."""
    right, real = rows_of(exact_dedup.exact_dedup(docs, capacity=2)), exact_dedup.directory
    monkeypatch.setattr(exact_dedup, "directory", lambda e, c: real(e, c).filter("hash % 3 <> 0"))
    assert len(rows_of(exact_dedup.exact_dedup(docs, capacity=2).filter("keep_id is not null or group_size is not null"))) < len(right)
    monkeypatch.setattr(exact_dedup, "directory", lambda e, c: real(e, c).unionByName(real(e, c).withColumn("bucket", F.col("bucket") + 1)))
    assert rows_of(exact_dedup.exact_dedup(docs, capacity=2)) != right


def test_owners_merge_parts_and_tell_texts_of_one_hash_apart(spark):
    rows = [(k, f"text {k % 7}") for k in range(200)] + [(1000 + k, f"alone {k}") for k in range(50)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    entries = exact_dedup._entries(exact_dedup._rows(df, "doc_id", "text", 64))
    assert entries.count() > 57 + 7
    index = exact_dedup.build_index(df).collect()
    assert sorted((r["keep_id"], r["group_size"]) for r in index if r["group_size"] > 1) == sorted((max(k for k in range(200) if k % 7 == m), sum(k % 7 == m for k in range(200))) for m in range(7)) and len(index) == 57
    chained = exact_dedup.build_index(df, hash_bits=2).collect()
    assert len(chained) == 57 and max(r["chain_len"] for r in chained) > 5 and len({(r["bucket"], r["hash"]) for r in chained}) <= 4
    assert all(r["t"] is not None for r in chained if r["chain_len"] > 1)


def test_drop_exact_copies_keeps_columns(docs):
    out = exact_dedup.drop_exact_copies(docs)
    assert out.columns == docs.columns and sorted(r[0] or 0 for r in out.select("doc_id").collect()).count(1) == 0


def test_exact_dedup_without_rows(none):
    assert exact_dedup.exact_dedup(none).count() == 0


def test_directory_splits_full_buckets(spark):
    index = exact_dedup.build_index(spark.createDataFrame([(k, str(k)) for k in range(3000)], "doc_id long, text string"), capacity=4).collect()
    sizes, hashes = Counter((r["depth"], r["bucket"]) for r in index), {r["hash"] for r in index}
    assert len(index) == 3000 == len(hashes) and max(sizes.values()) <= 4 and len({d for d, _ in sizes}) > 1
    for r in index:
        assert r["bucket"] >> (64 - r["depth"]) == r["hash"] >> (64 - r["depth"])
    for depth, bucket in sizes:  # one level up a bucket that split was overfull, below the depth the directory starts with
        up = [h for h in hashes if h >> (65 - depth) == bucket >> (65 - depth)]
        assert len(up) > 4 or depth == int(math.log2(3000 / 4))


def test_directory_goes_as_deep_as_it_must(spark):
    """Hashes that agree on 40 bits, a chain that no bit splits, and null ids."""
    entries = spark.createDataFrame([((7 << 40) + k, 1) for k in range(20)] + [((9 << 40) + 5, 1)] * 6, "hash long, n int")
    got = {tuple(r) for r in exact_dedup.directory(entries, 2).collect()}
    assert len(got) == 21 and {d for h, d, _ in got if h >> 40 == 7} <= {62, 63, 64}
    assert max(Counter((d, b) for h, d, b in got if h >> 40 == 7).values()) <= 2


# Pages


def test_blocks_of_a_page():
    page = "<html><head><title>no</title><script>var t='<p>';</script></head><body><nav><a href=/>A</a></nav><!-- c --><article><h1>T&amp;t</h1><p>one <b>two</b><br>three<p>four&#233;</article><div hidden>x</div>"
    assert [(b[0][-1] if b[0] else "", b[1]) for b in html_text.blocks_of(page)][:4] == [("a", "A"), ("h1", "T&t"), ("p", "one two three"), ("p", "fouré")]


STORY = "<article><h1>Title here.</h1><p>First words of the story are here.</p><p>More words of it.</p>"


@pytest.mark.parametrize("head", ["<head><title>t</title><body>", "<head><title>t</title>", "<head><title>t<body>", "<title>t</title>", "<html><head><meta charset=x><script>if (a<b) x='</p>'</script></head><body>", "<!-- c --><html><head><style>p{}</style><link rel=x><title>a <b> c</title>", "<head><title>it's <!-- <y \"z</title></head><body>"])
def test_head_ends_without_end_tag(head):
    assert [b[1] for b in html_text.blocks_of(head + STORY + "</article>")] == ["Title here.", "First words of the story are here.", "More words of it."]


def test_only_scripts_styles_and_comments_run_to_the_end():
    for tag in "noscript template textarea select svg iframe object canvas math".split():
        assert [b[1] for b in html_text.blocks_of(f"<body>{STORY}<{tag}>inside <p>After it.</article>")][2:] == ["More words of it.", "inside", "After it."], tag
        assert "inside" in " ".join(b[1] for b in html_text.blocks_of(f"<body>{STORY}<p>x <{tag}>inside</{tag}> y</p></article>")), tag
    for start in ("<script>", "<style>", "<!-- "):
        assert [b[1] for b in html_text.blocks_of(f"<body>{STORY}{start}inside <p>After it.</article>")][2:] == ["More words of it."]
    assert [b[1] for b in html_text.blocks_of("<body><p>Let <math><mi>x</mi><mo>=</mo><mn>1</mn></math> hold.</p>")] == ["Let x=1 hold."]


def test_extract_text(spark):
    page = "<html><body><nav><ul><li><a href='/'>Home</a></li><li><a href='/'>News</a></li></ul></nav><div class='ad'>Buy this now.</div><article><h1>Title here.</h1><p>First words of the story are here.</p><p>More &amp;  more\n text.</p></article><footer>&copy; site</footer></body></html>"
    rows = [(1, "u", page, "x"), (2, None, None, "x"), (3, "u", "", "x"), (None, "u", "<<<>", "x"), (1, "u", page, "x")]
    got = rows_of(html_text.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string, text string")))
    text = "Title here.\n\nFirst words of the story are here.\n\nMore & more text."
    assert [g for g in got if g[0] in (1, 2, 3)] == [(1, "u", text, len(text))] * 2 + [(2, None, "", 0), (3, "u", "", 0)]


def test_references_end_at_tags():
    assert html_text.blocks_of("<p>a &am<b>p;</b> b &lt;p&gt; &nbsp;c &eacute</p>") == [(("p",), "a &amp; b <p> c é", 0.0)]


def test_pages_written_by_hand(spark):
    """Where names or tags say what a block is, every page is right; pages of nameless div elements are not (the README says how many)."""
    rows = [(k, "u", page) for k, (_, page, _) in enumerate(PAGES)] + [(1000, "u", PAGES[0][1].replace("</p>", "</p>" + "<p>More of the same story is told here.</p>" * 3000, 1))]
    got = {r["page_id"]: r["text"] for r in html_text.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    wrong = [name for k, (name, _, main) in enumerate(PAGES) if got[k] != "\n\n".join(main)]
    assert all(name.endswith("nameless") for name in wrong), wrong
    assert got[1000].count("More of the same story is told here.") == 3000
    assert html_text.extract_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_labeller_on_unseen_pages():
    model, right, n = html_text.kept(), 0, 0
    for x, y in html_text.made_pages(200, 77):
        s = model.scores(*html_text.padded([x]))[0] >= 0.5
        right, n = right + (s == y).sum(), n + len(y)
    assert right / n > 0.95


def test_gradients_match_differences():
    model = html_text.BiLSTM(3)
    x, y = html_text.made_pages(1, 5)[0]
    x, mask = html_text.padded([x[:6]])
    y = y[None, :6]
    g = model.gradients(x, mask, y)

    def loss():
        s = model.scores(x, mask).astype(float)
        return -(y * np.log(s) + (1 - y) * np.log(1 - s)).sum() / mask.sum()

    for name in ("fh", "bx", "o"):
        at = np.unravel_index(np.argmax(np.abs(g[name])), g[name].shape)
        old = model.p[name][at]
        model.p[name][at] = old + 1e-2
        up = loss()
        model.p[name][at] = old - 1e-2
        down = loss()
        model.p[name][at] = old
        assert math.isclose((up - down) / 2e-2, g[name][at], rel_tol=0.05, abs_tol=1e-4)


# Mixing


def test_mix_fills_siblings_first(spark):
    rows = [(k, "a b c d", "en", "src0") for k in range(10)] + [(100 + k, "a b c d", "fr", "src0") for k in range(100)] + [(1000 + k, "a b c d", "en", "src15") for k in range(100)]
    mix = mixing.Mix(domain_weights={"web": 1, "books": 1}, lang_weights={}, budget_percent=50, max_epochs=1)
    got = mixing.mix_sources(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"), mix).groupBy("domain", "lang").agg({"n_tokens": "sum", "copies": "sum"}).collect()
    copies = {(r["domain"], r["lang"]): r["sum(copies)"] for r in got}
    assert copies == {("web", "en"): 10, ("web", "fr"): 42, ("books", "en"): 52}


def by_plain_sums(rows, m):
    """Copies of rows (id, text, lang, source) by the stated rules, in plain Python."""
    leaf = {k: (m.domains.get(r[3] or "", m.other_domain), r[2] or "", r[3] or "") for k, r in enumerate(rows)}
    n = {k: len((r[1] or "").split()) for k, r in enumerate(rows)}
    tokens = Counter()
    for k, x in leaf.items():
        tokens[x] += n[k]
    weight = lambda x: (m.domain_weights, m.lang_weights, m.source_weights)[len(x) - 1].get(x[-1], 1)
    caps = {x: t * m.max_epochs if weight(x) else 0 for x, t in tokens.items()}
    for depth in (2, 1):
        for x in {x[:depth] for x in tokens}:
            caps[x] = sum(c for y, c in caps.items() if len(y) == depth + 1 and y[:depth] == x) if weight(x) else 0
    budget = {(): sum(tokens.values()) * m.budget_percent // 100}
    for depth in (1, 2, 3):
        for parent in [x for x in list(budget) if len(x) == depth - 1]:
            children = sorted((x for x in caps if len(x) == depth and x[:-1] == parent), key=lambda x: (caps[x] / max(weight(x), 1), x[-1]))
            b, w = budget[parent], sum(map(weight, children))
            while children and b * weight(children[0]) >= caps[children[0]] * w:
                x = children.pop(0)
                budget[x], b, w = caps[x], b - caps[x], w - weight(x)
            budget |= {x: b * weight(x) // w for x in children}
    out, run = [], Counter()
    full = {x: budget[x] // tokens[x] if tokens[x] else 0 for x in tokens}
    place = lambda k: hashlib.md5(":".join(map(str, [m.seed, full[leaf[k]] + 1] + ([rows[k][0]] if rows[k][0] is not None else []))).encode()).hexdigest()
    for k in sorted(leaf, key=lambda k: (place(k), n[k])):
        x = leaf[k]
        run[x] += n[k]
        rest = budget[x] - full[x] * tokens[x]
        out.append((rows[k][0], n[k], full[x] + (rest > 0 and run[x] <= rest)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("mix", [
    mixing.Mix(), mixing.Mix(sort_rows=0), mixing.Mix(domain_weights={"web": 0, "books": 1}, lang_weights={"fr": 0}), mixing.Mix(lang_weights={"en": 0, "fr": 0, "": 0}), mixing.Mix(source_weights={"src0": 0, "src1": 7}, budget_percent=150, sort_rows=1),
    mixing.Mix(budget_percent=0), mixing.Mix(max_epochs=1, budget_percent=100),
])
def test_mix_equals_plain_sums(spark, mix):
    r = random.Random(8)
    rows = [(k if k % 50 else None, " ".join(["a"] * r.randrange(0, 9)) if k % 31 else None, r.choice(["en", "fr", "de", None]), r.choice(["src0", "src0", "src0", "src1", "src12", None])) for k in range(400)]
    rows += rows[:3]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = mixing.mix_sources(df, mix).select("doc_id", "n_tokens", "copies")
    assert rows_of(got) == by_plain_sums(rows, mix)


def test_take_mix_takes_each_row_its_own_copies(spark):
    rows = [(k // 2 if k % 7 else None, f"a b c {k}", "en", "src0", k) for k in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, copies int")
    for frame in (df, df.filter("doc_id is not null and copies % 2 = 1")):
        for mix in (mixing.Mix(budget_percent=50), mixing.Mix(budget_percent=150)):
            want = Counter()
            for r in mixing.mix_sources(frame, mix).collect():
                want[r["doc_id"]] += r["copies"]
            out = mixing.take_mix(frame, mix)
            assert out.columns == frame.columns and Counter(r["doc_id"] for r in out.collect()) == +want
            each = Counter(r["copies"] for r in out.collect())
            assert set(each.values()) <= ({1} if mix.budget_percent < 100 else {1, 2})


def test_mix_refuses_negative_weights():
    with pytest.raises(ValueError):
        mixing.Mix(lang_weights={"fr": -1})


def test_mix_edges(docs, none):
    out = mixing.mix_sources(docs)
    assert out.count() == docs.count() and mixing.mix_sources(none).count() == 0
    assert all(r["copies"] in (0, 1, 2) for r in out.collect())
    assert mixing.take_mix(docs).columns == docs.columns


# Quality


def test_quality_learns(spark):
    rows, labels = [], []
    for k in range(400):
        good = k % 3 > 0
        text = sentence(60).capitalize() + "." if good else " | ".join(RND.choice(WORDS) for _ in range(60))
        rows.append((k, text, "en"))
        labels.append((k, int(good), 0))
    d, lab = spark.createDataFrame(rows + [(None, None, "en"), (900, "", "en")], "doc_id long, text string, score string"), spark.createDataFrame(labels + [(None, 1, 0), (5, None, None)], "doc_id long, quality int, toxic int")
    got = quality.score_quality(d, lab).collect()
    test = [r for r in got if r["held_out"] and r["doc_id"] < 400]
    assert len(got) == 402 and test and sum(r["predicted"] == int(r["doc_id"] % 3 > 0) for r in test) / len(test) > 0.97
    assert quality.drop_low_quality(d, lab).columns == d.columns


def test_quality_without_labels_or_rows(docs, none, spark):
    lab = spark.createDataFrame([], "doc_id long, quality int")
    assert {r["score"] for r in quality.score_quality(docs, lab).collect()} == {0.5}
    assert quality.score_quality(none, lab).count() == 0


def test_scores_add_one_entry_a_table():
    r = np.random.default_rng(5)
    x = np.round(r.standard_normal((500, 4)), 1)
    y = (x[:, 0] + 2 * np.sign(x[:, 1] * x[:, 2]) > 0).astype(float)
    model = quality.GAM(rounds=20, pair_rounds=20).fit(x, y)
    assert model.pair_tables
    for row, score in zip(x, model.score(x)):
        z = model.base + sum(table[sum(v >= e for e in edges)] for v, edges, table in zip(row, model.edges, model.tables))
        z += sum(table[sum(row[i] >= e for e in model.pair_edges[i]), sum(row[j] >= e for e in model.pair_edges[j])] for i, j, table in model.pair_tables)
        assert math.isclose(score, 1 / (1 + math.exp(-z)), rel_tol=1e-9)
    assert ((model.score(x) >= 0.5) == (y > 0)).mean() > 0.9


def test_quality_folds_ties_and_repeats(spark):
    rows = [(1, "same words here."), (1, "same words here."), (1, "| x |"), (2, None), (3, "")] + [(k, sentence(20) if k % 2 else "# # # " * 9) for k in range(10, 90)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    lab = spark.createDataFrame([(1, 0), (1, 1)] + [(k, k % 2) for k in range(10, 90)], "doc_id long, quality int")
    got = quality.score_quality(d, lab).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(i for i, _ in rows)
    for r in got:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and r["predicted"] == int(r["score"] >= 0.7)
    assert len({r["score"] for r in got if r["doc_id"] in (2, 3)}) == 1 and len({r["score"] for r in got if r["doc_id"] == 1}) == 2


def test_no_more_rows_than_the_bound_are_learned_from(spark, monkeypatch):
    seen, fit = [], quality.GAM.fit
    monkeypatch.setattr(quality.GAM, "fit", lambda self, x, y: seen.append(len(x)) or fit(self, x, y))
    docs = spark.createDataFrame([(1, f"text {k}") for k in range(300)] + [(k, "other words") for k in range(2, 30)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(1, 30)], "doc_id long, quality int")
    quality.fit_quality(docs, labels, max_train_rows=40)
    assert seen == [40]


def test_features_are_finite():
    for t in (None, "", "\n", "é" * 10, "a " * 10_000):
        x = quality.features(t)
        assert len(x) == len(quality.FEATURES) and np.isfinite(x).all()


# Embeddings


def test_near_embeddings(spark):
    r = np.random.default_rng(6)
    rows, base = [], r.standard_normal((12, 16))
    for k in range(300):
        v = base[k % 12] + r.standard_normal(16) * (0.12 if k % 3 else 0.02)
        rows.append((k, [float(np.float32(x)) for x in v]))
    rows += [(300 + k, rows[0][1]) for k in range(4)] + [(400, None), (401, [0.0] * 16), (402, [float("nan")] * 16), (403, [None] * 16), (404, []), (405, [1.0, 2.0]), (None, rows[0][1])]
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<float>, id string, v int")
    good = [(i, np.array(v)) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    pairs = [(a, b) for a, x in good for b, y in good if a < b and len(x) == len(y) and x @ y / math.sqrt((x @ x) * (y @ y)) >= 0.95]
    of, n = components_of([i for i, _ in rows if i is not None], pairs), Counter(i for p in pairs for i in p)
    expected = sorted(((i, n[i] if i is not None else 0, of.get(i), i == of.get(i)) for i, _ in rows), key=repr)
    assert rows_of(embedding_dedup.near_embeddings(df)) == expected
    assert embedding_dedup.near_embeddings(df.limit(0)).count() == 0


def test_near_embeddings_of_repeated_ids_and_large_components(spark, monkeypatch):
    """Rows that repeat an id and its vector count as rows; blocks of stars and components meet each other."""
    monkeypatch.setattr(embedding_dedup, "BLOCK", 7)
    r = np.random.default_rng(3)
    centre = r.standard_normal(24)
    rows = [(k, (centre + r.standard_normal(24) * 0.13).tolist()) for k in range(60)] + [(100 + k, r.standard_normal(24).tolist()) for k in range(20)]
    rows += [rows[5], rows[5], rows[70]]
    good = [(i, np.array(v)) for i, v in rows]
    pairs = [(a, b) for x, (a, u) in enumerate(good) for b, v in good[x + 1 :] if u @ v / math.sqrt((u @ u) * (v @ v)) >= 0.95]
    of, n = components_of({i for i, _ in rows}, [(a, b) for a, b in pairs if a != b]), Counter()
    for x, (a, u) in enumerate(good):
        n[x] = sum(u @ v / math.sqrt((u @ u) * (v @ v)) >= 0.95 for y, (_, v) in enumerate(good) if y != x)
    expected = sorted(((i, n[x], of[i], i == of[i]) for x, (i, _) in enumerate(rows)), key=repr)
    assert len(set(of.values())) < 60
    assert rows_of(embedding_dedup.near_embeddings(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))) == expected


def test_estimates_are_unbiased():
    r = np.random.default_rng(7)
    x, y = embedding_dedup._unit(r.standard_normal((2000, 64))), embedding_dedup._unit(r.standard_normal((2000, 64)))
    error = []
    for seed in range(5):
        _, code, factor = embedding_dedup.codes(x, seed)
        turned = y @ embedding_dedup.rotation(64, seed).T
        error.append(np.einsum("ij,ij->i", code, turned) / factor - np.einsum("ij,ij->i", x, y))
        assert (np.abs(error[-1]) <= embedding_dedup.slack(factor, 64, 6.0)).all()
    assert abs(np.mean(error)) < 0.005


# Tokens


def test_bpe_equals_tiktoken(docs, none):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = {(r[0], r[1], r[2], r[3]) for r in bpe.bpe_digests(docs, path, public_tokenizers.PATTERN, at_once=500, remember=50).collect()}
    expected = set()
    for i, t, *_ in documents():
        ids = enc.encode_ordinary(t or "")
        expected.add((i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert got == expected
    for r in bpe.bpe_round_trip(docs, path, public_tokenizers.PATTERN).collect():
        assert len(r["ids"]) == r["n_tokens"]
    assert bpe.bpe_digests(none, path, public_tokenizers.PATTERN).count() == 0


def test_long_words_equal_tiktoken():
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    codec = bpe.WordCodec(path)
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=codec.ranks, special_tokens={})
    r = random.Random(2)
    words = []
    for n in (127, 128, 129, 199, 200, 201, 255, 256, 257, 385, 5000, 20_000):
        words += ["".join(r.choice(some) for _ in range(n)) for some in ("abcdefghijklmnopqrstuvwxyz", "etaoin", "é中a")] + ["a" * n, "=" * n, "the" * (n // 3 + 1), " " * n, "-" * n + "==="]
    for word, (ids, decoded) in zip(words, codec.encode([w.encode() for w in words], 300_000)):
        assert list(map(int, ids.split())) == enc._core_bpe.encode_single_piece(word.encode()), (word[:9], len(word))
        assert decoded == word.encode()
    assert codec.encode([], 300_000) == []


def test_memory_of_words_stays_bounded():
    memory = bpe._Memory(10)
    for k in range(50):
        distinct = {"always", f"w{k}", f"v{k}", "x" * bpe.LONG + str(k)}
        new = memory.room_for(distinct.difference(memory.ids), distinct)
        for x in new:
            memory.ids[x] = memory.bytes[x] = x
        assert distinct <= set(memory.ids) and len(memory.ids) <= 10
        memory.forget_long(new)
        assert not any(len(x) >= bpe.LONG for x in memory.ids)
    assert "always" not in new


def test_spread_join_of_a_hot_key(spark):
    left = spark.createDataFrame([(1, k) for k in range(3000)] + [(2 + k, k) for k in range(50)], "a long, b long")
    right = spark.createDataFrame([(k, f"t{k}") for k in range(40)], "u long, t string")
    counts = left.groupBy("a").agg({"*": "count"}).withColumnRenamed("count(1)", "n")
    got = sorted(tuple(r) for r in common.spread_join(left, right, "a", "u", counts, 3050, "b", least=100).select("a", "b", "t").collect())
    assert got == sorted((a, b, f"t{a}") for a, b in [(1, k) for k in range(3000)] + [(2 + k, k) for k in range(50)] if a < 40)


def test_sifted_keeps_what_a_join_needs(spark):
    rows = spark.range(5000).union(spark.createDataFrame([(None,), (-7,)], "id long")).withColumnRenamed("id", "k")
    ids = spark.createDataFrame([(i,) for i in (0, 1, 17, 4999, -7, 10**12)], "w long")
    for bits in (None, 1 << 24, 1 << 16, 64):
        got = {r["k"] for r in common.sifted(rows, "k", ids, "w", bits).collect()}
        assert {0, 1, 17, 4999, -7} <= got and (bits == 64 or len(got) < 100)
    assert common.sifted(rows, "k", ids.limit(0), "w").count() == 0


@pytest.mark.parametrize("piece", ["<a x=", "<title>", "<a \"", "<a<a", "</a ", "<script ", "<a 'b\" ", "<title></head>", "<! ", "<div>", "</x>"])
def test_blocks_take_linear_time(piece):
    def took(n):
        t = time.process_time()
        html_text.blocks_of(piece * n)
        return time.process_time() - t

    took(100)
    assert took(40_000) < 8 * took(10_000) + 0.5


def test_bpe_remembers_decoded_bytes_only_where_they_differ():
    from corvid.llm import bpe as module

    memory = module._Memory(10)
    memory.put("ab", b"ab", "1 2", b"ab")
    memory.put("c", b"c", "3", b"other")
    assert memory.bytes == {"c": b"other"} and [memory.decoded(x) for x in ("ab", "c")] == [b"ab", b"other"]
    memory.put("x" * module.LONG, b"x" * module.LONG, "4", b"x" * module.LONG)
    memory.forget_long({"ab", "x" * module.LONG})
    assert set(memory.ids) == {"ab", "c"}


def test_a_worker_without_bpe_tasks_forgets_words_and_codec(monkeypatch):
    import sys

    import pyarrow as pa

    monkeypatch.setattr(bpe, "IDLE", 0.2)
    run = bpe._codec_rows(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, 100, 1000, False)
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array(["some words of a text", None])], ["id", "t"])
    first = [b.to_pylist() for b in run(iter([batch]))]
    kept = sys.modules["corvid_worker"].__dict__
    until = time.time() + 10
    while time.time() < until and ("codec" in kept or "words" in kept):
        time.sleep(0.05)
    assert "codec" not in kept and "words" not in kept
    assert [b.to_pylist() for b in run(iter([batch]))] == first
