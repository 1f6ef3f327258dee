"""Chat formatting, hard negatives and source divergence against plain restatements, on rows with nulls, ties, repeats, long texts and clashing columns."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from corvid.llm import chat, divergence, hard_negatives

CONTROLS = ["<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "[ROLE]", "[TEXT]", "[/ROLE]"]
PIECES = [*CONTROLS, "\\", "\\\\", " ", "a", "\n", "<", "</", "[", "SYS>>", "s>", "é", "\x00"]


def test_any_turn_reads_back():
    rnd, grammar = random.Random(2), chat.Grammar(chat.Template())
    for _ in range(20_000):
        role = rnd.choice(["user", "assistant", "system", "tool", "".join(rnd.choice(PIECES) for _ in range(rnd.randrange(4)))])
        text = "".join(rnd.choice(PIECES) for _ in range(rnd.randrange(8)))
        out, start, end, rounds = grammar.render(role, text)
        turns, wrong = grammar.read("<s>" + out + out)
        assert wrong == -1 and [t[:2] for t in turns] == [(role, text)] * 2 and rounds <= 3
        assert grammar._half(out, start, end) == text


def test_texts_without_control_strings_are_not_escaped():
    grammar = chat.Grammar(chat.Template())
    assert grammar.render("user", "a \\ b")[0] == "[INST] a \\ b [/INST]"
    assert grammar.render("assistant", "</s>")[0] == "\\</s></s>"


@pytest.mark.parametrize("text", ["", "a</s>", "<s>a</s", "<s>[INST] a</s>", "<s>[INST]a [/INST]", "<s>[/INST]", "<s>a</s>rest", "<s>[ROLE]x[/ROLE]", "<s>[ROLE]x[TEXT]y", "<s><s>a</s>"])
def test_what_is_no_conversation_is_not_read(text):
    assert chat.Grammar(chat.Template()).read(text)[1] >= 0


def test_templates_that_can_be_confused_are_refused():
    for roles in ({"user": ("", "<u>"), "assistant": ("", "</s>")}, {"user": ("<s>>", "<u>")}, {"user": ("s><u", "<v>")}, {"user": ("<u>", "")}, {"user": ("<u>", "<u>")}, {"user": ("\\u", "<v>")}):
        with pytest.raises(ValueError):
            chat.Template(roles=roles)


def said():
    rnd = random.Random(3)
    rows = [(c, t, rnd.choice(["user", "assistant", "system", "tool", None]), "".join(rnd.choice(PIECES[:-1]) for _ in range(rnd.randrange(12)))) for c in range(12) for t in range(rnd.randrange(1, 9))]
    rows += [(20, 0, "user", None), (20, 0, "user", None), (20, None, "assistant", ""), (20, 1, "assistant", None), (None, 0, "user", "x"), (None, 5, "assistant", "y")]
    rows += [(21, k, "assistant" if k % 2 else "user", "</s>" * 3000 + "z" * 5000) for k in range(40)] + [(22, 0, "assistant", "\\" * 9999)]
    return [(*r, 1, 2, "p", 4) for r in rows]


SAID = "conv_id long, turn long, role string, text string, start int, end int, segment string, part int"


@pytest.mark.parametrize("part_chars", [10, 1 << 20])
def test_conversations_read_back_from_their_parts(spark, part_chars):
    rows = said()
    df = spark.createDataFrame(rows, SAID).repartition(5)
    parts = chat.format_conversations(df, part_chars=part_chars)
    by = defaultdict(list)
    grammar = chat.Grammar(chat.Template())
    for c, t, role, text, *_ in rows:
        by[c].append((-1 if t is None else t, role or "", grammar.render(role or "", text or "")[0], text or ""))
    want = {}
    for c, turns in by.items():
        turns.sort()
        loss = "".join(x[3] for x in turns if x[1] == "assistant")
        want[c] = (c, len(turns), hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, _, x in turns).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), 3 + sum(len(x[2]) for x in turns))
    assert {r["conv_id"]: tuple(r) for r in chat.chat_digests(df, part_chars=part_chars).collect()} == want
    assert {r["conv_id"]: tuple(r) for r in chat.read_back(parts.repartition(3)).collect()} == want
    found = parts.collect()
    assert max(len(r["text"]) for r in found if r["conv_id"] != 21) < 30_000 and len(found) >= (40 if part_chars == 10 else 16)
    first = next(r for r in found if r["conv_id"] == 22)
    assert [first["text"][s["start"] : s["end"]] for s in first["loss"]] == ["\\" * 9999 * 2]


def test_chat_without_rows(spark):
    assert chat.chat_digests(spark.createDataFrame([], SAID)).collect() == []


def vectors(seed, n, d, spread=1.0):
    rnd = np.random.default_rng(seed)
    return (rnd.standard_normal((n, d)) * spread).tolist()


def mined(rows, positives=5, negatives=10):
    good = []
    for i, v, label in rows:
        if i is not None and label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            good.append((i, [math.floor(256 * x) for x in v], label))
    out = []
    for a, u, label in good:
        if a % 100 == 0:
            met = sorted((-sum(x * y for x, y in zip(u, v)), i, other == label) for i, v, other in good if i != a and len(v) == len(u))
            for s, p, _ in [m for m in met if m[2]][:positives]:
                inside = [m for m in met if not m[2] and 30 * -s <= 100 * -m[0] <= 90 * -s][:negatives]
                out += [(a, p, k, i, -s, -t) for k, (t, i, _) in enumerate(inside, 1)]
    return sorted(out)


@pytest.mark.parametrize("block_rows, query_rows", [(7, 2), (4096, 512)])
def test_hard_negatives(spark, block_rows, query_rows):
    rows = [(k * 10, v, k % 3) for k, v in enumerate(vectors(1, 160, 9))] + [(5 + k * 25, v, k % 2) for k, v in enumerate(vectors(2, 30, 4))]
    rows += [(10_000 + k * 50, v, k % 4) for k, v in enumerate(np.round(vectors(3, 40, 3), 0).tolist())]  # ties
    rows += [(20_000 + k * 50, v, k % 2) for k, v in enumerate(vectors(4, 20, 2, 1e6))] + [(30_000 + k * 50, v, k % 2) for k, v in enumerate(vectors(5, 6, 1, 1e4))]
    rows += [(300, None, 1), (400, [1.0, None], 1), (500, [float("nan")] * 9, 1), (600, [float("inf")] * 9, 2), (700, vectors(6, 1, 9)[0], None), (None, vectors(7, 1, 9)[0], 1), (40_000, [], 1), (40_001, [], 1), (40_002, [], 2)]
    df = spark.createDataFrame([(*r, 1, 2, 3.0) for r in rows], "vec_id long, embedding array<double>, label int, id int, query int, score double").repartition(3)
    got = hard_negatives.hard_negatives(df, block_rows=block_rows, query_rows=query_rows, fit_rows=50)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert sorted(tuple(r) for r in got.collect()) == mined(rows)


def test_hard_negatives_of_repeated_ids_and_copies(spark):
    v = vectors(8, 1, 6)[0]
    near = [[x + y / 9 for x, y in zip(v, w)] for w in vectors(9, 60, 6)]
    rows = [(0, v, 1), (100, v, 1), (100, near[0], 1), *[(k, v, k % 2) for k in range(1, 40)], *[(200 + k, w, k % 3) for k, w in enumerate(near)]]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label long")
    for low, high in ((30, 90), (90, 100)):
        got = sorted(tuple(r) for r in hard_negatives.hard_negatives(df, low=low, high=high, block_rows=16).collect())
        if (low, high) == (30, 90):
            assert got == mined(rows)
        else:
            assert got and all(90 * r[4] <= 100 * r[5] <= 100 * r[4] for r in got)


def test_scores_beyond_doubles_stay_whole(spark):
    big = [(100, [1e9, 3.0], 1), (1, [1e9, 1.0], 1), (2, [0.5e9, 1.0], 2), (3, [0.5e9, 2.0], 2), (4, [0.5e9 + 1, -1.0], 2), (5, [1e300, 1.0], 1), (6, [1e308, 1.0], 1)]
    got = hard_negatives.hard_negatives(spark.createDataFrame(big, "vec_id long, embedding array<double>, label long"), n_positives=2).collect()
    top = sorted({(r["positive_id"], r["positive_score"]) for r in got})
    assert top == []  # the products of 256e9 and its like leave 64 bits, so they are all held to the same number
    small = [(i, [x / 1e4 for x in v], label) for i, v, label in big[:5]]
    got = hard_negatives.hard_negatives(spark.createDataFrame(small, "vec_id long, embedding array<double>, label long")).collect()
    assert sorted(tuple(r) for r in got) == mined(small) and any(r["negative_score"] > 1 << 53 for r in [*got]) is False


def test_estimates_stay_within_their_bound():
    x = np.floor(256 * np.random.default_rng(5).standard_normal((500, 7)))
    books = hard_negatives.Codebooks(x[:100].tolist(), 16)
    codes, rest = books.code(x)
    est, lost = hard_negatives.estimates(x[:20], codes, books.of[7])
    assert (np.abs(est.T - x[:20] @ x.T) <= hard_negatives.norms(x[:20])[:, None] * rest[None, :] + lost).all()
    assert rest.mean() < 0.5 * hard_negatives.norms(x).mean()


def test_hard_negatives_without_rows(spark):
    assert hard_negatives.hard_negatives(spark.createDataFrame([], "vec_id long, embedding array<double>, label long")).collect() == []


def diverging(rows, top=200, min_docs=3):
    docs = [(lang or "", source or "", [w.translate({k: k + 32 for k in range(65, 91)}) for w in re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", text or "")]) for lang, source, text in rows]
    out = []
    for lang in {d[0] for d in docs}:
        held = Counter(w for d in docs if d[0] == lang for w in set(d[2]))
        kept = sorted(w for w, n in held.items() if n >= min_docs)
        sources = sorted({d[1] for d in docs if d[0] == lang}, key=lambda x: x.encode())

        def shares(texts, kept=kept):
            c = Counter(w for t in texts for w in t)
            n = sum(c[w] for w in kept)
            return {w: 1 + 1_000_000_000 * (c[w] + 1) // (n + len(kept)) for w in kept}, c

        p = {s: shares([d[2] for d in docs if d[:2] == (lang, s)]) for s in sources}
        q, _ = shares([d[2] for d in docs if d[0] == lang])
        for s in sources:
            pairs = [(-sum((p[s][0][w] - p[t][0][w]) ** 2 // p[t][0][w] for w in kept), t.encode(), t) for t in sources if t != s]
            out += [(lang, s, "pair", t, -v, k) for k, (v, _, t) in enumerate(sorted(pairs), 1)]
            terms = [(-((p[s][0][w] - q[w]) ** 2 // q[w]), w.encode(), w) for w in kept if p[s][1][w] and p[s][0][w] > q[w]]
            out += [(lang, s, "term", w, -v, k) for k, (v, _, w) in enumerate(sorted(terms)[:top], 1)]
    return sorted(out)


def texts(seed, n, sources):
    rnd = random.Random(seed)
    common, rare = ["the", "Of", "ÉTÉ", "été"], [f"w{chr(97 + a)}{chr(97 + b)}" for a in range(26) for b in range(8)]
    return [("en" if rnd.random() < 0.8 else "fr", f"s{min(int(rnd.expovariate(0.3)), sources - 1)}", " ".join(rnd.choice(common) if rnd.random() < 0.4 else rnd.choice(rare[: 20 + k % 190]) for _ in range(rnd.randrange(30)))) for k in range(n)]


@pytest.mark.parametrize("tile, chunk, task_bytes", [(64, 2048, 1 << 26), (2, 3, 3000), (3, 16, 1)])
def test_divergence(spark, tile, chunk, task_bytes):
    rows = texts(1, 250, 11) + [(None, None, None), ("en", None, "the the wab"), ("xx", "a", ""), ("xx", "b", "1 2 3"), ("de", "a", "Über über ÜBER"), ("de", "a", "über"), ("de", "b", "über " * 3000), ("de", "b", "x" * 100_000)]
    df = spark.createDataFrame([(*r, 1, 2, 3, "t") for r in rows], "lang string, source string, text string, p int, q int, b int, term string").repartition(4)
    got = divergence.divergence(df, tile=tile, chunk=chunk, task_bytes=task_bytes)
    assert sorted(tuple(r) for r in got.collect()) == diverging(rows)
    assert sorted(tuple(r) for r in divergence.divergence(df, top=2, min_docs=5, tile=tile).collect()) == diverging(rows, 2, 5)


def test_divergence_of_many_sources_by_lookups(spark, monkeypatch):
    """Groups looked up with their hot keys apart, and postings cut by blocks."""
    attach = divergence._attach
    monkeypatch.setattr(divergence, "_attach", lambda rows, index, n, keys, values: attach(rows, index, n, keys, values, most=0))
    rows = texts(2, 400, 30) + [("en", f"s{k}", "wide wide") for k in range(14)]
    df = spark.createDataFrame(rows, "lang string, source string, text string")
    assert sorted(tuple(r) for r in divergence.divergence(df, tile=4, chunk=5).collect()) == diverging(rows)


def test_divergence_without_rows(spark):
    assert divergence.divergence(spark.createDataFrame([], "lang string, source string, text string")).collect() == []
