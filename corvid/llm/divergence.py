"""How far the sources of a language diverge: pairs of sources, and the terms that set a source apart from its language.

1. A task counts terms by (lang, source), with the documents that hold them, before anything is shuffled.
2. A term in ``min_docs`` documents of its language is kept. Shares p are whole numbers, computed as decimals.
3. f(p, q) = floor((p - q)^2 / q) is summed over all kept terms for each pair of sources. All sums are taken against
   f0 = f(p0, q0), of the shares p0 and q0 of terms that a source doesn't have, so that V * f0 stands for all terms, and
   terms in neither source of a pair cost nothing:

   - heavy terms, in at least half of a language's sources: dense tiles of up to ``tile`` sources by ``chunk`` terms meet
     pairwise and add f - f0;
   - rare terms: what one source has alone depends on its count only, so a histogram of counts a source adds
     f(p, q0) - f0 and f(p0, q) - f0 to all its pairs; pairs within a term's postings add the rest,
     f(p, q) - f(p, q0) - f(p0, q) + f0, summed inside the task. Postings of more than ``tile`` sources are cut by
     blocks of sources, so that no row and no group grows with a term.

   The three sums are whole numbers and are added exactly.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvid.llm.common import drop_shared, lookup, write_shared

#: Letters of ASCII and all beyond ASCII, in UTF-8 bytes that are lower-cased (which changes A-Z only).
TERM = re.compile(rb"[a-z\x80-\xff]+")
SCALE = 1_000_000_000
PARTIAL = "lang string, source string, term string, c long, docs long"


def _counted(most: int):
    """Counts and documents by (lang, source, term) in a task, given out whenever their keys reach ``most`` bytes; a null term marks that a group occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups: dict[tuple, dict[bytes, list[int]]] = {}
        held = 0
        for batch in batches:
            for lang, source, text in zip(*(c.to_pylist() for c in batch.columns)):
                if (group := groups.get((lang, source))) is None:
                    group = groups[lang, source] = {None: [0, 0]}
                    held += 100
                in_text: dict[bytes, int] = {}
                for term in TERM.findall(text.encode().lower()):
                    in_text[term] = in_text.get(term, 0) + 1
                for term, n in in_text.items():
                    if (found := group.get(term)) is None:
                        group[term] = [n, 1]
                        held += len(term) + 200
                    else:
                        found[0] += n
                        found[1] += 1
                if held > most:
                    yield from out(groups)
                    groups, held = {}, 0
        yield from out(groups)

    def out(groups: dict) -> Iterator[pa.RecordBatch]:
        for (lang, source), terms in groups.items():
            n = len(terms)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * n, pa.string()), pa.array([source] * n, pa.string()), pa.array([t if t is None else t.decode() for t in terms], pa.string()), pa.array([x[0] for x in terms.values()], pa.int64()), pa.array([x[1] for x in terms.values()], pa.int64())], ["lang", "source", "term", "c", "docs"])

    return run


def gap(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // q


def _sums(source: np.ndarray, other: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Whole-number sums of ``value`` by (source, other)."""
    order = np.lexsort((other, source))
    source, other, value = source[order], other[order], value[order]
    starts = np.flatnonzero(np.concatenate([[True], (source[1:] != source[:-1]) | (other[1:] != other[:-1])])) if len(source) else np.empty(0, int)
    return source[starts], other[starts], np.add.reduceat(value, starts) if len(starts) else value


def _tile(rows: pd.DataFrame) -> pd.DataFrame:
    """Entries (source, p0, term, p) of one block of sources and one chunk of terms (a null term: the source itself) as one dense matrix."""
    marks = rows[rows["term"].isna()]
    entries = rows[rows["term"].notna()]
    sources, terms = sorted(marks["source"]), sorted(entries["term"].unique())
    p0 = marks.set_index("source")["p0"]
    dense = np.repeat(p0.loc[sources].to_numpy(np.int64)[:, None], len(terms), 1)
    dense[np.searchsorted(np.array(sources, object), entries["source"].to_numpy(object)), np.searchsorted(np.array(terms, object), entries["term"].to_numpy(object))] = entries["p"].to_numpy(np.int64)
    row = [rows["lang"].iloc[0], int(rows["b"].iloc[0]), int(rows["chunk"].iloc[0]), sources, [int(p0[s]) for s in sources], terms, dense.astype("<i4").tobytes()]
    return pd.DataFrame([row], columns=["lang", "b", "chunk", "sources", "p0", "terms", "dense"])


TILE = "lang string, b long, chunk long, sources array<string>, p0 array<long>, terms array<string>, dense binary"
SUMS = "lang string, source string, other string, value long"


def _dense_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of tiles (a, b) of one chunk: f - f0 summed over their terms, both ways (one way each where a is b)."""

    def spread(r: dict, side: str, terms: list[str]) -> tuple[np.ndarray, np.ndarray]:
        p0 = np.array(r[f"{side}_p0"], np.int64)
        dense = np.frombuffer(r[f"{side}_dense"], "<i4").reshape(len(p0), -1)
        out = np.repeat(p0[:, None], len(terms), 1)
        place = {t: k for k, t in enumerate(terms)}
        out[:, [place[t] for t in r[f"{side}_terms"]]] = dense
        return p0, out

    for batch in batches:
        for r in batch.to_pylist():
            terms = r["a_terms"] if r["a_b"] == r["b_b"] else sorted({*r["a_terms"], *r["b_terms"]})
            (p0, p), (q0, q) = spread(r, "a", terms), spread(r, "b", terms)
            for x0, x, y0, y, xs, ys in ((p0, p, q0, q, r["a_sources"], r["b_sources"]), (q0, q, p0, p, r["b_sources"], r["a_sources"]))[: 1 if r["a_b"] == r["b_b"] else 2]:
                n = len(ys)
                for k, s in enumerate(xs):
                    value = gap(x[k][None, :], y).sum(1) - len(terms) * gap(x0[k], y0)
                    yield pa.RecordBatch.from_arrays([pa.array([r["lang"]] * n, pa.string()), pa.array([s] * n, pa.string()), pa.array(ys, pa.string()), pa.array(value, pa.int64())], ["lang", "source", "other", "value"])


def _single(rows: pd.DataFrame) -> pd.DataFrame:
    """The sources of a block with their histograms of rare terms' shares, as one row."""
    marks = rows[rows["p"].isna()].sort_values("source")
    of = {s: x for s, x in rows[rows["p"].notna()].groupby("source")}
    none = rows.iloc[:0]
    row = [rows["lang"].iloc[0], int(rows["b"].iloc[0]), int(rows["v"].iloc[0]), list(marks["source"]), [int(x) for x in marks["p0"]], [[int(x) for x in of.get(s, none)["p"]] for s in marks["source"]], [[int(x) for x in of.get(s, none)["n"]] for s in marks["source"]]]
    return pd.DataFrame([row], columns=["lang", "b", "v", "sources", "p0", "ps", "ns"])


SINGLE = "lang string, b long, v long, sources array<string>, p0 array<long>, ps array<array<long>>, ns array<array<long>>"


def _single_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of blocks a and b: V * f0, and what the rare terms of one source alone add, for all (source of a, other source of b)."""
    for batch in batches:
        for r in batch.to_pylist():
            p0, q0 = np.array(r["a_p0"], np.int64), np.array(r["b_p0"], np.int64)
            value = r["a_v"] * gap(p0[:, None], q0[None, :]) if r["a_v"] else np.zeros((len(p0), len(q0)), np.int64)
            for k in range(len(p0)):
                p, n = np.array(r["a_ps"][k], np.int64), np.array(r["a_ns"][k], np.int64)
                for s in range(0, len(p), 1 << 14):
                    part = slice(s, s + (1 << 14))
                    value[k] += (n[part][:, None] * (gap(p[part][:, None], q0[None, :]) - gap(p0[k], q0)[None, :])).sum(0)
            for k in range(len(q0)):
                q, n = np.array(r["b_ps"][k], np.int64), np.array(r["b_ns"][k], np.int64)
                for s in range(0, len(q), 1 << 14):
                    part = slice(s, s + (1 << 14))
                    value[:, k] += (n[part][:, None] * (gap(p0[None, :], q[part][:, None]) - gap(p0, q0[k])[None, :])).sum(0)
            n = len(q0)
            for k, s in enumerate(r["a_sources"]):
                yield pa.RecordBatch.from_arrays([pa.array([r["lang"]] * n, pa.string()), pa.array([s] * n, pa.string()), pa.array(r["b_sources"], pa.string()), pa.array(value[k], pa.int64())], ["lang", "source", "other", "value"])


def _posting_pairs(most: int):
    """Rows (lang, term, i, j, source, b, p, p0), together by the first four: what both sources of a pair have, summed in the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers: dict[tuple, int] = {}
        sums: dict[tuple[int, int], int] = {}
        now: tuple = ()
        held: list[tuple] = []
        ready: dict[int, list[list[tuple]]] = {}
        size = 0

        def add(x: np.ndarray, y: np.ndarray) -> None:
            """Pairs of rows of x (source, p, p0 by list and place) with rows of y, both ways."""
            for u, v in ((x, y), (y, x)):
                p, p0, q, q0 = (c.astype(np.int64) for c in (u[..., 1][:, :, None], u[..., 2][:, :, None], v[..., 1][:, None, :], v[..., 2][:, None, :]))
                value = gap(p, q) - gap(p, q0) - gap(p0, q) + gap(p0, q0)
                a, b = np.broadcast_arrays(u[..., 0][:, :, None], v[..., 0][:, None, :])
                for s, t, n in zip(*(c.tolist() for c in _sums(a.ravel(), b.ravel(), value.ravel()))):
                    if s != t:
                        sums[s, t] = sums.get((s, t), 0) + n
                if x is y:
                    return

        def settle() -> None:
            for lists in ready.values():
                x = np.array(lists, np.int64)
                step = max(1, (1 << 20) // x.shape[1] ** 2)
                for k in range(0, len(x), step):
                    part = x[k : k + step]
                    add(part, part)
            ready.clear()

        def close() -> None:
            nonlocal size
            if len(held) > 1 and now[2] == now[3]:
                ready.setdefault(len(held), []).append([r[:3] for r in held])
                size += len(held)
            elif len(held) > 1:
                left, right = ([r[:3] for r in held if r[3] == now[k]] for k in (2, 3))
                if left and right:
                    add(np.array([left], np.int64), np.array([right], np.int64))
            held.clear()

        def out() -> Iterator[pa.RecordBatch]:
            settle()
            names, pairs = list(numbers), list(sums.items())
            for k in range(0, len(pairs), 10_000):
                part = pairs[k : k + 10_000]
                yield pa.RecordBatch.from_arrays([pa.array([names[a][0] for (a, _), _ in part], pa.string()), pa.array([names[a][1] for (a, _), _ in part], pa.string()), pa.array([names[b][1] for (_, b), _ in part], pa.string()), pa.array([n for _, n in part], pa.int64())], ["lang", "source", "other", "value"])
            sums.clear()
            numbers.clear()

        for batch in batches:
            for lang, term, i, j, source, b, p, p0 in zip(*(c.to_pylist() for c in batch.columns)):
                if now != (lang, term, i, j):
                    close()
                    now = (lang, term, i, j)
                    if size > most:
                        settle()
                        size = 0
                    if len(sums) > most:
                        yield from out()
                held.append((numbers.setdefault((lang, source), len(numbers)), p, p0, b))
        close()
        yield from out()

    return run


SHARE = "1 + (cast(1000000000 as decimal(10, 0)) * cast({0} + 1 as decimal(20, 0))) div cast({1} + v as decimal(20, 0))"
GAP = "(p - q) * (p - q) div q"


def _attach(rows: DataFrame, index: DataFrame, n: int, keys: list[str], values: list[str], most: int = 100_000) -> DataFrame:
    """``values`` of the ``index`` row of ``n`` that has the row's keys; up to ``most`` rows are broadcast, more are looked up with their hot keys apart."""
    if n <= most:
        return rows.join(F.broadcast(index.select(*keys, *values)), keys)
    return write_shared(lookup(rows, index, keys, "rows", values), "attached")[0]


def divergence(docs: DataFrame, top: int = 200, min_docs: int = 3, lang_col: str = "lang", source_col: str = "source", text_col: str = "text", tile: int = 64, chunk: int = 2048, task_bytes: int = 64 << 20) -> DataFrame:
    """Rows (lang, source, part, item, value, rank) of every (lang, source) group.

    Part ``pair``: for every other source of the language, f summed over its kept terms (0 without any). Part ``term``:
    the group's kept terms with a greater share than in the language, up to rank ``top``. Null texts, languages and
    sources are empty ones; rows that repeat count again. Other columns are ignored, whatever their names. No rows give
    no rows.
    """
    spark = docs.sparkSession
    text = docs.select(*[F.coalesce(F.col(c), F.lit("")).alias(n) for n, c in (("lang", lang_col), ("source", source_col), ("text", text_col))])
    counts, counts_path = write_shared(text.mapInArrow(_counted(task_bytes), PARTIAL).groupBy("lang", "source", "term").agg(F.sum("c").alias("c"), F.sum("docs").alias("docs")), "counts")
    every = counts.filter("term is not null")
    terms, terms_path = write_shared(every.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("c").alias("total"), F.count("*").alias("k")).filter(F.col("docs") >= min_docs).drop("docs"), "terms")
    kept, kept_path = write_shared(every.select("lang", "source", "term", "c").join(terms, ["lang", "term"]), "kept")

    present = counts.select("lang", "source").distinct()
    langs = present.groupBy("lang").agg(F.count("*").alias("s")).join(terms.groupBy("lang").agg(F.count("*").alias("v"), F.sum("total").alias("n_lang")), "lang", "left")
    langs = langs.select("lang", "s", F.coalesce("v", F.lit(0)).alias("v"), F.coalesce("v", F.lit(0)).alias("rows"), F.coalesce("n_lang", F.lit(0)).alias("n_lang"), F.ceil(F.col("s") / tile).alias("nb"))
    langs, langs_path = write_shared(langs, "langs")
    n_langs = langs.count()
    heavy_terms = _attach(terms, langs, n_langs, ["lang"], ["s"]).filter("2 * k >= s").groupBy("lang").agg(F.ceil(F.count("*") / chunk).alias("chunks"))
    sums = kept.groupBy("lang", "source").agg(F.sum("c").alias("n"), F.count("*").alias("rows"))
    groups = present.join(sums, ["lang", "source"], "left").select("lang", "source", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("rows", F.lit(0)).alias("rows"))
    groups = groups.join(langs.drop("rows"), "lang").join(heavy_terms, "lang", "left").withColumn("b", F.expr("pmod(xxhash64(source), nb)"))
    groups = groups.select("*", F.expr(f"case when v > 0 then {SHARE.format(0, 'n')} else 1 end").alias("p0"))
    groups, groups_path = write_shared(groups, "groups")
    n_groups = groups.count()

    shares = _attach(kept, groups, n_groups, ["lang", "source"], ["n", "v", "n_lang", "s", "b", "chunks", "p0"]).withColumn("p", F.expr(SHARE.format("c", "n")))
    apart = shares.withColumn("q", F.expr(SHARE.format("total", "n_lang"))).filter("c > 0 and p > q").select("lang", "source", F.col("term").alias("item"), F.expr(GAP).alias("value"))
    ranked = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    terms_apart, _ = write_shared(apart.withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") <= top), "apart")

    pairs, pairs_path = write_shared(_pairs(shares, groups, tile).filter("source <> other").groupBy("lang", "source", "other").agg(F.sum("value").alias("value")), "pairs")
    drop_shared(spark, counts_path, terms_path, kept_path, langs_path, groups_path)
    pairs = pairs.select("lang", "source", F.col("other").alias("item"), "value").withColumn("rank", F.row_number().over(ranked))
    columns = ["lang", "source", "part", "item", "value", F.col("rank").cast("int").alias("rank")]
    return pairs.withColumn("part", F.lit("pair")).select(*columns).union(terms_apart.withColumn("part", F.lit("term")).select(*columns))


def _met(keys: DataFrame, packed: DataFrame, on: list[str]) -> DataFrame:
    """The two packed rows of each (lang, .., i, j)."""
    for side, place in (("a", "i"), ("b", "j")):
        named = packed.select(*[F.col(c).alias(f"{side}_{c}" if c not in on else c) for c in packed.columns], F.col("b").alias(place))
        keys = keys.join(named, [*on, place])
    return keys


def _pairs(shares: DataFrame, groups: DataFrame, tile: int) -> DataFrame:
    """Sums by (lang, source, other) that add up to each pair's value."""
    per_lang = groups.groupBy("lang").agg(F.first("nb").alias("nb"), F.first("chunks").alias("chunks"))
    blocks = per_lang.withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("nb") - 1)))
    every = F.expr("explode(sequence(0L, chunks - 1))")

    heavy = shares.filter("2 * k >= s").select("lang", "b", F.expr("pmod(xxhash64(term), chunks)").alias("chunk"), "source", "p0", "term", "p")
    marks = groups.filter("chunks > 0").select("lang", "b", every.alias("chunk"), "source", "p0", F.lit(None).cast("string").alias("term"), F.lit(None).cast("long").alias("p"))
    tiles, _ = write_shared(heavy.union(marks).groupBy("lang", "b", "chunk").applyInPandas(_tile, TILE), "tiles")
    up = blocks.filter("chunks > 0").select("lang", "i", F.expr("explode(sequence(i, nb - 1))").alias("j"), "chunks").select("lang", "i", "j", every.alias("chunk"))
    dense = _met(up, tiles, ["lang", "chunk"]).mapInArrow(_dense_pairs, SUMS)

    rare = shares.filter("2 * k < s")
    histogram = rare.groupBy("lang", "source", "b", "p").agg(F.count("*").alias("n")).select("lang", "b", F.lit(0).cast("long").alias("v"), "source", F.lit(0).cast("long").alias("p0"), "p", "n")
    marks = groups.select("lang", "b", "v", "source", "p0", F.lit(None).cast("long").alias("p"), F.lit(None).cast("long").alias("n"))
    singles, _ = write_shared(marks.union(histogram).groupBy("lang", "b").applyInPandas(_single, SINGLE), "singles")
    all_ = blocks.select("lang", "i", F.expr("explode(sequence(0L, nb - 1))").alias("j"))
    single = _met(all_, singles, ["lang"]).mapInArrow(_single_pairs, SUMS)

    posted = rare.filter("k > 1").select("lang", "term", "source", "b", "p", "p0", "k")
    whole = posted.filter(F.col("k") <= tile).select("lang", "term", F.lit(-1).cast("long").alias("i"), F.lit(-1).cast("long").alias("j"), "source", "b", "p", "p0")
    long_ = posted.filter(F.col("k") > tile)
    cut = long_.join(long_.groupBy("lang", "term").agg(F.collect_set("b").alias("at")), ["lang", "term"]).withColumn("o", F.explode("at"))
    cut = cut.select("lang", "term", F.least("b", "o").alias("i"), F.greatest("b", "o").alias("j"), "source", "b", "p", "p0")
    key = ["lang", "term", "i", "j"]
    both = whole.union(cut).repartition(*key).sortWithinPartitions(*key).mapInArrow(_posting_pairs(1 << 20), SUMS)
    return dense.union(single).union(both)


ORACLE_SQL = r"""
WITH said AS (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
words AS (SELECT lang, source, r, unnest(terms) AS term FROM said),
terms AS (SELECT lang, term, count(*) AS total FROM words GROUP BY lang, term HAVING count(DISTINCT r) >= 3),
langs AS (SELECT lang, count(*) AS v, sum(total)::BIGINT AS n FROM terms GROUP BY lang),
counts AS (SELECT lang, source, term, count(*) AS c FROM words JOIN terms USING (lang, term) GROUP BY lang, source, term),
sizes AS (SELECT lang, source, sum(c)::BIGINT AS n FROM counts GROUP BY lang, source),
groups AS (SELECT DISTINCT lang, source FROM said),
shares AS (
  SELECT g.lang, g.source, t.term, coalesce(c.c, 0) AS c, 1 + (1000000000 * (coalesce(c.c, 0) + 1)) // (coalesce(z.n, 0) + l.v) AS p, 1 + (1000000000 * (t.total + 1)) // (l.n + l.v) AS q
  FROM groups g JOIN langs l USING (lang) JOIN terms t USING (lang) LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = t.term LEFT JOIN sizes z ON z.lang = g.lang AND z.source = g.source),
sums AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0)::BIGINT AS value FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
apart AS (SELECT lang, source, 'term' AS part, term AS item, (((p - q) * (p - q)) // q)::BIGINT AS value FROM shares WHERE c > 0 AND p > q)
SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM apart) QUALIFY part = 'pair' OR rank <= 200
"""
