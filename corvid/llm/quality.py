"""Quality classifier: a generalised additive model with pairwise interactions.

Features of a text are binned; boosting cycles over the features, each round fitting a tree of up to four leaves to
one feature's bins, so that a feature's trees add up to a lookup table over its bins. Then the pairs whose joint tree
lowers the loss most are boosted in the same way on coarser bins. A score adds one table entry a feature and a pair.

Labels come from ``max_train_rows`` labelled rows at most, those with the smallest hash of their id; everything else
covers all rows. Labels, lang, source and id are never inputs of a score.
"""

from __future__ import annotations

import operator
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FEATURES = [
    "log_bytes", "log_words", "word_length", "upper", "digits", "bars", "marks", "exclaims", "stops", "other_punctuation", "non_ascii", "spaces",
    "distinct_words", "top_word", "repeats", "line_length", "repeated_lines", "bare_words", "top_byte",
]
_CLASS = {name: np.isin(np.arange(256), list(chars)) for name, chars in {"upper": bytes(range(65, 91)), "digits": b"0123456789", "bars": b"|", "marks": b"#$%&*", "exclaims": b"!?", "stops": b".,", "other_punctuation": b"\"'()+-/:;<=>@[\\]^_`{}~", "non_ascii": bytes(range(128, 256)), "spaces": b" \t\n\r\x0b\x0c"}.items()}
_CLASSES = np.array([_CLASS[name] for name in FEATURES if name in _CLASS]).T.astype(float)
_NO_LETTER = bytes(range(65)) + bytes(range(91, 97)) + bytes(range(123, 128))


def features(text: str | None) -> np.ndarray:
    data = (text or "").encode("utf-8", "surrogatepass")
    n, words, lines = max(len(data), 1), data.split(), data.split(b"\n")
    counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256) if data else np.zeros(256)
    m = max(len(words), 1)
    top = max(Counter(words).values(), default=0)
    kept = [x for x in lines if len(x) > 10]
    bare = sum(not x for x in map(bytes.translate, words, (None,) * len(words), (_NO_LETTER,) * len(words)))
    return np.array([
        np.log1p(len(data)), np.log1p(len(words)), (n - counts[32]) / m, *(counts @ _CLASSES / n),
        len(set(words)) / m, top / m, sum(map(operator.eq, words, words[1:])) / m, np.log1p(n / len(lines)), 1 - len(set(kept)) / max(len(kept), 1), bare / m, counts.max() / n,
    ])


def _cut(g: np.ndarray, h: np.ndarray, ridge: float) -> tuple[float, int]:
    """The best gain over one leaf, and the first bin of the right side (0: no gain)."""
    left_g, left_h, all_g, all_h = np.cumsum(g)[:-1], np.cumsum(h)[:-1], g.sum(), h.sum()
    if not len(left_g):
        return 0.0, 0
    gain = left_g**2 / (left_h + ridge) + (all_g - left_g) ** 2 / (all_h - left_h + ridge) - all_g**2 / (all_h + ridge)
    gain[(left_h < 1e-3) | (all_h - left_h < 1e-3)] = 0
    k = int(np.argmax(gain))
    return (float(gain[k]), k + 1) if gain[k] > 1e-9 else (0.0, 0)


def _tree(g: np.ndarray, h: np.ndarray, ridge: float) -> np.ndarray:
    """Leaf values over the bins of one feature: one cut, then a cut on each side."""
    out, (_, at) = np.zeros(len(g)), _cut(g, h, ridge)
    for side in (slice(0, at), slice(at, len(g))) if at else (slice(0, len(g)),):
        _, k = _cut(g[side], h[side], ridge) if at else (0, 0)
        start, stop = side.start, side.stop
        for a, b in ((start, start + k), (start + k, stop)):
            if b > a:
                out[a:b] = -g[a:b].sum() / (h[a:b].sum() + ridge)
    return out


def _pair_tree(g: np.ndarray, h: np.ndarray, ridge: float) -> tuple[float, np.ndarray]:
    """As :func:`_tree` over two features' bins: the first cut on either, the second on the other."""
    best = (0.0, np.zeros(g.shape))
    for flip in (False, True):
        x, y = (g.T, h.T) if flip else (g, h)
        gain, at = _cut(x.sum(1), y.sum(1), ridge)
        out = np.zeros(x.shape)
        for side in (slice(0, at), slice(at, len(x))):
            if side.stop > side.start:
                more, k = _cut(x[side].sum(0), y[side].sum(0), ridge)
                gain += more
                for part in (slice(0, k), slice(k, x.shape[1])):
                    if part.stop > part.start:
                        out[side, part] = -x[side, part].sum() / (y[side, part].sum() + ridge)
        if gain > best[0]:
            best = (gain, out.T if flip else out)
    return best


class GAM:
    """Additive lookup tables. Without rows of both labels, every score is the share of label 1 (0.5 without rows)."""

    def __init__(self, bins: int = 32, pair_bins: int = 8, pairs: int = 6, rounds: int = 150, pair_rounds: int = 40, rate: float = 0.15, ridge: float = 1.0):
        self.bins, self.pair_bins, self.pairs, self.rounds, self.pair_rounds, self.rate, self.ridge = bins, pair_bins, pairs, rounds, pair_rounds, rate, ridge

    def fit(self, x: np.ndarray, y: np.ndarray) -> GAM:
        n, width = len(x), x.shape[1] if len(x) else 0
        share = float(np.clip(y.mean(), 1e-3, 1 - 1e-3)) if n else 0.5
        self.base, self.tables, self.pair_tables = float(np.log(share / (1 - share))), [], []
        if not n or y.min() == y.max():
            self.edges, self.pair_edges = [], []
            return self
        self.edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, self.bins + 1)[1:-1])) for f in range(width)]
        self.pair_edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, self.pair_bins + 1)[1:-1])) for f in range(width)]
        fine = [np.searchsorted(e, x[:, f], "right") for f, e in enumerate(self.edges)]
        coarse = [np.searchsorted(e, x[:, f], "right") for f, e in enumerate(self.pair_edges)]
        self.tables, z = [np.zeros(len(e) + 1) for e in self.edges], np.full(n, self.base)

        def slopes() -> tuple[np.ndarray, np.ndarray]:
            p = 1 / (1 + np.exp(-z))
            return p - y, p * (1 - p)

        for _ in range(self.rounds):
            for f, b in enumerate(fine):
                g, h = slopes()
                m = len(self.tables[f])
                step = self.rate * _tree(np.bincount(b, g, m), np.bincount(b, h, m), self.ridge)
                self.tables[f] += step
                z += step[b]

        def joint(i: int, j: int, g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
            shape = (len(self.pair_edges[i]) + 1, len(self.pair_edges[j]) + 1)
            cell, m = coarse[i] * shape[1] + coarse[j], shape[0] * shape[1]
            return _pair_tree(np.bincount(cell, g, m).reshape(shape), np.bincount(cell, h, m).reshape(shape), self.ridge)

        g, h = slopes()
        ranked = sorted(((joint(i, j, g, h)[0], i, j) for i in range(width) for j in range(i)), reverse=True)
        self.pair_tables = [[i, j, np.zeros((len(self.pair_edges[i]) + 1, len(self.pair_edges[j]) + 1))] for gain, i, j in ranked[: self.pairs] if gain > 0]
        for _ in range(self.pair_rounds):
            for i, j, table in self.pair_tables:
                step = self.rate * joint(i, j, *slopes())[1]
                table += step
                z += step[coarse[i], coarse[j]]
        return self

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.base)
        for f, table in enumerate(self.tables):
            z += table[np.searchsorted(self.edges[f], x[:, f], "right")]
        for i, j, table in self.pair_tables:
            z += table[np.searchsorted(self.pair_edges[i], x[:, i], "right"), np.searchsorted(self.pair_edges[j], x[:, j], "right")]
        return 1 / (1 + np.exp(-z))


def held_out(doc_id: Column, modulus: int = 4, remainder: int = 2) -> Column:
    """True for rows whose labels are never learned from; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % modulus == remainder, F.lit(False))


def fit_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_train_rows: int = 20_000, **params) -> GAM:
    """Learn from labelled rows outside the held-out fold. Null labels teach nothing; a repeated id counts by its largest label. No more than ``max_train_rows`` rows reach the driver."""
    rows = labels.select(F.col(id_col).alias("__id"), F.col(label_col).cast("int").alias("__label")).filter("__id is not null and __label is not null").filter(~held_out(F.col("__id")))
    rows = rows.groupBy("__id").agg(F.max("__label").alias("__label")).orderBy(F.xxhash64("__id"), "__id").limit(max_train_rows)
    found = docs.select(F.col(id_col).alias("__doc"), F.col(text_col).cast("string").alias("__text")).join(F.broadcast(rows), F.col("__doc") == F.col("__id"))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield pd.DataFrame({"id": part["__doc"], "label": part["__label"], "x": [features(t) for t in part["__text"]]})

    # An id may repeat among the documents, so that the bound holds for their rows, too.
    taught = found.mapInPandas(run, "id long, label int, x array<double>").orderBy(F.xxhash64("id"), "id", F.xxhash64("x")).limit(max_train_rows)
    got = taught.toPandas().sort_values("id", kind="stable")
    x = np.stack(got["x"].to_numpy()) if len(got) else np.empty((0, len(FEATURES)))
    return GAM(**params).fit(x, (got["label"].to_numpy() > 0).astype(float))


def score_column(model: GAM, text: Column) -> Column:
    @F.pandas_udf("double")
    def score(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            yield pd.Series(model.score(np.stack([features(t) for t in part])) if len(part) else np.empty(0))

    return score(text)


def score_quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, id_col: str = "doc_id", text_col: str = "text", **params) -> DataFrame:
    """One row per row of ``docs``: id, held_out, score (0 to 1), predicted (1 if score >= threshold).

    Null and empty texts get the score of an empty text; repeated rows each get their row. Other columns are
    ignored, whatever their names. Without rows of both labels the score is the same for all.
    """
    model = fit_quality(docs, labels, id_col, text_col, **params)
    out = docs.select(F.col(id_col), held_out(F.col(id_col)).alias("held_out"), score_column(model, F.col(text_col).cast("string")).alias("score"))
    return out.withColumn("predicted", F.when(F.col("score") >= threshold, 1).otherwise(0))


def drop_low_quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, id_col: str = "doc_id", text_col: str = "text", **params) -> DataFrame:
    """The rows of ``docs``, all columns, that :func:`score_quality` predicts as 1."""
    model = fit_quality(docs, labels, id_col, text_col, **params)
    return docs.withColumn("__score", score_column(model, F.col(text_col).cast("string"))).filter(F.col("__score") >= threshold).drop("__score")
