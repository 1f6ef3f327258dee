"""Evaluation metrics of a case."""

from __future__ import annotations

import difflib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from corvid.functions.text import let, ngrams, or_empty, tokens, ustrip
from corvid.functions.vectors import clamp, dot

def similarity(a: Column, b: Column) -> Column:
    """Clamped dot product of unit vectors; 0 without both."""
    return F.coalesce(let(dot(a, b), lambda c: clamp(c)), F.lit(0.0))


def bleu(reference: Column, candidate: Column, n: int = 4, tokenizer=tokens) -> Column:
    """BLEU whose precision is the share of candidate n-grams that the reference holds at all, with a brevity penalty.

    ``tokenizer`` gives a text's tokens; a morphological one plugs in here. Zero precisions count as 1e-10, unless all are zero: then the score is 0, as it is without tokens.
    """
    def of(t: Column) -> Column:
        grams = F.struct(*[ngrams(t[side], k).alias(f"{side}{k}") for side in ("r", "c") for k in range(1, n + 1)])
        return let(grams, lambda g: let(F.array(*[share(g[f"c{k}"], g[f"r{k}"]) for k in range(1, n + 1)]), lambda p: score(t, p)))

    def share(have: Column, want: Column) -> Column:
        return F.when(F.size(have) > 0, held(have, want) / F.size(have)).otherwise(0.0)

    def held(have: Column, want: Column) -> Column:
        """How many of ``have`` are in ``want``: where none repeats, those that both have; else both are sorted into one row of marks and counted in a pass, so that long texts cost n log n."""
        return let(F.array_intersect(have, want), lambda both: F.when(F.size(both) == 0, 0).when(F.size(F.array_distinct(have)) == F.size(have), F.size(both)).otherwise(repeated(have, both)))

    def repeated(have: Column, both: Column) -> Column:
        marks = F.sort_array(F.concat(F.transform(both, lambda x: F.struct(x.alias("g"), F.lit(0).alias("k"))), F.transform(have, lambda x: F.struct(x.alias("g"), F.lit(1).alias("k")))))
        start = F.struct(F.lit(None).cast("string").alias("g"), F.lit(0).alias("n"))
        step = lambda s, m: F.when(m["k"] == 0, F.struct(m["g"].alias("g"), s["n"].alias("n"))).otherwise(F.struct(s["g"].alias("g"), (s["n"] + F.when(s["g"] == m["g"], 1).otherwise(0)).alias("n")))
        return F.aggregate(marks, start, step)["n"]

    def score(t: Column, p: Column) -> Column:
        mean = F.aggregate(p, F.lit(0.0), lambda s, x: s + F.ln(F.greatest(x, F.lit(1e-10)))) / n
        penalty = F.when(F.size(t["c"]) >= F.size(t["r"]), 1.0).otherwise(F.exp(1 - F.size(t["r"]) / F.nullif(F.size(t["c"]), F.lit(0))))
        return F.when((F.size(t["r"]) == 0) | (F.size(t["c"]) == 0) | (F.array_max(p) == 0), 0.0).otherwise(F.exp(mean) * penalty)

    return let(F.struct(tokenizer(reference).alias("r"), tokenizer(candidate).alias("c")), of)


def overlap(retrieved: Column, expected: Column) -> tuple[Column, Column]:
    """Recall and precision over sets; (1, 1) without expectations, (0, 0) without retrieved items."""
    got, want = F.array_distinct(retrieved), F.array_distinct(expected)
    both = F.size(F.array_intersect(got, want))
    pick = lambda n: F.when(F.size(want) == 0, 1.0).when(F.size(got) == 0, 0.0).otherwise(both / F.nullif(n, F.lit(0)))
    return pick(F.size(want)), pick(F.size(got))


def normalised(score: Column) -> Column:
    """1 to 5 as 0 to 1; 0 and less as 0."""
    return F.when(score <= 0, 0.0).otherwise((score - 1) / 4)


def token_counts(response: Column, metadata: Column | None = None) -> tuple[Column, Column]:
    """Input and output tokens, from the response itself, else from its metadata; output also as total less input, 0 at least."""
    none = F.lit(None).cast("int")
    own = lambda x: F.try_element_at(response, F.lit(x))
    told = lambda x: none if metadata is None else F.try_element_at(metadata, F.lit(x))
    put = F.coalesce(own("input_tokens"), told("prompt_tokens"), told("input_tokens"), F.lit(0))
    total = F.coalesce(told("total_tokens"), told("tokens_used"))
    return put, F.coalesce(own("output_tokens"), own("completion_tokens"), told("completion_tokens"), F.when(total.isNotNull(), F.greatest(total - put, F.lit(0))), F.lit(0))


def lightweight(expected: Column, generated: Column) -> dict[str, Column]:
    """BLEU, equality and ratio of matching blocks, the latter two of stripped texts."""
    a, b = ustrip(or_empty(expected)), ustrip(or_empty(generated))
    return {"bleu": bleu(expected, generated), "exact_match": a == b, "string_similarity": sequence_ratio(a, b)}


@F.pandas_udf(DoubleType())
def sequence_ratio(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """Ratio of matching blocks of two texts, which no built-in function gives."""
    for a, b in parts:
        yield pd.Series([difflib.SequenceMatcher(None, x or "", y or "").ratio() for x, y in zip(a, b)], dtype=float)
