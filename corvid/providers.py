"""Models as columns: embedding, reranking, generation and judging plug in here; the defaults are deterministic stand-ins."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from corvid.models import Model

from pyspark.sql import Column
from pyspark.sql import functions as F


def _hashed_vector(text: Column, d: int = 64) -> Column:
    """Signs of token hashes summed by bin; no model, but equal texts meet and shared words pull together."""
    words = F.filter(F.split(F.lower(text), r"(?U)\s+"), lambda w: w != "")
    bins = F.transform(words, lambda w: F.pmod(F.xxhash64(w), F.lit(d)))
    return F.transform(F.sequence(F.lit(0), F.lit(d - 1)), lambda k: F.size(F.filter(bins, lambda b: b == k)).cast("double"))


def _overlap_rerank(query: Column, text: Column) -> Column:
    words = F.array_distinct(F.split(F.lower(query), r"(?U)\s+"))
    return F.size(F.filter(words, lambda w: F.lower(text).contains(w))) / F.size(words)


def _extractive(prompt: Column, context: Column) -> Column:
    return F.substring_index(context, "\n\n---\n\n", 1)


def passage(text: Column, prefix: str = "passage: ") -> Column:
    """A document as models of that family embed it."""
    return F.concat(F.lit(prefix), text)


def query(text: Column, prefix: str = "query: ") -> Column:
    return F.concat(F.lit(prefix), text)


@dataclass(frozen=True)
class Providers:
    """``check`` replies to a verification prompt; ``usage`` counts the tokens of a prompt and its answer by name.

    ``model`` and ``checker`` (:class:`corvid.models.Model`) are called in stages of their own, in place of ``generate`` and
    ``check``; ``rerank`` may be such a model, too.
    """

    embed: Callable[[Column], Column] = _hashed_vector
    rerank: Callable[[Column, Column], Column] = _overlap_rerank
    generate: Callable[[Column, Column], Column] = _extractive
    judge: Callable[[Column, Column, Column], Column] | None = None
    check: Callable[[Column], Column] | None = None
    usage: Callable[[Column, Column], Column] | None = None
    model: Model | None = None
    checker: Model | None = None
