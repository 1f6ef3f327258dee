"""Routing by confidence bands, and the responses that follow."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from corvid.functions.text import or_empty


@dataclass(frozen=True)
class Bands:
    """Thresholds from high to low for question-answer pairs and for document sections."""

    faq: float = 0.80
    faq_mid: float = 0.70
    section: float = 0.65
    section_mid: float = 0.55
    section_low: float = 0.40

    def __post_init__(self):
        if not (1 >= self.faq >= self.faq_mid >= 0 and 1 >= self.section >= self.section_mid >= self.section_low >= 0):
            raise ValueError("thresholds must fall from high to low, within 0 and 1")


def route_faq(score: Column, bands: Bands = Bands()) -> Column:
    return F.when(score >= bands.faq, "faq_ok").when(score >= bands.faq_mid, "faq_mid").otherwise("sections")


def route_sections(score: Column, bands: Bands = Bands()) -> Column:
    return F.when(score >= bands.section, "section_ok").when(score >= bands.section_mid, "section_mid").when(score >= bands.section_low, "section_low").otherwise("none")


def relevant(hits: Column, threshold: float) -> Column:
    """Hits within nine tenths of the threshold, else the first alone."""
    kept = F.filter(hits, lambda h: h["score"] >= 0.9 * threshold)
    return F.when(F.size(kept) > 0, kept).otherwise(F.slice(hits, 1, 1))


def context_text(hits: Column, separator: str = "\n\n---\n\n") -> Column:
    """Hits (title, content) as one context."""
    return F.array_join(F.transform(hits, lambda h: F.concat(F.lit("["), or_empty(h["title"]), F.lit("]\n"), or_empty(h["content"]))), separator)


def mean_score(hits: Column) -> Column:
    return F.when(F.size(hits) > 0, F.aggregate(hits, F.lit(0.0), lambda s, h: s + h["score"]) / F.size(hits)).otherwise(0.0)


def citations(answer: Column) -> Column:
    return F.regexp_extract_all(answer, F.lit(r"\[참조:\s*([^\]]+)\]"), F.lit(1))


def citations_or_titles(answer: Column, hits: Column) -> Column:
    """An answer's citations, else the first two hits by document and section."""
    own = citations(answer)
    return F.when(F.size(own) > 0, own).otherwise(F.transform(F.slice(hits, 1, 2), lambda h: F.concat(or_empty(h["document"]), F.lit(" - "), or_empty(h["title"]))))


def prompt_of(systems: dict[str, str], route: Column, context: Column, query: Column) -> Column:
    """What a model is asked: the text of the route, the context, the query."""
    system = F.create_map(*[F.lit(x) for pair in systems.items() for x in pair])[route]
    return F.concat(system, F.lit("\n\n"), context, F.lit("\n\n"), query)


def prompt(system: str, context: Column, query: Column) -> Column:
    return F.concat(F.lit(system + "\n\n"), context, F.lit("\n\n"), query)


def total_tokens(usage: Column, name: str) -> Column:
    return F.coalesce(F.try_element_at(usage, F.lit(name)), F.lit(0))
