"""JSON in model replies: plain, fenced, or somewhere in the text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corvid.functions.text import ustrip

FENCE = r"```(?:json)?\s*(\{[\s\S]*?\})\s*```"
BRACES = r"\{(?:[^{}]|\{[^{}]*\})*\}"


def lenient(c: Column, keys: tuple[str, ...] = ("verified", "confidence")) -> Column:
    """A VARIANT of the whole text, else of the first fenced object, else of the first object nested one deep that has one of ``keys``; null if none parses."""

    def expected(m: Column) -> Column:
        found = F.json_object_keys(m)
        return F.try_parse_json(m).isNotNull() & F.coalesce(F.arrays_overlap(found, F.array(*[F.lit(k) for k in keys])), F.lit(False))

    last = F.get(F.filter(F.regexp_extract_all(c, F.lit(BRACES), F.lit(0)), expected), F.lit(0))
    return F.coalesce(F.try_parse_json(c), F.try_parse_json(F.regexp_extract(c, FENCE, 1)), F.try_parse_json(last))


def balanced(c: Column) -> Column:
    """From the first opening brace to the brace that closes it, however deep; null without either."""

    def step(s: Column, x: Column) -> Column:
        depth = s["depth"] + F.when(x == "{", 1).when(x == "}", -1).otherwise(0)
        at = s["n"] + 1
        return F.when(s["end"] > 0, s).otherwise(F.struct(depth.alias("depth"), at.alias("n"), F.when(depth == 0, at).otherwise(0).alias("end")))

    rest = c.substr(F.instr(c, "{"), F.length(c))
    end = F.aggregate(F.split(rest, ""), F.struct(F.lit(0).alias("depth"), F.lit(0).alias("n"), F.lit(0).alias("end")), step)["end"]
    return F.when(F.instr(c, "{") > 0, F.when(end > 0, rest.substr(F.lit(1), end)))


def embedded(c: Column) -> Column:
    """The text that should be JSON in a reply: of a fence marked so, of any fence, or of balanced braces; else all."""
    text = ustrip(c)

    def fenced(mark: str) -> Column:
        start = F.instr(text, mark)
        body = text.substr(start + len(mark), F.length(text))
        return F.when((start > 0) & (F.instr(body, "```") > 1), ustrip(F.substring_index(body, "```", 1)))

    return F.coalesce(fenced("```json"), fenced("```"), balanced(text), text)


def field(v: Column, path: str, kind: str) -> Column:
    return F.try_variant_get(v, path, kind)
