"""Rule checks of answers: citations, hedges, confidence, verdict."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corvid.functions.jsons import field, lenient
from corvid.functions.text import let, or_empty
from corvid.functions.vectors import clamp

# Citation pattern, article pattern, hedging phrases and the texts of signs, penalties and limits.
CITATION = r"\[참조:\s*([^\]]+)\]|\[출처:\s*([^\]]+)\]"
ARTICLE = r"제\s*\d+\s*조"
HEDGES = ["일반적으로", "보통", "아마도", "~할 수도 있습니다", "제 생각에는", "추측컨대"]
UNCITED = "답변에 출처가 명시되지 않았거나 유효하지 않습니다"
HEDGE_SIGN, LONG_SIGN = "불확실한 표현 감지: '{}'", "긴 답변에 출처가 없습니다"
CITATION_PENALTY, SIGN_PENALTY, LONG_ANSWER, THRESHOLD = 0.3, 0.15, 500, 0.7


def cited(answer: Column) -> Column:
    """References that an answer cites, in order."""
    both = F.arrays_zip(F.regexp_extract_all(answer, F.lit(CITATION), F.lit(1)).alias("a"), F.regexp_extract_all(answer, F.lit(CITATION), F.lit(2)).alias("b"))
    return F.transform(both, lambda m: F.when(m["a"] != "", m["a"]).otherwise(m["b"]))


def citations_valid(answer: Column, titles: Column, required: bool = True) -> Column:
    """Every reference overlaps a title of the context or its article number, or names no article at all."""
    full = F.filter(titles, lambda t: t.isNotNull() & (t != ""))
    numbers = F.filter(F.transform(full, lambda t: F.regexp_extract(t, ARTICLE, 0)), lambda t: t != "")
    known = F.array_distinct(F.concat(full, numbers))
    refs = F.transform(cited(answer), F.trim)

    def fine(ref: Column) -> Column:
        article = F.regexp_extract(ref, ARTICLE, 0)
        return F.exists(known, lambda s: s.contains(ref) | ref.contains(s)) | (article == "") | F.array_join(known, "\n").contains(article)

    return F.when(F.size(refs) == 0, F.lit(not required)).otherwise(F.forall(refs, fine))


def hedges(answer: Column) -> Column:
    """Signs of doubt: hedging phrases, and a long answer without a citation."""
    signs = [F.when(answer.contains(h), F.lit(HEDGE_SIGN.format(h))) for h in HEDGES]
    signs.append(F.when((F.length(answer) > LONG_ANSWER) & ~answer.rlike(CITATION), F.lit(LONG_SIGN)))
    return F.filter(F.array(*signs), lambda s: s.isNotNull())


def confidence(valid: Column, signs: Column, verdict_confidence: Column | None = None, has_verdict: Column | None = None) -> Column:
    """1 less penalties; with a model's verdict, the mean with its confidence (0.5 if it names none); clamped last."""
    own = F.lit(1.0) - F.when(valid, 0.0).otherwise(CITATION_PENALTY) - F.size(signs) * SIGN_PENALTY
    if verdict_confidence is not None:
        mean = (own + F.coalesce(verdict_confidence, F.lit(0.5))) / 2
        own = F.when(has_verdict if has_verdict is not None else verdict_confidence.isNotNull(), mean).otherwise(own)
    return clamp(own)


def issues(valid: Column, signs: Column, verdict: Column | None = None, required: bool = True) -> Column:
    """What speaks against an answer: its citations where they are required, signs of doubt, and what a model that refuses it names."""
    none = F.array().cast("array<string>")
    parts = [F.when(valid, none).otherwise(F.array(F.lit(UNCITED)))] if required else []
    parts.append(signs)
    if verdict is not None:
        parts.append(F.when(verdict["verified"], none).otherwise(F.coalesce(verdict["issues"], none)))
    return F.concat(*parts)


def verified(confidence_: Column, found: Column, threshold: float = THRESHOLD) -> Column:
    """Confident enough, and nothing speaks against it."""
    return (confidence_ >= threshold) & (F.size(found) == 0)


def quick_verdict(answer: Column, titles: Column, required: bool = True) -> Column:
    """By the rules alone: valid citations and no sign of doubt."""
    return citations_valid(answer, titles, required) & (F.size(hedges(answer)) == 0)


def check_prompt(question: Column, answer: Column, context: Column) -> Column:
    """What a model is asked to check; ``context`` has items (title, content)."""
    sources = F.array_join(F.transform(context, lambda c: F.concat(F.lit("["), or_empty(c["title"]), F.lit("]\n"), or_empty(c["content"]))), "\n\n")
    return F.concat(F.lit("Sources:\n"), sources, F.lit("\n\nQuestion: "), question, F.lit("\nAnswer: "), answer, F.lit('\n\nDoes every statement of the answer follow from the sources? Reply as {"verified": true or false, "confidence": 0 to 1, "issues": ["..."], "reasoning": "..."}.'))


def model_verdict(reply: Column) -> Column:
    """struct<verified, confidence, issues, reasoning> of a model's reply; null if there is none to be read.

    A reply that doesn't say whether it verifies adds no issues, but doesn't count as passed in the reasoning (``passed``).
    """
    v = lenient(reply)
    said = field(v, "$.verified", "boolean")
    parts = F.struct(F.coalesce(said, F.lit(True)).alias("verified"), F.coalesce(said, F.lit(False)).alias("passed"), F.coalesce(field(v, "$.confidence", "double"), F.lit(0.5)).alias("confidence"), F.coalesce(field(v, "$.issues", "array<string>"), F.array().cast("array<string>")).alias("issues"), or_empty(field(v, "$.reasoning", "string")).alias("reasoning"))
    return F.when(v.isNotNull() & (F.to_json(v) != "{}"), parts)


def verify(answer: Column, titles: Column, reply: Column | None = None, required: bool = True, threshold: float = THRESHOLD) -> Column:
    """struct<verified, confidence, issues, reasoning, citations_valid> by the rules and, where there is one, a model's reply."""

    def of(x: Column) -> Column:
        verdict = x["verdict"]
        c = confidence(x["valid"], x["signs"], verdict["confidence"], verdict.isNotNull())
        return let(issues(x["valid"], x["signs"], verdict, required), lambda found: F.struct(verified(c, found, threshold).alias("verified"), c.alias("confidence"), found.alias("issues"), reasoning(x["valid"], x["signs"], verdict).alias("reasoning"), x["valid"].alias("citations_valid")))

    verdict = model_verdict(reply if reply is not None else F.lit(None).cast("string"))
    return let(F.struct(citations_valid(answer, titles, required).alias("valid"), hedges(answer).alias("signs"), verdict.alias("verdict")), of)


def reasoning(valid: Column, signs: Column, verdict: Column | None = None) -> Column:
    model = [] if verdict is None else [F.when(verdict["passed"], "✓ LLM 검증 통과").when(verdict.isNotNull(), F.concat(F.lit("✗ LLM 검증 실패: "), verdict["reasoning"]))]
    return F.concat_ws(
        " | ",
        F.when(valid, "✓ 출처 인용이 유효합니다").otherwise("✗ 출처 인용에 문제가 있습니다"),
        F.when(F.size(signs) == 0, "✓ 불확실한 표현이 감지되지 않았습니다").otherwise(F.concat(F.lit("✗ "), F.size(signs).cast("string"), F.lit("개의 주의 표현이 감지되었습니다"))),
        *model,
    )


def gated(source: Column, mode: Column, value: Column, default) -> Column:
    """Only answers from sections are verified; others take the default."""
    return F.when((source == "sections") & mode.isin("answer", "limited_answer"), value).otherwise(F.lit(default))
