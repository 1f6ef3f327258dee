"""Judging of answers by a model: what it is asked, and scores out of its replies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvid.functions.jsons import embedded, field
from corvid.functions.text import let, or_empty
from corvid.functions.vectors import clamp

# Criteria without and with context, the scale, the neutral score, and what scores look like in broken replies.
CRITERIA = ["correctness", "helpfulness", "faithfulness", "fluency"]
CONTEXT_CRITERIA = ["correctness", "helpfulness", "context_faithfulness", "fluency"]
LOW, HIGH, NEUTRAL = 1.0, 5.0, 3.0
SCORE = r'(?i)"?(\w+)"?\s*:\s*\{[^}]*"?score"?\s*:\s*(\d+(?:\.\d+)?)'
OVERALL = r'(?i)"?overall_?score"?\s*:\s*(\d+(?:\.\d+)?)'


def context_for_judge(items: Column) -> Column:
    """Context items (title, content, source) as one text; a missing title is the item's number."""

    def one(c: Column, k: Column) -> Column:
        title = F.coalesce(c["title"], F.concat(F.lit("문서 "), (k + 1).cast("string")))
        source = F.when(or_empty(c["source"]) != "", F.concat(F.lit(" (출처: "), c["source"], F.lit(")"))).otherwise("")
        return F.concat(F.lit("["), title, F.lit("]"), source, F.lit("\n"), or_empty(c["content"]))

    return F.when(F.size(items) > 0, F.array_join(F.transform(items, one), "\n\n")).otherwise("(검색된 컨텍스트 없음)")


def judge_prompt(question: Column, golden: Column, generated: Column, context: Column | None = None, criteria: list[str] | None = None) -> Column:
    """One question for all criteria, with the context where it is given."""
    names = criteria or (CRITERIA if context is None else CONTEXT_CRITERIA)
    told = F.lit("") if context is None else F.concat(F.lit("Sources:\n"), context, F.lit("\n\n"))
    form = ", ".join(f'"{c}": {{"score": 1 to 5, "reasoning": "..."}}' for c in names)
    return F.concat(told, F.lit("Question: "), question, F.lit("\nExpected answer: "), golden, F.lit("\nAnswer to judge: "), generated, F.lit(f'\n\nReply as {{{form}, "overall_score": 1 to 5, "summary": "..."}}.'))


def criterion_prompt(criterion: str, question: Column, golden: Column, generated: Column) -> Column:
    return F.concat(F.lit(f"Judge the {criterion} alone.\nQuestion: "), question, F.lit("\nExpected answer: "), golden, F.lit("\nAnswer to judge: "), generated, F.lit('\n\nReply as {"score": 1 to 5, "reasoning": "..."}.'))


def _number(v: Column, path: str) -> Column:
    """A JSON number, or a string that reads as one."""
    return F.coalesce(field(v, path, "double"), field(v, path, "string").try_cast("double"))


def _by_pattern(reply: Column, criteria: list[str]) -> dict[str, Column]:
    """The last score whose name has the criterion in it or is in it; a name counts for the first such criterion."""
    found = F.arrays_zip(F.regexp_extract_all(reply, F.lit(SCORE), F.lit(1)).alias("name"), F.regexp_extract_all(reply, F.lit(SCORE), F.lit(2)).alias("score"))

    def belongs(c: str):
        def to(m: Column) -> Column:
            name, kind = F.lower(m["name"]), None
            for other in criteria:
                fits = name.contains(other.lower()) | F.lit(other.lower()).contains(name)
                kind = F.when(fits, other) if kind is None else kind.when(fits, other)
            return F.coalesce(kind, F.lit("")) == c

        return to

    last = lambda hits: F.when(F.size(hits) > 0, F.element_at(hits, -1)["score"].cast("double"))
    return {c: clamp(let(F.filter(found, belongs(c)), last), LOW, HIGH) for c in criteria}


def judge_scores(reply: Column, criteria: list[str] | None = None) -> Column:
    """struct of each criterion's score, overall and summary out of a reply to :func:`judge_prompt`.

    Scores are objects with a ``score`` (3 if they lack one) clamped to the scale; what is missing or no number is 3. A
    reply that is no JSON is searched for scores by pattern. The overall score is the mean where the reply names none.
    """
    names = criteria or CRITERIA

    def of(x: Column) -> Column:
        v, reply_ = x["v"], x["reply"]
        broken = v.isNull()
        by_pattern = _by_pattern(reply_, names)
        got = {}
        for c in names:
            entry = field(v, f"$.{c}", "variant")
            is_object = F.schema_of_variant(entry).startswith("OBJECT")
            missing_score = field(v, f"$.{c}.score", "variant").isNull()
            parsed = F.when(is_object, F.when(missing_score, F.lit(NEUTRAL)).otherwise(clamp(_number(v, f"$.{c}.score"), LOW, HIGH)))
            got[c] = F.when(broken, by_pattern[c]).otherwise(parsed)
        named = F.when(broken, F.nullif(F.regexp_extract(reply_, OVERALL, 1), F.lit("")).cast("double")).otherwise(_number(v, "$.overall_score"))
        scores = F.struct(*[got[c].alias(c) for c in names], clamp(named, LOW, HIGH).alias("named"), F.when(~broken, or_empty(field(v, "$.summary", "string"))).otherwise("").alias("summary"), broken.alias("broken"))
        return let(scores, finished)

    def finished(s: Column) -> Column:
        filled = {c: F.coalesce(s[c], F.lit(NEUTRAL)) for c in names}
        mean = sum(list(filled.values())[1:], filled[names[0]]) / len(names)
        regex = s["broken"] & F.greatest(*[s[c].isNotNull() for c in names])
        warnings = F.concat_ws("; ", F.when(regex, "Scores extracted via regex fallback"), *[F.when(s[c].isNull(), f"Missing {c}, using default 3.0") for c in names])
        told = F.when(warnings != "", F.concat(F.when(s["summary"] != "", F.concat(s["summary"], F.lit(" "))).otherwise(""), F.lit("[Parse warnings: "), warnings, F.lit("]"))).otherwise(s["summary"])
        return F.struct(*[f.alias(c) for c, f in filled.items()], F.coalesce(s["named"], mean).alias("overall"), told.alias("summary"))

    return let(F.struct(F.try_parse_json(embedded(or_empty(reply))).alias("v"), or_empty(reply).alias("reply")), of)


def criterion_score(reply: Column) -> Column:
    """A reply to :func:`criterion_prompt`: its score as it stands; 3 where there is none or the reply is no JSON."""
    return F.coalesce(_number(F.try_parse_json(embedded(or_empty(reply))), "$.score"), F.lit(NEUTRAL))


def per_criterion(replies: dict[str, Column]) -> Column:
    """struct of each criterion's score from its own reply, and their mean as overall."""
    scores = {c: criterion_score(r) for c, r in replies.items()}
    mean = sum(list(scores.values())[1:], next(iter(scores.values()))) / len(scores)
    return F.struct(*[s.alias(c) for c, s in scores.items()], mean.alias("overall"))


def judged_or_neutral(scores: Column, error: Column, criteria: list[str] | None = None) -> Column:
    """The scores, or neutral ones with the error told where the judge failed."""
    neutral = F.struct(*[F.lit(NEUTRAL).alias(c) for c in criteria or CRITERIA], F.lit(NEUTRAL).alias("overall"), F.concat(F.lit("Evaluation error: "), error).alias("summary"))
    return F.when(error.isNull(), scores).otherwise(neutral)


def judges_of(models: DataFrame, pairs: DataFrame, fallbacks: DataFrame, default: str = "judge-default") -> DataFrame:
    """``models`` (generator, provider, ..) with the judge of each: that of its pair, else its provider's, else the default; and whether that is another model (``diverse``).

    ``pairs`` (generator, judge) and ``fallbacks`` (provider, fallback) come from a configuration. Names differ neither by
    case nor by hyphens and underscores.
    """
    same = lambda c: F.translate(F.lower(c), "-_", "")
    own = pairs.select(same(F.col("generator")).alias("__g"), F.col("judge").alias("judge"))
    x = models.join(own, same(F.col("generator")) == F.col("__g"), "left").join(fallbacks.select(F.col("provider").alias("__p"), "fallback"), F.col("provider") == F.col("__p"), "left")
    x = x.withColumn("judge", F.coalesce("judge", "fallback", F.lit(default))).drop("__g", "__p", "fallback")
    return x.withColumn("diverse", same(F.col("judge")) != same(F.col("generator")))


def judge_columns(scores: Column, context: bool = False) -> dict[str, Column]:
    """A case's judge columns; without scores they are 0. Faithfulness is that to the context where the judge saw one."""
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    overall = zero(scores["overall"])
    return {
        "judge": overall, "judge_normalised": F.when(overall <= 0, 0.0).otherwise((overall - 1) / 4), "judge_correctness": zero(scores["correctness"]), "judge_helpfulness": zero(scores["helpfulness"]),
        "judge_faithfulness": zero(scores["context_faithfulness" if context else "faithfulness"]), "judge_fluency": zero(scores["fluency"]), "judge_summary": or_empty(scores["summary"]),
    }
