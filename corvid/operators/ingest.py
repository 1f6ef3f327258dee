"""Ingest: content ids, first-wins deduplication, skipping of what exists, validation, sampling, chunking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvid.functions.text import int_or_null, let, or_empty, sha_id, ustrip

# Lengths that ids, chunks and parents keep.
ID_PREFIX, ANSWER_PREFIX, CHUNK, STORED, PARENT, LEAST = 500, 200, 2000, 1000, 500, 10
#: Header of an article: number and title.
HEADER = r"^제\s*(\d+)\s*조\s*[\(（]([^)）]+)[\)）]"


def faq_id(question: Column, answer: Column) -> Column:
    return sha_id(question, F.substring(answer, 1, ANSWER_PREFIX))


def single_faq_id(question: Column, created_at: Column) -> Column:
    """Id of a pair that is added by itself."""
    return sha_id(question, created_at)


def agent_answer_id(question: Column, session: Column, created_at: Column) -> Column:
    """Id of an agent's answer: of its session if it names one, else as any single pair."""
    return F.when(or_empty(session) != "", sha_id(question, session, created_at)).otherwise(single_faq_id(question, created_at))


def item_id(question: Column, now: Column) -> Column:
    """Id of an evaluation item."""
    return sha_id(question, now, n=12)


def chunk_id(document: Column, title: Column, content: Column) -> Column:
    return sha_id(document, title, F.substring(content, 1, ID_PREFIX))


def embed_text(title: Column, content: Column) -> Column:
    return ustrip(F.concat(or_empty(title), F.lit("\n"), or_empty(content)))


def stored_chunks(chunks_: DataFrame) -> DataFrame:
    """Chunks as a collection holds them: the text to embed, which must not be empty, and content cut to 1000 characters."""
    x = chunks_.withColumn("embed_text", embed_text(F.col("section_title"), F.col("section_content"))).filter("embed_text <> ''")
    return x.withColumn("section_content", F.substring("section_content", 1, STORED))


def first_wins(rows: DataFrame, key: str, order: str) -> DataFrame:
    """Of rows with one key, that of least ``order``. Partial minima go ahead of the shuffle, so a hot key sends one row a task."""
    first = rows.groupBy(key).agg(F.min(order).alias(order))
    return rows.join(first, [key, order], "left_semi").dropDuplicates([key])


def skip_existing(new: DataFrame, existing: DataFrame, key: str) -> DataFrame:
    return new.join(existing.select(key).distinct(), key, "left_anti")


def ingest_status(new: DataFrame, existing: DataFrame, key: str, order: str) -> DataFrame:
    """``new`` with status: skipped_duplicate (not the first of its key), skipped_existing, or added."""
    known = existing.select(key).distinct().withColumn("__known", F.lit(True))
    # One row a key meets the collection, and rows meet it by key and order: a hot key's rows never come together.
    first = new.groupBy(key).agg(F.min(order).alias(order)).join(known, key, "left").select(F.col(key).alias("__k"), F.col(order).alias("__o"), F.coalesce("__known", F.lit(False)).alias("__known"))
    x = new.join(first, F.col(key).eqNullSafe(F.col("__k")) & (F.col(order) == F.col("__o")), "left")
    status = F.when(F.col("__known").isNull(), "skipped_duplicate").when(F.col("__known"), "skipped_existing").otherwise("added")
    return x.withColumn("status", status).drop("__k", "__o", "__known")


def valid_pairs(rows: DataFrame, question: str, answer: str) -> DataFrame:
    return rows.filter((or_empty(question) != "") & (or_empty(answer) != ""))


def agent_answers(rows: DataFrame, as_of: str, order: str = "pos") -> DataFrame:
    """Agents' answers (question, answer, category, agent_id, session_id, created_at) with status and id.

    Questions and answers are stripped; a row that lacks one is skipped. A row with an ``error`` is one that could not be
    read. ``as_of`` stands for a missing time. Missing texts are empty ones.
    """
    x = rows.withColumns({c: ustrip(or_empty(c)) for c in ("question", "answer")}).withColumn("created_at", F.coalesce("created_at", F.lit(as_of)))
    broken = F.col("error").isNotNull() if "error" in rows.columns else F.lit(False)
    status = F.when(broken, "error").when((F.col("question") == "") | (F.col("answer") == ""), "skipped").otherwise("added")
    own = agent_answer_id(F.col("question"), F.col("session_id"), F.col("created_at"))
    return x.withColumn("status", status).withColumn("id", F.when(status == "added", own)).withColumn("source", F.lit("human_agent")).withColumn("human_verified", F.lit(True))


def backfill_summary(rows: DataFrame, order: str = "pos", shown: int = 5) -> DataFrame:
    """One row: success, added_count, skipped_count, error_count and the first ``shown`` errors in input order."""
    first = rows.filter("status = 'error'").orderBy(order).limit(shown).agg(F.array_sort(F.collect_list(F.struct(order, "error"))).alias("e"))
    counts = rows.agg(F.count_if(F.col("status") == "added").alias("added_count"), F.count_if(F.col("status") == "skipped").alias("skipped_count"), F.count_if(F.col("status") == "error").alias("error_count"))
    return counts.join(first).select((F.col("error_count") == 0).alias("success"), "added_count", "skipped_count", "error_count", F.transform("e", lambda x: x["error"]).alias("errors"))


def valid_or_all(rows: DataFrame) -> DataFrame:
    """Rows without error, or the rows as they came if none is."""
    valid = rows.agg(F.count_if(F.col("error").isNull()).alias("__valid"))
    return rows.join(F.broadcast(valid)).filter("error is null or __valid = 0").drop("__valid")


def validation_message(rows: DataFrame, order: str, shown: int = 5) -> DataFrame:
    """One row with the first errors by ``order`` and how many more there are; null without errors."""
    bad = rows.filter("error is not null")
    first = bad.orderBy(order).limit(shown).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, "error"))), lambda x: x["error"]), "; ").alias("m"))
    n = bad.agg(F.count("*").alias("n"))
    more = F.when(F.col("n") > shown, F.concat(F.lit(" (and "), (F.col("n") - shown).cast("string"), F.lit(" more)"))).otherwise("")
    return first.join(n).select(F.when(F.col("n") > 0, F.concat(F.lit("Dataset validation failed: "), F.col("m"), more)).alias("message"))


def validate(rows: DataFrame, required: list[str]) -> DataFrame:
    """``rows`` with error: the first required field that is missing or blank, else null."""
    checks = [F.when(ustrip(or_empty(c)) == "", F.lit(f"{c}: empty")) for c in required]
    return rows.withColumn("error", F.coalesce(*checks))


def seeded_sample(rows: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """n rows without replacement, the same for the same seed."""
    return rows.withColumn("__r", F.md5(F.concat_ws(":", F.lit(seed), F.col(key)).cast("binary"))).orderBy("__r", key).limit(n).drop("__r")


def sections(text: Column, header: str = HEADER) -> Column:
    """array<struct<title, content>> by one pass over the lines: a header line opens a section, blank lines go, and so do lines before the first header."""
    lines = F.filter(F.transform(F.split(text, "\n"), ustrip), lambda x: x != "")
    empty = F.array().cast("array<struct<title:string,content:string>>")

    def cut(all_: Column) -> Column:
        places = F.filter(F.sequence(F.lit(1), F.size(all_)), lambda k: F.element_at(all_, k).rlike(header))
        return F.when(F.size(all_) > 0, let(places, lambda p: F.when(F.size(p) > 0, F.transform(F.sequence(F.lit(1), F.size(p)), lambda k: section(all_, p, k))).otherwise(empty))).otherwise(empty)

    def section(all_: Column, p: Column, k: Column) -> Column:
        at = F.element_at(p, k)
        after = F.coalesce(F.get(p, k), F.size(all_) + 1)
        return F.struct(F.element_at(all_, at).alias("title"), F.array_join(F.slice(all_, at + 1, after - at - 1), "\n").alias("content"))

    return let(lines, cut)


def parent_context(title: Column, full: Column) -> Column:
    """500 characters from the first header (number and title in brackets) of the article before this one; empty without one."""
    n = int_or_null(F.regexp_extract(title, "(?U)" + HEADER, 1))
    at = F.regexp_instr(full, F.concat(F.lit(r"(?U)제\s*"), (n - 1).cast("string"), F.lit(r"\s*조\s*[\(（][^)）]+[\)）]")))
    return F.when((n > 1) & (at > 0), full.substr(at, F.lit(PARENT))).otherwise("")


def chunks(docs: DataFrame, document: str, text: str, given: str | None = None, header: str = HEADER) -> DataFrame:
    """Chunks of documents: given sections, else parsed ones, else the first 2000 characters of the whole.

    A section needs a title or content, and 10 characters together; a whole has no parent. Adds section_title, section_content,
    parent_content and chunk_id to the document's columns.
    """
    body = or_empty(text)

    def usable(s: Column) -> Column:
        t, c = ustrip(or_empty(s["title"])), ustrip(or_empty(s["content"]))
        return ((t != "") | (c != "")) & (F.length(F.concat(t, F.lit("\n"), c)) >= LEAST)

    shape = lambda s: F.struct(ustrip(or_empty(s["title"])).alias("title"), F.substring(ustrip(or_empty(s["content"])), 1, CHUNK).alias("content"), F.lit(True).alias("section"))
    parsed = F.transform(F.filter(sections(body, header), usable), shape)
    whole = F.array(F.struct(F.col(document).alias("title"), F.substring(body, 1, CHUNK).alias("content"), F.lit(False).alias("section")))
    found = F.when(F.size(parsed) > 0, parsed).when(body != "", whole)
    if given:
        own = F.transform(F.filter(F.col(given), usable), shape)
        found = F.when(F.size(own) > 0, own).otherwise(found)
    x = docs.withColumn("__s", F.explode(found)).withColumn("section_title", F.col("__s.title")).withColumn("section_content", F.col("__s.content"))
    parent = F.when(F.col("__s.section"), parent_context(F.col("section_title"), body)).otherwise("")
    return x.withColumn("parent_content", parent).withColumn("chunk_id", chunk_id(F.col(document), F.col("section_title"), F.col("section_content"))).drop("__s")
