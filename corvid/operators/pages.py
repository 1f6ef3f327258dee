"""Fields of crawled pages and documents by patterns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvid.functions.text import null_if_empty, squeeze, ymd

TAGS = r"<[^>]*>"
# Dates of effect, in order of priority, and revisions.
EFFECTIVE = [r"(\d{4})\s*[년.]\s*(\d{1,2})\s*[월.]\s*(\d{1,2})\s*일?\s*부터\s*시행", r"시행일\s*[:：]?\s*(\d{4})[./년](\d{1,2})[./월](\d{1,2})"]
REVISION = r"(?:개정|제정)\s*(\d{4})\s*[./년]\s*(\d{1,2})\s*[./월]\s*(\d{1,2})"


def without_tags(c: Column) -> Column:
    return squeeze(F.regexp_replace(c, TAGS, " "))


def first_text(html: Column, tag: str, default: str = "") -> Column:
    return F.coalesce(null_if_empty(without_tags(F.regexp_extract(html, rf"(?s)<{tag}\b[^>]*>(.*?)</{tag}>", 1))), F.lit(default))


def link_targets(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit(r'<a\s[^>]*href="([^"]*)"'), F.lit(1))


def page_count(html: Column) -> Column:
    """Largest page number in paging handlers, at least 1."""
    return F.greatest(F.lit(1), F.coalesce(F.array_max(F.transform(F.regexp_extract_all(html, F.lit(r"goPage\(['\"]?(\d+)['\"]?\)"), F.lit(1)), lambda x: x.cast("int"))), F.lit(1)))


def table_page_count(html: Column) -> Column:
    """Largest page number of paging links, by their text in digits or their handler, at least 1."""
    numbers = F.filter(F.transform(F.regexp_extract_all(html, F.lit(r"(?s)<a\b[^>]*>(.*?)</a>"), F.lit(1)), without_tags), lambda t: t.rlike(r"^\d+$"))
    return F.greatest(page_count(html), F.coalesce(F.array_max(F.transform(numbers, lambda t: t.try_cast("int"))), F.lit(1)))


def faq_scan(pages_: DataFrame, names: dict[str, str], category: str = "category", html: str = "html") -> DataFrame:
    """Pairs of all pages of all categories: one scan of (category code, html) in place of a loop, codes as names, sub-categories from brackets."""
    x = pages_.withColumn("__item", F.explode(faq_items(F.col(html)))).withColumn("question", F.col("__item.question")).withColumn("answer", F.col("__item.answer"))
    return x.withColumn("category", named(F.col(category), names)).withColumn("sub_category", subcategory(F.col("question"))).drop("__item", html)


def details(html: Column, frame: Column) -> Column:
    """struct of a document's title, content, sections, date of effect and revisions, from its page and the frame in it, whose text goes first."""
    body = F.coalesce(F.nullif(frame, F.lit("")), html)
    text = without_tags(body)
    return F.struct(first_text(html, "h1").alias("title"), text.alias("content"), heading_sections(body).alias("sections"), effective_date(text).alias("effective_date"), revisions(text).alias("revision_history"))


def listed_details(listed: DataFrame, pages_: DataFrame, key: str = "num") -> DataFrame:
    """Listed documents (num, title, ...) with the details of their pages (num, html, frame); those without a number or page go."""
    found = pages_.select(key, details(F.col("html"), F.col("frame")).alias("detail"))
    return with_details(listed.filter(F.coalesce(key, F.lit("")) != ""), found, key)


def view_parameters(onclick: Column) -> Column:
    at = lambda g: F.regexp_extract(onclick, r"doView\(\s*'([^']*)'\s*,\s*'([^']*)'\s*\)", g)
    return F.struct(at(1).alias("num"), at(2).alias("row_num"))


def file_url(onclick: Column) -> Column:
    return null_if_empty(F.regexp_extract(onclick, r"doFile\(\s*'([^']*)'\s*\)", 1))


def effective_date(text: Column) -> Column:
    """YYYY-MM-DD by the first pattern that hits, else the empty string."""
    hits = [F.when(F.regexp_extract(text, p, 1) != "", ymd(*[F.regexp_extract(text, p, g) for g in (1, 2, 3)])) for p in EFFECTIVE]
    return F.coalesce(*hits, F.lit(""))


def revisions(text: Column) -> Column:
    """Distinct revision dates in order."""
    parts = F.arrays_zip(*[F.regexp_extract_all(text, F.lit(REVISION), F.lit(g)).alias(f"g{g}") for g in (1, 2, 3)])
    return F.array_sort(F.array_distinct(F.transform(parts, lambda m: ymd(m["g1"], m["g2"], m["g3"]))))


def named(code: Column, names: dict[str, str]) -> Column:
    """A code's name, or the code."""
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in names.items() for x in kv]), code), code)


def subcategory(question: Column) -> Column:
    return F.regexp_extract(question, r"^\[([^\]]+)\]", 1)


def without_label(text: Column, label: str) -> Column:
    return squeeze(F.regexp_replace(squeeze(text), rf"^{label}\s*", ""))


def heading_sections(html: Column, heading: str = "h2", siblings: tuple[str, ...] = ("p", "ul", "ol", "div")) -> Column:
    """array<struct<title, content>>: each heading with the text of the element right after it, if that is one of ``siblings``."""
    follow = "|".join(rf"<{t}\b[^>]*>.*?</{t}>" for t in siblings)
    pattern = F.lit(rf"(?s)<{heading}\b[^>]*>((?:(?!</{heading}>).)*)</{heading}>\s*({follow})")
    pairs = F.arrays_zip(F.regexp_extract_all(html, pattern, F.lit(1)).alias("a"), F.regexp_extract_all(html, pattern, F.lit(2)).alias("b"))
    return F.transform(pairs, lambda m: F.struct(without_tags(m["a"]).alias("title"), without_tags(m["b"]).alias("content")))


def table_rows(html: Column) -> Column:
    """array<struct<cells, onclick>> of table rows with two cells or more and a link."""
    rows = F.regexp_extract_all(html, F.lit(r"(?s)<tr\b[^>]*>(.*?)</tr>"), F.lit(1))

    def parts(row: Column) -> Column:
        cells = F.transform(F.regexp_extract_all(row, F.lit(r"(?s)<t[dh]\b[^>]*>(.*?)</t[dh]>"), F.lit(1)), without_tags)
        return F.struct(cells.alias("cells"), F.regexp_extract(row, r'<a\b[^>]*onclick="([^"]*)"', 1).alias("onclick"), row.contains("<a").alias("linked"))

    return F.transform(F.filter(F.transform(rows, parts), lambda r: (F.size(r["cells"]) >= 2) & r["linked"]), lambda r: F.struct(r["cells"].alias("cells"), r["onclick"].alias("onclick")))


def faq_items(html: Column, question: str = "question", answer: str = "answer") -> Column:
    """array<struct<question, answer>> of elements with these classes, one after the other; labels and white space go."""
    pattern = F.lit(rf'(?s)<(?:dt|div|p|li|a)\b[^>]*class="{question}"[^>]*>(.*?)</(?:dt|div|p|li|a)>\s*<(?:dd|div|p|li)\b[^>]*class="{answer}"[^>]*>(.*?)</(?:dd|div|p|li)>')
    pairs = F.arrays_zip(F.regexp_extract_all(html, pattern, F.lit(1)).alias("q"), F.regexp_extract_all(html, pattern, F.lit(2)).alias("a"))
    return F.transform(pairs, lambda m: F.struct(without_label(without_tags(m["q"]), "질문").alias("question"), without_label(without_tags(m["a"]), "답변").alias("answer")))


def with_details(listed: DataFrame, details: DataFrame, key: str) -> DataFrame:
    """Listed documents that have details; those whose details failed go."""
    return listed.join(details, key)
