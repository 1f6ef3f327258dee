"""Column helpers for strings. Patterns carry (?U) where white space or word characters go beyond ASCII."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def or_empty(c) -> Column:
    """Missing and null mean the empty string at ingest."""
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def ustrip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def squeeze(c: Column) -> Column:
    return F.regexp_replace(ustrip(c), r"(?U)\s+", " ")


def sha_id(*parts: Column, n: int = 16) -> Column:
    """Leading hex digits of the SHA-256 of the parts joined by underscores."""
    return F.substring(F.sha2(F.concat_ws("_", *parts), 256), 1, n)


def tokens(c: Column) -> Column:
    """Words of a text; all but word characters, white space and Hangul syllables separate."""
    return F.filter(F.split(F.regexp_replace(c, r"(?U)[^\w\s가-힣]", " "), r"(?U)\s+"), lambda x: x != "")


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often the body and the lambdas in it use it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def ngrams(words: Column, n: int) -> Column:
    """Runs of n words, each joined by spaces; none if the text has fewer."""
    count = F.size(words) - n + 1
    run = lambda i: F.concat_ws(" ", *[F.get(words, i + k) for k in range(n)])
    return F.when(count >= 1, F.transform(F.sequence(F.lit(0), count - 1), run)).otherwise(F.array().cast("array<string>"))


def int_or_null(c: Column) -> Column:
    """Digits, full-width ones too, as a number; null for the empty string."""
    return F.translate(c, "０１２３４５６７８９", "0123456789").try_cast("int")


def null_if_empty(c: Column) -> Column:
    return F.when(c != "", c)


def fixed(c: Column, digits: int) -> Column:
    """A number of absolute value below 4 million with so many decimals, rounded by its exact binary value, ties to even."""
    v = F.abs(c) * float(1 << 40)
    whole = F.floor(v)
    units = whole.cast("decimal(38,0)") * F.lit(1 << 23).cast("decimal(10,0)") + F.floor((v - whole) * float(1 << 23)).cast("decimal(10,0)")

    def text(n: Column) -> Column:
        half, one = F.lit(1 << 62).cast("decimal(20,0)"), F.lit(1 << 62).cast("decimal(20,0)") * 2
        low = F.floor(n / one)
        rest = n - low * one
        up = (rest > half) | ((rest == half) & (low % 2 == 1))
        k = (low + F.when(up, 1).otherwise(0)).cast("long")
        sign = F.when((c < 0) & (k > 0), "-").otherwise("")
        ten = 10**digits
        return F.concat(sign, F.floor(k / ten).cast("string"), F.lit("."), F.lpad((k % ten).cast("string"), digits, "0"))

    return let((units * F.lit(10**digits).cast("decimal(5,0)")).cast("decimal(38,0)"), text)


def ymd(year: Column, month: Column, day: Column) -> Column:
    return F.concat(year, F.lit("-"), F.lpad(month, 2, "0"), F.lit("-"), F.lpad(day, 2, "0"))
