"""Subject - predicate - object relations: extraction by patterns, storage and search."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvid.functions.text import ustrip


@dataclass(frozen=True)
class Pattern:
    """A pattern with the groups of subject, predicate and object; a part is group number or fixed text."""

    regex: str
    subject: int | str
    predicate: int | str
    object: int | str
    default_subject: str = ""
    predicate_suffix: str = ""


# Relation patterns, names of predicates, and particles that a part loses at its end.
PATTERNS = [
    Pattern(r"(회사|당사|고객|이용자|납부자|가입자|사용자|투자자)(?:는|은|가|이)\s+([^을를]+)[을를]\s+(할 수 있|하여야 하|해야 하|거부할 수 있|거절할 수 있|제한할 수 있)", 1, 3, 2),
    Pattern(r'"?([^"]+)"?(?:이)?라\s*(?:함은|란)\s+([^을를]+)[을를]?\s*(?:말한다|의미한다|뜻한다)', 1, "정의", 2),
    Pattern(r"([가-힣\s]+)(?:하는|한)\s*경우(?:에)?[는는,]?\s*(회사|고객|이용자)?(?:는|은)?\s*([가-힣\s]{2,20})(?:합니다|한다|됩니다|된다)", 2, 1, 3, "회사", "_시"),
    Pattern(r"(회사|고객|이용자)?(?:는|은)?\s*([가-힣\s]+)[을를]?\s*(?:하여서는|해서는)\s*(?:아니|안)\s*(?:된다|됩니다)", 1, "금지", 2, "행위자"),
    Pattern(r"(회사|당사)(?:는|은)\s+([가-힣\s]+)에\s*(?:대하여|대해)\s*(?:책임을?\s*)?(?:지지\s*(?:아니|않|안)|면책)", 1, "면책", 2),
]
PREDICATES = {"할 수 있": "가능", "하여야 하": "의무", "해야 하": "의무", "거부할 수 있": "거부_가능", "거절할 수 있": "거절_가능", "제한할 수 있": "제한_가능"}
PARTICLES = "을를이가은는의에서로"
CONFIDENCE = 0.8


def clean(c: Column) -> Column:
    """White space squeezed, one particle at the end dropped."""
    return ustrip(F.regexp_replace(F.regexp_replace(ustrip(c), r"(?U)\s+", " "), f"[{PARTICLES}]$", ""))


def _parts(text: Column, p: Pattern) -> Column:
    groups = {g for g in (p.subject, p.predicate, p.object) if isinstance(g, int)}
    found = F.arrays_zip(*[F.regexp_extract_all(text, F.lit("(?U)" + p.regex), F.lit(g)).alias(f"g{g}") for g in sorted(groups)])

    def part(m: Column, g: int | str) -> Column:
        return m[f"g{g}"] if isinstance(g, int) else F.lit(g)

    def triple(m: Column) -> Column:
        subject = F.coalesce(F.when(part(m, p.subject) != "", part(m, p.subject)), F.lit(p.default_subject))
        predicate = ustrip(part(m, p.predicate))
        named = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in PREDICATES.items() for x in kv]), predicate), predicate)
        return F.struct(clean(subject).alias("subject"), clean(F.concat(named, F.lit(p.predicate_suffix))).alias("predicate"), clean(part(m, p.object)).alias("object"))

    # Most texts match no pattern: they are read once, not once a group.
    parts = F.transform(found, triple)
    return F.when(~text.rlike("(?U)" + p.regex), F.array().cast("array<struct<subject:string,predicate:string,object:string>>")).otherwise(parts)


def extract(text: Column, patterns: list[Pattern] | None = None) -> Column:
    """array<struct<subject, predicate, object>> of a text, by pattern and place; each once, empty parts left out."""
    all_ = F.concat(*[_parts(text, p) for p in (patterns or PATTERNS)])
    return F.array_distinct(F.filter(all_, lambda t: (t["subject"] != "") & (t["predicate"] != "") & (t["object"] != "")))


def triplet_id(t: DataFrame | None = None) -> Column:
    return F.substring(F.md5(F.concat_ws(":", "subject", "predicate", "object").cast("binary")), 1, 12)


def extract_all(rows: DataFrame, chunk_id: str, text: Column, patterns: list[Pattern] | None = None) -> DataFrame:
    """(chunk_id, pos, subject, predicate, object, triplet_id, confidence) of all chunks."""
    x = rows.select(F.col(chunk_id).alias("chunk_id"), F.posexplode(extract(text, patterns)).alias("pos", "t")).select("chunk_id", "pos", "t.*")
    return x.withColumn("triplet_id", triplet_id()).withColumn("confidence", F.lit(CONFIDENCE))


def store(triplets: DataFrame) -> DataFrame:
    """One row per content id; the first chunk keeps the attribution."""
    return triplets.groupBy("triplet_id", "subject", "predicate", "object", "confidence").agg(F.min("chunk_id").alias("chunk_id"))


GRAM = 3


def _grams(c: Column) -> Column:
    """Every character and every run of three characters of a text, each once."""
    runs = lambda n: F.when(F.length(c) >= n, F.transform(F.sequence(F.lit(1), F.length(c) - n + 1), lambda i: c.substr(i, F.lit(n)))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(runs(1), runs(GRAM)))


def containments(queries: DataFrame, keys: DataFrame) -> DataFrame:
    """(q, k, score) of queries(q) and keys(k), both distinct and in lower case, of which one holds the other.

    The held text's head, three characters or one if it is shorter, is among the grams of the other: that joins them, and
    the texts themselves decide. Empty texts match nothing.
    """
    head = lambda c: F.when(F.length(c) >= GRAM, F.substring(c, 1, GRAM)).otherwise(F.substring(c, 1, 1))
    inside = keys.select("k", F.explode(_grams(F.col("k"))).alias("g")).join(queries.select("q", head(F.col("q")).alias("g")), "g").filter(F.col("k").contains(F.col("q")) & (F.col("q") != ""))
    around = queries.select("q", F.explode(_grams(F.col("q"))).alias("g")).join(keys.select("k", head(F.col("k")).alias("g")), "g").filter(F.col("q").contains(F.col("k")) & (F.col("k") != ""))
    return inside.select("q", "k").union(around.select("q", "k")).distinct().withColumn("score", F.length("q") / F.greatest(F.length("k"), F.length("q")))


def search(queries: DataFrame, triplets: DataFrame, query: str = "query", fuzzy: bool = True) -> DataFrame:
    """Each query's triplets with match_type and score: the first field that matches counts, not the best one.

    Fuzzy search is containment either way. Queries meet the distinct values of the fields by their grams, and what
    matches finds its triplets by equality; no triplet is compared with a query it has nothing in common with.
    """
    fields = ("subject", "predicate", "object")
    places = triplets.select(F.struct(*triplets.columns).alias("__t"), F.posexplode(F.array(*[F.lower(f) for f in fields])).alias("__n", "__key"))
    places = places.filter("__key is not null").withColumn("match_type", F.element_at(F.array(*map(F.lit, fields)), F.col("__n") + 1))
    asked = queries.withColumn("__q", F.lower(query))
    if fuzzy:
        keys = places.select(F.col("__key").alias("k")).distinct()
        found = containments(asked.select(F.col("__q").alias("q")).distinct(), keys)
        asked = asked.join(found, F.col("__q") == F.col("q")).drop("q")
    else:
        asked = asked.withColumn("k", F.col("__q")).withColumn("score", F.lit(1.0))
    x = places.join(asked, F.col("__key") == F.col("k"))
    first = F.min_by(F.struct("match_type", "score"), "__n").alias("__m")
    return x.groupBy(*queries.columns, "__t").agg(first).select(*queries.columns, "__t.*", "__m.match_type", "__m.score")


def search_within(asked: DataFrame, triplets: DataFrame) -> DataFrame:
    """What a fuzzy :func:`search` gives of the chunks that queries ask about: ``asked`` (query_id, item_id, query), item_id a chunk's.

    Adds the triplet and its score, each once. Triplets are met by their chunk alone, so rows grow with what the chunks
    hold, not with how often a word of a query is a part of any triplet.
    """
    x = asked.distinct().join(triplets.select(F.col("chunk_id").alias("item_id"), F.struct(*triplets.columns).alias("__t")), "item_id")
    q = F.lower("query")

    def score(field: str) -> Column:
        k = F.lower(F.col("__t")[field])
        return F.when((q != "") & (k != "") & (k.contains(q) | q.contains(k)), F.length(q) / F.greatest(F.length(k), F.length(q)))

    # The first field that matches counts, not the best one.
    first = F.coalesce(*[score(f) for f in ("subject", "predicate", "object")])
    return x.withColumn("score", first).filter("score is not null").distinct()


def chunk_scores(hits: DataFrame, by: list[str]) -> DataFrame:
    """Sum of scores per query and chunk, as a share of the query's largest sum."""
    sums = hits.groupBy(*by, "chunk_id").agg(F.sum("score").alias("total"))
    best = sums.groupBy(*by).agg(F.max("total").alias("best"))
    return sums.join(best, by).withColumn("triplet_score", F.col("total") / F.col("best")).drop("best")


def by_chunk(triplets: DataFrame, chunk: str) -> DataFrame:
    return triplets.filter(F.col("chunk_id") == chunk)


def build_index(chunks: DataFrame, patterns: list[Pattern] | None = None, chunk_id: str = "id", title: str = "section_title", content: str = "section_content") -> tuple[DataFrame, DataFrame]:
    """The store of a collection's triplets, and one row with how many were extracted (not stored) and how many are stored."""
    text = F.concat(F.coalesce(title, F.lit("")), F.lit("\n"), F.coalesce(content, F.lit("")))
    found = extract_all(chunks, chunk_id, text, patterns)
    kept = store(found)
    return kept, found.agg(F.count("*").alias("extracted")).join(kept.agg(F.count("*").alias("stored")))


def save(triplets: DataFrame, path: str) -> None:
    triplets.select("triplet_id", "subject", "predicate", "object", "chunk_id", "confidence").write.mode("overwrite").json(path)


def load(spark: SparkSession, path: str) -> DataFrame:
    """What :func:`save` wrote; ids are made anew, and of equal triplets one stays."""
    rows = spark.read.schema("subject string, predicate string, object string, chunk_id string, confidence double").json(path)
    return store(rows.withColumn("triplet_id", triplet_id()))


def clear(spark: SparkSession, path: str) -> None:
    spark.createDataFrame([], "triplet_id string, subject string, predicate string, object string, chunk_id string, confidence double").write.mode("overwrite").json(path)
