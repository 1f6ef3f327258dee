"""JSON arrays from a file or folder, with an explicit schema and a stable input order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvid import schemas
from corvid.functions.text import ustrip
from corvid.operators.cases import usable
from corvid.operators.ingest import agent_answers, backfill_summary


def read_json(spark: SparkSession, path: str, schema: str, glob: str = "*.json") -> DataFrame:
    """Rows with file and pos, the place in input order. Files that are no JSON give a row with _corrupt_record.

    Files go by name. Spark packs files into tasks by size, and splits none here, so that a number that rises within a task
    tells the rows of one file apart; the name goes before it.
    """
    reader = spark.read.schema(f"{schema}, _corrupt_record string").option("multiLine", True).option("mode", "PERMISSIVE").option("pathGlobFilter", glob)
    x = reader.json(path).withColumn("file", F.col("_metadata.file_path"))
    return x.withColumn("pos", F.struct("file", F.monotonically_increasing_id().alias("n")))


def diagnose(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame | None, str]:
    """The good rows, and an error text that is empty when the input was read."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        return None, "missing"
    rows = read_json(spark, path, schema)
    # Spark reads no file for the mark of a broken row alone, so a column of the schema goes with it.
    bad = rows.filter("_corrupt_record is not null").select(rows.columns[0], "_corrupt_record").take(1)
    return rows.filter("_corrupt_record is null").drop("_corrupt_record"), "invalid" if bad else ""


def read_faq(spark: SparkSession, path: str) -> DataFrame:
    return read_json(spark, path, schemas.FAQ)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    return read_json(spark, path, schemas.DOCUMENT)


def _texts(spark: SparkSession, path: str) -> DataFrame:
    """(file, text, kind) of whole files: a list, an object, or invalid. Datasets of questions and results are small files."""
    x = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.col("value").alias("text"))
    head = F.substring(ustrip(F.col("text")), 1, 1)
    return x.withColumn("kind", F.when(F.try_parse_json("text").isNull(), "invalid").when(head == "[", "list").when(head == "{", "object").otherwise("other"))


def _nested(schema: str) -> str:
    return schema.replace(" array<", ":array<").replace(" string", ":string").replace(" double", ":double").replace(" boolean", ":boolean").replace(" map<", ":map<").replace(", ", ",")


def read_cases(spark: SparkSession, path: str) -> DataFrame:
    """Evaluation cases of a versioned dataset ({"items": [...]}) or a plain list; rows without an id get legacy_<n> by their place in it."""
    item = f"array<struct<{_nested(schemas.EVAL_CASE)}>>"
    x = _texts(spark, path)
    found = F.when(F.col("kind") == "list", F.from_json("text", item)).when(F.col("kind") == "object", F.from_json("text", f"struct<items:{item}>")["items"])
    return x.select(F.posexplode(found).alias("n", "item")).select("n", "item.*").withColumn("id", F.coalesce("id", F.concat(F.lit("legacy_"), F.col("n").cast("string"))))


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    """(n, question, category, difficulty) of a list, {"questions": [...]} or {"items": [...]}; items give question and category alone."""
    entry = "array<struct<question:string,q:string,category:string,difficulty:string>>"
    x = _texts(spark, path)
    other = F.from_json("text", f"struct<questions:{entry},items:{entry}>")
    bare = F.transform(other["items"], lambda i: F.struct(i["question"].alias("question"), F.lit(None).cast("string").alias("q"), i["category"].alias("category"), F.lit(None).cast("string").alias("difficulty")))
    found = F.when(F.col("kind") == "list", F.from_json("text", entry)).when(F.col("kind") == "object", F.coalesce(other["questions"], bare))
    known = F.when(found.isNotNull(), found).otherwise(F.raise_error(F.concat(F.lit("no list of questions in "), F.col("file"))).cast(entry))
    return x.select(F.posexplode(known).alias("n", "i")).select("n", F.coalesce("i.question", "i.q", F.lit("")).alias("question"), F.coalesce("i.category", F.lit("")).alias("category"), F.coalesce("i.difficulty", F.lit("medium")).alias("difficulty"))


def read_usable_cases(spark: SparkSession, path: str) -> DataFrame:
    """Cases of a plain list that have a question and an expected answer; any other form is an error."""
    x = _texts(spark, path)
    item = f"array<struct<{_nested(schemas.EVAL_CASE)}>>"
    found = F.when(F.col("kind") == "list", F.from_json("text", item)).otherwise(F.raise_error(F.lit("a list of cases is needed")).cast(item))
    return usable(x.select(F.posexplode(found).alias("n", "item")).select("n", "item.*"))


def read_agent_answers(spark: SparkSession, path: str) -> DataFrame:
    """Agents' answers with pos, and an error in place of a row for a file that is no JSON or no list."""
    entry = f"array<struct<{_nested(schemas.AGENT_ANSWER)}>>"
    x = _texts(spark, path).withColumn("error", F.when(F.col("kind") == "invalid", "JSON 파싱 오류").when(F.col("kind") != "list", "JSON 형식 오류: 배열이 아닙니다."))
    good = F.when(F.col("error").isNull(), F.from_json("text", entry))
    return x.select("file", "error", F.posexplode_outer(good).alias("pos", "i")).select("file", F.coalesce("pos", F.lit(0)).alias("pos"), "error", "i.*")


def agent_answers_or_error(spark: SparkSession, path: str, as_of: str) -> DataFrame:
    """The summary of a file of agents' answers; a missing file is its one error."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        return spark.createDataFrame([(False, 0, 0, 1, [f"파일을 찾을 수 없습니다: {path}"])], "success boolean, added_count long, skipped_count long, error_count long, errors array<string>")
    return backfill_summary(agent_answers(read_agent_answers(spark, path), as_of))


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """A row a results file: model, counts, the means and deviations; missing numbers are 0. Judge and context measures are not read."""
    means = ["mean_similarity", "mean_bleu", "mean_faithfulness", "mean_latency_ms", "std_similarity", "std_bleu", "std_latency_ms"]
    schema = f"struct<model_name:string,total_cases:long,evaluated_cases:long,metrics:struct<{','.join(f'{m}:double' for m in means)}>,verification:struct<verified_count:long,verification_rate:double>,category_scores:map<string,map<string,double>>>"
    x = _texts(spark, path).filter("kind = 'object'").withColumn("r", F.from_json("text", schema))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return x.select(F.coalesce("r.model_name", F.lit("unknown")).alias("model"), zero("r.total_cases").alias("total_cases"), zero("r.evaluated_cases").alias("evaluated_cases"), *[zero(f"r.metrics.{m}").alias(m) for m in means], zero("r.verification.verified_count").alias("verified_count"), zero("r.verification.verification_rate").alias("verification_rate"), F.col("r.category_scores").alias("category_scores"))
