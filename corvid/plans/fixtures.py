"""Literal rows that Spark and SQL read alike, for rules that the driver's tables have no cases of."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType


def rows(spark: SparkSession, schema: str, values: list[tuple]) -> DataFrame:
    """A local relation: its size is known, so that plans may broadcast it without being told."""
    kind = StructType.fromDDL(schema)
    plain = lambda v: list(v.items()) if isinstance(v, dict) else v
    columns = [pa.array([plain(r[k]) for r in values], to_arrow_type(f.dataType)) for k, f in enumerate(kind.fields)]
    return spark.createDataFrame(pa.Table.from_arrays(columns, kind.names), schema=kind)


def sql(schema: str, values: list[tuple]) -> str:
    names = ", ".join(part.split()[0] for part in schema.split(", "))

    def lit(v) -> str:
        if v is None:
            return "NULL"
        if isinstance(v, bool):
            return str(v)
        if isinstance(v, (int, float)):
            return f"({v!r})::DOUBLE" if isinstance(v, float) else repr(v)
        if isinstance(v, list):
            return "[" + ", ".join(map(lit, v)) + "]::VARCHAR[]"
        return "'" + v.replace("'", "''") + "'"

    return f"(SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(lit, r)) + ')' for r in values)}) AS t({names}))"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


REF_SCHEMA = "id int, query string"
REFS = [(1, "제1조가 뭐야?"), (2, "제3조 2항 알려줘"), (3, "제1조(목적) 설명"), (4, "환불은 어떻게 하나요?"), (5, "제 12 조 3 항 4 호를 보여줘"), (6, "제5조 （정의） 2항"), (7, "7조 제2항"), (8, "")]
TITLE_SCHEMA = "tid int, title string"
TITLES = [(1, "제1조(목적)"), (2, "제3조 (환불)"), (3, "제 12 조（면책）"), (4, "제1조 목적"), (5, "부칙"), (6, "제1조(정의)"), (7, "")]
CHUNK_SCHEMA = "chunk_id string, text string"
CHUNKS = [
    ("c1", "회사는 서비스 이용을 제한할 수 있습니다."),
    ("c2", "이용자는 요금을 해야 하며 책임은 이용자에게 있습니다."),
    ("c3", "회사는 천재지변에 대하여 책임을 지지 아니합니다."),
    ("c4", '"이용자"라 함은 서비스에 접속하는 자를 말한다.'),
    ("c5", "회사는 서비스 이용을 제한할 수 있습니다."),
    ("c6", "고객은 타인의 정보 도용을 하여서는 아니 된다."),
    ("c7", ""),
    ("c8", "회사는 통신 장애에 대해 면책됩니다. 당사는 정전에 대하여 면책됩니다."),
]
TEXT_SCHEMA = "id int, text string"
DATES = [
    (1, "이 약관은 2024년 01월 15일부터 시행합니다."), (2, "시행일: 2023.5.7"), (3, "시행일 2022/11/3 그리고 2024년 2월 1일부터 시행"), (4, "없음"), (5, ""),
    (6, "개정 2020.1.2 제정 2019년3월4 개정 2020.01.02 개정 2021/12/31"), (7, "제정 1999 . 7 . 8"),
]
ANSWER_SCHEMA = "id int, answer string, titles array<string>, model_confidence double"
ANSWERS = [
    (1, "환불됩니다. [참조: 제3조(환불)]", ["제3조(환불)", "제4조(해지)"], None),
    (2, "[출처: FAQ] 보통 가능합니다.", ["제3조(환불)"], 0.9),
    (3, "아마도 그렇습니다. [참조: 제9조(없음)]", ["제3조(환불)"], 0.1),
    (4, "출처가 없습니다.", ["제3조(환불)"], None),
    (5, "가" * 501, ["제3조(환불)"], None),
    (6, "[참조: 제3조] 일반적으로 보통 아마도 제 생각에는 추측컨대 [출처: 제8조]", [], 0.0),
    (7, "", ["제1조(목적)"], 0.5),
]
BAND_SCHEMA = "id int, score double"
BANDS = [(k, s) for k, s in enumerate([1.0, 0.80, 0.79999, 0.70, 0.69999, 0.65, 0.64999, 0.55, 0.54999, 0.40, 0.39999, 0.0])] + [(99, None)]
REPLY_SCHEMA = "id int, reply string"
REPLIES = [
    (1, '{"confidence": 0.9, "verified": true}'), (2, 'Here:\n```json\n{"confidence": 0.4, "verified": false}\n```'), (3, 'So {"confidence": 0.25, "verified": true} it is'), (4, "none"), (5, ""), (6, None), (7, '{"verified": true}'), (8, "```\n{\"confidence\": 1}\n```"),
]
JUDGE_SCHEMA = "id int, score double"
JUDGES = [(1, 5.0), (2, 4.5), (3, 3.0), (4, 1.0), (5, 0.0), (6, -2.0), (7, None)]
MODEL_SCHEMA = "id int, generator string, provider string"
MODELS = [(1, "Alpha-1", "north"), (2, "beta_2", "south"), (3, "gamma", "north"), (4, "delta", "elsewhere"), (5, "judge-n", "north")]
PAIR_SCHEMA = "generator string, judge string"
PAIRS = [("alpha-1", "judge-s"), ("beta_2", "judge-n")]
PROVIDER_SCHEMA = "provider string, fallback string"
PROVIDER_JUDGES = [("north", "judge-n"), ("south", "judge-n")]
CLICK_SCHEMA = "id int, onclick string"
CLICKS = [(1, "doView('78','1')"), (2, "doView( '5' , '22' ); return false"), (3, "doFile('/a/b.pdf')"), (4, "goPage(3)"), (5, "<a href=\"javascript:goPage('12')\"> goPage(4)"), (6, "")]
CASE_SCHEMA = "id int, got array<string>, want array<string>"
CASES = [(1, ["a", "b", "x"], ["a", "b", "c"]), (2, ["x"], ["a"]), (3, ["x"], []), (4, ["a", "b"], ["a"]), (5, [], ["a"]), (6, ["a", "a"], ["a", "a"])]
