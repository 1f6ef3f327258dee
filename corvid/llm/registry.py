"""The corpus operators as queries over whole tables, with SQL where SQL can express them."""

from __future__ import annotations

import corpus_pipeline
import public_tokenizers
from pyspark.sql import functions as F

from corvid.llm import bpe, chat, divergence, embedding_dedup, exact_dedup, hard_negatives, html_text, licenses, lm, minhash, mixing, quality, suffix_dedup


def table(spark, sf_dir: str, name: str):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_suffix_dedup(spark, sf_dir):
    return suffix_dedup.cut_repeats(table(spark, sf_dir, "documents"), texts=False).drop("kept")


def op2_minhash(spark, sf_dir):
    return minhash.near_dedup(table(spark, sf_dir, "documents"), width=2)


def op3_licenses(spark, sf_dir):
    return licenses.scan_licenses(table(spark, sf_dir, "documents")).drop("blocks", "windows")


def op4_lm(spark, sf_dir):
    return lm.score_texts(table(spark, sf_dir, "documents"))


def op5_exact_dedup(spark, sf_dir):
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op7_mixing(spark, sf_dir):
    return mixing.mix_sources(table(spark, sf_dir, "documents"))


def op6_html_text(spark, sf_dir):
    return html_text.extract_text(table(spark, sf_dir, "pages"))


def op8_quality(spark, sf_dir):
    return quality.score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_embeddings(spark, sf_dir):
    return embedding_dedup.near_embeddings(table(spark, sf_dir, "embeddings"))


def op10_bpe(spark, sf_dir):
    return bpe.bpe_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op11_chat(spark, sf_dir):
    said = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    more = spark.createDataFrame([(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")], "conv_id long, turn long, role string, text string")
    return chat.chat_digests(said.unionByName(more))


def op12_hard_negatives(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").withColumn("label", F.col("label").cast("long"))
    return hard_negatives.hard_negatives(rows.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))))


def op13_divergence(spark, sf_dir):
    return divergence.divergence(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_suffix_dedup": op1_suffix_dedup,
    "op2_minhash": op2_minhash,
    "op3_licenses": op3_licenses,
    "op4_lm": op4_lm,
    "op5_exact_dedup": op5_exact_dedup,
    "op6_html_text": op6_html_text,
    "op7_mixing": op7_mixing,
    "op8_quality": op8_quality,
    "op9_embeddings": op9_embeddings,
    "op10_bpe": op10_bpe,
    "op11_chat": op11_chat,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_divergence": op13_divergence,
    "pipeline": corpus_pipeline.run,
}
ORACLE_SQL = {
    "op5_exact_dedup": exact_dedup.ORACLE_SQL,
    "op7_mixing": mixing.oracle_sql(),
    "op9_embeddings": embedding_dedup.ORACLE_SQL,
    "op11_chat": chat.ORACLE_SQL,
    "op12_hard_negatives": hard_negatives.ORACLE_SQL,
    "op13_divergence": divergence.ORACLE_SQL,
}
