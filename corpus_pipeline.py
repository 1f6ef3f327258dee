"""From raw documents to token digests: quality, exact copies, near copies, mixing, tokens.

Each stage works on all that the stage before it kept.
"""

from __future__ import annotations

import public_tokenizers

from corvid.llm import bpe, common, exact_dedup, minhash, mixing, quality

#: Mixing may leave documents out but repeats none, so that ids stay unique.
MIX = mixing.Mix(max_epochs=1)
TOKENIZER = "byte_bpe_50k.tiktoken"


def keep_good(spark, docs, sf_dir):
    """Documents that the quality classifier doesn't reject (score of 0.7 or more)."""
    return quality.drop_low_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_exact(spark, docs, sf_dir):
    """Of equal texts, the one with the largest doc_id."""
    return exact_dedup.drop_exact_copies(docs)


def drop_near(spark, docs, sf_dir):
    """Of each component of near copies (five-word shingles, similarity 0.8), the one with the smallest doc_id."""
    return minhash.drop_near_copies(docs)


def mix(spark, docs, sf_dir):
    """The documents that the target weights take."""
    return mixing.take_mix(docs, MIX)


def tokens(spark, docs, sf_dir):
    """Token counts and digests of ids and decoded bytes."""
    return bpe.bpe_digests(docs, public_tokenizers.path(TOKENIZER), public_tokenizers.PATTERN)


STAGES = [("quality", keep_good), ("exact_dedup", drop_exact), ("near_dedup", drop_near), ("mixing", mix), ("bpe", tokens)]

ORACLE_SQL = None


def run(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs, _ = common.write_shared(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
