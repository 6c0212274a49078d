"""A corpus pipeline: documents in, token ids of a mixed, clean, deduplicated corpus out.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame; a stage's result is written as Parquet
and read again as the next one's ``docs``. All stages but the last return the columns of
``documents``.

Null and empty texts are clean, are copies of each other, have no near copies, take no words of the
mix and give no tokens; very long texts are read whole. Rows that repeat are exact copies: one stays.
An empty table gives an empty result. Other columns of ``documents`` travel as far as the mix,
whatever their names. Ties are those of the operators. This module needs the ``llm`` subpackage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from coldlake.llm import bpe, exact, minhash, mixing, toxicity
from coldlake.llm.common import materialise, table

#: Rank file of the tokenizer.
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the severity model does not reject."""
    model = toxicity.fit_toxicity(docs, table(spark, sf_dir, "labels"))
    return toxicity.drop_toxic(docs, model)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return exact.drop_duplicates(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: five-word shingles, similarity 0.8 or more."""
    return minhash.drop_near_duplicates(docs, size=5, percent=80)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of sources, documents repeated as the targets ask."""
    shards = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return mixing.mixed_documents(docs, shards=shards)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every copy, their number, and the SHA-256 of the bytes that they decode to.

    The ids are written between the two steps, so that a task holds one Python worker at a time.
    """
    tokens = materialise(bpe.encode(docs, RANKS, public_tokenizers.PATTERN), "tokens")
    decoded = bpe.decode(tokens, RANKS)
    return decoded.select(
        "doc_id",
        "lang",
        "source",
        "n_chars",
        F.size("ids").cast("long").alias("n_tokens"),
        "ids",
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_exact_copies),
    ("near_dedup", drop_near_copies),
    ("mixing", mix),
    ("byte_bpe", tokenize),
]

#: SQL cannot express the models and the tokenizer; tests compare with brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
