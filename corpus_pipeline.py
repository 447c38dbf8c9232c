"""A training-data pipeline of five operators; each stage works on what the one before it kept.

``run`` writes each stage's rows to the cluster's shared folder and reads them again, so that a stage is
computed once and a lost executor costs only the tasks it ran.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runstore.llm import bytebpe, mixing, pii, quality, simhash
from runstore.llm.common import kept, quoted


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules accept."""
    return quality.accepted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: that of the smallest id."""
    return simhash.keep_one(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without personal data; n_chars follows the text."""
    clean = pii.sanitised(docs)
    return clean.withColumn("n_chars", F.length("text").cast("long")).select(*[quoted(c) for c in docs.columns])


def mixing_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    packed = docs.select(F.struct(*[quoted(c) for c in docs.columns]).alias("doc"), "doc_id", "text", "source")  # no column is taken for one of the mix
    mixed = mixing.mix(packed).withColumn("copy", F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int"))))
    return mixed.select(*[F.col("doc")[c].alias(c) for c in docs.columns])


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of each text, and the hash of what they decode to."""
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    # smaller tables than alone: workers share executors with what the stages before left there
    coded = bytebpe.encode_decode(docs.select("doc_id", "lang", "source", "text"), ranks, public_tokenizers.PATTERN, states=100_000, words=200_000, give_back=True)
    return coded.drop("decoded")


STAGES = [
    ("quality rules", quality_rules),
    ("simhash near-dedup", near_dedup),
    ("personal data", personal_data),
    ("mixing sources", mixing_sources),
    ("byte-level bpe", byte_bpe),
]

#: Components, selection by seed and token ids have no SQL form; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = kept(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
