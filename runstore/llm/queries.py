"""The registered queries of this subpackage: each applies its operator to the whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from runstore.llm import bytebpe, dac, langid, media, mixing, pii, quality, sharding, simhash, tokencount


def _documents(spark, sf_dir, *columns):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select(*columns)


def op1_mixing(spark, sf_dir):
    mixed = mixing.mix(_documents(spark, sf_dir, "doc_id", "text", "source"), keep_text=False)
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "copies")


def op2_language_id(spark, sf_dir):
    docs = _documents(spark, sf_dir, "doc_id", "text", "lang")
    rest = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3
    model = langid.train(docs.where(rest != 1))
    found = langid.predict(docs.select("doc_id", F.coalesce(rest == 1, F.lit(False)).alias("held_out"), "text"), model)
    return found.select("doc_id", "held_out", "lang_pred", "score")


def op3_simhash(spark, sf_dir):
    return simhash.near_duplicates(_documents(spark, sf_dir, "doc_id", "text")).select("doc_id", "fingerprint", "component_id")


def op4_token_files(spark, sf_dir, tokenizer=None):
    return dac.token_files(_documents(spark, sf_dir, "doc_id", "text"), tokenizer or public_tokenizers.path("byte_bpe_50k.json"))


def op5_pii(spark, sf_dir):
    found = pii.personal_data(_documents(spark, sf_dir, "doc_id", "text"))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans")


def op6_byte_bpe(spark, sf_dir, ranks=None):
    return bytebpe.encode_decode(_documents(spark, sf_dir, "doc_id", "text"), ranks or public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, keep_ids=False)


def op7_quality(spark, sf_dir):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.judged(_documents(spark, sf_dir, "doc_id", "text", "lang"), labels).drop("lang")


def op8_token_counts(spark, sf_dir, tokenizer=None):
    return tokencount.token_counts(_documents(spark, sf_dir, "doc_id", "text"), tokenizer or public_tokenizers.path("byte_bpe_50k.json"))


def op9_sharding(spark, sf_dir):
    return sharding.shard_documents(_documents(spark, sf_dir, "doc_id", "text"), keep_text=False)


def op10_media(spark, sf_dir):
    return media.media_columns(_documents(spark, sf_dir, "doc_id", "text"), keep_media=False)


def queries():
    return {f.__name__: f for f in (op1_mixing, op2_language_id, op3_simhash, op4_token_files, op5_pii, op6_byte_bpe, op7_quality, op8_token_counts, op9_sharding, op10_media)}


def oracle_sql():
    """None of the ten can be written in SQL as a whole; the tests compare them with brute force."""
    return {}
