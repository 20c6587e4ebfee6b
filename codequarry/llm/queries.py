"""The queries opN_<name> with production parameters over whole tables, and their SQL where there is any."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, fingerprints, langid, linededup, mixing, quality, secrets, sharding, simhash, tokens
from ._common import read_table


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_documents(read_table(spark, sf_dir, "documents"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contained(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op3_linededup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.dedup_lines(read_table(spark, sf_dir, "documents"))


def op3_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.dedup_passages(read_table(spark, sf_dir, "documents"))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id")
    return sharding.place(docs, F.col("doc_id")).select("doc_id", "slot", "shard")


def op5_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(read_table(spark, sf_dir, "documents"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.importance_sample(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan_documents(read_table(spark, sf_dir, "documents"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read_table(spark, sf_dir, "documents"))


def tokenizer_path() -> str:
    """The vocabulary file that op9 encodes with, as installed on every machine."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op9_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.tokenize(read_table(spark, sf_dir, "documents"), tokenizer_path())


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.entropy_mix(read_table(spark, sf_dir, "documents"))


QUERIES = {"op1_fingerprints": op1_fingerprints, "op2_decontamination": op2_decontamination, "op3_linededup": op3_linededup, "op3_passages": op3_passages, "op4_sharding": op4_sharding, "op5_langid": op5_langid, "op6_quality": op6_quality, "op7_secrets": op7_secrets, "op8_simhash": op8_simhash, "op9_tokens": op9_tokens, "op10_mixing": op10_mixing}
ORACLES = {"op2_decontamination": decontaminate.CONTAINED_SQL, "op3_linededup": linededup.LINES_SQL, "op4_sharding": sharding.SHARD_SQL, "op10_mixing": mixing.MIX_SQL}
