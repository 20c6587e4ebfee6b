"""File discovery, classification and snapshot manifests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codequarry.functions import code as C


def classify(files: DataFrame, *also: str) -> DataFrame:
    """path, size, hash, language, is_test, test_framework, is_binary, analyzable of files outside the directories left out, and their columns `also`. files: path, content (binary)."""
    kept = files.where(~C.left_out(F.col("path")))
    text = F.decode("content", "UTF-8")
    language = C.language(F.col("path"))
    return kept.select(
        "path",
        F.octet_length("content").cast("long").alias("size"),
        C.capped_sha256(F.col("content")).alias("hash"),
        language.alias("language"),
        C.is_test(F.col("path")).alias("is_test"),
        C.test_framework(text).alias("test_framework"),
        C.is_binary(F.col("content")).alias("is_binary"),
        (~C.is_binary(F.col("content")) & (language != "unknown")).alias("analyzable"),
        *also,
    )


def language_breakdown(classified: DataFrame) -> DataFrame:
    return classified.groupBy("language").agg(F.count(F.lit(1)).alias("files"), F.sum("size").alias("bytes"))


def manifest(classified: DataFrame) -> DataFrame:
    """file_count, total_size, analyzable_count, languages (name=files, in order of name), outcome; one row."""
    by_language = classified.groupBy("language").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("size"), F.count_if("analyzable").alias("ok"))
    named = F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", "language", F.col("n").cast("string")))), ",")
    total = by_language.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("file_count"), F.coalesce(F.sum("size"), F.lit(0)).alias("total_size"), F.coalesce(F.sum("ok"), F.lit(0)).alias("analyzable_count"), named.alias("languages"))
    return total.withColumn("outcome", F.when(F.col("analyzable_count") > 0, "COMPLETED").otherwise("COMPLETED_WITH_WARNINGS"))
