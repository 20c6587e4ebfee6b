"""Classify files as they arrive, a snapshot at a time."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codequarry.operators.manifest import classify
from codequarry.sources.shared import exists, materialise, remove
from codequarry.sources.sinks import replace_snapshot


def merged(made: DataFrame, number: int, target: str) -> DataFrame:
    """made, classified and with batch, among the files that its snapshots have already under target: of each path in a snapshot the version of the latest batch.

    What batch `number` wrote before doesn't count, so that a batch that runs again changes nothing. Versions of a path within one batch stand by hash.
    """
    spark, rows = made.sparkSession, made.withColumn("batch", F.lit(number).cast("long"))
    if exists(spark, target):
        here = spark.read.schema(rows.schema).parquet(target).where(F.col("batch") < number)
        rows = rows.unionByName(here.join(rows.select("snapshot_id").distinct(), "snapshot_id", "left_semi"))
    latest = Window.partitionBy("snapshot_id", "path").orderBy(F.desc("batch"), "hash")
    return rows.withColumn("_n", F.row_number().over(latest)).where("_n = 1").drop("_n")


def classify_arrivals(spark: SparkSession, source: str, target: str, checkpoint: str, schema: str, transform: Callable[[DataFrame], DataFrame] = lambda df: df, complete: bool = True) -> None:
    """Classify the Parquet files that have arrived under source since the last call, and write them to their snapshots under target.

    transform makes snapshot_id, path, content of the rows. A path in several snapshots is a file of each, with its content there. complete: a batch holds its
    snapshots whole, and what they held before goes. Otherwise a snapshot's files may arrive over many batches: they are added to it, and a path that
    arrives again takes the place of its earlier version in that snapshot (the table has a column batch). A batch that runs again replaces what it wrote before.
    """

    def batch(rows: DataFrame, number: int) -> None:
        made = classify(transform(rows).select("snapshot_id", "path", "content"), "snapshot_id")
        if complete:
            replace_snapshot(made, target)
            return
        table = materialise(merged(made, number, target), "arrivals")  # written apart, since it is read from where it goes
        replace_snapshot(table, target)
        remove(table)

    stream = spark.readStream.schema(schema).parquet(source)
    stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(batch).start().awaitTermination()
