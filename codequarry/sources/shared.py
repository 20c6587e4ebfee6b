"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid
from hashlib import md5

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or a local folder where it is unset and all runs on this machine (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="codequarry-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def shared_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/codequarry/{label}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write df as Parquet under the shared folder and read it back: lineage ends at files that outlive executors."""
    path = shared_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _file_system(spark: SparkSession, path: str) -> tuple:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def exists(spark: SparkSession, path: str) -> bool:
    fs, where = _file_system(spark, path)
    return fs.exists(where)


def fingerprint_of(spark: SparkSession, path: str) -> str:
    """What tells one state of a table's files from another, without a list of them: the time of the path's last change, its bytes and files."""
    fs, where = _file_system(spark, path)
    if not fs.exists(where):
        return "none"
    held = fs.getContentSummary(where)
    return md5(repr((path, fs.getFileStatus(where).getModificationTime(), held.getLength(), held.getFileCount())).encode()).hexdigest()


def remove(df: DataFrame) -> None:
    """Delete the files of a materialised table that nothing will read again."""
    spark = df.sparkSession
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        fs, where = _file_system(spark, folder)
        fs.delete(where, True)


def spread(df: DataFrame, key: str) -> DataFrame:
    """df over as many partitions as there are cores if its scan has fewer, as small files do; as it is otherwise."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if df._jdf.queryExecution().toRdd().getNumPartitions() < cores else df
