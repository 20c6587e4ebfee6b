"""Source trees as DataFrames: path (relative, slashes), length, content."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What each kind of walk keeps and leaves out. Every walk leaves out names that begin with a dot.
WALKS = {
    "graph": ((".js", ".ts", ".jsx", ".tsx"), ()),
    "search": ((".js", ".ts", ".jsx", ".tsx", ".mjs", ".cjs"), ("node_modules", "dist", "build", "coverage", "tmp")),
    "parse": ((".js", ".ts", ".jsx", ".tsx"), ("node_modules", "dist", "build", ".git", "coverage", "tmp")),
}


def wanted(path: Column, walk: str = "graph") -> Column:
    """Whether a walk keeps a relative path."""
    ends, left_out = WALKS[walk]
    parts = F.split(path, "/")
    good = F.when(F.lit(False), F.lit(False))
    for end in ends:
        good = good.when(path.endswith(end), F.lit(True))
    named = F.exists(parts, lambda p: p.startswith(".") | (p.isin(*left_out) if left_out else F.lit(False)))
    return good.otherwise(F.lit(False)) & ~named


def read_tree(spark: SparkSession, root: str, walk: str = "graph") -> DataFrame:
    """The files of a tree that the walk keeps. Files that vanish or can't be read are left out; bytes that aren't UTF-8 decode to replacement characters."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("ignoreMissingFiles", True).load(root)
    full = F.regexp_replace("path", r"\\", "/")
    base = root.replace("\\", "/").split("://")[-1].rstrip("/") + "/"
    relative = F.element_at(F.split(full, F.lit("\\Q" + base + "\\E"), 2), -1)
    return found.select(relative.alias("path"), "length", "content").where(wanted(F.col("path"), walk)).withColumn("text", F.try_validate_utf8(F.col("content").cast("string")))


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One JSON document a file, by a given schema."""
    return spark.read.option("multiLine", True).schema(schema).json(path)
