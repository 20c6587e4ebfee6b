"""Writers: graph tables, snapshots' files, reports."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, DataFrameWriter, SparkSession
from pyspark.sql import functions as F


def write_graph(nodes: DataFrame, relationships: DataFrame, path: str) -> None:
    """Parquet under path, partitioned by type: a query for one type of node or edge reads only its folder.

    Rows stand in ranges of their id; of relationships there are two copies, one in ranges of each end, so that the least and greatest values that Parquet keeps of
    each row group stand in for an index on that end. The number of ranges grows with the data; the other end splits the ranges of a hub.
    """

    def clustered(rows: DataFrame, kind: str, *ends: str) -> DataFrameWriter:
        return rows.repartitionByRange(kind, *ends).sortWithinPartitions(kind, *ends).write.partitionBy(kind)

    clustered(nodes, "node_type", "id").parquet(f"{path}/nodes")
    clustered(relationships, "rel_type", "to_id", "from_id").parquet(f"{path}/relationships")
    clustered(relationships, "rel_type", "from_id", "to_id").parquet(f"{path}/relationships_from")


def read_graph(spark: SparkSession, path: str, by: str = "to_id") -> tuple[DataFrame, DataFrame]:
    """nodes and relationships; by: the end (to_id or from_id) that lookups name."""
    return spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/relationships" + ("_from" if by == "from_id" else ""))


def register_graph(spark: SparkSession, path: str, prefix: str = "graph_") -> list[str]:
    """Name the stored tables in the catalog, with statistics of all columns, for queries in SQL and for the choice of joins."""
    names = []
    for folder in ("nodes", "relationships", "relationships_from"):
        names.append(f"{prefix}{folder}")
        spark.sql(f"CREATE TABLE IF NOT EXISTS {names[-1]} USING parquet LOCATION '{path}/{folder}'")
        spark.sql(f"MSCK REPAIR TABLE {names[-1]}")
        spark.sql(f"ANALYZE TABLE {names[-1]} COMPUTE STATISTICS FOR ALL COLUMNS")
    return names


def replace_snapshot(files: DataFrame, path: str) -> None:
    """Write files (with snapshot_id) so that each snapshot in them replaces its earlier files and other snapshots stay."""
    files.write.option("partitionOverwriteMode", "dynamic").partitionBy("snapshot_id").mode("overwrite").parquet(path)


def table_sizes(tables: dict[str, DataFrame]) -> dict[str, int]:
    """Rows of each table."""
    return {name: df.count() for name, df in tables.items()}


def stored_bytes(spark: SparkSession, path: str) -> int:
    """Bytes of the files under path, those of all its tables."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(where).getLength()


def write_report(rows: DataFrame, path: str, columns: list[str] | None = None, most: int = 10_000) -> None:
    """A small result as JSON (path.json) and as a Markdown table (path.md), in the order of its rows; refuses more than `most` rows."""
    found = rows.limit(most + 1).collect()
    if len(found) > most:
        raise ValueError(f"a report of more than {most} rows; write a table instead")
    columns = columns or rows.columns
    with open(f"{path}.json", "w", encoding="utf-8") as out:
        json.dump([{c: r[c] for c in columns} for r in found], out, indent=2, default=str)
    with open(f"{path}.md", "w", encoding="utf-8") as out:
        out.write("| " + " | ".join(columns) + " |\n|" + "---|" * len(columns) + "\n")
        out.writelines("| " + " | ".join(str(r[c]) for c in columns) + " |\n" for r in found)
