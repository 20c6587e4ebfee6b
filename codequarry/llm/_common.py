"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from codequarry.sources.shared import materialise, remove, shared_dir, shared_path  # noqa: F401

from ._words import slices

#: ASCII white space that separates words: space and code points 9 to 13.
WORD = r"[^\x20\x09-\x0D]+"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table; only Spark touches the path."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def hash_bucket(key: Column, modulus: int) -> Column:
    """A bucket from 0 that an ANSI SQL engine can reproduce: leading 28 bits of md5 over the key as text; null as ''."""
    text = F.coalesce(key.cast("string"), F.lit(""))
    return F.conv(F.substring(F.md5(text), 1, 7), 16, 10).cast("long") % F.lit(modulus)


def salted(key: Column, salts: int) -> Column:
    """Salt from a row's own key, so that a task that runs again salts alike."""
    return F.pmod(F.xxhash64(key), F.lit(salts)).cast("int")


def every_salt(salts: int) -> Column:
    """To replicate the small side of a salted join."""
    return F.explode(F.array(*[F.lit(i) for i in range(salts)]))


def rows_with_keys(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """row (all columns of docs, so that their names clash with no others) and what tells it from other rows: _id, _digest of its text, _rest (a hash of its other columns)."""
    every = {c: F.col(f"`{c}`") for c in docs.columns}
    others = [col for c, col in every.items() if c not in (id_col, text_col)]
    rest = F.xxhash64(*others) if others else F.lit(0).cast("long")
    return docs.select(F.struct(*every.values()).alias("row"), every[id_col].alias("_id"), F.md5(every[text_col].cast("string")).alias("_digest"), rest.alias("_rest"))


ROW_KEYS = ("_id", "_digest", "_rest")


def same_row(a: str, b: str, keys: tuple[str, ...] = ROW_KEYS) -> Column:
    """Whether the rows of aliases a and b have equal keys, nulls included."""
    return reduce(Column.__and__, [F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}")) for k in keys])


def map_texts(rows: DataFrame, make: Callable[[], Callable[[str | None], tuple]], columns: str) -> DataFrame:
    """rows without text, and what make()(text) gives of each text as further columns.

    Spark bounds an Arrow batch by its bytes (spark.sql.execution.arrow.maxBytesPerBatch); a worker takes it slice by slice and text by text, so
    nothing of the session is changed. Other columns stay in Arrow as they are.
    """
    kept = [f for f in rows.schema.fields if f.name != "text"]
    schema = StructType(kept + StructType.fromDDL(columns).fields)
    arrow = to_arrow_schema(schema)

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = make()
        for part in slices(parts):
            found = list(zip(*(judge(t.as_py()) for t in part["text"].chunk(0)), strict=True))
            same = [part[f.name].chunk(0).cast(arrow.field(f.name).type) for f in kept]
            yield pa.RecordBatch.from_arrays([*same, *(pa.array(c, type=f.type) for c, f in zip(found, list(arrow)[len(kept) :], strict=True))], schema=arrow)

    return rows.mapInArrow(batches, schema)


def kind(df: DataFrame, column: str) -> str:
    """A column's type as text, for the schema of a Python function."""
    return df.schema[column].dataType.simpleString()
