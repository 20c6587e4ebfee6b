"""Evaluation: precision and recall at k, wins, precision and recall of sets, order statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def at_k(results: DataFrame, gold: DataFrame, k: int, within: bool = False) -> DataFrame:
    """query_id, hits, p, r for every query of gold. results: query_id, rank, file_path; gold: query_id, file_path, distinct.

    hits: gold files among the first k results; within: that stand anywhere in the path of one of them (a query's first k results meet only its own gold). p: hits
    over the results seen, null without results. r: hits over gold files.
    """
    top = results.where(F.col("rank") <= k)
    seen = top.groupBy("query_id").agg(F.count(F.lit(1)).alias("seen"))
    shown = top.select("query_id", "file_path").distinct()
    if within:
        parts = gold.join(shown.withColumnRenamed("file_path", "shown"), "query_id").where(F.col("shown").contains(F.col("file_path"))).select("query_id", "file_path").distinct()
    else:
        parts = gold.join(shown, ["query_id", "file_path"])
    hit = parts.groupBy("query_id").agg(F.count(F.lit(1)).alias("hits"))
    all_gold = gold.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_gold"))
    joined = all_gold.join(seen, "query_id", "left").join(hit, "query_id", "left").withColumn("hits", F.coalesce("hits", F.lit(0)))
    return joined.select("query_id", "hits", F.when(F.col("seen") > 0, F.col("hits") / F.col("seen")).alias("p"), (F.col("hits") / F.col("n_gold")).alias("r"))


def mean_at(results: DataFrame, gold: DataFrame, types: DataFrame) -> DataFrame:
    """type, queries, p1, p5, r10: means over the queries of each type. types: query_id, type."""
    p1, p5, r10 = at_k(results, gold, 1), at_k(results, gold, 5), at_k(results, gold, 10)
    each = p1.select("query_id", F.col("p").alias("p1")).join(p5.select("query_id", F.col("p").alias("p5")), "query_id").join(r10.select("query_id", F.col("r").alias("r10")), "query_id")
    return each.join(types, "query_id").groupBy("type").agg(F.count(F.lit(1)).alias("queries"), *[F.round(F.avg(m), 6).alias(m) for m in ("p1", "p5", "r10")])


def wins(first: DataFrame, second: DataFrame) -> DataFrame:
    """first, second, ties: queries won by p, then by r; inputs: query_id, p, r. A null p loses to any."""
    joined = first.select("query_id", F.coalesce("p", F.lit(-1.0)).alias("p1"), F.col("r").alias("r1")).join(second.select("query_id", F.coalesce("p", F.lit(-1.0)).alias("p2"), F.col("r").alias("r2")), "query_id")
    won = (F.col("p1") > F.col("p2")) | ((F.col("p1") == F.col("p2")) & (F.col("r1") > F.col("r2")))
    lost = (F.col("p2") > F.col("p1")) | ((F.col("p1") == F.col("p2")) & (F.col("r2") > F.col("r1")))
    count = lambda c: F.count_if(c)
    return joined.agg(count(won).alias("first"), count(lost).alias("second"), count(~won & ~lost).alias("ties"))


def precision_recall(expected: DataFrame, extracted: DataFrame, keys: list[str], by: list[str]) -> DataFrame:
    """by, matched, false_positives, false_negatives, precision, recall of distinct keys; 0 where nothing was extracted or expected."""
    e = expected.select(*by, *keys, F.lit(1).alias("e")).distinct()
    x = extracted.select(*by, *keys, F.lit(1).alias("x")).distinct()
    both = e.join(x, [*by, *keys], "full_outer").groupBy(*by).agg(F.count_if(F.col("e").isNotNull() & F.col("x").isNotNull()).alias("matched"), F.count_if(F.col("e").isNull()).alias("false_positives"), F.count_if(F.col("x").isNull()).alias("false_negatives"))
    ratio = lambda rest: F.when(F.col("matched") + F.col(rest) > 0, F.col("matched") / (F.col("matched") + F.col(rest))).otherwise(F.lit(0.0))
    return both.select(*by, "matched", "false_positives", "false_negatives", ratio("false_positives").alias("precision"), ratio("false_negatives").alias("recall"))


def order_statistics(rows: DataFrame, by: str, value: str, percents: tuple[int, ...] = (50, 95, 99)) -> DataFrame:
    """by, n and one column p<percent> each: the value in place min(n - 1, floor(percent n / 100)) from 0. Equal values are counted before any window."""
    counted = rows.where(F.col(value).isNotNull()).groupBy(by, value).agg(F.count(F.lit(1)).alias("c"))
    upto = F.sum("c").over(Window.partitionBy(by).orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
    n = F.sum("c").over(Window.partitionBy(by))
    ranked = counted.select(by, value, "c", upto.alias("upto"), n.alias("n"))
    picks = []
    for p in percents:
        place = F.least(F.col("n") - 1, F.floor(F.col("n") * p / 100))
        picks.append(F.min(F.when(F.col("upto") > place, F.col(value))).alias(f"p{p}"))
    return ranked.groupBy(by).agg(F.max("n").alias("n"), *picks)
