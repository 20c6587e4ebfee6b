"""Mixing sources to target token counts by entropy balancing (DataFrame operations only).

Among all document rates r, the mix minimises sum(size * (r log r - r)), the relative entropy of the token measure,
subject to sum(size * r) = target for each source. Its convex dual has one multiplier per source, and the optimal rates
are tilts exp(lambda) of the documents' base rate 1. Newton's method solves the dual: gradient and Hessian need only the
token sums that one distributed aggregation yields, so every iteration runs on a table of one row per source.

Rates are rounded to whole copies by systematic sampling: in each source, documents stand in order of falling size, and the
i-th gets floor(r) + floor(i f + 1/2) - floor((i-1) f + 1/2) copies, f being the fraction of r. Neighbours have like sizes,
so a source's error stays within about half its largest document. Ranks come from counts per cell
(source, size class, hash bucket), so no task holds a whole source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import ROW_KEYS, WORD, hash_bucket, materialise, rows_with_keys, same_row

#: Words that share a size class, hash buckets in a class, Newton steps; buckets of rows that share a doc_id, copies that are made at a time.
CLASS_WIDTH, BUCKETS, NEWTON_STEPS, MANY_BUCKETS, STEP = 16, 64, 80, 4096, 10_000


def word_count(text: Column) -> Column:
    """Number of words; null counts 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3) -> DataFrame:
    """skey, source_size, target: water filling of all words by weight, under caps of most times a source's words.

    sizes: skey (any orderable, 'n' last), size. The windows without partitions hold one row per source.
    """
    by_source = sizes.groupBy("skey").agg(F.sum("size").alias("source_size"))
    ranked = by_source.withColumn("k", F.row_number().over(Window.orderBy(F.col("skey") == "n", "skey")))
    w = F.element_at(F.array(*[F.lit(x) for x in weights]), ((F.col("k") - 1) % len(weights) + 1).cast("int"))
    whole = Window.orderBy("ratio", "skey").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = Window.orderBy("ratio", "skey").rowsBetween(Window.unboundedPreceding, -1)
    t = ranked.withColumn("w", w.cast("long")).withColumn("cap", F.col("source_size") * most).withColumn("ratio", F.col("cap").cast("double") / F.col("w"))
    left = F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(before), F.lit(0))
    t = t.withColumn("level", left.cast("double") / (F.sum("w").over(whole) - F.coalesce(F.sum("w").over(before), F.lit(0))))
    t = t.withColumn("level", F.first(F.when(F.col("ratio") >= F.col("level"), F.col("level")), ignorenulls=True).over(whole))
    return t.select("skey", "source_size", F.least(F.col("cap").cast("double"), F.col("level") * F.col("w")).alias("target"))


def newton_multiplier(size: Column, target: Column, steps: int = NEWTON_STEPS) -> Column:
    """Minimises size * exp(x) - target * x by Newton's method from 0; needs size and target above 0."""
    def step(x: Column, _: Column) -> Column:
        g = size * F.exp(x) - target
        return x - F.greatest(F.least(g / (size * F.exp(x)), F.lit(2.0)), F.lit(-2.0))

    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), F.lit(0.0), step)


def entropy_mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = (1, 2, 3), most: int = 3) -> DataFrame:
    """doc_id, size, source_size, target, rate, copies, taken for every row of docs.

    Null texts have size 0 and are taken 0 words; null sources form one source, the last. A source without words has
    target 0, rate 0. Repeated rows and ties each keep a row. An empty table gives an empty result. Other columns of docs are not read.
    """
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        F.coalesce(F.concat(F.lit("a"), F.col(source_col).cast("string")), F.lit("n")).alias("skey"),
        word_count(F.col(text_col)).alias("size"),
    )
    rows = rows.select("*", F.floor(F.col("size") / CLASS_WIDTH).cast("long").alias("cls"), hash_bucket(F.col("doc_id"), BUCKETS).alias("hb"))
    rows = materialise(rows, "mix-sizes")
    targets = source_targets(rows.select("skey", "size"), weights, most)
    positive = (F.col("source_size") > 0) & (F.col("target") > 0)
    size = F.col("source_size").cast("double")
    rate = F.when(positive, F.round(F.least(F.exp(newton_multiplier(size, F.col("target"))), F.lit(float(most))), 9)).otherwise(F.lit(0.0))
    targets = targets.withColumn("rate", rate)

    cells = rows.groupBy("skey", "cls", "hb", "size").agg(F.count(F.lit(1)).alias("n"))
    classes = cells.groupBy("skey", "cls").agg(F.sum("n").alias("n_cls"))
    earlier = lambda *keys, by: Window.partitionBy(*keys).orderBy(by).rowsBetween(Window.unboundedPreceding, -1)
    classes = classes.select("skey", "cls", F.coalesce(F.sum("n_cls").over(earlier("skey", by=F.col("cls").desc())), F.lit(0)).alias("cls_from"))
    in_class = F.coalesce(F.sum("n").over(Window.partitionBy("skey", "cls").orderBy("hb", F.col("size").desc()).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cells = cells.withColumn("cell_from", in_class).join(classes, ["skey", "cls"]).join(targets, "skey")
    cells = cells.select("skey", "cls", "hb", "size", (F.col("cls_from") + F.col("cell_from")).alias("from"), "source_size", "target", "rate")

    in_cell = Window.partitionBy("skey", "cls", "hb", "size").orderBy(F.col("doc_id").asc_nulls_first())
    ranked = rows.withColumn("i", F.row_number().over(in_cell)).join(cells, ["skey", "cls", "hb", "size"])
    i, whole = F.col("i") + F.col("from"), F.floor("rate")
    part = F.col("rate") - whole
    copies = whole + F.floor(i * part + 0.5) - F.floor((i - 1) * part + 0.5)
    ranked = ranked.withColumn("copies", F.least(copies, F.lit(most)).cast("long"))
    return ranked.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies", "rate")


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """docs with each row repeated by its copies; rows with none are left out. Columns as in docs, whatever their names.

    Rows that share a doc_id, or have none, share the copies of all of them evenly: c copies over n rows are c // n each, and one more for the first c % n by
    digest of the text and hash of the other columns. So the copies add up to those of entropy_mix.
    """
    mix = entropy_mix(docs, id_col, text_col, **options).groupBy(F.col("doc_id").alias("_id")).agg(F.sum("copies").alias("c"), F.count(F.lit(1)).alias("n"))
    mix = materialise(mix, "mix-copies")
    each = F.floor(F.col("m.c") / F.col("m.n")).cast("int")
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(id_col).alias("_id")).alias("k")
    out = whole.join(mix.where("c >= n").alias("m"), same_row("k", "m", ("_id",))).select("row", F.explode(F.sequence(F.lit(1), each)).alias("copy"))
    left = mix.where("c % n > 0").select("_id", (F.col("c") % F.col("n")).alias("more"))
    if not left.isEmpty():
        out = out.unionByName(_first_rows(rows_with_keys(docs, id_col, text_col), left))
    return out.select("row.*")


def _first_rows(keyed: DataFrame, left: DataFrame) -> DataFrame:
    """row, copy: the first `more` rows of each id of left, by digest and rest. Rows are counted by cell (id, bucket of digest and rest) and key, so that no task holds an id;
    of rows that are alike in all columns, one stands for those taken, where not all are."""
    bucket = F.pmod(F.xxhash64("_digest", "_rest"), F.lit(MANY_BUCKETS)).alias("b")
    keys = keyed.alias("k").join(left.alias("m"), same_row("k", "m", ("_id",))).groupBy("k._id", "k._digest", "k._rest", "m.more").agg(F.count(F.lit(1)).alias("n"))
    keys = materialise(keys.select("*", bucket), "mix-shared-ids")
    earlier = lambda *by: Window.partitionBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    cells = keys.groupBy("_id", "b").agg(F.sum("n").alias("n_cell")).withColumn("before", F.coalesce(F.sum("n_cell").over(earlier("_id").orderBy("b")), F.lit(0)))
    inside = F.coalesce(F.sum("n").over(earlier("_id", "b").orderBy("_digest", "_rest")), F.lit(0))
    placed = keys.withColumn("inside", inside).alias("k").join(cells.alias("c"), same_row("k", "c", ("_id", "b")))
    take = F.greatest(F.least(F.col("more") - F.col("before") - F.col("inside"), F.col("n")), F.lit(0)).alias("take")
    taken = materialise(placed.select(*[f"k.{k}" for k in ROW_KEYS], "n", take).where("take > 0"), "mix-first-rows")
    rows = keyed.alias("k").join(taken.alias("t"), same_row("k", "t")).select("row", *[f"k.{k}" for k in ROW_KEYS], "n", "take")
    every = rows.where("take = n").select("row", F.lit(1).alias("copy"))
    some = rows.where("take < n").dropDuplicates([*ROW_KEYS]) if not taken.where("take < n").isEmpty() else None
    if some is None:
        return every
    parts = some.select("row", F.explode(F.sequence(F.lit(0).cast("long"), F.col("take") - 1, F.lit(STEP).cast("long"))).alias("at"), "take")
    return every.unionByName(parts.select("row", F.explode(F.sequence(F.lit(1), F.least(F.col("take") - F.col("at"), F.lit(STEP)).cast("int"))).alias("copy")))


#: The same mix in SQL: a source's optimal rate is target / source_size, the fixed point of the Newton iterations.
MIX_SQL = """
WITH d AS (
  SELECT doc_id, coalesce('a' || source, 'n') AS skey,
         CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size,
         CAST(('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 7)) AS BIGINT) % 64 AS hb
  FROM documents),
s AS (SELECT skey, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY skey),
k AS (SELECT *, (row_number() OVER (ORDER BY skey = 'n', skey) - 1) % 3 + 1 AS w FROM s),
r AS (SELECT *, 3 * source_size AS cap, (3 * source_size)::DOUBLE / w AS ratio FROM k),
l AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY ratio, skey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
             / (sum(w) OVER () - coalesce(sum(w) OVER (ORDER BY ratio, skey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE AS level FROM r),
t AS (SELECT skey, w, source_size, cap, (SELECT arg_min(level, ratio) FROM l AS x WHERE x.ratio >= x.level) AS level FROM l),
g AS (SELECT skey, source_size, least(cap::DOUBLE, level * w) AS target FROM t),
q AS (SELECT *, CASE WHEN source_size > 0 THEN round(least(target / source_size, 3.0), 9) ELSE 0.0 END AS rate FROM g),
i AS (SELECT d.doc_id, d.size, q.source_size, q.target, q.rate,
             row_number() OVER (PARTITION BY d.skey ORDER BY d.size // 16 DESC, d.hb, d.size DESC, d.doc_id) AS i
      FROM d JOIN q USING (skey)),
c AS (SELECT *, least(floor(rate) + floor(i * (rate - floor(rate)) + 0.5) - floor((i - 1) * (rate - floor(rate)) + 0.5), 3)::BIGINT AS copies FROM i)
SELECT doc_id, size, source_size, target, copies * size AS taken, copies, rate FROM c
"""
