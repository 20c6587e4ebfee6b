"""Document fingerprints: a canonical exact digest (DataFrame operations only).

The canonical text is case-folded under Unicode compatibility composition (NFKC before and after folding), with runs of white space folded to
one space and none at either end. Its fingerprint is LANES 64-bit xxhash values with different seeds, as hexadecimal digits. Texts are
grouped by it, edited ones too; where texts of a group differ by SHA-256, a suffix tells them apart. Inside each group of two or more rows the canonical
texts themselves are compared byte by byte, and must be alike where both digests are. An exact digest is alike or not: its likeness is 1 or 0.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import every_salt, materialise, salted

LANES, SALTS = 2, 16


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of value, which is computed once."""
    return F.transform(F.array(value), body)[0]


def canonical(text: Column) -> Column:
    """The canonical text of a string; null has ''."""
    composed = lambda x: F.call_function("java_method", F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), x, F.lit(True))
    folded = F.call_function("java_method", F.lit("com.ibm.icu.lang.UCharacter"), F.lit("foldCase"), composed(F.coalesce(text, F.lit(""))), F.lit(True))
    return F.trim(F.regexp_replace(composed(folded), r"(?U)\s+", " "))


def _digest(canon: Column, lanes: int, digits: int) -> Column:
    lane = lambda k: F.substring(F.lpad(F.hex(F.xxhash64(canon) if k == 0 else F.xxhash64(F.lit(k), canon)), 16, "0"), 1, digits)
    return F.lower(F.concat(*[lane(k) for k in range(lanes)]))


def digest(text: Column, lanes: int = LANES, digits: int = 16) -> Column:
    """Hexadecimal digest of the canonical text; digits are kept of each lane (fewer than 16 only to test collisions)."""
    return let(canonical(text), lambda c: _digest(c, lanes, digits))


def successors(ids: DataFrame) -> DataFrame:
    """doc_id, next_id in a ring: ascending doc_id, after the last the first. ids: one column of distinct values, not null.

    Ids are dealt to range partitions and ordered within each. The windows over partitions have one row a partition.
    """
    dealt = materialise(ids.repartitionByRange(F.col("doc_id")).withColumn("part", F.spark_partition_id()), "ring")
    firsts = dealt.groupBy("part").agg(F.min("doc_id").alias("first"))
    ring = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    firsts = firsts.select("part", F.coalesce(F.lead("first").over(Window.orderBy("part")), F.first("first").over(ring)).alias("after"))
    here = dealt.withColumn("next_id", F.lead("doc_id").over(Window.partitionBy("part").orderBy("doc_id")))
    return here.join(firsts, "part").select("doc_id", F.coalesce("next_id", "after").alias("next_id"))


def fingerprint_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lanes: int = LANES, digits: int = 16) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next for every row.

    A row's edited text has its last floor(n_chars / 4) code points replaced by the first as many (or all) of the next document by doc_id, after the last
    the first. Null texts are empty. Where rows share a doc_id, the next document is the one with the least digest. Rows without a doc_id stand
    outside the order: what is cut from them isn't replaced, and near_next is 0; their texts are told apart like any others, by SHA-256. An empty table
    gives an empty result. Other columns aren't read.
    """
    # An alias to the same name would stay in one branch of the plan only, and its shuffle of the texts would differ.
    key = F.col("doc_id") if id_col == "doc_id" else F.col(id_col).alias("doc_id")
    rows = docs.select(key, F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    mark = lambda text: _mark(text, lanes, digits)
    narrow = materialise(rows.select("doc_id", F.char_length("text").cast("long").alias("n"), mark(F.col("text")).alias("m")), "digests")
    keyed = narrow.where(F.col("doc_id").isNotNull())
    ids = keyed.groupBy("doc_id").agg(F.max("n").alias("n"), F.min("m").alias("m"), F.count(F.lit(1)).alias("rows"))
    ring = successors(ids.select("doc_id"))

    grouped = narrow.groupBy("m.digest").agg(F.count(F.lit(1)).alias("members")).where("members > 1").select("digest", every_salt(SALTS).alias("salt"))
    shared = keyed.select("doc_id", "m.digest", salted(F.col("doc_id"), SALTS).alias("salt")).join(grouped, ["digest", "salt"]).select(F.col("doc_id").alias("next_id"), F.lit(True).alias("shared")).distinct()
    before = ring.join(ids, "doc_id").select(F.col("doc_id").alias("for_id"), "next_id", F.floor(F.col("n") / 4).cast("int").alias("k"))
    plan = before.join(ids.select(F.col("doc_id").alias("next_id"), F.col("m").alias("after"), "rows"), "next_id").join(shared, "next_id", "left")
    plan = materialise(plan, "ring-plan")

    # Both joins compare null-safely, so that no filter on doc_id makes the shuffle of the texts differ between them: it runs once.
    with_plan = rows.join(plan.hint("shuffle_hash"), F.col("doc_id").eqNullSafe(F.col("next_id")))
    heads = with_plan.select("for_id", "after", F.substring("text", F.lit(1), F.col("k")).alias("head"))
    if not plan.where("rows > 1").isEmpty():
        least = with_plan.where(mark(F.col("text")) == F.col("after"))
        heads = least.groupBy("for_id", "after").agg(F.min(F.substring("text", F.lit(1), F.col("k"))).alias("head"))
    joined = rows.join(heads.hint("shuffle_hash"), F.col("doc_id").eqNullSafe(F.col("for_id")), "left")
    n = F.char_length("text")
    k = F.floor(n / 4).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - k), F.substring(F.coalesce("head", F.lit("")), F.lit(1), k))
    made = joined.select("doc_id", n.cast("long").alias("n_chars"), "after", mark(F.col("text")).alias("own"), edited.alias("edited"))
    made = made.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "own", mark(F.col("edited")).alias("changed"), "after", F.lit(False).alias("clash"))

    texts = with_plan.where("shared").select(mark(F.col("text")).alias("own"), canonical(F.col("text")).alias("canon")).distinct()
    clashes = texts.groupBy("own").agg(F.count(F.lit(1)).alias("texts")).where("texts > 1").select("own", F.lit(True).alias("clash"))
    made = materialise(made.unionByName(clashes, allowMissingColumns=True), "fingerprints")
    if not made.where("clash").isEmpty():
        raise ValueError("two canonical texts share all of xxhash64 and SHA-256")
    return _told_apart(made.drop("clash"))


def _mark(text: Column, lanes: int, digits: int) -> Column:
    """digest, and the SHA-256 of the same canonical text: what tells texts apart whose digests collide."""
    return let(canonical(text), lambda c: F.struct(_digest(c, lanes, digits).alias("digest"), F.sha2(c, 256).alias("sha")))


def _told_apart(made: DataFrame) -> DataFrame:
    """The columns of the result. A digest that several texts have, be they rows' own, edited or next ones, gets a suffix: the text's rank by SHA-256, but none for the first."""
    every = made.select(F.explode(F.array("own", "changed")).alias("m")).select("m.digest", "m.sha")
    # As numbers of 16 hexadecimal digits and less, whose least and greatest a hash aggregation keeps.
    part = {f"p{k}": F.conv(F.substring("sha", k, 13), 16, 10).cast("long") for k in range(1, 65, 13)}
    spread = every.groupBy("digest").agg(*[f(c).alias(f"{name}_{p}") for p, c in part.items() for name, f in (("least", F.min), ("most", F.max))])
    several = materialise(spread.where(reduce(Column.__or__, [F.col(f"least_{p}") != F.col(f"most_{p}") for p in part])).select("digest"), "clashes")
    names = {"own": "fingerprint", "changed": "edited_fingerprint", "after": "next_fingerprint"}
    if several.isEmpty():
        out = made.select("*", *[F.col(f"{m}.digest").alias(name) for m, name in names.items()])
    else:
        rank = F.row_number().over(Window.partitionBy("digest").orderBy("sha"))
        ranks = materialise(every.join(several, "digest", "left_semi").distinct().withColumn("rank", rank).where("rank > 1"), "ranks")
        out = made
        for m, name in names.items():
            own = ranks.select(F.struct("digest", "sha").alias(f"{m}_mark"), F.col("rank").alias(f"{m}_rank"))
            suffix = F.coalesce(F.concat(F.lit("-"), F.col(f"{m}_rank").cast("string")), F.lit(""))
            out = out.join(own, F.col(m) == F.col(f"{m}_mark"), "left").withColumn(name, F.concat(F.col(f"{m}.digest"), suffix))
    same = lambda a, b: F.coalesce((F.col(a) == F.col(b)).cast("double"), F.lit(0.0))
    likeness = same("fingerprint", "edited_fingerprint").alias("near_edited"), same("fingerprint", "next_fingerprint").alias("near_next")
    return out.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", *likeness)


def duplicate_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """doc_id, fingerprint, first_id: the least doc_id with that fingerprint, for every row."""
    marked = fingerprint_documents(docs, id_col, text_col, **options).select("doc_id", "fingerprint", salted(F.col("doc_id"), SALTS).alias("salt"))
    firsts = marked.groupBy("fingerprint").agg(F.min("doc_id").alias("first_id")).select("*", every_salt(SALTS).alias("salt"))
    return marked.join(firsts, ["fingerprint", "salt"]).select("doc_id", "fingerprint", "first_id")
