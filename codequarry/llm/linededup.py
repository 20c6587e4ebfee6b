"""Line dedup over content-defined chunks (DataFrame operations only).

A rolling hash over the hashes of WINDOW lines ends a chunk of lines wherever it is 0 modulo DIVISOR, so chunk boundaries move with the content and
an insertion shifts only those near it. Chunks of two or more lines that occur before, in the same document or in one with a smaller doc_id,
are removed. Chunks are grouped by their bytes (with a hash as the leading key); copies within a task collapse before the shuffle.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import every_salt, materialise, salted
from .fingerprints import let

#: Fixed values of the rolling hash over two lines: multiplier and prime modulus; a chunk has DIVISOR lines on average.
MULTIPLIER, PRIME, DIVISOR, SALTS = 1_000_003, 2_147_483_647, 4, 16


def _line_hash(line: Column) -> Column:
    return F.conv(F.substring(F.md5(line), 1, 7), 16, 10).cast("long")


def chunks(text: Column, divisor: int = DIVISOR) -> Column:
    """Array of (pos: first line from 0, n: lines, text) that covers all lines of text in order."""

    def cut(lines: Column, hashes: Column) -> Column:
        last = F.size(lines) - 1

        def ends(i: Column) -> Column:
            before = F.coalesce(F.get(hashes, i - 1), F.lit(0).cast("long"))
            return (i == last) | (((before * MULTIPLIER + F.get(hashes, i)) % PRIME) % divisor == 0)

        return F.filter(F.sequence(F.lit(0), last), ends)

    def pieces(lines: Column, ends: Column) -> Column:
        def piece(end: Column, k: Column) -> Column:
            start = F.when(k == 0, F.lit(0)).otherwise(F.get(ends, k - 1) + 1)
            return F.struct(start.alias("pos"), (end - start + 1).alias("n"), F.array_join(F.slice(lines, start + 1, end - start + 1), "\n").alias("text"))

        return F.transform(ends, piece)

    return let(F.split(text, "\n"), lambda lines: let(let(F.transform(lines, _line_hash), lambda h: cut(lines, h)), lambda ends: pieces(lines, ends)))


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, text, t (a digest of the text: rows of one doc_id, or of none, that have unlike texts are told apart by it)."""
    text = F.col(text_col).cast("string")
    return docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), F.unhex(F.md5(text)).alias("t"))


def _with_marks(rows: DataFrame, found: DataFrame) -> DataFrame:
    """rows with marks: the places (column pos) that found has for their doc_id and t."""
    marks = found.groupBy(F.col("doc_id").alias("for_id"), F.col("t").alias("for_t")).agg(F.collect_set("pos").alias("marks"))
    on = F.col("doc_id").eqNullSafe(F.col("for_id")) & (F.col("t") == F.col("for_t"))
    return rows.join(marks.hint("shuffle_hash"), on, "left").select("doc_id", "text", F.coalesce("marks", F.array().cast("array<int>")).alias("marks"))


def _again(sorted_: Column, same: Callable[[Column, Column], Column], apart: bool = False) -> Column:
    """Places (field k) of an array of structs, sorted by value and then k, whose value stands before. apart: but for the second of a value, right after the first."""

    def before(s: Column, i: Column) -> Column:
        one, two = F.get(sorted_, i - 1), F.get(sorted_, i - 2)
        again = F.coalesce(same(one, s), F.lit(False))
        return again & ~((s["k"] == one["k"] + 1) & ~F.coalesce(same(two, s), F.lit(False))) if apart else again

    return F.transform(F.filter(sorted_, before), lambda s: s["k"])


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", divisor: int = DIVISOR, hash_digits: int = 32) -> DataFrame:
    """doc_id, n_lines, n_removed, n_removed_chunks, text (what is left) for every row.

    The first occurrence, by doc_id and then line, stays. Rows that share a doc_id count as one document: none of them makes another's chunks repeats.
    A null text stays null with 0 lines; an empty text has one empty line. A document all of whose chunks go is left ''. Null doc_ids are one
    document that stands after all others. An empty table gives an empty result. Other columns aren't read. hash_digits below 32 only serve to test collisions.
    """
    rows = _texts(docs, id_col, text_col)
    own = rows.where(F.col("text").isNotNull()).select("doc_id", "t", F.posexplode(chunks(F.col("text"), divisor)).alias("pos", "c")).where("c.n > 1")
    several = own.select("doc_id", "t", "pos", F.substring(F.md5("c.text"), 1, hash_digits).alias("h"), F.col("c.text").alias("chunk"))
    classes = several.groupBy("h", "chunk").agg(F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("first_id"))
    classes = materialise(classes.groupBy("h").agg(F.count(F.lit(1)).alias("texts"), F.sum("copies").alias("copies"), F.min("first_id").alias("first_id")).where("copies > 1"), "chunk-classes")
    one = classes.where("texts = 1").select("h", "first_id", every_salt(SALTS).alias("salt"))
    where = several.select("doc_id", "t", "pos", "h", salted(F.struct("doc_id", "t", "pos"), SALTS).alias("salt"))
    repeats = where.join(one, ["h", "salt"]).select("doc_id", "t", "pos", "first_id")
    if not classes.where("texts > 1").isEmpty():
        mixed = several.join(classes.where("texts > 1").select("h"), "h", "left_semi")
        truth = mixed.groupBy("h", "chunk").agg(F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("first_id")).where("copies > 1")
        repeats = repeats.unionByName(mixed.join(truth, ["h", "chunk"]).select("doc_id", "t", "pos", "first_id"))
    joined = _with_marks(rows, repeats.where(~F.col("doc_id").eqNullSafe(F.col("first_id"))).select("doc_id", "t", "pos"))

    def judge(own: Column) -> Column:
        """The chunks, and the places of those that stay: those of one line, and those seen neither in an earlier document nor before in the row."""
        long = F.filter(F.transform(own, lambda c, k: F.struct(c["n"].alias("n"), c["text"].alias("text"), k.alias("k"))), lambda c: c["n"] > 1)
        again = let(F.array_sort(F.transform(long, lambda c: F.struct(c["text"].alias("text"), c["k"].alias("k")))), lambda s: _again(s, lambda a, b: a["text"] == b["text"]))
        return F.struct(own.alias("all"), F.array_except(F.sequence(F.lit(0), F.size(own) - 1), F.concat("marks", again)).alias("kept"))

    judged = joined.select("doc_id", "text", let(chunks(F.col("text"), divisor), judge).alias("c"))
    lines = lambda of: F.aggregate(of, F.lit(0), lambda s, c: s + c["n"]).cast("long")
    judged = judged.select("doc_id", "text", F.col("c.all").alias("all"), F.transform("c.kept", lambda k: F.get("c.all", k)).alias("kept"))
    blank = F.col("text").isNull()
    return judged.select(
        "doc_id",
        F.when(blank, F.lit(0)).otherwise(lines("all")).alias("n_lines"),
        F.when(blank, F.lit(0)).otherwise(lines("all") - lines("kept")).alias("n_removed"),
        F.when(blank, F.lit(0)).otherwise(F.size("all") - F.size("kept")).cast("long").alias("n_removed_chunks"),
        F.when(~blank, F.array_join(F.transform("kept", lambda c: c["text"]), "\n")).alias("text"),
    )


def dedup_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_lines, n_removed, text (what is left) for every row: every repeated passage of two or more lines goes whole, wherever chunks would end.

    Each two neighbouring lines are an anchor. Those that occur in a document with a smaller doc_id, or before in the same row without a line in
    common, are repeats, and neighbouring repeats make up a whole passage. Anchors are compared by two digests of their bytes, 192 bits together. The first
    occurrence of a line always stays. Nulls, empty texts and rows that share a doc_id are as in dedup_lines.
    """
    rows = _texts(docs, id_col, text_col)

    def anchors(lines: Column) -> Column:
        def anchor(i: Column) -> Column:
            return let(F.concat(F.get(lines, i), F.lit("\n"), F.get(lines, i + 1)), lambda t: F.base64(F.concat(F.unhex(F.md5(t)), F.unhex(F.lpad(F.hex(F.xxhash64(t)), 16, "0")))))

        return F.when(F.size(lines) > 1, F.transform(F.sequence(F.lit(0), F.greatest(F.size(lines) - 2, F.lit(0))), anchor)).otherwise(F.array().cast("array<string>"))

    # An anchor's place is that among the distinct anchors of its row, in order of their first occurrence.
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id").alias("place")
    pairs = rows.where(F.col("text").isNotNull()).select("doc_id", "t", F.posexplode(F.array_distinct(let(F.split("text", "\n"), anchors))).alias("pos", "h"))
    classes = pairs.groupBy("h").agg(F.count(F.lit(1)).alias("copies"), F.min(place).alias("first")).where("copies > 1").select("h", F.col("first.doc_id").alias("first_id"))
    classes = materialise(classes, "passage-classes").select("*", every_salt(SALTS).alias("salt"))
    where = pairs.withColumn("salt", salted(F.struct("doc_id", "t"), SALTS)).join(classes, ["h", "salt"]).where(~F.col("doc_id").eqNullSafe(F.col("first_id")))
    joined = _with_marks(rows, where.select("doc_id", "t", "pos"))

    def gone_anchors(hs: Column) -> Column:
        """Places of the anchors that are repeats."""

        def of(sorted_: Column) -> Column:
            firsts = F.array_sort(F.transform(F.filter(sorted_, lambda s, i: F.coalesce(F.get(sorted_, i - 1)["h"] != s["h"], F.lit(True))), lambda s: s["k"]))
            known = F.transform("marks", lambda m: F.get(firsts, m))
            # The second of two like anchors in a row stays only if the first does.
            return F.concat(known, F.filter(F.transform(known, lambda k: k + 1), lambda k: F.coalesce(F.get(hs, k) == F.get(hs, k - 1), F.lit(False))), _again(sorted_, lambda a, b: a["h"] == b["h"], apart=True))

        return let(F.array_sort(F.transform(hs, lambda h, k: F.struct(h.alias("h"), k.alias("k")))), of)

    def judge(lines: Column) -> Column:
        gone = let(let(anchors(lines), gone_anchors), lambda at: F.concat(at, F.transform(at, lambda k: k + 1)))
        return F.struct(lines.alias("all"), F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), gone).alias("kept"))

    judged = joined.select("doc_id", "text", let(F.split("text", "\n"), judge).alias("c"))
    blank = F.col("text").isNull()
    return judged.select(
        "doc_id",
        F.when(blank, F.lit(0)).otherwise(F.size("c.all")).cast("long").alias("n_lines"),
        F.when(blank, F.lit(0)).otherwise(F.size("c.all") - F.size("c.kept")).cast("long").alias("n_removed"),
        F.when(~blank, F.array_join(F.transform("c.kept", lambda k: F.get("c.all", k)), "\n")).alias("text"),
    )


#: The same removal in SQL, by lines and windows.
LINES_SQL = f"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents WHERE text IS NOT NULL),
h AS (SELECT *, CAST(('0x' || substr(md5(line), 1, 7)) AS BIGINT) AS h FROM l),
e AS (SELECT *, ((coalesce(lag(h) OVER (PARTITION BY doc_id ORDER BY i), 0) * {MULTIPLIER} + h) % {PRIME}) % {DIVISOR} = 0 AS is_end FROM h),
k AS (SELECT *, coalesce(sum(CASE WHEN is_end THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS k FROM e),
c AS (SELECT doc_id, k, count(*) AS n, string_agg(line, chr(10) ORDER BY i) AS chunk FROM k GROUP BY doc_id, k),
r AS (SELECT *, n > 1 AND row_number() OVER (PARTITION BY chunk, n > 1 ORDER BY doc_id, k) > 1 AS gone FROM c),
s AS (SELECT doc_id, CAST(sum(n) AS BIGINT) AS n_lines, CAST(sum(CASE WHEN gone THEN n ELSE 0 END) AS BIGINT) AS n_removed,
             CAST(sum(CASE WHEN gone THEN 1 ELSE 0 END) AS BIGINT) AS n_removed_chunks,
             coalesce(string_agg(chunk, chr(10) ORDER BY k) FILTER (WHERE NOT gone), '') AS text
      FROM r GROUP BY doc_id)
SELECT d.doc_id, coalesce(s.n_lines, 0) AS n_lines, coalesce(s.n_removed, 0) AS n_removed, coalesce(s.n_removed_chunks, 0) AS n_removed_chunks, s.text
FROM documents AS d LEFT JOIN s USING (doc_id)
"""
