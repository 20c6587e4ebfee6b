"""Text functions over columns: tokens, character n-grams, line chunks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

CHUNK_WORDS = 300


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of value, which is computed once."""
    return F.transform(F.array(value), body)[0]


def tokens(text: Column) -> Column:
    """Lower-case runs of ASCII letters and digits of two or more, camelCase split first."""
    split = F.lower(F.regexp_replace(text, "([a-z0-9])([A-Z])", "$1 $2"))
    return F.filter(F.split(F.regexp_replace(split, r"[^a-z0-9\s]", " "), r"\s+"), lambda t: F.length(t) > 1)


def ngrams(text: Column, n: int = 3) -> Column:
    """Character n-grams of the ASCII letters and digits of the lower-cased text, across words, with repeats."""
    kept = F.regexp_replace(F.lower(text), "[^a-z0-9]", "")
    return F.regexp_extract_all(kept, F.lit(f"(?=(.{{{n}}}))"), 1)


def line_words(line: Column) -> Column:
    """Words of a line between white space; a blank line has 1."""
    return F.size(F.split(F.regexp_replace(line, r"^\s+|\s+$", ""), r"\s+"))


def line_chunks(text: Column, words: int = CHUNK_WORDS) -> Column:
    """Array of (start_line, end_line, text): lines gathered until they have `words` words, then afresh; the last chunk may have fewer."""

    def ends(lines: Column) -> Column:
        last = F.size(lines) - 1
        counted = F.transform(lines, lambda line, i: F.struct(i.alias("i"), line_words(line).alias("w"), (i == last).alias("last")))
        start = F.struct(F.lit(0).alias("sum"), F.array().cast("array<int>").alias("ends"))

        def step(s: Column, x: Column) -> Column:
            full = (s["sum"] + x["w"] >= words) | x["last"]
            return F.struct(F.when(full, F.lit(0)).otherwise(s["sum"] + x["w"]).alias("sum"), F.when(full, F.array_append(s["ends"], x["i"])).otherwise(s["ends"]).alias("ends"))

        return F.aggregate(counted, start, step, lambda s: s["ends"])

    def pieces(lines: Column, at: Column) -> Column:
        def piece(end: Column, k: Column) -> Column:
            first = F.when(k == 0, F.lit(0)).otherwise(F.get(at, k - 1) + 1)
            return F.struct((first + 1).alias("start_line"), (end + 1).alias("end_line"), F.array_join(F.slice(lines, first + 1, end - first + 1), "\n").alias("text"))

        return F.transform(at, piece)

    return let(F.split(text, "\n"), lambda lines: let(ends(lines), lambda at: pieces(lines, at)))
