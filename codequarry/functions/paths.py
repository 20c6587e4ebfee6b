"""Posix paths and import specifiers as column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Extensions in the order in which a specifier without one tries them.
EXTENSIONS = (".ts", ".tsx", ".js", ".jsx")


def normalise(path: Column) -> Column:
    """Backslashes as slashes, `.` and inner `..` resolved; a leading `..` stays."""

    def step(done: Column, part: Column) -> Column:
        up = (part == "..") & (F.size(done) > 0) & (F.element_at(done, -1) != "..")
        return F.when(part.isin("", "."), done).when(up, F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(F.array_append(done, part))

    slashed = F.replace(path, F.lit("\\"), F.lit("/"))
    joined = F.array_join(F.aggregate(F.split(slashed, "/"), F.array().cast("array<string>"), step), "/")
    return F.concat(F.when(slashed.startswith("/"), "/").otherwise(""), joined)


def directory(path: Column) -> Column:
    return F.regexp_extract(path, "^(.*)/[^/]*$", 1)


def extension(path: Column) -> Column:
    """From the last dot of the last part, unless that dot is its first sign."""
    return F.regexp_extract(path, r"[^/](\.[^./]*)$", 1)


def candidates(specifier: Column, from_path: Column) -> Column:
    """Paths that a relative or absolute specifier can mean, in order; an empty array for a package."""
    base = F.when(specifier.startswith("/"), normalise(specifier)).otherwise(normalise(F.concat_ws("/", F.nullif(directory(from_path), F.lit("")), specifier)))
    end = extension(base)
    stem = lambda n: F.substring(base, F.lit(1), F.length(base) - n)
    bare = F.array(*[F.concat(base, F.lit(e)) for e in EXTENSIONS], *[F.concat(base, F.lit("/index" + e)) for e in EXTENSIONS])
    mapped = F.when(end == ".js", F.array(base, F.concat(stem(3), F.lit(".ts")), F.concat(stem(3), F.lit(".tsx")))).when(end.isin(".mjs", ".cjs"), F.array(base, F.concat(stem(4), F.lit(".ts")))).otherwise(F.array(base))
    inside = specifier.startswith("./") | specifier.startswith("../") | specifier.startswith("/")
    return F.when(inside, F.when(end == "", bare).otherwise(mapped)).otherwise(F.array().cast("array<string>"))
