"""Functions that classify source files and digest their content."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Languages by extension, directories left out of a repository, the largest content that is digested, bytes looked at for a NUL.
LANGUAGES = {"typescript": (".ts", ".tsx"), "javascript": (".js", ".jsx")}
LEFT_OUT = ("node_modules", "dist", "build", "coverage", "vendor", "out", "target", "tmp", ".git", ".cache")
LARGEST_DIGESTED, BINARY_PREFIX = 1_048_576, 512
TEST_FILE = r"\.(test|spec)\.(js|ts|jsx|tsx)$|/(test|spec)/"


def language(path: Column) -> Column:
    found = F.when(F.lit(False), F.lit("unknown"))
    for name, ends in LANGUAGES.items():
        for end in ends:
            found = found.when(path.endswith(end), F.lit(name))
    return found.otherwise(F.lit("unknown"))


def is_test(path: Column) -> Column:
    return path.rlike(TEST_FILE)


def test_framework(content: Column) -> Column:
    return F.when(content.contains("jest") | content.contains("describe"), "jest").when(content.contains("mocha"), "mocha").when(content.contains("vitest"), "vitest").otherwise("unknown")


def is_binary(content: Column) -> Column:
    """A NUL among the first bytes. content: binary."""
    return F.locate("00", F.regexp_replace(F.hex(F.substring(content, 1, BINARY_PREFIX)), "(..)", "$1 ")) > 0


def left_out(path: Column) -> Column:
    return F.arrays_overlap(F.split(path, "/"), F.array(*[F.lit(d) for d in LEFT_OUT]))


def capped_sha256(content: Column) -> Column:
    """Digest of content of at most a mebibyte; else ''. content: binary."""
    return F.when(F.octet_length(content) <= LARGEST_DIGESTED, F.sha2(content, 256)).otherwise(F.lit(""))


def hash32(text: Column) -> Column:
    """Hexadecimal absolute value of the 32-bit rolling hash 31 h + unit over the UTF-16 units of text."""

    def step(h: Column, unit: Column) -> Column:
        return F.pmod(h * 31 + unit + 2147483648, F.lit(4294967296)) - 2147483648

    def each(h: Column, char: Column) -> Column:
        point = F.ascii(char).cast("long")
        high, low = F.lit(0xD800) + F.floor((point - 65536) / 1024), F.lit(0xDC00) + (point - 65536) % 1024
        return F.when(point < 65536, step(h, point)).otherwise(step(step(h, high.cast("long")), low))

    chars = F.filter(F.split(text, ""), lambda c: c != "")
    return F.lower(F.hex(F.abs(F.aggregate(chars, F.lit(0).cast("long"), each))))
