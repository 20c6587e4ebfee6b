"""Benchmark decontamination by size-partitioned MinHash containment.

An item is contained in a document if at least THRESHOLD of its distinct five-word shingles are among the document's. Similarity of a
short item to a long document is near 0, so signatures of whole documents can't find it; sketches that keep all shingles below a bound can. One
hash function orders all shingles. Items are partitioned by the number of their shingles. The sketch of an item of n shingles is its
n - need(n) + 1 least hashes, need(n) being the shared shingles that containment asks of n; the greatest hash of a partition's sketches is the partition's
bound. The sketch of a document in a partition is all its shingles' hashes up to that bound; documents too small to contain any item of a partition have none
there. A document that contains an item misses fewer of its shingles than the item's sketch has, so the two sketches share a hash:
no contained item is missed. Documents and items that share one are candidates, which exact containment of the shingles themselves verifies.

Items come to the executors in blocks of at most BLOCK_CHARS code points (a longer item is a block of its own). Each block is one pass over the documents; where
there are several, a block is built when its pass runs and given back after it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ._common import kind, materialise
from ._words import slices, word_hashes

WORDS, THRESHOLD, BLOCK_CHARS = 5, 0.8, 16_000_000
_WORD, _ODD, _SLOT_BITS = re.compile(r"[^\W_]+"), np.uint64(0x9E3779B97F4A7C15), 20
Shingle = tuple[str, ...]


def words_of(text: str | None) -> list[str]:
    """Maximal runs of letters and digits of the lower-cased text."""
    return _WORD.findall((text or "").lower())


def shingles_of(words: list[str], k: int = WORDS) -> set[Shingle]:
    """Distinct shingles of k words; of fewer words, the whole sequence; of none, no shingle."""
    if len(words) < k:
        return {tuple(words)} if words else set()
    return set(zip(*[words[i:] for i in range(k)], strict=False))


def need(n: int, threshold: float = THRESHOLD) -> int:
    """The least number of shared shingles out of n that reaches the threshold."""
    return max(1, -int(-(n * threshold - 1e-9) // 1))


def _mixed(sums: np.ndarray) -> np.ndarray:
    sums = (sums ^ (sums >> np.uint64(31))) * _ODD
    return sums ^ (sums >> np.uint64(29))


def _shingle_hashes(words: np.ndarray) -> np.ndarray:
    """A hash of every WORDS neighbouring word hashes."""
    n = max(0, len(words) - WORDS + 1)
    sums = np.zeros(n, dtype=np.uint64)
    for k in range(WORDS):
        sums = (sums + words[k : k + n]) * _ODD
    return _mixed(sums)


class Partition:
    """The sketches of the items of one size class: sorted hashes and the item of each, the bound, and the fewest shingles a document must have."""

    def __init__(self, pairs: list[tuple[int, np.ndarray]], needs: list[int]) -> None:
        hashes, items = np.concatenate([h for _, h in pairs]), np.repeat([i for i, _ in pairs], [len(h) for _, h in pairs]).astype(np.int32)
        order = np.argsort(hashes, kind="stable")
        self.hashes, self.items, self.least = hashes[order], items[order], min(needs)
        self.bound = self.hashes[-1]
        self.slots = np.zeros(1 << _SLOT_BITS, dtype=bool)
        self.slots[(self.hashes >> np.uint64(64 - _SLOT_BITS)).astype(np.int64)] = True

    def shared(self, sketch: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places in sketch, items) of all pairs of equal hashes."""
        at = np.nonzero(self.slots[(sketch >> np.uint64(64 - _SLOT_BITS)).astype(np.int64)])[0]
        low, high = np.searchsorted(self.hashes, sketch[at], "left"), np.searchsorted(self.hashes, sketch[at], "right")
        n = high - low
        return np.repeat(at, n), self.items[np.repeat(low - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]


class Index:
    """Sketches of a block of items, and the texts to verify by. Its size is a few bytes a code point of the items."""

    def __init__(self, items: list[tuple[object, str]], threshold: float) -> None:
        self.items, self.threshold = items, threshold
        self.short: dict[Shingle, list[int]] = {}  # items of fewer words than a shingle, by all their words
        words, counts = word_hashes(pa.array([t for _, t in items], pa.string()), _WORD, lower=True)
        by_size: dict[int, list[tuple[int, np.ndarray]]] = {}
        needs: dict[int, list[int]] = {}
        for i, (end, n) in enumerate(zip(np.cumsum(counts).tolist(), counts.tolist(), strict=True)):
            if n < WORDS:
                if n:
                    self.short.setdefault(tuple(words_of(items[i][1])), []).append(i)
                continue
            hashes = np.unique(_shingle_hashes(words[end - n : end]))
            asked = need(len(hashes), threshold)
            by_size.setdefault(len(hashes).bit_length(), []).append((i, hashes[: len(hashes) - asked + 1]))
            needs.setdefault(len(hashes).bit_length(), []).append(asked)
        self.partitions = [Partition(pairs, needs[size]) for size, pairs in sorted(by_size.items())]

    def candidates(self, sums: np.ndarray, ends: np.ndarray, counts: np.ndarray) -> set[tuple[int, int]]:
        """(text, item) that share a hash of their sketches. sums: hashes of every five words of all texts in a row; ends, counts: where a text's words end and how many they are."""
        found: set[tuple[int, int]] = set()
        for part in self.partitions:
            at = np.nonzero(sums <= part.bound)[0]
            place, item = part.shared(sums[at])
            place = at[place]
            text = np.searchsorted(ends, place, side="right")
            good = (place + WORDS <= ends[text]) & (counts[text] - WORDS + 1 >= part.least)
            found.update(zip(text[good].tolist(), item[good].tolist(), strict=True))
        return found

    def found(self, texts: pa.Array) -> Iterator[tuple[int, object, int, int]]:
        """Place of the text, key, shingles and shared shingles of each contained item."""
        h, counts = word_hashes(texts, _WORD, lower=True)
        sums, ends = _shingle_hashes(h), np.cumsum(counts)
        pairs = self.candidates(sums, ends, counts)
        if self.short:
            for k in np.nonzero((counts > 0) & (counts < WORDS))[0].tolist():
                pairs.update((k, i) for i in self.short.get(tuple(words_of(texts[k].as_py())), ()))
        last, words, own = None, [], sums[:0]
        for k, i in sorted(pairs):
            if k != last:
                last, words = k, words_of(texts[k].as_py())
                own = sums[ends[k] - counts[k] : max(ends[k] - counts[k], ends[k] - WORDS + 1)]
            key, text = self.items[i]
            s = shingles_of(words_of(text))
            # Only places whose hash is one of the item's can hold one of its shingles.
            item = np.array([xxhash.xxh64_intdigest(w) for x in s for w in x], dtype=np.uint64)
            hashes = _shingle_hashes(item)[::WORDS] if len(words) >= WORDS else None
            here = {tuple(words)} if hashes is None else {tuple(words[p : p + WORDS]) for p in np.nonzero(np.isin(own, hashes))[0].tolist()}
            if (shared := len(s & here)) >= need(len(s), self.threshold):
                yield k, key, len(s), shared

    def search(self, text: str | None) -> Iterator[tuple[object, int, int]]:
        """Key, shingles and shared shingles of each item that one text contains."""
        for _, *row in self.found(pa.array([text], pa.string())):
            yield tuple(row)


def _blocks(items: Iterator[tuple[object, str]], most: int) -> Iterator[list[tuple[object, str]]]:
    block, size = [], 0
    for key, text in items:
        if block and size + len(text) > most:
            yield block
            block, size = [], 0
        block.append((key, text))
        size += len(text)
    if block:
        yield block


def contained(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, item_id, n_shingles, shared, containment: one row for each row of docs and contained item.

    Null and empty texts contain nothing and are contained nowhere. An item of fewer than five words has one shingle, all of it, and is contained
    in documents of just those words. Repeated rows of either table repeat their pairs. Empty tables give an empty result. Other columns aren't read.
    """
    if not 0 < threshold <= 1:
        raise ValueError("threshold must be above 0 and at most 1")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    tests = items.select(F.col(item_col).alias("item_id"), F.col(item_text_col).cast("string").alias("text")).where(F.length("text") > 0)
    schema = f"doc_id {kind(rows, 'doc_id')}, item_id {kind(tests, 'item_id')}, n_shingles long, shared long, containment double"
    ids = [to_arrow_type(df.schema[c].dataType) for df, c in ((rows, "doc_id"), (tests, "item_id"))]
    arrow = pa.schema([("doc_id", ids[0]), ("item_id", ids[1]), ("n_shingles", pa.int64()), ("shared", pa.int64()), ("containment", pa.float64())])

    def searched(index: Broadcast) -> DataFrame:
        def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in slices(parts):
                out = [(part["doc_id"][k].as_py(), key, n, shared, shared / n) for k, key, n, shared in index.value.found(part["text"].chunk(0))]
                yield pa.RecordBatch.from_arrays([pa.array(column, type=t) for column, t in zip(zip(*out, strict=True) if out else [()] * 5, arrow.types, strict=True)], schema=arrow)

        return rows.mapInArrow(batches, schema)

    blocks = _blocks(((r["item_id"], r["text"]) for r in tests.toLocalIterator()), BLOCK_CHARS)
    block, after = next(blocks, []), next(blocks, None)
    if after is None:
        return searched(docs.sparkSession.sparkContext.broadcast(Index(block, threshold)))
    passes = []
    while block:
        index = docs.sparkSession.sparkContext.broadcast(Index(block, threshold))
        passes.append(materialise(searched(index), "contained"))
        index.destroy()
        block, after = after, next(blocks, None)
    return reduce(DataFrame.union, passes)


def clean(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of docs whose text contains no item. Columns as in docs.

    The key of a row covers its doc_id and its text, so rows without a doc_id, or with the doc_id of an unlike text, are judged each by its own text.
    """
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.concat_ws(":", F.col(id_col).cast("string"), F.md5(F.col(text_col).cast("string"))).alias("key"))
    found = contained(keyed.select("key", F.col(f"row.`{text_col}`").alias("text")), items, "key", "text", **options).select("doc_id").distinct()
    return keyed.alias("d").join(found.alias("f"), F.col("d.key") == F.col("f.doc_id"), "left_anti").select("row.*")


#: Containment by brute force in SQL.
CONTAINED_SQL = """
WITH d AS (SELECT doc_id AS id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS w FROM documents),
i AS (SELECT item_id AS id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS w FROM benchmark),
ds AS (SELECT DISTINCT id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda k: array_to_string(w[k:k + 4], ' '))
                                       WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM d),
s AS (SELECT DISTINCT id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda k: array_to_string(w[k:k + 4], ' '))
                                      WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM i),
n AS (SELECT id, count(*) AS n FROM s GROUP BY id),
x AS (SELECT ds.id AS doc_id, s.id AS item_id, count(*) AS shared FROM ds JOIN s ON ds.s = s.s GROUP BY ds.id, s.id)
SELECT x.doc_id, x.item_id, n.n AS n_shingles, x.shared, x.shared::DOUBLE / n.n AS containment
FROM x JOIN n ON n.id = x.item_id WHERE x.shared * 10 >= n.n * 8
"""
