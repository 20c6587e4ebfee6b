"""SimHash near-duplicate search by anchor-point covering.

Anchors are the codewords of the [31,26] Hamming code, applied to bits 0-30 and to bits 32-62 of a fingerprint. The code is
perfect: each 31-bit word lies within radius 1 of exactly one codeword. Fingerprints that differ in at most 3 bits differ in at
most 1 bit of one half, so within that half both lie within radius 1 + 1 = 2 of the anchor nearest to either. Each
fingerprint stands once at its nearest anchor and is replicated to every anchor within radius 2 (1 or 16 of 2^26 a half); pairs are
compared anchor by anchor. No link is missed. Only distinct fingerprints take part, so exact copies add no pairs.

The test for at most 3 bits is part of the join's condition, so only true links leave it; a cell crowded by a cluster of near copies
is split over tasks by the adaptive join, both of whose sides are plain shuffles.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from codequarry.operators.components import connected_components

from ._common import ROW_KEYS, every_salt, kind, map_texts, materialise, rows_with_keys, salted, same_row
from ._words import slices, word_hashes

WORDS, SEED, RADIUS = 3, 42, 3
_BLOCK = 1 << 15
#: For the rows that keep_first joins beyond SimHash links: words of a shingle, least Jaccard similarity, bands of a MinHash signature and values of a band.
SHINGLE, LIKENESS, BANDS, ROWS = 5, 0.8, 40, 5
_WORD, _ODD, _TOGETHER = re.compile(r"[^\W_]+"), np.uint64(0x9E3779B97F4A7C15), 512
_SHIFTS, _FACTORS = np.random.default_rng(SEED).integers(0, 1 << 32, (2, BANDS * ROWS), dtype=np.uint32)
_FACTORS |= np.uint32(1)
#: Positions 1 to 31 whose k-th bit is set, as a mask over bits 0 to 30: the parity checks of the Hamming code.
CHECKS = [sum(1 << (p - 1) for p in range(1, 32) if p >> k & 1) for k in range(5)]


def fingerprint(text: str | None, words: int = WORDS) -> int:
    """64-bit fingerprint, unsigned. Null and texts without words have 0."""
    w = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not w:
        return 0
    if len(w) < words:
        shingles: Iterator[bytes] = iter([b" ".join(w)])
        n = 1
    else:
        shingles, n = map(b" ".join, zip(*[w[k:] for k in range(words)], strict=False)), len(w) - words + 1
    counts, done = np.zeros(64, dtype=np.int64), 0
    digest = xxhash.xxh64_intdigest
    while done < n:
        k = min(_BLOCK, n - done)
        h = np.fromiter((digest(s, SEED) for _, s in zip(range(k), shingles, strict=False)), dtype="<u8", count=k)
        counts += np.unpackbits(h.view(np.uint8).reshape(k, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        done += k
    return int(np.packbits((2 * counts > n).astype(np.uint8), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS) -> DataFrame:
    """doc_id, fp (the 64 bits as a signed long) for every row."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def signed(text: str | None) -> tuple[int]:
        fp = fingerprint(text, words)
        return (fp - (fp >> 63 << 64),)

    return map_texts(rows, lambda: signed, "fp long")


def _syndrome(v: Column) -> Column:
    """0 for a codeword, else the position (from 1) of the bit whose flip gives the nearest codeword."""
    return sum(((F.bit_count(v.bitwiseAND(F.lit(m))) % 2) * (1 << k) for k, m in enumerate(CHECKS[1:], 1)), F.bit_count(v.bitwiseAND(F.lit(CHECKS[0]))) % 2).cast("int")


def _flip(v: Column, position: Column) -> Column:
    return v.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), (position - 1).cast("int")))


def _points(fps: DataFrame) -> DataFrame:
    """fp, half, v (its 31 bits), s (their syndrome)."""
    low = (1 << 31) - 1
    halves = F.array(F.struct(F.lit(0).alias("half"), F.col("fp").bitwiseAND(F.lit(low)).alias("v")), F.struct(F.lit(1).alias("half"), F.shiftright("fp", 32).bitwiseAND(F.lit(low)).alias("v")))
    return fps.select("fp", F.explode(halves).alias("p")).select("fp", "p.half", "p.v", _syndrome(F.col("p.v")).alias("s"))


def links(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """a, b (a < b): every pair of distinct fingerprints at distance radius (at most 3) or less. fps: one distinct column fp."""
    if not 0 <= radius <= 3:
        raise ValueError("the covering finds distances up to 3")
    points = _points(fps)
    v, s = F.col("v"), F.col("s")
    nearest = F.when(s == 0, v).otherwise(_flip(v, s))
    pairs = F.filter(F.sequence(F.lit(1), F.lit(31)), lambda i: i < i.bitwiseXOR(s))
    around = F.when(s == 0, F.array(v)).otherwise(F.concat(F.array(nearest), F.transform(pairs, lambda i: _flip(_flip(v, i), i.bitwiseXOR(s)))))
    cell = lambda anchor: (F.col("half").cast("long") * F.lit(1 << 31) + anchor).alias("cell")
    homes = points.select(cell(nearest), F.col("fp").alias("a"))
    members = points.select("fp", "half", F.explode(around).alias("anchor")).select(cell(F.col("anchor")), F.col("fp").alias("b"))
    close = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius
    found = homes.join(members, (homes["cell"] == members["cell"]) & (F.col("a") < F.col("b")) & close)
    return found.select("a", "b")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, radius: int = RADIUS, salts: int = 16) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id: the smallest doc_id reachable over links, for every row.

    Null and blank texts have fingerprint zero and link like any other. Repeated rows keep their rows. A null doc_id takes part and
    yields its rows, but names a component only where all its doc_ids are null. An empty table gives an empty result.
    """
    marked = materialise(fingerprints(docs, id_col, text_col, words), "simhash")
    per_fp = materialise(marked.groupBy("fp").agg(F.min("doc_id").alias("first")), "simhash-distinct")
    labels = connected_components(links(per_fp.select("fp"), radius).select(F.col("a").alias("u"), F.col("b").alias("v")))
    labelled = per_fp.join(labels, per_fp["fp"] == labels["node"], "left").select("fp", "first", F.coalesce("label", "fp").alias("label"))
    labelled = materialise(labelled, "simhash-labels")
    smallest = labelled.groupBy("label").agg(F.min("first").alias("component_id"))
    per_fp = labelled.join(smallest, "label").select("fp", "component_id")
    spread = per_fp.select("*", every_salt(salts).alias("salt"))
    rows = marked.select("*", salted(F.col("doc_id"), salts).alias("salt"))
    return rows.join(spread, ["fp", "salt"]).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _shingles(h: np.ndarray) -> np.ndarray:
    """A mixed 64-bit hash of every SHINGLE neighbouring word hashes; of fewer words, one of the whole; of none, none."""
    k = min(SHINGLE, len(h))
    if not k:
        return np.zeros(0, dtype=np.uint64)
    sums = np.zeros(len(h) - k + 1, dtype=np.uint64)
    for i in range(k):
        sums = (sums ^ h[i : i + len(sums)]) * _ODD
        sums ^= sums >> np.uint64(31)
    return sums


def _bands(shingles: np.ndarray) -> np.ndarray:
    """The hash of each band of the MinHash signature of at least one shingle."""
    x, least = (shingles >> np.uint64(32)).astype(np.uint32), np.full(len(_SHIFTS), 0xFFFFFFFF, dtype=np.uint32)
    for k in range(0, len(x), _TOGETHER):
        v = np.bitwise_xor.outer(_SHIFTS, x[k : k + _TOGETHER])
        v *= _FACTORS[:, None]
        np.minimum(least, v.min(axis=1), out=least)
    cells = np.arange(BANDS, dtype=np.uint64)
    for row in least.reshape(BANDS, ROWS).T:
        cells = (cells ^ row) * _ODD
        cells ^= cells >> np.uint64(29)
    return cells.view(np.int64)


def _text_shingles(texts: pa.Array) -> Iterator[np.ndarray]:
    h, counts = word_hashes(texts, _WORD, lower=True)
    ends = np.cumsum(counts)
    for end, n in zip(ends.tolist(), counts.tolist(), strict=True):
        yield _shingles(h[end - n : end])


def alike(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sorted arrays of distinct shingles have a Jaccard similarity of LIKENESS or more."""
    if min(len(a), len(b)) < LIKENESS * max(len(a), len(b)) - 1e-9:
        return False
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return shared >= LIKENESS * (len(a) + len(b) - shared) - 1e-9


def joined(prints: list[int], sets: list[np.ndarray], cells: list[list[int]]) -> list[tuple[int, int]]:
    """Pairs of fingerprints that join all fingerprints whose texts share a cell and are alike, directly or through others.

    Texts of one fingerprint are together from the start. A cell holds groups of texts that were together when they came in, so a cluster is skipped as one.
    """
    parent = {p: p for p in prints}

    def root(p: int) -> int:
        while parent[p] != p:
            parent[p] = p = parent[parent[p]]
        return p

    held: dict[int, list[list[int]]] = {}
    found = []
    for i, own in enumerate(prints):
        for cell in cells[i]:
            groups = held.setdefault(cell, [])
            home = None
            for group in groups:
                if root(prints[group[0]]) != root(own):
                    match = next((j for j in group if alike(sets[i], sets[j])), None)
                    if match is None:
                        continue
                    found.append((prints[match], own))
                    parent[root(own)] = root(prints[match])
                home = home or group
            if home is None:
                groups.append([i])
            else:
                home.append(i)
    return found


def similar_links(keyed: DataFrame, marked: DataFrame, text_col: str = "text") -> DataFrame:
    """a, b: fingerprints to join, since texts of theirs have a Jaccard similarity of LIKENESS or more over shingles of five words.

    BANDS bands of ROWS MinHash values find the candidates: a pair at LIKENESS shares no band in (1 - 0.8^5)^40 = 1.3e-7 of cases. Fingerprints that share
    bands, directly or through others, meet in one group, and there exact similarity decides.
    """
    cells = marked.select("fp", F.explode("cells").alias("cell")).distinct()
    shared = cells.groupBy("cell").agg(F.min("fp").alias("u"), F.max("fp").alias("last")).where("u < last").select("cell", "u")
    near = connected_components(cells.join(shared, "cell").where("fp != u").select("u", F.col("fp").alias("v")).distinct())
    near = materialise(near.select(F.col("node").alias("fp"), F.col("label").alias("near")), "simhash-near")
    one = marked.join(near, "fp").groupBy("_digest", "fp", "near").agg(F.min(F.struct("_id", "_rest")).alias("r")).select("_digest", "fp", "near", "r._id", "r._rest")
    texts = keyed.alias("k").join(one.alias("o"), same_row("k", "o")).select("o.fp", "o.near", F.col(f"k.row.`{text_col}`").cast("string").alias("text"))

    def verify(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("fp", kind="stable")
        sets = list(_text_shingles(pa.array(group["text"], pa.string())))
        found = joined(group["fp"].tolist(), [np.unique(x) for x in sets], [_bands(x).tolist() if len(x) else [] for x in sets])
        return pd.DataFrame(found, columns=["a", "b"], dtype=np.int64)

    return texts.groupBy("near").applyInPandas(verify, "a long, b long")


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, radius: int = RADIUS, similar: bool = False) -> DataFrame:
    """One row of each component: that of the smallest doc_id (null after all others), then fingerprint, digest of the text and hash of the other columns.

    Rows are joined by SimHash links, as in near_duplicates; with similar also by similar_links. Rows with a null doc_id or one that others share are
    told apart by their texts; of rows that are alike in all columns, one stays. Columns as in docs.
    """
    keyed = rows_with_keys(docs, id_col, text_col)
    rows = keyed.select(*ROW_KEYS, F.col(f"row.`{text_col}`").cast("string").alias("text"))
    schema = pa.schema([("_id", to_arrow_type(rows.schema["_id"].dataType)), ("_digest", pa.string()), ("_rest", pa.int64()), ("fp", pa.int64()), ("cells", pa.list_(pa.int64()))])

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(parts):
            texts = part["text"].chunk(0)
            fp = np.array([fingerprint(t.as_py(), words) for t in texts], dtype=np.uint64).view(np.int64)
            cells = [_bands(x) if len(x) else [] for x in _text_shingles(texts)] if similar else [[]] * len(texts)
            columns = [part[c].chunk(0).cast(schema.field(c).type) for c in ("_id", "_digest", "_rest")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(fp), pa.array(cells, type=pa.list_(pa.int64()))], schema=schema)

    marked = materialise(rows.mapInArrow(batches, f"_id {kind(rows, '_id')}, _digest string, _rest long, fp long, cells array<long>"), "simhash-rows")
    order = F.struct(F.col("_id").isNull().alias("none"), "_id", "fp", "_digest", "_rest").alias("r")
    per_fp = materialise(marked.groupBy("fp").agg(F.min(order).alias("r")), "simhash-distinct")
    edges = links(per_fp.select("fp"), radius).select(F.col("a").alias("u"), F.col("b").alias("v"))
    if similar:
        edges = edges.unionByName(similar_links(keyed, marked, text_col).select(F.col("a").alias("u"), F.col("b").alias("v")))
    labels = connected_components(edges)
    best = per_fp.join(labels, per_fp["fp"] == labels["node"], "left").groupBy(F.coalesce("label", "fp").alias("label")).agg(F.min("r").alias("r"))
    best = materialise(best.select("r._id", "r._digest", "r._rest"), "simhash-firsts")
    kept = keyed.alias("k").join(best.alias("o"), same_row("k", "o"), "left_semi")
    again = marked.groupBy(*ROW_KEYS).agg(F.count(F.lit(1)).alias("n")).where("n > 1").alias("o")
    twice = best.alias("k").join(again, same_row("k", "o"), "left_semi")
    return (kept if twice.isEmpty() else kept.dropDuplicates([*ROW_KEYS])).select("row.*")
