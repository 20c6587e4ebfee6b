"""Words of many texts at once: Arrow splits and numbers them, Python sees each distinct word of a slice once, numpy gathers the rest."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

#: Bytes of text in a slice; rows taken together at a time.
SLICE_BYTES, _STEP = 6 << 20, 100


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.Table]:
    """The rows of the batches, regrouped so that a slice has about `most` bytes in a column; a longer text is in a slice with few others."""
    waiting, size = [], 0
    for batch in batches:
        for k in range(0, batch.num_rows, _STEP):
            part = batch.slice(k, _STEP)
            waiting.append(part)
            size += pc.sum(pc.binary_length(part.column(column))).as_py() or 0
            if size >= most:
                yield pa.Table.from_batches(waiting).combine_chunks()
                waiting, size = [], 0
    if any(b.num_rows for b in waiting):
        yield pa.Table.from_batches(waiting).combine_chunks()


def word_hashes(texts: pa.Array, pattern: re.Pattern, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hash of every match of pattern in every text, matches a text). Matches may not hold white space; null texts have none."""
    split = pc.utf8_split_whitespace(pc.fill_null(texts, ""))
    word = split.flatten().dictionary_encode()
    at = word.indices.to_numpy(zero_copy_only=False)
    found, sizes, digest = [], [], xxhash.xxh64_intdigest
    for w in word.dictionary.to_pylist():
        parts = pattern.findall(w.lower() if lower else w)
        found += parts
        sizes.append(len(parts))
    hashes = np.fromiter((digest(p) for p in found), dtype=np.uint64, count=len(found))
    sizes = np.array(sizes, dtype=np.int64)
    n = sizes[at]
    take = np.repeat((np.cumsum(sizes) - sizes)[at] - (np.cumsum(n) - n), n).astype(np.int32)
    take += np.arange(len(take), dtype=np.int32)
    upto = np.concatenate([[0], np.cumsum(n)])
    bounds = split.offsets.to_numpy(zero_copy_only=False)
    return hashes[take], upto[bounds[1:] - bounds[0]] - upto[bounds[:-1] - bounds[0]]
