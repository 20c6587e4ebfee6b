"""The pipeline against plain Python and DuckDB: none of the stages' own functions takes part."""

from __future__ import annotations

import math
import re
import struct
import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import tokenizers
import xxhash

from codequarry.llm import mixing


def good_ones(texts, labels):
    """Ids that importance resampling keeps: log weights from counts of hashed words and pairs, Gumbel noise, the greatest k."""
    buckets, first, second = 10_000, 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F

    def grams(text):
        h = [xxhash.xxh64_intdigest(w) for w in re.findall(r"\w+|[^\w\s]+", text or "")]
        return Counter([x % buckets for x in h] + [((a * first + b * second) % 2**64 >> 20) % buckets for a, b in zip(h, h[1:], strict=False)])

    own = {d: grams(t) for d, t in texts.items()}
    good = {d for d, q in labels.items() if q == 1}
    raw, target = np.ones(buckets), np.ones(buckets)
    for d, found in own.items():
        for b, n in found.items():
            raw[b] += n
            target[b] += n * (d in good)
    ratio = np.log(target / target.sum()) - np.log(raw / raw.sum())
    seed = xxhash.xxh64_intdigest(struct.pack("<i", 7), 42)

    def key(d):
        h = xxhash.xxh64_intdigest(str(d).encode(), seed)
        u = ((h - (h >> 63 << 64)) % (1 << 52) + 0.5) / (1 << 52)
        return sum(ratio[b] * n for b, n in own[d].items()) - math.log(-math.log(u))

    share = len(good) / len(labels)
    share = min(1.0, share + 2 * math.sqrt(share * (1 - share) / len(labels)))
    return set(sorted(texts, key=key, reverse=True)[: round(share * len(texts))])


def first_of_links(texts):
    """Ids without a smaller one reachable over fingerprints that differ in three bits or fewer."""

    def fp(text):
        w = text.encode().lower().split()
        h = [xxhash.xxh64_intdigest(b" ".join(w[k : k + 3]), 42) for k in range(max(1, len(w) - 2))] if w else []
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    prints = {d: fp(t) for d, t in texts.items()}
    label = {d: d for d in prints}
    pairs = [(a, b) for a in prints for b in prints if a < b and (prints[a] ^ prints[b]).bit_count() <= 3]
    while any(label[a] != label[b] for a, b in pairs):
        for a, b in pairs:
            label[a] = label[b] = min(label[a], label[b])
    return {d for d in texts if label[d] == d}


def shingles(text):
    w = re.findall(r"[^\W_]+", (text or "").lower())
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or ({tuple(w)} if w else set())


def test_pipeline_independently(spark, sf_dir):
    import corpus_pipeline

    con = duckdb.connect()
    rows = con.execute(f"SELECT doc_id, text, source FROM read_parquet('{sf_dir}/documents.parquet')").fetchall()
    texts = {d: t for d, t, _ in rows}
    labels = dict(con.execute(f"SELECT doc_id, max(quality) FROM read_parquet('{sf_dir}/labels.parquet') WHERE quality IS NOT NULL GROUP BY doc_id").fetchall())
    items = [shingles(t) for (t,) in con.execute(f"SELECT text FROM read_parquet('{sf_dir}/benchmark.parquet')").fetchall()]
    kept = good_ones(texts, labels)
    kept = first_of_links({d: texts[d] for d in kept})
    own = {d: shingles(texts[d]) for d in kept}
    kept = {d for d in kept if not any(s and len(s & own[d]) >= 0.8 * len(s) for s in items)}
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, source VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?)", [r for r in rows if r[0] in kept])
    mix = con.execute(f"SELECT doc_id, copies FROM ({mixing.MIX_SQL}) ORDER BY doc_id").fetchall()
    encoder, start, want = tokenizers.Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), 0, []
    for d, copies in mix:
        ids = [*encoder.encode(texts[d], add_special_tokens=False).ids, 2]
        for _ in range(copies):
            want.append((d, start, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())))
            start += len(ids)
    assert len(want) > 100 and sorted(map(tuple, corpus_pipeline.run(spark, sf_dir).collect())) == want
