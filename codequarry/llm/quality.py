"""Quality classifier by importance resampling.

Two generative models share one space of hashed word and word-pair buckets: the target model counts the texts labelled good, the raw model
counts all texts. A text's log weight is the sum, over its n-grams, of the log ratio of the two probabilities. Adding Gumbel noise to log
weights and keeping the k greatest draws k documents without replacement in proportion to their weights. k is the labelled rows' share of good plus SLACK standard errors,
taken of all rows: where the share is uncertain, documents are kept. The target model learns from at most SAMPLE good rows, those with the least hash of
their id; raw counts, weights and the cut-off cover all rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import kind, materialise, rows_with_keys, same_row
from ._words import slices, word_hashes

BUCKETS, SMOOTHING, SEED, SAMPLE, SLACK = 10_000, 1.0, 7, 20_000, 2.0
_TOKEN = re.compile(r"\w+|[^\w\s]+")
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _pairs(first: np.ndarray, second: np.ndarray, buckets: int) -> np.ndarray:
    return ((first * _A + second * _B >> np.uint64(20)) % np.uint64(buckets)).astype(np.int64)


def features(text: str | None, buckets: int = BUCKETS) -> np.ndarray:
    """The buckets of a text's words and neighbouring pairs, with repeats. Words are runs of letters and digits or of other signs."""
    h = np.array([xxhash.xxh64_intdigest(t) for t in _TOKEN.findall(text or "")], dtype=np.uint64)
    return np.concatenate([(h % np.uint64(buckets)).astype(np.int64), _pairs(h[:-1], h[1:], buckets)])


def _features(texts: pa.Array, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of many texts: buckets of words; buckets of the pairs that begin with each word; whether there is such a pair in its text; words a text."""
    h, counts = word_hashes(texts, _TOKEN)
    inside = np.ones(len(h), dtype=bool)
    inside[(np.cumsum(counts) - 1)[counts > 0]] = False
    after = np.append(h[1:], np.uint64(0)) if len(h) else h
    return (h % np.uint64(buckets)).astype(np.int64), _pairs(h, after, buckets), inside, counts


def log_ratios(rows: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Log of target over raw probability for each bucket. rows: text, good (boolean). All rows are counted; the result has one number a bucket."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, target = np.zeros(buckets, dtype=np.int64), np.zeros(buckets, dtype=np.int64)
        for part in slices(batches):
            words, pairs, inside, counts = _features(part["text"].chunk(0), buckets)
            raw += np.bincount(words, minlength=buckets) + np.bincount(pairs[inside], minlength=buckets)
            good = np.repeat(part["good"].to_numpy(), counts)
            target += np.bincount(words[good], minlength=buckets) + np.bincount(pairs[inside & good], minlength=buckets)
        k = np.nonzero(raw)[0]
        yield pa.RecordBatch.from_pydict({"bucket": k, "raw": raw[k], "target": target[k]})

    sums = rows.mapInArrow(count, "bucket long, raw long, target long").groupBy("bucket").agg(F.sum("raw"), F.sum("target"))
    raw, target = np.full(buckets, SMOOTHING), np.full(buckets, SMOOTHING)
    for b, r, t in sums.collect():  # at most one row a bucket
        raw[b] += r
        target[b] += t
    if target.sum() <= SMOOTHING * buckets:
        return np.zeros(buckets)
    return np.log(target / target.sum()) - np.log(raw / raw.sum())


def _gumbel(key: Column, seed: int) -> Column:
    u = (F.pmod(F.xxhash64(F.lit(seed), key), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    return -F.log(-F.log(u))


def cutoff(keys: DataFrame, k: int, bins: int = 4096) -> tuple[float, int] | None:
    """(x, m): exactly k rows of keys (column `key`, doubles) are above x or among m of those equal to it. None: all rows are within k.

    Each round counts the keys of the interval that holds the k-th in `bins` parts, so the driver sees at most `bins` rows a round.
    """
    low, high, n = keys.agg(F.min("key"), F.max("key"), F.count("key")).first()
    if n <= k:
        return None
    if k <= 0:
        return high, 0
    above = 0
    while low < high:
        width = (high - low) / bins
        if width <= 0 or low + width == low:
            break
        part = F.least(F.floor((F.col("key") - low) / width), F.lit(bins - 1)).cast("int")
        counts = keys.where(F.col("key").between(low, high)).groupBy(part.alias("b")).agg(F.count(F.lit(1)).alias("n"), F.min("key").alias("lo"), F.max("key").alias("hi")).collect()
        for r in sorted(counts, key=lambda r: -r["b"]):
            if above + r["n"] >= k:
                low, high = r["lo"], r["hi"]
                break
            above += r["n"]
    return low, k - (keys.where(F.col("key") > low).count())


def _sampled(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", share: float | None = None, buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """What importance_sample returns, and t, a digest of the text: it tells rows of one doc_id, or of none, apart."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.md5(F.col(text_col).cast("string")).alias("t"))
    votes = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).alias("label")).where(F.col("doc_id").isNotNull() & F.col("label").isNotNull())
    votes = votes.groupBy("doc_id").agg(F.max("label").cast("int").alias("label"))
    chosen = votes.where("label = 1").orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE).select("doc_id", F.lit(True).alias("good"))
    marked = rows.join(F.broadcast(chosen), "doc_id", "left").select("text", F.coalesce("good", F.lit(False)).alias("good"))
    ratios = docs.sparkSession.sparkContext.broadcast(log_ratios(marked, buckets))

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = ratios.value
        for part in slices(batches):
            words, pairs, inside, counts = _features(part["text"].chunk(0), buckets)
            weight = table[words] + np.where(inside, table[pairs], 0.0)
            total, some = np.zeros(len(counts)), counts > 0
            if len(weight):
                total[some] = np.add.reduceat(weight, (np.cumsum(counts) - counts)[some])
            yield pa.RecordBatch.from_arrays([part["doc_id"].chunk(0), part["t"].chunk(0), pa.array(np.maximum(2 * counts - 1, 0)), pa.array(total)], ["doc_id", "t", "n_grams", "log_weight"])

    weighed = rows.mapInArrow(weigh, f"doc_id {kind(rows, 'doc_id')}, t string, n_grams long, log_weight double")
    weighed = materialise(weighed.withColumn("key", F.col("log_weight") + _gumbel(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), seed)), "importance")
    n = weighed.count()
    if share is None:
        good, labelled = votes.agg(F.sum((F.col("label") == 1).cast("long")), F.count(F.lit(1))).first()
        share = good / labelled if labelled else 1.0
        share = min(1.0, share + SLACK * (share * (1 - share) / labelled) ** 0.5) if labelled else 1.0
    cut = cutoff(weighed, round(share * n))
    if cut is None:
        return weighed.withColumn("selected", F.lit(True))
    x, ties = cut
    equal = F.lit(ties > 0)
    if 0 < ties < (tied := weighed.where(F.col("key") == x)).count():
        last, none = tied.orderBy(F.col("doc_id").asc_nulls_last()).limit(ties).agg(F.max("doc_id"), F.max(F.col("doc_id").isNull())).first()
        equal = F.lit(True) if none else F.coalesce(F.col("doc_id") <= last, F.lit(False))
    return weighed.withColumn("selected", (F.col("key") > x) | ((F.col("key") == x) & equal))


def importance_sample(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """doc_id, n_grams, log_weight, key, selected for every row; selected marks the k rows with the greatest key (log weight plus noise).

    share: k as a share of all rows; None takes the good share of the labelled rows and the slack (1 without labels). A doc_id that is labelled good anywhere counts
    as good; null labels and null doc_ids label nothing. Null and empty texts have weight 0. Rows of one doc_id have the same noise. Where equal keys straddle the
    cut-off, smaller doc_ids come first, null last, and rows that are alike in key and doc_id are all selected if one of them is: then there are more than k.
    Without good labels all log weights are 0. An empty table gives an empty result.
    """
    return _sampled(docs, labels, **options).drop("t")


def keep_selected(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of docs that are selected, each judged by its own text, whatever doc_ids it shares. Columns as in docs, whatever their names."""
    kept = _sampled(docs, labels, id_col=id_col, text_col=text_col, **options).where("selected").select(F.col("doc_id").alias("_id"), F.col("t").alias("_digest")).distinct()
    return rows_with_keys(docs, id_col, text_col).alias("d").join(kept.alias("k"), same_row("d", "k", ("_id", "_digest")), "left_semi").select("row.*")
