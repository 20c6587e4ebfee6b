"""Text retrieval over chunks: TF-IDF by tokens, TF-IDF by character 3-grams, query expansion by mutual information.

An index is a few DataFrames; a search joins the query's terms to the postings, so only postings of those terms take part.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codequarry.functions import text as T
from codequarry.sources.shared import materialise

#: The open interval of mutual information that expands a query, and how many terms it takes.
PMI_ABOVE, PMI_BELOW, EXPANSIONS, EPSILON = 1.5, 20.0, 12, 2.0**-52
#: Bounds of mutual information by which the rounds of an expansion go down to PMI_ABOVE; rounds of terms of fewer chunks than LEAST_DF are left out.
ROUNDS, LEAST_DF = (9.0, 6.0, 3.0), 16
#: Most rows of query terms that are broadcast.
BROADCAST_TERMS = 200_000


def chunk(files: DataFrame, words: int = T.CHUNK_WORDS) -> DataFrame:
    """chunk_id, file_path, start_line, end_line, text. files: path, text."""
    rows = files.where(F.col("text").isNotNull()).select(F.col("path").alias("file_path"), F.inline(T.line_chunks(F.col("text"), words)))
    return rows.select(F.concat_ws(":", "file_path", F.col("start_line").cast("string")).alias("chunk_id"), "file_path", "start_line", "end_line", "text")


def postings(chunks: DataFrame, terms: Column) -> DataFrame:
    """chunk_id, term, tf, norm: each distinct term of a chunk, its count, and the square root of all its terms' count."""
    split = chunks.select("chunk_id", terms.alias("terms"))
    flat = split.select("chunk_id", F.sqrt(F.size("terms")).alias("norm"), F.explode("terms").alias("term"))
    return flat.groupBy("chunk_id", "term", "norm").agg(F.count(F.lit(1)).alias("tf"))


def frequencies(found: DataFrame) -> DataFrame:
    """term, df of postings."""
    return found.groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def inverse_frequencies(found: DataFrame, chunks: DataFrame) -> DataFrame:
    """term, df, idf = ln(chunks / df)."""
    n = chunks.agg(F.count(F.lit(1)).alias("n"))
    return frequencies(found).crossJoin(F.broadcast(n)).select("term", "df", F.log(F.col("n") / F.col("df")).alias("idf"))


def _best(scored: DataFrame, k: int, method: str) -> DataFrame:
    """query_id, rank, chunk_id, score, method: the k best of each query, scores above 0; ties by chunk."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")
    return scored.where("score > 0").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "chunk_id", "score", F.lit(method).alias("method"))


def split(chunks: DataFrame, terms: Column) -> DataFrame:
    """chunk_id, norm, terms of every chunk: what a search reads, and what is worth keeping between searches."""
    return chunks.select("chunk_id", terms.alias("terms")).select("chunk_id", F.sqrt(F.size("terms")).alias("norm"), "terms")


def split_tokens(chunks: DataFrame) -> DataFrame:
    return split(chunks, T.tokens(F.col("text")))


def split_ngrams(chunks: DataFrame) -> DataFrame:
    return split(chunks, T.ngrams(F.col("text")))


def _search(rows: DataFrame, wanted: DataFrame, repeats: bool, k: int, method: str) -> DataFrame:
    """The k best chunks of each query by the sum of weight * idf over a chunk's terms (with repeats, or each once), over the root of their count.

    wanted: query_id, term, weight. Document frequencies are counted for the queries' terms alone. Where those fit a broadcast, a chunk's terms meet
    them in the task that split the chunk, so its scores are summed before any shuffle; beyond that size both sides are shuffled by term.
    """
    held = wanted.count() <= BROADCAST_TERMS
    side = F.broadcast if held else lambda df: df
    once = rows.select(F.explode(F.array_distinct("terms")).alias("term")).join(side(wanted.select("term").distinct()), "term", "left_semi")
    n = rows.agg(F.count(F.lit(1)).alias("n"))
    idf = frequencies(once).crossJoin(F.broadcast(n)).select("term", F.log(F.col("n") / F.col("df")).alias("idf")).where("idf > 0")
    asked = wanted.join(idf, "term").select("query_id", "term", (F.col("weight") * F.col("idf")).alias("gain"))
    each = rows.select("chunk_id", "norm", F.explode("terms" if repeats else F.array_distinct("terms")).alias("term"))
    hits = each.join(side(asked), "term").groupBy("query_id", "chunk_id", "norm").agg(F.sum("gain").alias("dot"))
    return _best(hits.select("query_id", "chunk_id", F.round(F.col("dot") / F.col("norm"), 6).alias("score")), k, method)


def keyword_search(chunks: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """Score: the sum of tf * idf over the query's tokens, repeats counting again, over the root of the chunk's tokens. A query without tokens has no result.

    chunks: chunks, or what split_tokens made of them.
    """
    rows = chunks if "terms" in chunks.columns else split_tokens(chunks)
    wanted = queries.select("query_id", F.explode(T.tokens(F.col("text"))).alias("term")).groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("weight"))
    return _search(rows, wanted, True, k, "keyword")


def query_ngrams(text: Column) -> Column:
    return F.array_union(T.ngrams(text), T.ngrams(F.array_join(T.tokens(text), " ")))


def ngram_search(chunks: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """Score: the sum of idf over the query's distinct 3-grams that the chunk has, over the root of the chunk's 3-grams. chunks: chunks, or what split_ngrams made of them."""
    rows = chunks if "terms" in chunks.columns else split_ngrams(chunks)
    wanted = queries.where(F.length(F.trim("text")) > 0).select("query_id", F.explode(query_ngrams(F.col("text"))).alias("term"), F.lit(1).alias("weight"))
    return _search(rows, wanted, False, k, "semantic")


def expansions(chunks: DataFrame, queries: DataFrame, most: int = EXPANSIONS, rounds: tuple[float, ...] = ROUNDS) -> DataFrame:
    """query_id, rank, term, query_term, pmi: terms that share chunks with a query's terms more than chance has it. chunks: chunks, or what split_tokens made of them.

    Co-occurrences are counted only where one side is a query's term. Two terms share no more chunks than either has, so their mutual information is at
    most log2(chunks / df) of the more frequent one. A round counts the pairs of terms whose df is at most chunks / 2^round; a query whose last wanted
    pair is above that bound by then can get no other, and the rest go on to the next round. The last round's bound is PMI_ABOVE, which no other pair reaches.
    """
    rows = chunks if "terms" in chunks.columns else split_tokens(chunks)
    words = materialise(rows.select("chunk_id", F.explode(F.array_distinct("terms")).alias("term")), "words")
    df = materialise(frequencies(words), "frequencies")
    asked = materialise(queries.select("query_id", F.explode(F.array_distinct(T.tokens(F.col("text")))).alias("query_term")), "asked")
    total, few = rows.count(), asked.count() <= BROADCAST_TERMS
    share = lambda c: F.col(c) / F.lit(float(total))
    pmi = F.log2(F.greatest(share("c"), F.lit(EPSILON)) / F.greatest(share("query_df") * share("df"), F.lit(EPSILON)))
    order = Window.partitionBy("query_id").orderBy(F.desc("pmi"), "term", "query_term")
    bounds = [b for b in rounds if total / 2**b >= LEAST_DF] + [PMI_ABOVE]
    held, left = [], asked
    for bound in bounds:
        limit = total / 2**bound
        common = F.broadcast(df.where(F.col("df") > limit).select("term"))  # at most 2^bound terms for each distinct term of a mean chunk, whatever the number of chunks
        rare = words.join(common, "term", "left_anti")
        own = left.select(F.col("query_term").alias("term")).distinct()
        own = F.broadcast(own) if few else own
        at = rare.join(own, "term", "left_semi").select("chunk_id", F.col("term").alias("query_term"))
        together = at.join(rare, "chunk_id").where("term <> query_term").groupBy("query_term", "term").agg(F.count(F.lit(1)).alias("c"))
        both = together.join(df, "term").join(df.select(F.col("term").alias("query_term"), F.col("df").alias("query_df")), "query_term")
        close = both.select("query_term", "term", F.round(pmi, 6).alias("pmi")).where((F.col("pmi") > PMI_ABOVE) & (F.col("pmi") < PMI_BELOW))
        near = left.join(close, "query_term").join(asked.select("query_id", F.col("query_term").alias("term")), ["query_id", "term"], "left_anti")
        best = near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most).select("query_id", "rank", "term", "query_term", "pmi")
        best = materialise(best, "expansions")
        if bound == bounds[-1]:
            return reduce(DataFrame.union, [*held, best])
        settled = best.where((F.col("rank") == most) & (F.col("pmi") > bound + 1e-6)).select("query_id")
        held.append(best.join(settled, "query_id", "left_semi"))
        left = left.join(settled, "query_id", "left_anti")
        if left.isEmpty():
            return reduce(DataFrame.union, held)


def expanded(queries: DataFrame, found: DataFrame) -> DataFrame:
    """queries with their expansions appended to the text."""
    added = found.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "term"))), lambda x: x["term"]), " ").alias("added"))
    return queries.join(added, "query_id", "left").select("query_id", F.concat_ws(" ", "text", "added").alias("text"))


def hybrid(keyword: DataFrame, ngram: DataFrame, k: int = 10, keyword_weight: float = 0.5) -> DataFrame:
    """Weighted sum of both methods' scores, each over its query's best; the k best of each query."""

    def scaled(found: DataFrame, weight: float) -> DataFrame:
        best = F.max("score").over(Window.partitionBy("query_id"))
        return found.select("query_id", "chunk_id", (F.col("score") / best * weight).alias("part"))

    both = scaled(keyword, keyword_weight).unionByName(scaled(ngram, 1 - keyword_weight))
    scored = both.groupBy("query_id", "chunk_id").agg(F.round(F.sum("part"), 6).alias("score"))
    return _best(scored, k, "hybrid")


def reranked(found: DataFrame, metadata: DataFrame, keep: Column, k: int = 10, recency_weight: float = 0.2) -> DataFrame:
    """query_id, rank, chunk_id, score: the results whose file the predicate keeps, by their score and their file's recency. metadata: file_path, recency (0 to 1) and what keep reads."""
    own = found.withColumn("file_path", F.regexp_replace("chunk_id", ":[0-9]+$", "")).join(metadata.where(keep), "file_path")
    scored = own.select("query_id", "chunk_id", F.round(F.col("score") * (1 - recency_weight) + F.col("recency") * recency_weight, 6).alias("score"))
    return _best(scored, k, "reranked").drop("method")
