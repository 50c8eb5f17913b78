"""Retrieval: exact dense search, BM25, reciprocal rank fusion, reranking.

Queries are a stated set; they meet the corpus in blocks of bounded size, and
each task keeps the best of its own rows before any shuffle, so no task sees all
of a query's rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions import text as X
from ..sources.tables import staged

#: BM25's parameters, the share of the mean idf that a negative one becomes, and fusion's constant.
K1, B, EPSILON, RRF_K = 1.5, 0.75, 0.25, 60
#: Candidates for the reranker; the lexical list is so many times as long as the dense one.
RERANK_CANDIDATES, LEXICAL_FACTOR = 20, 4
#: Numbers of one block of query vectors: 16 MB.
MAX_NUMBERS = 2_000_000


def top(scored: DataFrame, query: str, item: str, score: Column, n: int) -> DataFrame:
    """The n rows of each query with the highest scores (to nine decimals; then the smallest item), with rank from 1."""
    by = W.partitionBy(query).orderBy(F.round(score, 9).desc(), F.col(item))
    return scored.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= n)


def dense_top(queries: DataFrame, rows: DataFrame, n: int, undefined: float = 1.0) -> DataFrame:
    """(query_id, id, distance, rank): by cosine distance, from queries (query_id, q) and rows (id, vector).

    Exact: every row meets every query of the stated set, a batch of rows and a
    block of queries at a time, as one product of matrices; a task keeps the n
    best of its rows for each query.  A block has MAX_NUMBERS numbers at most,
    and goes to all tasks; more queries are searched block by block, each over
    the rows once.  Null vectors are left out.  A vector of zeros has no cosine:
    it is at distance `undefined`; NaN, as DuckDB has it, comes before all others.
    """
    queries = queries.where("q is not null").select("query_id", "q")
    first = queries.select(F.size("q")).first()
    if first is None:
        return rows.select(F.lit(None).cast(queries.schema["query_id"].dataType).alias("query_id"), "id", F.lit(0.0).alias("distance"), F.lit(0).alias("rank")).limit(0)
    per_block = max(MAX_NUMBERS // max(first[0], 1), 1)
    total = queries.count()
    # dealt by hash into blocks of half the number, so that none comes near it; all rows of a query_id are in one
    n_blocks = 1 if total <= per_block else -(-2 * total // per_block)
    block = F.pmod(F.xxhash64("query_id"), F.lit(n_blocks))
    found = [_dense_block(queries.where(block == i) if n_blocks > 1 else queries, rows, n, undefined) for i in range(n_blocks)]
    return top(reduce(DataFrame.unionByName, found), "query_id", "id", -F.col("distance"), n)


def _dense_block(queries: DataFrame, rows: DataFrame, n: int, undefined: float) -> DataFrame:
    """(query_id, id, distance) of each task's n nearest rows to each query, ties included."""
    asked = queries.collect()
    matrix = np.array([r["q"] for r in asked], float)
    norms = np.sqrt((matrix * matrix).sum(1, keepdims=True)) if len(asked) else 1.0
    shared = rows.sparkSession.sparkContext.broadcast(([r["query_id"] for r in asked], (matrix / np.where(norms > 0, norms, 1)).T if len(asked) else matrix, norms.T == 0 if len(asked) else None))
    # NaN is the least distance until the rows leave the task
    given = -np.inf if np.isnan(undefined) else undefined
    schema = T.StructType([T.StructField("query_id", queries.schema["query_id"].dataType), T.StructField("id", rows.schema["id"].dataType), T.StructField("distance", T.DoubleType())])
    types = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, q, none = shared.value
        best: tuple[np.ndarray, np.ndarray, list] | None = None  # query number, distance, and each hit's id
        for b in batches:
            if not b.num_rows or not len(ids):
                continue
            v = np.array(b.column("vector").to_pylist(), float)
            size = np.sqrt((v * v).sum(1, keepdims=True))
            # to twelve decimals, beyond which the order of additions shows
            distance = np.round(1 - (v / np.where(size > 0, size, 1)) @ q, 12) + 0.0
            distance[(size == 0) | none] = given
            # with a margin, so that rounding settles ties in one place only
            worst = np.partition(distance, n - 1, axis=0)[n - 1] if len(v) > n else np.full(len(ids), np.inf)
            row, number = np.nonzero(distance <= worst + 2e-9)
            keys = b.column("id").take(pa.array(row)).to_pylist()
            new = (number, distance[row, number], keys)
            best = new if best is None else _kept(np.concatenate([best[0], new[0]]), np.concatenate([best[1], new[1]]), best[2] + new[2], n)
        if best is not None:
            number, distance, keys = best
            made = ([ids[i] for i in number.tolist()], keys, np.where(np.isinf(distance), np.nan, distance))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(made, types, strict=True)], schema=types)

    return rows.where("vector is not null").select("id", "vector").mapInArrow(run, schema)


def _kept(number: np.ndarray, distance: np.ndarray, keys: list, n: int) -> tuple[np.ndarray, np.ndarray, list]:
    """Of each query's hits the n nearest, and those within rounding of the last."""
    order = np.lexsort((distance, number))
    number, distance = number[order], distance[order]
    start = np.searchsorted(number, number)
    last = np.minimum(start + n - 1, np.searchsorted(number, number, side="right") - 1)
    keep = distance <= distance[last] + 2e-9
    return number[keep], distance[keep], [keys[i] for i in order[keep].tolist()]


def to_parents(hits: DataFrame, parent: Column, n: int) -> DataFrame:
    """Hits on questions count for their chunk; the best place of each chunk stays, and ranks close up."""
    x = hits.withColumn("parent", parent)
    x = x.withColumn("_r", F.row_number().over(W.partitionBy("query_id", "parent").orderBy("rank"))).where("_r = 1").drop("_r")
    return x.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy("rank"))).where(F.col("rank") <= n)


def bm25_top(queries: DataFrame, docs: DataFrame, n: int) -> DataFrame:
    """(query_id, id, score, rank) by Okapi BM25 from queries (query_id, text) and docs (id, text).

    A query's term counts as often as it stands there.  A negative idf becomes a
    share of the mean idf over all terms.  Documents without any of the terms
    have score 0 and may be returned.
    """
    tokens = docs.select("id", X.tokens(F.col("text")).alias("t"))
    sizes = tokens.select(F.count("*").alias("n_docs"), F.avg(F.size("t")).alias("mean_length")).first()
    n_docs, mean_length = sizes["n_docs"], sizes["mean_length"] or 1.0
    # read twice: for the mean and for the asked terms
    frequency = staged(tokens.select(F.explode(F.array_distinct("t")).alias("term")).groupBy("term").agg(F.count("*").alias("df")))
    idf = frequency.withColumn("raw", F.log(F.lit(float(n_docs)) - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
    mean_idf = idf.select(F.avg("raw")).first()[0] or 0.0
    idf = idf.select("term", F.when(F.col("raw") < 0, F.lit(EPSILON * mean_idf)).otherwise(F.col("raw")).alias("idf"))
    asked = queries.select("query_id", F.explode(X.tokens(F.col("text"))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("times"))
    asked = staged(asked.join(idf, "term"))
    # postings of asked terms only leave the scan
    wanted = asked.select("term").distinct()
    wanted = F.broadcast(wanted) if wanted.limit(200_001).count() <= 200_000 else wanted
    postings = tokens.select("id", F.size("t").alias("length"), F.explode("t").alias("term")).join(wanted, "term").groupBy("id", "length", "term").agg(F.count("*").alias("tf"))
    part = F.col("times") * F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / mean_length))
    scored = postings.join(asked, "term").groupBy("query_id", "id").agg(F.sum(part).alias("score"))
    best = staged(top(scored, "query_id", "id", F.col("score"), n).drop("rank"))  # n rows a query
    # queries with fewer hits than n are filled up with the smallest ids that have score 0
    short = queries.select("query_id").join(best.groupBy("query_id").agg(F.count("*").alias("k")), "query_id", "left").where(F.coalesce("k", F.lit(0)) < n).select("query_id")
    first = docs.select("id").orderBy("id").limit(2 * n)
    zero = F.broadcast(first).crossJoin(short).join(best, ["query_id", "id"], "left_anti").select("query_id", "id", F.lit(0.0).alias("score"))
    return top(best.unionByName(zero), "query_id", "id", F.col("score"), n)


def rrf(rankings: list[DataFrame], n: int, k: int = RRF_K) -> DataFrame:
    """(query_id, id, score, rank): sums of 1 / (k + rank) over the rankings (query_id, id, rank)."""
    all_of = rankings[0].select("query_id", "id", "rank")
    for r in rankings[1:]:
        all_of = all_of.unionByName(r.select("query_id", "id", "rank"))
    fused = all_of.groupBy("query_id", "id").agg(F.sum(1 / (k + F.col("rank"))).alias("score"))
    return top(fused, "query_id", "id", F.col("score"), n)


def hybrid_top(dense: DataFrame, lexical: DataFrame, n: int) -> DataFrame:
    """Fuses a dense list of length n with a lexical one of four times that length, cut to n."""
    return rrf([dense.where(F.col("rank") <= n), lexical.where(F.col("rank") <= LEXICAL_FACTOR * n)], n)


def overlap_score(query: Column, text: Column) -> Column:
    """Share of the query's different tokens that the text has: the offline stand-in for a pair model."""
    q = F.array_distinct(X.tokens(query))
    return F.size(F.array_intersect(q, X.tokens(text))) / F.greatest(F.size(q), F.lit(1))


def chunk_rows(rows: DataFrame) -> DataFrame:
    """Rows that are chunks: what BM25 and the evaluation know; question rows are for the dense search alone."""
    return rows.where("entry_type = 'chunk'")


def rerank(candidates: DataFrame, queries: DataFrame, docs: DataFrame, n: int, score=overlap_score) -> DataFrame:
    """The n candidates (query_id, id) of each query with the best score(query text, document text)."""
    asked = candidates.select("query_id", "id").join(queries.select("query_id", F.col("text").alias("_q")), "query_id")
    # n candidates a query: broadcast if their number, which is counted, is small, so that only their texts leave the scan
    asked = F.broadcast(asked) if candidates.limit(100_001).count() <= 100_000 else asked
    x = docs.select("id", F.col("text").alias("_d")).join(asked, "id")
    return top(x.withColumn("score", score(F.col("_q"), F.col("_d"))).drop("_q", "_d"), "query_id", "id", F.col("score"), n)


def score_kind(reranked: Column, search: Column) -> Column:
    return F.when(reranked, "rerank").when(search == "hibrida", "rrf").otherwise("distancia")
