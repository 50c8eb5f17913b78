"""Retrieval by settings, and one turn of a chat from question to history."""

from __future__ import annotations

import warnings
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import answer as AN
from ..operators import evaluate as EV
from ..operators import retrieve as R
from .config import candidates, collection, run_name


def retrieve(s: dict[str, object], queries: DataFrame, rows: DataFrame, score=R.overlap_score, warn: bool = False, undefined: float = 1.0) -> DataFrame:
    """(query_id, id, score, rank, score_kind): k chunks for each query, as settings s ask for.

    queries: (query_id, text, q); rows: those of a collection (id, entry_type,
    parent_id, document, vector).  Question rows are hits on their chunk, so
    four times as many are fetched where there are any.  A hybrid search fuses
    with BM25 over the chunks; a reranker chooses k among more candidates.  The
    score is a distance, a fused or a reranker's one, as score_kind says.
    undefined: the distance of vectors of zeros; see dense_top().
    """
    n, hype = candidates(s), s["extras"] == "hype"
    found = R.dense_top(queries.select("query_id", "q"), rows.select("id", "vector"), R.LEXICAL_FACTOR * n if hype else n, undefined)
    if hype:
        parents = rows.select("id", F.coalesce("parent_id", "id").alias("_parent"))
        hits = found.join(parents, "id")
        # several rows of one chunk: the best place, and its distance
        found = R.to_parents(hits, F.col("_parent"), n).select("query_id", F.col("parent").alias("id"), "distance", "rank")
    found = found.withColumnRenamed("distance", "score")
    chunks = R.chunk_rows(rows).select("id", F.col("document").alias("text"))
    if warn and s["search"] == "densa":
        short = queries.select("query_id").join(found.groupBy("query_id").agg(F.count("*").alias("n")), "query_id", "left").where(F.coalesce("n", F.lit(0)) < s["k"]).count()
        if short:
            warnings.warn(f"{collection(s)}: {short} queries have fewer than {s['k']} chunks", stacklevel=2)
    if s["search"] == "hibrida":
        found = R.hybrid_top(found, R.bm25_top(queries.select("query_id", "text"), chunks, R.LEXICAL_FACTOR * n), n)
    if s["rerank"]:
        found = R.rerank(found, queries.select("query_id", "text"), chunks, int(s["k"]), score)
    return found.where(F.col("rank") <= s["k"]).select("query_id", "id", "score", "rank", R.score_kind(F.lit(s["rerank"]), F.lit(s["search"])).alias("score_kind"))


def prompts(hits: DataFrame, queries: DataFrame, rows: DataFrame) -> DataFrame:
    """(query_id, prompt) from hits (query_id, id, rank), queries (query_id, text) and rows (id, corpus, title, document)."""
    x = hits.join(rows.select("id", "corpus", "title", "document"), "id").join(queries.select("query_id", F.col("text").alias("_q")), "query_id")
    made = AN.prompt(F.col("rank"), F.col("corpus"), F.col("title"), F.col("id").cast("string"), F.col("document"), F.col("_q"))
    return x.groupBy("query_id").agg(made.alias("prompt"))


def run_turn(s: dict[str, object], turns: DataFrame, rows: DataFrame, embed: Callable[[Column], Column], condense: Callable[[Column, Column], Column], generate: Callable[[Column], Column], allowed: DataFrame, undefined: float = 1.0) -> DataFrame:
    """(query_id, query, answer, abstained, history) of turns (query_id, question, history), history an array of (q, a).

    The condenser always makes the query, of the last pairs and the question;
    the question as it was asked goes into the new history with the answer.
    undefined: the distance of vectors of zeros; see dense_top().
    """
    asked = turns.withColumn("query", condense(AN.last_turns(F.col("history")), F.col("question")))
    queries = asked.select("query_id", F.col("query").alias("text"), embed(F.col("query")).alias("q"))
    made = prompts(retrieve(s, queries, rows, undefined=undefined), queries, rows)
    answered = AN.answer(asked.join(made, "query_id"), generate, "query_id", allowed)
    pair = F.struct(F.col("question").alias("q"), F.col("answer").alias("a"))
    return answered.select("query_id", "query", "answer", "abstained", F.concat("history", F.array(pair)).alias("history"))


def run_row(s: dict[str, object], queries: DataFrame, labels: DataFrame, rows: DataFrame) -> DataFrame:
    """One result row of a run: its settings, its names, and the summary of its metrics.

    rows: a collection with sections (array) and n_tokens; labels: (query_id, sections).
    """
    hits = retrieve(s, queries, rows)
    chunks = R.chunk_rows(rows).select("id", "sections", "n_tokens")
    known = hits.join(chunks, "id")
    tokens = queries.select("query_id").join(known.groupBy("query_id").agg(F.sum("n_tokens").alias("tokens")), "query_id", "left").withColumn("tokens", F.coalesce("tokens", F.lit(0)))
    result = EV.summary(EV.question_metrics(known.select("query_id", "rank", "sections"), labels, int(s["k"])), tokens)
    return result.select(*[F.lit(v).alias(n) for n, v in s.items()], F.lit(collection(s)).alias("collection"), F.lit(run_name(s)).alias("run_id"), *result.columns)


def run_grid(grid, queries: DataFrame, labels: DataFrame, collections: Callable[[dict[str, object]], DataFrame], done: set[str] = frozenset()) -> DataFrame | None:
    """The result rows of all settings of a grid whose run isn't done yet; null if none is left.

    A grid is a few dozen settings, and each is a plan of its own.
    """
    out = None
    for s in grid:
        if run_name(s) not in done:
            x = run_row(s, queries, labels, collections(s))
            out = x if out is None else out.unionByName(x)
    return out


def warm_up(s: dict[str, object], rows: DataFrame, embed: Callable[[Column], Column], generate: Callable[[Column], Column]) -> None:
    """One real search and one call of the model, so that the first question doesn't wait for either to load."""
    one = rows.sparkSession.range(1).select(F.col("id").alias("query_id"), F.lit("warm-up").alias("text"))
    retrieve(s, one.withColumn("q", embed(F.col("text"))), rows).collect()
    one.select(generate(F.col("text"))).collect()
