"""Evaluation: retrieval metrics, verdicts of judges, one-factor tables over runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .index import run_id

#: Fixed value: what a run is made of, in the order of its tables.
DIMENSIONS = ("corpus", "extras", "embedding", "search", "k", "rerank", "cap")


def question_metrics(hits: DataFrame, labels: DataFrame, k: int) -> DataFrame:
    """(query_id, hit, precision, mrr, recall) for each labelled query.

    hits: (query_id, rank, sections); labels: (query_id, sections).  A hit is
    relevant if its sections meet the label's.  precision divides by k, recall
    counts the label's sections over all hits.  Labels outside the collection are misses.
    """
    labels = labels.where(F.size("sections") > 0).select("query_id", F.array_distinct("sections").alias("wanted"))
    x = labels.join(hits, "query_id", "left")
    good = F.coalesce(F.arrays_overlap("sections", "wanted"), F.lit(False)) & (F.col("rank") <= k)
    covered = F.array_intersect("wanted", F.coalesce("sections", F.array().cast("array<string>")))
    x = x.withColumns({"_good": good, "_covered": covered})
    x = x.groupBy("query_id").agg(F.first(F.size("wanted")).alias("n"), F.count_if("_good").alias("g"), F.min(F.when(F.col("_good"), F.col("rank"))).alias("r"), F.flatten(F.collect_list("_covered")).alias("c"))
    return x.select("query_id", F.when(F.col("g") > 0, 1.0).otherwise(0.0).alias("hit"), (F.col("g") / k).alias("precision"), F.coalesce(1 / F.col("r"), F.lit(0.0)).alias("mrr"), (F.size(F.array_distinct("c")) / F.col("n")).alias("recall"))


def best_ranks(hits: DataFrame) -> DataFrame:
    """(query_id, section, rank): the first place at which each section is covered."""
    return hits.select("query_id", F.explode("sections").alias("section"), "rank").groupBy("query_id", "section").agg(F.min("rank").alias("rank"))


def summary(metrics: DataFrame, tokens: DataFrame) -> DataFrame:
    """One row: means over labelled queries, null if there are none, and mean tokens over all queries."""
    m = metrics.agg(*[F.round(F.avg(c), 4).alias(n) for c, n in (("hit", "hit_rate"), ("precision", "precision"), ("mrr", "mrr"), ("recall", "recall"))], F.count("*").alias("n_scored"))
    t = tokens.agg(F.round(F.avg("tokens"), 2).alias("mean_tokens"), F.count("*").alias("n_queries"))
    return m.crossJoin(F.broadcast(t))


def majority(votes: DataFrame, item: str, least: int = 2) -> DataFrame:
    """(item, passed, score, reasons): passed with `least` votes or more; score is the mean of all votes."""
    return votes.groupBy(item).agg((F.count_if("passed") >= least).alias("passed"), F.round(F.avg("score"), 6).alias("score"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("judge", "reason"))), lambda x: x["reason"]), " | ").alias("reasons"))


def agreement(verdicts: DataFrame) -> DataFrame:
    """Share of labelled rows (verdict, label) that agree; rows with an empty label don't count."""
    x = verdicts.where(F.coalesce("label", F.lit("")) != "")
    return x.agg(F.count("*").alias("n"), F.count_if(F.col("verdict") != F.col("label")).alias("n_wrong"), F.round(F.avg((F.col("verdict") == F.col("label")).cast("int")), 6).alias("agreement"))


def verdict_summary(rows: DataFrame, by: list[str]) -> DataFrame:
    """Counts by verdict; what neither passed nor failed abstained; the pass rate is of all rows."""
    n, p, f = F.count("*"), F.count_if(F.col("verdict") == "pass"), F.count_if(F.col("verdict") == "fail")
    return rows.groupBy(*by).agg(n.alias("n"), p.alias("n_pass"), f.alias("n_fail"), (n - p - f).alias("n_abstained"), F.round(p / n, 4).alias("pass_rate"), F.round(F.avg("score"), 4).alias("mean_score"))


def sweep(runs: DataFrame, base: dict[str, object], metric: str) -> DataFrame:
    """(dimension, value, run_id, metric, delta, is_base): runs that differ from the base in one dimension, and the base in each."""
    lits = {d: F.lit(base[d]) for d in DIMENSIONS}
    out = None
    base_metric = runs.where(F.col("run_id") == run_id(*[lits[d] for d in ("corpus", "cap", "extras", "embedding", "search", "k", "rerank")])).agg(F.max(metric).alias("_base"))
    for i, d in enumerate(DIMENSIONS):
        changed = lits | {d: F.col(d)}
        wanted = run_id(*[changed[x] for x in ("corpus", "cap", "extras", "embedding", "search", "k", "rerank")])
        x = runs.where(F.col("run_id") == wanted).select(F.lit(i).alias("place"), F.lit(d).alias("dimension"), F.col(d).cast("string").alias("value"), "run_id", metric, (F.col(d) == lits[d]).alias("is_base"))
        out = x if out is None else out.unionByName(x)
    return out.crossJoin(F.broadcast(base_metric)).withColumn("delta", F.round(F.col(metric) - F.col("_base"), 4)).drop("_base")


def runs_on_base(generation: DataFrame, base: str) -> DataFrame:
    """Generation runs on one retrieval run, best pass rate first."""
    return generation.where(F.col("run_id") == F.concat(F.lit(base + "-"), F.col("model"))).orderBy(F.desc("pass_rate"), "model")


def summary_rows(retrieval: DataFrame, generation: DataFrame) -> DataFrame:
    """Both kinds of runs over the union of their columns; a missing rerank is off."""
    x = retrieval.unionByName(generation, allowMissingColumns=True)
    return x.withColumn("rerank", F.coalesce("rerank", F.lit(False))) if "rerank" in x.columns else x


def column_maxima(rows: DataFrame, metrics: list[str]) -> DataFrame:
    """Adds is_max_<metric>: whether the row has the largest value of all rows."""
    best = rows.agg(*[F.max(m).alias(f"_{m}") for m in metrics])
    x = rows.crossJoin(F.broadcast(best))
    return x.withColumns({f"is_max_{m}": F.coalesce(F.col(m) == F.col(f"_{m}"), F.lit(False)) for m in metrics}).drop(*[f"_{m}" for m in metrics])


def markdown_row(cells: list[Column]) -> Column:
    return F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))


def ranks(rows: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(W.partitionBy(*by).orderBy(*order)))


def differences(old: DataFrame, new: DataFrame) -> DataFrame:
    """Rows that only one of two tables has, with side "-" or "+"."""
    return old.exceptAll(new).withColumn("side", F.lit("-")).unionByName(new.exceptAll(old).withColumn("side", F.lit("+")))
