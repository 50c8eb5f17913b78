"""A cache of vectors by model and text, and the writers of a corpus and its enrichment."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import exists


def cached_vectors(spark: SparkSession, path: str) -> DataFrame:
    """(model, text, vector) of all complete parts of a cache; each text once a model."""
    if not exists(spark, path):
        return spark.createDataFrame([], "model string, text string, vector array<float>")
    return spark.read.schema("model string, text string, vector array<float>").parquet(f"{path}/part-of-cache=*").dropDuplicates(["model", "text"])


def missing_texts(texts: DataFrame, cache: DataFrame, model: str) -> DataFrame:
    """Distinct texts (text) that a model has no vector of."""
    return texts.select("text").where("text is not null").distinct().join(cache.where(F.col("model") == model).select("text"), "text", "left_anti")


def ensure_vectors(texts: DataFrame, path: str, model: str, embed: Callable[[Column], Column], parts: int = 1) -> DataFrame:
    """(text, vector) of all texts; what is missing is embedded and appended first.

    Each of `parts` parts is a folder of its own, and a folder counts once Spark
    has committed it: what a broken run had embedded is there for the next one.
    """
    spark = texts.sparkSession
    for i in range(parts):
        new = missing_texts(texts, cached_vectors(spark, path), model).where(F.pmod(F.xxhash64("text"), F.lit(parts)) == i)
        if not new.isEmpty():
            new.select(F.lit(model).alias("model"), "text", embed(F.col("text")).alias("vector")).write.parquet(f"{path}/part-of-cache={uuid.uuid4().hex}")
    wanted = texts.select("text").distinct()
    return cached_vectors(spark, path).where(F.col("model") == model).join(wanted, "text", "left_semi").select("text", "vector")


def write_corpus(notes: DataFrame, manual: DataFrame, path: str) -> None:
    """Writes sections as JSON lines in order, notes first, then the manual by chapter; ord keeps the order for readers."""
    order = F.struct(F.col("_part"), F.coalesce("chapter", F.lit(0)).alias("c"), F.col("ord").alias("o"))
    x = notes.withColumn("_part", F.lit(0)).unionByName(manual.withColumn("_part", F.lit(1)))
    x.select(order.alias("ord"), *[c for c in x.columns if c not in ("_part", "ord")]).sort("ord").write.json(path)


def append_enrichment(made: DataFrame, staging: str) -> None:
    """Appends what was just made; n tells later rows of an id from earlier ones."""
    made.write.mode("append").parquet(staging)


def finish_enrichment(chunks: DataFrame, staging: str, path: str) -> None:
    """Writes the newest row of each id that still has a chunk, by id; a reader sees the old rows or the new."""
    from ..operators.enrich import newest

    rows = newest(chunks.sparkSession.read.parquet(staging), "n").join(chunks.select("id"), "id", "left_semi").drop("n")
    rows.sort("id").write.mode("overwrite").parquet(path)
