"""The corpus pipeline: quality, near duplicates, repeated passages, benchmark passages, and the mix of sources.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written
and read again as the next stage's docs.  The first four return documents with
the columns that they came with.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import decontaminate, jaccard, mixing, quality_model, substring_dedup
from tessera.llm.common import Tables


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps what the quality classifier accepts.

    Null or empty text is scored as a text of no words; whole texts of any
    length are read; repeated rows are judged alike; null source or lang is a
    site of its own; an empty table stays empty; extra columns pass through.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality_model.score_documents(docs, labels).where("accepted").select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest doc_id of each component: shingles of five words, similarity of 0.8.

    Rows that repeat a doc_id: one stays.  Rows without doc_id, and those
    without words, all stay, as they are like nothing.  Extra columns pass through.
    """
    return jaccard.one_of_each(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes 50-word passages that a smaller doc_id has, and documents of which nothing is left; n_chars follows the text.

    A removed word goes with the blanks after it; line ends elsewhere stay.
    Null and empty texts, and texts of fewer words, stay as they are; rows of
    one doc_id do not remove each other's passages; null doc_ids come last.
    """
    found = substring_dedup.dedup_words(docs, with_text=True)
    kept = found.where("n_removed < n_symbols or n_symbols = 0")
    text = F.col("kept_text")
    made = {"text": text, "n_chars": F.when(F.col("n_removed") > 0, F.length(text).cast("long")).otherwise(F.col("row.n_chars"))}
    return kept.select(*[made[c].alias(c) if c in made else F.col(f"row.{c}").alias(c) for c in docs.columns])


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents with ten words in a row of a benchmark item, or all words of a shorter one.

    Null and empty texts have no words and stay; repeated rows are judged alike.
    """
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate.decontaminate(docs, benchmark).where(~F.col("contaminated")).select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the mix takes, with size, source_size, target and taken (words, repeats counted).

    Rows without words are never taken; a null source is one of its own; ties
    are settled by all columns; an empty table stays empty.
    """
    return mixing.mix(docs).where("taken > 0")


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("benchmark_passages", benchmark_passages),
    ("mix", mix),
]

#: The first three stages can't be put into SQL; tests hold them against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table documents, each written and read again; a stage's table goes when the next one's is written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    with Tables(spark) as tables:
        for i, (_, stage) in enumerate(STAGES):
            before, docs = docs, tables.write(stage(spark, docs, sf_dir), keep=i == len(STAGES) - 1)
            if i:
                tables.drop(before)
    return docs
