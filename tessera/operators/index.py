"""Index rows: base, with context, and by hypothetical questions; their vectors; names of collections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Names of collections and of runs.
COLLECTION, RUN = "{corpus}-{cap}-{extras}-{embedding}", "{corpus}-{cap}-{extras}-{embedding}-{search}-k{k}"


def of_corpus(rows: DataFrame, corpus: str, column: str = "corpus") -> DataFrame:
    """Rows of one corpus; "combined" is all of them."""
    return rows if corpus == "combined" else rows.where(F.col(column) == corpus)


def missing_enrichment(chunks: DataFrame, enrichment: DataFrame) -> DataFrame:
    return chunks.join(enrichment.select("id"), "id", "left_anti")


def require_enriched(chunks: DataFrame, enrichment: DataFrame) -> DataFrame:
    """chunks, or an error with the first five ids that have no enrichment."""
    bad = [r["id"] for r in missing_enrichment(chunks, enrichment).select("id").orderBy("id").limit(5).collect()]
    if bad:
        raise ValueError(f"without enrichment: {bad}")
    return chunks


def base_rows(chunks: DataFrame) -> DataFrame:
    return chunks.select(F.col("id").alias("row_id"), F.lit("chunk").alias("entry_type"), F.col("text").alias("document"), F.col("text").alias("embed_text"), F.lit(None).cast("string").alias("parent_id"))


def contextual_rows(chunks: DataFrame, enrichment: DataFrame) -> DataFrame:
    """The document stays the chunk's text; what is embedded begins with its context."""
    x = enrichment.join(chunks, "id")
    return x.select(F.col("id").alias("row_id"), F.lit("chunk").alias("entry_type"), F.col("text").alias("document"), F.concat("context", F.lit("\n\n"), "text").alias("embed_text"), F.lit(None).cast("string").alias("parent_id"))


def question_rows(chunks: DataFrame, enrichment: DataFrame) -> DataFrame:
    """One row a question: it is embedded, the document is the parent's text."""
    x = enrichment.select("id", F.posexplode("questions").alias("i", "question")).join(chunks, "id")
    return x.select(F.format_string("%s::hype::%d", "id", "i").alias("row_id"), F.lit("hype").alias("entry_type"), F.col("text").alias("document"), F.col("question").alias("embed_text"), F.col("id").alias("parent_id"))


def hype_rows(chunks: DataFrame, enrichment: DataFrame) -> DataFrame:
    return contextual_rows(chunks, enrichment).unionByName(question_rows(chunks, enrichment))


def metadata(columns: list[str]) -> Column:
    """A map of the columns that aren't null, as strings."""
    pairs = F.create_map(*[x for c in columns for x in (F.lit(c), F.col(c).cast("string"))])
    return F.map_filter(pairs, lambda _, v: v.isNotNull())


def embed_once(rows: DataFrame, embed) -> DataFrame:
    """Adds vector: each different embed_text goes through embed (Column -> Column) once and is joined back by its SHA-256; null stays without a vector."""
    x = rows.withColumn("_f", F.unhex(F.sha2("embed_text", 256)))
    vectors = x.where("_f is not null").groupBy("_f").agg(F.any_value("embed_text").alias("embed_text")).select("_f", embed(F.col("embed_text")).alias("vector"))
    return x.join(vectors, "_f", "left").drop("_f")


def collection_name(*parts: Column) -> Column:
    return F.concat_ws("-", *parts)


def run_id(corpus: Column, cap: Column, extras: Column, embedding: Column, search: Column, k: Column, rerank: Column) -> Column:
    """config.run_name() of columns."""
    parts = {"corpus": corpus, "cap": cap.cast("string"), "extras": extras, "embedding": embedding, "search": search, "k": k.cast("string")}
    name = F.format_string(RUN.format(**dict.fromkeys(parts, "%s")), *parts.values())
    return F.concat(name, F.when(F.coalesce(rerank, F.lit(False)), F.lit("-rerank")).otherwise(F.lit("")))
