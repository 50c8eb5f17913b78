"""Incremental enrichment: parent texts, what has to be made anew, and the merged cache."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as X

#: Characters of one part of a parent document.
PART_CHARS = 1_000_000


def parent_parts(sections: DataFrame, parent: list[str], page: str, order: str, text: str, size: int = PART_CHARS) -> DataFrame:
    """(parent, part, text): the prose of each parent document in the order of pages, as it came within one, in parts.

    A part ends with the section that takes it over `size` characters, so no
    parent has to fit into a string or a task: lengths before a section are
    summed up within its page, and page by page.  Pages that are null count as 0.
    """
    x = sections.withColumns({"_page": F.coalesce(page, F.lit(0)), "_length": F.coalesce(F.length(text), F.lit(0)).cast("long")})
    keys = [*parent, "_page"]
    totals = x.groupBy(*keys).agg(F.sum("_length").alias("_total"))
    before = F.sum("_total").over(W.partitionBy(*parent).orderBy("_page").rowsBetween(W.unboundedPreceding, -1))
    totals = totals.select(*[F.col(k).alias(f"_of{i}") for i, k in enumerate(keys)], F.coalesce(before, F.lit(0)).alias("_before"))
    inside = F.sum("_length").over(W.partitionBy(*keys).orderBy(order).rowsBetween(W.unboundedPreceding, -1))
    x = x.withColumn("_inside", F.coalesce(inside, F.lit(0)))
    on = [F.col(k).eqNullSafe(F.col(f"_of{i}")) for i, k in enumerate(keys)]
    x = x.join(totals, on).withColumn("part", F.floor((F.col("_before") + F.col("_inside")) / size))
    return x.groupBy(*parent, "part").agg(X.joined(F.struct("_page", F.col(order)), F.col(text), "\n\n").alias("text"))


def same_parent(a: DataFrame, b: DataFrame, columns: list[str]) -> Column:
    """Join condition: nulls are equal to each other, as one of chapter and file is always null."""
    cond = F.lit(True)
    for c in columns:
        cond = cond & a[c].eqNullSafe(b[c])
    return cond


def newest(cache: DataFrame, order: str) -> DataFrame:
    """The last row of each id."""
    return cache.withColumn("_r", F.row_number().over(W.partitionBy("id").orderBy(F.desc(order)))).where("_r = 1").drop("_r")


def to_enrich(chunks: DataFrame, cache: DataFrame, order: str) -> DataFrame:
    """Chunks whose newest cached row is missing or was made from another text."""
    return chunks.join(newest(cache, order).select("id", "fingerprint"), ["id", "fingerprint"], "left_anti")


def merged(chunks: DataFrame, cache: DataFrame, made: DataFrame, order: str) -> DataFrame:
    """The newest row of each id that still has a chunk; what was just made comes last."""
    return newest(cache.unionByName(made), order).join(chunks.select("id"), "id", "left_semi")


def valid_questions(q: Column) -> Column:
    """Three to five different questions, none blank."""
    return F.coalesce((F.size(q) >= 3) & (F.size(q) <= 5) & (F.size(F.array_distinct(q)) == F.size(q)) & F.forall(q, lambda x: X.strip(x) != ""), F.lit(False))


def valid_context(context: Column, cap: int = 100) -> Column:
    return F.coalesce((X.strip(context) != "") & (X.n_words(context) <= cap), F.lit(False))


def enrichment_of(chunks: DataFrame, enrichment: DataFrame) -> DataFrame:
    """Enrichment of the chunks of one corpus."""
    return enrichment.join(chunks.select("id"), "id", "left_semi")


def made_valid(rows: DataFrame, make, valid, value: str, prompt: str = "prompt", reminder: str = "\n\nThe last answer did not keep to the rules.") -> DataFrame:
    """Adds value = make(prompt), made once more, with a reminder, for rows where valid(value) is false; ok tells whether it is valid now."""
    x = rows.withColumn(value, make(F.col(prompt)))
    good, bad = x.where(valid(F.col(value))), x.where(~valid(F.col(value)))
    again = bad.withColumn(value, make(F.concat(F.col(prompt), F.lit(reminder))))
    return good.withColumn("ok", F.lit(True)).unionByName(again.withColumn("ok", valid(F.col(value))))


def require_made(rows: DataFrame, key: str) -> DataFrame:
    """rows without ok, or an error with some ids that stayed invalid."""
    bad = [r[key] for r in rows.where(~F.col("ok")).select(key).orderBy(key).limit(5).collect()]
    if bad:
        raise ValueError(f"not valid after a second attempt: {bad}")
    return rows.drop("ok")


def parsed_questions(answer: Column) -> Column:
    """Questions of a JSON array, stripped; none if it doesn't parse."""
    found = F.from_json(answer, "array<string>")
    return F.coalesce(F.filter(F.transform(found, X.strip), lambda x: x.isNotNull() & (x != "")), F.array().cast("array<string>"))
