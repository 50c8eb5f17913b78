"""From sections to chunks: runs of one document, merging of small sections, splitting at a cap, checks."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed value: a section of fewer tokens is merged.
SMALL = 50
#: Where a text is cut, the best first; "" is between characters.
SEPARATORS = ("\n\n", "\n", " ", "")


def contiguous_runs(rows: DataFrame, within: list[str], order: list[str], key: Column) -> DataFrame:
    """Adds run: neighbours in order with the same key have the same number; a key that comes back has another."""
    by = W.partitionBy(*within).orderBy(*order) if within else W.orderBy(*order)
    x = rows.withColumn("_k", key)
    before, first = F.lag("_k").over(by), F.row_number().over(by) == 1
    return x.withColumn("_new", (first | ~F.col("_k").eqNullSafe(before)).cast("int")).withColumn("run", F.sum("_new").over(by.rowsBetween(W.unboundedPreceding, 0))).drop("_k", "_new")


def merge_small(sections: DataFrame, run: list[str], order: str, tokens: str, least: int = SMALL) -> DataFrame:
    """Adds group to sections of each run: small ones join the group before; a small first group joins the next."""
    by = W.partitionBy(*run).orderBy(order)
    opens = (F.row_number().over(by) == 1) | (F.col(tokens) >= least)
    x = sections.withColumn("_o", opens.cast("int")).withColumn("_g", F.sum("_o").over(by.rowsBetween(W.unboundedPreceding, 0)))
    whole = W.partitionBy(*run)
    head, last = F.sum(F.when(F.col("_g") == 1, F.col(tokens)).otherwise(0)).over(whole), F.max("_g").over(whole)
    return x.withColumn("group", F.when((head < least) & (last > 1), F.greatest("_g", F.lit(2))).otherwise(F.col("_g"))).drop("_o", "_g")


def chunk_rows(grouped: DataFrame, run: list[str], order: str) -> DataFrame:
    """One row a group: fields of its first section, page_end from its last, all section ids in order."""
    parts = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col("section_id").alias("s"), F.col("text").alias("t"))))
    x = grouped.groupBy(*run, "group").agg(
        F.min_by("title", order).alias("title"),
        *[F.min_by(c, order).alias(c) for c in ("corpus", "kind", "file", "chapter") if c in grouped.columns],
        F.min_by("page", order).alias("page"),
        F.max_by("page", order).alias("page_end"),
        F.sum("n_tokens").alias("n_tokens"),
        parts.alias("_p"),
    )
    x = x.withColumns({"section_ids": F.transform("_p", lambda p: p["s"]), "text": F.array_join(F.transform("_p", lambda p: p["t"]), "\n\n")})
    return x.withColumn("chunk_id", chunk_id(F.col("section_ids"))).drop("_p")


def chunk_id(section_ids: Column, part: Column | None = None, n_parts: Column | None = None) -> Column:
    """Section ids joined by |, and #i for part i of several."""
    base = F.concat_ws("|", section_ids)
    return base if part is None else F.concat(base, F.when(n_parts > 1, F.concat(F.lit("#"), part.cast("string"))).otherwise(F.lit("")))


def words_of(text: str) -> int:
    return len(text.split())


def recursive_split(text: str, cap: int, count: Callable[[str], int] = words_of, separators: tuple[str, ...] = SEPARATORS) -> list[str]:
    """Pieces of at most cap tokens, without overlap, stripped.

    The text is cut before each of the first separator that it has; a separator
    stays with what it opens.  Neighbours that are each below the cap are joined
    while the sum of their tokens is within it; a longer one is cut at the
    separators that are left, and stays whole if there are none.
    """
    if not text.strip():
        return []
    cut, finer = "", ()
    for i, s in enumerate(separators):
        if s and s in text:
            cut, finer = s, separators[i + 1 :]
            break
    first, *more = text.split(cut) if cut else (text[:1], *text[1:])
    out, held, n_held = [], "", 0
    for p in (p for p in (first, *(cut + m for m in more)) if p):
        n = count(p)
        if held and (n >= cap or n_held + n > cap):
            out.append(held)
            held, n_held = "", 0
        if n < cap:
            held, n_held = held + p, n_held + n
        elif finer:
            out += recursive_split(p, cap, count, finer)
        else:
            out.append(p)
    return [x.strip() for x in (*out, held) if x.strip()]


def split_at_cap(chunks: DataFrame, cap: int, count: Callable[[str], int] = words_of) -> DataFrame:
    """Explodes chunks (section_ids, text, ...) into parts of at most cap tokens, with chunk_id and part.

    A text within the cap stays as it is.  Where to cut depends on a tokenizer,
    so it is a pandas UDF on whole columns.
    """

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def pieces(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [t] if t and count(t) <= cap else recursive_split(t or "", cap, count))

    x = chunks.withColumn("_parts", pieces("text")).withColumn("n_parts", F.size("_parts"))
    x = x.select(*[c for c in x.columns if c not in ("_parts", "text")], F.posexplode("_parts").alias("part", "text"))
    return x.withColumn("chunk_id", chunk_id(F.col("section_ids"), F.col("part"), F.col("n_parts")))


def repeated_ids(rows: DataFrame, key: str) -> DataFrame:
    return rows.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")


def require_unique(rows: DataFrame, key: str) -> DataFrame:
    """rows, or an error that lists some ids that repeat."""
    bad = [r[key] for r in repeated_ids(rows, key).orderBy(key).limit(20).collect()]
    if bad:
        raise ValueError(f"repeated ids: {bad}")
    return rows


def require_cap(rows: DataFrame, tokens: str, cap: int) -> DataFrame:
    """rows, or an error if one is over the cap, before anything is written."""
    worst = rows.where(F.col(tokens) > cap).limit(1).collect()
    if worst:
        raise ValueError(f"over the cap of {cap}: {worst[0].asDict()}")
    return rows


def prose(rows: DataFrame, kind: str = "kind") -> DataFrame:
    """Prose sections; pointers to tables are neither merged nor indexed."""
    return rows.where(F.col(kind) == "prosa")


def review_key(corpus: Column, chapter: Column) -> Column:
    """What a chunk is reviewed with: the notes together, the manual by chapter."""
    return F.when(corpus == "apuntes", F.lit("apuntes")).otherwise(F.format_string("cap-%02d", chapter))


def review_lines(chunks: DataFrame, order: list[str]) -> DataFrame:
    """(review, ord, line): the markdown of each review, one row a line, so that no review has to fit into a string.

    chunks: (corpus, chapter, chunk_id, title, text, n_tokens, ...).
    """
    lines = F.flatten(F.array(F.array(F.concat(F.lit("## "), "chunk_id", F.lit(" · "), F.coalesce("title", F.lit(""))), F.concat(F.lit("*"), F.col("n_tokens").cast("string"), F.lit(" tokens*")), F.lit("")), F.split("text", "\n"), F.array(F.lit(""))))
    return chunks.select(review_key(F.col("corpus"), F.col("chapter")).alias("review"), *order, F.posexplode(lines).alias("ord", "line"))


def write_chunks(chunks: DataFrame, path: str, key: str, tokens: str, cap: int) -> DataFrame:
    """Writes chunks, by corpus, only if no id repeats and none is over the cap; returns what was written."""
    require_cap(require_unique(chunks, key), tokens, cap).write.partitionBy("corpus").parquet(path)
    return chunks.sparkSession.read.parquet(path)
