"""Mixing sources to target weights by capped water-filling.  DataFrame functions only.

Each source asks for its share, by weight, of a budget of words.  No source may
be repeated more than `max_epochs` times, so sources whose share is above that
stop there and the excess goes to the others, by weight, until none is above.
Then each source repeats all of its documents as many whole times as its target
asks for, and a seeded part of them once more for the fraction that is left.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import blocked_running, n_words, row_key

#: A source's documents are dealt out to so many blocks (hex digits of the seeded order), so that none holds a large source.
BLOCK_DIGITS = 3


def targets(sizes: DataFrame, weights: Sequence[int], budget: tuple[int, int], max_epochs: int) -> DataFrame:
    """Rows (source, source_size, target) from rows (source, source_size).

    Sources in order of code points, null last, weigh weights[0], weights[1], ...
    and again from the first.  budget is a fraction (a, b) of all sizes.  A
    source of size 0 has target 0.  One row a source goes through the windows
    here: a mix has a table of weights by source, which is small beside any table of documents.
    """
    by_name, everything = W.orderBy(F.col("source").asc_nulls_last()), W.partitionBy()
    a, b = budget
    x = sizes.withColumn("rank", F.row_number().over(by_name) - 1)
    x = x.withColumn("weight", F.get(F.array(*[F.lit(int(w)) for w in weights]), F.col("rank") % len(weights)).cast("long"))
    x = x.withColumn("cap", F.col("source_size") * max_epochs)
    x = x.select("*", F.sum("cap").over(everything).alias("caps"), F.sum("weight").over(everything).alias("weights"), F.sum("source_size").over(everything).alias("total"))
    # by cap / weight, the first ones are full; a source is full if the level without the full ones before it reaches its cap
    level = W.orderBy((F.col("cap") / F.col("weight")).asc(), F.col("rank")).rowsBetween(W.unboundedPreceding, -1)
    x = x.select("*", F.coalesce(F.sum("cap").over(level), F.lit(0)).alias("caps_before"), F.coalesce(F.sum("weight").over(level), F.lit(0)).alias("weights_before"))
    x = x.withColumn("full", F.col("cap") * b * (F.col("weights") - F.col("weights_before")) <= F.col("weight") * (F.col("total") * a - F.col("caps_before") * b))
    x = x.select("*", F.sum(F.when(F.col("full"), F.col("cap")).otherwise(0)).over(everything).alias("caps_full"), F.sum(F.when(F.col("full"), 0).otherwise(F.col("weight"))).over(everything).alias("weights_free"))
    share = (F.col("weight") * (F.col("total") * a - F.col("caps_full") * b)).cast("double") / (F.col("weights_free") * b).cast("double")
    return x.select("source", "source_size", F.when(F.col("full"), F.col("cap").cast("double")).otherwise(share).alias("target"))


def mix(docs: DataFrame, weights: Sequence[int] = (5, 2, 1), budget: tuple[int, int] = (3, 2), max_epochs: int = 2, seed: int = 42, size: Column | None = None, text_key: Column | None = None) -> DataFrame:
    """Adds size, source_size, target and taken to each row of docs (doc_id, text, source, ...).

    taken is the number of words the mix takes of the row, repeats counted: a
    multiple of its size.  The rows of a source stand in a seeded order, by MD5
    of the seed, doc_id and MD5 of the text, then by the hash of all columns;
    those whose middle word comes before the fraction of the source's words are
    repeated once more, so a source's sum differs from its target by less than
    one document.  Equal input gives equal output, however it is partitioned:
    rows that still tie are equal in all columns.  size and text_key stand for
    the text where docs come without it.

    Null text: size 0, taken 0.  Null source: a source of its own, ranked last.
    Null doc_id: ordered as the text "null", spread by their texts.  Repeated
    rows count each.  A text of any length is one row, taken whole or not.
    Empty input: empty output.  All columns stay but those named like an added one.
    """
    kept = [c for c in docs.columns if c not in ("size", "source_size", "target", "taken")]
    size = n_words(docs["text"]) if size is None else size
    text_key = F.md5(F.coalesce(docs["text"], F.lit(""))) if text_key is None else text_key
    order = F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(docs["doc_id"].cast("string"), F.lit("null")), text_key))
    rows = docs.select(F.struct(*[docs[c] for c in kept]).alias("_row"), docs["source"].alias("_source"), size.alias("_size"), order.alias("_order"), row_key(*[docs[c] for c in kept]).alias("_tie"))
    rows = rows.withColumn("_block", F.substring("_order", 1, BLOCK_DIGITS))
    sizes = rows.groupBy(F.col("_source").alias("source")).agg(F.sum("_size").alias("source_size"))
    goal = targets(sizes, weights, budget, max_epochs).withColumnRenamed("source", "_of")
    rows = blocked_running(rows, ["_source"], "_block", [F.col("_order"), F.col("_size"), F.col("_tie")], {"_upto": F.col("_size")})
    rows = rows.join(F.broadcast(goal) if goal.count() <= 100_000 else goal, F.col("_source").eqNullSafe(F.col("_of")))
    epochs = F.col("target") / F.greatest(F.col("source_size"), F.lit(1))
    whole = F.floor(epochs)
    # the middle of the row's words, doubled to stay whole
    middle = F.col("_upto") * 2 - F.col("_size")
    more = middle.cast("double") < (F.col("target") - whole.cast("double") * F.col("source_size").cast("double")) * F.lit(2.0)
    taken = F.when(F.col("_size") > 0, F.col("_size") * (whole + more.cast("long"))).otherwise(F.lit(0)).cast("long")
    return rows.select("_row.*", F.col("_size").alias("size"), "source_size", "target", taken.alias("taken"))
