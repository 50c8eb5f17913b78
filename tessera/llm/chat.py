"""Chat formatting: logged snapshots that longer conversations continue are dropped, the rest rendered.  DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Tables, small

#: Turns of one conversation are dealt out to blocks of so many turn numbers.
BLOCK_TURNS = 256
#: A conversation and a block of it; no column is null, so that one exchange serves all that follows.
_CONV, _BLOCK = ["_null", "_conv"], ["_null", "_conv", "_block"]


def _hash(seed: int, *columns: Column) -> Column:
    # as decimals, so that sums neither wrap nor overflow: 2 ** 63 turns have room
    return F.xxhash64(F.lit(seed), *[y for c in columns for y in (c.isNull(), c)]).cast("decimal(20,0)")


def _before(rows: DataFrame, sums: dict[str, Column]) -> DataFrame:
    """(conversation, block, sums over the blocks before): one row a block goes through the window."""
    totals = rows.groupBy(*_BLOCK).agg(*[F.sum(c).alias(n) for n, c in sums.items()])
    before = W.partitionBy(*_CONV).orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    return totals.select(*_BLOCK, *[F.coalesce(F.sum(n).over(before), F.lit(0)).alias(f"_before_{n}") for n in sums])


def placed(turns: DataFrame) -> DataFrame:
    """Distinct turns with pos (1, 2, ...) in their conversation, and two hashes of place, role and text.

    The texts are shuffled once, to blocks of a conversation.
    """
    x = turns.select("conv_id", "turn", "role", "text")
    x = x.withColumns({"_null": F.col("conv_id").isNull(), "_conv": F.coalesce(F.col("conv_id").cast("string"), F.lit("")), "_block": F.coalesce(F.floor(F.col("turn") / BLOCK_TURNS), F.lit(-(2**62)))})
    by = W.partitionBy(*_BLOCK).orderBy(F.col("turn").asc_nulls_first(), F.col("role").asc_nulls_first(), F.col("text").asc_nulls_first())
    x = x.repartition(*_BLOCK).withColumn("_first", F.row_number().over(by) == 1)
    same = F.lag("turn").over(by).eqNullSafe(F.col("turn")) & F.lag("role").over(by).eqNullSafe(F.col("role")) & F.lag("text").over(by).eqNullSafe(F.col("text"))
    # of rows that repeat all four values the first counts
    x = x.withColumn("_new", (F.col("_first") | ~same).cast("int"))
    x = x.withColumn("_place", F.sum("_new").over(by.rowsBetween(W.unboundedPreceding, 0))).where("_new = 1")
    x = x.join(_before(x, {"n": F.lit(1)}), _BLOCK).withColumn("pos", (F.col("_place") + F.col("_before_n")).cast("int"))
    hashes = [_hash(k, F.col("pos"), F.col("role"), F.col("text")).alias(n) for k, n in ((1, "_a"), (2, "_b"))]
    return x.select("conv_id", *_BLOCK, "pos", "role", "text", *hashes)


def prefix_hashes(rows: DataFrame) -> DataFrame:
    """(conversation, pos, h1, h2) for rows of placed(): the rolling hash of a conversation up to each turn.

    The hash of a prefix is the sum over its turns, made block by block, so no
    conversation has to lie in one task.  Texts are not read.
    """
    x = rows.select("conv_id", *_BLOCK, "pos", "_a", "_b")
    inside = W.partitionBy(*_BLOCK).orderBy("pos").rowsBetween(W.unboundedPreceding, 0)
    x = x.join(_before(x, {"a": F.col("_a"), "b": F.col("_b")}), _BLOCK)
    return x.select("conv_id", *_CONV, "pos", (F.sum("_a").over(inside) + F.col("_before_a")).alias("h1"), (F.sum("_b").over(inside) + F.col("_before_b")).alias("h2"))


def maximal(turns: DataFrame) -> DataFrame:
    """Rows (conv_id, n_turns, n_copies) of the conversations that stay.

    A conversation goes if a longer one begins with all of its turns; of equal
    ones the least conv_id stays (n_copies counts them all).
    """
    with Tables(turns.sparkSession) as tables:
        kept = _maximal(tables, tables.write(placed(turns)))
        return Tables(turns.sparkSession).write(kept, keep=True).select("conv_id", "n_turns", "n_copies")


def _maximal(tables: Tables, rows: DataFrame) -> DataFrame:
    hashed = tables.write(prefix_hashes(rows))
    ends = hashed.groupBy(*_CONV).agg(F.max(F.struct("pos", "h1", "h2")).alias("_end"), F.first("conv_id").alias("conv_id")).select("conv_id", "_end.*")
    whole = ends.groupBy("pos", "h1", "h2").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_copies"))
    # a prefix that is not its conversation's end; counted in two numbers, so that a common first turn is summed up before the shuffle
    prefixes = hashed.groupBy("pos", "h1", "h2").agg(F.count("*").alias("_n"))
    longer = prefixes.join(whole, ["pos", "h1", "h2"]).where(F.col("_n") > F.col("n_copies")).select("pos", "h1", "h2")
    kept = whole.join(longer, ["pos", "h1", "h2"], "left_anti")
    return kept.select("conv_id", F.col("conv_id").isNull().alias("_null"), F.coalesce(F.col("conv_id").cast("string"), F.lit("")).alias("_conv"), F.col("pos").alias("n_turns"), "n_copies")


def render_turn(role: Column, text: Column) -> Column:
    """One turn in ChatML; a null role is "user", a null text is empty."""
    return F.concat(F.lit("<|im_start|>"), F.coalesce(role, F.lit("user")), F.lit("\n"), F.coalesce(text, F.lit("")), F.lit("<|im_end|>\n"))


def format_chats(turns: DataFrame) -> DataFrame:
    """Rows (conv_id, pos, n_turns, n_copies, rendered), one a turn, of the conversations that maximal() keeps.

    A row a turn, for a conversation may be of any length; as_texts() joins them.
    turns: (conv_id, turn, role, text) and any other columns, which are dropped.
    Turns stand by turn, null first, then role, then text, of any length.  Rows
    that repeat another's four values count once.  Null conv_id is a
    conversation of its own.  Empty input: empty output.
    """
    spark = turns.sparkSession
    # the texts are shuffled once and written once; all that is done with hashes reads other columns
    rows = Tables(spark).write(placed(turns), keep=True)
    with Tables(spark) as tables:
        kept = Tables(spark).write(_maximal(tables, rows).drop("conv_id"), keep=True)
    # a row of 40 bytes a conversation: counted, and joined by shuffle where there are very many
    x = rows.select("conv_id", *_CONV, "pos", "role", "text").join(small(kept, 1_000_000), _CONV)
    return x.select("conv_id", "pos", "n_turns", "n_copies", render_turn(F.col("role"), F.col("text")).alias("rendered"))


def as_texts(rendered: DataFrame) -> DataFrame:
    """One row (conv_id, n_turns, text) a conversation, for conversations that fit into a string."""
    parts = F.array_sort(F.collect_list(F.struct("pos", "rendered")))
    return rendered.groupBy("conv_id", "n_turns").agg(F.array_join(F.transform(parts, lambda p: p["rendered"]), "").alias("text"))
