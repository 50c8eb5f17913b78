"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Separators of words: space and the control characters from tab to carriage return.
BLANK = r"[\x20\x09-\x0D]+"
#: Each of these is such a separator; for translate().
BLANKS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lower_ascii(c: Column) -> Column:
    """Lower-cases A-Z and nothing else."""
    return F.translate(c, UPPER, LOWER)


def words(text: Column) -> Column:
    """The words [^\\x20\\x09-\\x0D]+ of a text; none for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), BLANK), lambda x: x != "")


def let(value: Column, body) -> Column:
    """body(value) with value evaluated once: what a lambda refers to is otherwise evaluated again for each element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def n_words(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def row_key(*columns: Column) -> Column:
    """A 64-bit key that rows with the same values share; nulls count as a value."""
    parts = [x for c in columns for x in (c.isNull(), c)]
    return F.xxhash64(*parts)


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir.  Only a session on one machine, as in tests, may do without: it gets a temporary one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = getattr(shared_dir, "made", None) or tempfile.mkdtemp(prefix="tessera-")
        shared_dir.made = found
    return found


class Tables:
    """Tables in the shared folder, each of which cuts the lineage.

    Used in a with statement: what was written and not dropped before goes at
    its end, but for tables that were written with keep=True, which hold a
    result that is read later.  Drop a table only when all that is made from it
    is written.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, {}

    def write(self, df: DataFrame, keep: bool = False) -> DataFrame:
        """Writes df and reads it: the plan starts anew there."""
        path = f"{shared_dir(self.spark)}/table-{uuid.uuid4().hex}"
        df.write.parquet(path)
        read = self.spark.read.schema(df.schema).parquet(path)
        if not keep:
            self.paths[id(read)] = (read, path)
        return read

    def drop(self, *tables: DataFrame) -> None:
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for t in tables:
            _, path = self.paths.pop(id(t))
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(conf).delete(at, True)

    def __enter__(self) -> Tables:
        return self

    def __exit__(self, *failure: object) -> None:
        self.drop(*[t for t, _ in list(self.paths.values())])


def cut(df: DataFrame) -> DataFrame:
    """df written as a table that stays, and read again."""
    return Tables(df.sparkSession).write(df, keep=True)


def small(df: DataFrame, max_rows: int) -> DataFrame:
    """df with a broadcast hint if it has at most max_rows rows, which are counted; else df, for a shuffled join."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def blocked_running(df: DataFrame, keys: list[str], block: str, order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """Running sums over each key's rows by (block, order), with no key's rows in one task.

    A window runs inside each (key, block); the totals of the blocks before come
    from a second, far smaller window over one row for each block.  Adds, for
    each name of sums, the sum of the rows up to and including this one.
    """
    inner = W.partitionBy(*keys, block).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    before = W.partitionBy(*keys).orderBy(block).rowsBetween(W.unboundedPreceding, -1)
    totals = df.groupBy(*keys, block).agg(*[F.sum(c).alias(n) for n, c in sums.items()])
    totals = totals.select(*[F.col(k).alias(f"_{k}") for k in [*keys, block]], *[F.coalesce(F.sum(n).over(before), F.lit(0)).alias(f"_{n}") for n in sums])
    inside = df.select("*", *[F.sum(c).over(inner).alias(n) for n, c in sums.items()])
    on = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in [*keys, block]]
    return inside.join(totals, on).select(*df.columns, *[(F.col(n) + F.col(f"_{n}")).alias(n) for n in sums])
