"""Numbers, dates and labels as text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def decimals(c: Column, n: int = 4) -> Column:
    """Ties go to the even digit."""
    return F.format_string(f"%.{n}f", F.bround(c.cast("double"), n))


def signed(c: Column, n: int = 4) -> Column:
    """With a sign; null is blank, as for what has nothing to be compared with."""
    return F.when(c.isNull(), F.lit("")).otherwise(F.format_string(f"%+.{n}f", F.bround(c.cast("double"), n)))


def percent(c: Column, n: int = 1) -> Column:
    return F.format_string(f"%.{n}f%%", F.bround(c.cast("double") * 100, n))


def two_digits(prefix: str, c: Column) -> Column:
    return F.format_string(f"{prefix}%02d", c.cast("int"))


def run_stamp(c: Column) -> Column:
    """The name of a run's log: its date and time."""
    return F.date_format(c, "yyyyMMdd-HHmmss")
