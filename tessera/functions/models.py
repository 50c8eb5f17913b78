"""Model callables and their deterministic offline stand-ins.

A model is a function from a Column to a Column.  batched() makes one of a
Python function on lists of texts; it loads once a worker and retries.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import text as X

#: Attempts of a model call, and seconds of waiting for each attempt so far.
ATTEMPTS, WAIT_S = 3, 5.0
LETTERS = "abcdefghijklmnopqrstuvwxyz"


def with_retry(call: Callable, *args, attempts: int = ATTEMPTS, wait_s: float = WAIT_S):
    """call(*args), tried again after a wait; the last error is raised."""
    for i in range(1, attempts + 1):
        try:
            return call(*args)
        except Exception:
            if i == attempts:
                raise
            time.sleep(wait_s * i)


def batched(load: Callable[[], Callable[[list[str]], list]], kind: T.DataType, attempts: int = ATTEMPTS, wait_s: float = WAIT_S) -> Callable[[Column], Column]:
    """A model as a column function: load() makes the callable once for each task, which then gets lists of texts."""

    @F.pandas_udf(kind)
    def run(series: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for s in series:
            yield pd.Series(with_retry(model, s.fillna("").tolist(), attempts=attempts, wait_s=wait_s))

    return lambda c: run(c)


@F.pandas_udf(T.ArrayType(T.FloatType()))
def _letters(texts: pd.Series) -> pd.Series:
    first, last = ord(LETTERS[0]), ord(LETTERS[-1])
    return texts.map(lambda t: None if t is None else np.bincount(np.frombuffer(t.lower().encode(), np.uint8), minlength=last + 1)[first : last + 1].astype(np.float32))


def letter_embedding(c: Column) -> Column:
    """Counts of the letters a-z: an embedding that SQL can make, too."""
    return _letters(c)


def template_context(title: Column) -> Column:
    return F.concat(F.lit("About "), title, F.lit("."))


def template_questions(title: Column) -> Column:
    return F.array(*[F.concat(F.lit(q), title, F.lit("?")) for q in ("What is ", "Where is ", "Why is ")])


def standalone_question(history: Column, question: Column) -> Column:
    """Condenses a follow-up: the last question asked before it, in brackets."""
    return F.concat(question, F.coalesce(F.concat(F.lit(" ("), F.get(history, F.size(history) - 1)["q"], F.lit(")")), F.lit("")))
