"""Answering: prompts, the number guardrail, one retry and then abstention, and turns of a dialogue."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X

#: What a model says to abstain, and the turns that a follow-up question may refer to.
SENTINEL, LAST_TURNS = "ABSTENER", 3
ABSTAINED = "No answer can be given from the sources."
WARNING = "\n\nA number in the last answer is not in the sources. Use only numbers that are."


def prompt(rank: Column, corpus: Column, title: Column, item: Column, text: Column, question: Column) -> Column:
    """Aggregate: blocks [corpus · title] and text by rank, then the question."""
    block = F.concat(F.lit("["), F.coalesce(corpus, F.lit("?")), F.lit(" · "), F.coalesce(title, item), F.lit("]\n"), text)
    return F.concat(X.joined(rank, block, "\n\n"), F.lit("\n\n"), F.first(question))


def allowed_pairs(constants: DataFrame) -> DataFrame:
    """Distinct (number, unit), canonical, of rows (number, unit)."""
    return constants.select(X.canonical_number(F.col("number").cast("string")).alias("number"), X.canonical_unit(F.col("unit")).alias("unit")).distinct()


def unknown_pairs(answers: DataFrame, text: Column, key: str, allowed: DataFrame) -> DataFrame:
    """(key, number, unit) of pairs in the text that are not allowed."""
    pairs = answers.select(key, F.explode(X.unit_pairs(text)).alias("p")).select(key, "p.number", "p.unit")
    return pairs.join(allowed, ["number", "unit"], "left_anti").select(key, "number", "unit")


def verify(answers: DataFrame, text: Column, key: str, allowed: DataFrame) -> DataFrame:
    """Adds verdict: "retry" if some number with a known unit is not allowed, else "ok"."""
    bad = unknown_pairs(answers, text, key, allowed).select(F.col(key).alias("_bad")).distinct()
    x = answers.join(bad, F.col(key) == F.col("_bad"), "left")
    return x.withColumn("verdict", F.when(F.col("_bad").isNull(), "ok").otherwise("retry")).drop("_bad")


def answer(questions: DataFrame, generate: Callable[[Column], Column], key: str, allowed: DataFrame, abstained: str = ABSTAINED) -> DataFrame:
    """Adds answer and abstained to rows (key, prompt).

    generate makes a text of a prompt.  It is called again, with a warning, only
    for rows whose first text fails; those that fail twice abstain, and so does the sentinel.
    """
    first = verify(questions.withColumn("_a", generate(F.col("prompt"))), F.col("_a"), key, allowed)
    good = first.where("verdict = 'ok'").drop("verdict")
    again = first.where("verdict <> 'ok'").drop("_a", "verdict")
    second = verify(again.withColumn("_a", generate(F.concat("prompt", F.lit(WARNING)))), F.col("_a"), key, allowed)
    second = second.withColumn("_a", F.when(F.col("verdict") == "ok", F.col("_a")).otherwise(F.lit(abstained))).drop("verdict")
    x = good.unionByName(second)
    out = X.strip(F.col("_a")).isin(SENTINEL, abstained)
    return x.withColumn("answer", F.when(out, F.lit(abstained)).otherwise(F.col("_a"))).withColumn("abstained", out).drop("_a")


def last_turns(history: Column, n: int = LAST_TURNS) -> Column:
    """The last n of an array; all of a shorter one."""
    return F.slice(history, F.greatest(F.size(history) - (n - 1), F.lit(1)), n)


def history_text(history: Column) -> Column:
    return F.array_join(F.transform(history, lambda h: F.concat(F.lit("Q: "), h["q"], F.lit("\nA: "), h["a"])), "\n")
