"""The exam: its questions and labels, expected answers, and how far labelling is."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed value: what stands between expected answers that are all right.
EITHER = "\nO BIEN (alternativa igual de válida):\n"


def exam_rows(golden: DataFrame, use: str = "eval") -> DataFrame:
    """The rows for one use; none is an error, as a truncated file has none."""
    rows = golden.where(F.col("use") == use)
    if rows.isEmpty():
        raise ValueError(f"no question is for {use}")
    return rows


def unmatched(exam: DataFrame, labels: DataFrame, order: str = "ord") -> DataFrame:
    """(id, exam_ord, label_ord) of questions without a label, labels without a question, and those at different places."""
    a, b = exam.select("id", F.col(order).alias("exam_ord")), labels.select("id", F.col(order).alias("label_ord"))
    return a.join(b, "id", "full").where(~F.col("exam_ord").eqNullSafe(F.col("label_ord")))


def require_matched(exam: DataFrame, labels: DataFrame, order: str = "ord") -> DataFrame:
    """exam with its labels, or an error with some ids of either that don't match."""
    bad = [r["id"] for r in unmatched(exam, labels, order).orderBy("id").limit(5).collect()]
    if bad:
        raise ValueError(f"labels and questions differ: {bad}")
    return exam.join(labels.drop(order), "id")


def expected_text(expected: Column) -> Column:
    """Expected answers (an array) as one text."""
    return F.array_join(expected, EITHER)


def all_sections(labels: DataFrame, columns: list[str]) -> DataFrame:
    """(id, sections): the sections of all corpora that a question's label names, each once, in order."""
    return labels.select("id", F.array_distinct(F.concat(*[F.coalesce(c, F.array().cast("array<string>")) for c in columns])).alias("sections"))


def ordered_distinct(rows: DataFrame, value: str, order: list[str]) -> DataFrame:
    """(value, place): each different value once, by where it came first."""
    first = rows.groupBy(value).agg(F.min(F.struct(*order)).alias("place"))
    return first.where(F.col(value).isNotNull())


def with_label(rows: DataFrame, key: str, labels: DataFrame) -> DataFrame:
    """rows with label and note from labels (key, label, note) where they have none yet: a label once set stays."""
    new = labels.select(key, F.col("label").alias("_l"), F.col("note").alias("_n"))
    x = rows.join(new, key, "left")
    unset = F.coalesce("label", F.lit("")) == ""
    return x.withColumns({"label": F.when(unset, F.coalesce("_l", "label")).otherwise(F.col("label")), "note": F.when(unset, F.coalesce("_n", "note")).otherwise(F.col("note"))}).drop("_l", "_n")


def progress(rows: DataFrame) -> DataFrame:
    """One row: how many are labelled, how many are left, and whether all are."""
    done = F.coalesce("label", F.lit("")) != ""
    return rows.agg(F.count_if(done).alias("n_done"), F.count_if(~done).alias("n_left"), (F.count_if(~done) == 0).alias("complete"))


def labelled(rows: DataFrame) -> DataFrame:
    """Rows with a label; none is an error."""
    x = rows.where(F.coalesce("label", F.lit("")) != "")
    if x.isEmpty():
        raise ValueError("no row is labelled")
    return x


def disagreements(verdicts: DataFrame) -> DataFrame:
    """Labelled rows (verdict, label, ...) whose verdict is another."""
    return verdicts.where((F.coalesce("label", F.lit("")) != "") & ~F.col("verdict").eqNullSafe(F.col("label")))


def with_real_ids(rows: DataFrame, mapping: DataFrame) -> DataFrame:
    """rows with real_id from a mapping (id, real_id) of anonymised ids."""
    return rows.join(mapping, "id", "left")


def council(answers: DataFrame, judges: dict[str, Callable[[Column], Column]], least: float = 0.5) -> DataFrame:
    """(id, judge, score, passed, reason): each judge's vote on rows (id, case); a judge makes (score, reason) of a case, and passes from `least` on."""
    votes = [F.struct(F.lit(name).alias("judge"), judge(F.col("case")).alias("v")) for name, judge in sorted(judges.items())]
    x = answers.select("id", F.explode(F.array(*votes)).alias("x")).select("id", "x.judge", "x.v.score", "x.v.reason")
    return x.withColumn("passed", F.col("score") >= least)
