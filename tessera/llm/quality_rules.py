"""Quality rules: base counts of a text, and lines that many documents of a host share.  DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLANK, BLANKS, Tables, let, lower_ascii, row_key, small, words

#: Characters that count as symbols.
SYMBOLS = "#*$%&|<>"
WINDOW = 8
#: A line in more documents of a host than this is frequent there, however large the host is.
MAX_DOCS = 50
#: A line in fewer documents of a host than this is not frequent, however small the host is.
MIN_DOCS = 20


def _covered(hashes: Column, width: int) -> Column:
    """Number of words in windows whose hash occurs twice or more in the array of window hashes."""
    # by hash, then place, so that equal windows are neighbours; each looks at both sides
    placed = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def twice(p: Column) -> Column:
        return F.transform(p, lambda x, j: F.when((F.get(p, j - 1)["h"] == x["h"]) | (F.get(p, j + 1)["h"] == x["h"]), x["i"]))

    def steps(at: Column) -> Column:
        return F.transform(at, lambda i, j: F.least(F.coalesce(F.get(at, j + 1) - i, F.lit(width)), F.lit(width)))

    at = F.array_sort(F.filter(let(placed, twice), lambda i: i.isNotNull()))
    return F.aggregate(let(at, steps), F.lit(0), lambda a, x: a + x)


def base(docs: DataFrame) -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed to rows with a column text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    x = docs.withColumn("_w", F.transform(words(F.col("text")), lambda w: F.xxhash64(w)))
    n = F.size("_w")

    def grams(w: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(w) - WINDOW), lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(WINDOW)]))

    x = x.withColumn("_g", F.when(n >= WINDOW, let(F.col("_w"), grams)).otherwise(F.array().cast("array<bigint>")))
    # most texts repeat no window: the count of distinct ones tells so without the sort by place
    repeats = F.when(F.size(F.array_distinct("_g")) < F.size("_g"), _covered(F.col("_g"), WINDOW)).otherwise(F.lit(0))
    lines = F.filter(F.split(text, "\n"), lambda s: F.length(F.translate(s, BLANKS, "")) > 0)
    x = x.withColumns(
        {
            "n_words": n.cast("long"),
            "word_chars": F.length(F.translate(text, BLANKS, "")).cast("long"),
            "n_symbols": (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long"),
            "n_dup_lines": let(lines, lambda s: F.size(s) - F.size(F.array_distinct(s))).cast("long"),
            "n_repeat_words": repeats.cast("long"),
        }
    )
    return x.withColumn("base_failed", (F.col("n_words") < 20) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 30)).drop("_w", "_g")


def normal_line(line: Column) -> Column:
    """Lower-cased (A-Z), digits as 0, runs of blanks as one space, trimmed."""
    return F.trim(F.regexp_replace(F.translate(lower_ascii(line), "123456789", "000000000"), BLANK, " "))


def _summed(lines: Column) -> Column:
    """Array of (line, words) with the words of equal lines added together."""

    def runs(s: Column) -> Column:
        first = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: ~F.get(s, i)["line"].eqNullSafe(F.get(s, i - 1)["line"]))
        return let(first, lambda at: F.transform(at, lambda i, j: F.struct(F.get(s, i)["line"].alias("line"), (F.get(s, i)["words"] * (F.coalesce(F.get(at, j + 1), F.size(s)) - i)).alias("words"))))

    # most texts repeat no line: the count of distinct ones tells so without the sort
    return let(lines, lambda s: F.when(F.size(F.array_distinct(s["line"])) < F.size(s), let(F.array_sort(s), runs)).otherwise(s))


def _frequent(max_percent: int, max_docs: int) -> Column:
    return (F.col("n_docs") * 100 > F.col("host_docs") * max_percent) | (F.col("n_docs") > max_docs)


def line_removals(docs: DataFrame, min_docs: int, max_percent: int, max_docs: int = MAX_DOCS) -> DataFrame:
    """Rows (row key, n_cut): words in lines that more than max_percent % of the host's documents or more than max_docs, and min_docs at least, have."""
    text = F.coalesce(F.col("text"), F.lit(""))
    doc = F.coalesce(F.col("doc_id"), F.lit(-(2**63)))
    lines = F.transform(F.split(text, "\n"), lambda s: F.struct(normal_line(s).alias("s")))
    lines = F.transform(F.filter(lines, lambda s: s["s"] != ""), lambda s: F.struct(F.xxhash64(s["s"]).alias("line"), F.size(F.split(s["s"], " ")).alias("words")))
    x = docs.select(F.col("_key"), row_key(F.col("source")).alias("host"), doc.alias("_doc"), F.explode(_summed(lines)).alias("_l")).select("_key", "host", "_doc", "_l.line", "_l.words")
    # rows that repeat doc_id, source and text share a key; the words are those of one of them
    rows = x.groupBy("_key", "host", "_doc", "line").agg(F.max("words").alias("words"))
    per_line = x.select("host", "line", "_doc").distinct().groupBy("host", "line").agg(F.count("*").alias("n_docs")).where(F.col("n_docs") >= min_docs)
    per_host = docs.select(row_key(F.col("source")).alias("host"), doc.alias("_doc")).distinct().groupBy("host").agg(F.count("*").alias("host_docs"))
    over = per_line.join(per_host, "host").where(_frequent(max_percent, max_docs)).select("host", "line")
    # the keys are the most frequent ones by nature: 16 bytes a row, written once, counted, and joined by shuffle only beyond
    return rows.join(small(Tables(docs.sparkSession).write(over, keep=True), 1_000_000), ["host", "line"]).groupBy("_key").agg(F.sum("words").alias("n_cut"))


def quality_rules(docs: DataFrame, min_docs: int = MIN_DOCS, max_percent: int = 10, min_left_percent: int = 30, max_docs: int = MAX_DOCS) -> DataFrame:
    """Adds the base counts, n_cut (words in removed lines) and kept to documents (doc_id, text, source).

    A line counts by the distinct doc_ids of its host (source) that have it,
    compared after normal_line().  It is removed if min_docs at least have it,
    and more than max_percent % of the host's documents or more than max_docs.  A document of which less than
    min_left_percent % of the words stay after removal is rejected.  Base
    counts are of the text as it came.

    Null text is empty: no words, base_failed.  Null source: a host of its own.
    Null doc_ids count as one document.  Repeated rows: each is judged, alike;
    they are one document in the counts.  Texts of any length are read whole.
    Empty input: empty output.  All columns stay but those named like an added one.
    """
    made = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "n_cut", "kept", "_key", "_w", "_g", "_cut_key")
    docs = docs.select(*[c for c in docs.columns if c not in made], row_key(F.col("doc_id"), F.col("source"), F.col("text")).alias("_key"))
    cut = line_removals(docs, min_docs, max_percent, max_docs).withColumnRenamed("_key", "_cut_key")
    counted = base(docs)
    return _verdict(counted, cut, min_left_percent)


def _verdict(counted: DataFrame, cut: DataFrame, min_left_percent: int) -> DataFrame:
    x = counted.join(cut, F.col("_key") == F.col("_cut_key"), "left").drop("_key", "_cut_key")
    x = x.withColumn("n_cut", F.coalesce("n_cut", F.lit(0)).cast("long"))
    return x.withColumn("kept", ~F.col("base_failed") & ((F.col("n_words") - F.col("n_cut")) * 100 >= F.col("n_words") * min_left_percent))


def quality_report(docs: DataFrame, min_docs: int = MIN_DOCS, max_percent: int = 10, min_left_percent: int = 30, max_docs: int = MAX_DOCS) -> DataFrame:
    """quality_rules() without the texts: only doc_id and the counts go through the last join."""
    docs = docs.select("doc_id", "source", "text", row_key(F.col("doc_id"), F.col("source"), F.col("text")).alias("_key"))
    cut = line_removals(docs, min_docs, max_percent, max_docs).withColumnRenamed("_key", "_cut_key")
    return _verdict(base(docs).drop("text", "source"), cut, min_left_percent)


def without_frequent_lines(docs: DataFrame, min_docs: int = MIN_DOCS, max_percent: int = 10, max_docs: int = MAX_DOCS) -> DataFrame:
    """Rows (host, line) that quality_rules() removes, hashed; for reports."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.array_distinct(F.transform(F.split(text, "\n"), normal_line))
    x = docs.select(F.col("source"), F.coalesce(F.col("doc_id"), F.lit(-(2**63))).alias("_doc"), F.explode(lines).alias("line")).where(F.col("line") != "").distinct()
    counts = x.groupBy("source", "line").agg(F.count("*").alias("n_docs")).where(F.col("n_docs") >= min_docs)
    hosts = docs.select(F.col("source").alias("_s"), F.coalesce(F.col("doc_id"), F.lit(-(2**63))).alias("_doc")).distinct().groupBy("_s").agg(F.count("*").alias("host_docs"))
    return counts.join(hosts, F.col("source").eqNullSafe(F.col("_s"))).where(_frequent(max_percent, max_docs)).select("source", "line", "n_docs", "host_docs")
