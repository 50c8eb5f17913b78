"""Benchmark decontamination over a positional inverted index.  DataFrame functions only.

The index holds (term, row, position) of the training texts.  A phrase is found
by its rarest terms: their posting lists, each moved back by the term's place in
the phrase, are intersected; where they agree the phrase may start, and there
the text is compared word by word.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut, let, lower_ascii, row_key, small

#: What stands between words: ASCII other than letters and digits.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The same before A-Z are lower-cased.
BETWEEN_CASED = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Tables made from the benchmark alone are broadcast up to so many rows, else joined by shuffle.
BROADCAST_ROWS = 500_000


def terms(text: Column) -> Column:
    """The words of a text, A-Z lower-cased.

    lower() is far cheaper than translate(): it serves whole texts in ASCII,
    and else tells which words have an upper-case letter at all.
    """
    text = F.coalesce(text, F.lit(""))
    plain = F.array_remove(F.split(F.lower(text), BETWEEN), "")
    other = F.transform(F.array_remove(F.split(text, BETWEEN_CASED), ""), lambda w: F.when(F.lower(w) == w, w).otherwise(lower_ascii(w)))
    return F.when(F.octet_length(text) == F.length(text), plain).otherwise(other)


def n_terms(text: Column) -> Column:
    return F.size(F.array_remove(F.split(F.coalesce(text, F.lit("")), BETWEEN_CASED), ""))


def windows(benchmark: DataFrame, window: int) -> DataFrame:
    """Distinct windows (window_id, terms, items): `window` consecutive words of an item, or all of a shorter one; items are sorted item_ids as strings."""
    x = benchmark.select(F.col("item_id").cast("string").alias("item"), terms(F.col("text")).alias("t")).where(F.size("t") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("t") - window + 1, F.lit(1)))
    x = x.select("item", F.explode(F.transform(starts, lambda i: F.slice("t", i, window))).alias("terms"))
    x = x.groupBy("terms").agg(F.array_sort(F.collect_set(F.coalesce("item", F.lit("")))).alias("items"))
    return x.withColumn("window_id", F.xxhash64("terms"))


def postings(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """Rows (term, key, pos): where the wanted terms (column term, distinct) stand in docs (key, terms), pos from 0."""
    x = docs.select("key", F.posexplode("terms").alias("pos", "term"))
    return x.join(small(wanted, BROADCAST_ROWS), "term")


def phrase_starts(docs: DataFrame, phrases: DataFrame, lists: int = 2) -> DataFrame:
    """Rows (window_id, key, start) at which each phrase's `lists` rarest terms stand where the phrase has them.

    docs: (key, terms); phrases: (window_id, terms).  Rarity is the number of
    rows that have the term, counted over all of docs.
    """
    spots = phrases.select("window_id", F.posexplode("terms").alias("offset", "term"))
    spots = cut(spots.groupBy("window_id", "term").agg(F.min("offset").alias("offset")))
    vocabulary = spots.select("term").distinct()
    frequency = docs.select(F.explode(F.array_distinct("terms")).alias("term")).join(small(vocabulary, BROADCAST_ROWS), "term").groupBy("term").agg(F.count("*").alias("n_docs"))
    # the texts are read once for this; what follows comes from the table
    found = cut(spots.join(frequency, "term"))
    # a phrase with a term that no row has can't occur: it has fewer terms found than it has
    alive = found.groupBy("window_id").agg(F.count("*").alias("n")).join(spots.groupBy("window_id").agg(F.count("*").alias("m")), "window_id")
    alive = alive.where("n = m").select("window_id", F.least("m", F.lit(lists)).cast("int").alias("needed"))
    ranked = found.withColumn("rank", F.row_number().over(W.partitionBy("window_id").orderBy("n_docs", "term"))).where(F.col("rank") <= lists)
    ranked = cut(ranked.join(alive, "window_id").select("window_id", "term", "offset", "rank", "needed"))
    hits = postings(docs, ranked.select("term").distinct()).join(small(ranked, BROADCAST_ROWS), "term")
    hits = hits.select("window_id", "key", (F.col("pos") - F.col("offset")).alias("start"), "needed", F.expr("shiftleft(1, rank - 1)").alias("bit"))
    agreed = hits.where("start >= 0").groupBy("window_id", "key", "start", "needed").agg(F.bit_or("bit").alias("bits"))
    return agreed.where("bits = shiftleft(1, needed) - 1").select("window_id", "key", "start")


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """Adds n_words, n_hit, item_ids (sorted strings, comma-joined), n_items, contaminated and hits to docs (doc_id, text).

    Words are runs of ASCII letters and digits, A-Z lower-cased, and of all
    characters beyond ASCII.  A word inside any occurrence of a benchmark
    window is hit.  hits: sorted array of (first word, one past the last word), a
    span for each window found; they may overlap.

    Null text or item text has no words; texts of any length are read whole.
    Null item_id counts as an item with an empty name.  Repeated rows are judged
    alike.  Empty tables: no hits, or no rows.  Columns of docs are kept; added
    names win.
    """
    made = ("n_words", "n_hit", "n_items", "item_ids", "contaminated", "hits", "_key", "_terms", "_found")
    docs = docs.select(*[c for c in docs.columns if c not in made], row_key(F.col("doc_id"), F.col("text")).alias("_key"))
    index = docs.select(F.col("_key").alias("key"), terms(F.col("text")).alias("terms"))
    bench = cut(windows(benchmark, window))
    starts = phrase_starts(index, bench)
    found = starts.distinct().join(small(bench, BROADCAST_ROWS), "window_id")
    found = found.groupBy("key").agg(F.collect_list(F.struct("start", "terms", "items")).alias("_found")).withColumnRenamed("key", "_of")
    x = docs.join(found, F.col("_key") == F.col("_of"), "left").drop("_of", "_key")
    # only texts in which a phrase may start are lower-cased
    x = x.withColumn("_terms", F.when(F.col("_found").isNotNull(), terms(F.col("text"))))
    x = x.withColumn("n_words", F.coalesce(F.when(F.col("_terms").isNotNull(), F.size("_terms")), n_terms(F.col("text"))).cast("long"))
    exact = let(F.col("_terms"), lambda t: F.filter("_found", lambda f: F.slice(t, f["start"] + 1, F.size(f["terms"])) == f["terms"]))
    x = x.withColumn("_found", F.coalesce(F.array_sort(F.transform(exact, lambda f: F.struct(f["start"].alias("a"), (f["start"] + F.size(f["terms"])).alias("b"), f["items"].alias("items")))), F.array().cast("array<struct<a:int,b:int,items:array<string>>>")))
    x = x.withColumn("hits", F.array_distinct(F.transform("_found", lambda f: F.struct(f["a"].alias("a"), f["b"].alias("b")))))
    # spans come by their start; each adds what lies beyond the furthest end so far
    nothing = F.struct(F.lit(0).alias("n"), F.lit(0).alias("upto"))
    n_hit = F.aggregate("hits", nothing, lambda s, h: F.struct((s["n"] + F.greatest(h["b"] - F.greatest(h["a"], s["upto"]), F.lit(0))).alias("n"), F.greatest(h["b"], s["upto"]).alias("upto")), lambda s: s["n"])
    ids = F.array_sort(F.array_distinct(F.flatten(F.transform("_found", lambda f: f["items"]))))
    x = x.withColumns({"n_hit": n_hit.cast("long"), "n_items": F.size(ids).cast("long"), "item_ids": F.array_join(ids, ",")})
    return x.withColumn("contaminated", F.col("n_hit") > 0).drop("_terms", "_found")


def proximity(docs: DataFrame, queries: DataFrame, within: int) -> DataFrame:
    """Rows (query_id, key, first, last): spans of at most `within` words of a row that hold all of a query's terms, in any order.

    docs: (key, terms); queries: (query_id, terms).  The lists of a query's two
    rarest terms are joined on blocks of `within` positions, so only neighbours
    meet; around each such pair the text is looked at for the others.  first is
    where a span begins, at one of the query's terms; last is the least end.
    A query of one term is found wherever that stands; one without terms, or
    with a term that no row has, nowhere.
    """
    queries = queries.select("query_id", F.array_distinct("terms").alias("asked")).where(F.size("asked") > 0)
    spots = queries.select("query_id", F.size("asked").alias("m"), F.explode("asked").alias("term"))
    frequency = docs.select(F.explode(F.array_distinct("terms")).alias("term")).join(small(spots.select("term").distinct(), BROADCAST_ROWS), "term").groupBy("term").agg(F.count("*").alias("n_docs"))
    found = cut(spots.join(frequency, "term"))
    alive = found.groupBy("query_id", "m").agg(F.count("*").alias("n")).where("n = m").select("query_id")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy("n_docs", "term"))
    ranked = cut(found.join(alive, "query_id").withColumn("rank", rank).where("rank <= 2").select("query_id", "term", "rank", "m"))
    p = postings(docs, ranked.select("term").distinct()).join(small(ranked, BROADCAST_ROWS), "term").withColumn("block", F.floor(F.col("pos") / within))
    a = p.where("rank = 1").select("query_id", "key", "m", F.col("pos").alias("p"), F.explode(F.array(F.col("block") - 1, F.col("block"), F.col("block") + 1)).alias("block"))
    b = p.where("rank = 2").select("query_id", "key", F.col("pos").alias("q"), "block")
    near = a.join(b, ["query_id", "key", "block"], "left").where(F.coalesce(F.abs(F.col("p") - F.col("q")) < within, F.col("m") == 1))
    near = near.groupBy("query_id", "key").agg(F.array_sort(F.collect_set("p")).alias("at"))
    x = near.join(docs, "key").join(queries, "query_id")
    # each place near a rarest term that holds one of the terms may open a span
    starts = F.array_distinct(F.flatten(F.transform("at", lambda i: F.sequence(F.greatest(i - within + 1, F.lit(0)), i))))
    opens = F.filter(starts, lambda i: F.array_contains(F.col("asked"), F.get("terms", i)))
    last = lambda i: i + F.array_max(F.transform("asked", lambda w: F.array_position(F.slice("terms", i + 1, within), w))).cast("int") - 1
    whole = F.filter(opens, lambda i: F.size(F.array_except("asked", F.slice("terms", i + 1, within))) == 0)
    x = x.select("query_id", "key", F.explode(F.transform(whole, lambda i: F.struct(i.alias("first"), last(i).alias("last")))).alias("s"))
    return x.select("query_id", "key", "s.first", "s.last")
