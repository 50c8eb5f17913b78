"""From parsed items to sections: running lines, page ranges, segmentation, tables, parser confidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as X

#: A line on so many pages is a running header; so many worst pages are reported.
RUNNING_PAGES, WORST_PAGES = 5, 3
#: A caption of a table, with either hyphen and blanks after it; at the start of a line, or anywhere in a parser's caption.
CAPTION = r"(?m)^Table\s+(\d+)[‑-]\s*(\d+)\."
ANY_CAPTION = r"Table\s+(\d+)[‑-]\s*(\d+)"
#: Fixed value: a chapter's row of a table of contents.
CHAPTER = r"^CHAPTER\s+(\d+)\b"


def without_running(items: DataFrame, page: str, text: str, least: int = RUNNING_PAGES) -> DataFrame:
    """Items whose stripped text does not stand on `least` or more different pages."""
    key = X.strip(F.col(text))
    running = items.select(key.alias("_t"), page).distinct().groupBy("_t").agg(F.count("*").alias("_n")).where(F.col("_n") >= least).select("_t")
    return items.join(running, key == F.col("_t"), "left_anti")


def reading_order(items: DataFrame, page: str, top: str, order: str) -> DataFrame:
    """Adds place: by page, from the top down, then as they came."""
    return items.withColumn("place", F.row_number().over(W.partitionBy(page).orderBy(F.desc(top), order)))


def chapter_ranges(contents: DataFrame, n_pages: Column) -> DataFrame:
    """(chapter, first, last) from rows (title, page) of a table of contents at division level.

    A chapter ends before the next division, whatever that is; the last with the book.
    """
    last = F.coalesce(F.lead("page").over(W.orderBy("page", "title")) - 1, n_pages)
    chapter = F.regexp_extract(F.translate("title", "\r\n", "  "), CHAPTER, 1)
    return contents.select(chapter.alias("chapter"), F.col("page").alias("first"), last.alias("last")).where("chapter <> ''").withColumn("chapter", F.col("chapter").cast("int"))


def page_map(ranges: DataFrame) -> DataFrame:
    """(page in the subset, page in the book) for ranges laid one after the other; the running number is made of sums by range."""
    start = F.coalesce(F.sum(F.col("last") - F.col("first") + 1).over(W.orderBy("chapter").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    # the sums first: an explode in the same select would come before them
    x = ranges.withColumn("start", start).select("chapter", "first", "start", F.explode(F.sequence("first", "last")).alias("page"))
    return x.select("chapter", (F.col("start") + F.col("page") - F.col("first") + 1).alias("subset_page"), "page")


def segments(items: DataFrame, document: list[str], order: str, unit: Column, text: str) -> DataFrame:
    """(document, section, unit, n_items, text): an item with a unit other than the open one opens a section.

    Items before the first section are dropped; a unit that comes back later opens another section.
    """
    by = W.partitionBy(*document).orderBy(order)
    x = items.withColumn("_u", unit)
    x = x.withColumn("_open", F.last("_u", ignorenulls=True).over(by.rowsBetween(W.unboundedPreceding, -1)))
    opens = F.col("_u").isNotNull() & ~F.col("_u").eqNullSafe(F.col("_open"))
    x = x.withColumn("section", F.sum(opens.cast("int")).over(by.rowsBetween(W.unboundedPreceding, 0))).where("section > 0")
    return x.groupBy(*document, "section").agg(F.min_by("_u", order).alias("unit"), F.count("*").alias("n_items"), X.joined(F.col(order), F.col(text), "\n").alias("text"))


def markdown_sections(lines: DataFrame, document: str, order: str) -> DataFrame:
    """(document, topic, title, n, text) of notes: # opens a topic, ## a section that runs to the next heading of either."""
    by = W.partitionBy(document).orderBy(order)
    line = F.col("line")
    heads = F.regexp_extract(line, r"^(#{1,2}) (.*)$", 1)
    x = lines.withColumns({"_h": heads, "_name": X.strip(F.regexp_extract(line, r"^#{1,2} (.*)$", 1))})
    x = x.withColumn("topic", F.last(F.when(F.col("_h") == "#", F.col("_name")), ignorenulls=True).over(by))
    x = x.withColumn("n", F.sum((F.col("_h") != "").cast("int")).over(by.rowsBetween(W.unboundedPreceding, 0)))
    x = x.groupBy(document, "n").agg(F.min_by("topic", order).alias("topic"), F.min_by("_h", order).alias("_h"), F.min_by("_name", order).alias("title"), X.joined(F.col(order), F.when(F.col("_h") == "", line), "\n").alias("text"))
    return x.where("_h = '##' and topic is not null and title <> 'Índice'").select(document, "topic", "title", "n", X.strip(F.col("text")).alias("text"))


def not_only_heading(sections: DataFrame) -> DataFrame:
    """Sections that have text besides their number and title."""
    head = F.concat_ws(" ", "unit", "title")
    at = F.instr(F.col("text"), head)
    rest = F.when(at > 0, F.overlay("text", F.lit(""), at, F.length(head))).otherwise(F.col("text"))
    return sections.where((X.strip(rest) != "") & (X.strip(F.col("text")) != ""))


def caption_ids(text: Column, pattern: str = CAPTION) -> Column:
    """Array of table numbers N-M, with a plain hyphen whichever the text has."""
    parts = F.arrays_zip(F.regexp_extract_all(text, F.lit(pattern), 1).alias("n"), F.regexp_extract_all(text, F.lit(pattern), 2).alias("m"))
    return F.transform(parts, lambda p: F.concat_ws("-", p["n"], p["m"]))


def captions(pages: DataFrame, text: Column, skip_lines: int = 2) -> DataFrame:
    """Distinct table numbers below the first lines of each page."""
    lines = F.split(text, "\n")
    body = F.array_join(F.slice(lines, skip_lines + 1, F.size(lines)), "\n")
    return pages.select(F.explode(caption_ids(body)).alias("caption")).distinct()


def parsed_captions(tables: DataFrame, caption: Column) -> DataFrame:
    """Distinct table numbers of a parser's tables: the first that each caption names."""
    return tables.select(F.get(caption_ids(F.coalesce(caption, F.lit("")), ANY_CAPTION), 0).alias("caption")).where("caption is not null").distinct()


def table_pointers(items: DataFrame, order: str = "ord") -> DataFrame:
    """(table_id, text, first_page, last_page): one a table, with its first caption; page 0 counts as unknown."""
    page = F.nullif(F.col("page"), F.lit(0))
    x = items.groupBy("table_id").agg(F.min_by("caption", order).alias("caption"), F.min(page).alias("first_page"), F.max(page).alias("last_page"))
    return x.select("table_id", F.concat(F.lit("Table "), "table_id", F.lit(". "), "caption").alias("text"), "first_page", "last_page")


def with_provenance(items: DataFrame, page: str = "page") -> DataFrame:
    """Items that a parser could place on a page."""
    return items.where(F.col(page).isNotNull())


def manifest(sections: DataFrame, claimed: DataFrame, found: DataFrame, scores: DataFrame) -> DataFrame:
    """One row a chapter: first and last page, sections, table pointers, tables that the text names, those that the parser lost, and its worst pages.

    sections: (chapter, kind, page, page_end); claimed, found: (chapter, caption); scores: (chapter, page, score).
    """
    counts = sections.groupBy("chapter").agg(
        F.min("page").alias("first_page"),
        F.max(F.coalesce("page_end", "page")).alias("last_page"),
        F.count_if(F.col("kind") == "prosa").alias("n_sections"),
        F.count_if(F.col("kind") == "puntero_tabla").alias("n_pointers"),
    )
    lost = claimed.join(found.select("chapter", "caption", F.lit(True).alias("_f")), ["chapter", "caption"], "left")
    lost = lost.groupBy("chapter").agg(F.count("*").alias("n_tables"), F.array_sort(F.collect_list(F.when(F.col("_f").isNull(), F.col("caption")))).alias("lost_tables"))
    worst = worst_pages(scores, "chapter", "page", "score").groupBy("chapter").agg(F.array_sort(F.collect_list("page")).alias("worst_pages"))
    x = counts.join(lost, "chapter", "left").join(worst, "chapter", "left")
    none = F.array().cast("array<string>")
    return x.select("chapter", "first_page", "last_page", "n_sections", "n_pointers", F.coalesce("n_tables", F.lit(0)).alias("n_tables"), F.coalesce("lost_tables", none).alias("lost_tables"), F.coalesce("worst_pages", F.array().cast(worst.schema["worst_pages"].dataType)).alias("worst_pages"))


def worst_pages(scores: DataFrame, chapter: str, page: str, score: str, n: int = WORST_PAGES) -> DataFrame:
    """The n pages of each chapter with the least scores; NaN and null scores say nothing."""
    x = scores.where(F.col(score).isNotNull() & ~F.isnan(score)).groupBy(chapter, page).agg(F.min(score).alias("least"))
    return x.withColumn("rank", F.row_number().over(W.partitionBy(chapter).orderBy("least", page))).where(F.col("rank") <= n)


def numeric_rows(text: Column) -> Column:
    """Lines that look like rows of a table: four words or more, four numbers or more, over half numbers."""

    def is_row(line: Column) -> Column:
        w = F.array_remove(F.split(line, r"\s+"), "")
        k = F.size(F.filter(w, lambda x: x.rlike(r"^[\d.,/:-]*\d[\d.,/:-]*$")))
        return (F.size(w) >= 4) & (k >= 4) & (k * 2 > F.size(w))

    return F.filter(F.split(text, "\n"), is_row)
