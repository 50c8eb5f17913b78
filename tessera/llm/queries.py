"""The registered query of each operator of this subpackage, and the SQL of those that DuckDB can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontaminate, jaccard, licenses, mixing, quality_model, quality_rules, substring_dedup, suffix_dedup, toxicity
from .sql_text import WORDS, lower_ascii


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_chats(table(spark, sf_dir, "conversations"))


OP1 = """
WITH t AS (SELECT DISTINCT conv_id, turn, role, text FROM conversations),
p AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS pos FROM t),
c AS (SELECT conv_id, list({'role': role, 'text': text} ORDER BY pos) AS turns, count(*) AS n_turns FROM p GROUP BY conv_id),
whole AS (SELECT turns, n_turns, min(conv_id) AS conv_id, count(*) AS n_copies FROM c GROUP BY turns, n_turns),
prefixes AS (SELECT DISTINCT turns[1:k] AS turns FROM (SELECT turns, unnest(generate_series(1, n_turns - 1)) AS k FROM c)),
kept AS (SELECT conv_id, n_turns, n_copies FROM whole WHERE turns NOT IN (SELECT turns FROM prefixes))
SELECT p.conv_id, p.pos::INTEGER AS pos, k.n_turns::INTEGER AS n_turns, k.n_copies,
       '<|im_start|>' || coalesce(role, 'user') || chr(10) || coalesce(text, '') || '<|im_end|>' || chr(10) AS rendered
FROM p JOIN kept k ON p.conv_id IS NOT DISTINCT FROM k.conv_id
"""


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return licenses.scan_licenses(docs).drop("text")


def _op2() -> str:
    known = ", ".join(f"('{s}', '{i}')" for s, i in licenses.SENTENCES.items())
    by_name: dict[str, list[str]] = {}
    for name, sequence in licenses.RULES:
        by_name.setdefault(name, []).append(f"contains(inside, ',{','.join(sequence)},')")
    has = {n: "(" + " OR ".join(x) + ")" for n, x in by_name.items()}
    said = [f"CASE WHEN {has[n]}" + (f" AND NOT {has[licenses.IMPLIED[n]]}" if n in licenses.IMPLIED else "") + f" THEN '{n}' END" for n in sorted(has)]
    return f"""
WITH known(sentence, id) AS (VALUES {known}),
s AS (SELECT doc_id, list_filter(list_transform(string_split_regex(coalesce(text, ''), '\\n|[.!?;:][\\x20\\x09-\\x0D]+'),
        lambda x: trim(regexp_replace({lower_ascii("x")}, '[^0-9a-z]+', ' ', 'g'), ' ')), lambda x: x <> '') AS s FROM documents),
one AS (SELECT doc_id, unnest(s) AS sentence, generate_subscripts(s, 1) AS k FROM s),
ids AS (SELECT doc_id, string_agg(id, ',' ORDER BY k) AS ids FROM one JOIN known USING (sentence) GROUP BY doc_id),
x AS (SELECT s.doc_id, len(s)::BIGINT AS n_sentences, coalesce(ids, '') AS sentence_ids, ',' || coalesce(ids, '') || ',' AS inside FROM s LEFT JOIN ids USING (doc_id))
SELECT doc_id, n_sentences, sentence_ids, concat_ws(',', {", ".join(said)}) AS licenses FROM x
"""


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.report(table(spark, sf_dir, "documents"))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_model.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.report(table(spark, sf_dir, "documents"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.report(table(spark, sf_dir, "documents"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    x = decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))
    return x.select("doc_id", "n_words", "n_hit", "n_items", F.sha2("item_ids", 256).alias("items_sha256"), "contaminated")


_TERMS = f"regexp_extract_all({lower_ascii('coalesce(text, chr(32))')}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
OP8 = f"""
WITH b AS (SELECT item_id::VARCHAR AS item, {_TERMS} AS t FROM benchmark),
w AS (SELECT DISTINCT item, t[i:i + 9] AS terms FROM (SELECT item, t, unnest(generate_series(1, greatest(len(t) - 9, 1))) AS i FROM b WHERE len(t) > 0)),
d AS (SELECT doc_id, {_TERMS} AS t FROM documents),
lens AS (SELECT DISTINCT len(terms) AS n FROM w),
slices AS (SELECT doc_id, n, i, t[i:i + n - 1] AS terms FROM (SELECT doc_id, t, n, unnest(generate_series(1, len(t) - n + 1)) AS i FROM d, lens)),
hit AS (SELECT doc_id, n, i, item FROM slices JOIN w USING (terms)),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + n - 1)) AS p FROM hit) GROUP BY doc_id),
items AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS ids FROM hit GROUP BY doc_id)
SELECT doc_id, len(t)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""


def benchmark_proximity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows (doc_id, n_near): benchmark items of which all words of a ten-word window stand within twenty words of a document, in any order."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("key"), decontaminate.terms(F.col("text")).alias("terms"))
    asked = decontaminate.windows(table(spark, sf_dir, "benchmark"), 10)
    near = decontaminate.proximity(docs, asked.select(F.col("window_id").alias("query_id"), "terms"), 20).select("query_id", "key").distinct()
    items = near.join(asked.select("window_id", F.explode("items").alias("item")), F.col("query_id") == F.col("window_id")).select("key", "item").distinct()
    return items.groupBy(F.col("key").alias("doc_id")).agg(F.count("*").alias("n_near"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_report(table(spark, sf_dir, "documents"), min_docs=5).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "n_cut", "kept")


_BLANKS = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
OP9 = f"""
WITH d AS (SELECT doc_id, coalesce(source, chr(0)) AS host, coalesce(text, '') AS text, {WORDS} AS w FROM documents),
g AS (SELECT doc_id, i, w[i:i + 7] AS gram FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 7)) AS i FROM d)),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, gram) AS n FROM g) WHERE n > 1),
covered AS (SELECT doc_id, count(DISTINCT p) AS n_repeat_words FROM (SELECT doc_id, unnest(generate_series(i, i + 7)) AS p FROM twice) GROUP BY doc_id),
raw AS (SELECT doc_id, host, unnest(string_split(text, chr(10))) AS line FROM d),
dup AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines FROM raw WHERE translate(line, {_BLANKS}, '') <> '' GROUP BY doc_id),
norm AS (SELECT doc_id, host, trim(regexp_replace(translate({lower_ascii('line')}, '123456789', '000000000'), '[\\x20\\x09-\\x0D]+', ' ', 'g'), ' ') AS line FROM raw),
per_line AS (SELECT host, line, count(DISTINCT doc_id) AS n FROM norm WHERE line <> '' GROUP BY host, line),
hosts AS (SELECT host, count(DISTINCT doc_id) AS docs FROM d GROUP BY host),
over AS (SELECT host, line FROM per_line JOIN hosts USING (host) WHERE n >= 5 AND (n * 100 > docs * 10 OR n > 50)),
cut AS (SELECT doc_id, sum(len(string_split(line, ' '))) AS n_cut FROM norm JOIN over USING (host, line) GROUP BY doc_id),
x AS (SELECT doc_id, len(w)::BIGINT AS n_words, length(translate(text, {_BLANKS}, ''))::BIGINT AS word_chars,
        (length(text) - length(translate(text, '#*$%&|<>', '')))::BIGINT AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines,
        coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(n_cut, 0)::BIGINT AS n_cut
      FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN dup USING (doc_id) LEFT JOIN cut USING (doc_id)),
y AS (SELECT *, n_words < 20 OR n_repeat_words * 100 > n_words * 30 AS base_failed FROM x)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, n_cut, NOT base_failed AND (n_words - n_cut) * 100 >= n_words * 30 AS kept FROM y
"""


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    sized = docs.select("doc_id", "source", mixing.n_words(docs["text"]).alias("n"), F.md5(F.coalesce("text", F.lit(""))).alias("key"))
    return mixing.mix(sized, size=sized["n"], text_key=sized["key"]).select("doc_id", "size", "source_size", "target", "taken")


OP10 = f"""
WITH d AS (SELECT doc_id, source, len({WORDS})::BIGINT AS size, md5('42:' || coalesce(doc_id::VARCHAR, 'null') || ':' || md5(coalesce(text, ''))) AS ord FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS r FROM d GROUP BY source),
w AS (SELECT *, [5, 2, 1][r % 3 + 1] AS weight, 2 * source_size AS cap, sum(source_size) OVER () AS total FROM s),
l AS (SELECT *, sum(weight) OVER () AS weights, coalesce(sum(cap) OVER o, 0) AS caps_before, coalesce(sum(weight) OVER o, 0) AS weights_before
      FROM w WINDOW o AS (ORDER BY cap::DOUBLE / weight, r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT *, cap * 2 * (weights - weights_before) <= weight * (total * 3 - caps_before * 2) AS is_full FROM l),
g AS (SELECT *, sum(CASE WHEN is_full THEN cap ELSE 0 END) OVER () AS caps_full, sum(CASE WHEN is_full THEN 0 ELSE weight END) OVER () AS weights_free FROM f),
t AS (SELECT source, source_size, CASE WHEN is_full THEN cap::DOUBLE ELSE (weight * (total * 3 - caps_full * 2))::DOUBLE / (weights_free * 2)::DOUBLE END AS target FROM g),
u AS (SELECT d.*, t.source_size, t.target, sum(size) OVER (PARTITION BY d.source ORDER BY ord, size ROWS UNBOUNDED PRECEDING) AS upto FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
v AS (SELECT *, floor(target / greatest(source_size, 1)) AS whole FROM u)
SELECT doc_id, size, source_size, target,
  CASE WHEN size > 0 THEN size * (whole::BIGINT + CASE WHEN (upto * 2 - size)::DOUBLE < (target - whole * source_size::DOUBLE) * 2.0::DOUBLE THEN 1 ELSE 0 END) ELSE 0 END::BIGINT AS taken
FROM v
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_chat_formatting": op1_chat_formatting,
        "op2_license_scan": op2_license_scan,
        "op3_jaccard_join": op3_jaccard_join,
        "op4_quality_classifier": op4_quality_classifier,
        "op5_substring_dedup": op5_substring_dedup,
        "op6_toxicity": op6_toxicity,
        "op7_suffix_dedup": op7_suffix_dedup,
        "op8_decontamination": op8_decontamination,
        "benchmark_proximity": benchmark_proximity,
        "op9_quality_rules": op9_quality_rules,
        "op10_mixing": op10_mixing,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_chat_formatting": OP1, "op2_license_scan": _op2(), "op8_decontamination": OP8, "op9_quality_rules": OP9, "op10_mixing": OP10}
