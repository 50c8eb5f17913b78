"""Column functions on text, numbers with units, and vectors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Units that the guardrail knows, canonical spelling first in each list, with the spellings that mean it.
UNITS = {
    "m/min": ("m/min", "metros por minuto", "m por minuto"),
    "fsw/min": ("fsw/min", "fsw por minuto"),
    "fsw": ("fsw",),
    "m": ("m", "metros", "metro"),
    "min": ("min", "minutos", "minuto"),
    "h": ("h", "horas", "hora"),
    "bar": ("bar",),
    "atm": ("atm", "atmósferas", "atmósfera", "atmosferas", "atmosfera"),
    "%": ("%", "por ciento"),
    "ºC": ("ºc", "°c"),
}
#: Fixed value: what opens a section, a number like 9-8.2.1 before a blank.
SECTION_START = r"^(\d+-\d+(?:\.\d+)*)\s"
#: A title ends at a full stop after three letters and before a capital, and has at most so many words or characters.
TITLE_END = r"(?<=[A-Za-z]{3})\.\s+(?=[A-Z])"
TITLE_WORDS, TITLE_CHARS = 15, 120

#: Words; and a number before a unit, with decimals after either mark, that no letter, digit, slash or mark goes before or after.
WORD = r"[\p{L}\p{N}_]+"
NUMBER_UNIT = r"(?iU)(?<![\w/,.])(\d+(?:[.,]\d+)?)\s*({units})(?![\w/º°%])"


def strip(c: Column) -> Column:
    """Without blanks of any kind at both ends; trim() takes spaces only."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def clean(c: Column) -> Column:
    """No soft hyphens; runs of spaces and tabs as one space; each line stripped.  Digits stay."""
    lines = F.split(F.replace(c, F.lit("­"), F.lit("")), "\n")
    return F.array_join(F.transform(lines, lambda s: strip(F.regexp_replace(s, "[ \t]+", " "))), "\n")


def fold_to_unit(section_id: Column) -> Column:
    """The first two parts of a section number: 9-8.2.1 is in 9-8.2."""
    return F.substring_index(section_id, ".", 2)


def n_words(c: Column) -> Column:
    return F.size(F.array_remove(F.split(c, r"\s+"), ""))


def split_title(rest: Column) -> Column:
    """The title at the start of a section's text."""
    head = strip(F.element_at(F.split(rest, TITLE_END, 2), 1))
    return F.when((head != "") & (n_words(head) <= TITLE_WORDS), head).otherwise(F.left(strip(rest), F.lit(TITLE_CHARS)))


def tokens(c: Column) -> Column:
    """Lower-cased runs of letters, digits and underscores of any script."""
    return F.regexp_extract_all(F.lower(c), F.lit(WORD), 0)


def fingerprint(c: Column, length: int = 16) -> Column:
    return F.substring(F.sha2(c, 256), 1, length)


def canonical_number(c: Column) -> Column:
    return F.translate(c, ".", ",")


def canonical_unit(c: Column) -> Column:
    """The canonical spelling of a unit; an unknown one stays as it is."""
    known = F.create_map(*[F.lit(x) for name, spellings in UNITS.items() for s in spellings for x in (s, name)])
    return F.coalesce(F.try_element_at(known, F.lower(c)), c)


def unit_pairs(c: Column) -> Column:
    """Array of (number, unit), canonical and in order, for each number with a known unit in the text."""
    spellings = sorted((s for all_of in UNITS.values() for s in all_of), key=len, reverse=True)
    pattern = F.lit(NUMBER_UNIT.format(units="|".join(spellings)))
    zipped = F.arrays_zip(F.regexp_extract_all(c, pattern, 1).alias("number"), F.regexp_extract_all(c, pattern, 2).alias("unit"))
    return F.transform(zipped, lambda p: F.struct(canonical_number(p["number"]).alias("number"), canonical_unit(p["unit"]).alias("unit")))


def strip_thinking(c: Column) -> Column:
    return strip(F.regexp_replace(c, "(?s)<think>.*?</think>", ""))


def text_blocks(blocks: Column) -> Column:
    """The texts of an array of (type, text) whose type is text, one after the other."""
    return F.array_join(F.transform(F.filter(blocks, lambda b: b["type"] == "text"), lambda b: b["text"]), "")


def escape_html(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def alphanumeric(c: Column) -> Column:
    """Letters and digits only, for comparisons that dashes and spaces don't matter in."""
    return F.regexp_replace(c, r"[^\p{L}\p{N}]", "")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine_distance(a: Column, b: Column) -> Column:
    return 1 - dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def joined(order: Column, value: Column, separator: str) -> Column:
    """Aggregate: values in order, joined.  For groups that fit into a string."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), value.alias("v")))), lambda x: x["v"]), separator)
