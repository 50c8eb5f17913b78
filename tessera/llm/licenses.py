"""License scans: known license sentences, and rules over their order.  DataFrame functions only."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lower_ascii

#: Normalised sentences of public license texts, with the identifier of each.
SENTENCES = {
    "licensed under the apache license version 2 0": "apache-notice",
    "licensed under the apache license version 2 0 the license": "apache-notice",
    "you may not use this file except in compliance with the license": "apache-compliance",
    "you may obtain a copy of the license at": "apache-copy",
    "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied": "apache-warranty",
    "released under the mit license": "mit-notice",
    "licensed under the mit license": "mit-notice",
    "this project is licensed under the mit license": "mit-notice",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions": "mit-grant",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software": "mit-condition",
    "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement": "mit-warranty",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "bsd-grant",
    "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer": "bsd-source",
    "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution": "bsd-binary",
    "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission": "bsd-endorse",
    "this work is licensed under the gnu general public license version 3": "gpl3-notice",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version": "gpl3-grant",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version": "gpl2-grant",
    "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose": "gpl-warranty",
    "licensed under cc by nc 4 0": "cc-by-nc-4-notice",
    "licensed under cc by 4 0": "cc-by-4-notice",
    "licensed under cc by sa 4 0": "cc-by-sa-4-notice",
    "this work is licensed under a creative commons attribution 4 0 international license": "cc-by-4-notice",
    "this source code form is subject to the terms of the mozilla public license v 2 0": "mpl2-notice",
    "all rights reserved": "all-rights-reserved",
}

#: Ordered rules: a document has the license if the rule's sentences stand in a row in its sequence of known sentences.
RULES = (
    ("Apache-2.0", ("apache-notice",)),
    ("Apache-2.0", ("apache-compliance", "apache-copy", "apache-warranty")),
    ("BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary")),
    ("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse")),
    ("CC-BY-4.0", ("cc-by-4-notice",)),
    ("CC-BY-NC-4.0", ("cc-by-nc-4-notice",)),
    ("CC-BY-SA-4.0", ("cc-by-sa-4-notice",)),
    ("GPL-2.0-or-later", ("gpl2-grant", "gpl-warranty")),
    ("GPL-3.0-only", ("gpl3-notice",)),
    ("GPL-3.0-or-later", ("gpl3-grant", "gpl-warranty")),
    ("MIT", ("mit-notice",)),
    ("MIT", ("mit-grant", "mit-condition", "mit-warranty")),
    ("MPL-2.0", ("mpl2-notice",)),
    ("Proprietary", ("all-rights-reserved",)),
)

#: Rules that say less than another on the same sentences.
IMPLIED = {"BSD-2-Clause": "BSD-3-Clause"}


def pieces(text: Column) -> Column:
    """Normalised pieces: cut at line ends and after . ! ? ; : before a blank; A-Z lower-cased; other than ASCII letters and digits one space.  Blank lines are empty ones."""
    cut = F.split(F.coalesce(text, F.lit("")), r"\n|[.!?;:][\x20\x09-\x0D]+")
    return F.transform(cut, lambda s: F.trim(F.regexp_replace(lower_ascii(s), "[^0-9a-z]+", " ")))


def _whole(known: dict[str, str]) -> str:
    """Pattern of a known sentence, the longest first, from one | to another; between its words a blank or a single |."""
    by_length = sorted(known, key=lambda s: (-len(s), s))
    return r"(?<=\|)(?:" + "|".join("[ |]".join(map(re.escape, s.split(" "))) for s in by_length) + r")(?=\|)"


def scan_licenses(docs: DataFrame, sentences_of: dict[str, str] | None = None, rules: tuple | None = None) -> DataFrame:
    """Adds n_sentences, sentence_ids (in order, comma-joined) and licenses (sorted, comma-joined) to rows with a column text.

    A known sentence is recognised, whole, where it is one piece of the text or
    several in a row: published texts are wrapped at any blank, and have stops
    inside a sentence ("v. 2.0", "free software; you can").  A blank line ends
    it.  n_sentences counts pieces.  Unknown sentences between known ones don't
    break a rule's order.  A null or empty text has none of either; a text of any
    length is read whole.  Works on one row at a time, without a shuffle:
    repeated rows are scanned alike, an empty table stays empty.  Every row
    stays; added names win over the input's.
    """
    known, rules = sentences_of or SENTENCES, rules or RULES
    ids = F.create_map(*[F.lit(x) for pair in known.items() for x in pair])
    x = docs.drop("n_sentences", "sentence_ids", "licenses").withColumn("_s", pieces(F.col("text")))
    x = x.withColumn("n_sentences", F.size(F.filter("_s", lambda s: s != "")).cast("long"))
    joined = F.concat(F.lit("|"), F.array_join("_s", "|"), F.lit("|"))
    x = x.withColumn("_s", F.regexp_extract_all(joined, F.lit(_whole(known)), F.lit(0)))
    x = x.withColumn("sentence_ids", F.array_join(F.transform("_s", lambda s: F.element_at(ids, F.translate(s, "|", " "))), ",")).drop("_s")
    inside = F.concat(F.lit(","), F.col("sentence_ids"), F.lit(","))
    found = {}
    for name, sequence in rules:
        has = inside.contains("," + ",".join(sequence) + ",")
        found[name] = found[name] | has if name in found else has
    named = [F.when(has & ~found[IMPLIED[n]] if n in IMPLIED and IMPLIED[n] in found else has, F.lit(n)) for n, has in sorted(found.items())]
    return x.withColumn("licenses", F.concat_ws(",", *named))
