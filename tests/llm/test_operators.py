"""Each operator on nulls, empty and long texts, ties, repeated rows, empty tables and clashing names; and worked cases."""

import random
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F
from tessera.llm import chat, decontaminate, jaccard, licenses, mixing, quality_model, quality_rules, substring_dedup, suffix_dedup, toxicity
from tessera.llm import symbols as S

from . import brute


def count(text):
    return len((text or "").encode().split())


def test_symbols_are_the_words():
    texts = ["a b\x0bc  d", None, "", "é\x85x y", "tail ", " \t"]
    data, lengths = S.flat(texts)
    hashes, start, end, counts = S.words(data, lengths)
    assert [data[a:b].tobytes() for a, b in zip(start, end, strict=True)] == [w for t in texts for w in (t or "").encode().split()]
    assert counts.tolist() == [count(t) for t in texts]
    again = S.words(*S.flat(["zzz d"]))[0]
    assert again[1] == hashes[3]


@pytest.mark.parametrize("solve", [substring_dedup.shared_windows, suffix_dedup.shared_windows])
def test_solvers(solve):
    rng = random.Random(2)
    for _ in range(80):
        base = [rng.randint(0, 3) for _ in range(50)]
        strings = [base[(a := rng.randint(0, 30)) : a + rng.randint(0, 20)] + [rng.randint(0, 3) for _ in range(rng.randint(0, 8))] for _ in range(rng.randint(1, 12))]
        docs, w, least = [rng.randint(0, 5) for _ in strings], rng.randint(1, 8), {}
        for s, d in zip(strings, docs, strict=True):
            for i in range(len(s) - w + 1):
                least[tuple(s[i : i + w])] = min(d, least.get(tuple(s[i : i + w]), 99))
        kind = np.uint8 if solve is suffix_dedup.shared_windows else np.uint64
        got = solve([np.array(s, kind) for s in strings], np.array(docs), w)
        assert [x.tolist() for x in got] == [[i for i in range(len(s) - w + 1) if least[tuple(s[i : i + w])] < d] for s, d in zip(strings, docs, strict=True)]


@pytest.mark.parametrize(("kind", "dedup"), [("words", substring_dedup.dedup_words), ("bytes", suffix_dedup.dedup_bytes)])
def test_repeats(spark, edge, edge_rows, nothing, kind, dedup):
    assert dedup(nothing).count() == 0
    got = dedup(edge, with_text=True).collect()
    assert len(got) == len(edge_rows)
    # rows of one doc_id are one document; null ids come last
    numbered = [(i, (10**9 if r[0] is None else r[0], r[1])) for i, r in enumerate(edge_rows)]
    least = {}
    parts = {i: (list((t or "").encode().split()) if kind == "words" else [bytes([b]) for b in (t or "").encode()]) for i, (_, t) in numbered}
    for i, (d, _) in numbered:
        for j in range(len(parts[i]) - 49):
            w = tuple(parts[i][j : j + 50])
            least[w] = min(d, least.get(w, 10**10))
    want = []
    for i, (d, t) in numbered:
        gone = [False] * len(parts[i])
        for j in range(len(parts[i]) - 49):
            if least[tuple(parts[i][j : j + 50])] < d:
                gone[j : j + 50] = [True] * 50
        want.append((d, t, len(gone), sum(gone)))
    key = lambda x: (x[0], x[1] or "", x[2], x[3])
    by_row = sorted(((10**9 if r.row.doc_id is None else r.row.doc_id, r.n_symbols, r.n_removed) for r in got))
    assert by_row == sorted((d, n, k) for d, _, n, k in sorted(want, key=key))
    assert all(r.row.key == "e" for r in got if r.row.doc_id == 1)
    assert all(r.kept_text is None or count(r.kept_text) == r.n_symbols - r.n_removed for r in got if kind == "words")


def test_hot_anchors_are_split_window_by_window(spark, monkeypatch):
    from tessera.llm import repeats

    monkeypatch.setattr(repeats, "MAX_RUNS", 1)
    rng = random.Random(4)
    shared = [f"s{i}" for i in range(70)]
    rows = [(d, " ".join([f"x{rng.randint(0, 9)}" for _ in range(30)] + shared[d % 7 :] + [f"y{d}{i}" for i in range(20)])) for d in range(25)]
    got = {r.row.doc_id: (r.n_symbols, r.n_removed, r.n_spans, r.kept_sha256) for r in substring_dedup.dedup_words(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute.repeats(rows, "words", 50)


def test_removed_passages_leave_line_ends(spark):
    passage = " ".join(f"p{i}" for i in range(60))
    rows = [(1, f"a b\n{passage}\nc"), (2, f"é  one\ttwo\n{passage}\n\n three\n"), (3, None)]
    got = {r.row.doc_id: r.kept_text for r in substring_dedup.dedup_words(spark.createDataFrame(rows, "doc_id long, text string"), with_text=True).collect()}
    assert got == {1: rows[0][1], 2: "é  one\ttwo\nthree\n", 3: None}


@pytest.mark.parametrize(("kind", "dedup", "most"), [("words", substring_dedup.dedup_words, 4_000), ("bytes", suffix_dedup.dedup_bytes, 4_000), ("words", substring_dedup.dedup_words, 2)])
def test_repeats_across_batches(spark, monkeypatch, kind, dedup, most):
    from tessera.llm import repeats

    monkeypatch.setattr(repeats, "BATCH_BYTES", 6_000)
    monkeypatch.setattr(repeats, "PER_BUCKET", 4)
    monkeypatch.setattr(repeats, "MAX_RUNS", most)
    rng = random.Random(11)
    own = lambda n: [f"q{rng.randint(0, 10**6)}" for _ in range(n)]
    passages, texts = [own(rng.randint(55, 140)) for _ in range(6)], []
    for _ in range(150):
        parts = own(rng.randint(0, 60))
        for _ in range(rng.randint(0, 3)):
            p = list(rng.choice(passages))
            p = p[rng.randint(0, 20) : len(p) - rng.randint(0, 20)]
            if rng.random() < 0.5:
                p[rng.randrange(len(p))] = "edit"
            parts += p + own(rng.randint(0, 30))
        texts.append(" ".join(parts))
    rows = [(d, x) for d, x in enumerate(texts)] + [(200 + i, texts[i]) for i in range(20)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r.row.doc_id: (r.n_symbols, r.n_removed, r.n_spans, r.kept_sha256) for r in dedup(df).collect()}
    assert got == brute.repeats(rows, kind, 50)
    # two texts of one document, in different batches, are judged against the others alike
    twice = [(d // 2, x) for d, x in rows]
    least, parts = {}, [(d, x.split() if kind == "words" else list(x.encode())) for d, x in twice]
    for d, p in parts:
        for i in range(len(p) - 49):
            w = tuple(p[i : i + 50])
            least[w] = min(d, least.get(w, d))
    want = []
    for d, p in parts:
        gone = [False] * len(p)
        for i in range(len(p) - 49):
            if least[tuple(p[i : i + 50])] < d:
                gone[i : i + 50] = [True] * 50
        want.append((d, len(p), sum(gone)))
    got = dedup(spark.createDataFrame(twice, "doc_id long, text string").repartition(5)).collect()
    assert sorted((r.row.doc_id, r.n_symbols, r.n_removed) for r in got) == sorted(want)


def test_jaccard(spark, edge, edge_rows, nothing):
    assert jaccard.similar(nothing).count() == 0
    got = jaccard.similar(edge, 3, 90, 100).collect()
    assert len(got) == len(edge_rows)
    assert {r.component_id for r in got if r.doc_id in (0, 1, 7)} == {0}
    assert all(r.component_id is None for r in got if r.doc_id is None)
    assert all(r.component_id == r.doc_id for r in got if r.doc_id in (2, 4, 5, 6, 10))
    assert {r.component_id for r in got if r.doc_id in (8, 9)} == {8}
    kept = jaccard.one_of_each(edge, 3, 90)
    assert kept.columns == edge.columns
    kept = kept.collect()
    assert sorted(r.doc_id for r in kept if r.doc_id is not None) == [0, 2, 3, 4, 5, 6, 8, 10, 11, 12] and sum(r.doc_id is None for r in kept) == 2


def test_jaccard_links_chains_of_near_copies(spark):
    rng = random.Random(8)
    word = lambda: f"w{rng.randint(0, 5000)}"
    rows, text = [], [word() for _ in range(80)]
    for d in range(40):  # each differs from the last a little, the ends from each other a lot
        rows.append((d, " ".join(text)))
        text[rng.randint(0, 79)] = word()
    base = [word() for _ in range(100)]
    for d in range(40, 90):
        t = list(base)
        for _ in range(rng.randint(0, 3)):
            t[rng.randint(0, 99)] = word()
        rows.append((d, " ".join(t)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    for n, num in ((3, 90), (5, 80)):
        got = {r.doc_id: r.component_id for r in jaccard.similar(df, n, num, 100).collect()}
        assert got == brute.components(brute.shingles(rows, n), num, 100)


def test_jaccard_links_large_groups(spark, monkeypatch):
    """Near copies at about the threshold, in blocks that are smaller than their group; repeated rows; texts of one doc_id."""
    monkeypatch.setattr(jaccard, "BLOCK", 16)
    monkeypatch.setattr(jaccard, "CHUNK", 1 << 9)
    monkeypatch.setattr(jaccard, "BATCH_BYTES", 20_000)
    monkeypatch.setattr(jaccard, "PER_BUCKET", 2)
    rng = random.Random(9)
    word = lambda: f"w{rng.randint(0, 5000)}"
    rows, base = [], [[word() for _ in range(90)] for _ in range(3)]
    for d in range(240):
        t = list(base[d % 3])
        for _ in range(rng.randint(0, 5)):
            t[rng.randint(0, 89)] = word()
        rows.append((d, " ".join(t)))
    sets = brute.shingles(rows, 3)
    want = brute.components(sets, 90, 100)
    assert 3 < len(set(want.values())) < 200
    other = [(900, rows[0][1]), (900, rows[1][1])]  # one document with two texts links two groups
    df = spark.createDataFrame([*rows, *rows[:50], *other], "doc_id long, text string").repartition(6)
    got = {}
    for r in jaccard.similar(df, 3, 90, 100).collect():
        got.setdefault(r.doc_id, set()).add(r.component_id)
    joined = {want[0], want[1]}
    assert got == {d: {min(joined) if c in joined else c} for d, c in want.items()} | {900: {min(joined)}}


def test_jaccard_verifies_pairs_in_proportion_to_classes(spark, monkeypatch):
    """Versions of a text, with copies of each: what is rare is a version's own, so pivots link no two versions, but all of their copies are alike."""
    base = [f"w{i}" for i in range(200)]
    rows = []
    for d in range(160):
        t = list(base)
        t[20 * (d % 4)] = f"version{d % 4}"
        t[100 + d // 4] = f"own{d}"
        rows.append((d, " ".join(t)))
    seen, verified = [], jaccard._verified
    monkeypatch.setattr(jaccard, "_verified", lambda pairs, *rest: (seen.append(pairs.count()), verified(pairs, *rest))[1])
    df = spark.createDataFrame([*rows, (900, "something else")], "doc_id long, text string").repartition(4)
    assert {r.doc_id: r.component_id for r in jaccard.similar(df).collect()} == {d: 0 for d in range(160)} | {900: 900}
    assert sum(seen) < 8 * len(rows), seen


def test_mixing(spark, edge, edge_rows, nothing):
    assert mixing.mix(nothing).count() == 0
    got = mixing.mix(edge)
    assert set(got.columns) == set(edge.columns) | {"size", "source_size", "target", "taken"}
    rows = got.collect()
    assert len(rows) == len(edge_rows)
    assert sorted(r["size"] for r in rows) == sorted(count(r[1]) for r in edge_rows)
    assert all(r["taken"] in (0, r["size"], 2 * r["size"]) for r in rows)
    assert sorted(map(str, rows)) == sorted(map(str, mixing.mix(edge.repartition(5)).collect()))
    total = sum(count(r[1]) for r in edge_rows)
    targets = {r["source"]: (r["target"], r["source_size"]) for r in rows}
    assert abs(sum(x for x, _ in targets.values()) - 1.5 * total) < 1e-6
    assert all(x <= 2 * n + 1e-9 for x, n in targets.values())


def test_mixing_of_ties_does_not_depend_on_partitions(spark):
    rows = [(None, f"t{i} b c", "s", str(i)) for i in range(30)] + [(7, "same text", "s", str(i)) for i in range(9)] + [(1, "x " * 300, "u", "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, size string")
    want = None
    for n in (1, 3, 7):
        got = sorted((str(r.doc_id), r.text, r.taken) for r in mixing.mix(df.repartition(n)).collect())
        assert want is None or got == want
        want = got
    assert 0 < sum(t > 0 for _, _, t in want) <= len(rows)


def test_targets_are_water_filled(spark):
    sizes = spark.createDataFrame([("a", 10), ("b", 1000), ("c", 500), (None, 90)], "source string, source_size long")
    got = {r.source: r.target for r in mixing.targets(sizes, (5, 2, 1), (3, 2), 2).collect()}
    want, left, free = {}, 2400.0, {"a": (5, 20), "b": (2, 2000), "c": (1, 1000), None: (5, 180)}
    while True:
        level = left / sum(w for w, _ in free.values())
        full = {k for k, (w, cap) in free.items() if w * level >= cap}
        if not full:
            break
        for k in full:
            want[k] = float(free[k][1])
            left -= free.pop(k)[1]
    want |= {k: w * level for k, (w, _) in free.items()}
    assert got == pytest.approx(want)


def test_quality_rules(edge, edge_rows, nothing):
    assert quality_rules.quality_rules(nothing).count() == 0 and quality_rules.without_frequent_lines(nothing).count() == 0
    rows = quality_rules.quality_rules(edge).collect()
    assert len(rows) == len(edge_rows)
    by = {(r.doc_id, r.text): r for r in rows}
    assert by[(6, "A b\nA b\nÄ c")].n_dup_lines == 1 and by[(12, "É #|& " * 9)].n_symbols == 27 and by[(12, "É #|& " * 9)].word_chars == 36
    assert by[(10, "x " * 300)].n_repeat_words == 300 and by[(10, "x " * 300)].base_failed
    assert by[(2, None)].n_words == 0 and by[(2, None)].base_failed


def test_frequent_lines_are_cut(spark):
    own = lambda d: " ".join(f"own{d}x{i}" for i in range(30))
    rows = [(d, f"Menu  ITEM {d % 10}\n{own(d)}", "h") for d in range(30)] + [(99, "menu item 7\n" * 12, "h"), (100, own(100), "h")]
    got = {r.doc_id: r for r in quality_rules.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert got[0].n_cut == 3 and got[0].kept and got[99].n_cut == 36 and not got[99].kept and got[100].n_cut == 0 and got[100].kept


def test_frequent_lines_in_a_large_host(spark):
    own = lambda d: " ".join(f"own{d}x{i}" for i in range(30)).translate({48 + i: 97 + i for i in range(10)})  # noqa: E731  digits would be one to the rule
    rows = [(d, ("on sixty pages\n" if d < 60 else "on fifty pages\n" if d < 110 else "") + own(d), "h") for d in range(1500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r.doc_id: r.n_cut for r in quality_rules.quality_rules(docs).collect()}
    assert got == {d: 3 if d < 60 else 0 for d in range(1500)}
    assert [r["line"] for r in quality_rules.without_frequent_lines(docs).collect()] == ["on sixty pages"]


def test_frequent_lines_of_repeated_rows(spark):
    own = lambda d: " ".join(f"own{d}x{i}" for i in range(30)).translate({48 + i: 97 + i for i in range(10)})  # noqa: E731  digits would be one to the rule
    rows = [(d, f"menu item\n{own(d)}\nMenu Item", "h") for d in range(30)] + [(50, "menu item\n" * 5 + own(50), "h")]
    docs = spark.createDataFrame([*rows, rows[0], rows[-1], rows[-1]], "doc_id long, text string, source string")
    got = quality_rules.quality_rules(docs).collect()
    assert len(got) == 34 and all(r.n_cut == (10 if r.doc_id == 50 else 4) and r.kept for r in got)


def test_frequent_lines_are_found_once(edge):
    """The result reads the frequent lines from a table; lines are split once more only, to be looked up there."""
    plan = quality_rules.quality_report(edge)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate explode") == 1


def test_decontamination(spark, edge, edge_rows, nothing):
    bench = spark.createDataFrame([(1, " ".join(edge_rows[0][1].split()[20:45])), (2, None), (3, ""), (4, "one"), (None, "Ä c"), (5, "never there at all")], "item_id long, text string")
    assert decontaminate.decontaminate(nothing, bench).count() == 0
    assert decontaminate.decontaminate(edge, bench.limit(0)).where("contaminated").count() == 0
    rows = decontaminate.decontaminate(edge, bench).collect()
    assert len(rows) == len(edge_rows) and {"size", "score", "key"} <= set(rows[0].asDict())
    by = {(r.doc_id, r.text): r for r in rows}
    assert (by[(0, edge_rows[0][1])].n_hit, by[(0, edge_rows[0][1])].item_ids) == (25, "1")
    assert by[(5, "one")].item_ids == "4" and by[(6, "A b\nA b\nÄ c")].item_ids == "" and by[(6, "A b\nA b\nÄ c")].n_hit == 2
    assert not by[(2, None)].contaminated and by[(2, None)].n_words == 0
    assert sum(r.contaminated for r in rows if r.doc_id == 0) == 2


def test_proximity(spark):
    rng = random.Random(4)
    texts = [[rng.choice("abcdefgh") for _ in range(rng.randint(0, 30))] for _ in range(60)]
    asked = [["a", "b"], ["h"], ["c", "c", "d", "e"], ["a", "z"], [], ["a", "b", "c", "d", "e"]]
    docs = spark.createDataFrame(list(enumerate(texts)), "key int, terms array<string>").repartition(3)
    queries = spark.createDataFrame(list(enumerate(asked)), "query_id int, terms array<string>")
    want = set()
    for q, terms in enumerate(asked):
        for k, t in enumerate(texts):
            for i, w in enumerate(t):
                if w in terms and set(terms) <= set(t[i : i + 6]):
                    want.add((q, k, i, i + max(t[i : i + 6].index(x) for x in terms)))
    got = [(r.query_id, r.key, r["first"], r["last"]) for r in decontaminate.proximity(docs, queries, 6).collect()]
    assert len(got) == len(set(got)) and set(got) == want and {q for q, *_ in want} == {0, 1, 2, 5}


def test_licenses(spark, edge, edge_rows, nothing):
    assert licenses.scan_licenses(nothing).count() == 0
    assert licenses.scan_licenses(edge).count() == len(edge_rows)
    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\nThe software is provided \"as is\", without warranty of any kind, express or implied, including but not limited to the warranties of merchantability, fitness for a particular purpose and noninfringement."
    got = licenses.scan_licenses(spark.createDataFrame([(mit,), ("\n".join(reversed(mit.split("\n"))),), ("Text. Licensed under CC BY-NC 4.0.\nAll rights reserved.",), (None,)], "text string")).collect()
    assert [r.licenses for r in got] == ["MIT", "", "CC-BY-NC-4.0,Proprietary", ""]
    assert got[3].n_sentences == 0 and got[2].sentence_ids == "cc-by-nc-4-notice,all-rights-reserved"


APACHE = """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License."""
MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER"""
BSD = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.

3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission."""
GPL = """    This program is free software{0} you can redistribute it and/or modify
    it under the terms of the GNU General Public License as published by
    the Free Software Foundation{1} either version {2} of the License, or
    (at your option) any later version.

    This program is distributed in the hope that it will be useful,
    but WITHOUT ANY WARRANTY; without even the implied warranty of
    MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
    GNU General Public License for more details."""
MPL = """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at https://mozilla.org/MPL/2.0/."""


def test_licenses_as_published(spark):
    gpl2, gpl3 = GPL.format(";", ";", 2), GPL.format(":", ",", 3)
    want = {MIT: "MIT", BSD: "BSD-3-Clause", BSD.split("\n\n3.")[0]: "BSD-2-Clause", gpl2: "GPL-2.0-or-later", gpl3: "GPL-3.0-or-later", MPL: "MPL-2.0", APACHE: "Apache-2.0", APACHE.split("\n", 1)[1]: "Apache-2.0"}
    shapes = {"lf": lambda t: t, "crlf": lambda t: t.replace("\n", "\r\n"), "comment": lambda t: "\n".join(" * " + x for x in t.split("\n")), "unwrapped": lambda t: "\n\n".join(" ".join(p.split()) for p in t.split("\n\n"))}
    rows = [(shape, f(t), name) for t, name in want.items() for shape, f in shapes.items()]
    rows += [("cut", "Some text.\nAll rights\n\nreserved.", ""), ("more", "Not all rights reserved.", ""), ("once", "This project is\nlicensed under the MIT\nLicense.", "MIT")]
    got = licenses.scan_licenses(spark.createDataFrame(rows, "shape string, text string, want string")).collect()
    assert [(r["shape"], r.want) for r in got if r.licenses != r.want] == []
    assert got[-1].sentence_ids == "mit-notice"


def test_chats(spark):
    schema = "conv_id long, turn long, role string, text string, pos string"
    a = [("user", "hi"), ("assistant", "yes"), ("user", "more"), ("assistant", None)]
    rows = [(1, i, *x, "z") for i, x in enumerate(a[:2])] + [(2, i, *x, "z") for i, x in enumerate(a)] + [(3, i, *x, "z") for i, x in enumerate(a)]
    rows += [(4, 0, "user", "hi", "z"), (5, 0, None, "hi", "z"), (None, None, "user", "x", "z"), (2, 0, "user", "hi", "other")]
    rows += [(6, i, "user", f"t{i}", "z") for i in range(600)]
    df = spark.createDataFrame(rows, schema).repartition(4)
    kept = {r.conv_id: (r.n_turns, r.n_copies) for r in chat.maximal(df).collect()}
    assert kept == {2: (4, 2), 5: (1, 1), None: (1, 1), 6: (600, 1)}
    out = chat.format_chats(df).collect()
    assert len(out) == 606 and {r.rendered for r in out if r.conv_id == 5} == {"<|im_start|>user\nhi<|im_end|>\n"}
    texts = {r.conv_id: r.text for r in chat.as_texts(chat.format_chats(df)).collect()}
    assert texts[2] == "".join(f"<|im_start|>{r}\n{x or ''}<|im_end|>\n" for r, x in a) and texts[6].count("im_start") == 600
    assert chat.format_chats(df.limit(0)).count() == 0


def test_quality_model(spark, edge, edge_rows, nothing):
    labels = spark.createDataFrame([(0, 1), (0, 1), (1, 1), (7, 1), (8, 1), (10, 0), (12, 0), (77, 1), (None, 0), (9, None)], "doc_id long, quality int")
    assert quality_model.score_documents(nothing, labels).count() == 0
    assert quality_model.score_documents(edge, labels.limit(0)).select("doc_score").distinct().count() == 1
    x = quality_model.score_documents(edge, labels)
    assert set(x.columns) == set(edge.columns) | {"doc_score", "path_score", "score", "accepted"}
    rows = x.collect()
    assert len(rows) == len(edge_rows) and all(0 <= r["score"] <= 1 for r in rows)
    assert all(r.accepted for r in rows if r.doc_id in (0, 1)) and not any(r.accepted for r in rows if r.doc_id == 10)


def test_quality_fit_needs_little_memory_of_the_driver(spark):
    """The driver has one block of labelled rows unpacked at a time, and the weights are the optimum of the risk over all rows."""
    rng = random.Random(8)
    rows = [(i, " ".join(f"{'bad' if i % 3 else 'w'}{rng.randrange(60)}" if rng.random() < 0.2 else f"v{rng.randrange(300)}" for _ in range(12)), int(i % 3 == 0)) for i in range(6_000)]
    labelled = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    tracemalloc.start()
    centre, scale, w = quality_model.fit_documents(labelled)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 70e6
    x, pairs = quality_model.evidence([t for _, t, _ in rows])
    y, has = np.array([q for *_, q in rows], float), np.zeros((len(rows), quality_model.BUCKETS))
    has.ravel()[pairs] = 1
    full = np.hstack([quality_model._numbers(x, centre, scale), has / np.sqrt(has.sum(1, keepdims=True)), np.ones((len(rows), 1))])
    assert np.abs(full.T @ (1 / (1 + np.exp(-full @ w)) - y) / len(y) + 3e-3 * w).max() < 1e-4


def test_posteriors_against_a_plain_version(spark):
    """Posterior means of paths and hosts, each without the document's own score."""
    rng = random.Random(6)
    rows = [(i, "a", "x", 0.9 - rng.random() / 20) for i in range(300)] + [(i, "a", "y", 0.1) for i in range(200)] + [(0, "b", "x", 0.1), (1, None, None, 0.4), (2, None, "y", 0.5)]
    df = spark.createDataFrame(rows, "doc_id long, host string, path string, doc_score double").withColumns({"_h": quality_model.row_key(F.col("host")), "_p": quality_model.row_key(F.col("host"), F.col("path"))})
    groups, mean, a, b = quality_model.posteriors(df.groupBy("_h", "_p").agg(F.count("*").alias("n"), F.sum("doc_score").alias("s")))
    got = df.join(groups, "_p").withColumn("path_score", quality_model.left_out(F.col("doc_score"), mean, a, b)).collect()

    def strength(parts):  # parts: (size, mean, mean of what stands above)
        parts = [x for x in parts if x[0] > 1]
        between, within, weighted = (sum(f(*x) for x in parts) for f in (lambda n, m, p: n * (m - p) ** 2, lambda n, m, p: p * (1 - p), lambda n, m, p: n * p * (1 - p)))
        return min(max(1 / max((between - within) / max(weighted - within, 1e-9), 1e-4) - 1, 1.0), 10_000.0)

    def group(key):
        out = {}
        for r in rows:
            out.setdefault(key(r), []).append(r[3])
        return out

    hosts, paths = group(lambda r: r[1]), group(lambda r: (r[1], r[2]))
    assert mean == pytest.approx(sum(r[3] for r in rows) / len(rows))
    assert a == pytest.approx(strength([(len(x), sum(x) / len(x), mean) for x in hosts.values()]))
    assert b == pytest.approx(strength([(len(x), sum(x) / len(x), (sum(hosts[h]) + a * mean) / (len(hosts[h]) + a)) for (h, _), x in paths.items()]))
    for r in got:
        h, p = hosts[r.host], paths[r.host, r.path]
        host = (sum(h) - r.doc_score + a * mean) / (len(h) - 1 + a)
        assert r.path_score == pytest.approx(min(max((sum(p) - r.doc_score + b * host) / (len(p) - 1 + b), 1e-3), 1 - 1e-3))
    by = {(r.host, r.path): r.path_score for r in got}
    assert by["a", "x"] > 0.8 and by["a", "y"] < 0.2 and 0.25 < by["b", "x"] < 0.6


def test_evidence_counts():
    x, has = quality_model.evidence(["Ab ab 1 | é!\n# ab ab", None, ""])
    assert x[0].tolist() == pytest.approx([np.log1p(8), 13 / 8, 2 / 20, 1 / 20, 1 / 20, 1 / 20, 1 / 20, 5 / np.sqrt(8 * np.log1p(8)), 2 / 8, np.log1p(1)])
    assert not x[1].any() and (x[1] == x[2]).all() and 1 <= len(has) <= 5 and not (has // quality_model.BUCKETS).any()


def test_toxicity(spark, edge, edge_rows, nothing):
    rng = random.Random(1)
    text = lambda bad: " ".join([f"w{rng.randint(0, 300)}" for _ in range(60)] + ["grobian"] * bad)
    docs = spark.createDataFrame([(i, text(i % 8 == 0)) for i in range(1200)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 8 == 0)) for i in range(0, 1200, 2)] + [(None, 1), (5000, None)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    got = toxicity.score(docs, model).collect()
    assert all(r.predicted == (r.doc_id % 8 == 0) for r in got)
    # labels of held-out rows and the order of rows change nothing
    flipped = labels.withColumn("toxic", F.when(toxicity.held_out(labels), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert np.array_equal(toxicity.train(docs.repartition(7), flipped)[1], model[1])
    rows = toxicity.score(edge, model).collect()
    assert len(rows) == len(edge_rows) and all(r.predicted == 0 for r in rows) and all(0 <= float(r["score"]) <= 1 for r in rows)
    assert toxicity.score(nothing, model).count() == 0
    assert toxicity.score(edge, toxicity.train(docs, labels.limit(0))).where("predicted = 1").count() == 0


def test_risk_estimator_against_a_plain_version():
    import math

    rng, prior = random.Random(3), 0.2
    width = 9
    sets = [[[c for c in range(width) if rng.random() < 0.3] for _ in range(n)] for n in (7, 12)]
    positive, unlabelled = (toxicity.Rows([np.array(s, int) for s in x], width) for x in sets)
    w, b = np.array([rng.gauss(0, 1) for _ in range(width)]), 0.3

    def plain(w, b):
        def mean(rows, loss):
            return sum(loss(1 / (1 + math.exp(-(b + sum(w[c] for c in s))))) for s in rows) / len(rows)

        return prior * mean(sets[0], lambda p: -math.log(p)), mean(sets[1], lambda p: -math.log(1 - p)) - prior * mean(sets[0], lambda p: -math.log(1 - p))

    scores = [1 / (1 + np.exp(-x.logits(w, b))) for x in (positive, unlabelled)]
    assert toxicity.risks(*scores, prior) == pytest.approx(plain(w, b))
    # gradients of both parts against differences
    d_pos = positive.pulled(prior * (scores[0] - 1) / positive.n)
    d_neg = unlabelled.pulled(scores[1] / unlabelled.n) - positive.pulled(prior * scores[0] / positive.n)
    for k in range(width + 1):
        at = lambda e: plain(w + e * (np.arange(width) == k), b + e * (k == width))  # noqa: B023, E731
        up, down = at(1e-5), at(-1e-5)
        assert [(x - y) / 2e-5 for x, y in zip(up, down, strict=True)] == pytest.approx([d_pos[k], d_neg[k]], abs=1e-6)
    # fitted weights lower the risk that is clipped at zero
    risk = lambda w, b: (lambda p, n: p + max(0.0, n))(*plain(w, b))
    assert risk(*toxicity.fit(positive, unlabelled, prior)) < min(risk(np.zeros(width), np.log(prior / (1 - prior))), risk(w, b))


def test_bounds_of_the_toxicity_sample(spark):
    rng = random.Random(1)
    docs = spark.createDataFrame([(i, " ".join([f"w{rng.randint(0, 300)}" for _ in range(40)] + ["grobian"] * (i % 4 == 0))) for i in range(1600)], "doc_id long, text string")
    labels = docs.selectExpr("doc_id", "int(doc_id % 4 = 0) AS toxic")
    rows = toxicity.score(docs, toxicity.train(docs, labels, max_positive=100, max_unlabelled=300)).collect()
    assert sum(r.predicted == (r.doc_id % 4 == 0) for r in rows) >= 1590


@pytest.mark.parametrize("name,gram", [("bytes", 16), ("words", 8)])
def test_runs_work_in_pieces_of_cache_size(name, gram):
    import tracemalloc

    from tessera.llm import repeats as R

    rng = np.random.default_rng(3)
    counts = np.array([0, 70_000, 3, 50, 0, 1_900_000, 49, 51, 300_000, 0])
    symbols = rng.integers(97, 123, int(counts.sum())).astype(np.uint8 if name == "bytes" else np.uint64)
    kind = R.Kind(name, 50, gram)
    tracemalloc.start()
    anchors = kind.runs(symbols, counts, content=False, sides=False)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 5 * sum(x.nbytes for x in anchors) + 8_000_000
    runs = kind.runs(symbols, counts)
    assert not len(anchors.content) and not len(anchors.left)
    assert all(np.array_equal(a, b) for a, b in zip(anchors[:4], runs[:4], strict=True))
    # every window of every text is in one run
    ends = np.cumsum(counts)
    wanted = [np.arange(e - n, e - 49) for e, n in zip(ends, counts, strict=True) if n >= 50]
    have = [np.arange(a, b + 1) for a, b in zip(runs.first, runs.last, strict=True)]
    assert np.array_equal(np.concatenate(have), np.concatenate(wanted))
    assert ((ends - counts)[runs.text] <= runs.first).all() and (runs.last + 50 <= ends[runs.text]).all()
