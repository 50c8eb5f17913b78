"""The registered queries against DuckDB, or against plain versions, on the smallest tables."""

import pytest
from conftest import SF
from tessera.llm import queries as Q

from . import brute


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_matches_sql(compare, name):
    compare(name, Q.queries(), Q.oracle_sql())


@pytest.fixture(scope="module")
def texts(spark):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]


def test_op3(spark, texts):
    sets = brute.shingles(texts, 3)
    want = brute.components(sets, 90, 100)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in Q.op3_jaccard_join(spark, SF).collect()}
    assert got == {d: (len(s), want[d]) for d, s in sets.items()}


def test_op5(spark, texts):
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in Q.op5_substring_dedup(spark, SF).collect()}
    assert got == {d: (n, k, h) for d, (n, k, _, h) in brute.repeats(texts, "words", 50).items()}


def test_op7(spark, texts):
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in Q.op7_suffix_dedup(spark, SF).collect()}
    assert got == brute.repeats(texts, "bytes", 50)


def test_benchmark_proximity(spark, texts):
    import re

    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    items = {r.item_id: words(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    windows = {(k, frozenset(w[i : i + 10])) for k, w in items.items() for i in range(max(len(w) - 9, 1)) if w}
    want = {}
    for d, t in texts:
        w = words(t)
        have = set(w)
        near = {k for k, x in windows if x <= have and any(x <= set(w[i : i + 20]) for i in range(len(w)))}
        if near:
            want[d] = len(near)
    assert {r.doc_id: r.n_near for r in Q.benchmark_proximity(spark, SF).collect()} == want and want


def test_op4_accepts_good_documents_and_rejects_junk(spark):
    d = SF.replace("sf0.001", "sf0.01")
    x = Q.op4_quality_classifier(spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").groupBy("quality", "accepted").count().collect()
    n = {(r["quality"], r["accepted"]): r["count"] for r in x}
    assert n.get((1, True), 0) >= 0.97 * (n.get((1, True), 0) + n.get((1, False), 0))
    assert n.get((0, False), 0) >= 0.9 * (n.get((0, True), 0) + n.get((0, False), 0))


def test_op6_finds_held_out_toxic_documents(spark):
    import zlib

    d = SF.replace("sf0.001", "sf0.1")
    rows = Q.op6_toxicity(spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and r.predicted == (r.score >= 0.7) for r in rows)
    held = [r for r in rows if r.held_out]
    toxic, clean = [r for r in held if r.toxic], [r for r in held if not r.toxic]
    assert sum(r.predicted for r in toxic) >= 0.85 * len(toxic)
    assert sum(r.predicted for r in clean) <= 0.02 * len(clean)


def test_pipeline_against_plain_versions(spark, tmp_path):
    import corpus_pipeline as P
    from tessera.llm import common as C

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    by_name = dict(P.STAGES)
    good = C.cut(by_name["quality"](spark, docs, SF))
    assert good.columns == docs.columns and 0 < good.count() < docs.count()
    one = C.cut(by_name["near_duplicates"](spark, good, SF))
    rows = [(r.doc_id, r.text) for r in good.collect()]
    root = brute.components(brute.shingles(rows, 5), 80, 100)
    assert sorted(r.doc_id for r in one.collect()) == sorted(d for d, r in root.items() if d == r)
    fresh = C.cut(by_name["repeated_passages"](spark, one, SF))
    rows = [(r.doc_id, r.text) for r in one.collect()]
    want = brute.repeats(rows, "words", 50)
    assert fresh.columns == docs.columns
    assert {r.doc_id: len(r.text.encode().split()) for r in fresh.collect()} == {d: n - k for d, (n, k, _, _) in want.items() if k < n or not n}
    clean = C.cut(by_name["benchmark_passages"](spark, fresh, SF))
    from tessera.llm.decontaminate import decontaminate

    hit = {r.doc_id for r in decontaminate(fresh, spark.read.parquet(f"{SF}/benchmark.parquet")).where("contaminated").collect()}
    assert clean.columns == docs.columns
    assert {r.doc_id for r in clean.collect()} == {r.doc_id for r in fresh.collect()} - hit
    mixed = by_name["mix"](spark, clean, SF)
    assert 0 < mixed.count() <= clean.count()


def test_stages_on_odd_rows(spark, edge, edge_rows, nothing):
    """Nulls, empty and very long texts, ties, repeated rows, empty tables, and extra columns named like the operators' own."""
    import corpus_pipeline as P
    from tessera.llm import common as C

    docs = C.cut(edge)
    for name, stage in P.STAGES:
        empty = stage(spark, nothing, SF)
        assert empty.count() == 0
        out = C.cut(stage(spark, docs, SF))
        rows = out.collect()
        if name == "mix":
            assert set(out.columns) == set(docs.columns) | {"source_size", "target", "taken"} and all(r.taken % r["size"] == 0 for r in rows)
            continue
        assert out.columns == docs.columns and out.schema["text"] == docs.schema["text"]
        assert {(r.doc_id, r.key) for r in rows} <= {(r[0], r[9]) for r in edge_rows}
        if name == "near_duplicates":
            ids = [r.doc_id for r in rows if r.doc_id is not None]
            assert len(ids) == len(set(ids)) and {2, 3, 5, 6} <= set(ids) and not {1, 7, 9} & set(ids)
        if name == "repeated_passages":
            by = {(r.doc_id, r.key): r.text for r in rows}
            assert (7, "e") not in by and by[0, "e"] == edge_rows[0][1] and by[2, "e"] is None and by[9, "e"] == "more"
