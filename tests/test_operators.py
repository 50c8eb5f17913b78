"""Worked values of single operators, and checks that guard writes."""

import random

import pytest
from pyspark.sql import functions as F
from tessera.functions import models as M
from tessera.functions import text as X
from tessera.operators import answer as AN
from tessera.operators import chunking as C
from tessera.operators import enrich as EN
from tessera.operators import evaluate as EV
from tessera.operators import index as IX
from tessera.operators import ingest as IN
from tessera.operators import retrieve as R
from tessera.plans import config as CF
from tessera.plans import retrieval as RT
from tessera.plans.config import parse_request
from tessera.sources import tables as TB
from tessera.streaming import dialogue as DI


def rows(df, *names):
    return sorted(tuple(r[n] for n in names) for r in df.collect())


def merged_by_hand(sizes, least=50):
    groups = []
    for n in sizes:
        if groups and n < least:
            groups[-1].append(n)
        else:
            groups.append([n])
    while len(groups) > 1 and sum(groups[0]) < least:
        groups[:2] = [groups[0] + groups[1]]
    return groups


def test_merge_small(spark):
    rng = random.Random(3)
    cases = [[60, 60], [60, 5], [5, 60], [5] * 5, *[[rng.choice([5, 20, 49, 50, 90]) for _ in range(rng.randint(1, 9))] for _ in range(60)]]
    df = spark.createDataFrame([(i, j, n) for i, c in enumerate(cases) for j, n in enumerate(c)], "doc int, ord int, n int")
    got = C.merge_small(df, ["doc"], "ord", "n").collect()
    for i, case in enumerate(cases):
        by = {}
        for r in sorted((r for r in got if r.doc == i), key=lambda r: r.ord):
            by.setdefault(r.group, []).append(r.n)
        assert list(by.values()) == merged_by_hand(case)


def test_runs_keep_what_comes_back_apart(spark):
    df = spark.createDataFrame([(0, "a"), (1, "a"), (2, None), (3, None), (4, "a")], "ord int, k string")
    assert [r.run for r in C.contiguous_runs(df, [], ["ord"], F.col("k")).orderBy("ord").collect()] == [1, 1, 2, 2, 3]


def test_segments(spark):
    df = spark.createDataFrame([(0, "preamble"), (1, "9-1 A"), (2, "x"), (3, "9-1.1.1 B"), (4, "9-1 C"), (5, "9-1.1 D")], "ord int, line string")
    df = df.withColumn("doc", F.lit(1))
    number = F.regexp_extract("line", X.SECTION_START, 1)
    got = IN.segments(df, ["doc"], "ord", F.when(number != "", X.fold_to_unit(number)), "line").orderBy("section").collect()
    assert [(r.unit, r.n_items) for r in got] == [("9-1", 2), ("9-1.1", 1), ("9-1", 1), ("9-1.1", 1)]


def test_markdown_sections(spark):
    text = "before\n# T1\n## a\nx\n### in a\n## Índice\nno\n# T2\nlost\n## b\ny"
    df = spark.createDataFrame([("f", i, s) for i, s in enumerate(text.split("\n"))], "file string, ord int, line string")
    got = IN.markdown_sections(df, "file", "ord").orderBy("n").collect()
    assert [(r.topic, r.title, r.text) for r in got] == [("T1", "a", "x\n### in a"), ("T2", "b", "y")]


def test_headings_tables_and_rows(spark):
    s = spark.createDataFrame([("1-1", "Title", "1-1 Title"), ("1-2", "T", "1-2 T body"), ("1-3", "T", "")], "unit string, title string, text string")
    assert [r.unit for r in IN.not_only_heading(s).collect()] == ["1-2"]
    t = spark.createDataFrame([("9-1", "first", 0, 1), ("9-1", "second", 7, 2), ("9-1", "x", 9, 3)], "table_id string, caption string, page int, ord int")
    r = IN.table_pointers(t).first()
    assert (r.text, r.first_page, r.last_page) == ("Table 9-1. first", 7, 9)
    lines = spark.createDataFrame([("10 20 30 40 a\nsome words and 1 2 3\n1 2 3",)], "t string")
    assert lines.select(IN.numeric_rows(F.col("t")).alias("x")).first().x == ["10 20 30 40 a"]


def test_text_functions(spark):
    df = spark.createDataFrame([(" a­ b\t c \n d ", "9-8.2.1", "<think>x\ny</think> ok ")], "a string, b string, c string")
    r = df.select(X.clean(F.col("a")).alias("a"), X.fold_to_unit(F.col("b")).alias("b"), X.strip_thinking(F.col("c")).alias("c")).first()
    assert (r.a, r.b, r.c) == ("a b c\nd", "9-8.2", "ok")
    cut = spark.createDataFrame([("Depth limits. The diver goes", ), ("No. Sentence ends here", )], "t string").select(X.split_title(F.col("t")).alias("t")).collect()
    assert [x.t for x in cut] == ["Depth limits", "No. Sentence ends here"]


@pytest.mark.parametrize(
    ("text", "pairs"),
    [
        ("ascenso a 18 m/min", [("18", "m/min")]),
        ("10.3 metros y 5 MINUTOS", [("10,3", "m"), ("5", "min")]),
        ("a 1,4 bar y 21%", [("1,4", "bar"), ("21", "%")]),
        ("30 mm, 5 metrosx, v2.5 m", []),
        ("60 fsw/min", [("60", "fsw/min")]),
    ],
)
def test_unit_pairs(spark, text, pairs):
    got = spark.createDataFrame([(text,)], "t string").select(X.unit_pairs(F.col("t")).alias("p")).first().p
    assert [(p.number, p.unit) for p in got] == pairs


def test_rrf_orders_by_score_then_id(spark):
    def ranking(ids):
        return spark.createDataFrame([(1, x, i + 1) for i, x in enumerate(ids)], "query_id int, id string, rank int")

    assert [r.id for r in R.rrf([ranking("abc"), ranking("bca")], 9).orderBy("rank").collect()] == ["b", "a", "c"]
    assert [r.id for r in R.rrf([ranking("b"), ranking("a")], 9).orderBy("rank").collect()] == ["a", "b"]
    assert [r.id for r in R.rrf([ranking("abc"), ranking("bad")], 9).orderBy("rank").collect()] == list("abcd")


def test_parents_keep_their_best_place(spark):
    hits = spark.createDataFrame([(1, x, i + 1) for i, x in enumerate(["a2::hype::0", "a1", "a2", "a1::hype::0", "a3"])], "query_id int, id string, rank int")
    got = R.to_parents(hits, F.substring_index("id", "::", 1), 9).orderBy("rank").collect()
    assert [(r.parent, r.rank) for r in got] == [("a2", 1), ("a1", 2), ("a3", 3)]


def test_bm25_fills_up_with_zero_scores(spark):
    docs = spark.createDataFrame([(i, x) for i, x in enumerate(["alpha beta", "gamma", "alpha", "delta"])], "id int, text string")
    q = spark.createDataFrame([(1, "unknown"), (2, "gamma")], "query_id int, text string")
    got = R.bm25_top(q, docs, 3)
    assert [r.id for r in got.where("query_id = 1").orderBy("rank").collect()] == [0, 1, 2]
    assert [r.id for r in got.where("query_id = 2").orderBy("rank").collect()] == [1, 0, 2]


def test_metrics_by_hand(spark):
    hits = spark.createDataFrame([("q1", 1, ["s9"]), ("q1", 2, ["s1"]), ("q2", 1, ["s2"]), ("q3", 1, ["s1"])], "query_id string, rank int, sections array<string>")
    labels = spark.createDataFrame([("q1", ["s1", "s3"]), ("q2", ["nowhere"]), ("q3", [])], "query_id string, sections array<string>")
    got = rows(EV.question_metrics(hits, labels, 2), "query_id", "hit", "precision", "mrr", "recall")
    assert got == [("q1", 1.0, 0.5, 0.5, 0.5), ("q2", 0.0, 0.0, 0.0, 0.0)]
    tokens = spark.createDataFrame([("q1", 30), ("q2", 40), ("q3", 50)], "query_id string, tokens int")
    r = EV.summary(EV.question_metrics(hits, labels, 2), tokens).first()
    assert (r.hit_rate, r.mean_tokens, r.n_scored, r.n_queries) == (0.5, 40.0, 2, 3)
    assert rows(EV.best_ranks(hits.where("query_id = 'q1'")), "section", "rank") == [("s1", 2), ("s9", 1)]


def test_enrichment_is_incremental(spark):
    chunks = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3")], "id string, fingerprint string")
    cache = spark.createDataFrame([("a", "1", 1), ("b", "old", 1), ("b", "2", 2), ("x", "9", 1)], "id string, fingerprint string, n int")
    todo = EN.to_enrich(chunks, cache, "n")
    assert rows(todo, "id") == [("c",)]
    made = todo.withColumn("n", F.lit(3))
    after = EN.merged(chunks, cache, made, "n")
    assert rows(after, "id", "fingerprint") == [("a", "1"), ("b", "2"), ("c", "3")]
    assert EN.to_enrich(chunks, after, "n").isEmpty()
    q = spark.createDataFrame([(["a", "b", "c"], "x"), (["a", "a", "b"], " "), (["a"], None)], "q array<string>, c string")
    assert [tuple(r) for r in q.select(EN.valid_questions(F.col("q")), EN.valid_context(F.col("c"))).collect()] == [(True, True), (False, False), (False, False)]


def test_index_checks(spark):
    chunks = spark.createDataFrame([("a", "x", 5), ("b", "y", 900)], "id string, text string, n int")
    with pytest.raises(ValueError, match="cap"):
        C.require_cap(chunks, "n", 512)
    with pytest.raises(ValueError, match="repeated"):
        C.require_unique(chunks.unionByName(chunks), "id")
    with pytest.raises(ValueError, match="'b'"):
        IX.require_enriched(chunks, chunks.where("id = 'a'"))
    assert chunks.select(IX.metadata(["id", "n"]).alias("m")).first().m == {"id": "a", "n": "5"}


def test_answer_prompts_and_windows(spark):
    df = spark.createDataFrame([(1, "en", None, "i1", "t1", "why?"), (2, None, "T", "i2", "t2", "why?")], "r int, c string, t string, i string, x string, q string")
    got = df.agg(AN.prompt(F.col("r"), F.col("c"), F.col("t"), F.col("i"), F.col("x"), F.col("q")).alias("p")).first().p
    assert got == "[en · i1]\nt1\n\n[? · T]\nt2\n\nwhy?"
    for n in (0, 2, 3, 5):
        h = spark.range(1).select(AN.last_turns(F.array(*[F.lit(i) for i in range(n)]).cast("array<int>")).alias("h")).first().h
        assert h == list(range(n))[-3:]


def test_config_and_requests():
    c = CF.settings(**CF.BEST)
    assert (CF.run_name(c), CF.collection(c), CF.candidates(c)) == ("combined-512-contextual-qwen8b-hibrida-k10-rerank", "combined-512-contextual-qwen8b", 20)
    for bad in (CF.BEST | {"k": 4}, CF.BEST | {"colour": "red"}, {k: v for k, v in CF.BEST.items() if k != "corpus"}):
        with pytest.raises(ValueError):
            CF.settings(**bad)
    assert len(list(CF.grid(search="densa", k=5))) == 36
    with pytest.raises(ValueError):
        CF.grid(embedding="none")
    good = {"question": "q", "history": [["a", "b"]], "model": "m", "config": {"corpus": "manual", "extras": "base", "embedding": "bgem3", "search": "densa", "k": 3}}
    assert parse_request(good, ("m",))[0] == [("a", "b")]
    for bad in ({"question": " "}, {"history": [["a"]]}, {"model": "x"}, {"config": {}}):
        with pytest.raises(ValueError):
            parse_request(good | bad, ("m",))


def test_sources_and_sinks(spark, tmp_path):
    p = tmp_path / "s.jsonl"
    p.write_text('{"corpus": "manual", "section_id": "1-1", "page": 3}\n\n{"corpus": "apuntes", "section_id": "f#a"}\n')
    assert TB.read_jsonl(spark, str(p), TB.SECTION).count() == 2
    assert TB.read_jsonl(spark, str(tmp_path / "none"), TB.SECTION, missing_ok=True).count() == 0
    (tmp_path / "v3.txt").write_text("one\n\n two \n")
    assert rows(TB.read_prompt(spark, str(tmp_path / "v3.txt")), "version", "text") == [("v3", "one"), ("v3", "two")]
    df = spark.range(3)
    path = TB.write_collection(df, str(tmp_path / "c"), "manual", 512, "base", "m")
    assert TB.read_collection(spark, path).count() == 3
    (tmp_path / "c/corpus=manual/cap=512/extras=base/model=m/_SUCCESS").unlink()
    with pytest.raises(FileNotFoundError):
        TB.read_collection(spark, path)
    assert TB.write_once(spark, df, str(tmp_path / "r")) == "written"
    assert TB.write_once(spark, df, str(tmp_path / "r")) == "same"
    with pytest.raises(ValueError, match="other rows"):
        TB.write_once(spark, spark.range(4), str(tmp_path / "r"))
    assert TB.splice("a <s> old <e> b", "new", "<s>", "<e>") == "a <s>\nnew\n<e> b"
    with pytest.raises(ValueError):
        TB.splice("a", "new", "<s>", "<e>")
    cell = TB.html_table(spark.createDataFrame([("<b>", None)], "x string, y string"), ["x", "y"]).first().row
    assert cell == "<tr><td>&lt;b&gt;</td><td></td></tr>"


def test_retry_and_batched_models(spark):
    calls = []

    def flaky(x):
        calls.append(x)
        if len(calls) < 3:
            raise OSError("down")
        return x

    assert M.with_retry(flaky, 1, wait_s=0) == 1
    with pytest.raises(OSError):
        M.with_retry(lambda: (_ for _ in ()).throw(OSError("down")), wait_s=0)
    from pyspark.sql import types as T

    model = M.batched(lambda: lambda texts: [len(t) for t in texts], T.LongType(), wait_s=0)
    assert rows(spark.createDataFrame([("ab",), (None,)], "t string").select(model(F.col("t")).alias("n")), "n") == [(0,), (2,)]


def test_stream_equals_batch(spark, tmp_path):
    turns = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet")
    for i in range(2):
        turns.where(F.col("turn") % 4 < 2 if i == 0 else F.col("turn") % 4 >= 2).where("turn < 4").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(turns.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = DI.dialogue_turns(stream).writeStream.format("memory").queryName("turns_out").option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    names = ("conv_id", "turn", "question", "answer", "n_before")
    assert rows(spark.table("turns_out"), *names) == rows(DI.dialogue_turns(turns.where("turn < 4")), *names)


def test_hybrid_reads_only_what_it_needs(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    plan = IX.of_corpus(docs, "en", "lang").select("doc_id")._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(lang), EqualTo(lang,en)]" in plan
    assert "ReadSchema: struct<doc_id:bigint,lang:string>" in plan


def test_dense_search_in_blocks(spark, monkeypatch):
    rng = random.Random(3)
    vectors = [(i, [rng.random() for _ in range(4)]) for i in range(40)]
    rows = spark.createDataFrame(vectors, "id long, vector array<double>")
    queries = spark.createDataFrame(vectors[:10], "query_id long, q array<double>")
    want = sorted(map(tuple, R.dense_top(queries, rows, 3).collect()))
    monkeypatch.setattr(R, "MAX_NUMBERS", 16)
    got = sorted(map(tuple, R.dense_top(queries, rows, 3).collect()))
    assert got == want and len(got) == 30


def test_dense_search_states_the_distance_of_zeros(spark):
    rows = spark.createDataFrame([(1, [0.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 1.0]), (4, [0.0, 0.0])], "id long, vector array<double>")
    queries = spark.createDataFrame([(0, [1.0, 0.0])], "query_id long, q array<double>")

    def found(**more):
        return [(r["id"], str(r["distance"])) for r in R.dense_top(queries, rows, 3, **more).orderBy("rank").collect()]

    assert found() == [(2, "0.0"), (1, "1.0"), (3, "1.0")]
    assert found(undefined=float("nan")) == [(1, "nan"), (4, "nan"), (2, "0.0")]
