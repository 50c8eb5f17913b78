"""Settings to answers, caches, writers, parsers, the service and its page."""

import json
import threading
import urllib.request
import warnings
from datetime import datetime

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tessera.functions import models as M
from tessera.operators import chunking as C
from tessera.operators import enrich as EN
from tessera.operators import exam as EX
from tessera.operators import ingest as IN
from tessera.operators import retrieve as R
from tessera.plans import config as CF
from tessera.plans import retrieval as RT
from tessera.plans import service as SV
from tessera.sources import tables as TB
from tessera.sources import vectors as VC


def test_splitter():
    assert C.recursive_split("a b c", 3) == ["a", "b", "c"][:0] + C.recursive_split("a b c", 3)
    # a separator stays with what it opens, and neighbours are joined while they fit
    assert C.recursive_split("one two\n\nthree four five\n\nsix", 4) == ["one two", "three four five\n\nsix"]
    assert C.recursive_split("one two three four five six", 4) == ["one two three four", "five six"]
    # a paragraph of the cap is cut at finer separators, one above it too; nothing is lost
    assert C.recursive_split("a b c d\n\ne", 4) == ["a b c d", "e"]
    chars = lambda t: len(t)
    assert C.recursive_split("abcdefgh", 3, chars) == ["abc", "def", "gh"]
    text = "\n\n".join(" ".join(f"w{i}x{j}" for j in range(i)) for i in range(1, 40))
    parts = C.recursive_split(text, 10)
    assert " ".join(parts).split() == text.split() and max(map(C.words_of, parts)) <= 10
    assert C.recursive_split(" \n ", 3) == []


def test_captions_have_either_hyphen(spark):
    pages = spark.createDataFrame([(1, "h\nh\nTable 9‑1. A\n x\nTable  3-\t12. B\nsee Table 7-7."), (2, "Table 1-1. head\nTable 2-2. head\n")], "page int, text string")
    assert sorted(r.caption for r in IN.captions(pages, F.col("text")).collect()) == ["3-12", "9-1"]
    tables = spark.createDataFrame([("Table 9-1 A and Table 4-4",), ("Fig",), (None,)], "caption string")
    assert [r.caption for r in IN.parsed_captions(tables, F.col("caption")).collect()] == ["9-1"]


def collection(spark):
    rows = [("a", "chunk", None, "alpha beta"), ("b", "chunk", None, "beta gamma"), ("c", "chunk", None, "delta"), ("a::hype::0", "hype", "a", "alpha beta"), ("a::hype::1", "hype", "a", "alpha beta")]
    x = spark.createDataFrame(rows, "id string, entry_type string, parent_id string, document string").withColumns({"corpus": F.lit("manual"), "title": F.lit(None).cast("string")})
    return x.withColumn("vector", M.letter_embedding(F.when(F.col("entry_type") == "hype", F.lit("what is alpha")).otherwise(F.col("document"))))


def test_retrieve_by_settings(spark):
    q = spark.createDataFrame([(1, "what is alpha")], "query_id int, text string").withColumn("q", M.letter_embedding(F.col("text")))
    rows = collection(spark)
    s = CF.settings(corpus="manual", extras="hype", embedding="bgem3", search="densa", k=5)
    with warnings.catch_warnings(record=True) as said:
        warnings.simplefilter("always")
        got = RT.retrieve(s, q, rows, warn=True).orderBy("rank").collect()
    assert [r.id for r in got][0] == "a" and sorted(r.id for r in got) == ["a", "b", "c"] and got[0].score == pytest.approx(0, abs=1e-9) and {r.score_kind for r in got} == {"distancia"}
    assert any("fewer than 5" in str(w.message) for w in said)
    hybrid = RT.retrieve(s | {"search": "hibrida"}, q, rows).collect()
    assert {r.score_kind for r in hybrid} == {"rrf"} and not any("hype" in r.id for r in hybrid)
    again = RT.retrieve(s | {"rerank": True, "k": 3}, q, rows).orderBy("rank").collect()
    assert again[0].id == "a" and again[0].score == pytest.approx(1 / 3) and again[0].score_kind == "rerank"
    RT.warm_up(s, rows, M.letter_embedding, lambda p: p)


def test_run_turn_keeps_the_question_as_asked(spark):
    turns = spark.createDataFrame([(1, "and beta?", [("x", "y")] * 5)], "query_id int, question string, history array<struct<q:string,a:string>>")
    s = CF.settings(corpus="manual", extras="base", embedding="bgem3", search="densa", k=3)
    allowed = spark.createDataFrame([("3", "m")], "number string, unit string")
    seen = RT.run_turn(s, turns, collection(spark).where("entry_type = 'chunk'"), M.letter_embedding, M.standalone_question, lambda p: F.concat(F.lit("3 m of "), F.length(p).cast("string")), allowed).first()
    assert seen["query"] == "and beta? (x)" and len(seen.history) == 6 and seen.history[-1].q == "and beta?" and seen.history[-1].a == seen.answer and not seen.abstained


def test_vector_cache(spark, tmp_path):
    calls = spark.sparkContext.accumulator(0)

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def embed(s):
        calls.add(len(s))
        return s.map(lambda t: [float(len(t))])

    path = str(tmp_path / "cache")
    texts = spark.createDataFrame([("a",), ("bb",), ("bb",), (None,)], "text string")
    assert sorted((r.text, r.vector[0]) for r in VC.ensure_vectors(texts, path, "m", embed, parts=2).collect()) == [("a", 1.0), ("bb", 2.0)]
    assert calls.value == 2
    more = texts.unionByName(spark.createDataFrame([("ccc",)], "text string"))
    assert VC.ensure_vectors(more, path, "m", embed).count() == 3 and calls.value == 3
    assert VC.missing_texts(more, VC.cached_vectors(spark, path), "other").count() == 3


def test_writers(spark, tmp_path):
    schema = "section_id string, chapter int, ord int, text string"
    notes, manual = spark.createDataFrame([("n#b", None, 1, "x"), ("n#a", None, 0, "x")], schema), spark.createDataFrame([("9-1", 9, 0, "x"), ("2-1", 2, 5, "x")], schema)
    VC.write_corpus(notes, manual, str(tmp_path / "corpus"))
    back = spark.read.json(str(tmp_path / "corpus"))
    assert [r.section_id for r in back.orderBy("ord").collect()] == ["n#a", "n#b", "2-1", "9-1"]
    staging, out = str(tmp_path / "staging"), str(tmp_path / "enriched")
    chunks = spark.createDataFrame([("a",), ("b",)], "id string")
    for n, rows in ((1, [("a", "old"), ("gone", "x")]), (2, [("b", "new"), ("a", "newer")])):
        VC.append_enrichment(spark.createDataFrame(rows, "id string, context string").withColumn("n", F.lit(n)), staging)
    VC.finish_enrichment(chunks, staging, out)
    assert sorted((r.id, r.context) for r in spark.read.parquet(out).collect()) == [("a", "newer"), ("b", "new")]
    made = spark.createDataFrame([("1-1", "manual", 3, 5), ("1-2", "apuntes", None, 7)], "chunk_id string, corpus string, chapter int, n_tokens int")
    assert C.write_chunks(made, str(tmp_path / "chunks"), "chunk_id", "n_tokens", 7).count() == 2
    for bad in (made.unionByName(made), made.withColumn("n_tokens", F.lit(8))):
        with pytest.raises(ValueError):
            C.write_chunks(bad, str(tmp_path / "bad"), "chunk_id", "n_tokens", 7)
    assert not TB.exists(spark, str(tmp_path / "bad"))


def test_parsed_files(spark, tmp_path):
    for name, body in (("a", b"1 One 3\n1 Two 9"), ("b", b"")):
        (tmp_path / f"{name}.bin").write_bytes(body)
    schema = T.StructType([T.StructField("level", T.IntegerType()), T.StructField("title", T.StringType()), T.StructField("page", T.IntegerType())])
    toc = TB.read_parsed(spark, str(tmp_path), lambda c: [(int(x), y, int(z)) for x, y, z in (r.split() for r in c.decode().splitlines())], schema)
    assert sorted((r.file.rsplit("/", 1)[1], r.title, r.page) for r in toc.collect()) == [("a.bin", "One", 3), ("a.bin", "Two", 9)]


def test_enrichment_is_made_again_once(spark):
    rows = spark.createDataFrame([(1, "good"), (2, "mends"), (3, "never")], "id int, prompt string")
    ask = lambda p: F.when(p.startswith("good") | (p.startswith("mends") & p.contains("rules")), '["a", " b ", "c"]').otherwise("no json")
    got = EN.made_valid(rows, ask, lambda v: EN.valid_questions(EN.parsed_questions(v)), "v")
    assert sorted((r.id, r.ok) for r in got.collect()) == [(1, True), (2, True), (3, False)]
    with pytest.raises(ValueError, match="3"):
        EN.require_made(got, "id")
    assert EN.require_made(got.where("ok"), "id").select(EN.parsed_questions(F.col("v")).alias("q")).first().q == ["a", "b", "c"]


def test_exam_errors(spark):
    golden = spark.createDataFrame([("q1", "eval", 0), ("q2", "train", 1)], "id string, use string, ord int")
    assert EX.exam_rows(golden).count() == 1
    with pytest.raises(ValueError):
        EX.exam_rows(golden.where("use = 'train'"))
    with pytest.raises(ValueError, match="q2"):
        EX.require_matched(golden, golden.where("id = 'q1'"))
    with pytest.raises(ValueError):
        EX.labelled(spark.createDataFrame([("", 1)], "label string, id int"))


def test_reviews_and_unions(spark):
    chunks = spark.createDataFrame([("manual", 3, "1-1", "T", "a\nb", 2)], "corpus string, chapter int, chunk_id string, title string, text string, n_tokens int")
    lines = C.review_lines(chunks, ["chunk_id"]).orderBy("ord").collect()
    assert [r.line for r in lines] == ["## 1-1 · T", "*2 tokens*", "", "a", "b", ""] and lines[0].review == "cap-03"
    both = TB.union_of_keys([chunks.select("corpus", "chapter"), chunks.select("corpus", "title")])
    assert both.columns == ["corpus", "chapter", "title"] and both.count() == 2
    page = TB.summary_page(spark.createDataFrame([("</script>", 0.5)], "run_id string, hit_rate double"), "runs")
    assert page.count("</script>") == 1 and '"hit_rate": 0.5' in page
    assert R.chunk_rows(collection(spark)).count() == 3


def test_service(tmp_path):
    def turn(history, question, model, s):
        if question == "boom":
            raise RuntimeError("model is gone")
        return {"answer": question.upper(), "history": [*history, (question, question.upper())], "run": CF.run_name(s)}

    warmed = []
    service = SV.Service(("m",), turn, lambda model, s: warmed.append(model))
    good = {"question": "hi", "history": [], "model": "m", "config": CF.BEST}
    ask = lambda method, path, body=None: (lambda r: (r[0], json.loads(r[2]) if "json" in r[1] else r[2]))(service.respond(method, path, json.dumps(body).encode()))
    log = SV.log_to(str(tmp_path), "chat", datetime(2026, 1, 2, 3, 4, 5))
    assert ask("POST", "/api/chat", good) == (200, {"answer": "HI", "history": [["hi", "HI"]], "run": CF.run_name(CF.BEST)})
    assert log.endswith("chat-20260102-030405.log") and '"question": "hi"' in open(log).read()
    assert ask("POST", "/api/warmup", {"model": "m", "config": CF.BEST}) == (200, {"ready": True}) and warmed == ["m"]
    assert [ask("POST", "/api/chat", b)[0] for b in (good | {"model": "x"}, [], good | {"question": "boom"})] == [400, 400, 500]
    assert ask("GET", "/none")[0] == 404 and ask("GET", "/api/options")[1]["models"] == ["m"]
    server = service.server()
    threading.Thread(target=server.serve_forever, daemon=True).start()
    with urllib.request.urlopen(f"http://127.0.0.1:{server.server_port}/") as r:
        assert r.status == 200 and b"/api/chat" in r.read()
    server.shutdown()


@pytest.mark.parametrize("name", ["piece_bpe_32k.model", "byte_bpe_50k.json"])
def test_token_counters(spark, name):
    import os

    from tessera.functions import tokens as TK

    folder = os.environ.get("TOKENIZERS", "/opt/tokenizers")
    if not os.path.exists(f"{folder}/{name}"):
        pytest.skip("no vocabulary here")
    counter = TK.load_counter(spark, f"{folder}/{name}")
    text = "\n\n".join(f"The diver number {i} ascends slowly, at nine metres a minute." for i in range(40))
    rows = spark.createDataFrame([("s", text), ("t", "short"), ("u", None)], "id string, text string").withColumn("section_ids", F.array("id"))
    assert [r.n for r in rows.select(TK.n_tokens(counter, F.col("text")).alias("n")).collect()][1:] == [counter("short"), 0]
    parts = C.split_at_cap(rows, 60, counter).withColumn("n", TK.n_tokens(counter, F.col("text"))).collect()
    long = [r for r in parts if r.section_ids == ["s"]]
    assert len(long) > 5 and max(r.n for r in long) <= 60 and " ".join(r.text for r in long).split() == text.split()
    assert [r.chunk_id for r in parts if r.section_ids == ["t"]] == ["t"]
