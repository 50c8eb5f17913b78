"""Every query of the engine against DuckDB on the smallest tables."""

import pytest
from conftest import SF
from tessera.plans.queries import QUERIES, SQL


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(compare, name):
    compare(name, QUERIES, SQL)


def test_split_cap_keeps_the_cap_and_the_words(spark):
    rows = QUERIES["split_cap"](spark, SF)
    assert rows.where("n_tokens > 120").count() == 0
    from pyspark.sql import functions as F
    from tessera.functions import text as X

    before = spark.read.parquet(f"{SF}/documents.parquet").agg(F.sum(X.n_words(F.col("text")))).first()[0]
    assert rows.agg(F.sum("n_tokens")).first()[0] == before


def test_entry_and_registry(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).limit(1).count() == 1


@pytest.mark.parametrize("name", ["retrieve_dense", "retrieve_dense_rerank", "one_turn", "rerank_topk", "hybrid_topk", "retrieve_hybrid", "retrieve_hybrid_rerank"])
def test_documents_without_letters_match_sql(spark, tmp_path, name):
    """Their vectors are of zeros, which have no cosine."""
    import duckdb
    from conftest import _plain
    from pyspark.sql import functions as F

    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(60)
    bare = docs.where("doc_id < 3").withColumns({"doc_id": F.col("doc_id") + 1000, "text": F.concat(F.lit("12 34 § "), "doc_id")})
    docs.unionByName(bare).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{SF}/benchmark.parquet").where("item_id < 12").write.parquet(f"{tmp_path}/benchmark.parquet")
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    df, out = QUERIES[name](spark, str(tmp_path)), con.execute(SQL[name])
    have = [c[0] for c in out.description]
    want = sorted(tuple(_plain(r[have.index(c)]) for c in df.columns) for r in out.fetchall())
    assert sorted(tuple(map(_plain, r)) for r in df.collect()) == want
