import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parent.parent
sys.path[:0] = [p for p in (str(ROOT), str(Path(__file__).parent)) if p not in sys.path]
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    made = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "4g")
        .config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse")))
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .getOrCreate()
    )
    made.sparkContext.setLogLevel("ERROR")
    yield made
    made.stop()


@pytest.fixture(scope="session")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def _plain(v):
    if hasattr(v, "asDict"):
        return _plain(v.asDict())
    if isinstance(v, dict):
        return "{" + ",".join(f"{k}:{_plain(x)}" for k, x in sorted(v.items())) + "}"
    if isinstance(v, list | tuple):
        return "[" + ",".join(map(_plain, v)) + "]"
    return repr(float(v)) if type(v).__name__ == "Decimal" else repr(v)


@pytest.fixture(scope="session")
def compare(spark, duck):
    """Holds a query's rows against its SQL's, in any order."""

    def check(name, queries, sql):
        df = queries[name](spark, SF)
        names = sorted(df.columns)
        got = sorted(tuple(_plain(r[c]) for c in names) for r in df.collect())
        out = duck.execute(sql[name])
        have = [c[0] for c in out.description]
        assert sorted(have) == names
        assert got == sorted(tuple(_plain(r[have.index(c)]) for c in names) for r in out.fetchall())

    return check
