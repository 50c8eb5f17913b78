"""Sources and sinks: JSON lines, text, collections as partitioned Parquet, write-once results, reports."""

from __future__ import annotations

import json
import re
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

SECTION = T.StructType([T.StructField(n, t) for n, t in (("corpus", T.StringType()), ("section_id", T.StringType()), ("title", T.StringType()), ("kind", T.StringType()), ("text", T.StringType()), ("file", T.StringType()), ("chapter", T.IntegerType()), ("page", T.IntegerType()), ("page_end", T.IntegerType()))])
COLLECTION_KEYS = ("corpus", "cap", "extras", "model")


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path of any store that Spark reads is there."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def shared_dir(spark: SparkSession) -> str:
    """A folder that the driver and all executors share: spark.checkpoint.dir, or on one machine a temporary one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return found or tempfile.mkdtemp(prefix="tessera-")


def staged(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read again: what is read more than once, or must outlive an executor, is computed once."""
    path = f"{shared_dir(df.sparkSession)}/staged-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType, missing_ok: bool = False) -> DataFrame:
    """Typed rows of JSON lines; blank lines are skipped, other rows must parse."""
    if missing_ok and not exists(spark, path):
        return spark.createDataFrame([], schema)
    lines = spark.read.text(path).where(F.trim("value") != "")
    return lines.select(F.from_json("value", schema, {"mode": "FAILFAST"}).alias("r")).select("r.*")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, ord, line) of text files."""
    x = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.posexplode(F.split("value", "\n")).alias("ord", "line"))
    return x


def read_prompt(spark: SparkSession, path: str) -> DataFrame:
    """(version, step, text): the file's stem names the version; one row for each line that isn't blank."""
    x = read_lines(spark, path).where(F.trim("line") != "")
    return x.select(F.regexp_extract("file", r"([^/]+?)\.[^./]*$", 1).alias("version"), F.col("ord").alias("step"), F.trim("line").alias("text"))


def read_parsed(spark: SparkSession, path: str, parse, schema: T.StructType) -> DataFrame:
    """Rows (file, ...schema) that parse(bytes) -> list of tuples makes of each file: a table of contents, or laid-out items.

    The parser runs on the executors, a file at a time, and is loaded there.
    """
    out = T.StructType([T.StructField("file", T.StringType()), *schema.fields])
    types = to_arrow_schema(out)

    def run(batches):
        for b in batches:
            for file, content in zip(b.column("path").to_pylist(), b.column("content").to_pylist(), strict=True):
                made = [(file, *row) for row in parse(content)]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in made], f.type) for i, f in enumerate(types)], schema=types)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, out)


def write_collection(rows: DataFrame, root: str, corpus: str, cap: int, extras: str, model: str) -> str:
    """Writes a collection anew; Spark's _SUCCESS file comes last and marks it complete."""
    path = f"{root}/corpus={corpus}/cap={cap}/extras={extras}/model={model}"
    rows.write.mode("overwrite").parquet(path)
    return path


def read_collection(spark: SparkSession, path: str) -> DataFrame:
    """A complete collection; one whose writing was broken off is refused."""
    if not exists(spark, f"{path}/_SUCCESS"):
        raise FileNotFoundError(f"no complete collection at {path}")
    return spark.read.parquet(path)


def by_ids(rows: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    return rows.join(ids.select(key).distinct(), key, "left_semi")


def write_once(spark: SparkSession, rows: DataFrame, path: str) -> str:
    """"written" if new, "same" if it has these rows already, else an error with some of the differences."""
    if not exists(spark, path):
        rows.write.json(path)
        return "written"
    old = spark.read.schema(rows.schema).json(path)
    gone, new = old.exceptAll(rows), rows.exceptAll(old)
    if gone.isEmpty() and new.isEmpty():
        return "same"
    shown = [f"- {json.dumps(r.asDict(True), default=str)}" for r in gone.limit(5).collect()] + [f"+ {json.dumps(r.asDict(True), default=str)}" for r in new.limit(5).collect()]
    raise ValueError(f"{path} has other rows:\n" + "\n".join(shown))


def split_runs(results: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(retrieval, generation): rows without run_id are skipped, those with a model are generation."""
    x = results.where(F.col("run_id").isNotNull())
    return x.where(F.col("model").isNull()), x.where(F.col("model").isNotNull())


def html_table(rows: DataFrame, columns: list[str], width: int = 400) -> DataFrame:
    """(row) of HTML: cells escaped and cut, nulls blank."""
    from ..functions.text import escape_html

    cells = [F.concat(F.lit("<td>"), escape_html(F.left(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit(width))), F.lit("</td>")) for c in columns]
    return rows.select(F.concat(F.lit("<tr>"), *cells, F.lit("</tr>")).alias("row"))


def splice(text: str, block: str, start: str, end: str) -> str:
    """text with what stands between two markers replaced; a missing marker is an error."""
    if start not in text or end not in text:
        raise ValueError(f"no marker {start if start not in text else end}")
    return re.sub(f"(?s){re.escape(start)}.*?{re.escape(end)}", lambda _: f"{start}\n{block}\n{end}", text, count=1)


def union_of_keys(collections: list[DataFrame]) -> DataFrame:
    """Rows of several collections over all their columns; what one lacks is null."""
    out = collections[0]
    for c in collections[1:]:
        out = out.unionByName(c, allowMissingColumns=True)
    return out


def summary_page(rows: DataFrame, title: str, max_rows: int = 10_000) -> str:
    """One HTML file with the rows of runs as JSON, which its script sorts by a click and filters by value; maxima are bold.

    Rows are runs, not data: more than max_rows are refused.
    """
    found = [r.asDict(True) for r in rows.limit(max_rows + 1).collect()]
    if len(found) > max_rows:
        raise ValueError(f"more than {max_rows} runs")
    data = json.dumps(found, ensure_ascii=False, default=str).replace("<", "\\u003c")
    return f"""<!doctype html><meta charset="utf-8"><title>{title}</title>
<div id="filters"></div><table><thead></thead><tbody></tbody></table>
<script>
const rows = {data}, keys = [...new Set(rows.flatMap(Object.keys))], chosen = {{}};
let by = null, down = true;
const best = k => Math.max(...rows.map(r => r[k]).filter(x => typeof x === "number"));
function show() {{
  let out = rows.filter(r => Object.entries(chosen).every(([k, v]) => v === "" || String(r[k]) === v));
  if (by) out = [...out].sort((a, b) => (a[by] > b[by] ? 1 : a[by] < b[by] ? -1 : 0) * (down ? -1 : 1));
  document.querySelector("tbody").replaceChildren(...out.map(r => {{
    const tr = document.createElement("tr");
    for (const k of keys) {{ const td = tr.insertCell(); td.textContent = r[k] ?? ""; if (typeof r[k] === "number" && r[k] === best(k)) td.style.fontWeight = "bold"; }}
    return tr;
  }}));
}}
const head = document.createElement("tr");
for (const k of keys) {{
  const th = document.createElement("th"); th.textContent = k; th.onclick = () => {{ down = by === k ? !down : true; by = k; show(); }}; head.append(th);
  if (rows.every(r => typeof r[k] !== "number" || Number.isInteger(r[k]))) {{
    const pick = document.createElement("select"); pick.append(new Option(k, ""), ...[...new Set(rows.map(r => String(r[k])))].sort().map(v => new Option(v)));
    pick.onchange = () => {{ chosen[k] = pick.value; show(); }}; document.getElementById("filters").append(pick);
  }}
}}
document.querySelector("thead").append(head);
show();
</script>"""
