"""Quality classifier: document evidence, shrunk towards what is known of its path, its host and the whole corpus."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import symbols as S
from .common import Tables, row_key
from .counters import frugal, give_back, pieces

#: Labelled rows that the document classifier is fitted on, at most: those with the least hash of their doc_id.
MAX_LABELLED = 10_000
#: Words are hashed to so many features.
BUCKETS = 1 << 10
#: Labelled rows whose features the driver holds unpacked at a time; all of them count in each step.
BLOCK = 500
FEATURES = ("log_words", "word_length", "symbols", "upper", "digits", "bangs", "bars", "distinct", "repeats", "lines")
_CLASSES = ("#*$%&<>@=~^", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", "!?", "|", "\n")
#: The number of the class of each byte, from 1; 0 for none, 7 for the later bytes of a character.
_CLASS = np.array([7 if 0x80 <= b < 0xC0 else next((i for i, c in enumerate(_CLASSES, 1) if chr(b) in c), 0) for b in range(256)], np.uint8)


def evidence(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(FEATURES of each whole text, text * BUCKETS + bucket for each bucket that a text has words of); null is empty.  Words are told apart by 44 bits."""
    data, lengths = S.flat(texts)
    kinds = _CLASS[data]
    at = np.flatnonzero(kinds)
    text = np.searchsorted(np.cumsum(lengths), at, side="right")
    _, symbols, upper, digits, bangs, bars, lines, later = np.bincount(text * 8 + kinds[at], minlength=8 * len(texts)).reshape(-1, 8).T
    n_chars = np.maximum(lengths - later, 1)
    hashes, start, end, counts = S.words(S.lower_ascii(data), lengths)
    of, n = np.repeat(np.arange(len(texts)), counts), np.maximum(counts, 1)
    key = of.astype(np.uint64) << np.uint64(44) | hashes >> np.uint64(20)
    same = of[1:][key[1:] == key[:-1]]
    distinct = np.unique(key) >> np.uint64(44)
    x = np.column_stack([
        np.log1p(counts),
        (np.bincount(of, end - start, len(texts)) - later) / n,
        (symbols + bars) / n_chars,
        upper / n_chars,
        digits / n_chars,
        bangs / n_chars,
        bars / n_chars,
        np.bincount(distinct.astype(np.int64), minlength=len(texts)) / np.sqrt(n * np.log1p(n)),
        np.bincount(same, minlength=len(texts)) / n,
        np.log1p(lines),
    ])
    return x, np.unique(of * BUCKETS + (hashes >> np.uint64(54)).astype(np.int64))


def _numbers(x: np.ndarray, centre: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """The features and their squares."""
    z = np.clip((x - centre) / scale, -6, 6)
    return np.hstack([z, z * z])


def _score(x: np.ndarray, pairs: np.ndarray, centre: np.ndarray, scale: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Log-odds of texts with this evidence; the buckets of a text are a vector of length 1."""
    k = 2 * x.shape[1]
    text = pairs // BUCKETS
    words = np.bincount(text, w[k:-1][pairs % BUCKETS], len(x)) / np.sqrt(np.maximum(np.bincount(text, minlength=len(x)), 1))
    return _numbers(x, centre, scale) @ w[:k] + words + w[-1]


def fit_documents(labelled: DataFrame, ridge: float = 3e-3) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(centre, scale, weights with the intercept last) of a logistic regression on rows (doc_id, text, quality), by Newton steps.

    The rows are those of a bounded sample; of each, 80 bytes and BUCKETS bits
    reach the driver.  Of rows with one doc_id the one with the least features counts.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in pieces(b):
                x, pairs = evidence(part.column("text").to_pylist())
                has = np.zeros((len(x), BUCKETS), bool)
                has.ravel()[pairs] = True
                made = [pa.array(list(x), pa.list_(pa.float64())), pa.array([np.packbits(h).tobytes() for h in has], pa.binary())]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *made, part.column("quality")], names=["doc_id", "x", "has", "quality"])

    rows = labelled.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col("quality").cast("int").alias("quality"))
    rows = rows.mapInArrow(frugal(run), "doc_id long, x array<double>, has binary, quality int")
    sample = sorted(rows.groupBy("doc_id").agg(F.min(F.struct("x", "has", "quality")).alias("r")).select("doc_id", "r.*").collect())
    raw = np.array([r["x"] for r in sample], float).reshape(-1, len(FEATURES))
    bits = np.frombuffer(b"".join(r["has"] for r in sample), np.uint8).reshape(-1, BUCKETS // 8)
    y = np.array([r["quality"] for r in sample], float)
    del sample
    size = 2 * len(FEATURES) + BUCKETS + 1
    if not len(y) or y.min() == y.max():
        p = (y.sum() + 1) / (len(y) + 2)
        return np.zeros(len(FEATURES)), np.ones(len(FEATURES)), np.append(np.zeros(size - 1), np.log(p / (1 - p)))
    centre, scale = raw.mean(0), raw.std(0) + 1e-9

    def block(at: slice) -> np.ndarray:
        has = np.unpackbits(bits[at], axis=1)
        word = has / np.sqrt(np.maximum(has.sum(1, keepdims=True, dtype=np.int64), 1))
        return np.hstack([_numbers(raw[at], centre, scale), word, np.ones((len(has), 1))]).astype(np.float32)

    w = np.zeros(size)
    for _ in range(15):
        # all rows at once would be some 200 MB of the driver's memory
        hessian, slope = len(y) * ridge * np.eye(size), len(y) * ridge * w
        for k in range(0, len(y), BLOCK):
            x = block(at := slice(k, k + BLOCK))
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            hessian += (x * (p * (1 - p)).astype(np.float32)[:, None]).T @ x
            slope += x.T @ (p - y[at])
        step = np.linalg.solve(hessian, slope)
        w -= step
        if np.abs(step).max() < 1e-2:
            break
    give_back()
    return centre, scale, w


def _logits(rows: DataFrame, model: tuple[np.ndarray, np.ndarray, np.ndarray]) -> DataFrame:
    """Adds _logit, the classifier's log-odds, to rows (text, ...)."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centre, scale, w = shared.value
        for b in batches:
            for part in pieces(b):
                logit = _score(*evidence(part.column("text").to_pylist()), centre, scale, w)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(np.clip(logit, -12, 12))], names=[*part.schema.names, "_logit"])

    return rows.mapInArrow(frugal(run), T.StructType([*rows.schema.fields, T.StructField("_logit", T.DoubleType())]))


def _strength(groups: DataFrame, parent: Column) -> float:
    """Pseudo-documents of the parent's mean that a group starts with: beta-binomial moments over groups (n, mean)."""
    row = groups.where("n > 1").select(
        F.sum("n").alias("n"),
        F.sum(F.col("n") * F.pow(F.col("mean") - parent, 2)).alias("between"),
        F.sum(parent * (1 - parent)).alias("within"),
        F.sum(F.col("n") * parent * (1 - parent)).alias("weighted"),
    ).first()
    if not row["n"] or not row["weighted"]:
        return 100.0
    # E[sum n (mean - parent) ** 2] = within + (weighted - within) * rho, where the strength is 1 / rho - 1
    rho = (row["between"] - row["within"]) / max(row["weighted"] - row["within"], 1e-9)
    return float(np.clip(1 / max(rho, 1e-4) - 1, 1.0, 10_000.0))


def score_documents(docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang", threshold: float = 0.5, with_text: bool = True, max_labelled: int = MAX_LABELLED) -> DataFrame:
    """Adds doc_score, path_score, score (0 to 1) and accepted (score >= threshold) to docs (doc_id, text, host, path, ...).

    doc_score: the document classifier's probability, from counts of the whole
    text and its hashed words.  The mean of it over the other documents of a
    host is shrunk to that of the corpus, and that of a path (a host's part) to
    its host's: posterior means of beta priors whose strengths come from how
    much groups differ.  A document's own score is left out of both, as it
    counts by itself: score adds to the document's log-odds those of its path
    over the corpus.  At most max_labelled labelled rows are used to fit; scores
    and posteriors cover all documents.

    Null or empty text has the features of no words; a text of any length is
    read whole.  Null host or path: a group of its own.  Labels without a
    document, with nulls, or repeated (the least quality counts) do no harm;
    without labels of both kinds all documents have one doc_score.  Repeated
    rows are scored alike.  Empty docs: empty output.  All columns stay but
    those named like an added one (and the text, if not with_text).
    """
    made = ("doc_score", "path_score", "score", "accepted", "_logit", "_h", "_p")
    docs = docs.select(*[c for c in docs.columns if c not in made])
    keep = docs.columns if with_text else [c for c in docs.columns if c != "text"]
    marked = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    # chosen before any text moves; max_labelled rows of 12 bytes
    chosen = F.broadcast(marked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled))
    model = fit_documents(docs.select("doc_id", "text").join(chosen, "doc_id"))

    def scored(rows: DataFrame) -> DataFrame:
        x = _logits(rows, model).withColumn("doc_score", 1 / (1 + F.exp(-F.col("_logit"))))
        return x.withColumns({"_h": row_key(F.col(host)), "_p": row_key(F.col(host), F.col(path))})

    with Tables(docs.sparkSession) as tables:
        if with_text:  # the texts are read twice rather than written
            rows = scored(docs)
        else:
            rows = Tables(docs.sparkSession).write(scored(docs).drop("text"), keep=True)
        paths = tables.write(rows.groupBy("_h", "_p").agg(F.count("*").alias("n"), F.sum("doc_score").alias("s")))
        groups, mean, a, b = posteriors(paths)
        groups = Tables(docs.sparkSession).write(groups, keep=True)
    # a row of 48 bytes a path: counted, and joined by shuffle where there are very many
    x = rows.join(F.broadcast(groups) if groups.count() <= 100_000 else groups, "_p", "left")
    x = x.withColumn("path_score", left_out(F.col("doc_score"), mean, a, b))
    prior = F.log(F.col("path_score") / (1 - F.col("path_score"))) - float(np.log(mean / (1 - mean)))
    x = x.withColumn("score", 1 / (1 + F.exp(-(F.col("_logit") + prior))))
    return x.withColumn("accepted", F.col("score") >= threshold).select(*keep, "doc_score", "path_score", "score", "accepted")


def posteriors(paths: DataFrame) -> tuple[DataFrame, float, float, float]:
    """From rows (_h, _p, n, s), the number and sum of scores of each path: rows (_p, _n, _s, _hn, _hs) with those of its host, the corpus mean, and the strengths of hosts and paths."""
    hosts = paths.groupBy("_h").agg(F.sum("n").alias("_hn"), F.sum("s").alias("_hs"))
    row = hosts.select(F.sum("_hn").alias("n"), F.sum("_hs").alias("s")).first()
    mean = float(np.clip((row["s"] or 0.0) / max(row["n"] or 0, 1), 1e-3, 1 - 1e-3))
    a = _strength(hosts.select(F.col("_hn").alias("n"), (F.col("_hs") / F.col("_hn")).alias("mean")), F.lit(mean))
    x = paths.join(hosts, "_h")
    host = (F.col("_hs") + a * mean) / (F.col("_hn") + a)
    b = _strength(x.select("n", (F.col("s") / F.col("n")).alias("mean"), host.alias("host_score")), F.col("host_score"))
    return x.select("_p", F.col("n").alias("_n"), F.col("s").alias("_s"), "_hn", "_hs"), mean, a, b


def left_out(own: Column, mean: float, a: float, b: float) -> Column:
    """The posterior mean of a row's path without the row's own score: (path + b * host) with host = (host + a * corpus)."""
    host = (F.col("_hs") - own + a * mean) / (F.col("_hn") - 1 + a)
    shrunk = (F.col("_s") - own + b * host) / (F.col("_n") - 1 + b)
    return F.greatest(F.least(shrunk, F.lit(1 - 1e-3)), F.lit(1e-3))


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows (doc_id, doc_score, path_score, score, accepted)."""
    slim = docs.select("doc_id", "text", "source", "lang")
    return score_documents(slim, labels, with_text=False).select("doc_id", "doc_score", "path_score", "score", "accepted")
