"""Toxicity: a linear classifier by non-negative positive-unlabelled learning, in numpy.

Confirmed toxic documents are the positives; other training text counts as
unlabelled, whatever its label says.  The risk of unlabelled text as negative,
less the class prior's share that positives have in it, may not fall below
zero; where its estimate does, the step goes the other way.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import symbols as S
from .counters import counted, frugal, pieces

#: Labelled rows that the classifier is fitted on, at most, of either kind: those with the least hash of their doc_id.
MAX_POSITIVE, MAX_UNLABELLED = 6_000, 14_000
#: Words and their beginnings are hashed to so many features.
SPACE_BITS = 18
#: Standard errors by which a feature must be more frequent in positives than in all text to get a weight.
LEAST_GAIN = 2.5
STEMS = (4, 5, 6, 7, 8)
#: Other than ASCII letters, digits and what lies beyond ASCII becomes a blank; A-Z a-z.
_PLAIN = np.array([b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)], np.uint8)


def features(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(text number, feature), sorted and each once: the hashed words of each whole text, and their beginnings of STEMS bytes, which inflected words share."""
    data, lengths = S.flat(texts)
    data = _PLAIN[data]
    hashes, start, end, counts = S.words(data, lengths)
    text = np.repeat(np.arange(len(texts)), counts).astype(np.uint64) << np.uint64(SPACE_BITS)
    keys, shift = [text | hashes >> np.uint64(64 - SPACE_BITS)], np.uint64(64 - SPACE_BITS)
    symbols = S.byte_symbols(data)
    for k in STEMS:
        long = end - start > k
        keys.append(text[long] | S.mix(S.spans_hash(symbols, start[long], start[long] + k) + np.uint64(k)) >> shift)
    key = np.unique(np.concatenate(keys))
    return (key >> np.uint64(SPACE_BITS)).astype(np.int64), (key & np.uint64((1 << SPACE_BITS) - 1)).astype(np.int64)


def held_out(docs: DataFrame):
    """Column: crc32(doc_id as text) mod 3 is 1; false for a null doc_id."""
    return F.coalesce(F.crc32(docs["doc_id"].cast("string").cast("binary")) % 3 == 1, F.lit(False))


def training_row(doc_id: object) -> bool:
    return zlib.crc32(str(doc_id).encode()) % 3 != 1


class Rows:
    """Sets of known features of several texts, as (row, column) pairs."""

    def __init__(self, sets: list[np.ndarray], width: int):
        self.n, self.width = len(sets), width
        self.row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        self.column = np.concatenate([*sets, np.zeros(0, np.int64)]).astype(np.int64)

    def logits(self, w: np.ndarray, b: float) -> np.ndarray:
        return np.bincount(self.row, w[self.column], self.n) + b

    def pulled(self, g: np.ndarray) -> np.ndarray:
        """The gradient of weights and intercept if that of the logits is g."""
        return np.append(np.bincount(self.column, g[self.row], self.width), g.sum())


def risks(s_p: np.ndarray, s_u: np.ndarray, prior: float) -> tuple[float, float]:
    """(positive, negative) parts of the risk of scores of positives and of unlabelled text, under log loss.

    The negative part is unlabelled text as negative, less the positives in it;
    the risk is positive + max(0, negative).
    """
    top = 1 - 1e-6
    as_negative = -np.log1p(-np.minimum(s_u, top)).mean() + prior * np.log1p(-np.minimum(s_p, top)).mean()
    return float(-prior * np.log(np.maximum(s_p, 1e-6)).mean()), float(as_negative)


def fit(positive: Rows, unlabelled: Rows, prior: float, steps: int = 100) -> tuple[np.ndarray, float]:
    """(weights, intercept) of least non-negative risk, by Adam's steps."""
    w, b = np.zeros(positive.width), float(np.log(prior / (1 - prior)))
    m, v = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    for t in range(1, steps + 1):
        s_p, s_u = (1 / (1 + np.exp(-np.clip(x.logits(w, b), -30, 30))) for x in (positive, unlabelled))
        d_pos = positive.pulled(prior * (s_p - 1) / positive.n)
        d_neg = unlabelled.pulled(s_u / unlabelled.n) - positive.pulled(prior * s_p / positive.n)
        grad = d_pos + d_neg if risks(s_p, s_u, prior)[1] >= 0 else -d_neg
        grad[:-1] += 1e-4 * w
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        step = 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, b = w - step[:-1], b - float(step[-1])
    return w, b


def _known(positive: np.ndarray, n_positive: int, everything: np.ndarray, n_all: int) -> np.ndarray:
    """The features that three positives or more have, and far more of them than of all text."""
    p, u = (positive + 0.5) / (n_positive + 1), (everything + 0.5) / (n_all + 1)
    gain = (p - u) / np.sqrt(np.maximum(u, p / 20) / max(n_positive, 1))
    return np.flatnonzero((positive >= 3) & (gain >= LEAST_GAIN) & (p >= 2 * u))


def _places(part: pa.RecordBatch) -> np.ndarray:
    """Two counters for each feature: of all texts, and of those that are positive; the last two count the texts."""
    text, feature = features(part.column("text").to_pylist())
    marked = part.column("positive").to_numpy(zero_copy_only=False)
    size = 1 << SPACE_BITS
    return np.concatenate([feature, feature[marked[text]] + size, np.full(len(marked), 2 * size), np.full(int(marked.sum()), 2 * size + 1)])


def _sets(sample: DataFrame, known: np.ndarray) -> list[tuple[bool, np.ndarray]]:
    """(positive, known features) of each doc_id of the sample (doc_id, text, positive); of rows with one doc_id, the least set."""
    number = np.full(1 << SPACE_BITS, -1)
    number[known] = np.arange(len(known))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in pieces(b):
                text, feature = features(part.column("text").to_pylist())
                column = number[feature]
                text, column = text[column >= 0], column[column >= 0].astype("<u4")
                sets = np.split(column, np.searchsorted(text, np.arange(1, part.num_rows)))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("positive"), pa.array([s.tobytes() for s in sets], pa.binary())], names=["doc_id", "positive", "s"])

    rows = sample.select("doc_id", "text", "positive").mapInArrow(frugal(run), T.StructType([sample.schema["doc_id"], sample.schema["positive"], T.StructField("s", T.BinaryType())]))
    found = rows.groupBy("doc_id").agg(F.max("positive").alias("positive"), F.min("s").alias("s")).collect()
    return [(r["positive"], np.frombuffer(r["s"], "<u4")) for r in sorted(found)]


def train(docs: DataFrame, labels: DataFrame, max_positive: int = MAX_POSITIVE, max_unlabelled: int = MAX_UNLABELLED) -> tuple[np.ndarray, np.ndarray, float]:
    """(known features, their weights, intercept), fitted on rows that are not held out.

    Positives are labelled rows that are toxic; unlabelled are labelled rows
    whose labels are not looked at: at most max_positive and max_unlabelled of
    them, by hash of doc_id, chosen before any text moves.  Which features get a
    weight comes from counts over all of docs that are not held out.  The class
    prior, toxic labels by labels, corrects the risk; the score is then the
    probability under even odds, as a text's site may be of any kind.

    Null doc_id or null label: not used to fit.  Null text: empty.  A doc_id
    labelled more than once is toxic if one of its labels is.  Labels without a
    document and repeated rows do no harm; texts of any length are read whole.
    No positives, no labels or no docs: no features, one low score for all.
    """
    marked = labels.where("doc_id is not null and toxic is not null").where(~held_out(labels)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    counts = marked.select(F.count("*").alias("n"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("k")).first()
    prior = (counts["k"] + 1) / (counts["n"] + 2) if counts["n"] else 0.05
    prior = float(np.clip(prior, 1e-3, 0.5))
    order = (F.xxhash64("doc_id"), F.col("doc_id"))
    toxic = marked.where("toxic = 1").orderBy(*order).limit(max_positive).select("doc_id", F.lit(True).alias("positive"))
    chosen = toxic.unionByName(marked.orderBy(*order).limit(max_unlabelled).select("doc_id", F.lit(False).alias("positive")))
    texts = docs.select("doc_id", "text").where("doc_id is not null").where(~held_out(docs))
    # both sides of max_positive + max_unlabelled rows of 9 bytes at most
    size = 1 << SPACE_BITS
    total = counted(texts.join(F.broadcast(toxic), "doc_id", "left").select("text", F.coalesce("positive", F.lit(False)).alias("positive")), 2 * size + 2, _places)
    known = _known(total[size : 2 * size], int(total[-1]), total[:size], int(total[-2]))
    sets = _sets(texts.join(F.broadcast(chosen.groupBy("doc_id").agg(F.max("positive").alias("positive"))), "doc_id"), known)
    first = {True: [s for p, s in sets if p], False: [s for _, s in sets]}
    if not len(known) or not first[True]:
        return np.zeros(0, np.int64), np.zeros(0), -4.0
    w, b = fit(Rows(first[True], len(known)), Rows(first[False], len(known)), prior)
    return known, w, b + float(np.log((1 - prior) / prior))


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, float], threshold: float = 0.7) -> DataFrame:
    """Adds held_out, score (0 to 1) and predicted (1 from threshold on) to docs (doc_id, text, ...).

    Works on one row at a time: repeated rows score alike, null text is empty,
    texts of any length are read whole, a null doc_id is not held out, empty
    docs give an empty output.  All columns stay but those named like an added one.
    """
    docs = docs.drop("held_out", "score", "predicted")
    docs = docs.withColumn("held_out", held_out(docs))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, weights, b = shared.value
        w = np.zeros(1 << SPACE_BITS)
        w[known] = weights
        for batch in batches:
            for part in pieces(batch):
                text, feature = features(part.column("text").to_pylist())
                logit = np.bincount(text, w[feature], part.num_rows) + b
                value = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(value), pa.array((value >= threshold).astype(np.int32))], names=[*part.schema.names, "score", "predicted"])

    schema = T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    return docs.mapInArrow(frugal(run), schema)


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows (doc_id, held_out, score, predicted)."""
    return score(docs.select("doc_id", "text"), train(docs, labels)).drop("text").select("doc_id", "held_out", "score", "predicted")
