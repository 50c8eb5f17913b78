"""Which keys of a batch of rows stand in another batch, too, without a row for each key.

Each batch sends its distinct keys, packed into KEY_BYTES bytes each, to buckets;
a bucket answers each batch with one bit for each key.  A key of many batches is
one key of each, so no bucket fills up by it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .counters import frugal

#: Keys are told apart by so many bytes; two that differ beyond count as one, so what is found this way is to be verified.
KEY_BYTES = 6
_KEYS = pa.schema([("bucket", pa.int64()), ("batch", pa.int64()), ("blob", pa.binary())])
_BITS = pa.schema([("bucket", pa.int64()), ("batch", pa.int64()), ("bits", pa.binary())])
KEYS, BITS = "bucket long, batch long, blob binary", "bucket long, batch long, bits binary"


def keys_of(hashes: np.ndarray) -> np.ndarray:
    """The upper KEY_BYTES bytes of 64-bit hashes."""
    return hashes >> np.uint64(64 - 8 * KEY_BYTES)


def pack(keys: np.ndarray) -> np.ndarray:
    """Bytes, KEY_BYTES a row, of keys."""
    return keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :KEY_BYTES]


def unpack(blob: bytes) -> np.ndarray:
    raw = np.zeros((len(blob) // KEY_BYTES, 8), np.uint8)
    raw[:, :KEY_BYTES] = np.frombuffer(blob, np.uint8).reshape(-1, KEY_BYTES)
    return raw.view("<u8").ravel()


def _parts(keys: np.ndarray, buckets: int) -> Iterator[tuple[int, np.ndarray]]:
    """(bucket, keys) of sorted distinct keys."""
    bucket = (keys % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    at = np.searchsorted(bucket[order], np.arange(buckets + 1))
    for k, (a, b) in enumerate(zip(at, at[1:], strict=False)):
        if b > a:
            yield k, order[a:b]


def question(batch: int, keys: np.ndarray, buckets: int) -> pa.Table:
    """Rows (bucket, batch, blob) of a batch's sorted distinct keys."""
    parts = [(k, pack(keys[at]).tobytes()) for k, at in _parts(keys, buckets)]
    return pa.table({"bucket": [k for k, _ in parts], "batch": [batch] * len(parts), "blob": [b for _, b in parts]}, schema=_KEYS)


def _answer(table: pa.Table) -> pa.Table:
    parts = [unpack(blob) for blob in table["blob"].to_pylist()]
    values = np.sort(np.concatenate(parts))
    shared = np.unique(values[1:][values[1:] == values[:-1]])
    bits = [np.packbits(np.isin(p, shared, assume_unique=True)).tobytes() for p in parts]
    return pa.table({"bucket": table["bucket"], "batch": table["batch"], "bits": bits}, schema=_BITS)


def answers(questions: DataFrame) -> DataFrame:
    """Rows (bucket, batch, bits) to rows (bucket, batch, blob)."""
    return questions.groupBy("bucket").applyInArrow(frugal(_answer), BITS)


def answered(keys: np.ndarray, buckets: int, table: pa.Table) -> np.ndarray:
    """For each of a batch's sorted distinct keys, whether another batch has it; table: the batch's answers."""
    found = dict(zip(table["bucket"].to_pylist(), table["bits"].to_pylist(), strict=True))
    out = np.zeros(len(keys), bool)
    for k, at in _parts(keys, buckets):
        out[at] = np.unpackbits(np.frombuffer(found[k], np.uint8), count=len(at)).astype(bool)
    return out
