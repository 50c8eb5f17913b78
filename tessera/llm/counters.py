"""Counters of fixed number that all rows of a table add to: hashed statistics whose size doesn't grow with the data."""

from __future__ import annotations

import ctypes
import inspect
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

#: Counters are summed up in so many ranges, by as many tasks.
RANGES = 256
#: Texts of one piece of a batch, in bytes.
PIECE_BYTES = 1_000_000


def give_back() -> None:
    """Returns freed memory to the system: a Python worker lives on, idle, beside the work of the stages after its own."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def frugal(work: Callable) -> Callable:
    """work, a function on an iterator of batches or on one or two tables, that gives memory back when it is done."""
    if inspect.isgeneratorfunction(work):

        def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            try:
                yield from work(rows)
            finally:
                give_back()

        return batches

    def one(table: pa.Table) -> pa.Table:
        out = work(table)
        give_back()
        return out

    def two(left: pa.Table, right: pa.Table) -> pa.Table:
        out = work(left, right)
        give_back()
        return out

    return one if len(inspect.signature(work).parameters) == 1 else two


def pieces(batch: pa.RecordBatch, size: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch (text, ...) of about `size` bytes of text; one text is never cut."""
    sizes = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False)
    group = np.cumsum(sizes, dtype=np.int64) // size
    edges = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(group)]
    for i, j in zip(edges, edges[1:], strict=False):
        if j > i:
            yield batch.slice(i, j - i)


def packed(total: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """(range, compressed counters) of an array of counters."""
    for k, part in enumerate(np.array_split(total, RANGES)):
        if part.any():
            yield k, zlib.compress(part.tobytes(), 1)


def add_up(parts: DataFrame, width: int) -> np.ndarray:
    """The sum of rows (k, part) that packed() made of uint32 arrays of `width`; 8 * width bytes reach the driver, at any input size."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for k, part in zip(b.column("k").to_pylist(), b.column("part").to_pylist(), strict=True):
                x = np.frombuffer(zlib.decompress(part), np.uint32)
                total[k] = total[k] + x if k in total else x.astype(np.uint64)
        sums = [zlib.compress(x.tobytes(), 1) for x in total.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array(sums, pa.binary())], names=["k", "part"])

    out = np.array_split(np.zeros(width, np.uint64), RANGES)
    for r in parts.repartition(RANGES, "k").mapInArrow(frugal(add), "k int, part binary").collect():
        out[r["k"]] = np.frombuffer(zlib.decompress(r["part"]), np.uint64)
    return np.concatenate(out)


def counted(rows: DataFrame, width: int, places: Callable[[pa.RecordBatch], np.ndarray]) -> np.ndarray:
    """How often places(piece) names each of `width` counters, over all rows (text, ...)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width, np.uint32)
        for b in batches:
            for part in pieces(b):
                total += np.bincount(places(part), minlength=width).astype(np.uint32)
        out = list(packed(total))
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in out], pa.int32()), pa.array([p for _, p in out], pa.binary())], names=["k", "part"])

    return add_up(rows.mapInArrow(frugal(count), "k int, part binary"), width)
