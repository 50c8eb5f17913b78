"""Spans of a document that also stand in a document with a smaller number.

Texts are sequences of symbols (hashed words, or bytes).  A window is `window`
symbols in a row; it is repeated if an equal window starts in a document with a
smaller doc number.  All windows of all texts are judged, exactly, without
bringing every text to every other:

1. Texts are dealt out to batches of a few MB.  In each batch every window gets
   its anchor, the least hash of its grams; equal windows have equal anchors.
   Neighbouring windows with one anchor form a run.
2. The anchors of each batch go, sorted and packed into five bytes each, to
   buckets by hash; a bucket answers each batch with one bit for each anchor:
   whether another batch has it too.
3. Of the runs whose anchor another text has, each batch sends one record for
   all that are equal, with the least document.  A bucket answers with one bit
   for each record, whether a smaller document holds the same run; and it asks
   for one copy of each different run that may share windows with another:
   every window holds the symbols to the left or those to the right of its
   anchor, so a run of which neither side is found with another run of the
   anchor is done.
4. These reference strings meet in shards, whole anchors to a shard, where a
   solver finds the windows that also stand in a string of a smaller document.
   An anchor with very many different runs is dealt out further, window by
   window, by the windows' hashes.
5. The spans come back to the batch that holds the text.

One exchange deals out the texts and is reused by steps 1, 3, 4 and 5; what
goes between batches and buckets are a few packed rows for each batch.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import symbols as S
from .common import row_key
from .counters import frugal

#: A solver takes strings of symbols and their document numbers; it returns, for each string, the (sorted) first symbols of its repeated windows.
Solver = Callable[[list[np.ndarray], np.ndarray, int], list[np.ndarray]]

#: Bytes of a batch, at least; it grows with the root of the input, as do the rows that a batch sends.
BATCH_BYTES = 2_000_000
#: Batches for each bucket; a bucket's keys are in proportion to that, at any input size.
PER_BUCKET = 8
#: Symbols of one piece of a batch, so that its arrays stay in the processor's cache; pieces overlap by window - 1 symbols.
PIECE = 1 << 16
#: An anchor with more different runs than this is dealt out window by window.
MAX_RUNS = 4_000
#: Null doc_ids come after all others and are one document to each other.
LAST = 2**63 - 1


class Kind:
    """What a symbol is: "words" (hashed) or "bytes"."""

    def __init__(self, name: str, window: int, gram: int):
        self.name, self.window, self.gram = name, window, gram

    def read(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Bytes, symbols, their number for each text, and where each symbol starts and ends in the bytes."""
        data, lengths = S.flat(texts)
        if self.name == "bytes":
            at = np.arange(len(data) + 1)
            return data, data, lengths, at[:-1], at[1:]
        hashes, start, end, counts = S.words(data, lengths)
        return data, hashes, counts, start, end

    def runs(self, symbols: np.ndarray, counts: np.ndarray, content: bool = True, sides: bool = True) -> Runs:
        """All runs of a batch, with what is asked for; places are those of its flat symbols."""
        ends, found = np.cumsum(counts), []
        side, none = -(-(self.window - self.gram) // 2), np.zeros(0, np.uint64)
        for at in range(0, max(1, len(symbols) - self.window + 1), PIECE):
            upto = min(len(symbols), at + PIECE + self.window - 1)
            values = S.byte_symbols(symbols[at:upto]) if self.name == "bytes" else symbols[at:upto]
            # the texts of this piece: the one that holds its first symbol, and those up to its last
            a, b = np.searchsorted(ends, at, side="right"), np.searchsorted(ends, upto, side="left") + 1
            piece = np.diff(np.concatenate([[at], np.clip(ends[a:b], at, upto)]))
            total = S.sums(values)
            anchor, text, first, last, place = S.runs(values, piece, self.window, self.gram, total)
            whole, parts = none, [none.astype(np.uint16)] * 2
            if content:
                whole = S.spans_hash(values, first, last + self.window, total) >> np.uint64(16)
            if sides:
                # a side that the text or the piece does not have is no window's either: first and last tell how far windows reach
                left, right = place - side, place + self.gram + side
                has_left, has_right = first <= left, last + self.window >= right
                parts = [np.where(has, S.spans_hash(values, np.where(has, x, 0), np.where(has, y, 0), total) >> np.uint64(49) | np.uint64(1 << 15), 0).astype(np.uint16) for has, x, y in ((has_left, left, place + self.gram), (has_right, place, right))]
            found.append((anchor, text + a, first + at, last + at, whole, *parts))
        return Runs(*(np.concatenate(x) for x in zip(*found, strict=True)))


class Runs(NamedTuple):
    anchor: np.ndarray
    text: np.ndarray
    first: np.ndarray
    last: np.ndarray
    #: 48 bits of the hash of the run's symbols.
    content: np.ndarray
    #: 15 bits of the hash of the anchor and the symbols to its left, or to its right, that half of the rest of a window has; 0 if no window of the run has them.
    left: np.ndarray
    right: np.ndarray


def _ordered(table: pa.Table) -> pa.Table:
    """In the order of the row keys, which no shuffle changes: a text is known by its place."""
    return table.sort_by([("rid", "ascending")])


def _texts(table: pa.Table) -> tuple[int, np.ndarray, list[str | None]]:
    """Batch number, documents and texts."""
    table = _ordered(table)
    return table["batch"][0].as_py(), table["doc"].to_numpy(), table["text"].to_pylist()


def _own(anchor: np.ndarray, buckets: int) -> np.ndarray:
    """An anchor's bucket, and 40 bits within it, as one number."""
    key = anchor >> np.uint64(7)
    return ((key >> np.uint64(40)) % np.uint64(buckets)) << np.uint64(40) | key & np.uint64((1 << 40) - 1)


def _packed(values: np.ndarray, width: int) -> bytes:
    return values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def _unpacked(blob: bytes, width: int) -> np.ndarray:
    raw = np.zeros((len(blob) // width, 8), np.uint8)
    raw[:, :width] = np.frombuffer(blob, np.uint8).reshape(-1, width)
    return raw.view("<u8").ravel()


def _by_bucket(own: np.ndarray) -> list[tuple[int, int, int]]:
    """(bucket, start, end) of sorted numbers of _own()."""
    bucket = (own >> np.uint64(40)).astype(np.int64)
    at = np.flatnonzero(np.diff(bucket, prepend=-1))
    return list(zip(bucket[at].tolist(), at.tolist(), [*at[1:].tolist(), len(own)], strict=False))


def _table(schema: pa.Schema, rows: list[tuple]) -> pa.Table:
    return pa.Table.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)


def _schema(fields: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "binary": pa.binary()}
    return pa.schema([(n, kinds[k]) for n, k in (x.split() for x in fields.split(", "))])


_ASKED, _BITS = "bucket long, batch long, blob binary", "bucket long, batch long, bits binary"
_SETTLED, _FOUND = "batch long, bucket long, bits binary, asked binary", "batch long, bucket long, bits binary, places binary, sizes binary, windows binary"
_STRINGS = "bucket long, batch long, asked binary, symbols binary"
#: What a bucket asks a batch for: where a run lies there, its windows, its document, and its anchor (or 0: window by window).
_ASK = np.dtype([("place", "<u4"), ("n", "u1"), ("doc", "<i8"), ("anchor", "<u8")])


def _send_anchors(kind: Kind, buckets: int):
    def send(table: pa.Table) -> pa.Table:
        batch, _, texts = _texts(table)
        _, symbols, counts, _, _ = kind.read(texts)
        own = np.unique(_own(kind.runs(symbols, counts, content=False, sides=False).anchor, buckets))
        return _table(_schema(_ASKED), [(k, batch, _packed(own[a:b], 5)) for k, a, b in _by_bucket(own)])

    return send


def _answer(table: pa.Table) -> pa.Table:
    parts = [_unpacked(blob, 5) for blob in table["blob"].to_pylist()]
    values = np.sort(np.concatenate(parts))
    shared = np.unique(values[1:][values[1:] == values[:-1]])
    bits = [np.packbits(np.isin(p, shared, assume_unique=True)).tobytes() for p in parts]
    return _table(_schema(_BITS), list(zip(table["bucket"].to_pylist(), table["batch"].to_pylist(), bits, strict=True)))


class Records(NamedTuple):
    """The different runs of a batch whose anchor another text has, too, by (own, content): of each, its spots as runs of the batch, by document."""

    own: np.ndarray
    head: np.ndarray
    size: np.ndarray
    spots: np.ndarray


def _records(runs: Runs, docs: np.ndarray, buckets: int, right: pa.Table) -> Records:
    own, doc = _own(runs.anchor, buckets), docs[runs.text]
    order = np.argsort(own)
    a, d = own[order], doc[order]
    group = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]])) if len(a) else np.zeros(0, np.int64)
    keys, size = a[group], np.diff(np.append(group, len(a)))
    shared = np.zeros(len(keys), bool)
    answers = {k: b for k, b, more in zip(right["bucket"].to_pylist(), right["bits"].to_pylist(), right["step"].to_pylist(), strict=True) if more == 1}
    for k, x, y in _by_bucket(keys):
        shared[x:y] = np.unpackbits(np.frombuffer(answers[k], np.uint8), count=y - x).astype(bool)
    # in another batch, or in two documents of this one
    keep = np.zeros(len(own), bool)
    if len(a):
        keep[order] = np.repeat(shared | (np.minimum.reduceat(d, group) != np.maximum.reduceat(d, group)), size)
    at = np.flatnonzero(keep)
    at = at[np.lexsort((at, doc[at], runs.content[at], own[at]))]
    new = np.ones(len(at), bool)
    new[1:] = (own[at][1:] != own[at][:-1]) | (runs.content[at][1:] != runs.content[at][:-1])
    heads = np.flatnonzero(new)
    return Records(own[at[heads]], at[heads], np.diff(np.append(heads, len(at))), at)


def _send_records(kind: Kind, buckets: int):
    def send(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return _schema(_ASKED).empty_table()
        batch, docs, texts = _texts(left)
        _, symbols, counts, _, _ = kind.read(texts)
        runs = kind.runs(symbols, counts)
        r = _records(runs, docs, buckets, right)
        doc, n = docs[runs.text[r.head]], (runs.last - runs.first + 1)[r.head]
        # nearly all documents' numbers fit into five bytes
        width = 5 if not len(doc) or (doc.min() >= 0 and doc.max() < 1 << 40) else 8
        rows = []
        for k, a, b in _by_bucket(r.own):
            h = r.head[a:b]
            columns = [(r.own[a:b], 5), (runs.content[h], 6), (doc[a:b].view(np.uint64), width), (runs.left[h], 2), (runs.right[h], 2), (runs.first[h], 4), (n[a:b], 1)]
            rows.append((k, batch, bytes([width]) + b"".join(_packed(c, w) for c, w in columns)))
        return _table(_schema(_ASKED), rows)

    return send


def _settle(table: pa.Table) -> pa.Table:
    """Answers each batch of a bucket, and asks for one copy, that of the least document, of each run that may share windows with another."""
    batches, parts = table["batch"].to_pylist(), []
    for blob in table["blob"].to_pylist():
        widths = (5, 6, blob[0], 2, 2, 4, 1)
        n, at, columns = (len(blob) - 1) // sum(widths), 1, []
        for w in widths:
            columns.append(_unpacked(blob[at : at + n * w], w))
            at += n * w
        parts.append(columns)
    anchor, content, doc, left, right, place, n = (np.concatenate(x) for x in zip(*parts, strict=True))
    doc = doc.view(np.int64)
    sizes = np.array([len(p[0]) for p in parts])
    source = np.repeat(np.arange(len(parts)), sizes)
    order = np.lexsort((source, doc, content, anchor))
    new = np.ones(len(order), bool)
    new[1:] = (anchor[order][1:] != anchor[order][:-1]) | (content[order][1:] != content[order][:-1])
    head, number = order[np.flatnonzero(new)], np.empty(len(order), np.int64)
    number[order] = np.cumsum(new) - 1
    smaller = doc > doc[head][number]
    ask = np.zeros(len(head), bool)
    for side in (left[head], right[head]):
        _, at, times = np.unique(anchor[head] << np.uint64(16) | side, return_inverse=True, return_counts=True)
        ask |= (times[at] > 1) & (side > 0)
    # one copy of each, or of each batch where one document's rows are in several
    asked = np.flatnonzero(ask[number] & ~smaller)
    _, at, times = np.unique(anchor[asked], return_inverse=True, return_counts=True)
    asks = np.zeros(len(asked), _ASK)
    asks["place"], asks["n"], asks["doc"] = place[asked], n[asked], doc[asked]
    # never 0, which stands for window by window
    asks["anchor"] = np.where(times[at] <= MAX_RUNS, anchor[asked] + np.uint64(1), 0)
    by = np.argsort(source[asked], kind="stable")
    cut = np.searchsorted(source[asked][by], np.arange(1, len(parts)))
    ends = np.cumsum(sizes)
    rows = [(b, k, np.packbits(smaller[e - s : e]).tobytes(), asks[x].tobytes()) for b, k, s, e, x in zip(batches, table["bucket"].to_pylist(), sizes, ends, np.split(by, cut), strict=True)]
    return _table(_schema(_SETTLED), rows)


def _send_strings(kind: Kind, buckets: int):
    def send(left: pa.Table, right: pa.Table) -> pa.Table:
        rows = []
        if left.num_rows and right.num_rows:
            batch, _, texts = _texts(left)
            _, symbols, _, _, _ = kind.read(texts)
            loose = []
            for bucket, blob in zip(right["bucket"].to_pylist(), right["asked"].to_pylist(), strict=True):
                asks = np.frombuffer(blob, _ASK)
                whole = asks[asks["anchor"] > 0]
                loose.append(asks[asks["anchor"] == 0])
                if len(whole):
                    rows.append((bucket, batch, whole.tobytes(), _cut(symbols, whole, kind.window).tobytes()))
            each = np.concatenate(loose)
            if len(each):
                row = np.repeat(np.arange(len(each)), each["n"])
                one = each[row]
                one["place"] += (np.arange(len(row)) - np.repeat(np.cumsum(each["n"], dtype=np.int64) - each["n"], each["n"])).astype("<u4")
                one["n"] = 1
                values = S.byte_symbols(symbols) if kind.name == "bytes" else symbols
                one["anchor"] = S.spans_hash(values, one["place"].astype(np.int64), one["place"].astype(np.int64) + kind.window) | np.uint64(1)
                bucket = (one["anchor"] >> np.uint64(8)) % np.uint64(buckets)
                for k in np.unique(bucket).tolist():
                    some = one[bucket == k]
                    rows.append((k, batch, some.tobytes(), _cut(symbols, some, kind.window).tobytes()))
        return _table(_schema(_STRINGS), rows)

    return send


def _cut(symbols: np.ndarray, asks: np.ndarray, window: int) -> np.ndarray:
    """The symbols of the asked runs in a row."""
    n = asks["n"].astype(np.int64) + window - 1
    return symbols[np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(asks["place"].astype(np.int64), n)]


def _solve(kind: Kind, solver: Solver, shard_symbols: int):
    """The strings of a bucket, whole anchors together until a shard is full; rows for each batch with what was found there."""
    of = np.dtype(np.uint8 if kind.name == "bytes" else np.uint64)

    def solve(table: pa.Table) -> pa.Table:
        parts = [np.frombuffer(b, _ASK) for b in table["asked"].to_pylist()]
        asks, symbols = np.concatenate(parts), np.concatenate([np.frombuffer(b, of) for b in table["symbols"].to_pylist()])
        source = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
        n = asks["n"].astype(np.int64) + kind.window - 1
        start = np.cumsum(n) - n
        order = np.lexsort((asks["place"], source, asks["anchor"]))
        anchor = asks["anchor"][order]
        upto = np.cumsum(n[order])
        group_end = np.append(np.flatnonzero(anchor[1:] != anchor[:-1]) + 1, len(order))
        hits: dict[int, list] = {}
        a = 0
        while a < len(order):
            # whole groups, at least one, until shard_symbols are reached
            full = np.searchsorted(upto, (upto[a - 1] if a else 0) + shard_symbols)
            b = int(group_end[min(np.searchsorted(group_end, min(full + 1, len(order))), len(group_end) - 1)])
            some = order[a:b]
            found = solver([symbols[start[i] : start[i] + n[i]] for i in some], asks["doc"][some], kind.window)
            for i, f in zip(some.tolist(), found, strict=True):
                if len(f):
                    hits.setdefault(int(source[i]), []).append((int(asks["place"][i]), f))
            a = b
        batches, rows = table["batch"].to_pylist(), []
        for k, x in hits.items():
            places, sizes = np.array([p for p, _ in x], "<u4"), np.array([len(f) for _, f in x], "<u4")
            rows.append((batches[k], None, None, places.tobytes(), sizes.tobytes(), np.concatenate([f for _, f in x]).astype("u1").tobytes()))
        return _table(_schema(_FOUND), rows)

    return solve


def _mask(kind: Kind, symbols: np.ndarray, counts: np.ndarray, docs: np.ndarray, buckets: int, right: pa.Table) -> np.ndarray:
    """True for each symbol of the batch that a repeated window covers."""
    runs = kind.runs(symbols, counts, sides=False)
    r = _records(runs, docs, buckets, right)
    smaller = np.zeros(len(r.own), bool)
    bits = {k: b for k, b, step in zip(right["bucket"].to_pylist(), right["bits"].to_pylist(), right["step"].to_pylist(), strict=True) if step == 2}
    for k, a, b in _by_bucket(r.own):
        smaller[a:b] = np.unpackbits(np.frombuffer(bits[k], np.uint8), count=b - a).astype(bool)
    steps = np.zeros(len(symbols) + 1, np.int32)

    def cover(first: np.ndarray, last: np.ndarray) -> None:
        np.add.at(steps, first, 1)
        np.add.at(steps, last, -1)

    # a smaller document holds the run: elsewhere, or in this batch
    record = np.repeat(np.arange(len(r.own)), r.size)
    doc = docs[runs.text[r.spots]]
    least = docs[runs.text[r.head]]
    whole = r.spots[smaller[record] | (doc > least[record])]
    cover(runs.first[whole], runs.last[whole] + kind.window)
    # windows of a run that stand in other runs: in all its spots of the least document, that of the copy that was sent
    by_place = np.argsort(runs.first[r.head], kind="stable")
    begin = np.cumsum(r.size) - r.size
    solved = right.filter(pc.is_valid(right["places"]))
    for places, sizes, windows in zip(solved["places"].to_pylist(), solved["sizes"].to_pylist(), solved["windows"].to_pylist(), strict=True):
        place, size, window = np.frombuffer(places, "<u4").astype(np.int64), np.frombuffer(sizes, "<u4").astype(np.int64), np.frombuffer(windows, "u1").astype(np.int64)
        # single windows that were dealt out by themselves lie inside their run
        at = by_place[np.searchsorted(runs.first[r.head][by_place], place, side="right") - 1]
        shift = place - runs.first[r.head[at]]
        n_spots = np.array([int(np.searchsorted(doc[begin[k] : begin[k] + r.size[k]], least[k], side="right")) for k in at.tolist()], np.int64)
        ask = np.repeat(np.arange(len(at)), n_spots)
        spot = r.spots[begin[at][ask] + np.arange(len(ask)) - np.repeat(np.cumsum(n_spots) - n_spots, n_spots)]
        m = size[ask]
        which = np.arange(int(m.sum())) - np.repeat(np.cumsum(m) - m, m) + np.repeat((np.cumsum(size) - size)[ask], m)
        first = np.repeat(runs.first[spot] + shift[ask], m) + window[which]
        cover(first, first + kind.window)
    return np.cumsum(steps[:-1]) > 0


def _kept_text(kind: Kind, data: np.ndarray, start: np.ndarray, keep: np.ndarray, begin: int, end: int) -> str:
    """The text of bytes begin to end without the removed symbols; with a word go the blanks after it, other blanks and line ends stay."""
    if kind.name == "bytes":
        return data[begin:end][keep].tobytes().decode("utf-8", "replace")
    steps = np.ones(end - begin, bool)
    for a, b in zip(start[~keep].tolist(), np.append(start[1:], end)[~keep].tolist(), strict=True):
        steps[a - begin : b - begin] = False
    return data[begin:end][steps].tobytes().decode("utf-8", "replace")


def _apply(kind: Kind, buckets: int, with_text: bool):
    def digest(table: pa.Table, right: pa.Table) -> dict[str, list]:
        _, docs, texts = _texts(table)
        data, symbols, counts, start, end = kind.read(texts)
        solid = ~_mask(kind, symbols, counts, docs, buckets, right)
        raw, at, byte = data.tobytes(), 0, 0
        out: dict[str, list] = {"n_symbols": [], "n_removed": [], "n_spans": [], "kept_sha256": [], "kept_text": []}
        for text, n in zip(texts, counts.tolist(), strict=True):
            size = 0 if text is None else len(text.encode("utf-8", "surrogatepass"))
            keep = solid[at : at + n]
            removed = n - int(keep.sum())
            opens = ~keep
            opens[1:] &= keep[:-1]
            if kind.name == "bytes":
                left = data[at : at + n][keep].tobytes() if removed else raw[at : at + n]
            else:
                place = np.flatnonzero(keep) + at
                left = b" ".join([raw[a:b] for a, b in zip(start[place].tolist(), end[place].tolist(), strict=True)])
            for k, v in (("n_symbols", n), ("n_removed", removed), ("n_spans", int(opens.sum())), ("kept_sha256", hashlib.sha256(left).hexdigest())):
                out[k].append(v)
            if with_text:
                out["kept_text"].append(_kept_text(kind, data, start[at : at + n], keep, byte, byte + size) if removed else text)
            at += n
            byte += size
        return out

    def apply(left: pa.Table, right: pa.Table) -> pa.Table:
        left = _ordered(left)
        out = digest(left, right) if left.num_rows else {k: [] for k in ("n_symbols", "n_removed", "n_spans", "kept_sha256", "kept_text")}
        kinds = {"kept_sha256": pa.string(), "kept_text": pa.string()}
        made = {k: pa.array(v, kinds.get(k, pa.int64())) for k, v in out.items() if with_text or k != "kept_text"}
        return pa.table({"row": left["row"]} | made)

    return apply


def remove_repeats(docs: DataFrame, kind: Kind, solver: Solver, shard_symbols: int, with_text: bool = False) -> DataFrame:
    """Rows (row, n_symbols, n_removed, n_spans, kept_sha256[, kept_text]) for rows (doc_id, text, ...).

    row: a struct of all columns but text.  n_spans: maximal runs of removed
    symbols.  kept_text is the text as it came where nothing is removed; else
    the text without the removed words and the blanks after each, or the kept
    bytes (bytes that are no longer UTF-8 become U+FFFD there, not in the digest).

    Null text: no symbols.  Texts shorter than a window: nothing is removed;
    very long ones are read whole, a piece at a time.
    Rows with the same doc_id are one document: they do not remove each other's
    windows.  Null doc_ids come last and are one document, too.  Repeated rows
    are treated alike.  Empty input: empty output.
    """
    rid = row_key(F.col("doc_id"), F.col("text"))
    total = docs.select(F.sum(F.octet_length("text"))).first()[0] or 0
    n_batches = int(total // max(BATCH_BYTES, 4 * math.isqrt(total))) + 1
    buckets = n_batches // PER_BUCKET + 1
    doc = F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST))
    row = F.struct(*[docs[c] for c in docs.columns if c != "text"])
    texts = docs.select(rid.alias("rid"), doc.alias("doc"), "text", F.pmod(rid, F.lit(n_batches)).alias("batch"), row.alias("row"))
    by_batch = texts.groupBy("batch")
    bits = by_batch.applyInArrow(frugal(_send_anchors(kind, buckets)), _ASKED).groupBy("bucket").applyInArrow(frugal(_answer), _BITS)
    bits = bits.withColumn("step", F.lit(1))
    settled = by_batch.cogroup(bits.groupBy("batch")).applyInArrow(frugal(_send_records(kind, buckets)), _ASKED).groupBy("bucket").applyInArrow(frugal(_settle), _SETTLED)
    strings = by_batch.cogroup(settled.where(F.octet_length("asked") > 0).groupBy("batch")).applyInArrow(frugal(_send_strings(kind, buckets)), _STRINGS)
    solved = strings.groupBy("bucket").applyInArrow(frugal(_solve(kind, solver, shard_symbols)), _FOUND).withColumn("step", F.lit(3))
    found = bits.unionByName(settled.drop("asked").withColumn("step", F.lit(2)), allowMissingColumns=True).unionByName(solved, allowMissingColumns=True)
    schema = T.StructType([T.StructField("row", texts.schema["row"].dataType), *[T.StructField(n, T.LongType()) for n in ("n_symbols", "n_removed", "n_spans")], T.StructField("kept_sha256", T.StringType())])
    return by_batch.cogroup(found.groupBy("batch")).applyInArrow(frugal(_apply(kind, buckets, with_text)), schema.add("kept_text", T.StringType()) if with_text else schema)
