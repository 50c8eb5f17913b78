"""N-gram Jaccard join: documents whose sets of word shingles are alike, and their connected components.

Documents with equal sets are one class, known by its smallest doc_id; only
classes are compared.  Shingles are ordered rare first; two sets that are alike
enough share a shingle in their prefixes, so classes are joined on those, under
length, positional and suffix filters, and each pair that is left is verified
once on the whole sets.

Only links between components matter, and a shingle of very many near copies
would make a pair of each two of them.  So each class is first held against the
pivots of a few of its shingles, which link most of a group; after that a class
meets those classes of its shingles that lie in another component, block by
block.  That goes in turns: in each, a class is verified with one of the classes
that it passes the filters with, so that what a turn verifies grows with the
classes, not with their pairs, and the components that are found to be linked
are one in the next turn.  When turns find few links more, all pairs between
components that pass the filters are verified.  Pairs inside a component need no
look, all others get one: no link between components is lost.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import meeting
from . import symbols as S
from .common import Tables, small
from .counters import add_up, frugal, packed, pieces

#: Documents of one piece of a batch, in bytes.
PIECE_BYTES = 2_000_000
#: Counters of the frequency sketch, at any input size.
COUNTERS = 1 << 21
#: Ranges of shingles, by hash, for the suffix filter; and how many of them are one coarse range.
BINS, COARSE = 64, 8
#: Bytes of texts of which the prefixes go to one batch, at least; it grows with the root of the input, as do the rows that a batch sends.
BATCH_BYTES = 4_000_000
#: Batches for each bucket of keys.
PER_BUCKET = 8
#: Shared shingles of a class that are held against pivots.
LEADS = 3
#: Classes of one shingle that meet in one block.
BLOCK = 2_048
#: Rows of pairs looked at together.
CHUNK = 1 << 20
#: Turns of one partner a class go on while over one of so many pairs is a link.
WORTH = 10


def shingle_sets(texts: list[str | None], n: int) -> list[np.ndarray]:
    """The distinct hashed shingles of n words of each text; a shorter one is one shingle, an empty one none."""
    data, lengths = S.flat(texts)
    hashes, _, _, counts = S.words(S.lower_ascii(data), lengths)
    grams, at, out = S.grams(hashes, n), 0, []
    for c in counts.tolist():
        if c >= n:
            out.append(np.unique(grams[at : at + c - n + 1]))
        elif c:
            out.append(S.spans_hash(hashes, np.array([at]), np.array([at + c])))
        else:
            out.append(np.zeros(0, np.uint64))
        at += c
    return out


def _nodes(sets: list[np.ndarray]) -> np.ndarray:
    """A key of each set, equal for equal sets."""
    salt = np.uint64(0x632BE59BD9B4E019)
    x = np.array([s.sum(dtype=np.uint64) for s in sets], np.uint64)
    y = np.array([S.mix(s ^ salt).sum(dtype=np.uint64) for s in sets], np.uint64)
    size = np.array([len(s) for s in sets], np.uint64)
    return S.mix(S.mix(S.mix(x) + y) + size).view(np.int64)


def _counter(shingles: np.ndarray) -> np.ndarray:
    return ((shingles >> np.uint64(7)) % np.uint64(COUNTERS)).astype(np.int64)


def _read(docs: DataFrame, n: int) -> DataFrame:
    """Rows (doc_id, node, n_shingles), one a text, and rows (k, part) with the counters of each task."""
    schema = pa.schema([("doc_id", pa.int64()), ("node", pa.int64()), ("n_shingles", pa.int64()), ("k", pa.int32()), ("part", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(COUNTERS, np.uint32)
        for b in batches:
            for part in pieces(b, PIECE_BYTES):
                sets = shingle_sets(part.column("text").to_pylist(), n)
                total += np.bincount(_counter(np.concatenate(sets)), minlength=COUNTERS).astype(np.uint32)
                none = [None] * len(sets)
                made = [part.column("doc_id"), _nodes(sets), [len(s) for s in sets], none, none]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(made, schema, strict=True)], schema=schema)
        out = list(packed(total))
        none = [None] * len(out)
        made = [none, none, none, [k for k, _ in out], [p for _, p in out]]
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(made, schema, strict=True)], schema=schema)

    return docs.mapInArrow(frugal(run), "doc_id long, node long, n_shingles long, k int, part binary")


def _prefixes(docs: DataFrame, n: int, num: int, den: int, scale) -> DataFrame:
    """Rows (doc_id, node, size, bins, prefix): a histogram of the set, and the keys of its rarest shingles, rare first.

    The rarest m - ceil(m * num / den) + 1 of m shingles: any set alike enough
    has one of them among its own.  The order is that of (counter, hash), one
    order for all sets.  A set of over 65,535 shingles has no histogram.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("node", pa.int64()), ("size", pa.int64()), ("bins", pa.binary()), ("prefix", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank = scale.value
        for b in batches:
            for part in pieces(b, PIECE_BYTES):
                sets = shingle_sets(part.column("text").to_pylist(), n)
                bins, prefix = [], []
                for s in sets:
                    m = len(s)
                    order = np.argsort(rank[_counter(s)].astype(np.uint64) << np.uint64(56) | s >> np.uint64(8), kind="stable")
                    first = s[order[: m - -(-m * num // den) + 1]]
                    prefix.append(np.column_stack([meeting.pack(meeting.keys_of(first)), (first % np.uint64(BINS)).astype(np.uint8)]).tobytes())
                    bins.append(np.bincount((s % np.uint64(BINS)).astype(np.int64), minlength=BINS).astype("<u2").tobytes() if m < 65_536 else b"")
                made = [part.column("doc_id"), _nodes(sets), [len(s) for s in sets], bins, prefix]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(made, schema, strict=True)], schema=schema)

    return docs.mapInArrow(frugal(run), "doc_id long, node long, size long, bins binary, prefix binary")


class _Prefixes:
    """The prefixes of a batch of classes, flat: key, bin, class number and place of each shingle."""

    def __init__(self, table: pa.Table):
        # rows that repeat doc_id and text are one class
        _, first = np.unique(table["node"].to_numpy(), return_index=True)
        table = table.take(pa.array(first))
        self.node, self.size = table["node"].to_numpy(), table["size"].to_numpy()
        blobs = table["prefix"].to_pylist()
        raw = np.frombuffer(b"".join(blobs), np.uint8).reshape(-1, meeting.KEY_BYTES + 1)
        self.key, self.bin = meeting.unpack(raw[:, : meeting.KEY_BYTES].tobytes()), raw[:, -1].astype(np.int64)
        counts = np.array([len(b) // raw.shape[1] for b in blobs], np.int64)
        self.owner = np.repeat(np.arange(len(blobs)), counts)
        self.pos = np.arange(len(self.key)) - np.repeat(np.cumsum(counts) - counts, counts)
        self.bins = table["bins"].to_pylist()


def _ask(buckets: int):
    return lambda table: meeting.question(table["batch"][0].as_py(), np.unique(_Prefixes(table).key), buckets)


_POSTINGS = "shingle long, node long, size long, pos long, nth int, n_shared int, bins binary"
_POSTING = pa.schema([("shingle", pa.int64()), ("node", pa.int64()), ("size", pa.int64()), ("pos", pa.int64()), ("nth", pa.int32()), ("n_shared", pa.int32()), ("bins", pa.binary())])


def _post(buckets: int):
    """Of each class, the shingles of its prefix that another class has in its own: with its place, and the histogram of the shingles after it."""

    def post(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return _POSTING.empty_table()
        p = _Prefixes(left)
        keys, at, times = np.unique(p.key, return_inverse=True, return_counts=True)
        common = (meeting.answered(keys, buckets, right) | (times > 1))[at]
        row = np.flatnonzero(common)
        owner = p.owner[row]
        n_shared = np.bincount(owner, minlength=len(p.node))
        nth = np.arange(len(row)) - (np.cumsum(n_shared) - n_shared)[owner]
        edges = np.searchsorted(owner, np.arange(len(p.node) + 1))
        start = np.searchsorted(p.owner, np.arange(len(p.node)))
        bins = []
        for k in np.flatnonzero(n_shared).tolist():
            pos = p.pos[row[edges[k] : edges[k + 1]]]
            if not p.bins[k]:
                bins += [b""] * len(pos)
                continue
            last = int(pos[-1]) + 1
            seen = np.zeros((last, BINS), np.int64)
            seen[np.arange(last), p.bin[start[k] : start[k] + last]] = 1
            after = np.frombuffer(p.bins[k], "<u2").astype(np.int64) - np.cumsum(seen, 0)[pos]
            bins += [x.tobytes() for x in np.minimum(after, 255).astype(np.uint8)]
        made = [p.key[row].astype(np.int64), p.node[owner], p.size[owner], p.pos[row], nth, n_shared[owner], bins]
        return pa.table([pa.array(c, f.type) for c, f in zip(made, _POSTING, strict=True)], schema=_POSTING)

    return post


def _need(a: np.ndarray, b: np.ndarray, num: int, den: int) -> np.ndarray:
    """The least intersection of sets of sizes a and b with den * intersection >= num * union."""
    return -(-((a + b) * num) // (num + den))


def _passing(x: dict[str, np.ndarray], i: np.ndarray, j: np.ndarray, num: int, den: int) -> np.ndarray:
    """Which pairs of postings i, j pass the filters.

    Length: neither set is too small for the other.  Positional: the shingle
    and what comes after it in both suffice.  Suffix: so they do after taking
    from the suffixes what differs in the histograms of their ranges, coarse
    ranges first.  Before the first shingle that two prefixes share nothing is
    common, so a pair that is alike enough passes there.
    """
    size, rest = x["size"], x["size"] - x["pos"] - 1
    a, b = size[i], size[j]
    need = _need(a, b, num, den)
    ok = (np.minimum(a, b) * den >= np.maximum(a, b) * num) & (1 + np.minimum(rest[i], rest[j]) >= need)
    at = np.flatnonzero(ok)
    for bins in (x["coarse"], x["bins"]):
        for k in range(0, len(at), CHUNK // 16):
            some = at[k : k + CHUNK // 16]
            p, q = i[some], j[some]
            apart = np.abs(bins[p] - bins[q]).sum(1, dtype=np.int64) * (x["fine"][p] & x["fine"][q])
            ok[some] = 1 + (rest[p] + rest[q] - apart) // 2 >= need[some]
        at = at[ok[at]]
    return ok


def _filled(bins: list[bytes]) -> dict[str, np.ndarray]:
    fine = np.array([len(b) > 0 for b in bins], bool)
    raw = np.frombuffer(b"".join(b or bytes(BINS) for b in bins), np.uint8).reshape(-1, BINS).astype(np.int16)
    return {"fine": fine, "bins": raw, "coarse": np.add.reduceat(raw, np.arange(0, BINS, COARSE), axis=1)}


def _with_pivots(num: int, den: int):
    """Rows (node, size, pos, bins) and their shingle's pivot (node2, size2, pos2, bins2): the pairs that pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                n = b.num_rows
                x = {c: np.concatenate([b.column(c).to_numpy(), b.column(c + "2").to_numpy()]) for c in ("node", "size", "pos")}
                x |= _filled([*b.column("bins").to_pylist(), *b.column("bins2").to_pylist()])
                i = np.arange(n)
                at = i[_passing(x, i, i + n, num, den)]
                yield pa.RecordBatch.from_arrays([pa.array(x["node"][at]), pa.array(x["node"][at + n]), b.column("m").take(pa.array(at))], names=["node", "pivot", "m"])

    return run


def _one_partner(a: np.ndarray, b: np.ndarray, h: np.ndarray) -> list[np.ndarray]:
    """Of rows (a, b, h), that of the largest h for each a."""
    order = np.lexsort((b, h, a))
    a, b, h = a[order], b[order], h[order]
    last = np.ones(len(a), bool)
    last[:-1] = a[1:] != a[:-1]
    return [a[last], b[last], h[last]]


def _meet(num: int, den: int, turn: int | None = None):
    """Streams postings sorted by cell; in each cell, those that ask meet all members, and the pairs (a, b) that pass come out.

    With a turn, a row (node, other, h) comes out for each class of such pairs:
    the partner of which the pair's hash in this turn is largest, of the cells
    looked at together.
    """
    columns = ("node", "size", "pos", "component")

    def partners(a: np.ndarray, b: np.ndarray) -> list[np.ndarray]:
        x, y = a.view(np.uint64), b.view(np.uint64)
        h = S.mix(S.mix(np.minimum(x, y)) + np.maximum(x, y) + S.mix(np.array([turn], np.uint64))).view(np.int64)
        return _one_partner(np.concatenate([a, b]), np.concatenate([b, a]), np.concatenate([h, h]))

    def flush(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(rows)
        x = {c: t[c].to_numpy() for c in columns} | _filled(t["bins"].to_pylist())
        cell = np.column_stack([t[c].to_numpy() for c in ("shingle", "block", "query")])
        asks, member = t["asks"].to_numpy(), t["member"].to_numpy()
        new = np.ones(len(cell), bool)
        new[1:] = (cell[1:] != cell[:-1]).any(1)
        number = np.cumsum(new) - 1
        members, asking = np.flatnonzero(member), np.flatnonzero(asks)
        begin, end = (np.searchsorted(number[members], number[asking], side=s) for s in ("left", "right"))
        found, k = [np.zeros((0, 2 if turn is None else 3), np.int64)], 0
        upto = np.cumsum(end - begin)
        while k < len(asking):
            # as many askers as make a chunk of pairs; one asker at least
            last = max(int(np.searchsorted(upto, (upto[k - 1] if k else 0) + CHUNK, side="right")), k + 1)
            n = (end - begin)[k:last]
            i = np.repeat(asking[k:last], n)
            j = members[np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(begin[k:last], n)]
            # of two that both ask, one does
            other = (x["component"][i] != x["component"][j]) & (~t["outside"].to_numpy()[j] | (x["node"][i] < x["node"][j]))
            i, j = i[other], j[other]
            ok = _passing(x, i, j, num, den)
            a, b = x["node"][i[ok]], x["node"][j[ok]]
            found.append(np.unique(np.column_stack([np.minimum(a, b), np.maximum(a, b)]), axis=0) if turn is None else np.column_stack(partners(a, b)))
            k = last
        pairs = np.concatenate(found)
        if turn is not None:
            return pa.RecordBatch.from_arrays([pa.array(c) for c in _one_partner(*pairs.T)], names=["node", "other", "h"])
        pairs = np.unique(pairs, axis=0)
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[pa.RecordBatch] = []
        for b in batches:
            if not b.num_rows:
                continue
            rows.append(b)
            if sum(r.num_rows for r in rows) < 4 * BLOCK:
                continue
            # whole cells only: the last one may go on in the next batch
            t = pa.Table.from_batches(rows).combine_chunks().to_batches()[0]
            cell = np.column_stack([t.column(c).to_numpy() for c in ("shingle", "block", "query")])
            change = np.flatnonzero((cell[1:] != cell[:-1]).any(1))
            if len(change):
                yield flush([t.slice(0, change[-1] + 1)])
                rows = [t.slice(change[-1] + 1)]
            else:
                rows = [t]
        if rows:
            yield flush(rows)

    return run


def _verified(pairs: DataFrame, docs: DataFrame, leaders: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """The pairs (a, b), each of which comes once, that are alike enough on their whole sets."""
    schema = pa.schema([("doc_id", pa.int64()), ("node", pa.int64()), ("items", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in pieces(b, PIECE_BYTES):
                sets = shingle_sets(part.column("text").to_pylist(), n)
                made = [part.column("doc_id"), _nodes(sets), [s.view(np.int64) for s in sets]]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(made, schema, strict=True)], schema=schema)

    either = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    # 16 bytes a row; of more rows than that, the texts are shuffled
    wanted = small(either.join(leaders, "node"), 2_000_000)
    sets = docs.join(wanted.select("doc_id"), "doc_id", "left_semi").mapInArrow(frugal(run), "doc_id long, node long, items array<bigint>")
    sets = sets.join(wanted, ["node", "doc_id"], "left_semi").dropDuplicates(["node"]).select("node", "items")
    x = pairs.join(sets.select(F.col("node").alias("a"), F.col("items").alias("x")), "a").join(sets.select(F.col("node").alias("b"), F.col("items").alias("y")), "b")
    x = x.withColumn("n", F.size(F.array_intersect("x", "y")))
    return x.where(F.col("n") * den >= num * (F.size("x") + F.size("y") - F.col("n"))).select("a", "b")


def components(tables: Tables, links: DataFrame) -> DataFrame:
    """Rows (node, component) of the nodes of links (a, b): the least node that can be reached.

    In turns each node takes the least label of its neighbours, and the label of its label, until none changes.
    """
    both = tables.write(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    step = tables.write(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("a"), F.min("b")).alias("component")))
    while True:
        labels = step.select("node", "component")
        near = both.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("component").alias("near"))
        new = labels.join(near, F.col("node") == F.col("a")).select("node", F.col("component").alias("was"), F.least("component", "near").alias("component"))
        target = labels.select(F.col("node").alias("_node"), F.col("component").alias("_next"))
        new = new.join(target, F.col("component") == F.col("_node")).select("node", "was", F.least("component", "_next").alias("component"))
        new = tables.write(new)
        tables.drop(step)
        step = new
        if step.where("was <> component").isEmpty():
            tables.drop(both)
            return step.drop("was")


def _pivot_pairs(postings: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs (a, b) of a class and the pivot of one of its shingles, two a class at most: of the most frequent one, and of the rarest.

    A shingle's pivot is the class of which most is shared, as of what edited copies were made from.
    """
    leads = postings.where(F.col("nth") < LEADS)
    head = F.struct("n_shared", F.xxhash64("node").alias("h"), "node", "size", "pos", "bins")
    heads = leads.groupBy("shingle").agg(F.max(head).alias("p"), F.count("*").alias("m")).where("m > 1")
    heads = heads.select("shingle", "m", *[F.col(f"p.{c}").alias(f"{c}2") for c in ("node", "size", "pos", "bins")])
    rows = leads.join(heads, "shingle").where("node <> node2").select(*[c + x for x in ("", "2") for c in ("node", "size", "pos", "bins")], "m")
    near = rows.mapInArrow(frugal(_with_pivots(num, den)), "node long, pivot long, m long")
    best = near.groupBy("node").agg(F.max(F.struct("m", "pivot")).alias("x"), F.min(F.struct("m", "pivot")).alias("y"))
    pairs = best.select("node", F.explode(F.array_distinct(F.array("x.pivot", "y.pivot"))).alias("pivot"))
    return pairs.select(F.least("node", "pivot").alias("a"), F.greatest("node", "pivot").alias("b")).distinct()


def _cells(tables: Tables, postings: DataFrame, labels: DataFrame) -> DataFrame:
    """Postings sorted by cell, for _meet(): of shingles whose classes lie in different components.

    A shingle's classes outside its largest component ask, and meet all of its
    classes, in blocks by hash if there are many.
    """
    named = postings.select("shingle", "node", "size", "pos", "bins").join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    sizes = named.groupBy("shingle", "component").agg(F.count("*").alias("m"))
    group = sizes.groupBy("shingle").agg(F.max(F.struct("m", "component")).alias("x"), F.sum("m").alias("all"), F.count("*").alias("n")).where("n > 1")
    group = tables.write(group.select("shingle", F.col("x.component").alias("main"), F.ceil(F.col("all") / BLOCK).alias("blocks"), F.ceil((F.col("all") - F.col("x.m")) / BLOCK).alias("queries")))
    rows = named.join(group, "shingle").withColumn("outside", F.col("component") != F.col("main"))
    own, asked = F.pmod(F.xxhash64("node"), F.col("blocks")), F.pmod(F.xxhash64("node", F.lit(1)), F.col("queries"))
    as_member = F.transform(F.sequence(F.lit(0).cast("long"), F.col("queries") - 1), lambda q: F.struct(own.alias("block"), q.alias("query"), F.lit(True).alias("member"), ((q == asked) & F.col("outside")).alias("asks")))
    as_query = F.transform(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), lambda b: F.struct(b.alias("block"), asked.alias("query"), F.lit(False).alias("member"), F.lit(True).alias("asks")))
    others = F.when(F.col("outside") & (F.col("blocks") > 1), F.filter(as_query, lambda c: c["block"] != own)).otherwise(F.filter(as_member, lambda c: F.lit(False)))
    cells = rows.withColumn("cell", F.explode(F.concat(as_member, others)))
    cells = cells.select("shingle", "cell.*", "node", "size", "pos", "component", "outside", "bins")
    return cells.repartition("shingle", "block", "query").sortWithinPartitions("shingle", "block", "query")


def _merged(tables: Tables, labels: DataFrame, links: DataFrame) -> DataFrame:
    """labels (node, component) after links (a, b); a node without a label is a component of its own."""
    # what is linked already is one node by now
    of = labels.select(F.col("node").alias("n1"), F.col("component").alias("c1"))
    joined = links.join(of, F.col("a") == F.col("n1"), "left").withColumn("a", F.coalesce("c1", "a")).select("a", "b")
    joined = joined.join(of, F.col("b") == F.col("n1"), "left").withColumn("b", F.coalesce("c1", "b")).select("a", "b")
    above = components(tables, joined).select(F.col("node").alias("component"), F.col("component").alias("top"))
    known = labels.join(above, "component", "left").select("node", F.coalesce("top", "component").alias("component"))
    first = above.select(F.col("component").alias("node"), F.col("top").alias("component")).join(labels.select("node"), "node", "left_anti")
    return tables.write(known.unionByName(first))


def _linked(tables: Tables, postings: DataFrame, labels: DataFrame, tried: DataFrame, docs: DataFrame, leaders: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """labels (node, component) after all links between components; of the pairs tried, they have the links.  Drops postings."""
    for turn in itertools.count():
        near = _cells(tables, postings, labels).mapInArrow(frugal(_meet(num, den, turn)), "node long, other long, h long")
        picked = tables.write(near.groupBy("node").agg(F.max(F.struct("h", "other")).alias("p")).select("node", F.col("p.other").alias("other")))
        # components only grow: a class without a partner now never gets one
        left = small(picked.select("node"), 4_000_000)
        before, postings = postings, tables.write(postings.join(left, "node", "left_semi"))
        tables.drop(before)
        if not turn:
            # few texts take part; those are read again and again
            wanted = small(leaders.join(left, "node", "left_semi").select("doc_id"), 4_000_000)
            docs = tables.write(docs.join(wanted, "doc_id", "left_semi"))
        pairs = picked.select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")).distinct()
        pairs = tables.write(pairs.join(tried, ["a", "b"], "left_anti"))
        links = tables.write(_verified(pairs, docs, leaders, n, num, den))
        labels, tried = _merged(tables, labels, links), tried.unionByName(pairs)
        if links.count() * WORTH <= pairs.count():
            break
    rest = _cells(tables, postings, labels).mapInArrow(frugal(_meet(num, den)), "a long, b long").distinct()
    rest = tables.write(rest.join(tried, ["a", "b"], "left_anti"))
    return _merged(tables, labels, tables.write(_verified(rest, docs, leaders, n, num, den)))


def similar(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """Rows (doc_id, n_shingles, component_id) for rows (doc_id, text), doc_id long; other columns are dropped.

    Sets are of shingles of n words [^\\x20\\x09-\\x0D]+ of the whole text, of
    any length, A-Z lower-cased; fewer words are one shingle.  Two documents
    link if den * intersection >= num * union.  component_id is the smallest
    doc_id that links reach, itself included.

    Null or empty text: no set, a component of its own.  Repeated rows: equal
    sets, so one class.  Rows that share a doc_id but not the text are one
    document, linked by either text.  Null doc_id: links with nothing,
    component_id null.  Empty input: empty output.
    """
    docs, spark = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), docs.sparkSession
    with Tables(spark) as tables:
        read = tables.write(_read(docs, n))
        rows = read.where("k is null").select("doc_id", "node", "n_shingles")
        counts = add_up(read.where("k is not null").select("k", "part"), COUNTERS)
        scale = spark.sparkContext.broadcast(np.minimum(np.log2(counts + 1.0) * 6, 255).astype(np.uint8))
        some = rows.where("n_shingles > 0 and doc_id is not null")
        leaders = tables.write(some.groupBy("node").agg(F.min("doc_id").alias("doc_id")))
        total = docs.select(F.sum(F.octet_length("text"))).first()[0] or 0
        n_batches = int(total // max(BATCH_BYTES, 8 * math.isqrt(total))) + 1
        buckets = n_batches // PER_BUCKET + 1
        prefixes = _prefixes(docs, n, num, den, scale).join(leaders, ["node", "doc_id"], "left_semi")
        by_batch = prefixes.select("node", "size", "bins", "prefix", F.pmod(F.xxhash64("node"), F.lit(n_batches)).alias("batch")).groupBy("batch")
        bits = meeting.answers(by_batch.applyInArrow(frugal(_ask(buckets)), meeting.KEYS))
        postings = tables.write(by_batch.cogroup(bits.groupBy("batch")).applyInArrow(frugal(_post(buckets)), _POSTINGS))
        twice = some.groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("z")).where("a <> z")
        same = some.join(twice, "doc_id").where("node <> a").select("a", F.col("node").alias("b")).distinct()
        tried = tables.write(_pivot_pairs(postings, num, den))
        links = tables.write(_verified(tried, docs, leaders, n, num, den).unionByName(same))
        labels = components(tables, links)
        labels = _linked(tables, postings, labels, tried, docs, leaders, n, num, den)
        named = leaders.join(labels, "node", "left").select("node", "doc_id", F.coalesce("component", "node").alias("component"))
        least = named.groupBy("component").agg(F.min("doc_id").alias("component_id"))
        named = named.join(least, "component").select("node", "component_id")
        own = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
        result = rows.join(named, "node", "left").select("doc_id", "n_shingles", own.alias("component_id"))
        return Tables(spark).write(result, keep=True)


def report(docs: DataFrame) -> DataFrame:
    """Three-word shingles, similarity of 0.9."""
    return similar(docs, 3, 90, 100)


def one_of_each(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """docs with one row of each component, that of the smallest doc_id; of rows that repeat that doc_id, the one of the least hash of all values.

    Rows whose doc_id is null all stay.  All of docs' columns; see similar().
    """
    found = similar(docs, n, num, den)
    gone = found.where("component_id < doc_id").select("doc_id").distinct()
    # 8 bytes a row; beyond so many, the texts are shuffled
    kept = docs.join(small(gone, 4_000_000), "doc_id", "left_anti").select(*docs.columns)
    again = found.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("_n")).where("_n > 1").select("doc_id")
    if again.isEmpty():
        return kept
    again = small(again, 4_000_000)
    row = F.struct(*[F.col(c) for c in docs.columns])
    repeated = kept.join(again, "doc_id", "left_semi").groupBy("doc_id").agg(F.min_by(row, F.xxhash64(row)).alias("_row")).select("_row.*")
    return kept.join(again, "doc_id", "left_anti").select(*docs.columns).unionByName(repeated)
