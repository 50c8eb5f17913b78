"""Plain versions of the operators, for small tables."""

from __future__ import annotations

import hashlib
from collections import defaultdict


def repeats(rows: list[tuple[int, str | None]], kind: str, window: int) -> dict[int, tuple[int, int, int, str]]:
    """doc_id -> (symbols, removed, spans, digest) by looking at every window."""
    parts = {d: list((t or "").encode().split()) if kind == "words" else [bytes([b]) for b in (t or "").encode()] for d, t in rows}
    least: dict[tuple, int] = {}
    for d, p in sorted(parts.items()):
        for i in range(len(p) - window + 1):
            least.setdefault(tuple(p[i : i + window]), d)
    out = {}
    for d, p in parts.items():
        gone = [False] * len(p)
        for i in range(len(p) - window + 1):
            if least[tuple(p[i : i + window])] < d:
                gone[i : i + window] = [True] * window
        kept = (b" " if kind == "words" else b"").join(x for x, g in zip(p, gone, strict=True) if not g)
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out[d] = (len(p), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


def components(sets: dict[int, frozenset], num: int, den: int) -> dict[int, int]:
    """doc_id -> least doc_id reachable by links: den * intersection >= num * union, for sets that aren't empty."""
    up = {d: d for d in sets}

    def root(d: int) -> int:
        while up[d] != d:
            d = up[d]
        return d

    having = defaultdict(list)
    for d, s in sets.items():
        for x in s:
            having[x].append(d)
    seen = set()
    for ds in having.values():
        for i, a in enumerate(ds):
            for b in ds[:i]:
                if (a, b) not in seen:
                    seen.add((a, b))
                    s, t = sets[a], sets[b]
                    if den * len(s & t) >= num * len(s | t):
                        x, y = sorted((root(a), root(b)))
                        up[y] = x
    return {d: root(d) for d in sets}


def shingles(rows: list[tuple[int, str | None]], n: int) -> dict[int, frozenset]:
    out = {}
    for d, t in rows:
        w = (t or "").encode().lower().split()
        out[d] = frozenset(tuple(w[i : i + n]) for i in range(max(len(w) - n + 1, 1))) if w else frozenset()
    return out
