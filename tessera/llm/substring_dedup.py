"""Substring dedup of word sequences: suffix automata of reference shards, and the matching statistics of documents against them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .repeats import Kind, remove_repeats

#: Symbols of reference strings in one automaton, about; a few hundred bytes of memory each.
SHARD_SYMBOLS = 100_000


class SuffixAutomaton:
    """Suffix automaton of several sequences, each of a document with a number.

    least[v] is, after settle(), the smallest number of a document in which the
    sequences of state v stand.
    """

    def __init__(self) -> None:
        self.step: list[dict[int, int]] = [{}]
        self.link, self.length, self.least = [-1], [0], [1 << 63]

    def _state(self, step: dict[int, int], link: int, length: int) -> int:
        self.step.append(step)
        self.link.append(link)
        self.length.append(length)
        self.least.append(1 << 63)
        return len(self.link) - 1

    def _split(self, p: int, q: int, symbol: int) -> int:
        """A state of its own for the sequences of q that are p's and one symbol more."""
        new = self._state(self.step[q].copy(), self.link[q], self.length[p] + 1)
        self.link[q] = new
        step, link = self.step, self.link
        while p >= 0 and step[p].get(symbol) == q:
            step[p][symbol] = new
            p = link[p]
        return new

    def add(self, sequence: list[int], document: int) -> None:
        """Adds a reference string; the states of its prefixes get its document, if that is smaller than theirs."""
        step, link, length, least = self.step, self.link, self.length, self.least
        last = 0
        for symbol in sequence:
            q = step[last].get(symbol)
            if q is not None:
                last = q if length[q] == length[last] + 1 else self._split(last, q, symbol)
            else:
                p, new = last, self._state({}, 0, length[last] + 1)
                while p >= 0 and symbol not in step[p]:
                    step[p][symbol] = new
                    p = link[p]
                if p >= 0:
                    q = step[p][symbol]
                    link[new] = q if length[q] == length[p] + 1 else self._split(p, q, symbol)
                last = new
            if document < least[last]:
                least[last] = document

    def settle(self) -> None:
        """Hands each state's least document on to its suffixes, longest first."""
        link, least = self.link, self.least
        for v in np.argsort(np.array(self.length), kind="stable")[:0:-1].tolist():
            if least[v] < least[link[v]]:
                least[link[v]] = least[v]

    def statistics(self, sequence: list[int]) -> Iterator[tuple[int, int]]:
        """Streams a sequence past the reference: for each of its places, the state and the length of the longest suffix that the reference has."""
        step, link, length = self.step, self.link, self.length
        v, n = 0, 0
        for symbol in sequence:
            while v and symbol not in step[v]:
                v = link[v]
                n = length[v]
            if symbol in step[v]:
                v, n = step[v][symbol], n + 1
            yield v, n

    def repeated(self, sequence: list[int], document: int, window: int) -> list[int]:
        """Where windows of the sequence start that the reference has in a document with a smaller number."""
        link, length, least, out = self.link, self.length, self.least, []
        for at, (v, n) in enumerate(self.statistics(sequence)):
            if n >= window:
                # the state of the last `window` symbols alone
                while length[link[v]] >= window:
                    v = link[v]
                if least[v] < document:
                    out.append(at - window + 1)
        return out


def shared_windows(strings: list[np.ndarray], documents: np.ndarray, window: int) -> list[np.ndarray]:
    """For each string, where its windows start that also stand in a string of a smaller document."""
    _, symbols = np.unique(np.concatenate(strings), return_inverse=True)
    ends = np.cumsum([len(s) for s in strings]).tolist()
    parts = [symbols[e - len(s) : e].tolist() for s, e in zip(strings, ends, strict=True)]
    automaton = SuffixAutomaton()
    for p, d in zip(parts, documents.tolist(), strict=True):
        automaton.add(p, d)
    automaton.settle()
    return [np.array(automaton.repeated(p, d, window), np.int64) for p, d in zip(parts, documents.tolist(), strict=True)]


def dedup_words(docs: DataFrame, window: int = 50, gram: int = 10, with_text: bool = False) -> DataFrame:
    """Removes words in windows of `window` words that also start in a document with a smaller doc_id; see remove_repeats()."""
    return remove_repeats(docs, Kind("words", window, gram), shared_windows, SHARD_SYMBOLS, with_text)


def report(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, n_words, n_removed, kept_sha256)."""
    x = dedup_words(docs.select("doc_id", "text"))
    return x.select(F.col("row.doc_id").alias("doc_id"), F.col("n_symbols").alias("n_words"), "n_removed", "kept_sha256")
