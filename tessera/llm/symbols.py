"""Symbol arrays for whole batches of texts, in numpy.

A batch of texts becomes one flat array of 64-bit symbols (hashed words, or
bytes) with the number of symbols of each text.  Everything below works on the
flat array at once, so no Python loop runs over words or bytes.
"""

from __future__ import annotations

import numpy as np

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser, so that sums and powers of it spread well."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(31)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xA0761D6478BD642F)
    x ^= x >> np.uint64(32)
    return x


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x2545F4914F6CDD1D))
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))


_KEPT: dict[int, np.ndarray] = {}


def powers(n: int, base: np.uint64 = _BASE) -> np.ndarray:
    """base ** 0 .. base ** (n - 1), modulo 2 ** 64; kept for the next call up to a few million."""
    have = _KEPT.get(int(base))
    if have is None or len(have) < n:
        out = np.full(max(n, 1 << 16), base, np.uint64)
        out[0] = 1
        have = np.multiply.accumulate(out)
        if n <= 1 << 22:
            _KEPT[int(base)] = have
    return have[:n]


def sums(values: np.ndarray) -> np.ndarray:
    """Sums of all that comes before each place and the end, of which any span's hash is made."""
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers(len(values)), out=total[1:])
    return total


def spans_hash(values: np.ndarray, start: np.ndarray, end: np.ndarray, total: np.ndarray | None = None) -> np.ndarray:
    """A hash of each values[start:end], equal for equal content at any place; total: sums(values), if it is known."""
    total = sums(values) if total is None else total
    inverse = powers(len(total), _INVERSE)
    return mix((total[end] - total[start]) * inverse[start] + mix((end - start).astype(np.uint64)))


def grams(symbols: np.ndarray, k: int, total: np.ndarray | None = None) -> np.ndarray:
    """Hash of symbols[i:i + k] for each i that has them; documents are not told apart here."""
    n = len(symbols) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = sums(symbols) if total is None else total
    out = total[k:] - total[:n]
    out *= powers(n, _INVERSE)
    return mix(out)


def flat(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts in a row, and the length of each in bytes; None is empty."""
    parts = [b"" if t is None else t.encode("utf-8", "surrogatepass") for t in texts]
    return np.frombuffer(b"".join(parts), np.uint8), np.fromiter(map(len, parts), np.int64, len(parts))


def lower_ascii(data: np.ndarray) -> np.ndarray:
    upper = (data >= 65) & (data <= 90)
    return data + (upper * np.uint8(32)).astype(np.uint8)


def words(data: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words [^\\x20\\x09-\\x0D]+ of each text: their hash, start, end in data, and their number for each text."""
    none = np.zeros(0, np.int64)
    if not len(data):
        return none.astype(np.uint64), none, none, np.zeros(len(lengths), np.int64)
    solid = ~((data == 32) | ((data >= 9) & (data <= 13)))
    first, bounds = np.zeros(len(data), bool), np.cumsum(lengths)
    first[(bounds - lengths)[lengths > 0]] = True
    before = np.empty(len(data), bool)
    before[0], before[1:] = False, solid[:-1]
    start = np.flatnonzero(solid & (~before | first))
    after = np.empty(len(data), bool)
    after[-1], after[:-1] = True, ~solid[1:] | first[1:]
    end = np.flatnonzero(solid & after) + 1
    count = np.diff(np.searchsorted(start, np.concatenate([[0], bounds])))
    return spans_hash(_BYTE[data], start, end), start, end, count


def byte_symbols(data: np.ndarray) -> np.ndarray:
    return _BYTE[data]


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """min(values[i:i + width]) for each i, by doubling."""
    out, have = values.copy(), 1
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[: len(out) - step], out[step:])
        have += step
    return out


def runs(symbols: np.ndarray, counts: np.ndarray, window: int, gram: int, total: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """Runs of windows that have one minimizer.

    Each window of `window` symbols inside a text has a minimizer, the least
    hash of its grams of `gram` symbols.  Windows with equal content have equal
    minimizers, wherever they stand, so they meet when they are dealt out by it.
    Returns (anchor hash, text number, first window, last window, place of the
    minimizer) for each run of neighbouring windows with the same minimizer;
    windows are numbered by their first symbol in the flat array.
    """
    none = np.zeros(0, np.int64)
    ends = np.cumsum(counts)
    if len(symbols) < window:
        return none.astype(np.uint64), none, none, none, none
    key = grams(symbols, gram, total)
    # the low bits tell neighbouring places apart, so that a run has one place
    key &= ~np.uint64(127)
    key |= np.arange(len(key), dtype=np.uint64) & np.uint64(127)
    least = sliding_min(key, window - gram + 1)
    # a run ends where the minimizer changes, and with its text; what lies between texts is none
    long = counts >= window
    new = np.ones(len(least) + 1, bool)
    np.not_equal(least[1:], least[:-1], out=new[1:-1])
    new[(ends - counts)[long]] = True
    new[(ends - window + 1)[long]] = True
    at = np.flatnonzero(new)
    first, last = at[:-1], at[1:] - 1
    text = np.searchsorted(ends, first, side="right")
    inside = first <= (ends - window)[text]
    first, last, text = first[inside], last[inside], text[inside]
    anchor = least[first]
    # the place is one of those that all windows of the run have, and its low bits are known
    place = last + (((anchor & np.uint64(127)).astype(np.int64) - last) & 127)
    return anchor & ~np.uint64(127), text, first, last, place
