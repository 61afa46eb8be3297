"""Windows of a fixed number of units (bytes or words), in runs that share an anchor.

Every window contains a number of k-unit grams; the one with the smallest hash is its anchor (of those that
agree in its upper half, the first). The anchor depends on the window's content alone, so equal windows have equal
anchors, wherever they are, and in however long a slice.
Neighbouring windows mostly share theirs: a run of them is one row (anchor, content, where it starts,
how many), a few dozen times fewer rows than windows. All rows that can share a window have the same
anchor and meet in one shuffle by it.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa

#: Fixed odd factors of the hashes.
FACTOR = np.uint64(0x9E3779B97F4A7C15)
MIX = np.uint64(0xBF58476D1CE4E5B9)
#: The bits that hold a gram's place among the units of a slice.
PLACES = np.uint64((1 << 32) - 1)


def mixed(x: np.ndarray) -> np.ndarray:
    """64 bits to 64 bits, one to one."""
    x = x ^ (x >> np.uint64(32))
    x *= MIX
    x ^= x >> np.uint64(29)
    x *= FACTOR
    x ^= x >> np.uint64(32)
    return x


def folded(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Two hashes as one. Not linear: no choice of words cancels out, as it does in polynomials modulo 2**64."""
    y = a * FACTOR
    y += b
    y ^= y >> np.uint64(29)
    return y


class Spans:
    """Hashes of spans of a sequence of 64-bit numbers, the same wherever a span stands.

    A span of 2**k numbers folds its halves; another length folds the longest such spans at its begin
    and end, and its length. Levels up to `whole` are kept for all places, longer ones are worked out
    where asked. The first level's numbers may stand for `width` units each, from each place on.
    """

    def __init__(self, numbers: np.ndarray, whole: int, width: int = 1):
        self.width, self.levels = width, {width: numbers}
        while width < whole:
            level = self.levels[width]
            self.levels[2 * width] = folded(level[:-width], level[width:]) if len(level) > width else level[:0]
            width *= 2

    def power(self, start: np.ndarray, size: int) -> np.ndarray:
        if size in self.levels:
            return self.levels[size][start]
        return folded(self.power(start, size // 2), self.power(start + size // 2, size // 2))

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of the units from each start to its end, `width` at least."""
        length = end - start
        out = np.empty(len(length), np.uint64)
        size = np.frexp(length / self.width)[1] - 1
        for k in np.unique(size):
            at = np.flatnonzero(size == k)
            p = self.width << int(k)
            out[at] = mixed(folded(self.power(start[at], p), self.power(end[at] - p, p)) + length[at].astype(np.uint64) * MIX)
        return out

    def grams(self, k: int, units: int) -> np.ndarray:
        """Hashes of the k units from each place on, of `units` in all; k - 1 places fewer."""
        n = max(0, units - k + 1)
        size = self.width
        while 2 * size <= k:
            size *= 2
        level = self.levels[size]
        return mixed(folded(level[:n], level[k - size :][:n]) + np.uint64(k * int(MIX) % (1 << 64)))


def packed(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as one number; after the end come bytes 0."""
    x = np.zeros(len(data) + 7, np.uint64)
    x[: len(data)] = data
    for k in (1, 2, 4):
        x[:-k] |= x[k:] << np.uint64(8 * k)
    return x[: len(data)]


def byte_spans(data: np.ndarray) -> Spans:
    """Of spans of eight bytes or more."""
    return Spans(mixed(packed(data)), 16, 8)


def word_hashes(data: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """A hash of each word, from its bytes: up to 16 of them as numbers, a digest of longer ones."""
    if not len(first):
        return np.zeros(0, np.uint64)
    eight, length = packed(data), last - first
    bits = np.uint64(8) * np.minimum(length, 8).astype(np.uint64)
    out = mixed((eight[first] & (~np.uint64(0) >> (np.uint64(64) - bits))) + length.astype(np.uint64) * MIX)
    longer = np.flatnonzero(length > 8)
    out[longer] = mixed(folded(out[longer], mixed(eight[last[longer] - 8])))
    raw = None
    for k in np.flatnonzero(length > 16).tolist():
        raw = data.tobytes() if raw is None else raw
        out[k] = digest(raw[first[k] : last[k]])
    return out


def digest(raw: bytes) -> np.uint64:
    return np.uint64(int.from_bytes(hashlib.blake2b(raw, digest_size=8).digest(), "little"))


def sliding_least(x: np.ndarray, w: int) -> np.ndarray:
    """The least of each w neighbours."""
    size, out = 1, x
    while 2 * size <= w:
        out = np.minimum(out[:-size], out[size:])
        size *= 2
    return np.minimum(out[: len(x) - w + 1], out[w - size :][: len(x) - w + 1]) if w > size else out


def runs(spans: Spans, units: int, ends: np.ndarray, window: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchor, content, first window's start and number of windows of each run; ends: where each document ends in the units."""
    none = np.zeros(0, np.uint64)
    if units < window:
        return none, none, none.astype(np.int64), none.astype(np.int64)
    hashes = spans.grams(k, units)
    # Grams are in the order of the upper half of their hashes, then of their places: that of two grams of a window doesn't depend on what lies around it, nor on how much does.
    place = np.arange(len(hashes), dtype=np.uint64)
    least = sliding_least((hashes & ~PLACES) | place, window - k + 1)
    at = (least & PLACES).astype(np.int64)
    # Windows that end in their own document.
    good = np.ones(len(at), bool)
    cut = ends[:-1][:, None] - np.arange(1, window)[None, :]
    cut = cut[(cut >= 0) & (cut < len(at))]
    good[cut] = False
    first = good.copy()
    first[1:] &= (at[1:] != at[:-1]) | ~good[:-1]
    last = good.copy()
    last[:-1] &= (at[1:] != at[:-1]) | ~good[1:]
    start, end = np.flatnonzero(first), np.flatnonzero(last)
    return hashes[at[start]], spans.of(start, end + window), start, end - start + 1


#: Bytes that part words: white space as ASCII has it.
SPACES = np.zeros(256, bool)
SPACES[[32, 9, 10, 11, 12, 13]] = True


def word_numbers(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A hash of each word of concatenated texts; where words start and end in the bytes; and where texts end in the words."""
    inside = ~SPACES[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[ends[:-1]] = True
    start = inside.copy()
    start[1:] &= ~inside[:-1] | edge[1:-1]
    stop = inside.copy()
    stop[:-1] &= ~inside[1:] | edge[1:-1]
    first, last = np.flatnonzero(start), np.flatnonzero(stop) + 1
    return word_hashes(data, first, last), first, last, np.searchsorted(first, ends, side="left")


def signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))
