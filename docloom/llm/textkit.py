"""Vectorised text kernels over Arrow string buffers.

All functions see the UTF-8 bytes of many documents at once as one numpy
array plus document offsets, so a pass costs some nanoseconds a byte and no
Python object is made per word.  Documents are taken in slices of about
``SLICE`` bytes to bound a worker's memory; a longer document is a slice of
its own and is never cut.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE = 1 << 20
_R = 0x9E3779B97F4A7C15 | 1
_R_INVERSE = pow(_R, -1, 1 << 64)
_rng = np.random.default_rng(20240229)
#: A random value for each byte, for polynomial hashing modulo 2**64.
BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

WORD = np.zeros(256, bool)
WORD[[*range(48, 58), *range(65, 91), *range(97, 123)]] = True
WORD[128:] = True
UPPER = np.zeros(256, bool)
UPPER[65:91] = True
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser: spreads every input bit over the 64 output bits."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


@lru_cache(1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for r in (_R, _R_INVERSE):
        p = np.full(n, r, np.uint64)
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << max(21, int(n).bit_length())
    up, down = _powers(size)
    return up[:n], down[:n]


def slices(texts: pa.Array | pa.ChunkedArray, lower: bool = False) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets into bytes) for runs of documents.

    Nulls count as empty texts.
    """
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.chunk(0)
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    n = len(texts)
    if not n:
        return
    off = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1]
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + SLICE, "right")) - 1)
        part = texts.slice(lo, hi - lo)
        if lower:
            part = pc.utf8_lower(part)
        o = np.frombuffer(part.buffers()[1], np.int64)[part.offset : part.offset + len(part) + 1]
        data = part.buffers()[2]
        b = np.frombuffer(data, np.uint8)[o[0] : o[-1]] if data is not None and o[-1] > o[0] else np.zeros(0, np.uint8)
        yield lo, hi, b, o - o[0]
        lo = hi


def word_mask(b: np.ndarray) -> np.ndarray:
    """True on the bytes of letters and digits; U+0080-00BF and U+2000-206F separate."""
    m = WORD[b]
    i = np.flatnonzero(b == 0xC2)
    m[i] = False
    m[np.minimum(i + 1, len(m) - 1)] = False
    i = np.flatnonzero(b == 0xE2)
    i = i[b[np.minimum(i + 1, len(b) - 1)] // 2 == 0x40]
    for k in range(3):
        m[np.minimum(i + k, len(m) - 1)] = False
    return m


def runs(m: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of True that don't cross documents: starts, ends, document of each."""
    if not len(m):
        z = np.zeros(0, np.int64)
        return z, z, z
    cut = np.zeros(len(m) + 1, bool)
    cut[off] = True
    before = np.empty(len(m), bool)
    before[0] = False
    before[1:] = m[:-1]
    start = np.flatnonzero(m & (~before | cut[:-1]))
    after = np.empty(len(m), bool)
    after[-1] = False
    after[:-1] = m[1:]
    end = np.flatnonzero(m & (~after | cut[1:])) + 1
    doc = np.searchsorted(off, start, "right") - 1
    return start, end, doc


#: Bytes whose prefix sums are held at a time; a word may reach as much beyond.
STRETCH = 1 << 20


class Hasher:
    """Hashes of any substrings of ``b``, asked for in the order of their starts.

    Bytes are summed up a stretch at a time, so a text of any length costs the
    memory of one stretch, and a substring longer than that is put together
    from parts.  A hash depends on the substring's bytes alone.
    """

    def __init__(self, b: np.ndarray, table: np.ndarray = BYTE) -> None:
        self.b, self.table = b, table
        self.held = self._sums(0, len(b)) if len(b) <= 2 * STRETCH else None

    def _sums(self, a: int, z: int) -> tuple[np.ndarray, np.ndarray]:
        up, down = powers(z - a + 1)
        out = np.zeros(z - a + 1, np.uint64)
        np.cumsum(self.table[self.b[a:z]] * up[: z - a], out=out[1:])
        return out, down

    def _long(self, a: int, z: int) -> int:
        total = 0
        for i in range(a, z, STRETCH):
            part = int(self._sums(i, min(i + STRETCH, z))[0][-1])
            total += part * pow(_R, i - a, 1 << 64)
        return total % (1 << 64)

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        size = (end - start).astype(np.uint64)
        if self.held is not None:
            sums, down = self.held
            return mix((sums[end] - sums[start]) * down[start] + size)
        out = np.empty(len(start), np.uint64)
        cuts = np.searchsorted(start, np.arange(0, len(self.b) + STRETCH, STRETCH))
        for k, (i, j) in enumerate(zip(cuts[:-1], cuts[1:])):
            if i == j:
                continue
            at = k * STRETCH
            fits = end[i:j] - at <= 2 * STRETCH
            sums, down = self._sums(at, int(end[i:j][fits].max(initial=at)))
            s, e = start[i:j][fits] - at, end[i:j][fits] - at
            own = np.empty(j - i, np.uint64)
            own[fits] = (sums[e] - sums[s]) * down[s]
            for n in np.flatnonzero(~fits):
                own[n] = self._long(int(start[i + n]), int(end[i + n]))
            out[i:j] = own
        return mix(out + size)


def hash_words(words: list[str]) -> np.ndarray:
    """What ``Hasher.of`` gives for each of these words."""
    out = []
    for w in words:
        b = np.frombuffer(w.encode(), np.uint8)
        out.append(Hasher(b).of(np.array([0]), np.array([len(b)]))[0])
    return np.array(out, np.uint64)


def count_by_doc(doc: np.ndarray, n: int, weight: np.ndarray | None = None) -> np.ndarray:
    return np.bincount(doc, weight, n)[:n].astype(float)


def sum_mask(mask: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Number of True bytes in each document."""
    out = np.zeros(len(off) - 1)
    full = off[1:] > off[:-1]
    if full.any():
        out[full] = np.add.reduceat(mask, off[:-1][full], dtype=np.int64)
    return out


def running(mask: np.ndarray) -> np.ndarray:
    """How many bytes before each place are True."""
    out = np.zeros(len(mask) + 1, np.int32)
    np.cumsum(mask, out=out[1:])
    return out
