"""Array kernels over Arrow string columns.

Texts of one Arrow batch are handled as flat byte arrays, in pieces of some
hundred kilobytes, so that a Python worker's memory does not follow the batch.
Everything here is a pure function of its input.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
PIECE_BYTES = 1 << 18
BASE = 0x9E3779B97F4A7C15 | 1
_INV = pow(BASE, -1, 1 << 64)

#: Bytes that end a word: space and 0x09 to 0x0D.
SPACE = np.zeros(256, bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True
#: A-Z to a-z; other bytes stay.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_powers: list[np.ndarray] = [np.ones(1, U64), np.ones(1, U64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of BASE and of its inverse modulo 2**64."""
    if len(_powers[0]) < n:
        size = max(n, 1 << 16)
        for k, base in enumerate((BASE, _INV)):
            p = np.full(size, base, U64)
            p[0] = 1
            _powers[k] = np.multiply.accumulate(p)
    return _powers[0][:n], _powers[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words whose output bits all depend on all input bits."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def strings(column: pa.Array | pa.ChunkedArray) -> pa.LargeStringArray:
    """The column as one large_string array, null as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    return pc.fill_null(column.cast(pa.large_string()), "")


def flat(texts: pa.LargeStringArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts, and the len + 1 offsets into them."""
    _, offsets, data = texts.buffers()
    off = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    buf = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return buf[off[0] : off[-1]], off - off[0]


def pieces(texts: pa.LargeStringArray, limit: int = PIECE_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of consecutive rows of at most `limit` bytes, or of one longer row."""
    buf, off = flat(texts)
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(off, off[at] + limit, "right")) - 1)
        yield at, buf[off[at] : off[to]], off[at : to + 1] - off[at]
        at = to


class Words:
    """The words of some texts.

    start, end: byte positions in `buf`, in which each text is followed by one space;
    doc: the text of each word; first: index of each text's first word (len + 1 entries).
    gaps says which bytes are in no word; the space must be.
    """

    def __init__(self, buf: np.ndarray, off: np.ndarray, lower: bool = True, gaps: Callable[[np.ndarray], np.ndarray] = SPACE.__getitem__):
        n = len(off) - 1
        self.buf = np.full(len(buf) + n, 32, np.uint8)
        self.base = off[:-1] + np.arange(n)
        keep = np.ones(len(self.buf), bool)
        keep[off[1:] + np.arange(n)] = False
        self.buf[keep] = LOWER[buf] if lower else buf
        self.gap = gap = gaps(self.buf)
        edge = np.flatnonzero(np.diff(gap, prepend=True, append=True)) if len(gap) else np.zeros(0, np.int64)
        self.start, self.end = edge[0::2], edge[1::2]
        ends = np.append(self.base[1:], len(self.buf))
        self.first = np.concatenate([[0], np.searchsorted(self.start, ends)]) if n else np.zeros(1, np.int64)
        self.doc = np.repeat(np.arange(n), np.diff(self.first))

    def strings(self) -> pa.LargeStringArray:
        """The words as one Arrow array."""
        off = np.append(0, np.cumsum(self.end - self.start)).astype(np.int64)
        return pa.LargeStringArray.from_buffers(len(self.start), pa.py_buffer(off), pa.py_buffer(self.buf[~self.gap]))

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word: a polynomial over its bytes, mixed."""
        p, q = powers(len(self.buf) + 1)
        total = np.zeros(len(self.buf) + 1, U64)
        np.cumsum((self.buf.astype(U64) + U64(1)) * p[:-1], out=total[1:])
        return mix((total[self.end] - total[self.start]) * q[self.start])


def ngrams(h: np.ndarray, n: int, seed: int = 0) -> np.ndarray:
    """Hashes of the n-grams that begin at each of the first len - n + 1 items."""
    m = len(h) - n + 1
    if m <= 0:
        return np.zeros(0, U64)
    p, _ = powers(n + 1)
    total = h[:m] + U64(seed)
    for k in range(1, n):
        total += h[k : k + m] * p[k]
    return mix(total)


def shingles(words: Words, n: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(hash, doc) of each n-word shingle, repeats included; a shorter text is one shingle."""
    h = words.hashes()
    count = np.diff(words.first)
    g = ngrams(h, n, 7)
    inside = words.doc[: len(g)] == words.doc[n - 1 :] if len(g) else np.zeros(0, bool)
    g, d = g[inside], words.doc[: len(inside)][inside]
    short = np.flatnonzero((count > 0) & (count < n))
    if len(short):
        extra = np.zeros(len(short), U64)
        for k in range(n - 1):
            has = count[short] > k
            i = words.first[short[has]] + k
            extra[has] = mix(extra[has] + h[i] + U64(count.max() * 0 + 11))
        g, d = np.concatenate([g, mix(extra ^ U64(0x5BD1E995))]), np.concatenate([d, short])
    return g, d


def by_text(g: np.ndarray, d: np.ndarray) -> np.ndarray:
    """The order by (d, g) of hashes g of texts d; equal pairs in any order."""
    first = np.argsort(g)
    d = d[first]
    return first[np.argsort(d.astype(np.uint16) if not len(d) or d.max() < 1 << 16 else d, kind="stable")]


def sets(g: np.ndarray, d: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes of each of n texts, ascending, and the n + 1 offsets into them."""
    order = by_text(g, d)
    g, d = g[order], d[order]
    new = np.ones(len(g), bool)
    new[1:] = (g[1:] != g[:-1]) | (d[1:] != d[:-1])
    g, d = g[new], d[new]
    return g, np.searchsorted(d, np.arange(n + 1))
