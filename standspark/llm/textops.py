"""Vectorised text primitives shared by the training-data operators.

Everything here works on one Arrow batch of whole texts at a time, so memory is bounded by the
batch and never by the table.  Words are ``[^\\x20\\x09-\\x0D]+`` over UTF-8 bytes with A-Z
lower-cased; the separators are ASCII, so byte positions split exactly where code points would.
"""

from __future__ import annotations

import numpy as np

_U = np.uint64
#: Table that maps bytes to lower case (A-Z only).
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: True for the word separators: space and 0x09-0x0D.
SPACE = np.zeros(256, dtype=bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
_BYTE_SEED = np.random.Generator(np.random.PCG64(20240611)).integers(1, 2**63, 256, dtype=np.uint64)
_BASE = _U(0x9E3779B97F4A7C15)  # odd, so it has an inverse modulo 2**64
_BASE_INV = _U(pow(0x9E3779B97F4A7C15, -1, 2**64))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x.copy()
    x ^= x >> _U(33)
    x *= _U(0xFF51AFD7ED558CCD)
    x ^= x >> _U(33)
    x *= _U(0xC4CEB9FE1A85EC53)
    x ^= x >> _U(33)
    return x


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, by doubling."""
    out = np.ones(max(n, 1), dtype=np.uint64)
    have, top = 1, base
    while have < n:
        take = min(have, n - have)
        out[have : have + take] = out[:take] * top
        have += take
        top = _U(int(top) * int(top) % 2**64)
    return out[:n]


class Words:
    """Words of a batch of texts.

    ``buf`` holds the lower-cased bytes of all texts, one separator after each; ``start``/``end``
    are byte positions of the words, ``doc`` is the row of each word and ``first`` the index of a
    row's first word (``first[n_rows]`` is the number of words).  ``key`` is a 64-bit hash.
    """

    def __init__(self, texts: list[bytes]):
        buf = np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8)
        self.buf = LOWER[buf]
        lengths = np.fromiter((len(t) + 1 for t in texts), dtype=np.int64, count=len(texts))
        self.row_at = np.concatenate([[0], np.cumsum(lengths)])
        space = SPACE[self.buf]
        edge = np.flatnonzero(space[1:] != space[:-1]) + 1
        if not space[0]:
            edge = np.concatenate([[0], edge])
        self.start, self.end = edge[0::2], edge[1::2]
        self.first = np.searchsorted(self.start, self.row_at)
        self.n_rows = len(texts)
        self._key = None

    @property
    def count(self) -> np.ndarray:
        """Number of words of each row."""
        return np.diff(self.first)

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(self.n_rows), self.count)

    @property
    def key(self) -> np.ndarray:
        if self._key is None:
            self._key = span_hash(self.buf, self.start, self.end)
        return self._key

    def text(self, i: int) -> bytes:
        return self.buf[self.start[i] : self.end[i]].tobytes()


#: Bytes that span_hash treats at once, so that its temporary arrays stay in the processor's cache.
_CHUNK = 1 << 17
_POWERS: dict[str, np.ndarray] = {}


def _cached_powers(name: str, base: np.uint64, n: int) -> np.ndarray:
    if len(_POWERS.get(name, ())) < n:
        _POWERS[name] = powers(base, max(n, 2 * _CHUNK))
    return _POWERS[name]


def span_hash(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of buf[start:end], equal for equal bytes wherever they stand.

    Spans are in order, not empty and don't overlap.  A polynomial prefix hash modulo 2**64 gives
    every span by two look-ups and one multiplication with a power of the inverse base.
    """
    out = np.empty(len(start), dtype=np.uint64)
    i = 0
    while i < len(start):
        base = start[i]
        j = max(i + 1, int(np.searchsorted(end, base + _CHUNK, side="right")))
        n = int(end[j - 1] - base)
        acc = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(_BYTE_SEED[buf[base : base + n]] * _cached_powers("up", _BASE, n)[:n], out=acc[1:])
        s, e = start[i:j] - base, end[i:j] - base
        out[i:j] = mix((acc[e] - acc[s]) * _cached_powers("down", _BASE_INV, n)[s] + (e - s).astype(np.uint64))
        i = j
    return out


def shingles(words: Words, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(key, row) of every run of ``size`` words; a row with fewer words gives its whole sequence.

    Rows without words give nothing.  Keys are 64-bit hashes of the word keys in order.
    """
    key, count, first = words.key, words.count, words.first
    mult = powers(_U(0xD6E8FEB86659FD93), size + 1)[1:]
    n = len(key)
    total = np.zeros(n, dtype=np.uint64)
    for j in range(size):
        total[: max(n - j, 0)] += mix(key[j:] * mult[j])
    runs = np.maximum(count - size + 1, 0)
    rows = np.repeat(np.arange(words.n_rows), runs)
    at = np.arange(len(rows)) - np.repeat(np.cumsum(runs) - runs, runs) + np.repeat(first[:-1], runs)
    keys = mix(total[at] + _U(size))
    short = np.flatnonzero((count > 0) & (count < size))
    if len(short):
        extra = np.zeros(len(short), dtype=np.uint64)
        for j in range(size - 1):
            has = count[short] > j
            extra[has] += mix(key[first[short][has] + j] * mult[j])
        keys = np.concatenate([keys, mix(extra + count[short].astype(np.uint64))])
        rows = np.concatenate([rows, short])
    return keys, rows


def distinct_by_row(keys: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, key) pairs, ordered by row and then key."""
    order = np.lexsort((keys, rows))
    keys, rows = keys[order], rows[order]
    keep = np.ones(len(keys), dtype=bool)
    keep[1:] = (keys[1:] != keys[:-1]) | (rows[1:] != rows[:-1])
    return keys[keep], rows[keep]


def row_sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of values[first[i]:first[i + 1]]; 0 for an empty row."""
    shape = (len(first) - 1, *values.shape[1:])
    out = np.zeros(shape, dtype=np.float64)
    full = np.flatnonzero(first[1:] > first[:-1])
    if len(full):
        out[full] = np.add.reduceat(values, first[:-1][full], axis=0, dtype=np.float64)
    return out


def as_signed(keys: np.ndarray) -> np.ndarray:
    return keys.view(np.int64)


def unique_words(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """(index of one word of each kind, kind of each word)."""
    _, at, kind = np.unique(words.key, return_index=True, return_inverse=True)
    return at, kind


class Grams:
    """Byte n-grams of chosen words, each padded on both sides; n is 7 at most, so a gram fits an integer.

    ``left`` zero bytes stand before a word and ``right`` bytes of value 1 after it.
    """

    def __init__(self, words: Words, at: np.ndarray, left: int, right: int):
        start, end = words.start[at], words.end[at]
        size = end - start + left + right
        self.first = np.concatenate([[0], np.cumsum(size)])
        total = int(self.first[-1])
        self.place = np.arange(total) - np.repeat(self.first[:-1], size)  # within the padded word
        length = np.repeat(end - start, size)
        inside = (self.place >= left) & (self.place < left + length)
        self.byte = np.where(self.place < left, 0, 1).astype(np.uint64)
        source = np.repeat(start, size) + self.place - left
        self.byte[inside] = words.buf[source[inside]]

    def ending_here(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(gram of n bytes that ends at each place, whether the word reaches so far back)."""
        gram = self.byte.copy()
        for j in range(1, n):
            gram[j:] |= self.byte[:-j] << np.uint64(8 * j)
        return gram, self.place >= n - 1


def find(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Index of each wanted value in sorted keys; -1 where it isn't there."""
    if not len(keys):
        return np.full(len(wanted), -1)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, at, -1)
