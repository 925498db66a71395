"""Words and rolling hashes of whole Arrow batches, in NumPy.

A batch's texts are worked on as one UTF-8 buffer in runs of some megabytes, so
that no Python object is made for each word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text worked on at once; a longer text is worked on alone.
RUN_BYTES = 1 << 20

_BYTE = np.arange(256)
#: Words between ASCII white space: space and 0x09 to 0x0D.
SPACED = ~((_BYTE == 0x20) | ((_BYTE >= 0x09) & (_BYTE <= 0x0D)))
#: Words of ASCII letters, digits and everything outside ASCII.
ALNUM = ((_BYTE >= 0x30) & (_BYTE <= 0x39)) | ((_BYTE >= 0x41) & (_BYTE <= 0x5A)) | ((_BYTE >= 0x61) & (_BYTE <= 0x7A)) | (_BYTE >= 0x80)
#: A-Z to a-z; other bytes unchanged.
LOWER = np.where((_BYTE >= 0x41) & (_BYTE <= 0x5A), _BYTE + 32, _BYTE).astype(np.uint8)
LOWER_BYTES = LOWER.tobytes()
#: As LOWER, with everything that is no ALNUM byte made a space.
ALNUM_LOWER_BYTES = np.where(ALNUM, LOWER, 0x20).astype(np.uint8).tobytes()

#: Polynomials are taken modulo this prime, so that no choice of words makes sums cancel as they do modulo 2 ** 64.
PRIME = (1 << 61) - 1
# The points at which the polynomials are taken. Two of them give two independent hashes.
_POINTS = (0x14C5A9B7D3E8F261, 0x0B7E151628AED2A7)
_P, _S61, _S32, _S29 = np.uint64(PRIME), np.uint64(61), np.uint64(32), np.uint64(29)
_M32, _M29 = np.uint64((1 << 32) - 1), np.uint64((1 << 29) - 1)
_powers: dict[tuple[int, bool], np.ndarray] = {}
_TABLE_STEP = 1 << 18


def _fold(x: np.ndarray) -> np.ndarray:
    """Below 2 ** 61, equal modulo the prime but for the prime itself, which stands for zero."""
    x = (x & _P) + (x >> _S61)
    return np.where(x >= _P, x - _P, x)


def _times_2_32(x: np.ndarray) -> np.ndarray:
    return (x >> _S29) + ((x & _M29) << _S32)


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a * b modulo the prime, of values below it, by halves of 32 bits."""
    a_high, a_low, b_high, b_low = a >> _S32, a & _M32, b >> _S32, b & _M32
    low = a_low * b_low
    return _fold((low & _P) + (low >> _S61) + _times_2_32(a_high * b_low + a_low * b_high) + (a_high * b_high << np.uint64(3)))


def _power_table(n: int, point: int, inverse: bool) -> np.ndarray:
    """The first n powers of a point, or of its inverse."""
    key = (point, inverse)
    if key not in _powers or len(_powers[key]) < n:
        base = pow(_POINTS[point], -1, PRIME) if inverse else _POINTS[point]
        out, size = np.ones(1, dtype=np.uint64), -(-n // _TABLE_STEP) * _TABLE_STEP
        while len(out) < size:
            out = np.concatenate([out, _product(out[: size - len(out)], np.uint64(pow(base, len(out), PRIME)))])
        _powers[key] = out
    return _powers[key]


def scramble(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x.copy()
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class Sums:
    """Prefix sums of a polynomial over ``values``, for the hashes of any of their segments."""

    #: Bytes of a segment up to which sums of unreduced products stay below 2 ** 64.
    _SHORT = 1 << 22

    def __init__(self, values: np.ndarray, point: int = 0, short: bool = False):
        n = len(values)
        self.point, powers = point, _power_table(n + 1, point, False)[:n]
        self.low, self.high = np.zeros(n + 1, dtype=np.uint64), np.zeros(n + 1, dtype=np.uint64)
        if values.dtype == np.uint8:
            by = values.astype(np.uint64) + np.uint64(1)
            low, high = by * (powers & _M32), by * (powers >> _S32)
            if not short:
                whole = low + _times_2_32(high)
                low, high = whole & _M32, whole >> _S32
        else:
            whole = _product(_fold(values), powers)
            low, high = whole & _M32, whole >> _S32
        np.cumsum(low, out=self.low[1:])
        np.cumsum(high, out=self.high[1:])

    def hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        high = _fold(self.high[ends] - self.high[starts])
        whole = _fold(_fold(self.low[ends] - self.low[starts]) + _times_2_32(high))
        return scramble(_product(whole, _power_table(len(self.low), self.point, True)[starts]))

    def windows(self, length: int) -> np.ndarray:
        """The hash of each run of ``length`` values (empty if there are fewer)."""
        n = len(self.low) - length
        if n <= 0:
            return np.empty(0, dtype=np.uint64)
        at = np.arange(n)
        return self.hashes(at, at + length)


def segment_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, point: int = 0) -> np.ndarray:
    """The hash of values[start:end] for each segment; ``point`` 0 and 1 give independent ones."""
    short = not len(starts) or int((ends - starts).max()) <= Sums._SHORT
    return Sums(values, point, short).hashes(starts, ends)


class Run:
    """Words of some consecutive texts. ``first[i]:first[i + 1]`` are those of text i."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray, fold: np.ndarray | None = None):
        self.raw = data
        self.data = fold[data] if fold is not None else data
        self.offsets = offsets
        word = is_word[data]
        before = np.empty(len(data) + 1, dtype=bool)
        before[0], before[1:] = False, word
        after = np.empty(len(data) + 1, dtype=bool)
        after[-1], after[:-1] = False, word
        cuts = offsets[(offsets > 0) & (offsets < len(data))]
        before, after = before[:-1], after[1:]
        before[cuts] = False
        after[cuts - 1] = False
        self.starts = np.flatnonzero(word & ~before)
        self.ends = np.flatnonzero(word & ~after) + 1
        self.first = np.searchsorted(self.starts, offsets)

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def text_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.offsets) - 1), self.counts())

    def word_hashes(self, point: int = 0) -> np.ndarray:
        return segment_hashes(self.data, self.starts, self.ends, point)

    def room(self) -> np.ndarray:
        """For each word, how many words its text still has, itself included."""
        counts = self.counts()
        return np.repeat(self.first[1:], counts) - np.arange(len(self.starts))


def windows(hashes: np.ndarray, length: int, point: int = 0) -> np.ndarray:
    """The hash of each run of ``length`` values (empty if there are fewer)."""
    return Sums(hashes, point).windows(length)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the offsets of its texts; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64, count=column.offset + len(column) + 1)[column.offset :]
    body = column.buffers()[2]
    data = np.frombuffer(body, dtype=np.uint8) if body is not None else np.empty(0, dtype=np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def runs(column: pa.Array, is_word: np.ndarray, fold: np.ndarray | None = None, limit: int = RUN_BYTES) -> Iterator[tuple[int, int, Run]]:
    """(first text, end, run) over the whole column."""
    data, offsets = utf8(column)
    at, n = 0, len(offsets) - 1
    while at < n:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1)
        yield at, end, Run(data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at], is_word, fold)
        at = end
