"""Numpy text kernels over whole Arrow batches: words, prefix hashes, window hashes, minima.

Hashes are 64-bit prefix polynomials modulo 2**64 over random byte codes, finished with an
avalanche step.  All positions of a slice of documents are hashed in a few vector passes, which is
what lets the Python stages keep up with the scan.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
#: Bytes of text worked on at once; bounds a worker's memory whatever the batch size is.
SLICE_BYTES = 1 << 19
SEPARATOR = np.zeros(256, bool)
SEPARATOR[[9, 10, 11, 12, 13, 32]] = True

#: Bytes of words that ``short_hashes`` takes by eight at a time.
LONG_WORD = 64
#: Masks of the first 0 to 8 bytes of a little-endian number.
_HEADS = np.array([(1 << 8 * i) - 1 for i in range(9)], U)
_BASES = {0: 0x9E3779B97F4A7C15 | 1, 1: 0xD1B54A32D192ED03 | 1, 2: 0xABC98388FB8FAC03 | 1, 3: 0x8CB92BA72F3D8DD7 | 1}
_powers: dict[tuple[int, int], np.ndarray] = {}
_codes: dict[int, np.ndarray] = {}
_trim: list = []


def _keep_arrays() -> None:
    """Let freed arrays stay in the process until ``trim`` gives them back: each would be mapped and cleared anew."""
    try:
        mallopt = ctypes.CDLL(None).mallopt
        mallopt(-3, 32 << 20)  # M_MMAP_THRESHOLD
        mallopt(-1, 64 << 20)  # M_TRIM_THRESHOLD
    except (OSError, AttributeError):  # another C library
        pass


_keep_arrays()


def mix(x: np.ndarray) -> np.ndarray:
    """Avalanche of uint64 values."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def powers(seed: int, n: int, inverse: bool = False) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, or of its inverse."""
    key = (seed, inverse)
    have = _powers.get(key)
    if have is None or len(have) < n:
        base = _BASES[seed]
        if inverse:
            base = pow(base, -1, 1 << 64)
        size = max(n, SLICE_BYTES + 1)
        out = np.full(size, U(base))
        out[0] = U(1)
        _powers[key] = have = np.multiply.accumulate(out)
    return have[:n]


def byte_codes(seed: int) -> np.ndarray:
    if seed not in _codes:
        _codes[seed] = mix(np.arange(1, 257, dtype=U) * U(0x9E3779B97F4A7C15) + U(seed * 7919 + 13))
    return _codes[seed]


class Prefix:
    """Prefix polynomial of a sequence of uint64 codes; ``spans`` hashes any of its spans."""

    def __init__(self, codes: np.ndarray, seed: int):
        self.seed = seed
        self.sums = np.zeros(len(codes) + 1, U)
        np.cumsum(codes * powers(seed, len(codes)), out=self.sums[1:])

    def spans(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        shift = powers(self.seed, len(self.sums), inverse=True)
        return mix((self.sums[end] - self.sums[start]) * shift[start])


def trim() -> None:
    """Give freed memory back to the system: a worker stays for later stages and would keep its largest."""
    pa.default_memory_pool().release_unused()
    if not _trim:
        try:
            _trim.append(ctypes.CDLL(None).malloc_trim)
        except (OSError, AttributeError):  # another C library
            _trim.append(lambda pad: 0)
    _trim[0](0)


def slices(text: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes of text, or of one row that is longer; trims memory at the end."""
    offsets = np.frombuffer(text.buffers()[1], np.int32 if pa.types.is_string(text.type) or pa.types.is_binary(text.type) else np.int64)
    offsets = offsets[text.offset : text.offset + len(text) + 1].astype(np.int64)
    at = 0
    while at < len(text):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        yield at, min(to, len(text))
        at = to
    trim()


def utf8(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets (from 0) of a string array without nulls."""
    kind = np.int32 if pa.types.is_string(text.type) or pa.types.is_binary(text.type) else np.int64
    offsets = np.frombuffer(text.buffers()[1], kind)[text.offset : text.offset + len(text) + 1].astype(np.int64)
    data = text.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs free of ASCII white space, and each row's first word."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64)
    free = ~SEPARATOR[data]
    begins = free.copy()
    begins[1:] &= ~free[:-1]
    ends = free.copy()
    ends[:-1] &= ~free[1:]
    edge = offsets[(offsets > 0) & (offsets < len(data))]
    begins[edge] = free[edge]
    ends[edge - 1] = free[edge - 1]
    start = np.flatnonzero(begins)
    return start, np.flatnonzero(ends) + 1, np.searchsorted(start, offsets)


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 0) -> np.ndarray:
    return Prefix(byte_codes(seed)[data], seed).spans(start, end)


def short_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of spans of bytes that are mostly short, by eight bytes at a time; other ones than ``word_hashes``."""
    size = end - start
    eight = np.ndarray(len(data), "<u8", np.r_[data, np.zeros(8, np.uint8)], strides=(1,)) if len(data) else np.zeros(0, U)
    out = mix((eight[start] & _HEADS[np.minimum(size, 8)]) ^ size.astype(U) * U(_BASES[2]))
    on = np.flatnonzero((size > 8) & (size <= LONG_WORD))
    for at in range(8, LONG_WORD, 8):
        if not len(on):
            break
        out[on] = mix(out[on] * U(_BASES[3]) + (eight[start[on] + at] & _HEADS[np.minimum(size[on] - at, 8)]))
        on = on[size[on] > at + 8]
    if len(size) and size.max() > LONG_WORD:
        on = np.flatnonzero(size > LONG_WORD)
        out[on] = word_hashes(data, start[on], end[on])
    return out


def ascii_lower(data: np.ndarray) -> np.ndarray:
    """A-Z lower-cased; all other bytes stay."""
    return np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` consecutive values, in log2(width) passes."""
    if len(x) < width:
        return x[:0]
    span = 1
    while span * 2 <= width:
        x = np.minimum(x[: len(x) - span], x[span:])
        span *= 2
    rest = width - span
    return np.minimum(x[: len(x) - rest], x[rest:]) if rest else x


def row_of(first: np.ndarray, index: np.ndarray) -> np.ndarray:
    """The row in which each item lies, where ``first`` has each row's first item and the total."""
    return np.searchsorted(first, index, "right") - 1


def signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)
