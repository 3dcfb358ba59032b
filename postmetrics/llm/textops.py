"""Vectorised byte-level text helpers used inside Arrow tasks.

Texts stay in their Arrow buffer: a batch is one ``uint8`` array plus the start and end of each
row.  Words, spans and their 64-bit hashes come from array arithmetic over that buffer, with no
Python loop per word.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: ASCII white space that separates words.
SPACES = np.zeros(256, dtype=bool)
SPACES[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: A-Z to a-z, every other byte unchanged.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Spans are hashed by two polynomials modulo this prime; a modulus of 2**64 would let some long texts
#: that swap two letters (Thue-Morse order) collide whatever the base.
_PRIME = (1 << 31) - 1
_BASES = (0x3C6EF372 % _PRIME, 0x1F83D9AB % _PRIME)
_powers: dict[int, np.ndarray] = {}


def mix(x) -> np.ndarray:
    """Finaliser with full avalanche (64 bit)."""
    x = np.asarray(x, dtype=U64).copy()
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


_BYTE_VALUE = np.stack([(mix(np.arange(1, 257, dtype=U64) * U64(k)) >> U64(34)) + U64(1)
                        for k in (0xD1B54A32D192ED03, 0x8CB92BA72F3D8DD7)])


def _reduce(x: np.ndarray) -> np.ndarray:
    """``x`` (below 2**62 or so) modulo the prime, in place."""
    for _ in range(2):
        high = x >> U64(31)
        x &= U64(_PRIME)
        x += high
    x -= U64(_PRIME) * (x >= U64(_PRIME))
    return x


def _power_table(base: int, n: int) -> np.ndarray:
    """The first ``n`` powers of ``base`` modulo the prime, built by doubling."""
    table = _powers.get(base)
    if table is None or len(table) < n:
        table = np.ones(1, U64) if table is None else table
        while len(table) < max(n, 1 << 16):
            table = np.concatenate((table, _reduce(table * U64(pow(base, len(table), _PRIME)))))
        _powers[base] = table
    return table[:n]


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, starts, ends) of a string column; a null counts as an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(0, np.int64), np.zeros(0, np.int64)
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[column.offset:column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0]:at[-1]], at[:-1] - at[0], at[1:] - at[0]


def row_slices(starts: np.ndarray, ends: np.ndarray, most: int):
    """Consecutive row ranges of at most ``most`` bytes; one longer row is a range by itself."""
    lo, n = 0, len(starts)
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(ends, starts[lo] + most, side="right")))
        yield lo, hi
        lo = hi


def row_of(starts: np.ndarray, positions: np.ndarray) -> np.ndarray:
    """Row that holds each byte position (rows are adjacent, empty rows hold none)."""
    return np.searchsorted(starts, positions, side="right") - 1


def prefix_sums(buf: np.ndarray) -> np.ndarray:
    """Sums (one row per polynomial) from which ``span_hash`` takes any span's hash; below 8 GB a buffer."""
    sums = np.zeros((len(_BASES), len(buf) + 1), U64)
    for k, base in enumerate(_BASES):
        np.cumsum(_reduce(_BYTE_VALUE[k][buf] * _power_table(base, len(buf))), out=sums[k, 1:])
    return sums


def _polynomial(sums: np.ndarray, k: int, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Polynomial ``k`` of the bytes [start, end), as if they stood at 0."""
    inverse = pow(_BASES[k], -1, _PRIME)
    return _reduce(_reduce(sums[k][end] - sums[k][start]) * _power_table(inverse, sums.shape[1])[start])


def span_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of the bytes [start, end); equal bytes give equal hashes wherever they stand."""
    both = (_polynomial(sums, 0, start, end) << U64(31)) | _polynomial(sums, 1, start, end)
    return mix(both + mix((end - start).astype(U64)))


def span_rank(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A cheaper number that equal spans of one length share, to order them by; different spans may tie."""
    return mix(_polynomial(sums, 0, start, end))


def word_spans(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row) of every maximal run of non-space bytes; no word crosses rows."""
    if not len(buf):
        none = np.zeros(0, np.int64)
        return none, none, none
    solid = ~SPACES[buf]
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    edge = starts[(starts < len(buf)) & (starts < ends)]
    first[edge] = solid[edge]
    last = solid.copy()
    last[:-1] &= ~solid[1:]
    edge = ends[starts < ends] - 1
    last[edge] = solid[edge]
    s, e = np.flatnonzero(first), np.flatnonzero(last) + 1
    return s, e, row_of(starts, s)


def sorted_distinct(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values in order and their counts (plain sort: faster than hashing on 64-bit keys)."""
    if not len(x):
        return x, np.zeros(0, np.int64)
    x = np.sort(x)
    at = np.flatnonzero(np.concatenate(([True], x[1:] != x[:-1])))
    return x[at], np.diff(np.append(at, len(x)))


def grouping_order(keys: np.ndarray) -> np.ndarray:
    """An order that puts equal 64-bit keys side by side.

    Position and the upper bits of the key are packed into one integer and sorted, which is several
    times faster than an argsort; if two keys differ only in the lower bits, argsort decides.
    """
    bits = max(1, int(len(keys) - 1).bit_length())
    low = U64((1 << bits) - 1)
    packed = np.sort((keys & ~low) | np.arange(len(keys), dtype=U64))
    order = (packed & low).astype(np.int64)
    high = packed >> U64(bits)
    near = keys[order]
    if np.any((high[1:] == high[:-1]) & (near[1:] != near[:-1])):
        return np.argsort(keys, kind="stable")
    return order
