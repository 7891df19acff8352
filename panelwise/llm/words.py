"""Words and word windows of whole Arrow text columns as numpy arrays of 64-bit hashes.

A text column arrives as one UTF-8 buffer with offsets. A 256-entry table maps each byte to the
byte that counts (lower case, say) or to 0 for a separator, and polynomial prefix sums modulo 2**64
give the hash of every word without a Python object for it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that are worked on at once; a longer text is worked on alone, as a whole.
SLICE_BYTES = 1 << 20

_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_P = np.uint64(0x9E3779B97F4A7C15)
_P_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_Q = np.uint64(0xD1342543DE82EF95)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finish that spreads the high bits of ``h`` over all bits."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    return h


_powers = {"p": np.ones(1, np.uint64), "i": np.ones(1, np.uint64)}


def _power(kind: str, base: np.uint64, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1); kept for as long as it is small."""
    if len(_powers[kind]) < n:
        full = np.full(max(n, SLICE_BYTES + 1), base, np.uint64)
        full[0] = 1
        made = np.cumprod(full)
        if n > 4 * SLICE_BYTES:
            return made[:n]
        _powers[kind] = made
    return _powers[kind][:n]


def buffer_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (one more than rows) of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    body = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return body[at[0] : at[-1]], at - at[0]


def slices(offsets: np.ndarray, size: int = SLICE_BYTES, rows: int = 4096) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``size`` bytes and ``rows`` rows at most; each holds one row at least and no row is divided."""
    low, n = 0, len(offsets) - 1
    while low < n:
        high = int(np.searchsorted(offsets, offsets[low] + size, side="right")) - 1
        high = min(n, low + rows, max(high, low + 1))
        yield low, high
        low = high


def byte_table(separators: bytes, lower: bool = True) -> np.ndarray:
    """The table for ``words``: 0 for a separator, otherwise the byte, A-Z lower-cased on demand.

    A NUL byte that is no separator becomes 255, which is no byte of UTF-8.
    """
    table = np.arange(256, dtype=np.uint8)
    table[0] = 255
    if lower:
        table[65:91] += 32
    table[np.frombuffer(separators, np.uint8)] = 0
    return table


#: Words as runs of anything but white space (fixed set: space, \t \n \v \f \r), A-Z lower-cased.
SPACED = byte_table(b" \t\n\x0b\x0c\r")
#: Words as runs of letters a-z, digits and non-ASCII characters, A-Z lower-cased.
LETTERED = byte_table(bytes([*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]))


def words(body: np.ndarray, offsets: np.ndarray, table: np.ndarray, stem: int = 0):
    """Hash, start and end byte of every word, and the first word of each row (one more than rows).

    With ``stem``, also the hash of each word's first ``stem`` bytes, mixed so that it differs from
    the hash of a whole word of these bytes.
    """
    n = len(body)
    if n == 0:
        none, hashes = np.zeros(0, np.int64), np.zeros(0, np.uint64)
        return (hashes, none, none, np.zeros(len(offsets), np.int64)) + ((hashes,) if stem else ())
    mapped = table[body]
    inside = mapped != 0
    before = np.empty(n, bool)
    before[0], before[1:] = False, inside[:-1]
    rows = offsets[:-1][offsets[:-1] < n]
    before[rows] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.empty(n, bool)
    after[-1], after[:-1] = False, inside[1:]
    after[rows[rows > 0] - 1] = False
    ends = np.flatnonzero(inside & ~after) + 1
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[mapped] * _power("p", _P, n), out=sums[1:])
    back = _power("i", _P_INVERSE, n)[starts]
    hashes = mix((sums[ends] - sums[starts]) * back)
    found = hashes, starts, ends, np.searchsorted(starts, offsets)
    if stem:
        found += (mix((sums[np.minimum(starts + stem, ends)] - sums[starts]) * back ^ np.uint64(0xA0761D6478BD642F)),)
    return found


def windows(hashes: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the windows of ``width`` words inside a row, and each row's number of them."""
    counts = np.maximum(np.diff(first) - width + 1, 0)
    if len(hashes) < width:
        return np.zeros(0, np.uint64), counts
    rolled = hashes[: len(hashes) - width + 1].copy()
    for k in range(1, width):
        rolled *= _Q
        rolled += hashes[k : len(hashes) - width + 1 + k]
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    return mix(rolled[row[: len(rolled)] == row[width - 1 :]]), counts
