"""Vectorised hashing over the UTF-8 bytes of an Arrow text column."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
_rng = np.random.default_rng(20240917)
#: One random word for each byte; FOLDED gives A-Z the words of a-z.
TABLE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * U64(2) + U64(1)
FOLDED = TABLE.copy()
FOLDED[65:91] = TABLE[97:123]
BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
SPACE = np.zeros(256, bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_powers: dict[tuple[int, bool], np.ndarray] = {}


def powers(base: int, n: int, inverse: bool = False) -> np.ndarray:
    have = _powers.get((base, inverse))
    if have is None or len(have) < n:
        step = pow(BASES[base], -1, 2**64) if inverse else BASES[base]
        have = np.full(max(n, 1 << 16) + 1, step, np.uint64)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        _powers[base, inverse] = have
    return have


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> U64(33))
    x *= U64(0xFF51AFD7ED558CCD)
    x ^= x >> U64(33)
    x *= U64(0xC4CEB9FE1A85EC53)
    x ^= x >> U64(33)
    return x


def sums(values: np.ndarray, base: int = 0) -> np.ndarray:
    """Sums of value * base**position, so that the hash of any span takes one subtraction."""
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers(base, len(values))[: len(values)], out=out[1:])
    return out


def prefix(buf: np.ndarray, table: np.ndarray = TABLE, base: int = 0) -> np.ndarray:
    """sums() of the bytes' random words."""
    return sums(table[buf], base)


def span_hash(p: np.ndarray, i: np.ndarray, j: np.ndarray, base: int = 0, salt: np.ndarray | int = 0) -> np.ndarray:
    """Hash of the bytes i..j (exclusive), whatever their place; salt and length go in as well."""
    x = (p[j] - p[i]) * powers(base, len(p), inverse=True)[i]
    x += (np.asarray(j - i).astype(np.uint64) * U64(0x2545F4914F6CDD1D)) + np.asarray(salt).astype(np.uint64) * U64(0x9FB21C651E98DF25)
    return mix(x)


def slices(column: pa.Array, limit: int = 1 << 19) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets) of runs of rows with about `limit` bytes; null is empty.

    A longer text stands alone, whole.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offs, data = column.buffers()
    offsets = np.frombuffer(offs, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    if column.null_count:  # a null slot may still cover bytes
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
        yield from slices(column, limit)
        return
    at = 0
    while at < len(column):
        end = int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1
        end = min(max(end, at + 1), len(column))
        yield at, end, raw[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]
        at = end


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Least of x[i : i + width] for each full window."""
    n = len(x)
    if n < width:
        return x[:0]
    pad = np.concatenate([x, np.full(-n % width, np.iinfo(np.uint64).max, np.uint64)]).reshape(-1, width)
    left = np.minimum.accumulate(pad, axis=1).ravel()
    right = np.minimum.accumulate(pad[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[: n - width + 1], left[width - 1 : n])


def words(buf: np.ndarray, offsets: np.ndarray, inner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row) of the maximal runs of bytes with inner[byte], none across rows."""
    if not len(buf):
        z = np.zeros(0, np.int64)
        return z, z, z
    ok = inner[buf]
    first = ok.copy()
    first[1:] &= ~ok[:-1]
    last = ok.copy()
    last[:-1] &= ~ok[1:]
    edge = offsets[1:-1]
    edge = edge[(edge > 0) & (edge < len(buf))]
    first[edge] = ok[edge]
    last[edge - 1] = ok[edge - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return start, end, np.searchsorted(offsets, start, side="right") - 1
