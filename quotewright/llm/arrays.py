"""Text as NumPy arrays: code points of whole batches and hashes of their slices, without loops over texts."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes of all values joined, byte offsets of the values from 0, which values are not null). A null has length 0."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    n = len(column)
    _, at, data = column.buffers()
    if n == 0 or at is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64), np.zeros(n, bool)
    offsets = np.frombuffer(at, np.int64, n + 1, column.offset * 8)
    valid = column.is_valid().to_numpy(zero_copy_only=False)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    lengths = np.diff(offsets)
    if (~valid & (lengths > 0)).any():  # bytes behind a null
        return utf8(pa.array(column.to_pylist(), pa.large_string()).fill_null("")) [:2] + (valid,)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0], valid


def code_points(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of UTF-8 bytes, and the values' offsets counted in code points."""
    points = np.frombuffer(data.tobytes().decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), np.uint32)
    if len(points) == len(data):
        return points, offsets
    before = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
    return points, before[offsets]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: equal in, equal out; else as good as random."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


#: Bases of the polynomials, a family of hashes each.
_BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(max(n, 1), base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def slice_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, family: int = 0) -> np.ndarray:
    """64-bit hash of values[start:end] for every slice; equal slices have equal hashes wherever they stand. Hashes of two
    families together are one of 128 bits.

    Karp-Rabin over running sums: the slice's polynomial is the difference of two sums, moved to position 0 by a
    power of the base's inverse modulo 2**64. Values go through `mix` first, so runs of small numbers do no harm.
    """
    if not len(starts):
        return np.zeros(0, np.uint64)
    base, back = np.uint64(_BASES[family]), np.uint64(pow(_BASES[family], -1, 1 << 64))
    mixed = mix(values + np.uint64(1 + (family << 40)))
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mixed * _powers(base, len(values)), dtype=np.uint64)))
    return mix((sums[ends] - sums[starts]) * _powers(back, len(values) + 1)[starts] + (ends - starts).astype(np.uint64))


def run_ids(lengths: np.ndarray) -> np.ndarray:
    """[0]*lengths[0] + [1]*lengths[1] + ..."""
    return np.repeat(np.arange(len(lengths)), lengths)


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """start, start+1, ... for each start, one after another."""
    if not len(lengths):
        return np.zeros(0, np.int64)
    first = np.cumsum(lengths) - lengths
    return np.arange(int(lengths.sum())) - np.repeat(first - starts, lengths)
