"""Word sequences of a column as hashes, and windows over them, for whole Arrow batches at once."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from quotewright.llm.arrays import code_points, mix, run_ids, slice_hashes, utf8


def word_hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hash of each word, offsets of the texts in them). Words stand between U+0020; nulls have none."""
    data, offsets, _ = utf8(column)
    return words_of_points(*code_points(data, offsets))


def word_pairs(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """word_hashes with a second hash of each word: (hashes, second hashes, offsets)."""
    data, offsets, _ = utf8(column)
    points, at = code_points(data, offsets)
    starts, ends = word_slices(points, at)
    wide = points.astype(np.uint64)
    return slice_hashes(wide, starts, ends), slice_hashes(wide, starts, ends, 1), np.searchsorted(starts, at)


def word_slices(points: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the words of texts begin and end in their code points."""
    inside = points != 0x20
    first = np.zeros(len(points) + 1, bool)
    first[at] = True
    before = np.concatenate(([False], inside[:-1])) if len(points) else inside
    after = np.concatenate((inside[1:], [False])) if len(points) else inside
    return np.flatnonzero(inside & (~before | first[:-1])), np.flatnonzero(inside & (~after | first[1:])) + 1


def words_of_points(points: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """word_hashes for code points and the offsets of the texts in them."""
    starts, ends = word_slices(points, at)
    return slice_hashes(points.astype(np.uint64), starts, ends), np.searchsorted(starts, at)


def windows(words: np.ndarray, at: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, text, position) of every run of `size` words that lies within one text."""
    if len(words) < size:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    text = run_ids(np.diff(at))
    start = np.flatnonzero(text[: len(words) - size + 1] == text[size - 1 :])
    return slice_hashes(words, start, start + size), text[start], start - at[text[start]]


def chained(words: np.ndarray, start: np.ndarray, size: int) -> np.ndarray:
    """Another hash of the runs of `size` words that begin at `start`: of second hashes, word after word."""
    out = np.full(len(start), 0x5851F42D4C957F2D, np.uint64)
    for k in range(size):
        out = mix(out ^ words[start + k])
    return out


def sequence_keys(words: np.ndarray, second: np.ndarray, at: np.ndarray) -> pa.Array:
    """16 bytes for each text's whole word sequence, of both hashes of its words."""
    both = np.stack((slice_hashes(words, at[:-1], at[1:]), slice_hashes(second, at[:-1], at[1:], 1)), 1)
    return pa.Array.from_buffers(pa.binary(16), len(at) - 1, [None, pa.py_buffer(np.ascontiguousarray(both).tobytes())]).cast(pa.binary())
