"""A Bloom filter of bounded size over pairs of 64-bit hashes, merged by executors before the driver reads it."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bits of the filter per key, positions per key, and the most bits that one filter may have (16 MB).
BITS_PER_KEY, POSITIONS, MAX_BITS = 10, 6, 1 << 27


def filter_words(hashes: DataFrame, count: int) -> np.ndarray:
    """The filter over `count` rows (h1, h2) as 64-bit words. The driver receives MAX_BITS / 64 words at most; with more
    than MAX_BITS / BITS_PER_KEY keys the filter lets more pass, and callers must have an exact way behind it."""
    bits = 1 << 10
    while bits < min(MAX_BITS, count * BITS_PER_KEY):
        bits *= 2
    at = F.explode(F.array(*[F.expr(f"((h1 & {bits - 1}) + {i} * ((h2 & {bits - 1}) | 1)) & {bits - 1}") for i in range(POSITIONS)]))
    rows = hashes.select(at.alias("at")).groupBy(F.shiftright("at", 6).alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(at & 63 as int)))").alias("mask"))
    words = np.zeros(bits // 64, np.int64)
    got = rows.toArrow()
    if got.num_rows:
        words[got["word"].to_numpy()] = got["mask"].to_numpy()
    return words.view(np.uint64)


def filter_of(h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    """The filter over unsigned hashes that stand in one task, as 64-bit words."""
    bits = 1 << 10
    while bits < min(MAX_BITS, len(h1) * BITS_PER_KEY):
        bits *= 2
    words = np.zeros(bits // 64, np.uint64)
    mask, odd = np.uint64(bits - 1), h2 | np.uint64(1)
    for i in range(POSITIONS):
        at = (h1 + np.uint64(i) * odd) & mask
        np.bitwise_or.at(words, at >> np.uint64(6), np.uint64(1) << (at & np.uint64(63)))
    return words


def may_hold(words: np.ndarray, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    """False only for what isn't in the filter. h1, h2: unsigned 64-bit hashes."""
    mask = np.uint64(len(words) * 64 - 1)
    odd = h2 | np.uint64(1)
    known = np.ones(len(h1), bool)
    for i in range(POSITIONS):
        at = (h1 + np.uint64(i) * odd) & mask
        known &= (words[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) == 1
    return known
