"""Texts that some text of another set may resemble: an exact filter before ranking and edit distances.

Two texts at an edit distance of at most k differ in at most 2 * GRAM * k distinct runs of GRAM code points. The runs of
each text are bits of a map, where collisions only lower the difference, so no pair within k is lost. Maps are compared
within classes of length, block against block; the pairs that are left are measured.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quotewright.functions.similarity import ratio_from
from quotewright.runtime import ship_code, written

#: Code points of a run, bytes of a block's maps, bits of a map at most.
GRAM, BLOCK_BYTES, MOST_BITS = 3, 8 << 20, 1 << 17
_MAPS = "key long, cls int, n int, bits binary"


def _class(n: int, least: float) -> int:
    return int(math.log(n) / -math.log(least) + 1e-9)


def _bits(cls: int, least: float) -> int:
    """Bits of the maps of a class: about eight for each code point of its longest text."""
    return min(MOST_BITS, max(64, 1 << math.ceil(math.log2(8 * least ** -(cls + 1)))))


def _runs(text: str) -> np.ndarray:
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64)
    mixed = np.zeros(max(0, len(codes) - GRAM + 1), np.uint64)
    for i in range(GRAM):
        mixed = (mixed ^ codes[i : i + len(mixed)]) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
    return mixed


def _maps(texts: DataFrame, least: float, around: int) -> DataFrame:
    """key, cls, n, bits: a map for each text's class of length and for `around` classes on either side."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            for key, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                runs, own = _runs(text), _class(len(text), least)
                for cls in range(max(0, own - around), own + around + 1):
                    bits = np.zeros(_bits(cls, least), np.uint8)
                    bits[(runs % np.uint64(len(bits))).astype(np.int64)] = 1
                    out.append((key, cls, len(text), np.packbits(bits).tobytes()))
            columns = list(zip(*out)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int32(), pa.binary()))], names=["key", "cls", "n", "bits"])

    return texts.mapInArrow(run, _MAPS)


def _compare(asked: pa.Table, held: pa.Table, least: float) -> pa.Table:
    out_a, out_b = [], []
    if asked.num_rows and held.num_rows:
        ka, kb = (t["key"].to_numpy() for t in (asked, held))
        na, nb = (t["n"].to_numpy().astype(np.int64) for t in (asked, held))
        ma, mb = (np.frombuffer(b"".join(t["bits"].to_pylist()), np.uint64).reshape(t.num_rows, -1) for t in (asked, held))
        order = np.argsort(nb, kind="stable")
        kb, nb, mb = kb[order], nb[order], mb[order]
        for i in range(len(ka)):
            low, high = np.searchsorted(nb, [least * na[i] - 1e-6, na[i] / least + 1e-6])
            if low < high:
                apart = np.bitwise_count(ma[i] ^ mb[low:high]).sum(axis=1, dtype=np.int64)
                hit = low + np.flatnonzero(apart <= 2 * GRAM * np.floor((1 - least) * np.maximum(na[i], nb[low:high]) + 1e-6))
                out_a.append(np.full(len(hit), ka[i]))
                out_b.append(kb[hit])
    join = lambda parts: pa.array(np.concatenate(parts) if parts else [], pa.int64())
    return pa.table({"asked": join(out_a), "held": join(out_b)})


def _blocks(maps: DataFrame, least: float) -> dict[int, int]:
    """Blocks of each class, each of about BLOCK_BYTES, since every block meets every block of the other side; the driver
    holds a row per class of length."""
    return {r.cls: -(-r.n * _bits(r.cls, least) // (8 * BLOCK_BYTES)) for r in maps.groupBy("cls").agg(F.count("*").alias("n")).collect()}


def may_resemble(asked: DataFrame, held: DataFrame, least: float) -> DataFrame:
    """text of `asked` of which some text of `held` has an edit similarity of at least `least`. Both: text; nulls and
    empty texts resemble nothing."""
    ship_code(asked.sparkSession)
    sides = [written(df.where(F.length("text") > 0).select("text").distinct().select(F.xxhash64("text").alias("key"), "text"), "texts") for df in (asked, held)]
    maps = [written(_maps(side, least, around), "maps") for side, around in zip(sides, (1, 0))]
    counts = [_blocks(m, least) for m in maps]
    both = sorted(counts[0].keys() & counts[1].keys())
    if not both:
        return sides[0].select("text").limit(0)

    def blocked(m: DataFrame, mine: dict[int, int], others: dict[int, int], own: str, other: str) -> DataFrame:
        n = lambda d: F.create_map(*[F.lit(x) for c in both for x in (c, d[c])])[F.col("cls")]
        rows = m.where(F.col("cls").isin(both)).withColumn(own, F.pmod(F.xxhash64("key"), n(mine)).cast("int"))
        return rows.withColumn(other, F.explode(F.sequence(F.lit(0), n(others) - 1)))

    a = blocked(maps[0], *counts, "i", "j").groupBy("cls", "i", "j")
    b = blocked(maps[1], *counts[::-1], "j", "i").groupBy("cls", "i", "j")
    pairs = written(a.cogroup(b).applyInArrow(lambda x, y: _compare(x, y, least), "asked long, held long"), "alike").distinct()
    left, right = (side.select(F.col("key").alias(n), F.col("text").alias(f"{n}_text")) for side, n in zip(sides, ("asked", "held")))
    rows = pairs.join(left, "asked").join(right, "held")
    near = rows.where(ratio_from(F.col("asked_text"), F.col("held_text"), least - 1e-9).isNotNull())
    return near.select(F.col("asked_text").alias("text")).distinct()
