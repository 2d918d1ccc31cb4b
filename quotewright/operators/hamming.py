"""Exact nearest bit vectors of a stated query set."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quotewright.runtime import ship_code

#: Bytes of query vectors that are broadcast at once; more are taken in blocks.
BLOCK_BYTES = 32 << 20


def _words(values: list[bytes]) -> np.ndarray:
    raw = np.frombuffer(b"".join(values), np.uint8).reshape(len(values), -1)
    padded = np.zeros((len(raw), -(-raw.shape[1] // 8) * 8), np.uint8)
    padded[:, : raw.shape[1]] = raw
    return padded.view(np.uint64)


def _near(asked, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, tuple[list, list]] = {}
        for b in batches:
            ids, vecs = b.column(0).to_pylist(), b.column(1).to_pylist()
            for size, (names, q) in asked.value.items():
                rows = [i for i, v in enumerate(vecs) if len(v) == size]
                if not rows:
                    continue
                x = _words([vecs[i] for i in rows])
                kept = best.setdefault(size, ([[] for _ in names], names))[0]
                for n in range(len(names)):
                    d = np.bitwise_count(x ^ q[n]).sum(1, dtype=np.int64)
                    limit = np.partition(d, min(k, len(d)) - 1)[min(k, len(d)) - 1]
                    kept[n] = sorted(kept[n] + [(int(d[i]), ids[rows[i]]) for i in np.flatnonzero(d <= limit)])[:k]
        rows = [(n, r, d) for kept, names in best.values() for n, found in zip(names, kept) for d, r in found]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.int64())], names=["query_id", "record_id", "distance"])

    return run


def nearest_of(queries: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    spark = queries.sparkSession
    ship_code(spark)
    q = queries.where(F.col("vec").isNotNull() & F.col("query_id").isNotNull()).select(F.col("query_id").cast("string").alias("query_id"), "vec").distinct()
    x = vectors.where(F.col("vec").isNotNull() & (F.octet_length("vec") > 0)).select(F.col("record_id").cast("string").alias("record_id"), "vec").distinct()
    blocks = -(-(q.agg(F.sum(F.octet_length("vec"))).first()[0] or 0) // BLOCK_BYTES) or 1
    found = spark.createDataFrame([], "query_id string, record_id string, distance long")
    for block in range(blocks):
        sized: dict[int, tuple[list, list]] = {}
        for r in q.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == block).orderBy("query_id").collect():
            names, values = sized.setdefault(len(r.vec), ([], []))
            names.append(r.query_id)
            values.append(bytes(r.vec))
        if sized:
            asked = spark.sparkContext.broadcast({n: (names, _words(values)) for n, (names, values) in sized.items()})
            found = found.unionByName(x.mapInArrow(_near(asked, k), found.schema))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "record_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)
