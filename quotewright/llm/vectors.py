"""The most similar vectors of every vector, over packed bit vectors and Hamming distance.

Equal vectors of a model are one point, which carries the first ids of its records: no other of its records can be
among the nearest of anything, as ties go to the smaller id. Points go to the nearest of a few pivots, fitted on a
bounded sample; a pivot with more than SHARD points is split by pivots of its own, level by level, so that the work
for a vector doesn't grow with the points of its cluster. Every shard gets a robust-pruned graph. Each point searches,
with a beam, the shards of the pivots nearest to it, and the best of all shards remain. Records are told apart before
the list is cut, and the beam widens until there are enough of them. Recall is in the README and tests.

Usable are vectors of dtype `binary`, of the dim that most rows of their model have (the smaller of two as common),
with exactly dim bits, not all zero; null ids, models and vectors take no part. Rows that repeat a record's vector
count once; of several vectors of a record the nearest counts. Ties go to the smaller record id. An empty table gives
no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quotewright.llm.graph import BATCH, Graph, build, distances
from quotewright.operators.skew import spread_join
from quotewright.runtime import ship_code, written

#: Rows that the pivots are fitted on for each model and most pivots; members of a shard, queries of a task, and the beam.
SAMPLE, PIVOTS, SHARD, QUERIES, BEAM = 8000, 256, 8192, 8192, 64
#: A model of more than PIVOTS * CROWD points gets a pivot for every CROWD points, MOST_PIVOTS at most, fitted on ROWS_A_PIVOT
#: sampled rows each (131,072 at most): clusters without a pivot of their own would be scattered.
CROWD, MOST_PIVOTS, ROWS_A_PIVOT = 1024, 4096, 32
#: Words of 64 bits that vectors are compared with pivots in at once: 8 MB, whatever the rows and pivots are.
WORDS = 1 << 20
#: Pivots searched for a vector: those at most SLACK of its bits farther than the nearest, PROBES at most.
SLACK, PROBES = 0.06, 8
#: Pivots nearer than this share of the bits are one; with fewer members in the sample a pivot is dropped, so that a
#: shard holds neighbours enough for its vectors. A model of at most SMALL points is one shard.
MERGED, LEAST_MEMBERS, SMALL = 0.15, 16, 4096
#: Pivots that a crowded pivot is split by at most, sampled points that they come from, and levels of splitting.
SPLIT, SPLIT_SAMPLE, LEVELS = 64, 512, 4
KEYS = ["model", "node", "shard"]
_NEAR = "array<struct<distance:int,record_id:string>>"


def packed(column: pa.Array) -> np.ndarray:
    """Rows of 64-bit words of equally long binary values."""
    raw = np.frombuffer(b"".join(column.to_pylist()), np.uint8)
    rows = raw.reshape(len(column), -1) if len(column) else raw.reshape(0, 8)
    padded = np.zeros((len(rows), -(-rows.shape[1] // 8) * 8), np.uint8)
    padded[:, : rows.shape[1]] = rows
    return padded.view(np.uint64)


def usable(df: DataFrame) -> DataFrame:
    """model, dim, record_id, vec of the usable vectors, each once."""
    usual = df.where(F.col("model").isNotNull() & F.col("dim").isNotNull()).groupBy("model", "dim").count()
    usual = usual.groupBy("model").agg(F.max(F.struct("count", (-F.col("dim")).alias("less"))).alias("top")).select("model", (-F.col("top.less")).alias("usual_dim"))
    rows = df.where((F.col("dtype") == "binary") & F.col("record_id").isNotNull() & F.col("vec").isNotNull()).select("model", "dim", "record_id", "vec")
    fits = (F.octet_length("vec") == F.ceil(F.col("dim") / 8)) & F.hex("vec").rlike("[1-9A-F]")
    return rows.join(usual, "model").where((F.col("dim") == F.col("usual_dim")) & fits).select("model", "dim", "record_id", "vec").distinct()


def pivots_for(points: int) -> tuple[int, int]:
    """(most pivots, rows to fit them on) for so many points."""
    pivots = min(MOST_PIVOTS, max(PIVOTS, points // CROWD))
    return pivots, max(SAMPLE, ROWS_A_PIVOT * pivots if pivots > PIVOTS else 0)


def fit_pivots(x: np.ndarray, bits: int, most: int = PIVOTS) -> np.ndarray:
    """Pivots of a sample: points far from each other, moved twice to the majority of what is nearest, the rare dropped."""
    chosen, d = [0], distances(x, x[0])
    for _ in range(min(most, max(1, len(x) // (64 if most <= PIVOTS else ROWS_A_PIVOT))) - 1):
        chosen.append(int(d.argmax()))
        d = np.minimum(d, distances(x, x[chosen[-1]]))
    pivots = x[chosen]
    for _ in range(2):
        home = np.concatenate([d.argmin(1) for d in _compared(x, pivots)])
        count = np.bincount(home, minlength=len(pivots))
        kept = np.flatnonzero(count >= max(1, min(LEAST_MEMBERS if most <= PIVOTS else ROWS_A_PIVOT // 4, count.max())))
        members = np.split(np.argsort(home, kind="stable"), np.cumsum(count)[:-1])
        pivots = np.stack([np.packbits(np.unpackbits(x[members[k]].view(np.uint8), axis=1).mean(0) >= 0.5).view(np.uint64) for k in kept])
    single: list[np.ndarray] = []
    for p in pivots:
        if not single or distances(np.stack(single), p).min() > MERGED * bits:
            single.append(p)
    return np.stack(single)


def _compared(x: np.ndarray, pivots: np.ndarray) -> Iterator[np.ndarray]:
    """The distances of some rows at a time to all pivots; what is held at once doesn't grow with the rows."""
    step = max(1, WORDS // pivots.size)
    for i in range(0, len(x), step):
        yield distances(x[i : i + step, None], pivots[None])


def nearest(x: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(pivots by distance, PROBES at most, and the distances) of each row."""
    best = [np.zeros((0, min(PROBES, len(pivots))), np.int64)]
    for d in _compared(x, pivots):
        keys = d.astype(np.int64) << 32 | np.arange(len(pivots))
        if len(pivots) > PROBES:
            keys = np.partition(keys, PROBES - 1, axis=1)[:, :PROBES]
        best.append(np.sort(keys, 1))  # a copy: a slice would hold the distances to all pivots
    keys = np.concatenate(best)
    return keys & 0xFFFFFFFF, keys >> 32


def _probes(x: np.ndarray, pivots: np.ndarray, bits: int) -> list[list[int]]:
    order, d = nearest(x, pivots)
    near = d <= d[:, :1] + SLACK * bits
    return [o[k].tolist() for o, k in zip(order, near)]


_PLACED = "model string, dim int, point binary, ids array<string>, vec binary, nodes array<long>"


def _homes(pivots):
    """Each point with the nodes of its pivots, the nearest first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            models, dims = b.column("model").to_pylist(), b.column("dim").to_numpy()
            probes: list = [None] * len(b)
            for model in set(models):
                rows = np.flatnonzero(np.array([m == model for m in models]))
                for r, p in zip(rows, _probes(packed(b.column("vec").take(pa.array(rows))), pivots.value[model], int(dims[rows[0]]))):
                    probes[r] = p
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(probes, pa.list_(pa.int64()))], names=[*b.schema.names, "nodes"])

    return run


def _split_pivots(t: pa.Table) -> pa.Table:
    """Points of a node as its pivots, twice as many as it needs shards, chosen by a hash: no order of the table matters."""
    t = t.sort_by("point").slice(0, min(SPLIT, -(-2 * t["members"][0].as_py() // SHARD)))
    return pa.table([pa.array([t[c][0].as_py()], k) for c, k in (("model", pa.string()), ("node", pa.int64()))] + [pa.array([b"".join(t["vec"].to_pylist())], pa.binary())], names=["model", "node", "pivots"])


def _descend(rows: pa.Table, held: pa.Table) -> pa.Table:
    """Each point of a block with its nodes one level below. A node's children follow it in numbers."""
    rows = rows.select(["model", "dim", "point", "ids", "vec", "node"])
    if not len(rows) or not len(held):
        return rows.drop_columns("node").append_column("nodes", pa.array([[n] for n in rows["node"].to_pylist()], pa.list_(pa.int64())))
    x = packed(rows["vec"].combine_chunks())
    raw = held["pivots"][0].as_py()
    size = len(rows["vec"][0].as_py())
    pivots = packed(pa.array([raw[i : i + size] for i in range(0, len(raw), size)], pa.binary()))
    base = (rows["node"][0].as_py() + 1) * (SPLIT + 1) + (1 << 20)
    nodes = [[base + k for k in p] for p in _probes(x, pivots, rows["dim"][0].as_py())]
    return rows.drop_columns("node").append_column("nodes", pa.array(nodes, pa.list_(pa.int64())))


_SHARDS = "model string, node long, shard int, points array<binary>, ids array<array<string>>, vectors binary, edges binary, entries binary"


def _build(t: pa.Table) -> pa.Table:
    t = t.sort_by("point")
    x = packed(t["vec"].combine_chunks())
    g = build(x)
    first = [t[k][0].as_py() for k in KEYS]
    types = [pa.string(), pa.int64(), pa.int32(), pa.list_(pa.binary()), pa.list_(pa.list_(pa.string())), pa.binary(), pa.binary(), pa.binary()]
    values = [*first, t["point"].to_pylist(), t["ids"].to_pylist(), x.tobytes(), g.edges.tobytes(), g.entries.tobytes()]
    return pa.table([pa.array([v], k) for v, k in zip(values, types)], names=[*KEYS, "points", "ids", "vectors", "edges", "entries"])


def _records(point: np.ndarray, distance: np.ndarray, code: np.ndarray, first: np.ndarray, wanted: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, record, distance) of the `wanted` nearest records of each query, in order. point: a row of points by query,
    -1 for none; code, first: the records of the points, in order, and where each point's begin."""
    query, column = np.nonzero(point >= 0)
    p = point[query, column]
    many = first[p + 1] - first[p]
    row = np.repeat(query, many)
    at = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many) + np.repeat(first[p], many)
    record, d = code[at], np.repeat(distance[query, column], many)
    by = np.lexsort((record, d, row))
    row, record, d = row[by], record[by], d[by]
    once = np.sort(np.unique(row * (int(code.max()) + 1) + record, return_index=True)[1]) if len(row) else np.zeros(0, np.int64)
    row, record, d = row[once], record[once], d[once]
    start = np.searchsorted(row, np.arange(len(point)))
    keep = np.arange(len(row)) - start[row] < wanted
    return row[keep], record[keep], d[keep]


def _search(wanted: int):
    def run(queries: pa.Table, shard: pa.Table) -> pa.Table:
        kind = pa.list_(pa.struct([("distance", pa.int32()), ("record_id", pa.string())]))
        if not len(queries) or not len(shard):
            return pa.table([pa.array([], pa.binary()), pa.array([], kind)], names=["point", "near"])
        owners = shard["ids"].combine_chunks().flatten()
        names = owners.flatten()
        order = {n: k for k, n in enumerate(sorted(set(names.to_pylist())))}
        code = np.array([order[n] for n in names.to_pylist()], np.int64)
        first = owners.offsets.to_numpy().astype(np.int64) - owners.offsets[0].as_py()
        n = len(owners)
        x = np.frombuffer(shard["vectors"][0].as_py(), np.uint64).reshape(n, -1)
        graph = Graph(x, np.frombuffer(shard["edges"][0].as_py(), np.int32).reshape(n, -1), np.frombuffer(shard["entries"][0].as_py(), np.int64))
        q = packed(queries["vec"].combine_chunks())
        place = {p: k for k, p in enumerate(shard["points"].combine_chunks().flatten().to_pylist())}
        own = np.array([place.get(p, -1) for p in queries["point"].to_pylist()], np.int64)
        # a larger shard is searched with a wider beam
        out, waiting, beam = [], np.arange(len(q)), max(wanted, int(BEAM * max(1.0, np.log2(max(n, 2) / 512) / 2)))
        while len(waiting):
            short = []
            for i in range(0, len(waiting), BATCH):
                rows = waiting[i : i + BATCH]
                row, record, d = _records(*graph.search(q[rows], beam, own[rows]), code, first, wanted)
                lacking = np.bincount(row, minlength=len(rows)) < min(wanted, len(order)) if beam < n else np.zeros(len(rows), bool)
                short.append(rows[lacking])
                kept = ~lacking[row]
                out.append((rows[row[kept]], record[kept], d[kept]))
            waiting, beam = np.concatenate(short), 2 * beam
        row, record, d = (np.concatenate([o[k] for o in out]) for k in range(3))
        by = np.argsort(row, kind="stable")
        row, record, d = row[by], record[by], d[by]
        ids = pa.array(list(order), pa.string()).take(pa.array(record))
        heads, begin = np.unique(row, return_index=True)
        near = pa.ListArray.from_arrays(pa.array(np.append(begin, len(row)), pa.int32()), pa.StructArray.from_arrays([pa.array(d, pa.int32()), ids], fields=list(kind.value_type)))
        return pa.table([queries["point"].combine_chunks().take(pa.array(heads)), near], names=["point", "near"])

    return run


def _sizes(placed: DataFrame) -> DataFrame:
    """model, node, members (points whose first node it is), asking (points that search it): a written table."""
    rows = placed.select("model", F.posexplode("nodes").alias("at", "node"))
    return written(rows.groupBy("model", "node").agg(F.count_if(F.col("at") == 0).alias("members"), F.count("*").alias("asking")), "sizes")


def _place(points: DataFrame, pivots) -> tuple[DataFrame, DataFrame]:
    """(points with their nodes, sizes of the nodes): crowded nodes are split, level after level."""
    placed = written(points.mapInArrow(_homes(pivots), _PLACED), "placed")
    sizes = _sizes(placed)
    for _ in range(LEVELS):
        crowded = sizes.where(F.col("members") > SHARD).select("model", "node", "members")
        if crowded.isEmpty():
            break
        asking = sizes.join(crowded.select("model", "node"), ["model", "node"]).select("model", "node", F.ceil(F.col("asking") / QUERIES).cast("int").alias("blocks"))
        homes = placed.select("model", F.element_at("nodes", 1).alias("node"), "point", "vec").join(crowded, ["model", "node"])
        chance = F.pmod(F.xxhash64("point"), F.lit(1_000_000)) < F.ceil(F.lit(1_000_000.0) * SPLIT_SAMPLE / F.col("members"))
        below = written(homes.where(chance).select("model", "node", "members", "point", "vec").groupBy("model", "node").applyInArrow(_split_pivots, "model string, node long, pivots binary"), "split")
        wide = placed.withColumn("node", F.explode("nodes")).drop("nodes").join(asking.join(below.select("model", "node"), ["model", "node"], "left_semi"), ["model", "node"], "left")
        stays = wide.where("blocks is null").select("model", "dim", "point", "ids", "vec", F.array("node").alias("nodes"))
        goes = wide.where("blocks is not null").withColumn("block", F.pmod(F.xxhash64("point"), F.col("blocks")).cast("int")).drop("blocks")
        offered = below.join(asking, ["model", "node"]).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
        by = ["model", "node", "block"]
        down = goes.groupBy(*by).cogroup(offered.groupBy(*by)).applyInArrow(_descend, _PLACED)
        # a point's nodes, those below its nearest first
        first = placed.select("point", F.element_at("nodes", 1).alias("old"))
        parts = stays.withColumn("old", F.col("nodes")[0]).unionByName(down.withColumn("old", F.floor((F.col("nodes")[0] - (1 << 20)) / (SPLIT + 1)).cast("long") - 1))
        joined = parts.join(first.withColumnRenamed("old", "home"), "point").groupBy("model", "dim", "point").agg(F.first("ids").alias("ids"), F.first("vec").alias("vec"), F.flatten(F.transform(F.array_sort(F.collect_list(F.struct((F.col("old") != F.col("home")).alias("other"), "old", "nodes"))), lambda x: x.nodes)).alias("nodes"))
        placed = written(joined, "placed")
        sizes = _sizes(placed)
    return placed, sizes


def neighbours(df: DataFrame, k: int = 10) -> DataFrame:
    """model, dim, record_id, neighbour_id, rank, distance: up to k nearest other records of every usable vector's record."""
    spark = df.sparkSession
    ship_code(spark)
    vectors = written(usable(df).withColumn("point", F.unhex(F.md5(F.concat(F.col("model").cast("binary"), F.lit(b"\x1f"), "vec")))), "vectors")
    kth = F.row_number().over(Window.partitionBy("model", "dim", "point").orderBy("record_id"))
    first = vectors.withColumn("kth", kth).where(F.col("kth") <= k + 1)
    points = written(first.groupBy("model", "dim", "point").agg(F.array_sort(F.collect_list("record_id")).alias("ids"), F.first("vec").alias("vec")), "points")
    of_model = {r.model: (r["count"], r.dim) for r in points.groupBy("model", "dim").count().collect()}
    empty = spark.createDataFrame([], "model string, dim int, record_id string, neighbour_id string, rank int, distance int")
    if not of_model:
        return empty
    share = F.create_map(*[F.lit(v) for m, (n, _) in of_model.items() for v in (m, min(1_000_000, -(-pivots_for(n)[1] * 1_000_000 // n)))])
    sample = points.where(F.pmod(F.xxhash64("point"), F.lit(1_000_000)) < share[F.col("model")]).select("model", "point", "vec").toArrow()
    sample = sample.sort_by("point")  # the pivots don't depend on partitions
    pivots = {}
    for m, (n, bits) in of_model.items():
        mine = sample.filter(pa.array([x == m for x in sample["model"].to_pylist()], pa.bool_())) if sample.num_rows else sample
        if not mine.num_rows:  # a tiny model that the hash left out
            mine = points.where(F.col("model") == m).select("model", "vec").limit(1).toArrow()
        fitted = fit_pivots(packed(mine["vec"].combine_chunks()), bits, pivots_for(n)[0])
        pivots[m] = fitted if n > min(SMALL, SHARD) else fitted[:1]
    placed, sizes = _place(points, spark.sparkContext.broadcast(pivots))

    # a node that couldn't be split further is cut by a hash, and all its parts are searched
    parts = written(sizes.where("members > 0").select("model", "node", F.ceil(F.col("members") / SHARD).cast("int").alias("shards"), F.ceil(F.col("asking") / QUERIES).cast("int").alias("blocks")), "parts")
    tasks = max(1, min(2000, parts.agg(F.sum("shards")).first()[0]))
    spread = F.xxhash64("point")
    homes = placed.select("model", F.element_at("nodes", 1).alias("node"), "point", "ids", "vec").join(parts, ["model", "node"])
    homes = homes.select("model", "node", F.pmod(spread, F.col("shards")).cast("int").alias("shard"), "point", "ids", "vec")
    shards = written(homes.repartition(tasks, *KEYS).groupBy(*KEYS).applyInArrow(_build, _SHARDS), "shards")

    asked = placed.select("model", "point", "vec", F.explode("nodes").alias("node")).join(parts, ["model", "node"])
    asked = asked.withColumn("shard", F.explode(F.sequence(F.lit(0), F.col("shards") - 1))).withColumn("block", F.pmod(spread, F.col("blocks")).cast("int")).drop("shards", "blocks")
    offered = shards.join(parts, ["model", "node"]).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("shards", "blocks")
    by = [*KEYS, "block"]
    found = asked.repartition(tasks, *by).groupBy(*by).cogroup(offered.repartition(tasks, *by).groupBy(*by)).applyInArrow(_search(k + 1), f"point binary, near {_NEAR}")
    near = written(found, "found")
    lists = spread_join(vectors.select("model", "dim", "record_id", "point"), near, ["point"]).repartition("model", "record_id")
    rows = lists.select("model", "dim", "record_id", F.explode("near").alias("n")).select("model", "dim", "record_id", F.col("n.record_id").alias("neighbour_id"), F.col("n.distance").alias("distance"))
    best = rows.where(F.col("record_id") != F.col("neighbour_id")).groupBy("model", "dim", "record_id", "neighbour_id").agg(F.min("distance").alias("distance"))
    rank = F.row_number().over(Window.partitionBy("model", "record_id").orderBy("distance", "neighbour_id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select(*empty.columns)


def mutual_pairs(near: DataFrame, most: tuple[int, int] = (15, 100)) -> DataFrame:
    """id_a < id_b of records that are neighbours of each other in one model and differ in at most the share `most` of
    their bits. near: from `neighbours`."""
    part, whole = most
    close = written(near.where(F.col("distance") * whole <= F.col("dim") * part).select("model", "record_id", "neighbour_id"), "close")
    back = close.select("model", F.col("record_id").alias("neighbour_id"), F.col("neighbour_id").alias("record_id"))
    both = close.join(back, ["model", "record_id", "neighbour_id"], "left_semi").where(F.col("record_id") < F.col("neighbour_id"))
    return both.select(F.col("record_id").alias("id_a"), F.col("neighbour_id").alias("id_b")).distinct()
