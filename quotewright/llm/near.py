"""Near-duplicate records with small edits: a set similarity join over chosen paths.

Each record is the set of its distinct runs of `shingle` words, embedded as a list of minwise tokens. A tree branches
records by the tokens that a node chooses; nodes of up to NODE_LIMIT records are compared exhaustively, larger ones
branch again. A larger node is compared too, in blocks, if its records are on average nearly as similar as the pairs
that are sought, so that what is compared is for the most part what is found; the average comes from a bounded sample
of the node's tokens and decides on cost only. Records that merely share boilerplate branch on until they part.
Independent trees repeat this: a pair of similarity s is missed at the first level with
(1 - s) ** (TREES * BRANCHES), 4e-7 at 0.6. Every candidate is verified exactly.

Records with equal word sequences are one class, known by 128 bits. Null ids and texts, and texts below `least_words`
words, take no part; repeated rows of an id count once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quotewright.llm.arrays import mix
from quotewright.llm.lookalike import connection
from quotewright.llm.pairs import class_members, expand, group_pairs, with_stats
from quotewright.llm.words import sequence_keys, windows, word_pairs
from quotewright.runtime import ship_code, written

TREES, BRANCHES, LEVELS, NODE_LIMIT = 8, 2, 12, 32
TOKENS = 3 * TREES * BRANCHES
#: Records of a node that its average similarity comes from, and how far below the sought similarity it may lie.
JUDGED, SLACK = 32, 0.05


def _sets(shingle: int, least_words: int):
    keys = mix(np.arange(1, TOKENS + 1, dtype=np.uint64)) | np.uint64(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        con = connection()
        for b in batches:
            batch = pa.table({"n": pa.array(range(len(b)), pa.int64()), "t": b.column(1)})
            con.register("batch", batch)
            plain = con.sql("SELECT words(t) AS w FROM batch ORDER BY n").to_arrow_table()["w"].combine_chunks()
            con.unregister("batch")
            words, second, at = word_pairs(plain)
            lengths = np.diff(at)
            hashes, text, _ = windows(words, at, shingle)
            order = np.lexsort((hashes, text))
            hashes, text = hashes[order], text[order]
            new = np.ones(len(hashes), bool)
            new[1:] = (hashes[1:] != hashes[:-1]) | (text[1:] != text[:-1])
            hashes, text = hashes[new], text[new]
            kept = (lengths >= least_words) & (np.bincount(text, minlength=len(lengths)) > 0)
            mine = kept[text]
            hashes, text = hashes[mine], text[mine]
            sizes = np.bincount(text, minlength=len(lengths))[kept]
            starts = np.cumsum(sizes) - sizes
            tokens = np.zeros((len(sizes), TOKENS), np.int32)
            if len(sizes):
                for i, k in enumerate(keys):
                    tokens[:, i] = (np.minimum.reduceat(mix(hashes ^ k), starts) >> np.uint64(32)).astype(np.uint32).view(np.int32)
            every = pa.array(np.arange(len(sizes) + 1) * TOKENS, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0).filter(pa.array(kept)),
                    sequence_keys(words, second, at).filter(pa.array(kept)),
                    pa.ListArray.from_arrays(pa.array(np.append(starts, len(hashes)), pa.int32()), pa.array(hashes.view(np.int64))),
                    pa.ListArray.from_arrays(every, pa.array(tokens.ravel())),
                ],
                names=["id", "sequence", "shingles", "tokens"],
            )

    return run


def _children(rows: DataFrame, level: int) -> DataFrame:
    """node, t, n: the nodes that each record of a node goes to. At the root every tree has its own tokens."""
    if level == 0:
        places = F.expr(f"sequence(0, {TREES * BRANCHES - 1})")
        at = F.col("i")
    else:
        places = F.expr(f"sequence(0, {BRANCHES - 1})")
        at = F.pmod(F.xxhash64("node", "i"), F.lit(TOKENS)).cast("int")
    wide = rows.withColumn("i", F.explode(places)).withColumn("at", at)
    node = F.xxhash64(*(["node"] if level else []), "at", F.element_at("tokens", F.col("at") + 1))
    return wide.select(node.alias("node"), "t", "n")


def _agreement(t: pa.Table) -> pa.Table:
    """The share of equal tokens over all pairs of a node's judged records."""
    tokens = t["tokens"].combine_chunks().flatten().to_numpy().reshape(len(t), -1)
    a, b = np.triu_indices(len(tokens), 1)
    alike = float((tokens[a] == tokens[b]).mean()) if len(a) else 1.0
    return pa.table({"node": pa.array([t["node"][0].as_py()], pa.int64()), "alike": pa.array([alike], pa.float64())})


def _alike_nodes(large: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """node of the large nodes whose records are on average at least `least` similar."""
    nth = F.row_number().over(Window.partitionBy("node").orderBy(F.xxhash64("t"), "t"))
    judged = large.select("node", "t").withColumn("nth", nth).where(F.col("nth") <= JUDGED).join(sets.select("t", "tokens"), "t").select("node", "tokens")
    return judged.groupBy("node").applyInArrow(_agreement, "node long, alike double").where(F.col("alike") >= least).select("node")


def similar_classes(df: DataFrame, id_col: str, text_col: str, shingle: int, least_words: int, similarity: tuple[int, int]) -> tuple[DataFrame, DataFrame]:
    """(members id, t; pairs a < b of classes t with at least `similarity`, a fraction, of their runs in common)."""
    ship_code(df.sparkSession)
    rows = df.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text")).where(F.col("id").isNotNull() & F.col("text").isNotNull())
    made = written(rows.mapInArrow(_sets(shingle, least_words), "id string, sequence binary, shingles array<long>, tokens array<int>"), "sets")
    sets = made.groupBy("sequence").agg(F.first("shingles").alias("shingles"), F.first("tokens").alias("tokens"))
    sets = written(sets.select("sequence", F.monotonically_increasing_id().alias("t"), "shingles", "tokens", F.size("shingles").alias("n")), "classes")
    members = made.select("id", "sequence").distinct().join(sets.select("sequence", "t"), "sequence").select("id", "t")
    part, whole = similarity
    pairs, frontier = None, _children(sets.select("t", "n", "tokens"), 0)
    for level in range(1, LEVELS + 1):
        placed = written(with_stats(frontier, ["node"]), "nodes")
        large = placed.where(F.col("group_size") > NODE_LIMIT)
        last = level == LEVELS or large.isEmpty()
        if last:
            near = placed
        else:
            alike = written(_alike_nodes(large, sets, part / whole - SLACK), "alike")
            near = placed.where(F.col("group_size") <= NODE_LIMIT).unionByName(large.join(alike, "node", "left_semi"))
            large = large.join(alike, "node", "left_anti")
        close = F.least("a_n", "b_n") * whole >= F.greatest("a_n", "b_n") * part
        here = group_pairs(near, ["node"], "t", ["n"]).where(close).select("a", "b")
        pairs = here if pairs is None else pairs.unionByName(here)
        if last or large.isEmpty():
            break
        frontier = _children(large.join(sets.select("t", "tokens"), "t"), level)
    runs = lambda n: sets.select(F.col("t").alias(n), F.col("shingles").alias(f"{n}_runs"))
    both = pairs.distinct().join(runs("a"), "a").join(runs("b"), "b").withColumn("common", F.size(F.array_intersect("a_runs", "b_runs")))
    union = F.size("a_runs") + F.size("b_runs") - F.col("common")
    return members, both.where(F.col("common") * whole >= union * part).select("a", "b")


def near_duplicates(df: DataFrame, id_col: str, text_col: str, shingle: int = 5, least_words: int = 20, similarity: tuple[int, int] = (4, 5), limit: int | None = None) -> DataFrame:
    """id_a < id_b of records that share at least `similarity` of their distinct word runs. Pairs of different word
    sequences are all given; copies give all pairs up to `limit` ids (500; 0 for no limit), beyond that each with the
    first id of its class, whose ids stand in `near_groups`."""
    members, pairs = similar_classes(df, id_col, text_col, shingle, least_words, similarity)
    return expand(pairs, class_members(members, "t"), "t", limit)


def groups(members: DataFrame, pairs: DataFrame) -> DataFrame:
    """id, group_id (the least id of the group), class_id (the least id of the records with its words), links (to other
    classes): connected records, one row per id. members: id, t; pairs: a, b of t.

    Labels spread along the pairs and jump to their label's label until nothing changes; each round is a written
    table, and the driver sees only the number of changes.
    """
    members = class_members(members, "t")
    pairs = written(pairs, "links")
    edges = written(pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))), "edges")
    labels = written(edges.groupBy(F.col("a").alias("v")).agg(F.least(F.col("v"), F.min("b")).alias("label")), "labels")
    while True:
        heard = edges.join(labels.select(F.col("v").alias("b"), F.col("label").alias("heard")), "b").groupBy(F.col("a").alias("v")).agg(F.min("heard").alias("heard"))
        spread = labels.join(heard, "v").select("v", F.col("label").alias("old"), F.least("label", "heard").alias("label"))
        jump = spread.alias("s").join(labels.select(F.col("v").alias("label"), F.col("label").alias("further")), "label", "left")
        after = written(jump.select("v", "old", F.least(F.col("label"), F.coalesce("further", "label")).alias("label")), "labels")
        labels = after.select("v", "label")
        if after.where(F.col("old") != F.col("label")).isEmpty():
            break
    links = edges.groupBy(F.col("a").alias("t")).agg(F.count("*").alias("links"))
    first = members.select("t", "first_id").distinct()
    named = labels.select(F.col("v").alias("t"), "label").join(first, "t")
    named = named.join(named.groupBy("label").agg(F.min("first_id").alias("group_id")), "label").select("t", "group_id").join(links, "t")
    return members.join(named, "t", "left").select("id", F.coalesce("group_id", "first_id").alias("group_id"), F.col("first_id").alias("class_id"), F.coalesce("links", F.lit(0)).cast("long").alias("links"))
