"""References to records that do not exist.

Every reference is tested against a Bloom filter over all keys that exist or were removed. A negative is proof
of a missing key and needs no join. The positives are reduced to one row per key, joined exactly with the keys'
histories, and only references to keys with something wrong are looked at again.

Nulls and edge cases: a null key is no reference; an empty string is a key like any other; a null loaded_at
on either side makes no reference late; repeated rows are reported once each; empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quotewright.operators import bloom
from quotewright.operators.skew import hot_keys, meet
from quotewright.runtime import ship_code, written

#: References that a task probes at once where the filter is parted.
PROBED = 1_000_000


def _hashed(target: Column, key: Column) -> list[Column]:
    return [F.xxhash64(target, key).alias("h1"), F.xxhash64(key, target, F.lit(7)).alias("h2")]


def _probe(words, column_count: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h1, h2 = (b.column(column_count + k).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64) for k in (0, 1))
            yield pa.RecordBatch.from_arrays([*b.columns[:column_count], pa.array(bloom.may_hold(words.value, h1, h2))], names=[*b.schema.names[:column_count], "maybe_there"])

    return run


def _probe_part(columns: list[str]):
    def run(refs: pa.Table, held: pa.Table) -> pa.Table:
        kept = refs.select(columns).combine_chunks()
        if not len(refs):
            return kept.append_column("maybe_there", pa.array([], pa.bool_()))
        words = np.frombuffer(held["words"][0].as_py(), np.uint64) if len(held) else np.zeros(16, np.uint64)
        h1, h2 = (refs[c].combine_chunks().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64) for c in ("h1", "h2"))
        return kept.append_column("maybe_there", pa.array(bloom.may_hold(words, h1, h2)))

    return run


def _filter_part(t: pa.Table) -> pa.Table:
    h1, h2 = (t[c].combine_chunks().to_numpy().view(np.uint64) for c in ("h1", "h2"))
    return pa.table({"part": pa.array([t["part"][0].as_py()], pa.int32()), "words": pa.array([bloom.filter_of(h1, h2).tobytes()], pa.binary())})


def probed(refs: DataFrame, keys: DataFrame, plain: list[str]) -> DataFrame:
    """refs (the columns `plain`) with maybe_there: false only where the filter over keys (target, key_value) proves that the
    key isn't there. A written table.

    One filter is broadcast while it has bits enough for all keys. Beyond that the keys are parted by hash, each part
    with a filter of its own, and references meet the filter of their part in tasks of at most PROBED rows.
    """
    spark = refs.sparkSession
    hashes = written(keys.select(*_hashed(F.col("target"), F.col("key_value"))).distinct(), "keys")
    count = hashes.count()
    parts = -(-count * bloom.BITS_PER_KEY // bloom.MAX_BITS) or 1
    schema = refs.select(*plain).schema.add("maybe_there", "boolean")
    asked = refs.select(*plain, *_hashed(F.col("target"), F.col("key_value")))
    if parts == 1:
        words = spark.sparkContext.broadcast(bloom.filter_words(hashes, count))
        return written(asked.mapInArrow(_probe(words, len(plain)), schema), "probed")
    part = F.pmod(F.xxhash64("h2", "h1"), F.lit(parts)).cast("int").alias("part")
    filters = written(hashes.select("h1", "h2", part).groupBy("part").applyInArrow(_filter_part, "part int, words binary"), "filters")
    asked = asked.select("*", part)
    salts = asked.groupBy("part").agg(F.ceil(F.count("*") / PROBED).cast("int").alias("salts"))
    spread = asked.join(F.broadcast(written(salts, "salts")), "part").withColumn("salt", F.pmod(F.xxhash64("row_no", "tab"), F.col("salts")).cast("int"))  # a row a part
    offered = filters.join(salts, "part").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).select("part", "salt", "words")
    met = spread.groupBy("part", "salt").cogroup(offered.groupBy("part", "salt")).applyInArrow(_probe_part(plain), schema)
    return written(met, "probed")


def references(tables: dict[str, tuple[DataFrame, str, str]]) -> DataFrame:
    """One row per reference: tab, target, key_value, row_no, loaded_at. tables: name -> (rows, key column, target)."""
    out = None
    for tab, (df, key, target) in tables.items():
        part = df.select(
            F.lit(tab).alias("tab"), F.lit(target).alias("target"), F.col(key).alias("key_value"), F.col("row_no"), F.col("loaded_at")
        ).where(F.col("key_value").isNotNull())
        out = part if out is None else out.unionByName(part)
    return out


def orphans(refs: DataFrame, parents: DataFrame, removals: DataFrame) -> DataFrame:
    """Rows tab, target, key_value, row_no, loaded_at, orphan_state of the references that are missing, removed or late.

    refs: from `references`. parents: target, key_value, loaded_at, a row per row of the target tables.
    removals: tab, key_value, removed_at.
    """
    ship_code(refs.sparkSession)
    there = parents.where(F.col("key_value").isNotNull()).groupBy("target", "key_value").agg(
        F.min("loaded_at").alias("first_loaded"), F.max("loaded_at").alias("last_loaded"), F.lit(True).alias("has_row")
    )
    gone = removals.where(F.col("key_value").isNotNull()).groupBy(F.col("tab").alias("target"), "key_value").agg(F.max("removed_at").alias("last_removed"), F.lit(True).alias("listed"))
    history = there.join(gone, ["target", "key_value"], "full_outer")
    plain = ["tab", "target", "key_value", "row_no", "loaded_at"]
    keys = parents.select("target", "key_value").unionByName(removals.select(F.col("tab").alias("target"), "key_value")).where(F.col("key_value").isNotNull())
    tested = probed(refs, keys, plain)
    proven = tested.where(~F.col("maybe_there")).select(*plain, F.lit("missing").alias("orphan_state"))

    positive = tested.where("maybe_there")
    # a key with a third of all references is one row here, made before the shuffle
    keyed = ["target", "key_value"]
    used = written(positive.groupBy(*keyed).agg(F.min("loaded_at").alias("earliest"), F.count("*").alias("refs")), "used")
    removed = F.coalesce("listed", F.lit(False)) & (F.col("last_loaded").isNull() | (F.col("last_loaded") <= F.col("last_removed")))
    state = F.when(F.col("has_row").isNull() & F.col("listed").isNull(), "missing").when(removed, "removed")
    suspect = used.join(history, keyed, "left").withColumn("key_state", state).where(F.col("key_state").isNotNull() | (F.col("first_loaded") > F.col("earliest")))
    verified = (
        meet(positive, suspect.select(*keyed, "key_state", "first_loaded"), keyed, hot_keys(used, keyed, "refs"))
        .withColumn("orphan_state", F.coalesce("key_state", F.when(F.col("first_loaded") > F.col("loaded_at"), "late")))
        .where("orphan_state is not null")
        .select(*plain, "orphan_state")
    )
    return proven.unionByName(verified)


def orphans_by_month(found: DataFrame) -> DataFrame:
    """Orphan references per table, month and state."""
    return found.groupBy("tab", F.date_format("loaded_at", "yyyy-MM").alias("load_month"), "orphan_state").agg(F.count("*").alias("orphan_count"))
