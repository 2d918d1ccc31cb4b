"""Joins and numberings in which no hot key is gathered in one task: counts are taken first, and its rows are spread."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quotewright.runtime import written

#: Rows of one key that a task takes; a key with more is spread over several. At most HOT_KEYS keys can be so hot that
#: they are: those with a HOT_KEYS-th of all rows, or more.
TASK_ROWS, HOT_KEYS = 100_000, 1024


def hot_keys(counts: DataFrame, keys: list[str], size: str) -> DataFrame | None:
    """keys, salts of the keys that are spread, HOT_KEYS at most, or None. counts: a written table of keys and `size`."""
    total = counts.agg(F.sum(size)).first()[0] or 0
    return _hot(counts, keys, size, total)


def _hot(counts: DataFrame, keys: list[str], size: str, total: int) -> DataFrame | None:
    bound = max(TASK_ROWS, total // HOT_KEYS)
    hot = counts.where(F.col(size) > bound).select(*keys, F.ceil(F.col(size) / TASK_ROWS).cast("int").alias("salts"))
    rows = hot.collect()
    return counts.sparkSession.createDataFrame(rows, hot.schema) if rows else None


def meet(many: DataFrame, few: DataFrame, keys: list[str], hot: DataFrame | None) -> DataFrame:
    """many joined with few on keys; the rows of a hot key in `many` are spread by its salts, those of `few` repeated."""
    if hot is None:
        return many.join(few, keys)
    salts = F.broadcast(hot)  # HOT_KEYS rows at most
    left = many.join(salts, keys, "left").withColumn("salt", F.pmod(F.xxhash64(*many.columns), F.coalesce("salts", F.lit(1))).cast("int")).drop("salts")
    right = few.join(salts, keys, "left").withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1))).drop("salts")
    return left.join(right, [*keys, "salt"]).drop("salt")


def spread_join(many: DataFrame, few: DataFrame, keys: list[str]) -> DataFrame:
    """many joined with few on keys. The keys of `many`, a written table, are counted first, so that hot ones are spread."""
    counts = written(many.groupBy(*keys).agg(F.count("*").alias("rows")).where(F.col("rows") > TASK_ROWS), "hot")
    return meet(many, few, keys, _hot(counts, keys, "rows", many.count()))


def running(df: DataFrame, keys: list[str], order: list[str], before: dict[str, Column]) -> DataFrame:
    """df with a column for each of `before`: the sum of its expression over the rows of the same keys that come first by
    `order`, 0 for the first. Rows are sorted over all tasks by keys and order, each task's sums are added up, and a row
    adds what its own task has before it; rows that tie by `order` stand in one task, in any order."""
    rows = df.withColumns({f"_of_{n}": c for n, c in before.items()}).repartitionByRange(*keys, *order).withColumn("_part", F.spark_partition_id())
    rows = written(rows, "sorted")
    ahead = lambda by, ordered: Window.partitionBy(*by).orderBy(*ordered).rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy(*keys, "_part").agg(*[F.sum(f"_of_{n}").alias(f"_sum_{n}") for n in before])
    base = sums.select(*[F.col(k).alias(f"_key_{k}") for k in keys], F.col("_part").alias("_key_part"), *[F.coalesce(F.sum(f"_sum_{n}").over(ahead(keys, ["_part"])), F.lit(0)).alias(f"_base_{n}") for n in before])
    inside = rows.withColumns({f"_in_{n}": F.coalesce(F.sum(f"_of_{n}").over(ahead([*keys, "_part"], order)), F.lit(0)) for n in before})
    same = F.col("_part") == F.col("_key_part")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_key_{k}"))
    return inside.join(base, same).select(*df.columns, *[(F.col(f"_base_{n}") + F.col(f"_in_{n}")).alias(n) for n in before])
