"""Pairs within groups, written so that no task ever holds a whole group."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quotewright.operators.skew import hot_keys, meet
from quotewright.runtime import written

#: Up to so many members a group of exact copies gives all its pairs; beyond, every member is paired with a
#: representative. Blocks that larger groups of different members are compared in have this size too.
PAIR_LIMIT = 500


def with_stats(members: DataFrame, keys: list[str], least: int = 2, **aggs) -> DataFrame:
    """members of groups of at least `least` rows, with the groups' aggregates, counted before the shuffle."""
    stats = members.groupBy(*keys).agg(F.count("*").alias("group_size"), *[v.alias(k) for k, v in aggs.items()])
    stats = written(stats.where(F.col("group_size") >= least) if least > 1 else stats, "stats")
    return meet(members, stats, keys, hot_keys(stats, keys, "group_size"))


def group_pairs(m: DataFrame, keys: list[str], value: str, extra: list[str] = ()) -> DataFrame:
    """keys, a, b (a < b) and the extra columns as a_x, b_x of all pairs in each group; m has group_size.

    A group beyond PAIR_LIMIT is cut into blocks: each member stands once on the left, in its block, and once in
    every block on the right, so a task sees one block against the group and no pair is missed.
    """
    m = m.withColumn("blocks", F.ceil(F.col("group_size") / PAIR_LIMIT).cast("int"))
    a = m.withColumn("block", F.pmod(F.xxhash64(value), F.col("blocks")).cast("int"))
    b = m.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    named = lambda side, n: side.select(*keys, "block", F.col(value).alias(n), *[F.col(x).alias(f"{n}_{x}") for x in extra])
    return named(a, "a").join(named(b, "b"), [*keys, "block"]).where(F.col("a") < F.col("b")).drop("block")


def class_members(members: DataFrame, key: str) -> DataFrame:
    """id, key, group_size, first_id: members with the size and the representative (least id) of their class. `members`
    has one row per id and class."""
    return written(with_stats(members.select(key, "id"), [key], least=1, first_id=F.min("id")), "members")


def expand(class_pairs: DataFrame, members: DataFrame, key: str, limit: int | None = None) -> DataFrame:
    """id_a < id_b: pairs of classes (a, b) written out over their members, and the copies within each class.

    members: from `class_members`. A class of more than `limit` (PAIR_LIMIT) copies is shown by its representative, and
    its copies by pairs with it; which ids it holds stands in the table of classes. A limit of 0 writes all pairs out.
    """
    most = PAIR_LIMIT if limit is None else limit
    small = F.lit(True) if most == 0 else F.col("group_size") <= most
    shown = members.where(small | (F.col("id") == F.col("first_id"))).select(key, "id")
    left = class_pairs.join(shown.select(F.col(key).alias("a"), F.col("id").alias("x")), "a")
    between = left.join(shown.select(F.col(key).alias("b"), F.col("id").alias("y")), "b").select(*ordered(F.col("x"), F.col("y")))
    copies = members.where(F.col("group_size") > 1)
    within = group_pairs(copies.where(small), [key], "id").select(F.col("a").alias("id_a"), F.col("b").alias("id_b"))
    star = copies.where(~small & (F.col("id") != F.col("first_id"))).select(F.col("first_id").alias("id_a"), F.col("id").alias("id_b"))
    return between.unionByName(within).unionByName(star)


def classes(class_pairs: DataFrame, members: DataFrame, key: str) -> DataFrame:
    """id, class_id (least id of the class), class_size, links (other classes that it is linked to), a row per id: with the
    pairs of representatives the whole relation, whatever the sizes. members: from `class_members`."""
    ends = class_pairs.select(F.col("a").alias(key)).unionAll(class_pairs.select(F.col("b").alias(key)))
    links = ends.groupBy(key).agg(F.count("*").alias("links"))
    return members.join(links, key, "left").select("id", F.col("first_id").alias("class_id"), F.col("group_size").alias("class_size"), F.coalesce("links", F.lit(0)).cast("long").alias("links"))


def ordered(a, b) -> list:
    """Columns id_a, id_b of a pair in code-point order."""
    return [F.least(a, b).alias("id_a"), F.greatest(a, b).alias("id_b")]
