"""Long exact spans shared between records.

Sliding spans: every run of `span` consecutive units is hashed and joined globally. The unit is the word, since the
normalised texts carry no sentence ends. Equal texts are one class. A span is known by 128 bits of two hashes.

Two texts that share a long passage share all its spans; only the one that begins it proposes the pair: the words
before it differ, or a text begins there. A first pass finds the spans before which different words stand, with 24
bytes a span in the shuffle; a filter of bounded size then keeps only what may be such a span.

Words stand between single spaces, as stored. Null ids and null texts take no part; a text shorter than the span
shares nothing; repeated rows of an id count once; a span repeated only within one record is not shared.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quotewright.llm.arrays import mix
from quotewright.llm.pairs import class_members, classes, expand, group_pairs
from quotewright.llm.words import chained, windows, word_hashes, word_pairs
from quotewright.operators.bloom import filter_words, may_hold
from quotewright.operators.skew import hot_keys, meet
from quotewright.runtime import ship_code, written


def _own(keys: pa.Array) -> np.ndarray:
    """A number for each text, of its key."""
    return np.frombuffer(b"".join(k[:8] for k in keys.to_pylist()), np.uint64)


def _before(words: np.ndarray, at: np.ndarray, text: np.ndarray, position: np.ndarray, own: np.ndarray) -> np.ndarray:
    """A number for the word before each span, the text's own number where there is none."""
    start = at[text] + position
    return np.where(position > 0, mix(words[np.maximum(start, 1) - 1] ^ np.uint64(0xA5A5A5A5A5A5A5A5)) if len(words) else np.uint64(0), own[text])


def _marked(span: int, before: bool):
    """Every span with the number of the word before it, or of its text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words, at = word_hashes(b.column(1))
            hashes, text, position = windows(words, at, span)
            own = _own(b.column(0))
            mark = _before(words, at, text, position, own) if before else own[text]
            yield pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64)), pa.array(mark.view(np.int64))], names=["w", "mark"])

    return run


def _candidates(held, span: int):
    """Spans that the filter lets pass, with their second hash, text, position and what stands before them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = held.value
        for b in batches:
            words, second, at = word_pairs(b.column(1))
            hashes, text, position = windows(words, at, span)
            keep = may_hold(table, hashes, hashes >> np.uint64(32))
            hashes, text, position = hashes[keep], text[keep], position[keep]
            before = _before(words, at, text, position, _own(b.column(0)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(hashes.view(np.int64)), pa.array(chained(second, at[text] + position, span).view(np.int64)), b.column(0).take(pa.array(text)), pa.array(before.view(np.int64)), pa.array(position, pa.int32())],
                names=["w", "v", "t", "before", "position"],
            )

    return run


def _inputs(df: DataFrame, id_col: str, text_col: str, span: int) -> tuple[DataFrame, DataFrame]:
    """members (id, t) and texts (t, text) of at least `span` words; t is a text's 128-bit digest."""
    ship_code(df.sparkSession)
    rows = df.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text")).where(F.col("id").isNotNull() & F.col("text").isNotNull())
    rows = rows.where(F.col("text").rlike(f"^ *(?:[^ ]+ +){{{span - 1}}}[^ ]")).withColumn("t", F.unhex(F.md5("text")))
    return rows.select("id", "t").distinct(), rows.select("t", "text")


def _spans(texts: DataFrame, span: int, before: bool) -> DataFrame:
    """w, v, t, before, position of the spans that different words stand before, or, else, that different texts hold."""
    spark = texts.sparkSession
    mixed = texts.mapInArrow(_marked(span, before), "w long, mark long").groupBy("w").agg(F.min("mark").alias("low"), F.max("mark").alias("high")).where("low <> high")
    keys = written(mixed.select("w"), "span_keys")
    hashes = keys.select(F.col("w").alias("h1"), F.shiftrightunsigned("w", 32).alias("h2"))
    held = spark.sparkContext.broadcast(filter_words(hashes, keys.count()))
    return texts.mapInArrow(_candidates(held, span), "w long, v long, t binary, before long, position int")


def _linked(texts: DataFrame, span: int) -> DataFrame:
    """a < b: pairs of texts that share a span."""
    places = _spans(texts, span, True).select("w", "v", "t", "before").distinct()
    places = written(places, "spans")
    stats = places.groupBy("w", "v").agg(F.count("*").alias("group_size"), F.min("before").alias("low"), F.max("before").alias("high"))
    stats = written(stats.where("low <> high").select("w", "v", "group_size"), "stats")
    grouped = meet(places, stats, ["w", "v"], hot_keys(stats, ["w", "v"], "group_size"))
    return group_pairs(grouped, ["w", "v"], "t", ["before"]).where("a_before <> b_before").select("a", "b").distinct()


def shared_span_pairs(df: DataFrame, id_col: str, text_col: str, span: int = 12, limit: int | None = None) -> DataFrame:
    """id_a < id_b of ids whose texts have at least `span` consecutive words in common.

    Pairs of different texts are all given. Copies of one text give all pairs up to `limit` ids (500; 0 for no limit),
    beyond that each id with the first one, which then stands for the class in pairs with other texts; the ids of each
    class stand in `span_classes`.
    """
    members, texts = _inputs(df, id_col, text_col, span)
    return expand(_linked(texts, span), class_members(members, "t"), "t", limit)


def span_classes(df: DataFrame, id_col: str, text_col: str, span: int = 12) -> DataFrame:
    """id, class_id, class_size, links: a row for every id whose text has at least `span` words, with the class of its equal
    texts and the number of other texts that share a span with it."""
    members, texts = _inputs(df, id_col, text_col, span)
    return classes(_linked(texts, span), class_members(members, "t"), "t")


def shared_share(df: DataFrame, id_col: str, text_col: str, span: int = 12) -> DataFrame:
    """id, n_words, shared_words, repeated_words, shared_percent: of each record, the words covered by spans that stand in other
    records too, and those covered by a span whose first record (by id) is another: what a clean-up would remove."""
    members, texts = _inputs(df, id_col, text_col, span)
    held = class_members(members, "t")
    first = written(held.select("t", "group_size", "first_id").distinct(), "text_classes")
    places = written(_spans(texts, span, False).select("w", "v", "t", "position").distinct(), "places")
    known = meet(places, first.select("t", "first_id"), ["t"], None)
    stats = known.groupBy("w", "v").agg(F.count("*").alias("rows"), F.min("t").alias("low"), F.max("t").alias("high"), F.min("first_id").alias("first_holder")).where("low <> high")
    stats = written(stats.select("w", "v", "rows", "first_holder"), "stats")
    shared = written(meet(known, stats.drop("rows"), ["w", "v"], hot_keys(stats, ["w", "v"], "rows")).select("t", "position", (F.col("first_id") != F.col("first_holder")).alias("repeated")), "shared")

    def covered(rows: DataFrame, name: str) -> DataFrame:
        following = F.lead("position").over(Window.partitionBy("t").orderBy("position"))
        return rows.withColumn("adds", F.least(F.lit(span), F.coalesce(following - F.col("position"), F.lit(span)))).groupBy("t").agg(F.sum("adds").alias(name))

    per = first.join(covered(shared, "shared_words"), "t", "left").join(covered(shared.where("repeated"), "repeated_words"), "t", "left").drop("group_size", "first_id")
    mine = meet(held, per, ["t"], hot_keys(first, ["t"], "group_size"))
    rows = df.select(F.col(id_col).cast("string").alias("id"), F.size(F.filter(F.split(F.col(text_col), " "), lambda x: x != "")).cast("long").alias("n_words"), F.col(text_col).isNotNull().alias("there"))
    counts = rows.where("there and id is not null").groupBy("id").agg(F.max("n_words").alias("n_words"))
    whole = F.col("group_size") > 1  # a copy is shared from its first word to its last
    shared_words = F.when(whole, F.col("n_words")).otherwise(F.coalesce("shared_words", F.lit(0)))
    repeated = F.when(whole & (F.col("id") != F.col("first_id")), F.col("n_words")).otherwise(F.coalesce("repeated_words", F.lit(0)))
    out = counts.join(mine.select("id", "group_size", "first_id", "shared_words", "repeated_words"), "id", "left")
    out = out.select("id", "n_words", F.coalesce(shared_words, F.lit(0)).cast("long").alias("shared_words"), F.coalesce(repeated, F.lit(0)).cast("long").alias("repeated_words"))
    return out.withColumn("shared_percent", F.when(F.col("n_words") > 0, F.floor(100 * F.col("shared_words") / F.col("n_words"))).otherwise(0).cast("long"))
