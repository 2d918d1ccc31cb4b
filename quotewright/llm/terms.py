"""Frequency of every distinct term: heavy-light aggregation.

A first pass over all rows finds the heaviest terms; their list is broadcast (at most HEAVY terms). In the second
pass every task counts the heavy terms in plain counter arrays and sends one row per heavy term, while the
remaining terms go through the shuffle. The union of both tables is exact whatever the first pass found.

A record counts once, by its id, however often its row was sent. Texts stay in their tasks for that: ids alone are
counted first, and only rows whose id may stand more than once, by a filter of bounded size, meet in a shuffle. Null ids and null values are left out; an empty
string holds no word but is a value; a null in another column changes nothing; empty tables give no terms.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quotewright.operators.bloom import filter_words, may_hold
from quotewright.runtime import ship_code, written

#: Most terms kept as heavy in all, most candidates that one task proposes, and what it remembers between batches.
HEAVY, PROPOSED, REMEMBERED = 512, 512, 65536
LIGHT, HEAVY_ROW, TOTAL, REPEATED = 0, 1, 2, 3
_PARTIAL = "field_name string, term string, occurrences long, n_ids long, kind int, id string, fields array<string>"


def _terms(column: pa.Array, split: bool) -> tuple[pa.Array, np.ndarray]:
    """All terms of a column one after another, and for each the row it stands in."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not split:
        keep = pc.indices_nonzero(column.is_valid())
        return column.take(keep), keep.to_numpy().astype(np.int64)
    lists = pc.split_pattern(column.fill_null(""), " ")
    words, row = pc.list_flatten(lists), pc.list_parent_indices(lists).to_numpy().astype(np.int64)
    keep = pc.not_equal(words, "")
    return words.filter(keep), row[keep.to_numpy(zero_copy_only=False)]


def _encoded(words: pa.Array) -> tuple[pa.Array, np.ndarray]:
    d = words.dictionary_encode()
    return d.dictionary, d.indices.to_numpy(zero_copy_only=False).astype(np.int64)


def _propose(fields: dict[str, bool]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, Counter] = {f: Counter() for f in fields}
        for b in batches:
            for i, (f, split) in enumerate(fields.items()):
                terms, codes = _encoded(_terms(b.column(i), split)[0])
                n = np.bincount(codes, minlength=len(terms))
                top = np.argsort(-n, kind="stable")[:REMEMBERED]
                for t, k in zip(terms.take(pa.array(top)).to_pylist(), n[top].tolist()):
                    seen[f][t] += k
                if len(seen[f]) > 2 * REMEMBERED:
                    seen[f] = Counter(dict(seen[f].most_common(REMEMBERED)))
        rows = [(f, t, k) for f, c in seen.items() for t, k in c.most_common(PROPOSED)]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.int64())], names=["field_name", "term", "occurrences"])

    return run


def _batch(columns: list, repeated: tuple[pa.Array, list[pa.Array]] | None = None) -> pa.RecordBatch:
    names = [c.split()[0] for c in _PARTIAL.split(", ")]
    if repeated is None:
        n = len(columns[0])
        return pa.RecordBatch.from_arrays([*columns, pa.nulls(n, pa.string()), pa.nulls(n, pa.list_(pa.string()))], names=names)
    ids, fields = repeated
    n, width = len(ids), len(fields)
    order = (np.arange(n)[:, None] + np.arange(width) * n).ravel()
    lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * width, pa.int32()), pa.concat_arrays(fields).take(pa.array(order)))
    return pa.RecordBatch.from_arrays([pa.nulls(n, pa.string()), pa.nulls(n, pa.string()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.array(np.full(n, REPEATED), pa.int32()), ids, lists], names=names)


def _count(fields: dict[str, bool], heavy: dict[str, list[str]], repeated=None):
    """Counts of a batch's rows, columns as `fields`; with a filter of `repeated` ids, columns id, h1, h2 come after them,
    and rows that it holds are passed on uncounted."""

    def rows(field: str, terms: pa.Array, occurrences: np.ndarray, ids: np.ndarray, kind: int) -> pa.RecordBatch:
        n = len(terms)
        return _batch([pa.array([field] * n, pa.string()), terms.cast(pa.string()), pa.array(occurrences, pa.int64()), pa.array(ids, pa.int64()), pa.array(np.full(n, kind), pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = {f: pa.array(heavy.get(f, []), pa.string()) for f in fields}
        local = {f: [np.zeros(len(index[f]), np.int64), np.zeros(len(index[f]), np.int64), 0] for f in fields}
        for b in batches:
            if repeated is not None:
                again = may_hold(repeated.value, *[b.column(len(fields) + k).to_numpy().view(np.uint64) for k in (1, 2)])
                more = b.filter(pa.array(again))
                if len(more):
                    yield _batch([], (more.column(len(fields)), [more.column(i).cast(pa.string()) for i in range(len(fields))]))
                b = b.filter(pa.array(~again))
            for i, (f, split) in enumerate(fields.items()):
                local[f][2] += len(b) - b.column(i).null_count
                words, row = _terms(b.column(i), split)
                if not len(words):
                    continue
                terms, codes = _encoded(words)
                occurrences = np.bincount(codes, minlength=len(terms))
                once = np.unique(row * len(terms) + codes) % len(terms)
                ids = np.bincount(once, minlength=len(terms))
                slot = pc.index_in(terms, index[f]).fill_null(-1).to_numpy(zero_copy_only=False)
                at = slot >= 0
                local[f][0][slot[at]] += occurrences[at]
                local[f][1][slot[at]] += ids[at]
                yield rows(f, terms.filter(pa.array(~at)), occurrences[~at], ids[~at], LIGHT)
        for f, (occurrences, ids, values) in local.items():
            there = occurrences > 0
            yield rows(f, index[f].filter(pa.array(there)), occurrences[there], ids[there], HEAVY_ROW)
            yield rows(f, pa.array([None], pa.string()), np.array([0]), np.array([values]), TOTAL)

    return run


def term_counts(df: DataFrame, id_col: str, fields: dict[str, bool], rare_below: int = 3, common_above: tuple[int, int] = (1, 5)) -> DataFrame:
    """field_name, term, occurrences, n_ids, freq_mark of every term of each field.

    fields: column -> whether its value is split at single spaces (else the value is one term). freq_mark is `rare`
    below `rare_below` ids, `common` above the share `common_above` (as a fraction) of the ids with a value, else null.
    Terms are compared as stored.
    """
    spark = df.sparkSession
    ship_code(spark)
    named = df.select(F.col(id_col).alias("id"), *fields).where(F.col("id").isNotNull())
    proposed = named.select(*fields).mapInArrow(_propose(fields), "field_name string, term string, occurrences long")
    heavy: dict[str, list[str]] = {}
    for r in proposed.groupBy("field_name", "term").agg(F.sum("occurrences").alias("n")).orderBy(F.desc("n"), "field_name", "term").limit(HEAVY).collect():
        heavy.setdefault(r.field_name, []).append(r.term)
    keyed = named.select(F.xxhash64("id").alias("h1"), F.xxhash64("id", F.lit(7)).alias("h2"))
    again = written(keyed.groupBy("h1", "h2").agg(F.count("*").alias("rows")).where("rows > 1").select("h1", "h2"), "repeated")
    held = spark.sparkContext.broadcast(filter_words(again, again.count()))
    wide = named.select(*fields, F.col("id").cast("string").alias("id"), F.xxhash64("id").alias("h1"), F.xxhash64("id", F.lit(7)).alias("h2"))
    most = written(wide.mapInArrow(_count(fields, heavy, held), _PARTIAL), "terms")
    once = most.where(F.col("kind") == REPEATED).groupBy("id").agg(F.min("fields").alias("fields")).select(*[F.col("fields")[i].alias(f) for i, f in enumerate(fields)])
    partial = most.where(F.col("kind") != REPEATED).unionByName(written(once.mapInArrow(_count(fields, heavy), _PARTIAL), "terms_once"))
    total = {r.field_name: r.n for r in partial.where(F.col("kind") == TOTAL).groupBy("field_name").agg(F.sum("n_ids").alias("n")).collect()}
    both = [partial.where(F.col("kind") == k).groupBy("field_name", "term").agg(F.sum("occurrences").alias("occurrences"), F.sum("n_ids").alias("n_ids")) for k in (HEAVY_ROW, LIGHT)]
    of = F.create_map(*[F.lit(x) for f in fields for x in (f, total.get(f, 0))])[F.col("field_name")]
    part, whole = common_above
    mark = F.when(F.col("n_ids") < rare_below, "rare").when(F.col("n_ids") * whole > of * part, "common")
    return both[0].unionByName(both[1]).withColumn("freq_mark", mark)
