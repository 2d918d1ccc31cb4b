"""Lexical search: an inverted index as tables, BM25 top lists, and the fusion of ranked lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quotewright.functions.text import index_tokens
from quotewright.operators.skew import hot_keys, meet
from quotewright.runtime import written

#: Fixed values of the score: saturation, length weight, and the least weight of a word that stands in most texts.
K1, B, LEAST_IDF = 1.2, 0.75, 1e-6
#: Scores are compared and returned as whole millionths, so that sums in another order rank alike.
UNIT = 1_000_000


def postings(texts: DataFrame, columns: list[str]) -> DataFrame:
    """doc_id, token, tf, doc_len over all `columns` together. texts: doc_id and the columns; a null counts as empty."""
    tokens = F.flatten(F.array(*[F.coalesce(index_tokens(F.col(c)), F.expr("array()").cast("array<string>")) for c in columns]))
    rows = texts.select("doc_id", tokens.alias("tokens")).withColumn("doc_len", F.size("tokens"))
    return rows.select("doc_id", "doc_len", F.explode("tokens").alias("token")).groupBy("doc_id", "token", "doc_len").agg(F.count("*").alias("tf"))


def bm25(index: DataFrame, lengths: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """query_id, doc_id, score, rank: the k best documents of each query, ties by doc_id.

    index: from `postings`. lengths: doc_id, doc_len of all documents, also of empty ones. queries: query_id, tokens; a
    token that a query repeats counts as often. Document frequencies are counted for the queries' words only, and
    scores are summed before the shuffle.
    """
    asked = written(queries.select("query_id", F.explode("tokens").alias("token")).groupBy("query_id", "token").agg(F.count("*").alias("times")), "asked_words")
    # the asked words' postings, read once: counted, then spread where a word stands in most texts
    hits = written(index.join(asked.select("token").distinct(), "token", "left_semi"), "hits")
    df = written(hits.groupBy("token").agg(F.count("*").alias("df")), "frequencies")
    n, average = lengths.agg(F.count("*"), F.avg("doc_len")).first()
    idf = F.log((F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weighed = asked.join(df, "token").select("query_id", "token", (F.when(idf > 0, idf).otherwise(LEAST_IDF) * F.col("times")).alias("weight"))
    part = F.col("weight") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("doc_len") / F.lit(average)))
    scored = meet(hits, weighed, ["token"], hot_keys(df, ["token"], "df")).groupBy("query_id", "doc_id").agg(F.floor(F.sum(part) * UNIT + 0.5).cast("long").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k)


def lengths_of(texts: DataFrame, columns: list[str]) -> DataFrame:
    """doc_id, doc_len of all documents."""
    return texts.select("doc_id", sum(F.coalesce(F.size(index_tokens(F.col(c))), F.lit(0)) for c in columns).alias("doc_len"))


def distinct_records(ranked: DataFrame, record_of: str, k: int) -> DataFrame:
    """query_id, record_id, rank: of a ranked list of representations the best rank of each record, the first k of them."""
    best = ranked.groupBy("query_id", F.col(record_of).alias("record_id")).agg(F.min("rank").alias("first"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("first", "record_id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "record_id", "rank")


def first_seen(ranked: DataFrame, k: int) -> DataFrame:
    """query_id, record_id, rank: records of a query's terms in the order in which they first appear, terms in turn.
    ranked: query_id, term_no, record_id, rank."""
    at = ranked.groupBy("query_id", "record_id").agg(F.min(F.struct("term_no", "rank")).alias("at"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("at", "record_id"))
    return at.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "record_id", "rank")


def fuse(lists: list[DataFrame], k: int, constant: int = 60) -> DataFrame:
    """query_id, record_id, score, rank: the sum over the lists of 1 / (constant + rank from 0), in whole billionths,
    the k best, ties by record_id. A list: query_id, record_id, rank from 1."""
    rows = None
    for ranked in lists:
        part = ranked.select("query_id", "record_id", "rank")
        rows = part if rows is None else rows.unionByName(part)
    gain = F.floor(F.lit(1_000_000_000) / (constant + F.col("rank") - 1)).cast("long")
    total = rows.groupBy("query_id", "record_id").agg(F.sum(gain).alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "record_id"))
    return total.withColumn("rank", rank).where(F.col("rank") <= k)


def hamming_topk(queries: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """query_id, record_id, distance, rank: the k nearest of a stated query set, by bits that differ, ties by record_id.

    The queries are a set of bounded size, counted and sent to every task; each task keeps its k best of each query
    before the shuffle. queries: query_id, vec; vectors: record_id, vec; vectors of another length are left out.
    """
    from quotewright.operators.hamming import nearest_of

    return nearest_of(queries, vectors, k)


def reached(found: DataFrame, records: DataFrame) -> DataFrame:
    """query_id, kind, reached: whether a query's list holds a record of the kind."""
    kinds = records.select(F.col("id").alias("record_id"), "kind").distinct()
    return found.join(kinds, "record_id").groupBy("query_id", "kind").agg((F.count("*") > 0).alias("reached"))
