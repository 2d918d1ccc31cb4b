"""What a caller asks of a corpus: verify texts, search, fetch records, describe the corpus."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quotewright.functions.text import index_tokens, join_with_and, query_text
from quotewright.operators import corpus, extract, rules, search, verify
from quotewright.runtime import written


@dataclass(frozen=True)
class Corpus:
    """The tables of a built corpus."""

    records: DataFrame
    variants: DataFrame
    translations: DataFrame
    sources: DataFrame
    postings: DataFrame
    lengths: DataFrame

    @classmethod
    def load(cls, spark: SparkSession, path: str, sources: DataFrame) -> Corpus:
        t = {n: spark.read.parquet(f"{path}/{n}") for n in ("records", "variants", "translations", "postings", "lengths")}
        return cls(t["records"], t["variants"], t["translations"], sources, t["postings"], t["lengths"])


def verify_texts(texts: DataFrame, c: Corpus, grammar: extract.Grammar, handed_on: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(matches of every quotation, outcome of every text). texts: doc_id, text, of the length that a request may have;
    handed_on: doc_id, handoff."""
    asked = texts.where(rules.request_problem("verify", F.col("text")).isNull())
    spans = written(extract.quotations(asked, "doc_id", "text", grammar).withColumn("span_id", F.concat_ws(":", F.col("doc_id").cast("string"), F.col("span_no").cast("string"))), "quotations")
    found = verify.verify(spans, c.records, corpus.representations(c.records, c.variants))
    matches = spans.join(found, "span_id")
    return matches, rules.overall(matches, "doc_id", handed_on)


def find(queries: DataFrame, c: Corpus, limit: int) -> DataFrame:
    """query_id, record_id, rank of search queries (query_id, q) in either script; blank queries find nothing."""
    limit = max(1, min(100, limit))
    tokens = F.filter(index_tokens(query_text(F.col("q"))), lambda t: F.length(t) > 1)
    ranked = search.bm25(c.postings, c.lengths, queries.select("query_id", tokens.alias("tokens")), 2 * limit)
    return search.distinct_records(ranked.withColumn("record_id", F.split("doc_id", "\x1f")[0]).drop("doc_id"), "record_id", limit)


def records_of(ids: DataFrame, c: Corpus, lang: str = "en") -> DataFrame:
    """The records of ids (id) with one translation and their source each, in one join for all."""
    rows = corpus.translations_of(c.records.join(ids.select("id").distinct(), "id", "left_semi"), c.translations, lang)
    sources = c.sources.select(F.col("id").alias("source_id"), F.col("title").alias("source_title"), "license_id", "attribution")
    return rows.join(sources, "source_id", "left")


def describe(c: Corpus, titles: dict[str, str]) -> DataFrame:
    """scope: one sentence on what the corpus holds, in the order of `titles`; kinds and collections without a title are
    left out."""
    held = corpus.scope(c.records).select(F.coalesce("collection", "kind").alias("key")).distinct()
    order = {k: n for n, k in enumerate(titles)}
    named = held.where(F.col("key").isin(list(titles))).select(F.struct(F.create_map(*[F.lit(x) for k, n in order.items() for x in (k, n)])[F.col("key")].alias("n"), F.create_map(*[F.lit(x) for k, t in titles.items() for x in (k, t)])[F.col("key")].alias("title")).alias("s"))
    listed = named.agg(F.transform(F.array_sort(F.collect_list("s")), lambda s: s.title).alias("titles"))  # at most one row a title
    return listed.select(F.when(F.size("titles") > 0, F.concat(F.lit("This corpus contains "), join_with_and(F.col("titles")), F.lit("."))).otherwise("This corpus does not yet contain any source.").alias("scope"))


def claim_check(claims: DataFrame, c: Corpus, per_term: int = 20, per_claim: int = 10) -> DataFrame:
    """claim_no, record_id, rank: candidates of each claim by its terms in turn. claims: claim_no, terms (array)."""
    rows = claims.select("claim_no", F.posexplode("terms").alias("term_no", "q"))
    asked = rows.select(F.concat_ws(":", F.col("claim_no").cast("string"), F.col("term_no").cast("string")).alias("query_id"), "q")
    got = find(asked, c, per_term)
    part = F.split("query_id", ":")
    ranked = got.select(part[0].cast("int").alias("query_id"), part[1].cast("int").alias("term_no"), "record_id", "rank")
    return search.first_seen(ranked, per_claim).withColumnRenamed("query_id", "claim_no")


def assessed(claims: DataFrame, verdicts: DataFrame, candidates: DataFrame) -> DataFrame:
    """claim_no, claim, verdict, record_id: a provider's verdicts, matched to claims by number; cited records that aren't
    candidates of the claim are left out, and a claim without a cited record keeps a row."""
    cited = verdicts.select("claim_no", "verdict", F.explode_outer("record_ids").alias("record_id"))
    known = candidates.select("claim_no", "record_id", F.lit(True).alias("known"))
    rows = claims.select("claim_no", "claim").join(cited, "claim_no", "left").join(known, ["claim_no", "record_id"], "left")
    kept = rows.withColumn("record_id", F.when(F.col("known"), F.col("record_id")))
    return kept.groupBy("claim_no", "claim", "verdict", "record_id").agg(F.count("*").alias("n")).drop("n")


def segments(texts: DataFrame, spans: DataFrame) -> DataFrame:
    """doc_id, segment_no, text, span_no: each text in pieces, in order, those of a span and those between; together they
    are the text. texts: doc_id, text; spans: doc_id, span_no, span_start, span_end, none overlapping another."""
    cuts = spans.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("span_start", "span_end", "span_no"))).alias("s"))
    rows = texts.join(cuts, "doc_id", "left").withColumn("s", F.coalesce("s", F.expr("array()").cast("array<struct<span_start:int,span_end:int,span_no:int>>")))
    ends = F.transform(F.sequence(F.lit(0), F.size("s")), lambda i: F.struct(F.when(i == 0, 0).otherwise(F.get("s", i - 1).span_end).alias("a"), F.when(i == F.size("s"), F.length("text")).otherwise(F.get("s", i).span_start).alias("b"), F.lit(None).cast("int").alias("span_no")))
    own = F.transform("s", lambda x: F.struct(x.span_start.alias("a"), x.span_end.alias("b"), x.span_no.alias("span_no")))
    pieces = F.filter(F.array_sort(F.concat(ends, own)), lambda p: p.b > p.a)
    return rows.select("doc_id", "text", F.posexplode(pieces).alias("segment_no", "p")).select("doc_id", "segment_no", F.substr("text", F.col("p.a") + 1, F.col("p.b") - F.col("p.a")).alias("text"), "p.span_no")
