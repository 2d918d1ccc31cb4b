"""Queries over normalisation and text functions, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quotewright.functions import normalize as norm
from quotewright.functions import similarity, spec, text
from quotewright.runtime import table

# DuckDB's regular expressions know ASCII white space only.
_WS = "'[\\s\\x{1c}-\\x{1f}\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]+'"
def _squeezed(x: str) -> str:
    return f"trim(regexp_replace({x}, {_WS}, ' ', 'g'))"


def tier_sql(tier: str, column: str) -> str:
    """DuckDB SQL of a tier of a column."""
    out = f"replace(nfc_normalize({column}), 'ـ', '')"
    if tier != "light":
        out = f"translate(regexp_replace({out}, '[\\x{{64b}}-\\x{{65f}}\\x{{670}}\\x{{6d6}}-\\x{{6ed}}]', '', 'g'), 'آأإٱ', 'اااا')"
    if tier == "aggressive":
        out = f"regexp_replace(translate({out}, 'ىة', 'يه'), '[^\\x{{600}}-\\x{{6ff}}]', ' ', 'g')"
    return _squeezed(out)


def _tier(tier: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return table(spark, sf_dir, "records").select("row_no", norm.normalize(F.col("text_ar"), tier).alias("norm_text"))

    return query


def norm_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All tiers of whole documents, as digests."""
    rows = norm.tiers(table(spark, sf_dir, "documents").select("doc_id", "text"), "text")
    return rows.select("doc_id", *[F.sha2(f"norm_{t}", 256).alias(f"{t}_sha256") for t in spec.TIERS])


def norm_idempotent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records that normalising again would change, by tier."""
    rows = norm.tiers(table(spark, sf_dir, "records").select("row_no", "text_ar"), "text_ar")
    out = None
    for t in spec.TIERS:
        part = rows.where(norm.normalize(F.col(f"norm_{t}"), t) != F.col(f"norm_{t}")).agg(F.count("*").alias("violations")).select(F.lit(t).alias("tier"), "violations")
        out = part if out is None else out.unionByName(part)
    return out


def stored_norms_differ(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored tiers that aren't what text_ar gives."""
    rows = norm.tiers(table(spark, sf_dir, "records"), "text_ar", "now_")
    bad = F.col("norm_standard").isNotNull() & ((F.col("norm_light") != F.col("now_light")) | (F.col("norm_standard") != F.col("now_standard")) | (F.col("norm_aggressive") != F.col("now_aggressive")))
    return rows.where(bad).select("row_no", "id")


def text_sha256(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "records").select("row_no", F.sha2("text_ar", 256).alias("text_sha256"))


def full_variant(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "records").select("row_no", text.full_text(F.col("text_ar"), F.col("addenda_ar")).alias("full_ar"))


def grade_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edit similarity of each spelling of a grade to its plain form, in ten thousandths."""
    g = table(spark, sf_dir, "gradings").select("grade").where(F.col("grade").isNotNull()).distinct()
    return g.select("grade", F.floor(similarity.ratio(F.col("grade"), F.lower(F.trim("grade"))) * 10000 + 0.5).cast("long").alias("ratio_1e4"))


def document_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words, Arabic script and its redaction, of whole documents."""
    t = F.col("text")
    return table(spark, sf_dir, "documents").where(t.isNotNull()).select("doc_id", text.word_count(t).cast("long").alias("words"), text.contains_arabic(t).alias("has_arabic"), F.sha2(text.redact_arabic(t), 256).alias("redacted_sha256"))


def search_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The evaluation texts as search queries."""
    return table(spark, sf_dir, "eval_cases").select("item_id", text.query_text(F.col("text")).alias("query"))


def chapter_spellings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spellings by which a chapter may be named."""
    names = table(spark, sf_dir, "records").where("surah_name_en is not null").select("surah", "surah_name_en").distinct()
    return names.select("surah", F.explode(text.spelling_variants(F.col("surah_name_en"))).alias("spelling")).distinct()


def annotated_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A mark after names, over all translations."""
    return table(spark, sf_dir, "translations").select("row_no", F.sha2(text.annotate(F.col("text"), ["teacher", "student", "king"], "†"), 256).alias("marked_sha256"))


def citation_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Printed numbers as numbers of at most 2,000."""
    n = table(spark, sf_dir, "records").where("hadith_no is not null").select("row_no", text.citation_number(F.col("hadith_no"), F.lit(2000)).alias("number"))
    return n.select("row_no", F.col("number").cast("long").alias("number"))


def cleaned_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without page, milestone and part marks, as digests."""
    return table(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.sha2(text.clean_markup(F.col("text")), 256).alias("clean_sha256"))


QUERIES = {
    "norm_light": _tier("light"), "norm_standard": _tier("standard"), "norm_aggressive": _tier("aggressive"), "norm_documents": norm_documents,
    "norm_idempotent": norm_idempotent, "stored_norms_differ": stored_norms_differ, "text_sha256": text_sha256, "full_variant": full_variant,
    "grade_similarity": grade_similarity, "document_words": document_words, "search_queries": search_queries, "chapter_spellings": chapter_spellings,
    "annotated_names": annotated_names, "citation_numbers": citation_numbers, "cleaned_documents": cleaned_documents,
}
_NORMS = {t: tier_sql(t, "text_ar") for t in spec.TIERS}
_SCRIPT = "[\\x{600}-\\x{6ff}\\x{750}-\\x{77f}\\x{870}-\\x{8ff}\\x{fb50}-\\x{fdff}\\x{fe70}-\\x{feff}]"
_SLUG = "regexp_replace(lower(strip_accents(surah_name_en)), '[^a-z]', '', 'g')"
SQL = {
    "chapter_spellings": f"WITH b AS (SELECT DISTINCT surah, {_SLUG} AS s FROM records WHERE surah_name_en IS NOT NULL), stems AS (SELECT * FROM b UNION SELECT surah, substr(s, length(a) + 1) FROM b, (SELECT unnest({text.ARTICLES}) AS a) WHERE starts_with(s, a) AND length(s) - length(a) >= 3) SELECT surah, s AS spelling FROM stems UNION SELECT surah, substr(s, 1, length(s) - 1) FROM stems WHERE s LIKE '%h'",
    **{f"norm_{t}": f"SELECT row_no, {s} AS norm_text FROM records" for t, s in _NORMS.items()},
    "norm_documents": "SELECT doc_id, " + ", ".join(f"sha256({tier_sql(t, 'text')}) AS {t}_sha256" for t in spec.TIERS) + " FROM documents",
    "norm_idempotent": " UNION ALL ".join(f"SELECT '{t}' AS tier, count(*) AS violations FROM (SELECT {s} AS n FROM records) WHERE {tier_sql(t, 'n')} <> n" for t, s in _NORMS.items()),
    "stored_norms_differ": f"SELECT row_no, id FROM records WHERE norm_standard IS NOT NULL AND (norm_light <> {_NORMS['light']} OR norm_standard <> {_NORMS['standard']} OR norm_aggressive <> {_NORMS['aggressive']})",
    "text_sha256": "SELECT row_no, sha256(text_ar) AS text_sha256 FROM records",
    "full_variant": "SELECT row_no, CASE WHEN addenda_ar IS NULL THEN text_ar ELSE text_ar || ' ' || addenda_ar END AS full_ar FROM records",
    "document_words": f"SELECT doc_id, len(list_filter(string_split(trim(regexp_replace(text, {_WS}, ' ', 'g')), ' '), lambda x: x <> ''))::BIGINT AS words, regexp_matches(text, '{_SCRIPT}') AS has_arabic, sha256(regexp_replace(text, '{_SCRIPT}+', '<arabic script redacted>', 'g')) AS redacted_sha256 FROM documents WHERE text IS NOT NULL",
    "search_queries": f"SELECT item_id, trim(concat_ws(' ', CASE WHEN regexp_matches(text, '{_SCRIPT}') THEN nullif({tier_sql('aggressive', 'text')}, '') END, nullif(trim(regexp_replace(regexp_replace(lower(text), '{_SCRIPT}', ' ', 'g'), {_WS}, ' ', 'g')), ''))) AS query FROM eval_cases",
    "annotated_names": "SELECT row_no, sha256(regexp_replace(regexp_replace(text, '\\b(teacher|student|king)\\b', '\\1 †', 'g'), ' †([''’])', '\\1', 'g')) AS marked_sha256 FROM translations",
    "grade_similarity": "SELECT DISTINCT grade, CASE WHEN length(grade) = 0 THEN 0 ELSE floor((1 - levenshtein(grade, lower(trim(grade)))::DOUBLE / length(grade)) * 10000 + 0.5)::BIGINT END AS ratio_1e4 FROM gradings WHERE grade IS NOT NULL",
    "citation_numbers": "SELECT row_no, CASE WHEN try_cast(hadith_no AS BIGINT) BETWEEN 1 AND 2000 THEN try_cast(hadith_no AS BIGINT) END AS number FROM records WHERE hadith_no IS NOT NULL",
    "cleaned_documents": f"SELECT doc_id, sha256(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, 'PageV\\d+P\\d+', ' ', 'g'), 'ms\\d+', ' ', 'g'), '\\\\ \\d+ \\\\', ' ', 'g'), '@QB@|@QE@', ' ', 'g'), {_WS}, ' ', 'g'))) AS clean_sha256 FROM documents WHERE text IS NOT NULL",
}
