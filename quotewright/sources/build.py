"""From pinned files to a corpus: read by format, gate, join into records, derive, index, check.

Each step takes and returns DataFrames; `build` writes its tables once and returns them by name.
"""

from __future__ import annotations

from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quotewright.operators import corpus, search
from quotewright.sources import manifest, markdown, scripture

# The columns of source rows that are kept as sent.
SOURCE_COLUMNS = ["id", "source_id", "kind", "surah", "ayah", "collection", "book_no", "chapter_ar", "hadith_no", "numbering_scheme", "text_ar", "bismillah", "isnad_ar", "addenda_ar", "unscorable_reason", "reference_display"]
_TYPES = {"surah": "int", "ayah": "int", "book_no": "int"}


def reader(kind: str) -> Callable[[SparkSession, str], DataFrame]:
    """The reader of a format; an unknown one raises ManifestError."""
    if kind == "xml":
        return scripture.xml
    if kind == "txt-2":
        return scripture.pipe
    raise manifest.ManifestError(f"no verse reader for {kind!r}")


def cached(source: dict, cache: str) -> Path:
    """Where a source stands in the cache, once it has passed its gate."""
    return Path(cache) / manifest.cache_name(source["id"], source["format"], source["url"])


def fetch(source: dict, cache: str, download: Callable[[str], str] | None = None) -> str:
    """The path of a source: in the cache, or else of what the given function downloads, beside the cache until `keep`
    moves it there after its gate. Without a function a source that isn't cached raises ManifestError."""
    path = cached(source, cache)
    if path.is_file():
        return str(path)
    if download is None:
        raise manifest.ManifestError(f"{source['id']} isn't in the cache, and nothing may be downloaded")
    waiting = path.parent / "ungated" / path.name
    waiting.parent.mkdir(parents=True, exist_ok=True)
    waiting.write_text(download(source["url"]), encoding="utf-8")
    return str(waiting)


def gated(source: dict, path: str, cache: str, check: Callable[[], None]) -> str:
    """The path of a source in the cache, after `check` found nothing; what it refuses is removed, never cached."""
    try:
        check()
    except corpus.GateError:
        if Path(path) != cached(source, cache):
            Path(path).unlink(missing_ok=True)
        raise
    if Path(path) != cached(source, cache):
        Path(path).replace(cached(source, cache))
    return str(cached(source, cache))


def shaped(rows: DataFrame) -> DataFrame:
    """rows with all source columns, nulls where they have none."""
    return rows.select(*[F.col(c).cast(_TYPES.get(c, "string")).alias(c) if c in rows.columns else F.lit(None).cast(_TYPES.get(c, "string")).alias(c) for c in SOURCE_COLUMNS])


def check_records(records: DataFrame) -> None:
    """GateError for repeated ids, blank texts and citations that two records show."""
    corpus.require_empty(records.groupBy("id").agg(F.count("*").alias("n")).where("n > 1"), "repeated ids")
    corpus.require_empty(records.where("text_ar is null or trim(text_ar) = ''").select("id"), "blank texts")
    corpus.require_empty(corpus.duplicate_values(records, "reference_display"), "citations shown twice")


def check_translations(translations: DataFrame, records: DataFrame) -> None:
    """GateError for translations of records that aren't there."""
    missing = translations.join(records.select(F.col("id").alias("record_id")), "record_id", "left_anti").select("record_id").distinct()
    corpus.require_empty(missing, "translations without a record")


def materialize(records: DataFrame, translations: DataFrame, path: str) -> dict[str, DataFrame]:
    """Derived tables of a source-only corpus, written under path: records, variants, translations, postings, lengths, and
    the report of stray signs as CSV. Gates: complete
    derivation; no record that may be scored stands whole within a chapter of verses, of which there must be some."""
    spark = records.sparkSession

    def put(name: str, df: DataFrame) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{path}/{name}")
        return spark.read.parquet(f"{path}/{name}")

    full = put("records", corpus.derive(records))
    variants = put("variants", corpus.variants(full))
    corpus.require_empty(corpus.incomplete(full), "incomplete records")
    base = full.where("kind = 'ayah'").select("surah", "ayah", F.col("norm_standard").alias("text"))
    if base.isEmpty():
        raise corpus.GateError("no verses: the containment gate would pass without meaning")
    scored = full.where("kind = 'hadith' and unscorable_reason is null").select("id", F.col("norm_standard").alias("text"))
    held = scored.unionByName(variants.join(full.where("kind = 'hadith'").select(F.col("id").alias("record_id")), "record_id").select(F.col("record_id").alias("id"), F.col("norm_standard").alias("text")))
    corpus.require_empty(corpus.whole_in_group(held, base, "surah", "ayah"), "records that are wholly a quotation")
    put("translations", translations)
    texts = indexed_texts(full, variants, translations)
    columns = ["norm_standard", "norm_aggressive", "translation"]
    corpus.noise_report(full.select("id", F.col("text_ar").alias("text"))).orderBy(F.desc("n_ids"), "sign").coalesce(1).write.mode("overwrite").option("header", True).csv(f"{path}/noise")
    return {"records": full, "variants": variants, "postings": put("postings", search.postings(texts, columns)), "lengths": put("lengths", search.lengths_of(texts, columns))}


def indexed_texts(records: DataFrame, variants: DataFrame, translations: DataFrame) -> DataFrame:
    """doc_id (record and variant), record_id, norms and translation of all that is searched; a translation only beside
    the primary, as all of a record's joined in order."""
    joined = translations.groupBy("record_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("source_id", "text"))), lambda x: x.text), " ").alias("translation"))
    primary = records.where("unscorable_reason is null").select(F.col("id").alias("record_id"), F.lit(corpus.PRIMARY).alias("variant"), "norm_standard", "norm_aggressive").join(joined, "record_id", "left")
    full = variants.select("record_id", "variant", "norm_standard", "norm_aggressive", F.lit(None).cast("string").alias("translation"))
    return primary.unionByName(full).withColumn("doc_id", F.concat_ws("\x1f", "record_id", "variant"))


def markdown_measured(spark: SparkSession, path: str, book: markdown.Book) -> DataFrame:
    """units, sha256 of a markdown file: one row."""
    count = markdown.read(spark, path, book).count()
    return manifest.digests(spark, path).select(F.lit(count).alias("units"), "sha256")


def build(spark: SparkSession, manifest_path: str, cache: str, out: str, books: dict[str, markdown.Book], titles: dict[str, str], download: Callable[[str], str] | None = None, curation: DataFrame | None = None) -> dict[str, DataFrame]:
    """The corpus of a manifest, written under `out`: verses, then books, then verse files of other languages as
    translations. Sources that aren't what they are pinned to, and references to nothing, raise; a download is cached
    after its gate. books, titles: by collection; without them a book is read without cuts under its source's title.
    `curation` (record_id, text_sha256, reason) must apply in full."""
    records, translations = None, None
    for e in manifest.entries(Path(manifest_path).read_text(encoding="utf-8")):
        path = fetch(e, cache, download)
        one = spark.createDataFrame([tuple(e.get(c) for c in [*manifest.REQUIRED, *manifest.OPTIONAL])], manifest.SCHEMA)
        book = books.get(e["collection"], markdown.Book(e["collection"])) if e["format"] == "openiti-markdown" else None

        def check(e=e, path=path, one=one, book=book) -> None:
            measured = markdown_measured(spark, path, book) if book else scripture.measured(reader(e["format"])(spark, path))
            corpus.require_empty(manifest.gate(one, measured.select(F.lit(e["id"]).alias("id"), "units", "sha256")), f"source {e['id']}")

        path = gated(e, path, cache, check)
        if book:
            title = titles.get(e["collection"], e["title"])
            rows = shaped(markdown.as_records(markdown.read(spark, path, book), e["id"], e["collection"], title, e.get("numbering_scheme", "")))
            corpus.require_empty(rows.where(~F.col("id").startswith(f"hadith:{e['collection']}:")).select("id"), "ids of another collection")
        else:
            rows = shaped(scripture.as_records(reader(e["format"])(spark, path), e["id"]).withColumn("reference_display", F.concat_ws(":", F.col("surah").cast("string"), F.col("ayah").cast("string"))))
        if e["kind"] == "translation":
            part = rows.select(F.col("id").alias("record_id"), "source_id", F.lit("en").alias("lang"), F.col("text_ar").alias("text"))
            translations = part if translations is None else translations.unionByName(part)
        else:
            records = rows if records is None else records.unionByName(rows)
    if records is None:
        raise manifest.ManifestError("the manifest names no text")
    if translations is None:
        translations = spark.createDataFrame([], "record_id string, source_id string, lang string, text string")
    check_records(records)
    if curation is not None:
        records, open_ = corpus.curate(records, curation)
        corpus.require_empty(open_, "curation that doesn't apply")
    check_translations(translations, records)
    return materialize(records, translations, out)
