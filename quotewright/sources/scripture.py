"""Readers of verse files: pipe-delimited lines and XML. Rows: file, place (in the file), surah, ayah, text, bismillah."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LINE = "^(\\d{1,3})\\|(\\d{1,3})\\|(.*)$"
XML_SCHEMA = "_index int, _name string, aya array<struct<_index:int,_text:string,_bismillah:string>>"


def _lines(spark: SparkSession, path: str) -> DataFrame:
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")
    rows = whole.select("file", F.posexplode(F.split("value", "\n")).alias("line_no", "line"))
    return rows.withColumn("line", F.regexp_replace("line", "\r$", ""))


def pipe(spark: SparkSession, path: str) -> DataFrame:
    """Lines `surah|ayah|text`; the text may hold pipes. Blank lines and notices (#) are skipped; any other line raises."""
    rows = _lines(spark, path).where((F.trim("line") != "") & ~F.ltrim("line").startswith("#"))
    part = lambda n: F.regexp_extract("line", LINE, n)
    bad = F.concat(F.lit("unrecognized content at line "), (F.col("line_no") + 1).cast("string"))
    rows = rows.withColumn("surah", F.when(F.col("line").rlike(LINE), part(1).cast("int")).otherwise(F.raise_error(bad).cast("int")))
    return rows.select("file", F.col("line_no").cast("long").alias("place"), "surah", part(2).cast("int").alias("ayah"), F.trim(part(3)).alias("text"), F.lit(None).cast("string").alias("bismillah"))


def notices(spark: SparkSession, path: str) -> DataFrame:
    """file, attribution: the notice lines of a pipe file as they stand."""
    rows = _lines(spark, path).where(F.ltrim("line").startswith("#"))
    return rows.groupBy("file").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x.line), "\n").alias("attribution"))


def xml(spark: SparkSession, path: str) -> DataFrame:
    """Chapters with verses as attributes."""
    read = spark.read.format("xml").option("rowTag", "sura").schema(XML_SCHEMA).load(path)
    # a chapter's place is where its tag stands among the file's tags, which the reader numbers within the file's one part
    chapters = read.select(F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("chapter"), F.col("_index").alias("surah"), F.posexplode("aya").alias("n", "v"))
    return chapters.select("file", (F.col("chapter") * 100_000 + F.col("n")).alias("place"), "surah", F.col("v._index").alias("ayah"), F.col("v._text").alias("text"), F.col("v._bismillah").alias("bismillah"))


def xml_attribution(spark: SparkSession, path: str) -> DataFrame:
    """file, attribution: the first comment of each file."""
    whole = spark.read.text(path, wholetext=True)
    return whole.select(F.col("_metadata.file_path").alias("file"), F.regexp_extract("value", "(?s)<!--(.*?)-->", 1).alias("attribution"))


def payload() -> Column:
    """A verse as the line that digests are taken of."""
    return F.concat_ws("|", F.col("surah").cast("string"), F.col("ayah").cast("string"), "text")


def measured(verses: DataFrame) -> DataFrame:
    """file, units, sha256 of the verses of each file, in the order of the file, so that a reordered file differs. A file is
    a source of a few thousand lines that its pinned digest covers as one text; it stands in one row here."""
    lines = F.transform(F.array_sort(F.collect_list(F.struct("place", payload().alias("line")))), lambda x: x.line)
    return verses.groupBy("file").agg(F.count("*").alias("units"), F.sha2(F.array_join(lines, "\n"), 256).alias("sha256"))


def as_records(verses: DataFrame, source_id: str) -> DataFrame:
    """Verses as source rows of the corpus."""
    return verses.select(F.concat_ws(":", F.lit("quran"), F.col("surah").cast("string"), F.col("ayah").cast("string")).alias("id"), F.lit(source_id).alias("source_id"), F.lit("ayah").alias("kind"), "surah", "ayah", F.col("text").alias("text_ar"), "bismillah")
