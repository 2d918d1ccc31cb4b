"""The manifest of pinned sources, and the gate that a fetched source must pass."""

from __future__ import annotations

import hashlib
import re
import tomllib
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# What a manifest entry must have, and the field that counts its units, by format.
REQUIRED = ["id", "kind", "format", "title", "url", "license_id", "content_sha256", "modifications"]
COUNTED_BY = {"xml": "expected_lines", "txt-2": "expected_lines", "openiti-markdown": "expected_records"}
OPTIONAL = ["expected_lines", "expected_records", "commit", "publisher", "edition", "license_url", "collection", "numbering_scheme"]
VERSION = 1
SCHEMA = ", ".join([*[f"{c} string" for c in REQUIRED], "expected_lines int, expected_records int", *[f"{c} string" for c in OPTIONAL[2:]]])


class ManifestError(Exception):
    """A manifest that can't be used, or a source that isn't what it pins."""


def entries(text: str) -> list[dict]:
    """The checked entries of a manifest."""
    data = tomllib.loads(text)
    if data.get("lockfile_version") != VERSION:
        raise ManifestError(f"version {data.get('lockfile_version')!r} is not {VERSION}")
    found = data.get("source") or []
    if not found:
        raise ManifestError("the manifest names no source")
    for e in found:
        problem = None
        if lacking := [c for c in REQUIRED if c not in e]:
            problem = f"lacks {', '.join(lacking)}"
        elif e["format"] not in COUNTED_BY:
            problem = f"has the unknown format {e['format']!r}"
        elif COUNTED_BY[e["format"]] not in e:
            problem = f"lacks {COUNTED_BY[e['format']]}, which counts its units"
        elif not re.fullmatch("[0-9a-f]{64}", e["content_sha256"]):
            problem = "has no sha256 of 64 hexadecimal digits"
        if problem:
            raise ManifestError(f"source {e.get('id', 'without id')!r} {problem}")
    return found


def load(spark: SparkSession, path: str) -> DataFrame:
    """The manifest as a DataFrame."""
    p = Path(path)
    if not p.is_file():
        raise ManifestError(f"no manifest at {path}")
    rows = [tuple(e.get(c) for c in [*REQUIRED, *OPTIONAL]) for e in entries(p.read_text(encoding="utf-8"))]
    return spark.createDataFrame(rows, SCHEMA)


def cache_name(source_id: str, kind: str, url: str) -> str:
    return f"{source_id}-{kind}-{hashlib.sha256(url.encode()).hexdigest()[:8]}.txt"


def cache_names(manifest: DataFrame) -> DataFrame:
    """id, file of each source in the cache."""
    return manifest.select("id", F.concat_ws("-", "id", "format", F.concat(F.substr(F.sha2("url", 256), F.lit(1), F.lit(8)), F.lit(".txt"))).alias("file"))


def gate(manifest: DataFrame, measured: DataFrame) -> DataFrame:
    """id, problem of sources that are absent or whose count or digest isn't the pinned one. measured: id, units, sha256."""
    expected = F.coalesce("expected_lines", "expected_records")
    rows = manifest.join(measured, "id", "left")
    problem = F.when(F.col("sha256").isNull(), "not read").when(F.col("units") != expected, "another count").when(F.col("sha256") != F.col("content_sha256"), "another digest")
    return rows.select("id", problem.alias("problem")).where("problem is not null")


def digests(spark: SparkSession, path: str) -> DataFrame:
    """path, sha256 of files."""
    return spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("sha256"))
