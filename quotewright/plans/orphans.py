"""Queries of the orphan report and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quotewright.operators import orphans as op
from quotewright.runtime import table


def _orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda name: table(spark, sf_dir, name)
    refs = op.references({
        "translations": (t("translations"), "record_id", "records"),
        "gradings": (t("gradings"), "record_id", "records"),
        "record_vectors": (t("record_vectors"), "record_id", "records"),
        "records": (t("records"), "source_id", "sources"),
    })
    parents = None
    for name in ("records", "sources"):
        part = t(name).select(F.lit(name).alias("target"), F.col("id").alias("key_value"), "loaded_at")
        parents = part if parents is None else parents.unionByName(part)
    return op.orphans(refs, parents, t("removals"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _orphans(spark, sf_dir).select("tab", F.date_format("loaded_at", "yyyy-MM").alias("load_month"), "row_no", "orphan_state")


def p3_orphans_by_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.orphans_by_month(_orphans(spark, sf_dir))


_STATES = """
WITH refs AS (
  SELECT 'translations' AS tab, 'records' AS target, record_id AS k, row_no, loaded_at FROM translations
  UNION ALL SELECT 'gradings', 'records', record_id, row_no, loaded_at FROM gradings
  UNION ALL SELECT 'record_vectors', 'records', record_id, row_no, loaded_at FROM record_vectors
  UNION ALL SELECT 'records', 'sources', source_id, row_no, loaded_at FROM records
), there AS (
  SELECT 'records' AS target, id AS k, min(loaded_at) AS first_l, max(loaded_at) AS last_l FROM records GROUP BY id
  UNION ALL SELECT 'sources', id, min(loaded_at), max(loaded_at) FROM sources GROUP BY id
), gone AS (
  SELECT tab AS target, key_value AS k, max(removed_at) AS last_r FROM removals GROUP BY tab, key_value
), states AS (
  SELECT r.tab, strftime(r.loaded_at, '%Y-%m') AS load_month, r.row_no,
    CASE WHEN t.k IS NULL AND g.k IS NULL THEN 'missing'
         WHEN g.k IS NOT NULL AND (t.k IS NULL OR t.last_l <= g.last_r) THEN 'removed'
         WHEN t.first_l > r.loaded_at THEN 'late' END AS orphan_state
  FROM refs r LEFT JOIN there t ON r.target = t.target AND r.k = t.k LEFT JOIN gone g ON r.target = g.target AND r.k = g.k
  WHERE r.k IS NOT NULL
)
"""

QUERIES = {"p3_found": p3_found, "p3_orphans_by_month": p3_orphans_by_month}
SQL = {
    "p3_found": _STATES + "SELECT * FROM states WHERE orphan_state IS NOT NULL",
    "p3_orphans_by_month": _STATES + "SELECT tab, load_month, orphan_state, count(*) AS orphan_count FROM states WHERE orphan_state IS NOT NULL GROUP BY ALL",
}
