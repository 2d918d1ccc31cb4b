"""Readers of evaluation cases."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quotewright.operators.corpus import require_empty
from quotewright.operators.evaluate import bad_cases

CASES = "id string, text string, rationale string, expect_verdict string, expect_record string, expect_claim string, expect_risk string, forbid_verdict string, expect_no_other_record string, expect_no_quotation boolean, expect_handoff boolean, expect_scope_caveat boolean, expect_verified_spans int, expect_misattributed_spans int"
ANSWERS = "id string, candidate_ids array<string>, history_ids array<string>, selection struct<summary:string,items:array<struct<record_id:string,framing:string,matn_translation:string>>>, must_block boolean"


def cases(spark: SparkSession, path: str) -> DataFrame:
    """Cases from JSON files (lists or lines), checked: repeated ids and unknown verdicts raise GateError."""
    df = spark.read.schema(CASES).option("multiLine", True).json(path).withColumnRenamed("id", "case_id")
    require_empty(bad_cases(df), "cases")
    return df


def cases_of_yaml(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Cases from YAML files, where a YAML library is installed."""
    try:
        import yaml
    except ImportError as e:
        raise RuntimeError("reading YAML cases needs the package yaml; JSON cases need nothing") from e
    names = [c.split()[0] for c in CASES.split(", ")]
    rows = [tuple(r.get(c) for c in names) for p in paths for r in yaml.safe_load(open(p, encoding="utf-8")) or []]
    df = spark.createDataFrame(rows, CASES).withColumnRenamed("id", "case_id")
    require_empty(bad_cases(df), "cases")
    return df


def answers(spark: SparkSession, path: str) -> DataFrame:
    """Answer cases as `rules.guards` and `evaluate.answer_gate` take them; repeated ids raise GateError."""
    df = spark.read.schema(ANSWERS).option("multiLine", True).json(path)
    require_empty(df.groupBy("id").agg(F.count("*").alias("n")).where("n > 1"), "answer cases")
    items = F.transform("selection.items", lambda i: F.struct(i.record_id.alias("record_id"), i.framing.alias("framing"), i.matn_translation.alias("translation")))
    return df.select(F.col("id").alias("answer_id"), F.col("selection.summary").alias("summary"), items.alias("items"), "candidate_ids", F.coalesce("history_ids", F.array().cast("array<string>")).alias("history_ids"), "must_block")
