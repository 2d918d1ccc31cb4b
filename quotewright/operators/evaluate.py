"""The two-sided evaluation gate over verified cases, and the gate over guarded answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

VERIFIED, MISATTRIBUTED = ["EXACT", "EXACT_ORTHOGRAPHY"], ["WRONG_REFERENCE"]
KNOWN = [*VERIFIED, *MISATTRIBUTED, "NEAR_MATCH", "NOT_FOUND"]


def bad_cases(cases: DataFrame) -> DataFrame:
    """case_id, problem: repeated ids and expected verdicts that don't exist. Must be empty before a run."""
    twice = cases.groupBy("case_id").agg(F.count("*").alias("n")).where("n > 1").select("case_id", F.lit("repeated id").alias("problem"))
    odd = cases.where(F.col("expect_verdict").isNotNull() & ~F.col("expect_verdict").isin(KNOWN)).select("case_id", F.lit("unknown verdict").alias("problem"))
    return twice.unionByName(odd)


def _of(cases: DataFrame, column: str, kind: str) -> Column:
    """A column of the cases that they may lack."""
    return F.col(column) if column in cases.columns else F.lit(None).cast(kind)


def _licensed(cases: DataFrame, declared: str, verdicts: list[str]) -> Column:
    """Spans with one of `verdicts` that a case licenses: as many as it declares, else one if it expects such a verdict."""
    return F.coalesce(_of(cases, declared, "long").cast("long"), F.coalesce(F.col("expect_verdict").isin(verdicts), F.lit(False)).cast("long"))


def judge(cases: DataFrame, matches: DataFrame, claims: DataFrame | None = None, routes: DataFrame | None = None) -> DataFrame:
    """case_id, first_verdict, excess_verified, excess_misattributed, problems (array), passed of each case.

    Spans beyond what a case licenses are errors each; a case without spans passes only what it doesn't ask of them.
    cases: case_id, expect_verdict, expect_record, expect_no_quotation, and, where there are such columns,
    expect_verified_spans, expect_misattributed_spans, forbid_verdict, expect_no_other_record, expect_claim, expect_risk,
    expect_handoff, expect_scope_caveat. matches: case_id, span_no, verdict, record_id. claims: case_id, kind, of what
    was detected in the case's text; routes: case_id, route, handed_on.
    """
    counted = {"verified": F.col("verdict").isin(VERIFIED), "wrong": F.col("verdict").isin(MISATTRIBUTED)}
    asked = cases.select("case_id", _of(cases, "forbid_verdict", "string").alias("forbidden"), _of(cases, "expect_no_other_record", "string").alias("only"))
    counted |= {"barred": F.col("verdict") == F.col("forbidden"), "strays": F.col("record_id") != F.col("only")}
    sums = [F.sum(F.coalesce(c, F.lit(False)).cast("long")).alias(n) for n, c in counted.items()]
    per = matches.join(asked, "case_id").groupBy("case_id").agg(F.count("*").alias("spans"), *sums, F.min_by(F.struct("verdict", "record_id"), "span_no").alias("first"))
    rows = cases.join(per, "case_id", "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("spans", *counted)})
    if claims is not None:
        rows = rows.join(claims.groupBy("case_id").agg(F.collect_set("kind").alias("claimed")), "case_id", "left")
    if routes is not None:
        rows = rows.join(routes.select("case_id", "route", "handed_on"), "case_id", "left")
    excess = lambda n, declared, verdicts: F.greatest(F.col(n) - _licensed(cases, declared, verdicts), F.lit(0))
    rows = rows.withColumn("excess_verified", excess("verified", "expect_verified_spans", VERIFIED)).withColumn("excess_misattributed", excess("wrong", "expect_misattributed_spans", MISATTRIBUTED))

    def unlike(expected: str, got: Column, kind: str = "string") -> Column:
        return _of(cases, expected, kind).isNotNull() & ~_of(cases, expected, kind).eqNullSafe(got)

    problems = {
        "false verification": F.col("excess_verified") > 0, "false misattribution": F.col("excess_misattributed") > 0,
        "verdict": unlike("expect_verdict", F.col("first.verdict")), "record": unlike("expect_record", F.col("first.record_id")),
        "forbidden verdict": F.col("barred") > 0, "another record": F.col("strays") > 0,
        "quotations": unlike("expect_no_quotation", F.col("spans") == 0, "boolean"),
        "scope caveat": F.coalesce(_of(cases, "expect_scope_caveat", "boolean"), F.lit(False)) & F.col("first.record_id").isNotNull(),
    }
    if claims is not None:
        problems["claim"] = _of(cases, "expect_claim", "string").isNotNull() & ~F.coalesce(F.array_contains("claimed", _of(cases, "expect_claim", "string")), F.lit(False))
    if routes is not None:
        problems |= {"risk": unlike("expect_risk", F.col("route")), "handoff": unlike("expect_handoff", F.col("handed_on"), "boolean")}
    found = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in problems.items()]))
    return rows.select("case_id", F.col("first.verdict").alias("first_verdict"), "excess_verified", "excess_misattributed", found.alias("problems"), (F.size(found) == 0).alias("passed"))


def summary(judged: DataFrame) -> DataFrame:
    """first_verdict, cases, passed, excess_verified, excess_misattributed: the gate by the first span's verdict."""
    return judged.groupBy("first_verdict").agg(F.count("*").alias("cases"), F.count_if("passed").alias("passed"), F.sum("excess_verified").alias("excess_verified"), F.sum("excess_misattributed").alias("excess_misattributed"))


def gate(judged: DataFrame) -> bool:
    """Whether no case verified or accused more than it licenses, and all passed."""
    return judged.where(~F.col("passed")).isEmpty()


def answer_gate(results: DataFrame, expected: DataFrame) -> DataFrame:
    """answer_id, outcome: `ok`, `not blocked` or `blocked`, both ways. expected: answer_id, must_block."""
    blocked = results.groupBy("answer_id").agg(F.max(~F.col("passed")).alias("blocked"))
    return expected.join(blocked, "answer_id", "left").select("answer_id", F.when(F.coalesce("blocked", F.lit(False)) == F.col("must_block"), "ok").when(F.col("must_block"), "not blocked").otherwise("blocked").alias("outcome"))
