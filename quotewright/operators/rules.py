"""Rule tables over text: detectors, ordered routing, guards of written answers, and the decision they lead to.

Rules are data: patterns are parameters, so that no wording is built in. Null texts count as empty.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quotewright.functions.text import contains_arabic, fold_diacritics, redact_arabic, word_count
from quotewright.operators.skew import running
from quotewright.runtime import written

#: Most words of a summary and of a framing, and most signs, turns and lists of a request.
SUMMARY_WORDS, FRAMING_WORDS = 80, 25
MOST_SIGNS = {"verify": 50_000, "ask": 2_000, "claim": 10_000, "summary": 1_000}
MOST_TURNS = 10


@dataclass(frozen=True)
class Rule:
    """A detector: what it is called, its pattern (Java), its label and its note."""

    kind: str
    pattern: str
    label: str = ""
    note: str = ""


def detect(texts: DataFrame, rules: list[Rule], text_col: str = "text") -> DataFrame:
    """The columns of texts and kind, label, note: a row for each rule that a text meets, in one pass over the texts."""
    met = F.array_compact(F.array(*[F.when(F.coalesce(text_col, F.lit("")).rlike(r.pattern), F.struct(F.lit(r.kind).alias("kind"), F.lit(r.label).alias("label"), F.lit(r.note).alias("note"))) for r in rules]))
    return texts.withColumn("_met", F.explode(met)).select(*texts.columns, "_met.kind", "_met.label", "_met.note")


def route(text: Column, routes: list[tuple[str, list[list[str]]]], otherwise: str) -> Column:
    """The first route of which some group of patterns is met in full: (code, [[pattern and pattern ...] or [...]])."""
    text = F.coalesce(text, F.lit(""))
    out: Column | None = None
    for code, groups in routes:
        meets = F.lit(False)
        for group in groups:
            every = F.lit(True)
            for pattern in group:
                every = every & text.rlike(pattern)
            meets = meets | every
        out = F.when(meets, code) if out is None else out.when(meets, code)
    return F.lit(otherwise) if out is None else out.otherwise(otherwise)


def requires(code: Column, codes: list[str]) -> Column:
    """Whether a route is among those handed on."""
    return code.isin(codes)


def request_problem(kind: str, text: Column, history: Column | None = None) -> Column:
    """Why a request is refused: `blank`, `too long`, `too many turns`, `too long a summary`, or null. history: an array of
    structs with a summary, a turn each."""
    out = F.when(text.isNull() | (F.trim(text) == ""), "blank").when(F.length(text) > MOST_SIGNS[kind], "too long")
    if history is None:
        return out
    return out.when(F.size(history) > MOST_TURNS, "too many turns").when(F.exists(history, lambda t: F.length(t.summary) > MOST_SIGNS["summary"]), "too long a summary")


def clamp(n: Column, low: int = 1, high: int = 100) -> Column:
    return F.least(F.greatest(n, F.lit(low)), F.lit(high))


def guards(answers: DataFrame, forbidden: dict[str, str], exempt: dict[str, str] | None = None) -> DataFrame:
    """answer_id, guard, passed, detail: a row per guard and answer.

    answers: answer_id, summary, items (array of structs record_id, framing, translation), candidate_ids, history_ids.
    Guards: cited ids are candidates or in the history; no Arabic script in prose; lengths; and for each name in
    `forbidden` that its pattern isn't met in the prose without accents and in lower case. What `exempt` has for the same
    name, such as titles, is taken out before, with hyphens as spaces. Details never repeat script.
    """
    parts = F.flatten(F.array(F.array(F.struct(F.lit("summary").alias("label"), F.col("summary").alias("text"))), F.transform("items", lambda i: F.struct(F.concat(F.lit("framing for "), i.record_id).alias("label"), i.framing.alias("text"))), F.transform(F.filter("items", lambda i: F.coalesce(i.translation, F.lit("")) != ""), lambda i: F.struct(F.concat(F.lit("translation for "), i.record_id).alias("label"), i.translation.alias("text")))))
    cited = F.transform("items", lambda i: i.record_id)
    rows = answers.withColumn("parts", parts).withColumn("stray", F.array_except(cited, F.array_union("candidate_ids", F.coalesce("history_ids", F.array().cast("array<string>")))))
    rows = rows.withColumn("arabic", F.transform(F.filter("parts", lambda p: contains_arabic(F.coalesce(p.text, F.lit("")))), lambda p: p.label))
    long_items = F.transform(F.filter("items", lambda i: word_count(F.coalesce(i.framing, F.lit(""))) > FRAMING_WORDS), lambda i: F.concat(F.lit("framing for "), i.record_id))
    long_ = F.when(word_count(F.coalesce("summary", F.lit(""))) > SUMMARY_WORDS, F.concat(F.array(F.lit("summary")), long_items)).otherwise(long_items)
    rows = rows.withColumn("prose", F.lower(F.array_join(F.transform("parts", lambda p: F.coalesce(p.text, F.lit(""))), " "))).withColumn("plain", fold_diacritics(F.col("prose")))
    state = lambda name, bad, detail: F.struct(F.lit(name).alias("guard"), (~bad).alias("passed"), redact_arabic(F.when(bad, detail).otherwise("")).alias("detail"))
    def spared(name: str) -> Column:
        if not exempt or name not in exempt:
            return F.col("plain")
        return F.regexp_replace(F.regexp_replace(F.translate("plain", "-", " "), "\\s+", " "), exempt[name], " ")

    results = [
        state("cited_id_in_candidates", F.size("stray") > 0, F.concat(F.lit("ids outside the candidates: "), F.array_join(F.array_sort("stray"), ", "))),
        state("no_arabic_in_prose", F.size("arabic") > 0, F.concat(F.lit("Arabic script in: "), F.array_join("arabic", ", "))),
        state("length", F.size(long_) > 0, F.concat(F.lit("too long: "), F.array_join(long_, ", "))),
        *[state(name, spared(name).rlike(p), F.lit("forbidden wording")) for name, p in forbidden.items()],
    ]
    return rows.select("answer_id", F.explode(F.array(*results)).alias("r")).select("answer_id", "r.guard", "r.passed", "r.detail")


def adjudicate(all_passed: Column, overreach: Column, disputed: Column, attempt: Column) -> Column:
    """RETRY once, then ABSTAIN, where a guard or the audit objects; else RELABEL_INTERPRETATION or PUBLISH."""
    blocked = ~all_passed | F.coalesce(overreach, F.lit(False))
    return F.when(blocked & (attempt == 0), "RETRY").when(blocked, "ABSTAIN").when(disputed, "RELABEL_INTERPRETATION").otherwise("PUBLISH")


def overall(matches: DataFrame, request: str, handoff: DataFrame) -> DataFrame:
    """request, outcome: handoff, insufficient_span, needs_review or grounded. matches: request and verdict, a row per
    span; handoff: request, handoff, a row per request."""
    bad = F.col("verdict").isin("WRONG_REFERENCE", "NOT_FOUND", "NEAR_MATCH")
    per = matches.groupBy(request).agg(F.count("*").alias("spans"), F.max(bad).alias("review"))
    rows = handoff.join(per, request, "left")
    return rows.select(request, F.when(F.col("handoff"), "handoff").when(F.col("spans").isNull(), "insufficient_span").when(F.col("review"), "needs_review").otherwise("grounded").alias("outcome"))


def running_text(turns: DataFrame, thread: str, order: str, text: str, most: int = MOST_TURNS) -> DataFrame:
    """turns with context: the text of a thread's last turns up to this one, `most` of them.

    Turns get their numbers, and each meets those of its own and of the preceding stretch of `most` turns, so that a long
    thread is spread over tasks."""
    numbered = written(running(turns, [thread], [order], {"_n": F.lit(1)}), "turns")
    stretch = F.floor(F.col("_n") / most)
    said = numbered.select(F.col(thread).alias("_thread"), F.col("_n").alias("_m"), F.col(text).alias("_said"), F.explode(F.array(stretch, stretch + 1)).alias("_stretch"))
    asked = numbered.select(F.col(thread).alias("_of"), "_n", stretch.alias("_at"))
    near = F.col("_of").eqNullSafe(F.col("_thread")) & (F.col("_at") == F.col("_stretch")) & (F.col("_m") <= F.col("_n")) & (F.col("_m") > F.col("_n") - most)
    met = asked.join(said, near).groupBy("_of", F.col("_n").alias("_k")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_m", "_said"))), lambda x: x["_said"]), " ").alias("context"))  # `most` rows
    return numbered.join(met, F.col(thread).eqNullSafe(F.col("_of")) & (F.col("_n") == F.col("_k"))).select(*turns.columns, "context")
