"""Answering over the corpus with injected providers: expand, retrieve, select, guard, audit, decide; at most two tries.

Providers are plain functions, so a run is deterministic with a stub; no network code is part of the engine. A stage's
events come as rows of (request_id, stage_no, stage, payload JSON).
"""

from __future__ import annotations

import inspect
import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quotewright.functions.text import index_tokens
from quotewright.operators import rules, search
from quotewright.runtime import written

#: The head of a block of evidence, and what a rejected try is told where no guard says more.
HEAD = "CANDIDATE SET (cite only these record_ids):\n\n"
REJECTED = "The answer was rejected; be more careful."
ITEMS = "array<struct<record_id:string,framing:string,translation:string>>"
HISTORY = "array<struct<question:string,summary:string,item_ids:array<string>>>"


@dataclass(frozen=True)
class Providers:
    """expand(question) -> search terms; select(question, ids[, feedback[, evidence]]) -> (summary, [(record_id, framing,
    translation)]); audit(summary, items) -> overreach. None of them for `audit` means no objection."""

    expand: Callable[[str], list[str]]
    select: Callable[..., tuple[str, list[tuple[str, str, str | None]]]]
    audit: Callable[[str, list], bool] | None = None


def retrieve(terms: DataFrame, index: DataFrame, lengths: DataFrame, near: DataFrame | Callable[[], DataFrame] | None = None, k: int = 24, each: int = 50) -> DataFrame:
    """query_id, record_id, score, rank, in_text, in_vector: text and vector lists of each query, fused.

    terms: query_id, term_no, tokens. index, lengths: of `search.postings` over doc_id = record_id, or
    record_id and variant after U+001F, of which twice as many are ranked. near: query_id, record_id, rank of the vector
    search, or a function that gives them; without it, or if the function fails, the text list alone is used.
    """
    if callable(near):
        try:
            near = written(near(), "near")  # what the provider of vectors can't answer shows here
        except Exception:  # noqa: BLE001
            near = None
    numbered = terms.withColumn("_term", F.concat_ws("\x1f", F.col("query_id").cast("string"), F.col("term_no").cast("string")))
    ranked = search.bm25(index, lengths, numbered.select(F.col("_term").alias("query_id"), "tokens"), 2 * each)
    ranked = search.distinct_records(ranked.withColumn("doc_id", F.split("doc_id", "\x1f")[0]), "doc_id", each)
    back = numbered.select(F.col("_term"), F.col("query_id").alias("q"), "term_no")
    by_term = ranked.join(back, ranked["query_id"] == back["_term"]).select(F.col("q").alias("query_id"), "term_no", "record_id", "rank")
    text = search.first_seen(by_term, 1 << 30)
    lists = [text] if near is None else [text, near]
    fused = search.fuse(lists, k)
    out = fused.join(text.select("query_id", "record_id", F.lit(True).alias("t")), ["query_id", "record_id"], "left").withColumn("in_text", F.coalesce("t", F.lit(False))).drop("t")
    if near is None:
        return out.withColumn("in_vector", F.lit(False))
    return out.join(near.select("query_id", "record_id", F.lit(True).alias("v")), ["query_id", "record_id"], "left").withColumn("in_vector", F.coalesce("v", F.lit(False))).drop("v")


def _accepts(f: Callable, n: int) -> bool:
    """Whether a provider's function takes `n` arguments by position."""
    kinds = [p.kind for p in inspect.signature(f).parameters.values()]
    return inspect.Parameter.VAR_POSITIONAL in kinds or sum(k in (inspect.Parameter.POSITIONAL_ONLY, inspect.Parameter.POSITIONAL_OR_KEYWORD) for k in kinds) >= n


def feedback_of(details: Column, flags: Column) -> Column:
    """What a rejected answer's next try is told: the details of failed guards, then what the audit flagged."""
    said = F.array_join(F.filter(F.concat(F.coalesce(details, F.array().cast("array<string>")), F.coalesce(flags, F.array().cast("array<string>"))), lambda x: x != ""), "; ")
    return F.when(said == "", REJECTED).otherwise(said)


def events(spark: SparkSession, request_id: str, question: str, history: list[str], providers: Providers, find: Callable[[list[str]], list[str]], routes: list, handed_on: list[str], forbidden: dict[str, str]) -> Iterator[tuple[str, dict]]:
    """The stages of one request as they come. Errors of a provider end it with a scrubbed message. The second try is told
    what the first was rejected for, by a third argument of `select` where it takes one."""
    route = spark.range(1).select(rules.route(F.lit(" ".join([*history, question])), routes, "GENERAL")).first()[0]
    yield "route", {"route": route}
    if route in handed_on:
        yield "final", {"decision": "ABSTAIN", "reason": "handed on"}
        return
    try:
        terms = providers.expand(question)
        yield "expand", {"terms": terms}
        ids = find(terms)
        yield "retrieve", {"ids": ids}
        decision, told = "ABSTAIN", None
        for attempt in range(2):
            more = [told] if told is not None and _accepts(providers.select, 3) else []
            summary, items = providers.select(question, ids, *more)
            yield "select", {"attempt": attempt, "items": [i[0] for i in items]}
            answer = spark.createDataFrame([(request_id, summary, items, ids, [])], f"answer_id string, summary string, items {ITEMS}, candidate_ids array<string>, history_ids array<string>")
            results = rules.guards(answer, forbidden).collect()
            passed = all(r.passed for r in results)
            yield "check", {"attempt": attempt, "guards": {r.guard: r.passed for r in results}}
            overreach = bool(passed and providers.audit and providers.audit(summary, items))
            if passed:
                yield "audit", {"attempt": attempt, "overreach": overreach}
            decision = "PUBLISH" if passed and not overreach else "RETRY" if attempt == 0 else "ABSTAIN"
            decision = "RELABEL_INTERPRETATION" if decision == "PUBLISH" and route == "DISPUTED" else decision
            yield "decide", {"attempt": attempt, "decision": decision}
            if decision != "RETRY":
                break
            told = "; ".join(r.detail for r in results if not r.passed and r.detail) or REJECTED
        yield "final", {"decision": decision}
    except Exception as e:  # what a provider says may hold the user's text
        yield "error", {"message": f"{type(e).__name__}: the request could not be completed"}


def _provided(f: Callable, returns: str) -> Callable:
    """A provider's function as a column function; where it raises, its result is null, and its message goes nowhere."""

    def call(*values):
        try:
            return f(*values)
        except Exception:  # noqa: BLE001
            return None

    return F.udf(call, returns, useArrow=True)


def evidence(hits: DataFrame, records: DataFrame) -> DataFrame:
    """query_id, candidate_ids, evidence: the records that a request may cite, in order of rank, and the block of text in
    which a provider reads them. hits: query_id, record_id, rank, a bounded list a query; records: id, reference_display, text_ar."""
    shown = records.select(F.col("id").alias("record_id"), F.concat(F.lit("["), F.col("id"), F.lit("] "), F.coalesce("reference_display", F.lit("")), F.lit("\n"), F.coalesce("text_ar", F.lit("")), F.lit("\n")).alias("block"))
    listed = hits.join(shown, "record_id").groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "record_id", "block"))).alias("h"))
    return listed.select("query_id", F.transform("h", lambda x: x.record_id).alias("candidate_ids"), F.concat(F.lit(HEAD), F.array_join(F.transform("h", lambda x: x.block), "\n")).alias("evidence"))


def run(requests: DataFrame, records: DataFrame, index: DataFrame, lengths: DataFrame, providers: Providers, routes: list, handed_on: list[str], forbidden: dict[str, str], near: DataFrame | Callable[[], DataFrame] | None = None) -> DataFrame:
    """request_id, route, handed_on, terms, candidates, reached, attempts, decision, status, summary, items, reason of every
    request, all requests stage by stage.

    requests: request_id, question, history (array of struct question, summary, item_ids). A provider's failure, or a
    request for which nothing is found, abstains. `select` gets the question, the candidates, the feedback of the first
    try and the block of evidence, as many of these as it takes. near: as in `retrieve`, by request_id.
    """
    asked_before = F.transform(F.coalesce("history", F.array().cast(HISTORY)), lambda t: F.coalesce(t.question, F.lit("")))
    route = rules.route(F.trim(F.concat_ws(" ", F.array_join(F.filter(asked_before, lambda q: q != ""), " "), "question")), routes, "GENERAL")
    expand = _provided(providers.expand, "array<string>")
    rows = requests.select("request_id", "question", "history", route.alias("route")).withColumn("handed_on", rules.requires(F.col("route"), handed_on))
    rows = written(rows.withColumn("terms", F.when(~F.col("handed_on"), expand("question"))), "requests")
    words = F.array_distinct(F.filter(index_tokens(F.col("term")), lambda t: F.length(t) > 1))
    terms = rows.select(F.col("request_id").alias("query_id"), F.posexplode("terms").alias("term_no", "term")).select("query_id", "term_no", words.alias("tokens"))
    hits = written(retrieve(terms, index, lengths, near).select("query_id", "record_id", "rank"), "hits")
    kinds = search.reached(hits, records).groupBy("query_id").agg(F.array_sort(F.collect_set("kind")).alias("reached"))
    known = rows.select("request_id", F.explode("history").alias("t")).select("request_id", F.explode("t.item_ids").alias("id")).join(records.select("id").distinct(), "id", "left_semi")
    carried = known.groupBy("request_id").agg(F.collect_set("id").alias("history_ids"))
    none = F.array().cast("array<string>")
    base = rows.join(evidence(hits, records).withColumnRenamed("query_id", "request_id"), "request_id", "left").join(kinds.withColumnRenamed("query_id", "request_id"), "request_id", "left").join(carried, "request_id", "left")
    base = written(base.withColumns({c: F.coalesce(c, none) for c in ("candidate_ids", "reached", "history_ids")}), "candidates")

    arguments = next(n for n in (4, 3, 2) if _accepts(providers.select, n))
    select = _provided(lambda *v: providers.select(*v[:arguments]), f"struct<summary:string,items:{ITEMS}>")
    audit = _provided(providers.audit, "boolean") if providers.audit else None
    waiting = base.where(F.col("terms").isNotNull() & (F.size("candidate_ids") > 0)).withColumn("feedback", F.lit(None).cast("string"))
    ended = None
    for attempt in (0, 1):
        tried = written(waiting.withColumn("answer", select("question", "candidate_ids", "feedback", "evidence")).withColumns({"summary": F.col("answer.summary"), "items": F.coalesce("answer.items", F.array().cast(ITEMS))}), "tried")
        checked = rules.guards(tried.where("answer is not null").withColumnRenamed("request_id", "answer_id"), forbidden)
        per = checked.groupBy(F.col("answer_id").alias("request_id")).agg(F.min("passed").alias("all_passed"), F.array_sort(F.collect_list(F.when(~F.col("passed"), F.col("detail")))).alias("details"))  # a row a guard
        judged = tried.join(per, "request_id", "left").withColumn("overreach", F.when(F.col("all_passed"), audit("summary", "items")) if audit else F.lit(None).cast("boolean"))
        decision = F.when(F.col("answer").isNull(), "ABSTAIN").otherwise(rules.adjudicate(F.coalesce("all_passed", F.lit(False)), F.col("overreach"), F.col("route") == "DISPUTED", F.lit(attempt)))
        judged = written(judged.withColumn("decision", decision).withColumn("feedback", feedback_of(F.col("details"), F.when(F.col("overreach"), F.array(F.lit("says more than its sources"))))).withColumn("attempts", F.lit(attempt + 1)), "judged")
        done = judged.where("decision <> 'RETRY'").select("request_id", "attempts", "decision", "summary", "items", F.col("answer").isNull().alias("failed"))
        ended = done if ended is None else ended.unionByName(done)
        waiting = judged.where("decision = 'RETRY'").select(*base.columns, "feedback")
    out = base.join(ended, "request_id", "left")
    published = F.col("decision").isin("PUBLISH", "RELABEL_INTERPRETATION")
    reason = F.when(F.col("handed_on"), "handed on").when(F.col("terms").isNull(), "no search terms").when(F.size("candidate_ids") == 0, "nothing found").when(F.col("failed"), "no answer").when(~published, "rejected")
    return out.select("request_id", "route", "handed_on", "terms", F.size("candidate_ids").alias("candidates"), "reached", F.coalesce("attempts", F.lit(0)).alias("attempts"), F.coalesce("decision", F.lit("ABSTAIN")).alias("decision"), F.when(published, "published").otherwise("abstained").alias("status"), F.when(published, F.col("summary")).alias("summary"), F.when(published, F.col("items")).alias("items"), reason.alias("reason"))


def claims_of(texts: DataFrame, extract: Callable[[str], list[tuple[str, list[str]]]]) -> DataFrame:
    """request_id, claim_no, claim, terms: what a provider finds to check in each text (request_id, text); none where it fails."""
    found = _provided(extract, "array<struct<claim:string,terms:array<string>>>")
    rows = written(texts.select("request_id", found("text").alias("claims")), "claims")
    return rows.select("request_id", F.posexplode("claims").alias("claim_no", "c")).select("request_id", "claim_no", "c.claim", "c.terms")


def assess_claims(claims: DataFrame, candidates: DataFrame, records: DataFrame, assess: Callable[[str], list[tuple[str, str, list[str]]]]) -> DataFrame:
    """request_id, claim_no, claim, verdict, note, record_ids: a provider's assessments of a request's claims, which it reads
    in one block with their candidates and gives in their order; ids that aren't candidates of the claim are left out.
    claims: from `claims_of`; candidates: request_id, claim_no, record_id, rank."""
    text = records.select(F.col("id").alias("record_id"), F.concat(F.lit("  ["), F.col("id"), F.lit("] "), F.coalesce("reference_display", F.lit("")), F.lit(": "), F.coalesce("text_ar", F.lit(""))).alias("line"))
    listed = candidates.join(text, "record_id").groupBy("request_id", "claim_no").agg(F.array_sort(F.collect_list(F.struct("rank", "record_id", "line"))).alias("h"))
    rows = claims.join(listed, ["request_id", "claim_no"], "left")
    lines = F.when(F.col("h").isNull(), F.lit("  (no candidates)")).otherwise(F.array_join(F.transform("h", lambda x: x.line), "\n"))
    rows = rows.withColumn("block", F.concat(F.lit("Claim "), (F.col("claim_no") + 1).cast("string"), F.lit(": "), F.col("claim"), F.lit("\n"), lines)).withColumn("ids", F.coalesce(F.transform("h", lambda x: x.record_id), F.array().cast("array<string>")))
    per = rows.groupBy("request_id").agg(F.array_sort(F.collect_list(F.struct("claim_no", "claim", "block", "ids"))).alias("c"))
    said = _provided(assess, "array<struct<verdict:string,note:string,record_ids:array<string>>>")
    done = written(per.select("request_id", "c", said(F.array_join(F.transform("c", lambda x: x.block), "\n\n")).alias("said")), "assessed")
    pairs = done.where("said is not null").select("request_id", F.explode(F.filter(F.arrays_zip("c", "said"), lambda p: p.c.isNotNull() & p.said.isNotNull())).alias("p"))
    return pairs.select("request_id", "p.c.claim_no", "p.c.claim", "p.said.verdict", "p.said.note", F.array_intersect("p.c.ids", F.coalesce("p.said.record_ids", F.array().cast("array<string>"))).alias("record_ids"))


def event_rows(spark: SparkSession, request_id: str, stages: Iterator[tuple[str, dict]]) -> DataFrame:
    """request_id, stage_no, stage, payload of a request's stages."""
    return spark.createDataFrame([(request_id, n, s, json.dumps(p, sort_keys=True)) for n, (s, p) in enumerate(stages)], "request_id string, stage_no int, stage string, payload string")


def server_sent(rows: DataFrame) -> DataFrame:
    """line: each event as a server-sent event."""
    return rows.select("request_id", "stage_no", F.concat(F.lit("data: "), F.to_json(F.struct("stage", F.parse_json("payload").alias("payload"))), F.lit("\n\n")).alias("line"))
