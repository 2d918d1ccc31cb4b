"""Matching quotations against the corpus: exact at two tiers, after a prefix, then by words and edit similarity.

A quotation's row: span_id, quoted, and cited_family, cited_surah, cited_ayah, cited_collection, cited_number of the
citation near it, or nulls. Representations come from `corpus.representations`. Each stage gets what the one before
left over, by anti join.

The records that tie for a text are rows of a table (`HELD`): text, record_id, kind, surah, ayah, collection,
hadith_no, opens, variant, score. A span selects among them by two lookups: the record at the address that it cites, or
else the first of the cited kind; so a text that many records share and many spans quote is no product of both.
"""

from __future__ import annotations

import difflib
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quotewright.functions import spec
from quotewright.functions.normalize import SPACES, nfc, tiers
from quotewright.functions.similarity import may_reach, ratio, ratio_from
from quotewright.functions.text import search_tokens
from quotewright.operators import search
from quotewright.operators.reach import may_resemble
from quotewright.runtime import ship_code, written

#: The verdict of each tier, candidates of a quotation, the least similarity of a near match, and by how
#: much a quoted prefix may be longer than the stored one.
VERDICTS = {"light": "EXACT", "standard": "EXACT_ORTHOGRAPHY", "aggressive": "NEAR_MATCH"}
CANDIDATES, NEAR, PREFIX_SLACK = 50, 0.86, 15
CITED = ["cited_family", "cited_surah", "cited_ayah", "cited_collection", "cited_number"]
ADDRESS = ["kind", "surah", "ayah", "collection", "hadith_no"]
HELD = ["text", "record_id", *ADDRESS, "opens", "variant", "score"]
RESULT = ["span_id", "verdict", "tier", "record_id", "score", "ties", "variant", "asked"]
NOTHING = "\x00"
#: Code points of the runs by which a needle is looked up, the first that it is as long as; runs of a needle; rows whose keys are broadcast at most.
RUNS, RUNS_A_NEEDLE, FEW = (16, 6, 2), 8, 100_000


def conflicts(kind: Column, surah: Column, ayah: Column, collection: Column, number: Column) -> Column:
    """Whether a citation names another record: another kind, or another address. False without a citation."""
    verse = (kind != "ayah") | ~surah.eqNullSafe(F.col("cited_surah")) | (F.col("cited_ayah").isNotNull() & ~ayah.eqNullSafe(F.col("cited_ayah")))
    placed = (kind == "ayah") | ~collection.eqNullSafe(F.col("cited_collection")) | ~number.eqNullSafe(F.col("cited_number"))
    return F.when(F.col("cited_family").isNull(), False).when(F.col("cited_family") == "verse", verse).otherwise(placed)


def _key(family: str, *parts: str) -> Column:
    """An address as one string; a null part is a part of its own."""
    return F.concat_ws("\x1f", F.lit(family), *[F.coalesce(F.col(p).cast("string"), F.lit(NOTHING)) for p in parts])


def choose(spans: DataFrame, held: DataFrame, among: str | None = None) -> DataFrame:
    """span_id, asked, record_id, variant, score, ties, conflict of every span whose text has records in `held`.

    spans: span_id, asked (its text) and CITED. The record is the one at the cited address, else the first of the cited
    kind, else the first, by address and id. `among` names a flag that the chosen record must have; ties counts all.
    """
    verse = F.col("kind") == "ayah"
    place = F.struct(F.coalesce("surah", F.lit(0)).alias("s"), F.coalesce("ayah", F.lit(0)).alias("a"), "record_id", "variant")
    once = held.groupBy("text", "record_id", *ADDRESS).agg(F.max(F.coalesce("opens", F.lit(False))).alias("opens"), F.min("variant").alias("variant"), F.max("score").alias("score"))
    allowed = F.lit(True) if among is None else F.col(among)
    per = once.groupBy("text").agg(F.min(F.when(allowed & verse, place)).alias("verse"), F.min(F.when(allowed & ~verse, place)).alias("placed"), F.count_distinct("record_id").alias("ties"), F.max("score").alias("score"))
    keys = F.when(verse, F.array(_key("v", "surah", "ayah"), _key("v", "surah"))).otherwise(F.array(_key("c", "collection", "hadith_no")))
    named = once.where(allowed).select("text", F.explode(keys).alias("key"), place.alias("place")).groupBy("text", "key").agg(F.min("place").alias("agreed"))
    cites = F.when(F.col("cited_family") == "verse", F.when(F.col("cited_ayah").isNull(), _key("v", "cited_surah")).otherwise(_key("v", "cited_surah", "cited_ayah"))).when(F.col("cited_family").isNotNull(), _key("c", "cited_collection", "cited_number"))
    asked = spans.select("span_id", F.col("asked").alias("text"), "cited_family", F.coalesce(cites, F.lit(NOTHING)).alias("key"))
    rows = asked.join(per, "text").join(named, ["text", "key"], "left")
    first = F.when(F.col("cited_family").isNull(), F.least("verse", "placed")).when(F.col("cited_family") == "verse", F.coalesce("verse", "placed")).otherwise(F.coalesce("placed", "verse"))
    rows = rows.withColumn("chosen", F.coalesce("agreed", first)).where("chosen is not null")
    return rows.select("span_id", F.col("text").alias("asked"), "chosen.record_id", "chosen.variant", "score", "ties", (F.col("cited_family").isNotNull() & F.col("agreed").isNull()).alias("conflict"))


def _result(chosen: DataFrame, tier: str) -> DataFrame:
    """RESULT of chosen records. A wrong citation is reported only at the tiers that fold nothing a reader would see."""
    verdict = F.lit(VERDICTS[tier]) if tier == "aggressive" else F.when(F.col("conflict"), "WRONG_REFERENCE").otherwise(VERDICTS[tier])
    score = F.floor(F.col("score") * 10000 + 0.5) / 10000
    return chosen.select("span_id", verdict.alias("verdict"), F.lit(tier).alias("tier"), "record_id", score.alias("score"), F.col("ties").cast("long").alias("ties"), "variant", "asked")


def _missed(spans: DataFrame, score: Column | None = None) -> DataFrame:
    null = lambda t: F.lit(None).cast(t)
    values = {"verdict": F.lit("NOT_FOUND"), "tier": null("string"), "record_id": null("string"), "score": null("double") if score is None else score, "ties": F.lit(0).cast("long"), "variant": null("string"), "asked": null("string")}
    return spans.select("span_id", *[v.alias(c) for c, v in values.items()])


def _at(spans: DataFrame, tier: str) -> DataFrame:
    return spans.where(F.col(f"norm_{tier}") != "").select("span_id", F.col(f"norm_{tier}").alias("asked"), *CITED)


def held_at(reps: DataFrame, tier: str) -> DataFrame:
    """The representations' records by their text at a tier."""
    opens = F.col("opens") if "opens" in reps.columns else F.lit(False)
    return reps.where(F.col(f"norm_{tier}") != "").select(F.col(f"norm_{tier}").alias("text"), "record_id", *ADDRESS, opens.alias("opens"), "variant", F.lit(1.0).alias("score"))


def exact(spans: DataFrame, reps: DataFrame, tier: str) -> DataFrame:
    """RESULT of spans whose text at the tier is a representation's whole text. spans: with norm_light and norm_standard."""
    return _result(choose(_at(spans, tier), held_at(reps, tier)), tier)


def by_digest(df: DataFrame, tiers: tuple[str, ...] = ("light", "standard")) -> DataFrame:
    """df with 128-bit digests for texts at `tiers`, for stages that ask only whether two are equal; empty stays empty."""
    return df.withColumns({f"norm_{t}": F.when(F.col(f"norm_{t}") == "", "").otherwise(F.md5(F.col(f"norm_{t}"))) for t in tiers})


def exact_cascade(spans: DataFrame, reps: DataFrame) -> DataFrame:
    """The light tier, then the standard tier for what it left."""
    light = exact(spans, reps, "light")
    return light.unionByName(exact(spans.join(light, "span_id", "left_anti"), reps, "standard"))


def also_at(found: DataFrame, held: dict[str, DataFrame]) -> DataFrame:
    """span_id, record_id of the other records that tie with the one selected, whatever the tier. held: by tier."""
    parts = []
    for tier, ties in held.items():
        mine = found.where((F.col("tier") == tier) & (F.col("ties") > 1)).select("span_id", F.col("record_id").alias("selected"), F.col("asked").alias("text"))
        parts.append(mine.join(ties.select("text", "record_id").distinct(), "text").where(F.col("record_id") != F.col("selected")).select("span_id", "record_id"))
    return reduce(DataFrame.unionByName, parts).distinct()


def candidates(texts: DataFrame, reps: DataFrame, k: int = CANDIDATES) -> DataFrame:
    """text, doc_id, score, rank: representations that share words with a text (at the aggressive tier), the k best by BM25."""
    held = reps.select(F.concat_ws("\x1f", "record_id", "variant").alias("doc_id"), "norm_standard", "norm_aggressive")
    columns = ["norm_standard", "norm_aggressive"]
    queries = texts.select(F.col("text").alias("query_id"), search_tokens(F.col("text")).alias("tokens"))
    return search.bm25(search.postings(held, columns), search.lengths_of(held, columns), queries, k).withColumnRenamed("query_id", "text")


def nearest(texts: DataFrame, reps: DataFrame, score_misses: bool) -> tuple[DataFrame, DataFrame]:
    """(HELD of the records that tie for a near match of each text; text, score of the best candidate of the others).

    Each distinct text once. Without `score_misses` an exact filter first drops texts that no representation resembles
    closely enough; the near matches are the same, and the second table is empty.
    """
    texts = texts.where(F.col("text") != "").select("text").distinct()
    if not score_misses:
        texts = may_resemble(texts, reps.select(F.col("norm_aggressive").alias("text")), NEAR)
    texts = written(texts, "close")
    opens = F.col("opens") if "opens" in reps.columns else F.lit(False)
    ranked = written(candidates(texts, reps), "candidates")
    pairs = ranked.select("text", "doc_id", "rank").join(reps.select(F.concat_ws("\x1f", "record_id", "variant").alias("doc_id"), "record_id", *ADDRESS, opens.alias("opens"), "variant", F.col("norm_aggressive").alias("held")), "doc_id")
    if score_misses:
        scored = pairs.withColumn("score", ratio(F.col("text"), F.col("held")))
    else:
        scored = pairs.where(may_reach(F.col("text"), F.col("held"), NEAR)).withColumn("score", ratio_from(F.col("text"), F.col("held"), NEAR)).where("score is not null")
    # a record counts by its best representation, of equal ones the better ranked
    best = scored.groupBy("text", "record_id", *ADDRESS, "opens").agg(F.max(F.struct("score", (-F.col("rank")).alias("up"), "variant")).alias("b")).select("text", "record_id", *ADDRESS, "opens", "b.variant", "b.score")
    top = written(best.withColumn("place", F.rank().over(Window.partitionBy("text").orderBy(F.desc("score")))).where("place = 1").drop("place"), "nearest")
    return top.where(F.col("score") >= NEAR).select(*HELD), top.where(F.col("score") < NEAR).groupBy("text").agg(F.max("score").alias("score"))


def fuzzy(spans: DataFrame, reps: DataFrame, score_misses: bool = False) -> tuple[DataFrame, DataFrame]:
    """(RESULT of each span: NEAR_MATCH, or NOT_FOUND with the best candidate's score where misses are scored; HELD)."""
    held, missed = nearest(spans.select(F.col("norm_aggressive").alias("text")), reps, score_misses)
    found = written(_result(choose(_at(spans, "aggressive"), held), "aggressive"), "near")
    rest = spans.join(found, "span_id", "left_anti")
    if score_misses:
        rest = rest.join(missed.select(F.col("text").alias("norm_aggressive"), "score"), "norm_aggressive", "left")
        return found.unionByName(_missed(rest, F.floor(F.coalesce("score", F.lit(0.0)) * 10000 + 0.5) / 10000)), held
    return found.unionByName(_missed(rest)), held


def _loose(target: str) -> str:
    """A regular expression for texts in NFC whose standard form is `target`: alefs in any form, and marks and kashidas
    anywhere."""
    marks = "[" + spec.KASHIDA + "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in spec.MARKS) + "]*"
    alefs = f"[{spec.ALEFS[1][0]}{spec.ALEFS[0]}]"
    signs = [SPACES if c == " " else alefs if c == spec.ALEFS[1][0] else f"\\x{{{ord(c):x}}}" for c in target]
    return marks + marks.join(signs) + marks


def strip_prefix(spans: DataFrame, prefixes: list[str]) -> DataFrame:
    """span_id, CITED, quoted and its tiers of spans (with norm_standard) that begin with one of `prefixes` at the
    standard tier, less that prefix. A span that is nothing else, or that writes the prefix much longer than it is stored, is left out."""
    wanted = {spec.normalize(p, "standard"): len(p) for p in sorted(prefixes, key=len)}
    rest: Column | None = None
    text = F.regexp_replace(nfc(F.col("quoted")), f"^{SPACES}", "")
    for target in sorted((t for t in wanted if t), key=len, reverse=True):
        pattern = f"^{_loose(target)}"
        cut = F.regexp_replace(text, pattern, "")
        fits = text.rlike(pattern) & (F.length(text) - F.length(cut) <= wanted[target] + PREFIX_SLACK)
        rest = F.when(fits, cut) if rest is None else rest.when(fits, cut)
    rest = F.regexp_replace(F.lit(None).cast("string") if rest is None else rest, f"^{SPACES}", "")
    begins = [F.startswith("norm_standard", F.lit(t)) for t in wanted if t]
    spans = spans.where(reduce(Column.__or__, begins)) if begins else spans.limit(0)
    return tiers(spans.select("span_id", rest.alias("quoted"), *CITED).where("quoted <> ''"), "quoted")


def prefixes_of(records: DataFrame) -> list[str]:
    """The prefixes that records carry, as stored, one for each standard form; the driver holds one row a form."""
    if "bismillah" not in records.columns:
        return []
    known = records.where(F.col("bismillah").isNotNull()).groupBy("bismillah").count()
    by_form = tiers(known, "bismillah").groupBy("norm_standard").agg(F.max(F.struct(F.length("bismillah").alias("n"), "bismillah")).alias("b"))
    return [r[0] for r in by_form.select("b.bismillah").orderBy("bismillah").collect()]


def prefix_retry(stripped: DataFrame, reps: DataFrame, with_fuzzy: bool = True) -> tuple[DataFrame, dict[str, DataFrame]]:
    """(RESULT of spans that match without a corpus prefix, HELD by tier). stripped: from `strip_prefix`, a written table.

    The text left is matched against the whole corpus, tier by tier, as any quotation is. The match is taken only if the
    first record of a chapter that has the prefix is among the records that tie for it; then one of those is selected,
    and the others remain ties. Where none is, the span is left as it was.
    """
    rest, found, held = stripped, None, {}
    for tier in ("light", "standard", "aggressive"):
        if tier == "aggressive":
            if not with_fuzzy or rest.isEmpty():
                break
            held[tier] = nearest(rest.select(F.col("norm_aggressive").alias("text")), reps, False)[0]
        else:
            held[tier] = held_at(reps, tier)
        asked = _at(rest, tier)
        taken = _result(choose(asked, held[tier], "opens"), tier)
        found = taken if found is None else found.unionByName(taken)
        matched = asked.join(held[tier].select(F.col("text").alias("asked")).distinct(), "asked", "left_semi").select("span_id")
        rest = written(rest.join(matched, "span_id", "left_anti"), "rest")
    return found, held


def _digest(text: Column) -> Column:
    return F.unhex(F.md5(text))


def _among(many: DataFrame, few: DataFrame, key: str) -> DataFrame:
    """Rows of `many` whose key is in `few`, a written table. Few rows are broadcast, so that texts stay where they are."""
    keys = few.select(key).distinct()
    return many.join(F.broadcast(keys) if few.count() <= FEW else keys, key, "left_semi")


def containing(needles: DataFrame, texts: DataFrame, among: DataFrame | None = None) -> DataFrame:
    """needle_id, text_id: texts that contain a needle, of two code points or more, as a raw substring. needles: needle_id,
    needle; texts: text_id, text; among: needle_id of the needles that are asked for, where not all are.

    Texts are known by their 128-bit digests until they are compared, each different one once. A needle is looked up by
    the rarest, among the texts, of RUNS_A_NEEDLE of its runs that stand at even distances, and dropped where no text has
    one of them. Only needles and texts that share a run so chosen are compared.
    """
    size = F.length("needle")
    kind = F.when(size >= RUNS[0], RUNS[0]).when(size >= RUNS[1], RUNS[1]).otherwise(RUNS[2])
    run = lambda c, i, n: F.xxhash64(F.substr(c, i, n))
    spread = F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(RUNS_A_NEEDLE - 1)), lambda i: run(F.col("needle"), (F.floor((size - kind) * i / (RUNS_A_NEEDLE - 1)) + 1).cast("int"), kind)))
    every = lambda n: F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("text") - n + 1), lambda i: run(F.col("text"), i, F.lit(n))))
    keyed = needles.where(size >= RUNS[-1]).withColumn("needle_key", _digest(F.col("needle")))
    asked = keyed.select("needle_id", "needle_key", kind.alias("kind"), spread.alias("runs"))
    asked = written((asked if among is None else asked.join(among.select("needle_id").distinct(), "needle_id", "left_semi")).distinct(), "needles")
    held = texts.where(F.length("text") >= RUNS[-1]).withColumn("text_key", _digest(F.col("text")))
    once = held.dropDuplicates(["text_key"]).select("text_key", "text")
    pairs = None
    for n in sorted(r.kind for r in asked.select("kind").distinct().collect()):
        wanted = written(asked.where(F.col("kind") == n).select("needle_key", F.explode("runs").alias("g")).distinct(), "wanted")
        there = once.where(F.length("text") >= n).select("text_key", F.explode(every(n)).alias("g"))
        there = written(there.join(wanted.select("g").distinct(), "g", "left_semi"), "runs")
        counts = there.groupBy("g").agg(F.count("*").alias("n"))
        rarest = wanted.join(counts, "g", "left").groupBy("needle_key").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "g")).alias("r")).where("r.n > 0").select("needle_key", F.col("r.g").alias("g"))
        part = rarest.join(there, "g").select("needle_key", "text_key")
        pairs = part if pairs is None else pairs.unionByName(part)
    if pairs is None:
        return asked.select("needle_id").join(texts.select("text_id").limit(0))
    pairs = written(pairs, "pairs")
    whole = _among(keyed.select("needle_id", "needle_key", "needle"), pairs, "needle_key").join(asked.select("needle_id", "needle_key"), ["needle_id", "needle_key"], "left_semi")
    hits = pairs.join(whole.select("needle_key", "needle").dropDuplicates(["needle_key"]), "needle_key").join(_among(once, pairs, "text_key"), "text_key")
    hits = written(hits.where(F.contains("text", "needle")).select("needle_key", "text_key"), "hits")
    return asked.select("needle_id", "needle_key").join(hits, "needle_key").join(_among(held.select("text_id", "text_key"), hits, "text_key"), "text_key").select("needle_id", "text_id").distinct()


def contained(found: DataFrame, spans: DataFrame, records: DataFrame) -> DataFrame:
    """span_id, record_id, at_standard, agrees: verses that contain a span which matched a record of another kind, at the
    aggressive tier; whether at the standard tier too, and whether the span's citation names the verse."""
    kinds = records.select(F.col("id").alias("record_id"), "kind").distinct()
    asked = found.where("record_id is not null").select("span_id", "record_id").join(kinds, "record_id").where("kind = 'hadith'").select("span_id")
    verses = written(records.where("kind = 'ayah' and norm_aggressive is not null").select("id", *ADDRESS, "norm_standard", "norm_aggressive"), "verses")
    near = containing(spans.select(F.col("span_id").alias("needle_id"), F.col("norm_aggressive").alias("needle")), verses.select(F.col("id").alias("text_id"), F.col("norm_aggressive").alias("text")), asked.select(F.col("span_id").alias("needle_id")))
    near = written(near.select(F.col("needle_id").alias("span_id"), F.col("text_id").alias("id")), "near")
    quoted = _among(spans.select("span_id", F.col("norm_standard").alias("asked"), *CITED), near, "span_id")
    rows = near.join(quoted, "span_id").join(_among(verses, near, "id").distinct(), "id")
    agrees = F.col("cited_family").isNotNull() & ~conflicts(*[F.col(c) for c in ADDRESS])
    return rows.select("span_id", F.col("id").alias("record_id"), ((F.col("asked") != "") & F.contains("norm_standard", "asked")).alias("at_standard"), agrees.alias("agrees"))


def withhold(found: DataFrame, inside: DataFrame) -> DataFrame:
    """found, where a match is withheld as NOT_FOUND if the citation names a verse that contains the span, with the number
    of verses to disclose. Columns beside span_id, verdict and ties become null where a match is withheld."""
    per = inside.groupBy("span_id").agg(F.max("agrees").alias("agrees"), F.sum(F.col("at_standard").cast("long")).alias("contained_in"))
    rows = found.join(per, "span_id", "left").withColumn("held_back", F.coalesce("agrees", F.lit(False)))
    kept = {c: F.when(~F.col("held_back"), F.col(c)) for c in found.columns}
    kept |= {"span_id": F.col("span_id"), "verdict": F.when(F.col("held_back"), "NOT_FOUND").otherwise(F.col("verdict")), "ties": F.when(F.col("held_back"), 0).otherwise(F.col("ties"))}
    if "score" in kept:
        kept["score"] = F.when(F.col("held_back"), 0.0).otherwise(F.col("score"))
    return rows.select(*[v.alias(c) for c, v in kept.items()], F.coalesce("contained_in", F.lit(0)).cast("long").alias("contained_in"))


def verify_with_ties(spans: DataFrame, records: DataFrame, reps: DataFrame, with_fuzzy: bool = True, score_misses: bool = False) -> tuple[DataFrame, DataFrame]:
    """(span_id, verdict, tier, record_id, score, ties, diff, contained_in of every span; span_id, record_id of the other
    records that tie with the one selected). spans: span_id, quoted and CITED.

    diff, of near matches, is between the quotation (less a prefix that was taken off) and the representation that
    matched, see `differences`. `score_misses` gives NOT_FOUND the score of its best candidate; else it is null, and
    candidates are ranked only for texts that may have a near match. `with_fuzzy` false leaves out the similarity stage.
    """
    asked = written(tiers(spans.select("span_id", "quoted", *CITED), "quoted"), "asked")
    reps = written(reps, "reps")
    # each stage is written, so that what follows starts from a table and not from all stages before it
    found = written(exact_cascade(asked, reps), "exact")
    held = [(found, {t: held_at(reps, t) for t in ("light", "standard")})]
    # what later stages need of a span, without its text as quoted and at the tiers that are done
    rest = written(asked.select("span_id", "norm_aggressive", *CITED).join(found, "span_id", "left_anti"), "rest")
    prefixes, stripped = prefixes_of(records), None
    if prefixes:
        stripped = written(strip_prefix(asked, prefixes).join(found, "span_id", "left_anti"), "stripped")
        if not stripped.isEmpty():
            retried, ties = prefix_retry(stripped, reps, with_fuzzy)
            retried = written(retried, "retried")
            held.append((retried, ties))
            found = found.unionByName(retried)
            rest = written(rest.join(retried, "span_id", "left_anti"), "rest")
    if with_fuzzy:
        near, ties = fuzzy(rest, reps, score_misses)
        near = written(near, "last")
        held.append((near, {"aggressive": ties}))
    else:
        near = _missed(rest)
    found = written(found.unionByName(near), "found")
    texts = reps.select("record_id", "variant", F.col("text_ar").alias("canonical"))
    told = found.where("verdict = 'NEAR_MATCH'").select("span_id", "record_id", "variant").join(near.select("span_id", F.lit(True).alias("whole")), "span_id", "left")
    bare = (asked.limit(0) if stripped is None else stripped).select("span_id", F.col("quoted").alias("bare"))
    diffs = asked.select("span_id", "quoted").join(told, "span_id").join(bare, "span_id", "left").join(texts, ["record_id", "variant"])
    diffs = with_diff(diffs.select("span_id", F.when(F.col("whole"), F.col("quoted")).otherwise(F.coalesce("bare", "quoted")).alias("quoted"), "canonical"))
    found = written(found.join(diffs.select("span_id", "diff"), "span_id", "left").select("span_id", "verdict", "tier", "record_id", "score", "ties", "diff"), "told")
    final = withhold(found, written(contained(found.select("span_id", "record_id"), asked, records), "contained"))
    others = reduce(DataFrame.unionByName, [also_at(f, h) for f, h in held])
    return final, others


def verify(spans: DataFrame, records: DataFrame, reps: DataFrame, with_fuzzy: bool = True, score_misses: bool = False) -> DataFrame:
    """The first table of `verify_with_ties`."""
    return verify_with_ties(spans, records, reps, with_fuzzy, score_misses)[0]


#: What an opcode says of its two sides: the name of an edit, and of which side it shows the text.
_EDITS = {"equal": [("equal", 0)], "delete": [("quoted-only", 0)], "insert": [("corpus-only", 1)], "replace": [("quoted-only", 0), ("corpus-only", 1)]}


def differences(quoted: str, canonical: str) -> list[tuple[str, str]]:
    """Edits (op, text) from a quotation to the text, both at the standard tier: runs that are equal, only quoted, only in
    the corpus."""
    sides = [spec.normalize(t, "standard") for t in (quoted, canonical)]
    matcher = difflib.SequenceMatcher(None, *sides)
    return [(name, sides[side][slice(*(code[1:3], code[3:5])[side])]) for code in matcher.get_opcodes() for name, side in _EDITS[code[0]]]


def with_diff(pairs: DataFrame) -> DataFrame:
    """pairs (quoted, canonical, and others) with diff, an array of (op, text); null where one of the two is null."""
    ship_code(pairs.sparkSession)

    @F.udf("array<struct<op:string,text:string>>", useArrow=True)
    def diff(a: str | None, b: str | None):
        return None if a is None or b is None else differences(a, b)

    return pairs.withColumn("diff", diff("quoted", "canonical"))
