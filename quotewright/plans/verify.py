"""Queries over quotations, matching, search and the answer pipeline, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quotewright.functions.text import index_tokens
from quotewright.operators import ask, corpus, evaluate, extract, rules, search
from quotewright.operators import verify as op
from quotewright.plans.corpus import records_once
from quotewright.plans.text import tier_sql
from quotewright.runtime import table, written
from quotewright.sources.build import indexed_texts

_NOTHING_CITED = {"cited_family": "string", "cited_surah": "int", "cited_ayah": "int", "cited_collection": "string", "cited_number": "string"}
#: Another kind of text in each third of the quotations: verbatim, with kashida and other alefs, and one letter short.
_QUOTED = "CASE pmod(row_no, 3) WHEN 0 THEN text_ar WHEN 1 THEN concat('ـ', translate(text_ar, 'أإ', 'ٱٱ')) ELSE substring(text_ar, 1, length(text_ar) - 1) END"


def _reps(records: DataFrame) -> DataFrame:
    return corpus.representations(records, corpus.variants(records))


def _record_quotations(spark: SparkSession, sf_dir: str, cited: bool) -> DataFrame:
    """Each record's text quoted as `_QUOTED` says; with a citation, right for even rows and one off for odd ones."""
    r = table(spark, sf_dir, "records").select("row_no", F.expr(_QUOTED).alias("quoted"), "kind", "surah", "ayah", "collection", "hadith_no")
    if not cited:
        return r.select(F.col("row_no").alias("span_id"), "quoted", *[F.lit(None).cast(t).alias(c) for c, t in _NOTHING_CITED.items()])
    verse, off = F.col("kind") == "ayah", F.pmod("row_no", F.lit(2)).cast("int")
    return r.select(
        F.col("row_no").alias("span_id"), "quoted", F.when(verse, "verse").otherwise("collection").alias("cited_family"), F.when(verse, F.col("surah")).alias("cited_surah"), F.when(verse, F.col("ayah") + off).alias("cited_ayah"),
        F.when(~verse, F.col("collection")).alias("cited_collection"), F.when(~verse, F.concat("hadith_no", F.when(off == 1, "0").otherwise(""))).alias("cited_number"),
    )


def _exact(spark: SparkSession, sf_dir: str, cited: bool) -> DataFrame:
    from quotewright.functions.normalize import tiers

    spans = tiers(_record_quotations(spark, sf_dir, cited), "quoted")
    return op.exact_cascade(spans, _reps(records_once(spark, sf_dir))).select("span_id", "verdict", "tier", "record_id", "ties")


def verify_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _exact(spark, sf_dir, False)


def select_by_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _exact(spark, sf_dir, True)


def exact_ties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The other records that share a verbatim text."""
    from quotewright.functions.normalize import tiers

    reps = _reps(records_once(spark, sf_dir))
    spans = tiers(_record_quotations(spark, sf_dir, False), "quoted")
    return op.also_at(op.exact_cascade(spans, reps), {t: op.held_at(reps, t) for t in ("light", "standard")})


def quotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quotation spans of all documents, with the citation near each."""
    return extract.quotations(table(spark, sf_dir, "documents"), "doc_id", "text", extract.grammar_of(table(spark, sf_dir, "records")))


def citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.citations(table(spark, sf_dir, "documents"), "doc_id", "text", extract.grammar_of(table(spark, sf_dir, "records")))


def _spans(rows: DataFrame) -> DataFrame:
    return rows.withColumn("span_id", F.concat_ws(":", F.col("doc_id").cast("string"), F.col("span_no").cast("string")))


def _shown(found: DataFrame) -> DataFrame:
    """Verdicts with the diff as JSON."""
    return found.withColumn("diff", F.to_json("diff"))


def verify_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every quotation of every document through the whole cascade, similarity included."""
    records = records_once(spark, sf_dir)
    spans = _spans(quotations(spark, sf_dir))
    return _shown(op.verify(written(spans, "quotations"), records, _reps(records)))


def _cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = records_once(spark, sf_dir)
    spans = _spans(extract.quotations(table(spark, sf_dir, "eval_cases"), "item_id", "text", extract.grammar_of(records)))
    return op.verify(written(spans, "quotations"), records, _reps(records), score_misses=True)


def verify_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every quotation of the evaluation texts through the whole cascade, similarity included, misses scored."""
    return _shown(_cases(spark, sf_dir))


def _judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = F.split("span_id", ":")
    matches = _cases(spark, sf_dir).select(part[0].cast("long").alias("case_id"), part[1].cast("int").alias("span_no"), "verdict", "record_id")
    cases = table(spark, sf_dir, "eval_cases").select(F.col("item_id").alias("case_id"), "expect_verdict", "expect_record", "expect_no_quotation")
    return evaluate.judge(cases, matches).withColumn("problems", F.array_join("problems", ", "))


def eval_cases_judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _judged(spark, sf_dir)


def eval_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.summary(_judged(spark, sf_dir))


def case_diffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edits between what a case quotes and the record that its citation or verdict names."""
    spans = _spans(extract.quotations(table(spark, sf_dir, "eval_cases"), "item_id", "text", extract.grammar_of(table(spark, sf_dir, "records"))))
    expected = table(spark, sf_dir, "eval_cases").where("expect_record is not null").select(F.col("item_id").alias("doc_id"), F.col("expect_record").alias("id"))
    held = records_once(spark, sf_dir).select("id", F.col("text_ar").alias("canonical"))
    return op.with_diff(spans.join(expected, "doc_id").join(held, "id").select("span_id", "quoted", "canonical")).select("span_id", F.to_json("diff").alias("diff"))


def _index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All that the corpus index holds: primaries that may be scored and every variant."""
    records = records_once(spark, sf_dir)
    return indexed_texts(records, corpus.variants(records), table(spark, sf_dir, "translations").select("record_id", "source_id", "text").distinct())


_COLUMNS = ["norm_standard", "norm_aggressive", "translation"]


def _case_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The evaluation texts as sets of words."""
    words = F.array_distinct(F.filter(index_tokens(F.col("text")), lambda t: F.length(t) > 1))
    return table(spark, sf_dir, "eval_cases").select(F.col("item_id").alias("query_id"), words.alias("tokens"))


def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best representations of the whole index for each evaluation text."""
    texts = _index(spark, sf_dir)
    found = search.bm25(search.postings(texts, _COLUMNS), search.lengths_of(texts, _COLUMNS), _case_queries(spark, sf_dir), 10)
    return found.select("query_id", "doc_id", "score", F.col("rank").cast("long").alias("rank"))


def fts_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best records of twice as many ranked representations."""
    found = bm25_topk(spark, sf_dir).withColumn("doc_id", F.split("doc_id", "\x1f")[0])
    return search.distinct_records(found, "doc_id", 5).withColumn("rank", F.col("rank").cast("long"))


def claim_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten records for each evaluation text, sentence after sentence in the order in which they appear."""
    texts = _index(spark, sf_dir)
    parts = table(spark, sf_dir, "eval_cases").where("item_id is not null").select("item_id", F.posexplode(F.split("text", "[.:]")).alias("term_no", "part")).select("item_id", "term_no", F.array_distinct(F.filter(index_tokens(F.col("part")), lambda t: F.length(t) > 1)).alias("tokens"))
    numbered = parts.select(F.concat_ws(":", F.col("item_id").cast("string"), F.col("term_no").cast("string")).alias("query_id"), "tokens")
    found = search.bm25(search.postings(texts, _COLUMNS), search.lengths_of(texts, _COLUMNS), numbered, 20)
    ids = F.split("query_id", ":")
    by_term = found.select(ids[0].cast("long").alias("query_id"), ids[1].cast("int").alias("term_no"), F.split("doc_id", "\x1f")[0].alias("record_id"), "rank")
    return search.first_seen(by_term, 10).withColumn("rank", F.col("rank").cast("long"))


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """model, record_id, row_no, vec of the usable vectors: of the dim that most rows of their model have."""
    v = table(spark, sf_dir, "record_vectors").where("model is not null and record_id is not null")
    usual = v.groupBy("model", "dim").count().groupBy("model").agg(F.max(F.struct("count", (-F.col("dim")).alias("less"))).alias("top")).select("model", (-F.col("top.less")).alias("dim"))
    return v.join(usual, ["model", "dim"]).where("dtype = 'binary' and octet_length(vec) = ceil(dim / 8)").select("model", "record_id", "row_no", "vec")


def hamming_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest vectors of its model for the stated query set: every usable vector whose row number divides by 50."""
    v = written(_vectors(spark, sf_dir), "vectors")
    out = None
    for model in [r.model for r in v.select("model").distinct().orderBy("model").collect()]:  # a few models
        mine = v.where(F.col("model") == model)
        held = mine.groupBy("record_id").agg(F.max("vec").alias("vec"))
        near = search.hamming_topk(mine.where("row_no % 50 = 0").select(F.col("row_no").cast("string").alias("query_id"), "vec"), held, 10).withColumn("model", F.lit(model))
        out = near if out is None else out.unionByName(near)
    return out.withColumn("rank", F.col("rank").cast("long"))


def hybrid_retrieve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evaluation texts that expect a record: the text list and the neighbours of that record's vector, fused, with what was
    reached."""
    texts = _index(spark, sf_dir)
    held = written(_vectors(spark, sf_dir).where("model = 'enc-b2'").groupBy("record_id").agg(F.max("vec").alias("vec")), "vectors")
    asked = table(spark, sf_dir, "eval_cases").where("expect_record is not null").select(F.col("item_id").cast("string").alias("query_id"), F.col("expect_record").alias("record_id"))
    near = lambda: search.hamming_topk(asked.join(held, "record_id").select("query_id", "vec"), held, 50).select(F.col("query_id").cast("long").alias("query_id"), "record_id", "rank")
    terms = _case_queries(spark, sf_dir).withColumn("term_no", F.lit(0))
    found = ask.retrieve(terms, search.postings(texts, _COLUMNS), search.lengths_of(texts, _COLUMNS), near)
    return found.withColumn("rank", F.col("rank").cast("long"))


def rrf_fuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two rankings of each collection's records, by number of words and by text, fused."""
    from pyspark.sql import Window

    r = records_once(spark, sf_dir).where("collection is not null and norm_standard is not null").select(F.col("collection").alias("query_id"), F.col("id").alias("record_id"), F.length("norm_standard").alias("n"), "norm_standard")
    ranked = [r.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*o, "record_id"))).where("rank <= 50") for o in ([F.desc("n")], [F.col("norm_standard")])]
    return search.fuse(ranked, 24).withColumn("rank", F.col("rank").cast("long"))


def contains_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of one kind that contain a text of the other as a raw substring."""
    rows = table(spark, sf_dir, "records").select("id", "loaded_at", "row_no", "kind", "norm_standard")
    r = written(corpus.latest_rows(rows, ["id"], ["loaded_at", "row_no"]).where("norm_standard is not null").select("id", "kind", "norm_standard"), "records")
    return op.containing(r.where("kind = 'ayah'").select(F.col("id").alias("needle_id"), F.col("norm_standard").alias("needle")), r.where("kind = 'hadith'").select(F.col("id").alias("text_id"), F.col("norm_standard").alias("text")))


def withhold_disclose(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quoted records of one kind that stand within the other, with what is withheld: citations name the verse's own address."""
    from quotewright.functions.normalize import tiers

    # texts are worked out once and written; where they need only be equal, their digests take part
    spans = tiers(_record_quotations(spark, sf_dir, True), "quoted").select("span_id", *op.CITED, "norm_light", "norm_standard", "norm_aggressive")
    spans = written(op.by_digest(spans, ("light",)), "spans")
    rows = table(spark, sf_dir, "records").select("id", "loaded_at", "row_no", *op.ADDRESS, "text_ar", "addenda_ar", "unscorable_reason", "norm_light", "norm_standard", "norm_aggressive")
    verse = F.col("kind") == "ayah"
    slim = rows.select("id", "loaded_at", "row_no", *op.ADDRESS, "unscorable_reason", "addenda_ar", F.when(F.col("addenda_ar").isNotNull(), F.col("text_ar")).alias("text_ar"), *[F.when(verse, F.col(f"norm_{t}")).alias(f"verse_{t}") for t in ("standard", "aggressive")], "norm_light", "norm_standard", F.lit(None).cast("string").alias("norm_aggressive"))
    slim = written(corpus.latest_rows(op.by_digest(slim), ["id"], ["loaded_at", "row_no"]), "records")
    full = op.by_digest(corpus.variants(slim))
    reps = written(corpus.representations(slim, full).select("record_id", "variant", *op.ADDRESS, "norm_light", "norm_standard"), "reps")
    found = written(op.exact_cascade(op.by_digest(spans, ("standard",)), reps).select("span_id", "verdict", "record_id", "ties"), "found")
    records = slim.select("id", *op.ADDRESS, F.col("verse_standard").alias("norm_standard"), F.col("verse_aggressive").alias("norm_aggressive"))
    return op.withhold(found, op.contained(found, spans, records)).select("span_id", "verdict", "record_id", "contained_in")


DETECTORS = [
    rules.Rule("absolute", "(?i)\\b(every|each) (reader|teacher|student)\\b", "Speaks of all", "Needs a source."),
    rules.Rule("conclusion", "(?i)\\b(therefore|thus|hence)\\b", "Concludes", "Goes beyond a quotation."),
    rules.Rule("citation", "(?i)\\bal-[a-z]+ [0-9]+|\\bsection [0-9]+", "Cites", "To be checked."),
]
ROUTES = [("FIRST", [["(?i)\\b(my|me|mine)\\b", "(?i)\\b(must|should|can)\\b"]]), ("SECOND", [["(?i)\\bprohibition\\b"], ["(?i)\\bjurisprudence\\b"]]), ("THIRD", [["[؀-ۿ]"]])]


def detect_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.detect(table(spark, sf_dir, "documents").select("doc_id", "text"), DETECTORS).select("doc_id", "kind", "label")


def route_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = rules.route(F.col("text"), ROUTES, "GENERAL")
    return table(spark, sf_dir, "documents").select("doc_id", t.alias("route"), rules.requires(t, ["FIRST"]).alias("handed_on"))


def request_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that no request could hold."""
    return table(spark, sf_dir, "documents").select("doc_id", rules.request_problem("ask", F.col("text")).alias("problem")).where("problem is not null")


def overall_outcome(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The outcome of each source, if its records were one request."""
    sources = table(spark, sf_dir, "records").where("source_id is not null").select("row_no", F.col("source_id").alias("request"))
    matches = _exact(spark, sf_dir, False).join(sources, F.col("span_id") == F.col("row_no")).select("request", "verdict")
    handoff = table(spark, sf_dir, "sources").select(F.col("id").alias("request"), (F.col("kind") == "none").alias("handoff"))
    return rules.overall(matches, "request", handoff)


FORBIDDEN = {"no_consensus": "\\b(no|every|all) (scholars|teachers?)\\b", "no_grading": "\\b(sound|weak|authoritative)\\b"}


def _answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Translations as written answers about their record, which is a candidate if the corpus has it."""
    known = table(spark, sf_dir, "records").select(F.col("id").alias("known")).distinct()
    t = table(spark, sf_dir, "translations").join(known, F.col("record_id") == F.col("known"), "left")
    item = F.struct("record_id", F.col("text").alias("framing"), F.lit(None).cast("string").alias("translation"))
    return t.select(F.col("row_no").alias("answer_id"), F.col("text").alias("summary"), F.array(item).alias("items"), F.when(F.col("known").isNull(), F.array().cast("array<string>")).otherwise(F.array("known")).alias("candidate_ids"), F.array().cast("array<string>").alias("history_ids"))


def guard_battery(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.guards(_answers(spark, sf_dir), FORBIDDEN).select("answer_id", "guard", "passed")


def adjudicate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The decision on each answer, at its first or second try by its row number."""
    per = guard_battery(spark, sf_dir).groupBy("answer_id").agg(F.min("passed").alias("all_passed"))
    decision = rules.adjudicate(F.col("all_passed"), F.lit(None).cast("boolean"), F.pmod("answer_id", F.lit(5)) == 0, F.pmod("answer_id", F.lit(2)))
    return per.select("answer_id", decision.alias("decision"))


def answer_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The gate over answers, each of which must be blocked if its text is longer than 150 signs."""
    expected = table(spark, sf_dir, "translations").select(F.col("row_no").alias("answer_id"), (F.length("text") > 150).alias("must_block"))
    return evaluate.answer_gate(guard_battery(spark, sf_dir), expected)


QUERIES = {f.__name__: f for f in (
    verify_exact, select_by_reference, exact_ties, quotations, citations, verify_documents, verify_cases, eval_cases_judged, eval_gate, case_diffs, bm25_topk, fts_records,
    claim_candidates, hamming_topk, hybrid_retrieve, rrf_fuse, contains_lookup, withhold_disclose, detect_claims, route_documents, request_check, overall_outcome,
    guard_battery, adjudicate, answer_gate,
)}
QUERIES |= {"bm25_index_topk": bm25_topk, "fts_index_records": fts_records}  # the names that they had beside smaller ones

_ONCE = "once AS (SELECT * FROM records QUALIFY row_number() OVER (PARTITION BY id ORDER BY loaded_at DESC, row_no DESC) = 1)"
_SQL_QUOTED = "CASE row_no % 3 WHEN 0 THEN text_ar WHEN 1 THEN 'ـ' || translate(text_ar, 'أإ', 'ٱٱ') ELSE substring(text_ar, 1, length(text_ar) - 1) END"


def _exact_sql(cited: bool) -> str:
    verse = "r.kind = 'ayah'"
    family = f"CASE WHEN {verse} THEN 'verse' ELSE 'collection' END" if cited else "NULL"
    return f"""
WITH {_ONCE},
full_rows AS (SELECT id, kind, surah, ayah, collection, hadith_no, text_ar || ' ' || addenda_ar AS t FROM once WHERE addenda_ar IS NOT NULL AND text_ar IS NOT NULL),
reps AS (
  SELECT id AS record_id, kind, surah, ayah, collection, hadith_no, norm_light, norm_standard FROM once WHERE unscorable_reason IS NULL
  UNION ALL SELECT id, kind, surah, ayah, collection, hadith_no, {tier_sql('light', 't')}, {tier_sql('standard', 't')} FROM full_rows
), asked AS (
  SELECT row_no AS span_id, {tier_sql('light', 'q')} AS light, {tier_sql('standard', 'q')} AS standard, {family} AS cited_family, r.surah AS c_surah, r.ayah + row_no % 2 AS c_ayah, r.collection AS c_collection, r.hadith_no || CASE WHEN row_no % 2 = 1 THEN '0' ELSE '' END AS c_number
  FROM (SELECT *, {_SQL_QUOTED} AS q FROM records) r
), hits AS (
  SELECT a.*, p.*, 'light' AS tier FROM asked a JOIN reps p ON a.light = p.norm_light WHERE a.light <> ''
  UNION ALL SELECT a.*, p.*, 'standard' FROM asked a JOIN reps p ON a.standard = p.norm_standard WHERE a.standard <> ''
), best AS (SELECT * FROM hits QUALIFY tier = min(tier) OVER (PARTITION BY span_id)),
marked AS (
  SELECT *, CASE WHEN cited_family IS NULL THEN false WHEN cited_family = 'verse' THEN kind <> 'ayah' OR surah IS DISTINCT FROM c_surah OR (c_ayah IS NOT NULL AND ayah IS DISTINCT FROM c_ayah)
    ELSE kind = 'ayah' OR collection IS DISTINCT FROM c_collection OR hadith_no IS DISTINCT FROM c_number END AS conflict,
    cited_family IS NOT NULL AND (cited_family = 'verse') <> (kind = 'ayah') AS other FROM best
), chosen AS (
  SELECT *, count(DISTINCT record_id) OVER (PARTITION BY span_id) AS n FROM marked
  QUALIFY row_number() OVER (PARTITION BY span_id ORDER BY conflict, other, coalesce(surah, 0), coalesce(ayah, 0), record_id) = 1
)
"""


_CHOSEN = "SELECT span_id, CASE WHEN cited_family IS NOT NULL AND conflict THEN 'WRONG_REFERENCE' WHEN tier = 'light' THEN 'EXACT' ELSE 'EXACT_ORTHOGRAPHY' END AS verdict, tier, record_id, (SELECT count(DISTINCT m.record_id) FROM marked m WHERE m.span_id = c.span_id) AS ties FROM (SELECT * FROM marked QUALIFY row_number() OVER (PARTITION BY span_id ORDER BY conflict, other, coalesce(surah, 0), coalesce(ayah, 0), record_id) = 1) c"
_EXACT_SQL = {c: _exact_sql(c).rsplit(", chosen AS", 1)[0] for c in (False, True)}

_TOKENS = "list_filter(string_split(regexp_replace(regexp_replace(lower({0}), '\\p{{Mn}}', '', 'g'), '[^\\p{{L}}\\p{{N}}\\p{{Co}}]+', ' ', 'g'), ' '), lambda x: x <> '')"
_BM25 = f"""
WITH {_ONCE}, tr AS (SELECT record_id, string_agg(text, ' ' ORDER BY text) AS translation FROM (SELECT DISTINCT record_id, text FROM translations) GROUP BY 1),
docs AS (SELECT id AS doc_id, list_concat(list_concat({_TOKENS.format('norm_standard')}, {_TOKENS.format('norm_aggressive')}), coalesce({_TOKENS.format('translation')}, [])) AS tokens FROM once LEFT JOIN tr ON id = record_id WHERE norm_standard IS NOT NULL),
lens AS (SELECT doc_id, len(tokens) AS doc_len FROM docs), size AS (SELECT count(*) AS n, avg(doc_len) AS average FROM lens),
post AS (SELECT doc_id, token, count(*) AS tf FROM (SELECT doc_id, unnest(tokens) AS token FROM docs) GROUP BY ALL),
asked AS (SELECT item_id AS query_id, unnest(list_distinct(list_filter({_TOKENS.format('text')}, lambda x: length(x) > 1))) AS token FROM eval_cases),
df AS (SELECT token, count(*) AS df FROM post GROUP BY token),
scored AS (
  SELECT query_id, p.doc_id, floor(sum(greatest(CASE WHEN ln((n - df + 0.5) / (df + 0.5)) > 0 THEN ln((n - df + 0.5) / (df + 0.5)) ELSE 1e-6 END, 0) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * doc_len / average))) * 1000000 + 0.5)::BIGINT AS score
  FROM asked a JOIN post p ON a.token = p.token JOIN df d ON d.token = a.token JOIN lens l ON l.doc_id = p.doc_id CROSS JOIN size GROUP BY ALL
), ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM scored QUALIFY rank <= 10)
"""
_BM25_INDEX = _BM25.replace(_BM25[_BM25.index("tr AS ("):_BM25.index("lens AS (")], f"""tr AS (SELECT record_id, string_agg(text, ' ' ORDER BY source_id, text) AS translation FROM (SELECT DISTINCT record_id, source_id, text FROM translations) GROUP BY 1),
held AS (
  SELECT id || chr(31) || 'primary' AS doc_id, norm_standard AS s, norm_aggressive AS a, translation FROM once LEFT JOIN tr ON id = record_id WHERE unscorable_reason IS NULL
  UNION ALL SELECT id || chr(31) || 'full', {tier_sql('standard', 't')}, {tier_sql('aggressive', 't')}, NULL FROM (SELECT id, text_ar || ' ' || addenda_ar AS t FROM once WHERE addenda_ar IS NOT NULL AND text_ar IS NOT NULL)
), docs AS (SELECT doc_id, list_concat(list_concat(coalesce({_TOKENS.format('s')}, []), coalesce({_TOKENS.format('a')}, [])), coalesce({_TOKENS.format('translation')}, [])) AS tokens FROM held),
""")
_GUARDS = """
WITH g AS (SELECT t.row_no AS answer_id, t.record_id IN (SELECT id FROM records) AS known, lower(t.text) AS low, t.text, len(list_filter(string_split(trim(regexp_replace(t.text, '\\s+', ' ', 'g')), ' '), lambda x: x <> '')) AS words FROM translations t),
rows AS (
  SELECT answer_id, 'cited_id_in_candidates' AS guard, known AS passed FROM g
  UNION ALL SELECT answer_id, 'no_arabic_in_prose', NOT regexp_matches(text, '[\\x{600}-\\x{6ff}\\x{750}-\\x{77f}\\x{870}-\\x{8ff}\\x{fb50}-\\x{fdff}\\x{fe70}-\\x{feff}]') FROM g
  UNION ALL SELECT answer_id, 'length', words <= 25 FROM g
  UNION ALL SELECT answer_id, 'no_consensus', NOT regexp_matches(low || ' ' || low, '\\b(no|every|all) (scholars|teachers?)\\b') FROM g
  UNION ALL SELECT answer_id, 'no_grading', NOT regexp_matches(low || ' ' || low, '\\b(sound|weak|authoritative)\\b') FROM g
)
"""
_AGREES = "a.cited_family IS NOT NULL AND a.cited_family = 'verse' AND v.surah IS NOT DISTINCT FROM a.c_surah AND (a.c_ayah IS NULL OR v.ayah IS NOT DISTINCT FROM a.c_ayah)"
_BM25_PARTS = _BM25_INDEX.replace("rank <= 10", "rank <= 20").replace(
    _BM25_INDEX[_BM25_INDEX.index("asked AS ("):_BM25_INDEX.index("df AS (SELECT token")],
    f"parts AS (SELECT item_id, unnest(string_split_regex(text, '[.:]')) AS part, unnest(range(len(string_split_regex(text, '[.:]')))) AS term_no FROM eval_cases WHERE item_id IS NOT NULL),\n"
    f"asked AS (SELECT item_id || ':' || term_no AS query_id, unnest(list_distinct(list_filter({_TOKENS.format('part')}, lambda x: length(x) > 1))) AS token FROM parts),\n",
)
_USUAL = "dims AS (SELECT model, dim AS usual FROM (SELECT model, dim, count(*) AS n FROM record_vectors WHERE model IS NOT NULL AND record_id IS NOT NULL GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY model ORDER BY n DESC, dim) = 1),\nu AS (SELECT r.* FROM record_vectors r JOIN dims d ON r.model = d.model AND r.dim = d.usual WHERE r.dtype = 'binary' AND r.record_id IS NOT NULL AND octet_length(r.vec) = (r.dim + 7) // 8)"
SQL = {
    "withhold_disclose": _EXACT_SQL[True] + f"""
, selected AS ({_CHOSEN}), wide AS (SELECT row_no AS span_id, {tier_sql('aggressive', 'q')} AS aggressive FROM (SELECT *, {_SQL_QUOTED} AS q FROM records)),
inside AS (
  SELECT s.span_id, max({_AGREES}) AS agrees, count(*) FILTER (a.standard <> '' AND contains(v.norm_standard, a.standard)) AS n
  FROM selected s JOIN once h ON h.id = s.record_id AND h.kind = 'hadith' JOIN asked a ON a.span_id = s.span_id JOIN wide w ON w.span_id = s.span_id
  JOIN once v ON v.kind = 'ayah' AND v.norm_aggressive IS NOT NULL AND length(w.aggressive) >= 2 AND contains(v.norm_aggressive, w.aggressive) GROUP BY s.span_id
)
SELECT s.span_id, CASE WHEN agrees THEN 'NOT_FOUND' ELSE verdict END AS verdict, CASE WHEN NOT coalesce(agrees, false) THEN record_id END AS record_id, coalesce(n, 0) AS contained_in FROM selected s LEFT JOIN inside i ON i.span_id = s.span_id""",
    "claim_candidates": _BM25_PARTS + """, seen AS (SELECT split_part(query_id, ':', 1)::BIGINT AS query_id, split_part(doc_id, chr(31), 1) AS record_id, min({'term': split_part(query_id, ':', 2)::INT, 'rank': rank}) AS place FROM ranked GROUP BY ALL)
SELECT query_id, record_id, row_number() OVER (PARTITION BY query_id ORDER BY place.term, place.rank, record_id) AS rank FROM seen QUALIFY rank <= 10""",
    "hybrid_retrieve": _BM25_INDEX.replace("rank <= 10", "rank <= 100") + f""", {_USUAL},
listed AS (SELECT query_id, record_id, row_number() OVER (PARTITION BY query_id ORDER BY first, record_id) AS rank FROM (SELECT query_id, split_part(doc_id, chr(31), 1) AS record_id, min(rank) AS first FROM ranked GROUP BY ALL) QUALIFY rank <= 50),
v AS (SELECT record_id, max(vec) AS vec FROM u WHERE model = 'enc-b2' GROUP BY 1),
near AS (SELECT e.item_id AS query_id, v.record_id, row_number() OVER (PARTITION BY e.item_id ORDER BY bit_count(xor(q.vec::BIT, v.vec::BIT)), v.record_id) AS rank FROM eval_cases e JOIN v q ON q.record_id = e.expect_record CROSS JOIN v QUALIFY rank <= 50),
fused AS (SELECT query_id, record_id, sum(floor(1000000000.0::DOUBLE / (60 + rank - 1)))::BIGINT AS score FROM (SELECT query_id, record_id, rank FROM listed UNION ALL SELECT * FROM near) GROUP BY ALL)
SELECT f.query_id, f.record_id, f.score, row_number() OVER (PARTITION BY f.query_id ORDER BY score DESC, f.record_id) AS rank, l.record_id IS NOT NULL AS in_text, n.record_id IS NOT NULL AS in_vector
FROM fused f LEFT JOIN listed l ON l.query_id = f.query_id AND l.record_id = f.record_id LEFT JOIN near n ON n.query_id = f.query_id AND n.record_id = f.record_id QUALIFY row_number() OVER (PARTITION BY f.query_id ORDER BY score DESC, f.record_id) <= 24""",
    "verify_exact": _EXACT_SQL[False] + _CHOSEN,
    "select_by_reference": _EXACT_SQL[True] + _CHOSEN,
    "exact_ties": _EXACT_SQL[False] + f", selected AS ({_CHOSEN}) SELECT DISTINCT b.span_id, b.record_id FROM best b JOIN selected s ON b.span_id = s.span_id AND b.record_id <> s.record_id",
    "bm25_topk": _BM25_INDEX + "SELECT query_id, doc_id, score, rank FROM ranked",
    "fts_records": _BM25_INDEX + "SELECT query_id, record_id, row_number() OVER (PARTITION BY query_id ORDER BY first, record_id) AS rank FROM (SELECT query_id, split_part(doc_id, chr(31), 1) AS record_id, min(rank) AS first FROM ranked GROUP BY ALL) QUALIFY rank <= 5",
    "hamming_topk": """
WITH dims AS (SELECT model, dim AS usual FROM (SELECT model, dim, count(*) AS n FROM record_vectors WHERE model IS NOT NULL AND record_id IS NOT NULL GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY model ORDER BY n DESC, dim) = 1),
u AS (SELECT r.* FROM record_vectors r JOIN dims d ON r.model = d.model AND r.dim = d.usual WHERE r.dtype = 'binary' AND r.record_id IS NOT NULL AND octet_length(r.vec) = (r.dim + 7) // 8),
v AS (SELECT model, record_id, max(vec) AS vec FROM u GROUP BY ALL),
asked AS (SELECT model, row_no::VARCHAR AS query_id, vec FROM u WHERE row_no % 50 = 0)
SELECT a.model, query_id, record_id, bit_count(xor(a.vec::BIT, v.vec::BIT))::BIGINT AS distance, row_number() OVER (PARTITION BY query_id ORDER BY bit_count(xor(a.vec::BIT, v.vec::BIT)), record_id) AS rank FROM asked a JOIN v ON a.model = v.model QUALIFY rank <= 10""",
    "rrf_fuse": f"""
WITH {_ONCE}, r AS (SELECT collection AS query_id, id AS record_id, length(norm_standard) AS n, norm_standard AS t FROM once WHERE collection IS NOT NULL AND norm_standard IS NOT NULL),
lists AS (SELECT query_id, record_id, row_number() OVER (PARTITION BY query_id ORDER BY n DESC, record_id) AS k FROM r UNION ALL SELECT query_id, record_id, row_number() OVER (PARTITION BY query_id ORDER BY t, record_id) FROM r),
fused AS (SELECT query_id, record_id, sum(floor(1000000000.0::DOUBLE / (60 + k - 1)))::BIGINT AS score FROM lists WHERE k <= 50 GROUP BY ALL)
SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, record_id) AS rank FROM fused QUALIFY rank <= 24""",
    "contains_lookup": f"WITH {_ONCE} SELECT a.id AS needle_id, h.id AS text_id FROM once a JOIN once h ON a.kind = 'ayah' AND h.kind = 'hadith' AND length(a.norm_standard) >= 2 AND contains(h.norm_standard, a.norm_standard)",
    "detect_claims": "SELECT doc_id, kind, label FROM (" + " UNION ALL ".join(f"SELECT doc_id, '{r.kind}' AS kind, '{r.label}' AS label FROM documents WHERE regexp_matches(text, '{r.pattern}')" for r in DETECTORS) + ")",
    "route_documents": "SELECT doc_id, route, route = 'FIRST' AS handed_on FROM (SELECT doc_id, CASE " + " ".join(f"WHEN {' OR '.join('(' + ' AND '.join(f"regexp_matches(coalesce(text, {chr(39)}{chr(39)}), '{p}')" for p in group) + ')' for group in groups)} THEN '{code}'" for code, groups in ROUTES) + " ELSE 'GENERAL' END AS route FROM documents)",
    "request_check": "SELECT doc_id, CASE WHEN text IS NULL OR trim(text, ' ') = '' THEN 'blank' ELSE 'too long' END AS problem FROM documents WHERE text IS NULL OR trim(text, ' ') = '' OR length(text) > 2000",
    "overall_outcome": _EXACT_SQL[False] + f", selected AS ({_CHOSEN}), per AS (SELECT source_id AS request, max(verdict IN ('WRONG_REFERENCE', 'NOT_FOUND', 'NEAR_MATCH')) AS review FROM selected JOIN records ON span_id = row_no GROUP BY 1) SELECT id AS request, CASE WHEN kind = 'none' THEN 'handoff' WHEN review IS NULL THEN 'insufficient_span' WHEN review THEN 'needs_review' ELSE 'grounded' END AS outcome FROM sources LEFT JOIN per ON id = request",
    "guard_battery": _GUARDS + "SELECT * FROM rows",
    "adjudicate": _GUARDS + "SELECT answer_id, CASE WHEN NOT min(passed) AND answer_id % 2 = 0 THEN 'RETRY' WHEN NOT min(passed) THEN 'ABSTAIN' WHEN answer_id % 5 = 0 THEN 'RELABEL_INTERPRETATION' ELSE 'PUBLISH' END AS decision FROM rows GROUP BY answer_id",
    "answer_gate": _GUARDS + "SELECT answer_id, CASE WHEN blocked = (length(text) > 150) THEN 'ok' WHEN length(text) > 150 THEN 'not blocked' ELSE 'blocked' END AS outcome FROM (SELECT answer_id, NOT min(passed) AS blocked FROM rows GROUP BY answer_id) JOIN translations ON row_no = answer_id",
}
SQL |= {"bm25_index_topk": SQL["bm25_topk"], "fts_index_records": SQL["fts_records"]}
