"""Queries over small literal tables, whose SQL states the expected rows: shapes of citations and quotations, verdicts, ties,
diffs and the evaluation gate. They check what SQL can't express over the large tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quotewright.operators import corpus, evaluate, extract
from quotewright.operators import verify as op

GRAMMAR = extract.Grammar(
    {"zarfan": "zarfan", "al-zarfan": "zarfan", "sunan zarfan": "zarfan", "ibn birqas": "birqas", "kitab ibn birqas": "birqas"}, {"zarfan": 3000, "birqas": 450}, {1: 7, 2: 286, 12: 111},
    {"Al-Fatihah": 1, "Al-Baqarah": 2, "Yusuf": 12, "Hud": 2}, {"زرفان": "zarfan", "ابن برقاس": "birqas"},
)
#: Texts with citations.
CITING = [
    (1, "See 2:255 and 2：256, also ٢:١."), (2, "Zarfan 12, al-Zarfan no. 0013, sunan  zarfan hadith 14"), (3, "alzarfan #15; ZARFAN number 3001"), (4, "Zarfan book 3, hadith 9 and Zarfan 1:2"),
    (5, "Ibn Birqas 450 but ibn birqas 451"), (6, "رواه ابن برقاس حديث ٧ ثم زرفان 8"), (7, "surah Yusuf, Al-Baqarah; Yusuf went home"), (8, "Al-Baqarah 2:5 and the chapter Hud"),
    (9, "1234:5, 2:2555, x2:255, 9:9"), (10, "Kitab Ibn Birqas, 17: a text"), (11, ""), (12, None), (13, "2 : 7 and 1:2:3"),
]
#: Texts with quotations.
QUOTING = [
    (1, "He said «قل هو الحق» (2:255), then “ab” and «ق»."), (2, "ثم قال رسولهم and more"), (3, "«زرفان ٧»"), (4, "\"قل\" \"هو الذي\" «» «open"), (5, "Zarfan 7 " + "x " * 90 + "«قل هو»"), (6, "«قال زرفان ٧ كلاما»  (1:1)"), (7, None), (8, "قل قل"),
]
_RECORDS = "id string, kind string, surah int, ayah int, collection string, hadith_no string, text_ar string, addenda_ar string, unscorable_reason string, bismillah string"
PREFIX = "بِسْمِ ٱلرَّبِّ"
#: A corpus.
RECORDS = [
    ("quran:1:1", "ayah", 1, 1, None, None, "إن الملك على كل شيء قدير وهو السميع", None, None, PREFIX),
    ("quran:2:5", "ayah", 2, 5, None, None, "تبارك الذي بيده الملك وهو على كل شيء", None, None, None),
    ("quran:2:6", "ayah", 2, 6, None, None, "تبارك الذي بيده الملك وهو على كل شيء", None, None, None),
    ("quran:3:1", "ayah", 3, 1, None, None, "تنزيل الكتاب من العزيز الحكيم", None, None, PREFIX),
    ("quran:4:2", "ayah", 4, 2, None, None, "تنزيل الكتاب من العزيز الحكيم", None, None, None),
    ("quran:5:1", "ayah", 5, 1, None, None, "وما كان لنفس أن تؤمن إلا بإذن ربه", None, None, PREFIX),
    ("quran:5:3", "ayah", 5, 3, None, None, "وما كان لنفس أن تؤمن إلا بإذن ربها", None, None, None),
    ("hadith:c:7", "hadith", None, None, "c", "7", "الملك وهو على كل", "وزاد فيه رجل من القوم كلاما طويلا", None, None),
    ("hadith:c:8", "hadith", None, None, "c", "8", "نص لا يحسب أبدا في الميزان", None, "fragment", None),
    ("hadith:c:9", "hadith", None, None, "c", "9", "كلمة أولى وثانية وثالثة ورابعة في البيت القديم", None, None, None),
    ("hadith:d:9", "hadith", None, None, "d", "9", "كلمة أولى وثانية وثالثة ورابعة في البيت القديم", None, None, None),
]
_N = (None,) * 5
#: Quotations of it, with the citation near each.
QUOTED = [
    ("01", "إن الملك على كل شيء قدير وهو السميع", *_N), ("02", "إنَّ المـلك على كل شيء قدير وهو السميع", *_N), ("03", "ان الملك علي كل شيء قدير وهو السميع", *_N), ("04", "كلام آخر ليس فيه", *_N),
    ("05", "تبارك الذي بيده الملك وهو على كل شيء", *_N), ("06", "تبارك الذي بيده الملك وهو على كل شيء", "verse", 2, 6, None, None), ("07", "تبارك الذي بيده الملك وهو على كل شيء", "verse", 9, 9, None, None), ("08", "تبارك الذي بيده الملك وهو على كل شيء", "collection", None, None, "c", "7"),
    ("09", "بسم الرب تنزيل الكتاب من العزيز الحكيم", *_N), ("10", "بسم الرب تنزيل الكتاب من العزيز الحكيم", "verse", 4, 2, None, None), ("11", "بسم الرب وما كان لنفس أن تؤمن إلا بإذن ربها", *_N), ("12", "بسمِ  ٱلرب وما كان لنفس أن تؤمن إلا بإذن ربه", *_N), ("13", "بسم الرب", *_N),
    ("14", "الملك وهو على كل", *_N), ("15", "الملك وهو على كل", "verse", 2, 6, None, None), ("16", "الملك وهو على كل", "collection", None, None, "c", "7"), ("17", "الملك وهو على كل وزاد فيه رجل من القوم كلاما طويلا", *_N), ("18", "نص لا يحسب أبدا في الميزان", *_N),
    ("19", "كلمة أولى وثانية وثالثة ورابعة في البيت القدبم", *_N), ("20", "كلمة أولى وثانية وثالثة ورابعة في البيت القدبم", "collection", None, None, "d", "9"), ("21", "كلمة أولى وثانية وثالثة ورابعة في البيت القدبم", "verse", 1, 1, None, None), ("22", " ", *_N), ("23", None, *_N),
]
_QUOTED = "span_id string, quoted string, cited_family string, cited_surah int, cited_ayah int, cited_collection string, cited_number string"
#: Cases of the gate and what their spans came to.
CASES = [(1, "EXACT", "a", None, None, None, None), (2, "EXACT", None, None, 2, None, None), (3, "NOT_FOUND", None, None, None, None, None), (4, None, None, True, None, None, None), (5, "WRONG_REFERENCE", None, None, None, None, None), (6, None, None, None, None, "NOT_FOUND", "a"), (7, None, None, False, None, None, None), (8, "NEAR_MATCH", "b", None, None, None, None)]
_CASES = "case_id int, expect_verdict string, expect_record string, expect_no_quotation boolean, expect_verified_spans int, forbid_verdict string, expect_no_other_record string"
MATCHES = [(1, 0, "EXACT", "a"), (1, 1, "EXACT", "b"), (2, 0, "EXACT", "a"), (2, 1, "EXACT_ORTHOGRAPHY", "b"), (3, 0, "WRONG_REFERENCE", "c"), (5, 0, "WRONG_REFERENCE", "d"), (6, 0, "NOT_FOUND", None), (6, 1, "EXACT", "b"), (8, 0, "NEAR_MATCH", "b")]


def citation_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every shape of citation, with offsets."""
    return extract.citations(spark.createDataFrame(CITING, "doc_id int, text string"), "doc_id", "text", GRAMMAR)


def quotation_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every shape of quotation, with the citation nearest to it."""
    return extract.quotations(spark.createDataFrame(QUOTING, "doc_id int, text string"), "doc_id", "text", GRAMMAR)


def _verified(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    records = corpus.derive(spark.createDataFrame(RECORDS, _RECORDS))
    return op.verify_with_ties(spark.createDataFrame(QUOTED, _QUOTED), records, corpus.representations(records, corpus.variants(records)), score_misses=True)


def verdict_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stage of the cascade."""
    rows = _verified(spark)[0]
    return rows.select("span_id", "verdict", "tier", "record_id", F.floor(F.col("score") * 10000 + 0.5).cast("long").alias("score_1e4"), "ties", "contained_in", F.array_join(F.transform("diff", lambda d: F.concat_ws("=", d.op, d.text)), "|").alias("diff"))


def verdict_ties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The records that tie with those selected."""
    return _verified(spark)[1]


def gate_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Budgets and constraints of evaluation cases."""
    judged = evaluate.judge(spark.createDataFrame(CASES, _CASES), spark.createDataFrame(MATCHES, "case_id int, span_no int, verdict string, record_id string"))
    return judged.withColumn("problems", F.array_join("problems", ", "))


QUERIES = {f.__name__: f for f in (citation_shapes, quotation_shapes, verdict_cases, verdict_ties, gate_cases)}
#: The expected rows, read over one by one against what each stage is defined to do; scores by a plain edit distance.
SQL = {
    "citation_shapes": """SELECT doc_id::INTEGER AS doc_id, citation_no::INTEGER AS citation_no, family::VARCHAR AS family, surah::INTEGER AS surah, ayah::INTEGER AS ayah, collection::VARCHAR AS collection, number::VARCHAR AS number, raw::VARCHAR AS raw, citation_start::INTEGER AS citation_start, citation_end::INTEGER AS citation_end, resolved::BOOLEAN AS resolved FROM (VALUES
  (1, 0, 'verse', 2, 255, NULL, NULL, '2:255', 4, 9, true),
  (1, 1, 'verse', 2, 256, NULL, NULL, '2：256', 14, 19, true),
  (1, 2, 'verse', 2, 1, NULL, NULL, '٢:١', 26, 29, true),
  (2, 0, 'collection', NULL, NULL, 'zarfan', '12', 'Zarfan 12', 0, 9, true),
  (2, 1, 'collection', NULL, NULL, 'zarfan', '13', 'al-Zarfan no. 0013', 11, 29, true),
  (2, 2, 'collection', NULL, NULL, 'zarfan', '14', 'sunan  zarfan hadith 14', 31, 54, true),
  (3, 0, 'collection', NULL, NULL, 'zarfan', '15', 'alzarfan #15', 0, 12, true),
  (3, 1, 'collection', NULL, NULL, 'zarfan', NULL, 'ZARFAN number 3001', 14, 32, false),
  (4, 0, 'collection', NULL, NULL, 'zarfan', NULL, 'Zarfan book 3, hadith 9', 0, 23, false),
  (4, 1, 'collection', NULL, NULL, 'zarfan', NULL, 'Zarfan 1:2', 28, 38, false),
  (5, 0, 'collection', NULL, NULL, 'birqas', '450', 'Ibn Birqas 450', 0, 14, true),
  (5, 1, 'collection', NULL, NULL, 'birqas', NULL, 'ibn birqas 451', 19, 33, false),
  (6, 0, 'collection', NULL, NULL, 'birqas', '7', 'رواه ابن برقاس حديث ٧', 0, 21, true),
  (6, 1, 'collection', NULL, NULL, 'zarfan', '8', 'زرفان 8', 25, 32, true),
  (7, 0, 'verse', 12, NULL, NULL, NULL, 'Yusuf', 6, 11, true),
  (7, 1, 'verse', 2, NULL, NULL, NULL, 'Al-Baqarah', 13, 23, true),
  (8, 0, 'verse', 2, 5, NULL, NULL, '2:5', 11, 14, true),
  (10, 0, 'collection', NULL, NULL, 'birqas', '17', 'Kitab Ibn Birqas, 17', 0, 20, true),
  (13, 0, 'verse', 2, 7, NULL, NULL, '2 : 7', 0, 5, true),
  (13, 1, 'verse', 1, 2, NULL, NULL, '1:2', 10, 13, true)) AS t(doc_id, citation_no, family, surah, ayah, collection, number, raw, citation_start, citation_end, resolved)""",
    "quotation_shapes": """SELECT doc_id::INTEGER AS doc_id, span_no::INTEGER AS span_no, quoted::VARCHAR AS quoted, span_start::INTEGER AS span_start, span_end::INTEGER AS span_end, span_kind::VARCHAR AS span_kind, cited_family::VARCHAR AS cited_family, cited_surah::INTEGER AS cited_surah, cited_ayah::INTEGER AS cited_ayah, cited_collection::VARCHAR AS cited_collection, cited_number::VARCHAR AS cited_number, cited_raw::VARCHAR AS cited_raw FROM (VALUES
  (1, 0, 'قل هو الحق', 9, 19, 'wrapped', 'verse', 2, 255, NULL, NULL, '2:255'),
  (2, 0, 'ثم قال رسولهم', 0, 13, 'arabic-run', NULL, NULL, NULL, NULL, NULL, NULL),
  (4, 0, 'قل', 1, 3, 'wrapped', NULL, NULL, NULL, NULL, NULL, NULL),
  (4, 1, 'هو الذي', 6, 13, 'wrapped', NULL, NULL, NULL, NULL, NULL, NULL),
  (5, 0, 'قل هو', 190, 195, 'wrapped', NULL, NULL, NULL, NULL, NULL, NULL),
  (6, 0, 'قال زرفان ٧ كلاما', 1, 18, 'wrapped', 'collection', NULL, NULL, 'zarfan', '7', 'زرفان ٧')) AS t(doc_id, span_no, quoted, span_start, span_end, span_kind, cited_family, cited_surah, cited_ayah, cited_collection, cited_number, cited_raw)""",
    "verdict_cases": """SELECT span_id::VARCHAR AS span_id, verdict::VARCHAR AS verdict, tier::VARCHAR AS tier, record_id::VARCHAR AS record_id, score_1e4::BIGINT AS score_1e4, ties::BIGINT AS ties, contained_in::BIGINT AS contained_in, diff::VARCHAR AS diff FROM (VALUES
  ('01', 'EXACT', 'light', 'quran:1:1', 10000, 1, 0, NULL),
  ('02', 'EXACT_ORTHOGRAPHY', 'standard', 'quran:1:1', 10000, 1, 0, NULL),
  ('03', 'NEAR_MATCH', 'aggressive', 'quran:1:1', 10000, 1, 0, 'equal=ان الملك عل|quoted-only=ي|corpus-only=ى|equal= كل شيء قدير وهو السميع'),
  ('04', 'NOT_FOUND', NULL, NULL, 2000, 0, 0, NULL),
  ('05', 'EXACT', 'light', 'quran:2:5', 10000, 2, 0, NULL),
  ('06', 'EXACT', 'light', 'quran:2:6', 10000, 2, 0, NULL),
  ('07', 'WRONG_REFERENCE', 'light', 'quran:2:5', 10000, 2, 0, NULL),
  ('08', 'WRONG_REFERENCE', 'light', 'quran:2:5', 10000, 2, 0, NULL),
  ('09', 'EXACT', 'light', 'quran:3:1', 10000, 2, 0, NULL),
  ('10', 'WRONG_REFERENCE', 'light', 'quran:3:1', 10000, 2, 0, NULL),
  ('11', 'NOT_FOUND', NULL, NULL, 7907, 0, 0, NULL),
  ('12', 'EXACT', 'light', 'quran:5:1', 10000, 1, 0, NULL),
  ('13', 'NOT_FOUND', NULL, NULL, 0, 0, 0, NULL),
  ('14', 'EXACT', 'light', 'hadith:c:7', 10000, 1, 2, NULL),
  ('15', 'NOT_FOUND', NULL, NULL, 0, 0, 2, NULL),
  ('16', 'EXACT', 'light', 'hadith:c:7', 10000, 1, 2, NULL),
  ('17', 'EXACT', 'light', 'hadith:c:7', 10000, 1, 0, NULL),
  ('18', 'NOT_FOUND', NULL, NULL, 3261, 0, 0, NULL),
  ('19', 'NEAR_MATCH', 'aggressive', 'hadith:c:9', 9783, 2, 0, 'equal=كلمة اولى وثانية وثالثة ورابعة في البيت القد|quoted-only=ب|corpus-only=ي|equal=م'),
  ('20', 'NEAR_MATCH', 'aggressive', 'hadith:d:9', 9783, 2, 0, 'equal=كلمة اولى وثانية وثالثة ورابعة في البيت القد|quoted-only=ب|corpus-only=ي|equal=م'),
  ('21', 'NEAR_MATCH', 'aggressive', 'hadith:c:9', 9783, 2, 0, 'equal=كلمة اولى وثانية وثالثة ورابعة في البيت القد|quoted-only=ب|corpus-only=ي|equal=م'),
  ('22', 'NOT_FOUND', NULL, NULL, 0, 0, 0, NULL),
  ('23', 'NOT_FOUND', NULL, NULL, 0, 0, 0, NULL)) AS t(span_id, verdict, tier, record_id, score_1e4, ties, contained_in, diff)""",
    "verdict_ties": """SELECT span_id::VARCHAR AS span_id, record_id::VARCHAR AS record_id FROM (VALUES
  ('05', 'quran:2:6'),
  ('06', 'quran:2:5'),
  ('07', 'quran:2:6'),
  ('08', 'quran:2:6'),
  ('09', 'quran:4:2'),
  ('10', 'quran:4:2'),
  ('19', 'hadith:d:9'),
  ('20', 'hadith:c:9'),
  ('21', 'hadith:d:9')) AS t(span_id, record_id)""",
    "gate_cases": """SELECT case_id::INTEGER AS case_id, first_verdict::VARCHAR AS first_verdict, excess_verified::BIGINT AS excess_verified, excess_misattributed::BIGINT AS excess_misattributed, problems::VARCHAR AS problems, passed::BOOLEAN AS passed FROM (VALUES
  (1, 'EXACT', 1, 0, 'false verification', false),
  (2, 'EXACT', 0, 0, '', true),
  (3, 'WRONG_REFERENCE', 0, 1, 'false misattribution, verdict', false),
  (4, NULL, 0, 0, '', true),
  (5, 'WRONG_REFERENCE', 0, 0, '', true),
  (6, 'NOT_FOUND', 1, 0, 'false verification, forbidden verdict, another record', false),
  (7, NULL, 0, 0, 'quotations', false),
  (8, 'NEAR_MATCH', 0, 0, '', true)) AS t(case_id, first_verdict, excess_verified, excess_misattributed, problems, passed)""",
}
