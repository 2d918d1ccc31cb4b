"""Core operators: string semantics against plain Python, edge cases, and small end-to-end runs."""

import random
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from quotewright.functions import normalize as norm
from quotewright.functions import similarity, spec, text
from quotewright.operators import ask, bloom, corpus, evaluate, extract, orphans, rules, search, verify
from quotewright.sources import manifest, markdown, scripture
from quotewright.streaming import audit

SAMPLES = ["", " ", "قُلْ هُوَ", "ٱلرَّحْمَـٰنِ", "أإآا", "آل", "على رحمة", "abc ١٢", "x y z", "a\x1cb", "é é", "ﻻ ک", "\n  ـ ", "ۖ نص ۗ", "😀 نص", None]


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def one(spark, column, value):
    return spark.createDataFrame([(value,)], "v string").select(column(F.col("v"))).first()[0]


# -- normalisation


@pytest.mark.parametrize("tier", spec.TIERS)
def test_tier_columns_follow_the_plain_functions(spark, tier):
    rng, signs = random.Random(1), "قُلآأـة ى١ٰٓۖ  a-é"
    values = SAMPLES + ["".join(rng.choice(signs) for _ in range(rng.randint(0, 14))) for _ in range(300)]
    got = spark.createDataFrame(list(enumerate(values)), "n int, t string").select("n", norm.normalize(F.col("t"), tier).alias("o")).orderBy("n").collect()
    for r in got:
        assert r.o == spec.normalize(values[r.n], tier)
        assert r.o is None or spec.normalize(r.o, tier) == r.o


def test_unknown_tier_raises():
    with pytest.raises(ValueError):
        spec.normalize("x", "other")
    with pytest.raises(ValueError):
        norm.normalize(F.lit("x"), "other")


def test_every_code_point_that_nfc_touches_visits_python():
    ranges = [(0x370, 0x38F), (0x900, 0x11FF), (0x1F00, 0x2001), (0x2126, 0x232A), (0x2ADC, 0x2ADC), (0xF900, 0xFB4F), (0x1D100, 0x1D1FF), (0x2F800, 0x2FA1F)]
    assert all(f"{a:x}" in norm.COMPOSABLE for a, _ in ranges)
    for p in range(0x110000):
        c = chr(p)
        if not 0xD800 <= p < 0xE000 and (unicodedata.combining(c) or not unicodedata.is_normalized("NFC", c)):
            assert unicodedata.category(c)[0] == "M" or any(a <= p <= b for a, b in ranges), hex(p)


def test_ratio(spark):
    pairs = [("", "", 0.0), ("قل", "قمل", 1 - 1 / 3), ("abc", "", 0.0), ("same", "same", 1.0)]
    df = spark.createDataFrame(pairs, "a string, b string, want double").select(similarity.ratio(F.col("a"), F.col("b")).alias("r"), "want", "a", "b")
    for r in df.collect():
        assert r.r == pytest.approx(r.want) == pytest.approx(spec.ratio(r.a, r.b))
    assert spark.createDataFrame([(None, "x")], "a string, b string").select(similarity.ratio(F.col("a"), F.col("b"))).first()[0] is None


# -- text functions


def test_scalar_functions(spark):
    assert one(spark, text.slug, "Āl-'Imrān 3") == "alimran"
    assert one(spark, text.spelling_variants, "Al-Baqarah") == sorted(extract.spellings("Al-Baqarah")) == ["albaqara", "albaqarah", "baqara", "baqarah"]
    assert one(spark, lambda c: text.annotate(c, ["Adam", "Nuh"], "(x)"), "Adam, Adam's and Nuh (x)") == "Adam (x), Adam's and Nuh (x)"
    assert one(spark, text.redact_arabic, "a قل هو b") == "a <arabic script redacted> <arabic script redacted> b"
    assert one(spark, text.word_count, " a b  c ") == 3 and one(spark, text.word_count, "  ") == 0
    assert one(spark, text.fold_diacritics, "ijmāʿ") == "ijma"
    assert one(spark, text.clean_markup, "a PageV01P002 ms0012 \\ 1 \\ @QB@ b @QE@") == "a b"
    assert one(spark, text.search_tokens, "AND, قل* x هو") == ["AND", "قل", "هو"]
    assert one(spark, text.query_text, "Mercy رَحمة") == "رحمه mercy" and one(spark, text.query_text, "  ") == ""
    assert one(spark, lambda c: text.full_text(c, F.lit(None).cast("string")), "a") == "a"
    for n, want in ((0, ""), (1, "a"), (2, "a and b"), (3, "a, b, and c")):
        assert spark.range(1).select(text.join_with_and(F.array(*[F.lit(x) for x in "abc"[:n]]).cast("array<string>"))).first()[0] == want


@pytest.mark.parametrize(("digits", "want"), [("0042", 42), ("٠٠٤٢", 42), ("0", None), ("12345", None), ("9" * 4000, None), ("x", None), ("", None)])
def test_citation_number(spark, digits, want):
    assert one(spark, lambda c: text.citation_number(c, F.lit(7124)), digits) == want


# -- extraction


NAMES = {"Bukhari": "b", "al-Bukhari": "b", "Sahih al-Bukhari": "b", "Muslim": "m", "Sahih Muslim": "m", "Ibn Majah": "i", "Sunan Ibn Majah": "i"}
LARGEST = {"b": 7124, "m": 3033, "i": 4341}
GRAMMAR = extract.Grammar(NAMES, LARGEST, {1: 7, 2: 286, 112: 4}, {"Al-Fatihah": 1, "Al-Baqarah": 2, "Sad": 38, "Yusuf": 12}, {"البخاري": "b", "مسلم": "m", "سنن ابن ماجه": "i"})


@pytest.mark.parametrize(
    ("t", "want"),
    [
        ("see 2:255 there", [("verse", 2, 255, None)]), ("2：255", [("verse", 2, 255, None)]), ("٢:٢٥٥", [("verse", 2, 255, None)]), ("2:999 and 300:1", []),
        ("Sahih al-Bukhari 619", [("collection", None, None, "619")]), ("Bukhari, no. 0619", [("collection", None, None, "619")]), ("Muslim 2:255", []), ("Bukhari Book 52, Hadith 268", []),
        ("Bukhari 12345", []), ("Ibn Majah 4342", []), ("صحيح البخاري ٦١٩", [("collection", None, None, "619")]), ("a muslim man", []), ("Al-Baqarah", [("verse", 2, None, None)]), ("Fatiha", []), ("surah Fatiha", [("verse", 1, None, None)]),
        ("albukhari #7", [("collection", None, None, "7")]), ("AL BUKHARI hadeeth 7", [("collection", None, None, "7")]), ("Bukhari 7:1", []), ("Bukhari7", []), ("xBukhari 7", []), ("Ibn  Majah , number 4341", [("collection", None, None, "4341")]), ("Kitab 3, Bukhari 9", [("collection", None, None, "9")]),
        ("رواه مسلم رقم 12", [("collection", None, None, "12")]), ("سنن ابن ماجه 9", [("collection", None, None, "9")]), ("x2:255", []), ("2:255x", []), ("1234:5", []), ("2:2555", []), ("1:2:3", [("verse", 1, 2, None)]), ("2 : 255", [("verse", 2, 255, None)]),
        ("Yusuf said", []), ("sura Yusuf", [("verse", 12, None, None)]), ("in the Quran Yusuf", [("verse", 12, None, None)]), ("measura Yusuf", []), ("al Baqarah", [("verse", 2, None, None)]), ("at Yusuf", []), ("surah Sad", []),
        ("Sad news", []), ("Al-Baqarah 2:255", [("verse", 2, 255, None)]), ("", []),
    ],
)
def test_citations(t, want):
    assert [(c.family, c.surah, c.ayah, c.number) for c in GRAMMAR.citations(t) if c.resolved] == want


def test_spans_offsets_floors_and_overlap():
    t = "He said «قل هو الله أحد» and قال رسول الله then «x» “ab”"
    got = extract.spans(t)
    assert [(s.kind, s.text) for s in got] == [("wrapped", "قل هو الله أحد"), ("arabic-run", "قال رسول الله")]
    assert all(t[s.start : s.end] == s.text for s in got)
    assert [s.text for s in extract.spans("«قل “هو” \"أحد\" «» «قل")] == ["قل “هو", "أحد"] and extract.spans("«» \"»قل\"") == []
    assert extract.spans("«قل»")[0].kind == "wrapped" and extract.spans("قل هو") == [] and extract.spans("") == []


def test_nearest_citation_and_citation_only_spans(spark):
    df = spark.createDataFrame([(1, "Al-Baqarah 2:255 «قل هو الله أحد» (1:1)", "a"), (2, "صحيح البخاري ٦١٩", "b"), (3, None, "c"), (4, "", "d"), (5, "x" * 100_000 + " «قل هو»", "e")], "doc_id int, text string, quoted string")
    got = {r.doc_id: r for r in extract.quotations(df, "doc_id", "text", GRAMMAR).collect()}
    assert got.keys() == {1, 5} and (got[1].cited_surah, got[1].cited_ayah) == (1, 1) and got[5].cited_family is None
    assert [r.resolved for r in extract.citations(df, "doc_id", "text", GRAMMAR).orderBy("doc_id", "citation_no").collect()] == [True, True, True]


# -- verification


REC = "id string, kind string, surah int, ayah int, collection string, hadith_no string, text_ar string, addenda_ar string, unscorable_reason string, bismillah string"


@pytest.fixture(scope="module")
def small_corpus(spark):
    data = [
        ("quran:1:1", "ayah", 1, 1, None, None, "إن الله على كل شيء قدير وهو السميع", None, None, "بسم الله"),
        ("quran:2:5", "ayah", 2, 5, None, None, "تبارك الذي بيده الملك وهو على كل شيء", None, None, None),
        ("quran:2:6", "ayah", 2, 6, None, None, "تبارك الذي بيده الملك وهو على كل شيء", None, None, None),
        ("hadith:c:7", "hadith", None, None, "c", "7", "الملك وهو على كل", "وزاد فيه رجل من القوم كلاما طويلا", None, None),
        ("hadith:c:8", "hadith", None, None, "c", "8", "نص لا يحسب أبدا في الميزان", None, "fragment", None),
    ]
    df = corpus.derive(spark.createDataFrame(data, REC))
    return df, corpus.representations(df, corpus.variants(df))


SPANS = "span_id string, quoted string, cited_family string, cited_surah int, cited_ayah int, cited_collection string, cited_number string"


def at_once(spark, held, cases):
    """The verdict and the other ties of each (quoted, cited), all in one run."""
    found, ties = verify.verify_with_ties(spark.createDataFrame([(str(n), q, *c) for n, (q, c) in enumerate(cases)], SPANS), *held)
    others: dict[str, list] = {}
    for r in ties.orderBy("record_id").collect():
        others.setdefault(r.span_id, []).append(r.record_id)
    return {cases[int(r.span_id)]: (r, others.get(r.span_id, [])) for r in found.collect()}


VERDICTS = [
    ("إن الله على كل شيء قدير وهو السميع", (None,) * 5, "EXACT", "quran:1:1"),
    ("إنَّ اللهَ على كل شيء قدير وهو السميع", (None,) * 5, "EXACT_ORTHOGRAPHY", "quran:1:1"),
    ("بسم الله إن الله على كل شيء قدير وهو السميع", (None,) * 5, "EXACT", "quran:1:1"),
    ("إن الله على كل شيي قدير وهو السميع", (None,) * 5, "NEAR_MATCH", "quran:1:1"),
    ("كلام آخر ليس في الكتاب", (None,) * 5, "NOT_FOUND", None),
    ("تبارك الذي بيده الملك وهو على كل شيء", ("verse", 2, 6, None, None), "EXACT", "quran:2:6"),
    ("تبارك الذي بيده الملك وهو على كل شيء", ("verse", 1, 1, None, None), "WRONG_REFERENCE", "quran:2:5"),
    ("تبارك الذي بيده الملك وهو على كل شيء", ("collection", None, None, "c", "7"), "WRONG_REFERENCE", "quran:2:5"),
    ("الملك وهو على كل", ("verse", 2, 6, None, None), "NOT_FOUND", None),
    ("الملك وهو على كل", ("collection", None, None, "c", "7"), "EXACT", "hadith:c:7"),
    ("الملك وهو على كل وزاد فيه رجل من القوم كلاما طويلا", (None,) * 5, "EXACT", "hadith:c:7"),
    ("نص لا يحسب أبدا في الميزان", (None,) * 5, "NOT_FOUND", None),
]


@pytest.fixture(scope="module")
def verdicts(spark, small_corpus):
    return at_once(spark, small_corpus, [(q, c) for q, c, _, _ in VERDICTS])


@pytest.mark.parametrize(("quoted", "cited", "verdict", "record"), VERDICTS)
def test_verdicts(verdicts, quoted, cited, verdict, record):
    r = verdicts[quoted, cited][0]
    assert (r.verdict, r.record_id) == (verdict, record)
    if quoted == "الملك وهو على كل":
        assert r.contained_in == 2


def test_other_ties_come_as_rows(spark, small_corpus):
    spans = spark.createDataFrame([("s", "تبارك الذي بيده الملك وهو على كل شيء")], "span_id string, quoted string")
    spans = norm.tiers(spans.withColumns({c: F.lit(None).cast(t) for c, t in zip(verify.CITED, ("string", "int", "int", "string", "string"))}), "quoted")
    found = verify.exact_cascade(spans, small_corpus[1])
    assert found.first().ties == 2 and rows(verify.also_at(found, {"light": verify.held_at(small_corpus[1], "light")})) == [("s", "quran:2:6")]


@pytest.fixture(scope="module")
def opened_corpus(spark):
    """Chapters that open with a prefix, and a verse that reads like an opener; a third verse longer than an opener."""
    prefix = "بِسْمِ ٱللَّهِ"
    data = [
        ("quran:3:1", "ayah", 3, 1, None, None, "تنزيل الكتاب من العزيز الحكيم", None, None, prefix),
        ("quran:4:2", "ayah", 4, 2, None, None, "تنزيل الكتاب من العزيز الحكيم", None, None, None),
        ("quran:5:1", "ayah", 5, 1, None, None, "وما كان لنفس أن تؤمن إلا بإذن ربه", None, None, prefix),
        ("quran:5:3", "ayah", 5, 3, None, None, "وما كان لنفس أن تؤمن إلا بإذن ربها", None, None, None),
        ("quran:6:1", "ayah", 6, 1, None, None, "والسماء ذات البروج واليوم الموعود وشاهد ومشهود", None, None, prefix),
    ]
    df = corpus.derive(spark.createDataFrame(data, REC))
    return df, corpus.representations(df, corpus.variants(df))


OPENED = [
    # an opener among the ties is taken, and the others are told
    ("بسم الله تنزيل الكتاب من العزيز الحكيم", (None,) * 5, "EXACT", "quran:3:1", ["quran:4:2"]),
    ("بسم الله تنزيل الكتاب من العزيز الحكيم", ("verse", 4, 2, None, None), "WRONG_REFERENCE", "quran:3:1", ["quran:4:2"]),
    # the whole corpus is matched first: a better record that is no opener stops the retry
    ("بسم الله وما كان لنفس أن تؤمن إلا بإذن ربها", (None,) * 5, "NOT_FOUND", None, []),
    ("بسمِ  اللـه وما كان لنفس أن تؤمن إلا بإذن ربه", (None,) * 5, "EXACT", "quran:5:1", []),
    ("بسم الله والسماء ذات البروج واليوم الموعود وشاهد ومشهد", (None,) * 5, "NEAR_MATCH", "quran:6:1", []),
    ("بسم الله", (None,) * 5, "NOT_FOUND", None, []),
]


@pytest.fixture(scope="module")
def opened(spark, opened_corpus):
    return at_once(spark, opened_corpus, [(q, c) for q, c, *_ in OPENED])


@pytest.mark.parametrize(("quoted", "cited", "verdict", "record", "others"), OPENED)
def test_a_prefix_is_taken_off_for_openers_only(opened, quoted, cited, verdict, record, others):
    r, ties = opened[quoted, cited]
    assert (r.verdict, r.record_id) == (verdict, record) and ties == others
    if verdict == "NEAR_MATCH":
        assert "".join(d.text for d in r.diff if d.op != "quoted-only") == "والسماء ذات البروج واليوم الموعود وشاهد ومشهود"


def test_near_ties_misses_and_the_least_similarity(spark):
    at = lambda n: "ب" * (50 - n) + "ت" * n
    words = "كلمة " * 3
    data = [(f"quran:9:{i}", "ayah", 9, i, None, None, t, None, None, None) for i, t in enumerate([words + at(0), words + at(0), "حرف " + at(0)], 1)]
    df = corpus.derive(spark.createDataFrame(data, REC))
    reps = corpus.representations(df, corpus.variants(df))
    schema = "span_id string, quoted string, cited_family string, cited_surah int, cited_ayah int, cited_collection string, cited_number string"
    asked = spark.createDataFrame([("near", words + at(1), *(None,) * 5), ("edge", "حرف " + at(7), *(None,) * 5), ("miss", "حرف " + at(8), *(None,) * 5), ("far", "غير", *(None,) * 5)], schema)
    found, ties = verify.verify_with_ties(asked, df, reps, score_misses=True)
    got = {r.span_id: (r.verdict, r.record_id, r.score, r.ties) for r in found.collect()}
    assert got["near"] == ("NEAR_MATCH", "quran:9:1", round(1 - 1 / 65, 4), 2) and rows(ties) == [("near", "quran:9:2")]
    assert got["edge"][:2] == ("NEAR_MATCH", "quran:9:3") and got["miss"] == ("NOT_FOUND", None, round(1 - 8 / 54, 4), 0) and got["far"] == ("NOT_FOUND", None, 0.0, 0)
    plain = {r.span_id: (r.verdict, r.record_id, r.score, r.ties) for r in verify.verify(asked, df, reps).collect()}
    assert {k: v for k, v in plain.items() if v[0] == "NEAR_MATCH"} == {k: v for k, v in got.items() if v[0] == "NEAR_MATCH"} and plain["miss"][2] is None


def test_aggressive_never_verifies(spark, small_corpus):
    r = verify.verify(spark.createDataFrame([("s", "ان الله علي كل شيء قدير وهو السميع", *(None,) * 5)], SPANS), *small_corpus).first()
    assert r.verdict == "NEAR_MATCH" and r.tier == "aggressive" and r.score == 1.0


def test_containment_is_a_raw_substring_test(spark):
    n = spark.createDataFrame([("a", "bc"), ("b", "bcdefgh"), ("c", "x"), ("d", "zz"), ("e", None)], "needle_id string, needle string")
    t = spark.createDataFrame([("1", "abcdefghi"), ("2", "bc"), ("3", None), ("4", "")], "text_id string, text string")
    assert rows(verify.containing(n, t)) == [("a", "1"), ("a", "2"), ("b", "1")]


def test_containment_for_some_needles_of_all_lengths(spark, monkeypatch):
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdef") for _ in range(rng.randint(1, 6))) for _ in range(40)]
    t = [(str(k), " ".join(rng.choices(words, k=rng.randint(1, 30)))) for k in range(60)] + [("same", "ab cd ef"), ("again", "ab cd ef")]
    n = [(f"n{k}", v[a : a + rng.choice([1, 2, 3, 5, 6, 7, 15, 16, 17, 40])]) for k, (_, v) in enumerate(t * 3) for a in [rng.randrange(len(v))]]
    n += [("miss", "ab cd eg zz"), ("twice", "cd ef"), ("twice", "ab cd ef")]
    want = sorted({(a, b) for a, needle in n for b, text in t if len(needle) >= 2 and needle in text})
    needles, held = spark.createDataFrame(n, "needle_id string, needle string"), spark.createDataFrame(t, "text_id string, text string")
    assert rows(verify.containing(needles, held)) == want and len(want) > 200
    monkeypatch.setattr(verify, "FEW", 0)
    some = spark.createDataFrame([(f"n{k}",) for k in range(0, 180, 2)] + [("twice",), ("nowhere",)], "needle_id string")
    ids = {r[0] for r in some.collect()}
    assert rows(verify.containing(needles, held, some)) == [p for p in want if p[0] in ids]
    assert rows(verify.containing(needles.limit(0), held)) == []


def test_containment_writes_digests_and_not_texts(spark, monkeypatch):
    """Needles' and texts' runs, of which there are as many as signs, are shuffled and stored without the texts themselves."""
    stored = []
    monkeypatch.setattr(verify, "written", lambda df, label: stored.append(df) or df)
    text = "".join(chr(0x620 + k % 40) for k in range(400))
    needles = spark.createDataFrame([("a", text[3:])], "needle_id string, needle string")
    assert rows(verify.containing(needles, spark.createDataFrame([("t", text)], "text_id string, text string"))) == [("a", "t")]
    assert stored and not any(c in ("needle", "text") for df in stored for c in df.columns)
    assert all(df.count() <= 400 for df in stored)


def test_differences():
    assert verify.differences("قل هو", "قل هي") == [("equal", "قل ه"), ("quoted-only", "و"), ("corpus-only", "ي")]


# -- search


def test_bm25_formula_ties_and_repeats(spark):
    import math

    docs = spark.createDataFrame([("a", "x y"), ("b", "x x"), ("c", "z"), ("d", None), ("e", "x y")], "doc_id string, t string")
    q = spark.createDataFrame([(1, ["x", "y"]), (2, ["y", "y"]), (3, [])], "query_id int, tokens array<string>")
    got = search.bm25(search.postings(docs, ["t"]), search.lengths_of(docs, ["t"]), q, 10).collect()
    score = {(r.query_id, r.doc_id): r.score for r in got}
    avg = 7 / 5
    part = lambda df, tf, n: max(math.log((5 - df + 0.5) / (df + 0.5)), 0) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n / avg)) if math.log((5 - df + 0.5) / (df + 0.5)) > 0 else 1e-6 * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n / avg))
    assert score[1, "a"] == math.floor((part(3, 1, 2) + part(2, 1, 2)) * 1e6 + 0.5) and score[2, "a"] == math.floor(2 * part(2, 1, 2) * 1e6 + 0.5)
    assert [r.doc_id for r in sorted(got, key=lambda r: r["rank"]) if r.query_id == 2] == ["a", "e"]


def test_fusion_counts_ranks_from_zero(spark):
    lists = [spark.createDataFrame([(1, "a", 1), (1, "b", 2)], "query_id int, record_id string, rank int"), spark.createDataFrame([(1, "b", 1)], "query_id int, record_id string, rank int")]
    assert [(r.record_id, r.score) for r in search.fuse(lists, 5).orderBy("rank").collect()] == [("b", int(1e9 / 61) + int(1e9 / 60)), ("a", int(1e9 / 60))]


def test_hamming_topk(spark):
    v = spark.createDataFrame([("a", bytes([0, 1])), ("b", bytes([0, 3])), ("c", bytes([255])), ("d", None), ("a2", bytes([0, 1]))], "record_id string, vec binary")
    q = spark.createDataFrame([("q", bytes([0, 0])), ("n", None)], "query_id string, vec binary")
    assert [(r.record_id, r.distance) for r in search.hamming_topk(q, v, 2).orderBy("rank").collect()] == [("a", 1), ("a2", 1)]
    assert search.hamming_topk(q.limit(0), v, 2).collect() == []


# -- corpus


def test_upsert_keeps_the_later_row(spark):
    old = spark.createDataFrame([("a", 1, "x"), ("b", 9, "y")], "id string, n int, v string")
    new = spark.createDataFrame([("a", 0, "z"), ("c", 1, None), ("c", 2, "w")], "id string, n int, v string")
    assert rows(corpus.upsert(old, new, ["id"], ["n"])) == [("a", 0, "z"), ("b", 9, "y"), ("c", 2, "w")]


def test_fingerprint_tells_null_from_empty_and_ignores_order(spark):
    f = lambda data: corpus.fingerprint(spark.createDataFrame(data, "id string, v string"), "t", ["v"], ["id"]).first().fingerprint
    assert f([("a", None), ("b", "x")]) == f([("b", "x"), ("a", None)]) != f([("a", ""), ("b", "x")])
    assert corpus.fingerprint(spark.createDataFrame([], "id string, v string"), "t", ["v"], ["id"]).first().n_rows == 0


def test_curation_is_pinned_to_the_text(spark):
    import hashlib

    r = spark.createDataFrame([("a", "x", None), ("b", "y", None)], "id string, text_ar string, unscorable_reason string")
    pins = spark.createDataFrame([("a", hashlib.sha256(b"x").hexdigest(), "short"), ("b", "old", "short"), ("c", "old", "short")], "record_id string, text_sha256 string, reason string")
    done, bad = corpus.curate(r, pins)
    assert rows(bad) == [("b", "changed"), ("c", "missing")] and rows(done)[0] == ("a", "x", "short")
    with pytest.raises(corpus.GateError):
        corpus.require_empty(bad, "curation")


def test_prefix_collisions_and_containment(spark):
    n = spark.createDataFrame([("a", "w1 w2 w3 w4 w5"), ("b", "w1 w2 w3 w4"), ("c", "w1 w2 w3"), ("d", None)], "id string, text string")
    assert rows(corpus.prefix_collisions(n)) == [("a", 1, "b"), ("b", 1, "c")]
    base = spark.createDataFrame([(1, 1, "w1 w2"), (1, 2, "w3 w4"), (2, 1, "z"), (2, 2, None)], "g int, o int, text string")
    t = spark.createDataFrame([("a", "w2 w3"), ("b", "w2 w3 w4"), ("c", "2 w3"), ("d", "z"), ("e", ""), ("f", None), ("g", "w1 w2 w3 w4 z")], "id string, text string")
    assert rows(corpus.whole_in_group(t, base, "g", "o")) == [("a", 1), ("b", 1), ("d", 2)]


def test_population_of_pointers(spark):
    n = spark.createDataFrame([("a", "قال زيد"), ("b", " ".join(["كلمة"] * 9)), ("c", " ".join(["كلمة"] * 9 + ["بهذا"])), ("d", None), ("a", "قال زيد")], "id string, text string")
    assert rows(corpus.pointer_population(n, ["بهذا"], ["قال"], [])) == [("a", 1), ("c", 10)]
    assert rows(corpus.pure_pointers(n, ["بهذا", "زيد"], ["قال"], [], 9, but_not="كلمة")) == [("a", 0)]


def test_content_mass(spark):
    assert one(spark, lambda c: corpus.content_mass(c, ["قال"], ["عن"]), "قال عن زيد كلام طويل") == 2


# -- orphans


def test_orphans_states_and_hot_key(spark):
    import datetime as dt

    day = lambda n: dt.datetime(2025, 1, 1) + dt.timedelta(days=n)
    refs = spark.createDataFrame(
        [(i, "gone", day(3)) for i in range(40)] + [(100, "ok", day(5)), (101, "ok", day(1)), (102, "nowhere", day(1)), (103, None, day(1)), (104, "back", day(9)), (105, "listed", day(1)), (106, "", day(1)), (106, "", day(1)), (107, "ok", None)], "row_no long, record_id string, loaded_at timestamp_ntz"
    )
    parents = spark.createDataFrame([("records", "ok", day(2)), ("records", "ok", day(8)), ("records", "gone", day(0)), ("records", "back", day(0)), ("records", "back", day(7)), ("sources", "nowhere", day(0)), ("records", None, day(0))], "target string, key_value string, loaded_at timestamp_ntz")
    gone = spark.createDataFrame([("records", "gone", day(1), "r"), ("records", "gone", day(0), None), ("records", "back", day(6), None), ("records", "listed", day(1), None)], "tab string, key_value string, removed_at timestamp_ntz, target string")
    named = orphans.references({"t": (refs, "record_id", "records")})
    got = rows(orphans.orphans(named, parents, gone).select("row_no", "orphan_state"))
    assert got == sorted([(i, "removed") for i in range(40)] + [(101, "late"), (102, "missing"), (105, "removed"), (106, "missing"), (106, "missing")], key=repr)
    assert orphans.orphans(named.limit(0), parents, gone).collect() == []
    assert {r.orphan_state for r in orphans.orphans(named, parents.limit(0), gone.limit(0)).collect()} == {"missing"}


def test_small_filters_change_nothing(spark, monkeypatch):
    refs = spark.createDataFrame([(i, f"k{i}") for i in range(200)], "row_no long, record_id string").withColumn("loaded_at", F.lit(None).cast("timestamp_ntz"))
    parents = spark.createDataFrame([("records", f"k{i}") for i in range(0, 200, 2)], "target string, key_value string").withColumn("loaded_at", F.lit(None).cast("timestamp_ntz"))
    none = spark.createDataFrame([], "tab string, key_value string, removed_at timestamp_ntz")
    named = orphans.references({"t": (refs, "record_id", "records")})
    want = rows(orphans.orphans(named, parents, none).select("row_no"))
    for bits in (64, 256):  # filters in parts
        monkeypatch.setattr(bloom, "MAX_BITS", bits)
        monkeypatch.setattr(orphans, "PROBED", 7)
        assert rows(orphans.orphans(named, parents, none).select("row_no")) == want and len(want) == 100


# -- rules, gates, the answer pipeline


def answer(summary, items, candidates=("a",), history=()):
    return (1, summary, items, list(candidates), list(history))


ANSWER = "answer_id int, summary string, items array<struct<record_id:string,framing:string,translation:string>>, candidate_ids array<string>, history_ids array<string>"


@pytest.mark.parametrize(
    ("row", "failed"),
    [
        (answer("fine", [("a", "ok", None)]), set()), (answer("fine", [("b", "ok", None)]), {"cited_id_in_candidates"}), (answer("fine", [("b", "ok", None)], history=("b",)), set()),
        (answer("قل", []), {"no_arabic_in_prose"}), (answer("fine", [("a", "x " * 26, None)]), {"length"}), (answer("x " * 81, []), {"length"}), (answer("fine", [("a", "ok", "of the ijmāʿ")]), {"unanimity"}), (answer(None, None), set()),
    ],
)
def test_guards(spark, row, failed):
    got = rules.guards(spark.createDataFrame([row], ANSWER), {"unanimity": "\\bijma\\b"}).collect()
    if row[2] is None:
        return
    assert {r.guard for r in got if not r.passed} == failed and not any(re.search("[؀-ۿ]", r.detail) for r in got)


def test_titles_are_exempt_and_histories_are_bounded(spark):
    df = spark.createDataFrame([answer("the Sahih-Zarfan says", []), answer("a sahih report", [])], ANSWER)
    got = [r.passed for r in rules.guards(df, {"grading": "\\bsahih\\b"}, {"grading": "\\bsahih zarfan\\b"}).where("guard = 'grading'").collect()]
    assert sorted(got) == [False, True]
    turns = "question string, history array<struct<question:string,summary:string,item_ids:array<string>>>"
    h = spark.createDataFrame([("q", [("a", "x", [])] * 11), ("q", [("a", "x" * 1001, [])]), ("q", [("a", None, [])] * 10), (" ", None)], turns)
    assert [r[0] for r in h.select(rules.request_problem("ask", F.col("question"), F.col("history"))).collect()] == ["too many turns", "too long a summary", None, "blank"]


def test_context_and_numbers_of_long_threads(spark):
    data = [("a", n, f"t{n}") for n in range(47)] + [("b", 5, "x"), ("b", 2, None), (None, 1, "u"), (None, 3, "v")]
    df = spark.createDataFrame(data, "thread string, n int, said string").repartition(6)
    got = {(r.thread, r.n): r.context for r in rules.running_text(df, "thread", "n", "said", 4).collect()}
    want = {(t, n): " ".join(s for u, m, s in sorted((x for x in data if x[0] == t), key=lambda x: x[1]) if m <= n and s is not None and sum(1 for x in data if x[0] == t and m <= x[1] <= n) <= 4) for t, n, _ in data}
    assert got == want
    assert rows(corpus.occurrences(df, "thread", "n").where("thread = 'a'").select("n", "occurrence")) == sorted(((n, n + 1) for n in range(47)), key=repr)


def test_decisions(spark):
    df = spark.createDataFrame([(True, None, False, 0), (False, None, False, 0), (False, None, False, 1), (True, True, False, 1), (True, False, True, 0)], "p boolean, o boolean, d boolean, a int")
    got = [r[0] for r in df.select(rules.adjudicate(F.col("p"), F.col("o"), F.col("d"), F.col("a"))).collect()]
    assert got == ["PUBLISH", "RETRY", "ABSTAIN", "ABSTAIN", "RELABEL_INTERPRETATION"]


def test_answer_stages_with_stub_providers(spark):
    calls = []
    ok = ask.Providers(lambda q: ["term"], lambda q, ids: (calls.append(1), ("summary", [(ids[0] if len(calls) > 1 else "stray", "framing", None)]))[1], lambda s, i: False)
    stages = list(ask.events(spark, "r", "question", [], ok, lambda terms: ["a"], [], [], {}))
    assert [s for s, _ in stages if s == "decide"] == ["decide", "decide"] and stages[-1] == ("final", {"decision": "PUBLISH"})
    broken = ask.Providers(lambda q: 1 / 0, lambda q, ids: ("", []))
    assert list(ask.events(spark, "r", "secret", [], broken, lambda t: [], [], [], {}))[-1][0] == "error"
    out = ask.server_sent(ask.event_rows(spark, "r", iter(stages))).orderBy("stage_no").first().line
    assert out == 'data: {"stage":"route","payload":{"route":"GENERAL"}}\n\n'


def test_gate_counts_excess_both_ways(spark):
    cases = spark.createDataFrame([(1, "EXACT", "a", None), (2, "NOT_FOUND", None, None), (3, None, None, True), (4, "WRONG_REFERENCE", None, None)], "case_id int, expect_verdict string, expect_record string, expect_no_quotation boolean")
    found = spark.createDataFrame([(1, 0, "EXACT", "a"), (1, 1, "EXACT", "b"), (2, 0, "WRONG_REFERENCE", "c"), (4, 0, "WRONG_REFERENCE", "d")], "case_id int, span_no int, verdict string, record_id string")
    got = {r.case_id: r for r in evaluate.judge(cases, found).collect()}
    assert (got[1].excess_verified, got[2].excess_misattributed) == (1, 1) and not got[1].passed and got[3].passed and got[4].passed
    more = spark.createDataFrame([(1, "EXACT", None, None, 2, "WRONG_REFERENCE", "a", "absolute", True), (2, None, None, False, None, "NOT_FOUND", None, "citation", False), (3, None, None, None, 1, None, None, None, None)], "case_id int, expect_verdict string, expect_record string, expect_no_quotation boolean, expect_verified_spans int, forbid_verdict string, expect_no_other_record string, expect_claim string, expect_handoff boolean")
    spans = spark.createDataFrame([(1, 0, "EXACT", "a"), (1, 1, "EXACT", "b"), (2, 0, "NOT_FOUND", None)], "case_id int, span_no int, verdict string, record_id string")
    said = spark.createDataFrame([(1, "absolute"), (2, "absolute")], "case_id int, kind string")
    went = spark.createDataFrame([(1, "FIRST", True), (2, "GENERAL", False), (3, "GENERAL", False)], "case_id int, route string, handed_on boolean")
    got = {r.case_id: r.problems for r in evaluate.judge(more, spans, said, went).collect()}
    assert got == {1: ["another record"], 2: ["forbidden verdict", "claim"], 3: []}
    assert rows(evaluate.bad_cases(cases.union(cases.limit(1)).union(spark.createDataFrame([(9, "EXCAT", None, None)], cases.schema)))) == [(1, "repeated id"), (9, "unknown verdict")]


# -- sources


def test_manifest_rules(spark, tmp_path):
    good = 'lockfile_version = 1\n[[source]]\nid = "s"\nkind = "k"\nformat = "xml"\ntitle = "t"\nurl = "u"\nlicense_id = "l"\ncontent_sha256 = "' + "a" * 64 + '"\nmodifications = "none"\nexpected_lines = 4\n'
    p = tmp_path / "m.toml"
    p.write_text(good)
    m = manifest.load(spark, str(p))
    assert m.first().expected_lines == 4 and manifest.cache_names(m).first().file == manifest.cache_name("s", "xml", "u")
    measured = spark.createDataFrame([("s", 3, "a" * 64)], "id string, units int, sha256 string")
    assert rows(manifest.gate(m, measured)) == [("s", "another count")] and rows(manifest.gate(m, measured.limit(0))) == [("s", "not read")]
    for old, new in (("lockfile_version = 1", "lockfile_version = 2"), ('"xml"', '"csv"'), ("a" * 64, "a" * 63), ("expected_lines = 4", ""), ('title = "t"', "")):
        with pytest.raises(manifest.ManifestError):
            manifest.entries(good.replace(old, new))


def test_verse_readers(spark, tmp_path):
    (tmp_path / "a.txt").write_text("# notice\n1|1|one|two\r\n\n1|2| x \n", encoding="utf-8")
    got = scripture.pipe(spark, str(tmp_path / "a.txt"))
    assert rows(got.select("surah", "ayah", "text")) == [(1, 1, "one|two"), (1, 2, "x")] and scripture.notices(spark, str(tmp_path / "a.txt")).first().attribution == "# notice"
    (tmp_path / "b.txt").write_text("1|1|x\nbad line\n", encoding="utf-8")
    with pytest.raises(Exception, match="line 2"):
        scripture.pipe(spark, str(tmp_path / "b.txt")).collect()
    (tmp_path / "c.xml").write_text('<quran><!-- by us --><sura index="1" name="n"><aya index="1" text="t"/><aya index="2" text="u" bismillah="b"/></sura></quran>', encoding="utf-8")
    assert rows(scripture.xml(spark, str(tmp_path / "c.xml")).select("surah", "ayah", "text", "bismillah")) == [(1, 1, "t", None), (1, 2, "u", "b")]
    assert scripture.xml_attribution(spark, str(tmp_path / "c.xml")).first().attribution == " by us "
    assert scripture.measured(got).first().units == 2 and scripture.as_records(got, "s").first().id == "quran:1:1"


BOOK = """#META# x
#META#Header#End#
### | 1 كتاب العلم
### || باب الأول (وفيه
~~بقية)
# 12 حدثنا زيد عن عمرو * قال الرجل كلاما
~~طويلا PageV01P002 ms0007
# وزاد هنا
# 12 م حدثنا علي * نص ثان وقال بعد ذلك شيئا آخر
#
### ||| 13
# حدثنا بكر * نص ثالث x1
# 14 باب ليس وحدة
# 15 بلا نجمة
"""


def test_markdown_units(spark, tmp_path):
    p = tmp_path / "book.txt"
    p.write_text(BOOK, encoding="utf-8")
    read = markdown.read(spark, str(p), markdown.Book("c", (markdown.Cut("وقال"),)))
    got = {r.record_id: r for r in read.collect()}
    assert sorted(got) == ["hadith:c:12", "hadith:c:12-2", "hadith:c:13", "hadith:c:15"]
    a, b = got["hadith:c:12"], got["hadith:c:12-2"]
    assert (a.matn_ar, a.isnad_ar, a.book_no, a.book_ar, a.chapter_ar) == ("قال الرجل كلاما طويلا وزاد هنا", "حدثنا زيد عن عمرو", 1, "كتاب العلم", "باب الأول (وفيه بقية")
    assert (b.is_repeat, b.matn_ar, b.addenda_ar) == (True, "نص ثان", "وقال بعد ذلك شيئا آخر") and got["hadith:c:13"].stray_signs == "1x" and got["hadith:c:15"].isnad_ar is None
    shown = [r.reference_display for r in markdown.as_records(read, "s", "c", "Book", "printed").collect()]
    assert len(set(shown)) == 4
    with pytest.raises(markdown.FormatError):
        markdown.units("no header", markdown.Book("c"))


def test_rules_of_a_book_are_data():
    chain = markdown.Chain(frozenset({"بن", "عن", "حدثنا"}), frozenset({"يا", "في"}), "(?:و)?قال", first_no_link="عن")
    cut = (markdown.Cut("حدثنا", chain=chain),)
    at = lambda t, b=None: markdown.split(t, b or markdown.Book("c", cut), "r")[:2]
    assert at("نص طويل هنا حدثنا زيد بن عمرو كلام") == ("نص طويل هنا", "حدثنا زيد بن عمرو كلام")  # a chain of names
    assert at("نص طويل هنا قال زيد حدثنا كلام في") == ("نص طويل هنا", "قال زيد حدثنا كلام في")  # taken with its attribution
    assert at("نص طويل هنا حدثنا عن ذلك")[1] is None and at("نص طويل هنا حدثنا يا زيد")[1] is None
    steps = markdown.Book("c", (markdown.Cut("قال"),), further=((markdown.Cut("وفي الباب"),),), strips=(markdown.Strip(r"\[\d+\]"),), removed=((r"<\d+>", ""),))
    assert at("نص أول [12] وفي الباب عن زيد قال بكر", steps) == ("نص أول", "وفي الباب عن زيد قال بكر") and at("[12]", steps)[0] == "[12]"
    assert re.fullmatch(markdown.case_forms("أبو داود"), "أبي داود") and markdown.case_forms("مسلم") == "مسلم"
    assert [u[7] for u in markdown.units("#META#Header#End#\n# 1 ح <3>* نص\n", steps)] == ["نص"]


def test_pins_hold_for_one_text_only():
    import hashlib

    text_ = "نص ثان وقال بعد"
    pin = lambda action, arg="": markdown.Book("c", (markdown.Cut("وقال"),), {"r": markdown.Pin(hashlib.sha256(text_.encode()).hexdigest(), action, arg)})
    assert markdown.split(text_, pin("never_cut"), "r") == (text_, None, None) and markdown.split(text_, pin("cut_at", "2"), "r") == ("نص", "ثان وقال بعد", None)
    assert markdown.split(text_, pin("unscorable", "fragment"), "r")[2] == "fragment" and markdown.split(text_, markdown.Book("c", (markdown.Cut("وقال", head=3),)), "r")[1] is None
    with pytest.raises(markdown.StalePin):
        markdown.split(text_ + "x", pin("never_cut"), "r")


# -- audit


def test_audit_holds_no_text_and_streams_once(spark, tmp_path, data):
    m = spark.createDataFrame([("q", 1, "NOT_FOUND", None, "secret words"), ("q", 0, "EXACT", "a", "secret words")], "request string, span_no int, verdict string, record_id string, quoted string")
    r = audit.audit_rows(m, "request", "verify", F.lit("2025-01-01T00:00:00")).first()
    assert r.verdict == "EXACT" and "secret" not in str(r.asDict())
    for _ in range(2):
        audit.stream(spark, data, "events.parquet", str(tmp_path / "rows"), str(tmp_path / "state")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "rows")).count() == spark.read.parquet(f"{data}/events.parquet").count()
