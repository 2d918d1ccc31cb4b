"""From files to a corpus, and what callers ask of it."""

import hashlib
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from quotewright.operators import ask, corpus, embed, evaluate, extract, rules, service
from quotewright.sources import build, cases, manifest, markdown

VERSES = [(1, 1, "إن الله على كل شيء قدير"), (1, 2, "تبارك الذي بيده الملك"), (2, 1, "قل هو الله أحد")]
ENGLISH = [(1, 1, "over all things"), (1, 2, "blessed is the king"), (2, 1, "say he is one")]
BOOK = "#META#\n#META#Header#End#\n### | كتاب\n# 1 حدثنا زيد * كلام طويل لا يشبه غيره\n# 2 حدثنا زيد * كلام آخر قصير هنا\n"


def pinned(verses):
    return hashlib.sha256("\n".join(f"{s}|{a}|{t}" for s, a, t in verses).encode()).hexdigest()


@pytest.fixture(scope="module")
def files(tmp_path_factory):
    base = tmp_path_factory.mktemp("build")
    entry = lambda i, kind, fmt, sha, counted, more="": f'[[source]]\nid = "{i}"\nkind = "{kind}"\nformat = "{fmt}"\ntitle = "t"\nurl = "file:{i}"\nlicense_id = "l"\ncontent_sha256 = "{sha}"\nmodifications = "none"\n{counted}\n{more}\n'
    text = "lockfile_version = 1\n" + entry("v", "scripture", "txt-2", pinned(VERSES), "expected_lines = 3") + entry("e", "translation", "txt-2", pinned(ENGLISH), "expected_lines = 3")
    text += entry("b", "book", "openiti-markdown", hashlib.sha256(BOOK.encode()).hexdigest(), "expected_records = 2", 'collection = "c"\nnumbering_scheme = "printed"')
    (base / "manifest.toml").write_text(text, encoding="utf-8")
    for name, fmt, body in (("v", "txt-2", "\n".join(f"{s}|{a}|{t}" for s, a, t in VERSES)), ("e", "txt-2", "\n".join(f"{s}|{a}|{t}" for s, a, t in ENGLISH)), ("b", "openiti-markdown", BOOK)):
        (base / "cache").mkdir(exist_ok=True)
        (base / "cache" / manifest.cache_name(name, fmt, f"file:{name}")).write_text(body, encoding="utf-8")
    return base


@pytest.fixture(scope="module")
def built(spark, files):
    build.build(spark, str(files / "manifest.toml"), str(files / "cache"), str(files / "out"), {"c": markdown.Book("c")}, {"c": "Book"})
    sources = spark.createDataFrame([("v", "Verses", "l", "by"), ("b", "Book", "l", "by")], "id string, title string, license_id string, attribution string")
    return service.Corpus.load(spark, str(files / "out"), sources)


def test_build_and_gates(spark, files, built):
    assert sorted(r.id for r in built.records.collect()) == ["hadith:c:1", "hadith:c:2", "quran:1:1", "quran:1:2", "quran:2:1"]
    assert built.records.where("norm_standard is null").isEmpty() and built.lengths.count() == 5
    changed = (files / "manifest.toml").read_text(encoding="utf-8").replace("expected_records = 2", "expected_records = 3")
    (files / "other.toml").write_text(changed, encoding="utf-8")
    with pytest.raises(corpus.GateError, match="another count"):
        build.build(spark, str(files / "other.toml"), str(files / "cache"), str(files / "no"), {"c": markdown.Book("c")}, {"c": "Book"})
    with pytest.raises(manifest.ManifestError):
        build.fetch({"id": "x", "format": "xml", "url": "u"}, str(files / "cache"))
    with pytest.raises(manifest.ManifestError):
        build.reader("csv")
    with pytest.raises(corpus.GateError):
        build.check_translations(spark.createDataFrame([("quran:9:9",)], "record_id string"), built.records)


def test_a_record_that_is_wholly_a_quotation_stops_the_build(spark, built, files):
    bad = build.shaped(built.records.limit(0).unionByName(built.records)).withColumn("text_ar", F.when(F.col("id") == "hadith:c:1", "الذي بيده الملك").otherwise(F.col("text_ar")))
    with pytest.raises(corpus.GateError, match="wholly"):
        build.materialize(bad, built.translations, str(files / "bad"))
    with pytest.raises(corpus.GateError, match="no verses"):
        build.materialize(bad.where("kind = 'hadith'"), built.translations, str(files / "bad"))


def test_callers(spark, built):
    grammar = extract.Grammar({"al-c": "c"}, {"c": 2}, {1: 2, 2: 1})
    texts = spark.createDataFrame([(1, "«قل هو الله أحد» (2:1)"), (2, "no quotation"), (3, "«كلام آخر قصير هنا» (1:2)"), (4, " "), (5, None)], "doc_id int, text string")
    handed = texts.select("doc_id", (F.col("doc_id") == 4).alias("handoff"))
    matches, outcomes = service.verify_texts(texts, built, grammar, handed)
    assert {r.doc_id: r.verdict for r in matches.collect()} == {1: "EXACT", 3: "WRONG_REFERENCE"}
    assert {r.doc_id: r.outcome for r in outcomes.collect()} == {1: "grounded", 2: "insufficient_span", 3: "needs_review", 4: "handoff", 5: "insufficient_span"}
    q = spark.createDataFrame([(1, "King"), (2, "الملكُ"), (3, " "), (4, None)], "query_id int, q string")
    assert {(r.query_id, r.record_id) for r in service.find(q, built, 500).collect()} == {(1, "quran:1:2"), (2, "quran:1:2")}
    got = service.records_of(spark.createDataFrame([("quran:1:2",), ("nowhere",)], "id string"), built).collect()
    assert [(r.id, r.t.text, r.source_title) for r in got] == [("quran:1:2", "blessed is the king", "Verses")]
    assert service.describe(built, {"ayah": "the verses", "c": "Book"}).first().scope == "This corpus contains the verses and Book."


def test_claims_and_segments(spark, built):
    claims = spark.createDataFrame([(0, "king", ["king", "things"]), (1, "none", ["zzz"])], "claim_no int, claim string, terms array<string>")
    found = service.claim_check(claims, built)
    assert [(r.claim_no, r.record_id) for r in found.orderBy("claim_no", "rank").collect()] == [(0, "quran:1:2"), (0, "quran:1:1")]
    said = spark.createDataFrame([(0, "supported", ["quran:1:2", "stray"]), (1, "unsupported", [])], "claim_no int, verdict string, record_ids array<string>")
    assert {(r.claim_no, r.verdict, r.record_id) for r in service.assessed(claims, said, found).collect()} >= {(0, "supported", "quran:1:2"), (1, "unsupported", None)}
    texts = spark.createDataFrame([(1, "abcdef"), (2, "xy"), (3, "")], "doc_id int, text string")
    spans = spark.createDataFrame([(1, 0, 0, 2), (1, 1, 3, 5)], "doc_id int, span_no int, span_start int, span_end int")
    assert [(r.doc_id, r.text, r.span_no) for r in service.segments(texts, spans).orderBy("doc_id", "segment_no").collect()] == [(1, "ab", 0), (1, "c", None), (1, "de", 1), (1, "f", None), (2, "xy", None)]


def test_embedding_is_incremental(spark, built):
    none = spark.createDataFrame([], "record_id string, model string, dim int, dtype string, text_sha256 string, vec binary")
    first = embed.refresh(built.records, built.variants, none, embed.stub(64), "m")
    assert first.count() == 5 and first.first().dim == 64 and len(first.first().vec) == 8
    asked = []

    def provider(texts):
        asked.append(len(texts))
        return np.ones((len(texts), 64))

    changed = built.records.withColumn("text_ar", F.when(F.col("id") == "quran:2:1", "نص جديد").otherwise(F.col("text_ar")))
    again = {r.record_id: r.vec for r in embed.refresh(changed, built.variants, first, lambda t: np.ones((len(t), 64)), "m").collect()}
    assert again["quran:2:1"] == b"\xff" * 8 and sum(v == b"\xff" * 8 for v in again.values()) == 1
    assert provider(["a"]).shape == (1, 64) and embed.sign_bits(np.array([[1.0, -1, 0, 2, -3, 1, 1, 1]])) == [bytes([0b10010111])]


def test_case_files(spark, tmp_path):
    p = tmp_path / "c.json"
    p.write_text(json.dumps([{"id": "a", "text": "t", "expect_verdict": "EXACT"}, {"id": "b", "text": "u"}]))
    assert cases.cases(spark, str(p)).count() == 2
    p.write_text(json.dumps([{"id": "a", "text": "t", "expect_verdict": "EXCAT"}]))
    with pytest.raises(corpus.GateError):
        cases.cases(spark, str(p))
    a = tmp_path / "a.json"
    a.write_text(json.dumps([{"id": "x", "candidate_ids": ["r"], "selection": {"summary": "قل", "items": [{"record_id": "r", "framing": "f"}]}, "must_block": True}, {"id": "y", "candidate_ids": ["r"], "selection": {"summary": "s", "items": []}, "must_block": True}]))
    got = cases.answers(spark, str(a))
    out = evaluate.answer_gate(rules.guards(got, {}), got.select("answer_id", "must_block"))
    assert {r.answer_id: r.outcome for r in out.collect()} == {"x": "ok", "y": "not blocked"}


def test_downloads_are_cached_after_their_gate(spark, files, tmp_path):
    text = (files / "manifest.toml").read_text(encoding="utf-8")
    (tmp_path / "m.toml").write_text(text, encoding="utf-8")
    bodies = {"file:v": "\n".join(f"{s}|{a}|{t}" for s, a, t in VERSES), "file:e": "\n".join(f"{s}|{a}|{t}" for s, a, t in ENGLISH), "file:b": BOOK}
    args = [{"c": markdown.Book("c")}, {"c": "Book"}]
    swapped = bodies | {"file:v": "\n".join(f"{s}|{a}|{t}" for s, a, t in VERSES[::-1])}
    with pytest.raises(corpus.GateError, match="another digest"):  # the order of a file is part of its digest
        build.build(spark, str(tmp_path / "m.toml"), str(tmp_path / "cache"), str(tmp_path / "out"), *args, download=swapped.__getitem__)
    assert not [p for p in (tmp_path / "cache").rglob("*") if p.is_file()]
    build.build(spark, str(tmp_path / "m.toml"), str(tmp_path / "cache"), str(tmp_path / "out"), {}, {}, download=bodies.__getitem__)
    assert len([p for p in (tmp_path / "cache").glob("*.txt")]) == 3
    assert spark.read.option("header", True).csv(str(tmp_path / "out/noise")).columns == ["sign", "n_ids"]
    bad = spark.createDataFrame([("quran:1:1", "0" * 64, "short")], "record_id string, text_sha256 string, reason string")
    with pytest.raises(corpus.GateError, match="curation"):
        build.build(spark, str(tmp_path / "m.toml"), str(tmp_path / "cache"), str(tmp_path / "out"), {}, {}, curation=bad)


def test_command_line(spark, files, built, tmp_path, capsys):
    from quotewright.__main__ import main

    (tmp_path / "rules.toml").write_text('[c]\ntitle = "Book"\ncuts = [{pattern = "وقال", governing = ["ثم"]}]\nstrips = ["x"]\n', encoding="utf-8")
    assert main(["build", str(files / "manifest.toml"), str(files / "cache"), str(tmp_path / "out"), "--rules", str(tmp_path / "rules.toml")]) == 0
    assert main(["materialize", str(tmp_path / "out"), str(tmp_path / "again")]) == 0
    assert main(["embed", str(tmp_path / "again"), str(tmp_path / "vectors"), "--dim", "64"]) == 0 and spark.read.parquet(str(tmp_path / "vectors")).count() == 5
    assert main(["embed", str(tmp_path / "again"), str(tmp_path / "vectors"), "--dim", "64"]) == 0
    p = tmp_path / "cases.json"
    p.write_text(json.dumps([{"id": "a", "text": "«قل هو الله أحد» (2:1)", "expect_verdict": "EXACT", "expect_record": "quran:2:1"}]))
    assert main(["evaluate", str(tmp_path / "again"), str(p), str(tmp_path / "judged")]) == 0
    p.write_text(json.dumps([{"id": "a", "text": "«قل هو الله أحد» (2:1)", "expect_verdict": "NOT_FOUND"}]))
    assert main(["evaluate", str(tmp_path / "again"), str(p), str(tmp_path / "judged")]) == 1
    assert "1 falsely verified" in capsys.readouterr().out


def test_requests_in_batch(spark, built):
    tried = lambda question, ids, feedback, evidence: ("s", [(ids[0] if feedback or "first" in question else "stray", "f", None)]) if "king" in evidence or "[quran" in evidence else None
    p = ask.Providers(lambda q: {"none": ["zzz"], "fail": 1 / 0 if q == "fail" else []}.get(q, ["king"]), tried, lambda s, items: False)
    history = [("before", None, ["quran:1:1", "nowhere"])]
    data = [("a", "first", None), ("b", "second", None), ("c", "none", None), ("d", "fail", None), ("e", "my rule", history), ("f", "third", history), ("g", "disputed", None)]
    requests = spark.createDataFrame(data, f"request_id string, question string, history {ask.HISTORY}")
    routes = [("PERSONAL", [["\\bmy\\b"]]), ("DISPUTED", [["disputed"]])]
    got = {r.request_id: r for r in ask.run(requests, built.records, built.postings, built.lengths, p, routes, ["PERSONAL"], {}).collect()}
    assert {k: (r.status, r.attempts, r.decision, r.reason) for k, r in got.items()} == {
        "a": ("published", 1, "PUBLISH", None), "b": ("published", 2, "PUBLISH", None), "c": ("abstained", 0, "ABSTAIN", "nothing found"), "d": ("abstained", 0, "ABSTAIN", "no search terms"),
        "e": ("abstained", 0, "ABSTAIN", "handed on"), "f": ("published", 2, "PUBLISH", None), "g": ("published", 2, "RELABEL_INTERPRETATION", None),
    }
    assert got["b"]["items"][0].record_id == "quran:1:2" and got["a"].reached == ["ayah"]
    texts = spark.createDataFrame([("r", "t"), ("bad", "fail")], "request_id string, text string")
    claims = ask.claims_of(texts, lambda t: [("king", ["king"]), ("none", ["zzz"])] if t == "t" else 1 / 0)
    found = service.claim_check(claims.select("claim_no", "terms"), built).withColumn("request_id", F.lit("r"))
    seen = ask.assess_claims(claims, found, built.records, lambda block: [("supported", "n", ["quran:1:2", "stray"]), ("unsupported", block[-16:], [])])
    assert [(r.claim, r.verdict, r.record_ids) for r in seen.orderBy("claim_no").collect()] == [("king", "supported", ["quran:1:2"]), ("none", "unsupported", [])]


def test_vectors_in_any_order_and_as_bytes(spark):
    texts = spark.createDataFrame([("a", "x", "1"), ("b", "y", "2")], "id string, text string, text_sha256 string").coalesce(1)
    got = {r.record_id: (r.dtype, r.vec) for r in embed.embed(texts, lambda t: [(1, [-1, 2]), (0, [3, -128])][: len(t)] if len(t) == 2 else [(0, [3, -128])], "m", "int8").collect()}
    assert got["a"] == ("int8", bytes([3, 128]))
