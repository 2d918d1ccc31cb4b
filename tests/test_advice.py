"""Cases in which queries gave less than the whole result."""

import os
import random

from pyspark.sql import functions as F

import __spark_entry__ as entry
from quotewright.operators.reach import may_resemble


def beside(spark, data, tmp_path, **tables):
    """A folder with the tables of `data`, some of them replaced."""
    for name in os.listdir(data):
        if name.removesuffix(".parquet") not in tables:
            os.symlink(f"{data}/{name}", tmp_path / name)
    for name, df in tables.items():
        df.write.parquet(str(tmp_path / f"{name}.parquet"))
    return str(tmp_path)


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_verify_documents_finds_edited_quotations(spark, data, tmp_path):
    r = spark.read.parquet(f"{data}/records.parquet").where("unscorable_reason is null and length(norm_aggressive) between 60 and 200").orderBy("row_no").first()
    word = r.norm_aggressive.split()[2]
    edited = r.norm_aggressive.replace(word, word + "ن", 1)
    docs = spark.createDataFrame([(1, f"He read «{edited}» aloud."), (2, f"She read «{edited}» too.")], "doc_id long, text string")
    out = entry.queries()["verify_documents"](spark, beside(spark, data, tmp_path, documents=docs)).collect()
    assert [(x.verdict, x.record_id) for x in out] == [("NEAR_MATCH", r.id)] * 2


def test_the_filter_before_ranking_loses_no_text(spark):
    rng = random.Random(3)
    words = ["".join(rng.choice("ابتثجحخدذر") for _ in range(rng.randint(2, 7))) for _ in range(60)]
    held = [" ".join(rng.choice(words) for _ in range(rng.choice([1, 2, 8, 20]))) for _ in range(60)]

    def edited(t):
        cs = list(t)
        for _ in range(rng.randint(0, max(1, len(t) // 5))):
            cs[rng.randrange(len(cs))] = rng.choice(["", "x", "xy", "ا"])
        return "".join(cs)

    asked = sorted({edited(t) for t in held * 3} - {""})
    want = sorted(a for a in asked if any(abs(len(a) - len(b)) <= 0.14005 * max(len(a), len(b)) + 1e-9 and distance(a, b) <= 0.14005 * max(len(a), len(b)) + 1e-9 for b in held))
    frame = lambda x: spark.createDataFrame([(t,) for t in [*x, None, ""]], "text string").select(F.col("text"))
    got = sorted(r.text for r in may_resemble(frame(asked), frame(held), 0.85995).collect())
    assert 50 < len(want) < len(asked) and got == want


def test_collections_come_from_ids_whatever_their_number_of_rows(spark):
    from quotewright.operators import extract

    data = [("hadith:zarfan:7", "zarfan", "7"), ("hadith:birqas:3", None, "3"), *[(f"hadith:zarfan:{i}", "al-zarfan", str(i)) for i in range(20, 50)], ("quran:1:1", None, None)]
    r = spark.createDataFrame(data, "id string, collection string, hadith_no string").withColumns({"surah": F.lit(None).cast("int"), "ayah": F.lit(None).cast("int"), "surah_name_en": F.lit(None).cast("string")})
    g = extract.grammar_of(r)
    found = [(c.collection, c.number) for c in g.citations("As in Zarfan 7, al-zarfan 21 and birqas 3.")]
    assert found == [("zarfan", "7"), ("zarfan", "21"), ("birqas", "3")]


def test_the_index_of_claims_holds_addenda_and_no_unscorable_text(spark, data, tmp_path):
    r = spark.read.parquet(f"{data}/records.parquet")
    ids = [x.id for x in r.select("id").distinct().orderBy("id").limit(2).collect()]
    changed = r.withColumn("addenda_ar", F.when(F.col("id") == ids[0], F.lit("زيادة غغغغظظ")).otherwise(F.col("addenda_ar"))).withColumn("unscorable_reason", F.when(F.col("id") == ids[1], "fragment").otherwise(F.col("unscorable_reason")))
    changed = changed.withColumn("norm_standard", F.when(F.col("id") == ids[1], F.lit("غغغغظظ")).otherwise(F.col("norm_standard")))
    cases = spark.read.parquet(f"{data}/eval_cases.parquet").limit(1).withColumn("text", F.lit("غغغغظظ"))
    d = beside(spark, data, tmp_path, records=changed, eval_cases=cases)
    for name in ("claim_candidates", "fts_index_records"):
        assert [x.record_id for x in entry.queries()[name](spark, d).collect()] == [ids[0]]
