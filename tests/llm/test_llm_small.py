"""The training-data operators on small fixtures against brute force, and their edge cases."""

import random
import tracemalloc
import unicodedata

import numpy as np
import pyarrow as pa
import pytest

from quotewright.functions.spec import normalize
from quotewright.llm import graph, leaks, lookalike, near, pairs, reading, spans, terms, tokenize, vectors
from quotewright.llm.queries import TOKENIZERS
from quotewright.operators import skew

RANKS = f"{TOKENIZERS}/byte_bpe_50k.tiktoken"
RECORDS = "id string, text string, extra string"


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def texts(spark, values, schema=RECORDS):
    return spark.createDataFrame([(i, t, None) for i, t in values], schema)


def vocabulary(n=400):
    rng = random.Random(5)
    return ["".join(rng.choice("بتثجحخدذرزسشصضطظعغفقكلمنهوي") for _ in range(rng.randint(3, 7))) for _ in range(n)]


def sentences(rng, words, n):
    return [rng.choice(words) for _ in range(n)]


# -- pairs


def test_copies_give_all_pairs_or_a_star(spark, monkeypatch):
    members = spark.createDataFrame([("g", f"{i:03}") for i in range(9)] + [("h", "x"), ("h", "y"), ("k", "z")], "t string, id string")
    linked = spark.createDataFrame([("g", "k")], "a string, b string")
    held = pairs.class_members(members, "t")
    whole = {(f"{i:03}", f"{j:03}") for i in range(9) for j in range(i + 1, 9)} | {("x", "y")} | {(f"{i:03}", "z") for i in range(9)}
    assert set(rows(pairs.expand(linked, held, "t"))) == whole
    monkeypatch.setattr(pairs, "PAIR_LIMIT", 4)
    assert rows(pairs.expand(linked, held, "t")) == sorted([("000", f"{i:03}") for i in range(1, 9)] + [("x", "y"), ("000", "z")])
    assert set(rows(pairs.expand(linked, held, "t", limit=0))) == whole
    assert set(rows(pairs.classes(linked, held, "t"))) == {(f"{i:03}", "000", 9, 1) for i in range(9)} | {("x", "x", 2, 0), ("y", "x", 2, 0), ("z", "z", 1, 1)}


def test_hot_keys_are_spread_without_loss(spark, monkeypatch):
    monkeypatch.setattr(skew, "TASK_ROWS", 10)
    many = spark.createDataFrame([("hot", i) for i in range(95)] + [("cold", 1), ("none", 2)], "k string, v int")
    few = spark.createDataFrame([("hot", "a"), ("hot", "b"), ("cold", "c")], "k string, w string")
    got = rows(skew.spread_join(many, few, ["k"]).select("k", "v", "w"))
    assert got == sorted([("hot", i, w) for i in range(95) for w in "ab"] + [("cold", 1, "c")])
    assert len(rows(pairs.with_stats(many, ["k"], least=1))) == 97


def test_large_groups_are_compared_in_blocks_without_loss(spark, monkeypatch):
    monkeypatch.setattr(pairs, "PAIR_LIMIT", 3)
    m = spark.createDataFrame([(1, v, 11) for v in range(11)], "k int, v int, group_size int")
    assert len(rows(pairs.group_pairs(m, ["k"], "v").select("a", "b").distinct())) == 55


# -- 1: vectors


def packed_rows(x):
    return [np.packbits(r).tobytes() for r in x]


def test_neighbours_match_brute_force_and_unusable_rows_are_left_out(spark):
    rng = np.random.default_rng(1)
    centres = rng.random((6, 256)) < 0.5
    x = np.concatenate([(rng.random((40, 256)) < 0.2) ^ c for c in centres])
    x[1] = x[0] ^ (rng.random(256) < 0.03)
    data = [(f"r{i:03}", "m", 256, "binary", v, "clash") for i, v in enumerate(packed_rows(x))]
    bad = [("zero", "m", 256, "binary", bytes(32), "c"), ("cut", "m", 256, "binary", bytes([1] * 5), "c"), ("none", "m", 256, "binary", None, "c"), (None, "m", 256, "binary", data[3][4], "c"), ("other", "m", 128, "binary", bytes([1] * 16), "c"), ("kind", "m", 256, "int8", bytes([1] * 32), "c")]
    df = spark.createDataFrame(data + [data[0], data[0]] + bad, "record_id string, model string, dim int, dtype string, vec binary, rank string")
    got = vectors.neighbours(df, 10).collect()
    d = (x[:, None] != x[None]).sum(2)
    np.fill_diagonal(d, 999)
    hits = [r.distance <= np.sort(d[int(r.record_id[1:])])[9] for r in got]
    assert len(got) == 2400 and np.mean(hits) >= 0.9
    assert ("r000", "r001") in rows(vectors.mutual_pairs(vectors.neighbours(df, 10)))
    assert rows(vectors.neighbours(df.limit(0), 10)) == []


def test_pivots_and_shards_keep_recall(spark, monkeypatch):
    monkeypatch.setattr(vectors, "SHARD", 150)
    monkeypatch.setattr(vectors, "QUERIES", 100)
    rng = np.random.default_rng(2)
    centres = rng.random((5, 256)) < 0.5
    x = np.concatenate([(rng.random((160, 256)) < 0.2) ^ c for c in centres])
    df = spark.createDataFrame([(f"{i}", "m", 256, "binary", v) for i, v in enumerate(packed_rows(x))], "record_id string, model string, dim int, dtype string, vec binary")
    d = (x[:, None] != x[None]).sum(2)
    np.fill_diagonal(d, 999)
    kth = np.sort(d, 1)[:, 9]
    got = vectors.neighbours(df, 10).collect()
    assert sum(r.distance <= kth[int(r.record_id)] for r in got) / 8000 >= 0.9


def brute_records(data, k):
    """data: record -> list of bit rows; (record, rank) -> distance, by the nearest vectors of two records."""
    names = sorted(data)
    out = {}
    for a in names:
        d = sorted((min(int((x != y).sum()) for x in data[a] for y in data[b]), b) for b in names if b != a)
        out[a] = [x for x, _ in d[:k]]
    return out


def test_fitting_and_comparing_pivots_hold_little_at_once():
    """The driver fits pivots, so no table of all sampled rows by all pivots may stand in its memory."""
    rng = np.random.default_rng(5)
    x = rng.integers(0, 1 << 63, (500, 4), dtype=np.uint64)[rng.integers(0, 500, 20_000)] ^ (np.uint64(1) << rng.integers(0, 63, (20_000, 4), dtype=np.uint64))
    tracemalloc.start()
    try:
        pivots = vectors.fit_pivots(x, 256, 600)
        order, d = vectors.nearest(x, pivots)
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert most < 40e6  # a table of distances has 20,000 x 500 x 4 bytes, its keys twice that
    full = np.bitwise_count(x[:300, None] ^ pivots[None]).sum(-1, dtype=np.int64)
    want = np.argsort(full, 1, kind="stable")[:, : vectors.PROBES]
    assert len(pivots) > 400 and (order[:300] == want).all() and (d[:300] == np.take_along_axis(full, want, 1)).all()


def test_a_record_with_several_vectors_gets_k_distinct_neighbours(spark):
    rng = np.random.default_rng(4)
    data = {f"r{i:02}": [(rng.random(256) < 0.5)] for i in range(40)}
    for r in data:
        data[r] += [data[r][0] ^ (rng.random(256) < 0.03) for _ in range(3)]
    df = spark.createDataFrame([(r, "m", 256, "binary", v) for r, xs in data.items() for v in packed_rows(np.array(xs))], "record_id string, model string, dim int, dtype string, vec binary")
    got = vectors.neighbours(df, 10).collect()
    want = brute_records(data, 10)
    mine = {r: sorted((x.rank, x.distance, x.neighbour_id) for x in got if x.record_id == r) for r in data}
    assert all(len(m) == 10 and len({x[2] for x in m}) == 10 for m in mine.values())
    assert np.mean([[x[1] for x in mine[r]] == want[r] for r in data]) >= 0.9


def test_hot_vectors_keep_the_first_ids_and_crowded_pivots_are_split(spark, monkeypatch):
    monkeypatch.setattr(vectors, "SHARD", 100)
    monkeypatch.setattr(vectors, "SMALL", 50)
    monkeypatch.setattr(vectors, "QUERIES", 90)
    monkeypatch.setattr(vectors, "SPLIT", 8)
    rng = np.random.default_rng(5)
    centres = rng.random((30, 256)) < 0.2  # clusters of one cluster
    x = np.concatenate([(rng.random((20, 256)) < 0.05) ^ c for c in centres])
    hot = rng.random(256) < 0.5
    data = [(f"{i:04}", v) for i, v in enumerate(packed_rows(x))] + [(f"h{i:03}", v) for i, v in enumerate(packed_rows(np.array([hot] * 300)))]
    df = spark.createDataFrame([(r, "m", 256, "binary", v) for r, v in data], "record_id string, model string, dim int, dtype string, vec binary")
    got = vectors.neighbours(df, 10).collect()
    d = (x[:, None] != x[None]).sum(2)
    np.fill_diagonal(d, 999)
    kth = np.sort(d, 1)[:, 9]
    assert len(got) == 9000 and len({(r.record_id, r.neighbour_id) for r in got}) == 9000
    plain = [r for r in got if r.record_id[0] != "h"]
    assert sum(r.distance <= kth[int(r.record_id)] for r in plain) / len(plain) >= 0.9
    first = [f"h{i:03}" for i in range(11)]
    for r in ("h000", "h005", "h299"):
        assert [x.neighbour_id for x in sorted((x for x in got if x.record_id == r), key=lambda x: x.rank)] == [h for h in first if h != r][:10]


def test_graph_of_one_and_of_equal_points():
    one = np.zeros((1, 2), np.uint64)
    assert graph.build(one).search(one, 8)[0][0, 0] == 0
    same = np.ones((50, 2), np.uint64)
    ids, d = graph.build(same).search(same[:3], 16)
    assert (d[:, :10] == 0).all() and len(set(ids[0, :10])) == 10


def test_hot_model_of_identical_vectors(spark):
    df = spark.createDataFrame([(f"{i}", "m", 64, "binary", bytes([7] * 8)) for i in range(60)], "record_id string, model string, dim int, dtype string, vec binary")
    got = vectors.neighbours(df, 10).collect()
    assert len(got) == 600 and all(r.distance == 0 for r in got)


# -- 2: terms


def test_terms_count_ids_once_and_mark(spark, monkeypatch):
    monkeypatch.setattr(terms, "HEAVY", 2)
    data = [("a", "x y x", "c"), ("a", "x y x", "c"), ("b", "x z", "c "), ("c", "", None), ("d", None, ""), (None, "x q", "c"), ("e", "x", "c"), ("f", "w  w", "c")]
    df = spark.createDataFrame(data, "id string, words string, label string")
    got = {(r.field_name, r.term): (r.occurrences, r.n_ids, r.freq_mark) for r in terms.term_counts(df, "id", {"words": True, "label": False}).collect()}
    assert got[("words", "x")] == (4, 3, "common") and got[("words", "y")] == (1, 1, "rare") and got[("words", "w")] == (2, 1, "rare")
    assert got[("label", "c")] == (3, 3, "common") and got[("label", "")] == (1, 1, "rare") and ("words", "q") not in got
    assert terms.term_counts(df.limit(0), "id", {"words": True}).collect() == []


def test_terms_do_not_depend_on_what_is_heavy(spark, monkeypatch):
    rng = random.Random(3)
    df = spark.createDataFrame([(str(i), " ".join(rng.choice("abcdefgh") * rng.randint(1, 2) for _ in range(9))) for i in range(300)], "id string, w string").repartition(5)
    out = []
    for heavy in (1, 3, 100):
        monkeypatch.setattr(terms, "HEAVY", heavy)
        out.append(rows(terms.term_counts(df, "id", {"w": True}).select("term", "occurrences", "n_ids")))
    assert out[0] == out[1] == out[2]


# -- 4: look-alikes


@pytest.mark.parametrize(
    ("a", "b", "same"),
    [
        ("كتاب", "ﻛﺘﺎﺏ", True), ("أحمد", "أحمد", True), ("قال لي", "قال لي", True), ("قال", "ق​ا‏ل", True), ("(نص)!", "（نص）！", True),
        ("كل", "کل", True), ("هو", "ھو", True), ("بيت", "بیت", True), ("لا", "ﻻ", True), ("مَُّ", "مُّ", False), ("قال", "قـال", False), ("على", "علي", False), ("قَال", "قال", False), ("احمد", "أحمد", False), ("على", "علی", True),
    ],
)
def test_consistent_form(a, b, same):
    out = lookalike.consistent(lookalike.connection(), pa.array([a, b, None, ""]))
    assert (out[0].as_py() == out[1].as_py()) is same and out[2].as_py() is None and out[3].as_py() == ""


def test_lookalike_pairs(spark, monkeypatch):
    df = texts(spark, [("a", "قال لي"), ("b", "قال لي"), ("c", "قال لي"), ("c", "قال لي"), ("d", None), (None, "قال لي"), ("e", "x" * 200_000), ("f", "")])
    assert rows(lookalike.lookalike_pairs(df, "id", "text")) == [("a", "b"), ("b", "c")]
    monkeypatch.setattr(lookalike, "PAIR_LIMIT", 2)
    got = rows(lookalike.lookalike_pairs(df, "id", "text"))
    assert {x for p in got for x in p} == {"a", "b", "c"}
    assert rows(lookalike.lookalike_pairs(df.limit(0), "id", "text")) == []


def test_look_alikes_of_a_hot_text_all_meet(spark, monkeypatch):
    monkeypatch.setattr(lookalike, "PAIR_LIMIT", 3)
    data = [(f"h{i}", "كل") for i in range(8)] + [("v1", "کل"), ("v2", "ﻛﻞ"), ("v3", "ﻛﻞ")]
    got = sorted(map(tuple, lookalike.lookalike_pairs(spark.createDataFrame(data, "id string, text string"), "id", "text").collect()))
    assert got == sorted((a, b) for a, x in data for b, y in data if a < b and x != y)


# -- 5: spans


def brute_spans(data, n):
    runs = {i: {tuple(t.split()[k : k + n]) for k in range(len(t.split()) - n + 1)} for i, t in data if i and t}
    ids = sorted(runs)
    return sorted((a, b) for a in ids for b in ids if a < b and runs[a] & runs[b])


def test_shared_spans_match_brute_force(spark):
    rng, words = random.Random(4), vocabulary()
    common = sentences(rng, words, 15)
    data = []
    for i in range(60):
        w = sentences(rng, words, 30)
        if i % 5 == 0:
            w[5 : 5 + 11 + i % 4] = common[: 11 + i % 4]
        data.append((f"r{i:02}", " ".join(w)))
    data += [("copy1", data[1][1]), ("copy2", data[1][1]), ("short", "a b"), ("copyshort", "a b"), ("none", None), ("empty", ""), (None, data[1][1])]
    df = texts(spark, data + data[:3])
    got = rows(spans.shared_span_pairs(df, "id", "text", 12))
    assert got == brute_spans(data, 12)
    share = {r.id: r for r in spans.shared_share(df, "id", "text", 12).collect()}
    assert share["copy1"].shared_percent == 100 and share["copy1"].repeated_words == 0 and share["copy2"].repeated_words == 30
    assert share["short"].shared_words == 0 and share["empty"].n_words == 0
    assert rows(spans.shared_span_pairs(df.limit(0), "id", "text", 12)) == []


def test_a_third_of_all_rows_may_share_one_text(spark, monkeypatch):
    monkeypatch.setattr(pairs, "PAIR_LIMIT", 10)
    hot = " ".join(vocabulary(20))
    data = [(f"h{i:02}", hot) for i in range(30)] + [(f"o{i}", " ".join(sentences(random.Random(i), vocabulary(), 20))) for i in range(30)] + [("near", hot + " x")]
    df = texts(spark, data)
    assert rows(spans.shared_span_pairs(df, "id", "text", 12)) == sorted([("h00", f"h{i:02}") for i in range(1, 30)] + [("h00", "near")])
    assert rows(spans.shared_span_pairs(df, "id", "text", 12, limit=0)) == brute_spans(data, 12)
    got = {r[0]: r[1:] for r in rows(spans.span_classes(df, "id", "text", 12))}
    assert got["h07"] == ("h00", 30, 1) and got["near"] == ("near", 1, 1) and got["o3"] == ("o3", 1, 0) and len(got) == 61


def test_a_passage_that_many_share_proposes_each_pair_once(spark, monkeypatch):
    """Passages that begin texts, follow equal words, repeat within a text, or stand at several places."""
    rng, words = random.Random(12), vocabulary()
    boiler = sentences(rng, words, 40)
    data = []
    for i in range(24):
        head = [] if i % 4 == 0 else ["same"] if i % 4 == 1 else sentences(rng, words, 3)
        data.append((f"r{i:02}", " ".join(head + boiler[i % 3 : 40 - i % 5] + sentences(rng, words, 4) + (boiler[:20] if i % 6 == 0 else []))))
    data += [("twice", " ".join(boiler[5:20] + boiler[5:20])), ("once", " ".join(boiler[6:18])), ("less", " ".join(boiler[6:17]))]
    monkeypatch.setattr(pairs, "PAIR_LIMIT", 5)
    assert rows(spans.shared_span_pairs(texts(spark, data), "id", "text", 12, limit=0)) == brute_spans(data, 12)


# -- 6: near duplicates


def brute_near(data, shingle, least, share):
    sets = {}
    for i, t in data:
        w = normalize(t, "aggressive").split() if t else []
        if i and len(w) >= least:
            sets[i] = {tuple(w[k : k + shingle]) for k in range(len(w) - shingle + 1)}
    ids = sorted(sets)
    return sorted((a, b) for a in ids for b in ids if a < b and len(sets[a] & sets[b]) >= share * len(sets[a] | sets[b]) - 1e-12)


@pytest.mark.parametrize("limit", [32, 2])
def test_near_duplicates_match_brute_force(spark, monkeypatch, limit):
    monkeypatch.setattr(near, "NODE_LIMIT", limit)
    rng, words, data = random.Random(6), vocabulary(), []
    for g in range(12):
        base = sentences(rng, words, 40)
        for k in range(6):
            w = list(base)
            for _ in range(k):
                w[rng.randrange(len(w))] = rng.choice(words)
            data.append((f"g{g:02}k{k}", " ".join(w)))
    data += [("same", data[0][1]), ("signs", "ﻛ" + data[0][1]), ("short", " ".join(words[:19])), ("none", None), ("empty", ""), (None, data[0][1])]
    df = texts(spark, data + data[:2])
    want = brute_near([(i, t.replace("ﻛ", "ك") if t else t) for i, t in data], 3, 20, 0.6)
    assert rows(near.near_duplicates(df, "id", "text", 3, 20, (3, 5))) == want
    assert rows(near.near_duplicates(df.limit(0), "id", "text")) == []


def test_groups(spark):
    members = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3), ("d", 4), ("e", 5), ("e2", 5)], "id string, t long")
    links = spark.createDataFrame([(1, 2), (2, 3), (4, 5)], "a long, b long")
    assert rows(near.groups(members, links)) == [("a", "a", "a", 1), ("b", "a", "b", 2), ("c", "a", "c", 1), ("d", "d", "d", 1), ("e", "d", "e", 1), ("e2", "d", "e", 1)]


def test_groups_are_those_of_the_pairs(spark, data):
    from quotewright.llm import queries

    group = {r.id: r.group_id for r in queries.p6_groups(spark, data).collect()}
    found = queries.p6_found(spark, data).collect()
    assert found and all(group[p.id_a] == group[p.id_b] for p in found)
    linked = {x for p in found for x in p}
    assert all(g == i for i, g in group.items() if i not in linked)


# -- 7: tokens


@pytest.fixture(scope="module")
def encoder():
    from pathlib import Path

    return tokenize.Encoder(tokenize.Vocabulary(Path(RANKS).read_bytes()))


def reference_ids(values):
    import base64

    import public_tokenizers as p
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    enc = tiktoken.Encoding("own", pat_str=p.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return [enc.encode_ordinary(t) if t else [] for t in values]


def test_tokens_match_the_public_library_and_decode(encoder):
    rng, signs = random.Random(7), "aA's t'rer'vell'dm  \n\t1٣é،؟!\"'«» ‏ﷺ日本😀"
    values = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 30))) for _ in range(1500)]
    values += ["'re", "x'll 'd", "don't", "''s", "\n's", " 's", "'", "a'", "'sabc", "x" * 700, "ab" * 900, " " * 300, "<|endoftext|>", None, "", "a\n\n\n b", "  x"]
    want, k = reference_ids(values), 0
    for part in tokenize.chunks(pa.array(values), 500):
        ids, at, ends = encoder.encode(part)
        for j in range(len(part)):
            mine = ids[at[j] : at[j + 1]].tolist()
            assert mine == want[k], values[k]
            assert tokenize.decode(mine, encoder.v) == (values[k] or "").encode()
            if mine:
                assert ends[at[j + 1] - 1] == len(values[k].encode())
            k += 1
    assert k == len(values)


def test_tokens_query(spark):
    df = spark.createDataFrame([(1, "Hello world", "x"), (2, None, "x"), (3, "", None), (4, "Hello world", "x")], "doc_id long, text string, ids string")
    got = {r.doc_id: list(r.ids) for r in tokenize.encode(df, "doc_id", "text", RANKS).collect()}
    assert got[1] == got[4] == reference_ids(["Hello world"])[0] and got[2] == got[3] == []
    assert tokenize.encode(df.limit(0), "doc_id", "text", RANKS, with_ends=True).collect() == []


# -- 8: leaks


def brute_leaks(docs, items, run=5):
    fold = lambda t: [w for w in "".join(c if unicodedata.category(c)[0] in "LN" else " " if unicodedata.category(c) not in ("Mn", "Cf") and c != "ـ" else "" for c in unicodedata.normalize("NFKC", t).lower().translate(str.maketrans("آأإٱ", "اااا"))).split()]
    out = []
    for i, t in items:
        w = fold(t or "")
        for d, x in docs:
            grams = {tuple(fold(x or "")[k : k + run]) for k in range(len(fold(x or "")) - run + 1)}
            hit = {p for k in range(len(w) - run + 1) if tuple(w[k : k + run]) in grams for p in range(k, k + run)}
            if w and 2 * len(hit) >= len(w) and hit:
                out.append((i, d))
    return sorted(out)


def test_leaks_match_brute_force_also_when_reordered(spark, monkeypatch):
    rng, words = random.Random(8), vocabulary()
    items = [(i, " ".join(sentences(rng, words, 20))) for i in range(8)] + [(90, "a b c"), (91, None), (92, "")]
    docs = []
    for d in range(40):
        body = sentences(rng, words, 30)
        source = items[d % 8][1].split()
        keep = [20, 12, 9, 0][d % 4]
        cut = source[:keep]
        docs.append((d, " ".join(body[:10] + cut[keep // 2 :] + ["zz"] * (d % 3 == 0) + cut[: keep // 2] + body[10:])))
    docs += [(100, items[0][1].upper().replace(" ", ",  ")), (101, None), (102, ""), (103, items[1][1].replace("ا", "أ") + "ـ"), (103, items[1][1].replace("ا", "أ") + "ـ")]
    d = spark.createDataFrame([(k, t, "x") for k, t in docs], "doc_id long, text string, item_id string")
    i = spark.createDataFrame([(k, t, 1) for k, t in items], "item_id long, text string, doc_id int")
    want = sorted(set(brute_leaks(docs, items)))
    assert want and rows(leaks.leaked(leaks.leaks(d, "doc_id", "text", i, "item_id", "text"))) == want
    monkeypatch.setattr(leaks, "BLOCK_CHARS", 300)
    assert rows(leaks.leaked(leaks.leaks(d, "doc_id", "text", i, "item_id", "text"))) == want
    assert rows(leaks.leaks(d.limit(0), "doc_id", "text", i, "item_id", "text")) == rows(leaks.leaks(d, "doc_id", "text", i.limit(0), "item_id", "text")) == []


def test_tiles_decide_and_only_what_they_leave_is_counted(spark, monkeypatch):
    words = [f"w{i}" for i in range(40)]
    d = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(words[:9] + ["x"] + words[6:14] + ["x"] + words[11:20])), (3, " ".join(words[:6]))], "doc_id long, text string")
    i = spark.createDataFrame([(7, " ".join(words))], "item_id long, text string")
    got = {r.doc_id: (r.tiles, r.tiled_words, r.covered_words) for r in leaks.leaks(d, "doc_id", "text", i, "item_id", "text").collect()}
    # of document 2 the tiles hold 9 + 9 words, and the run in the middle adds two by overlapping
    assert got == {1: (1, 40, None), 2: (2, 18, 20), 3: (1, 6, 6)}
    assert rows(leaks.leaked(leaks.leaks(d, "doc_id", "text", i, "item_id", "text"))) == [(7, 1), (7, 2)]


def test_tiles_of_words_are_those_of_seeds():
    rng = np.random.default_rng(6)
    for n in range(60):
        a, b = (rng.integers(0, 2 + n % 5, 30 + 2 * n).astype(np.uint64) for _ in range(2))
        seeds = [(i, j) for i in range(len(a) - 4) for j in range(len(b) - 4) if (a[i : i + 5] == b[j : j + 5]).all()]
        if seeds:
            i, j = np.array(seeds).T
            want = leaks.tile(leaks.maximal_matches(np.zeros(len(i), np.int64), i, j, 5)[:, 1:], 5)
            assert sorted(leaks.tile_words(a, b, 5)) == sorted(want)


def test_an_item_of_equal_words_takes_time_by_its_words(spark):
    import time

    i = spark.createDataFrame([(1, "la " * 1000)], "item_id long, text string")
    seconds = []
    for n in (2000, 16000):
        d = spark.createDataFrame([(5, "la " * n)], "doc_id long, text string")
        began = time.time()
        assert rows(leaks.leaks(d, "doc_id", "text", i, "item_id", "text")) == [(1, 5, 1000, 1, 1000, None)]
        seconds.append(time.time() - began)
    assert seconds[1] < 4


def test_tiles_are_the_longest_and_do_not_overlap():
    matches = np.array([[0, 0, 8], [5, 20, 9], [0, 40, 5]])
    assert leaks.tile(matches, 5) == [(5, 20, 9), (0, 0, 5)]


# -- 9: reading level


def graded(rng, level):
    easy, hard = ["cat", "dog", "sun", "red", "big", "ran", "sat", "hat", "cup", "man"], ["jurisprudence", "consolidation", "verification", "interpolation", "codicologist", "provenance"]
    out = []
    for _ in range(40 // (3 * level) + 3):
        out.append(" ".join(rng.choice(hard) if rng.random() < level * 0.12 - 0.08 else rng.choice(easy) for _ in range(4 * level + rng.randint(0, 3))).capitalize() + ".")
    return " ".join(out)


def test_levels_on_held_out_texts(spark):
    rng = random.Random(9)
    docs = [(n, graded(rng, 1 + n % 5) + " x" * 40, "l") for n in range(300)] + [(900, None, "l"), (901, "short text", "l"), (902, "", "l")]
    docs.append((903, docs[299][1], "l"))
    d = spark.createDataFrame(docs, "doc_id long, text string, reading_level string")
    r = spark.createDataFrame([(n, 1 + n % 5, "r") for n in range(200)] + [(0, 1, None), (5, None, "r"), (None, 3, "r"), (7777, 2, "r")], "doc_id long, reading_level int, rater string")
    got = {x.doc_id: x.reading_level for x in reading.reading_levels(d, "doc_id", "text", r, "doc_id", "reading_level").collect()}
    assert not {900, 901, 902} & got.keys() and got[903] == got[299] and set(got.values()) <= {1, 2, 3, 4, 5}
    assert np.mean([got[n] == 1 + n % 5 for n in range(200, 300)]) >= 0.8
    assert reading.reading_levels(d, "doc_id", "text", r.limit(0), "doc_id", "reading_level").collect() == []
    assert reading.reading_levels(d.limit(0), "doc_id", "text", r, "doc_id", "reading_level").collect() == []


def test_close_points_far_from_all_others_are_found():
    """Points noisier than the rest have few edges towards them; each still finds its one close point."""
    rng = np.random.default_rng(3)
    centre = rng.random(512) < 0.5
    plain = (rng.random((700, 512)) < 0.2) ^ centre
    far = (rng.random((40, 512)) < 0.28) ^ centre
    x = np.packbits(np.concatenate([plain, far, far ^ (rng.random((40, 512)) < 0.1)]), axis=1).view(np.uint64)
    ids, _ = graph.build(x).search(x, 64, np.arange(len(x)))
    assert np.mean([700 + (i - 700 + 40) % 80 in ids[i, :3] for i in range(700, 780)]) >= 0.97


def test_hot_boilerplate_and_large_groups_of_like_records(spark, monkeypatch):
    """Records that share half of their words, and a group too alike to be parted: nothing is lost, levels end."""
    monkeypatch.setattr(near, "NODE_LIMIT", 4)
    rng, words = random.Random(10), vocabulary()
    boiler, base = sentences(rng, words, 25), sentences(rng, words, 60)
    data = [(f"b{i:02}", " ".join(boiler + sentences(rng, words, 25))) for i in range(40)]
    for i in range(30):
        w = list(base)
        w[rng.randrange(60)] = rng.choice(words)
        data.append((f"n{i:02}", " ".join(w)))
    assert rows(near.near_duplicates(texts(spark, data), "id", "text", 3, 20, (3, 5))) == brute_near(data, 3, 20, 0.6)
