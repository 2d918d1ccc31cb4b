"""Visually identical text in one consistent form, by SQL that DuckDB runs inside Arrow partitions.

The form: presentation and full-width signs become the plain ones, every blank becomes U+0020, invisible characters
go, look-alike letters become the usual letter, and the result is in NFC. Vowel signs, hamza, dots and kashida stay.
A null stays null, an empty text stays empty; length is not limited.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quotewright.functions.spec import ALEFS, ARABIC, KASHIDA, LOSSY, MARKS
from quotewright.llm.pairs import PAIR_LIMIT, group_pairs, ordered, with_stats
from quotewright.runtime import ship_code, written

# Letters that look alike, as (as found, as wanted).
LOOKALIKES = [
    ("کڪھہەۃ", "ككهههة"),
    ("۰۱۲۳۷۸۹", "٠١٢٣٧٨٩"),
    ("АВЕЅІЈКМНОРСТХаеорсухѕіј", "ABESIJKMHOPCTXaeopcyxsij"),
    ("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧο", "ABEZHIKMNOPTYXo"),
    ("‐‑", "--"),
]
# Characters without any mark on paper.
INVISIBLE = [(0xAD, 0xAD), (0x34F, 0x34F), (0x61C, 0x61C), (0x180E, 0x180E), (0x200B, 0x200F), (0x202A, 0x202E), (0x2060, 0x2064), (0x2066, 0x206F), (0xFE00, 0xFE0F), (0xFEFF, 0xFEFF)]
# Blocks whose compatibility forms are folded.
FOLDED = [(0x2000, 0x200A), (0xFB50, 0xFDFF), (0xFE70, 0xFEFC), (0xFF01, 0xFF60), (0xFFE0, 0xFFE6)]
BLANKS = "\t\n\x0b\x0c\r\x85\xa0     　"
YEH, FARSI_YEH, DOTLESS_YEH = "ي", "ی", "ى"
FARSI_YEH_FORMS = "ﯼﯽﯾﯿ"


def _tables() -> tuple[str, str, dict[str, str]]:
    """(from, to) of translate, characters beyond the end of `to` are dropped; and forms of several characters."""
    one, many = {b: " " for b in BLANKS}, {}
    for low, high in FOLDED:
        for c in map(chr, range(low, high + 1)):
            plain = unicodedata.normalize("NFKC", c)
            if len(plain) == 1 and plain != c:
                one[c] = plain
            elif len(plain) > 1:
                many[c] = plain
    for found, wanted in LOOKALIKES:
        one |= dict(zip(found, wanted))
    gone = "".join(chr(c) for low, high in INVISIBLE for c in range(low, high + 1))
    return "".join(one) + gone, "".join(one.values()), many


_FROM, _TO, _LIGATURES = _tables()


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def consistent_sql(t: str) -> str:
    """DuckDB SQL of the consistent form of a text."""
    parts = f"map([{', '.join(map(_quoted, _LIGATURES))}], [{', '.join(map(_quoted, _LIGATURES.values()))}])"
    apart = f"CASE WHEN regexp_matches({t}, '[{''.join(_LIGATURES)}]') THEN array_to_string(list_transform(string_split({t}, ''), lambda x: coalesce({parts}[x], x)), '') ELSE {t} END"
    plain = f"translate({apart}, {_quoted(_FROM)}, {_quoted(_TO)})"
    # a letter joined on its left shows the Farsi yeh with dots, a last letter shows it without
    joined = _quoted(f"{FARSI_YEH}(\\p{{Mn}}*[\\x{{0620}}-\\x{{063F}}\\x{{0640}}-\\x{{064A}}\\x{{066E}}-\\x{{06D3}}])")
    dotted = f"regexp_replace(regexp_replace({plain}, {joined}, '{YEH}\\1', 'g'), {joined}, '{YEH}\\1', 'g')"
    return f"nfc_normalize(CASE WHEN contains({t}, '{FARSI_YEH}') OR regexp_matches({t}, '[{FARSI_YEH_FORMS}]') THEN replace({dotted}, '{FARSI_YEH}', '{DOTLESS_YEH}') ELSE {plain} END)"


def words_sql(form: str) -> str:
    """DuckDB SQL of the words, at the aggressive tier and a space between, of a text in its consistent form."""
    marks = "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in MARKS)
    bare = f"regexp_replace({form}, '[{KASHIDA}{marks}]+', '', 'g')"
    folded = f"translate({bare}, {_quoted(ALEFS[0] + LOSSY[0])}, {_quoted(ALEFS[1] + LOSSY[1])})"
    return f"trim(regexp_replace({folded}, '[^\\x{{{ARABIC[0]:x}}}-\\x{{{ARABIC[1]:x}}}]+', ' ', 'g'))"


def connection():
    """A DuckDB connection with the macros consistent(text) and words(text)."""
    import duckdb

    con = duckdb.connect(config={"threads": 1, "memory_limit": "300MB"})
    con.execute(f"CREATE MACRO consistent(t) AS {consistent_sql('t')}")
    con.execute(f"CREATE MACRO words(t) AS {words_sql('consistent(t)')}")
    return con


def consistent(con, column: pa.Array) -> pa.Array:
    """The consistent form of each value, in order."""
    batch = pa.table({"n": pa.array(range(len(column)), pa.int64()), "t": column})  # noqa: F841 - read by name
    con.register("batch", batch)
    out = con.sql("SELECT consistent(t) AS c FROM batch ORDER BY n").to_arrow_table()["c"].combine_chunks()
    con.unregister("batch")
    return out.cast(pa.string())


def _form(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    con = connection()
    for b in batches:
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), consistent(con, b.column(1))], names=["id", "text", "form"])


def with_form(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, text, form of every row."""
    ship_code(df.sparkSession)
    rows = df.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_form, "id string, text string, form string")


def _keyed(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id and 128 bits each of the form (f1, f2) and the stored text (t1, t2), once for each id and text: a written table."""
    key = lambda c, n: [F.xxhash64(c).alias(f"{n}1"), F.xxhash64(F.lit(11), c).alias(f"{n}2")]
    rows = with_form(df.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()), id_col, text_col)
    return written(rows.select("id", *key(F.col("form"), "f"), *key(F.col("text"), "t")).distinct(), "forms")


def lookalike_pairs(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id_a < id_b of ids whose texts differ as stored and have the same form.

    All such pairs are given; groups of more than PAIR_LIMIT ids are compared in blocks. Ids of one identical stored text
    form no pair, so a hot text costs as many rows as it has look-alikes.
    Null ids and null texts take no part.
    """
    keyed = _keyed(df, id_col, text_col)
    kinds = keyed.select("f1", "f2", "t1", "t2").distinct()
    texts = group_pairs(with_stats(kinds.withColumn("kind", F.struct("t1", "t2")), ["f1", "f2"]), ["f1", "f2"], "kind").select(*[F.col(f"{s}.{t}").alias(f"{s}_{t}") for s in "ab" for t in ("t1", "t2")])
    texts = written(texts, "look_alikes")
    both = texts.select(F.col("a_t1").alias("t1"), F.col("a_t2").alias("t2")).unionAll(texts.select(F.col("b_t1").alias("t1"), F.col("b_t2").alias("t2"))).distinct()
    # classes of ids with one stored text, of those that have look-alikes; a large one meets another block by block
    held = with_stats(keyed.select("t1", "t2", "id").join(both, ["t1", "t2"], "left_semi"), ["t1", "t2"], least=1).withColumn("block", F.pmod(F.xxhash64("id"), F.ceil(F.col("group_size") / PAIR_LIMIT)).cast("int"))
    held = written(held, "look_alike_ids")
    blocks = held.select("t1", "t2", "block").distinct()
    side = lambda df, s, *more: df.select(*[F.col(c).alias(f"{s}_{c}") for c in ("t1", "t2", "block", *more)])
    met = texts.join(side(blocks, "a"), ["a_t1", "a_t2"]).join(side(blocks, "b"), ["b_t1", "b_t2"])
    pairs = met.join(side(held, "a", "id"), ["a_t1", "a_t2", "a_block"]).join(side(held, "b", "id"), ["b_t1", "b_t2", "b_block"])
    # an id whose rows hold several texts may meet another, or itself, more than once
    return pairs.where(F.col("a_id") != F.col("b_id")).select(*ordered(F.col("a_id"), F.col("b_id"))).distinct()


def lookalike_classes(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, class_id (the least id with the same form), class_size (ids with it), links (of these, ids with another stored
    text): a row for every id; of an id with several texts the one with the most links, then the least class."""
    keyed = _keyed(df, id_col, text_col)
    rows = with_stats(keyed, ["f1", "f2"], least=1, class_id=F.min("id")).withColumnRenamed("group_size", "class_size")
    counted = with_stats(written(rows, "classes"), ["t1", "t2"], least=1).withColumn("links", F.col("class_size") - F.col("group_size"))
    best = counted.groupBy("id").agg(F.min(F.struct((-F.col("links")).alias("less"), "class_id", "class_size")).alias("c"))
    return best.select("id", "c.class_id", "c.class_size", (-F.col("c.less")).alias("links"))
