"""Queries of the training-data operators and the SQL of those that SQL can express."""

from __future__ import annotations

import os
import unicodedata

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quotewright.llm import leaks, lookalike, near, reading, spans, terms, tokenize, vectors
from quotewright.plans.text import tier_sql
from quotewright.runtime import table

#: Where the public vocabulary files are.
TOKENIZERS = os.environ.get("QUOTEWRIGHT_TOKENIZERS", "/opt/tokenizers")
TERM_FIELDS = {"norm_aggressive": True, "collection": False}


def p1_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest of every usable vector."""
    return vectors.neighbours(table(spark, sf_dir, "record_vectors"), 10)


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.mutual_pairs(p1_neighbours(spark, sf_dir))


def p2_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of all terms."""
    return terms.term_counts(table(spark, sf_dir, "records"), "id", TERM_FIELDS)


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The terms with a mark."""
    return p2_terms(spark, sf_dir).where("freq_mark is not null").select("field_name", "term", "freq_mark")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookalike.lookalike_pairs(table(spark, sf_dir, "records"), "id", "text_ar")


def p4_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each record's class of look-alikes."""
    return lookalike.lookalike_classes(table(spark, sf_dir, "records"), "id", "text_ar")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.shared_span_pairs(table(spark, sf_dir, "records"), "id", "norm_standard", 12)


def p5_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each record's class of equal texts and how many other texts share a span with it."""
    return spans.span_classes(table(spark, sf_dir, "records"), "id", "norm_standard", 12)


def p5_shared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of each record stands in others."""
    return spans.shared_share(table(spark, sf_dir, "records"), "id", "norm_standard", 12)


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near.near_duplicates(table(spark, sf_dir, "records"), "id", "text_ar", 3, 20, (3, 5))


def p6_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The groups that the pairs of p6_found form."""
    return near.groups(*near.similar_classes(table(spark, sf_dir, "records"), "id", "text_ar", 3, 20, (3, 5)))


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenize.encode(table(spark, sf_dir, "documents"), "doc_id", "text", f"{TOKENIZERS}/byte_bpe_50k.tiktoken")


def p8_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All shared runs of documents and items, with tiles and coverage."""
    return leaks.leaks(table(spark, sf_dir, "documents"), "doc_id", "text", table(spark, sf_dir, "eval_cases"), "item_id", "text")


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks.leaked(p8_leaks(spark, sf_dir))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reading.reading_levels(table(spark, sf_dir, "documents"), "doc_id", "text", table(spark, sf_dir, "doc_levels"), "doc_id", "reading_level")


_TERMS_SQL = """
WITH one AS (SELECT id, any_value(norm_aggressive) AS norm_aggressive, any_value(collection) AS collection FROM records GROUP BY id),
words AS (
  SELECT 'norm_aggressive' AS field_name, id, unnest(string_split(norm_aggressive, ' ')) AS term FROM one WHERE norm_aggressive IS NOT NULL
  UNION ALL SELECT 'collection', id, collection FROM one WHERE collection IS NOT NULL
), counted AS (
  SELECT field_name, term, count(*) AS occurrences, count(DISTINCT id) AS n_ids FROM words WHERE term <> '' OR field_name = 'collection' GROUP BY ALL
), totals AS (
  SELECT 'norm_aggressive' AS field_name, count(norm_aggressive) AS n FROM one UNION ALL SELECT 'collection', count(collection) FROM one
), marked AS (
  SELECT c.field_name, term, occurrences, n_ids, CASE WHEN n_ids < 3 THEN 'rare' WHEN n_ids * 5 > n THEN 'common' END AS freq_mark
  FROM counted c JOIN totals t ON c.field_name = t.field_name
)
"""

_SPANS_SQL = """
WITH one AS (SELECT id, any_value(norm_standard) AS text FROM records WHERE norm_standard IS NOT NULL AND id IS NOT NULL GROUP BY id),
split AS (SELECT id, list_filter(string_split(text, ' '), lambda x: x <> '') AS words FROM one),
spans AS (SELECT id, len(words) AS n_words, unnest(range(1, len(words) - 10)) AS position, words FROM split WHERE len(words) >= 12),
hashed AS (SELECT id, position, array_to_string(words[position:position + 11], ' ') AS span FROM spans)
"""

#: The consistent form once more, sign by sign through a table of signs, as the operator's SQL doesn't work.
_SIGNS = {chr(c): unicodedata.normalize("NFKC", chr(c)) for low, high in lookalike.FOLDED for c in range(low, high + 1)} | {c: " " for c in lookalike.BLANKS}
_SIGNS |= {a: b for found, wanted in lookalike.LOOKALIKES for a, b in zip(found, wanted)} | {chr(c): "" for low, high in lookalike.INVISIBLE for c in range(low, high + 1)}
_FORMS_SQL = f"""
WITH signs(sign, plain) AS (VALUES {", ".join(f"(chr({ord(a)}), '{b.replace(chr(39), chr(39) * 2)}')" for a, b in sorted(_SIGNS.items()))}),
texts AS (SELECT DISTINCT id, text_ar FROM records WHERE id IS NOT NULL AND text_ar IS NOT NULL),
found AS (SELECT text_ar, unnest(string_split(text_ar, '')) AS c, unnest(range(len(string_split(text_ar, '')))) AS i FROM (SELECT DISTINCT text_ar FROM texts)),
mapped AS (SELECT text_ar, unnest(string_split(coalesce(plain, c), '')) AS c, i, unnest(range(greatest(1, length(coalesce(plain, c))))) AS j FROM found LEFT JOIN signs ON c = sign),
solid AS (SELECT text_ar, i, j, lead(c) OVER (PARTITION BY text_ar ORDER BY i, j) AS next FROM mapped WHERE c <> '' AND NOT regexp_matches(c, '\\p{{Mn}}')),
shown AS (
  SELECT m.text_ar, m.i, m.j, CASE WHEN c <> 'ی' THEN c WHEN regexp_matches(next, '[\\x{{620}}-\\x{{63f}}\\x{{640}}-\\x{{64a}}\\x{{66e}}-\\x{{6d3}}]') THEN 'ي' ELSE 'ى' END AS c
  FROM mapped m LEFT JOIN solid s ON s.text_ar = m.text_ar AND s.i = m.i AND s.j = m.j
), formed AS (SELECT text_ar, nfc_normalize(string_agg(c, '' ORDER BY i, j)) AS form FROM shown GROUP BY text_ar),
forms AS (SELECT id, t.text_ar, coalesce(form, '') AS form FROM texts t LEFT JOIN formed f ON f.text_ar = t.text_ar)
"""
_NEAR_SQL = f"""{_FORMS_SQL},
words AS (SELECT DISTINCT id, list_filter(string_split({tier_sql('aggressive', 'form')}, ' '), lambda x: x <> '') AS w FROM forms),
runs AS (SELECT DISTINCT id, array_to_string(w[i:i + 2], ' ') AS run FROM (SELECT id, w, unnest(range(1, len(w) - 1)) AS i FROM words WHERE len(w) >= 20)),
sizes AS (SELECT id, count(*) AS n FROM runs GROUP BY id),
common AS (SELECT a.id AS id_a, b.id AS id_b, count(*) AS c FROM runs a JOIN runs b ON a.run = b.run AND a.id < b.id GROUP BY ALL),
alike AS (SELECT id_a, id_b FROM common JOIN sizes x ON x.id = id_a JOIN sizes y ON y.id = id_b WHERE c * 5 >= (x.n + y.n - c) * 3)
"""
#: Words for which letter case, marks, alef forms, kashida and typographic forms don't matter.
_TYPED = {chr(c): unicodedata.normalize("NFKC", chr(c)) for c in range(0x80, 0x10000) if not 0xD800 <= c < 0xE000 and not 0x3300 <= c < 0xFA6E and len(unicodedata.normalize("NFKC", chr(c))) == 1 and unicodedata.normalize("NFKC", chr(c)) != chr(c)}
_JOINED = {c: f for c, f in _SIGNS.items() if len(f) > 1}


def _folded(t: str) -> str:
    several = f"map([{', '.join(f'chr({ord(c)})' for c in _JOINED)}], [{', '.join(repr(f) for f in _JOINED.values())}])"
    apart = f"CASE WHEN regexp_matches({t}, '[{''.join(_JOINED)}]') THEN array_to_string(list_transform(string_split({t}, ''), lambda x: coalesce({several}[x], x)), '') ELSE {t} END"
    plain = "".join(_TYPED.values()).replace("'", "''")
    low = f"lower(nfc_normalize(translate({apart}, '{''.join(_TYPED)}', '{plain}')))"
    bare = f"translate(regexp_replace({low}, '[\\p{{Mn}}\\p{{Me}}\\p{{Cf}}ـ]', '', 'g'), 'آأإٱکیھہە', 'اااا' || 'كيههه')"
    return f"list_filter(string_split(regexp_replace({bare}, '[^\\p{{L}}\\p{{N}}\\p{{Mc}}]', ' ', 'g'), ' '), lambda x: x <> '')"


_LEAKS_SQL = f"""
WITH items AS (SELECT item_id, {_folded('text')} AS w FROM eval_cases WHERE item_id IS NOT NULL AND text IS NOT NULL),
docs AS (SELECT doc_id, {_folded('text')} AS w FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
asked AS (SELECT item_id, i, array_to_string(w[i:i + 4], ' ') AS run, len(w) AS n FROM (SELECT item_id, w, unnest(range(1, len(w) - 3)) AS i FROM items WHERE len(w) >= 5)),
held AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS run FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM docs WHERE len(w) >= 5)),
places AS (SELECT DISTINCT item_id, doc_id, n, unnest(range(i, i + 5)) AS place FROM asked a JOIN held h ON a.run = h.run)
SELECT item_id, doc_id FROM places GROUP BY item_id, doc_id, n HAVING count(*) * 2 >= n"""

QUERIES = {"p1_neighbours": p1_neighbours, "p1_found": p1_found, "p2_terms": p2_terms, "p2_found": p2_found, "p4_found": p4_found, "p4_classes": p4_classes, "p5_found": p5_found, "p5_classes": p5_classes, "p5_shared": p5_shared, "p6_found": p6_found, "p6_groups": p6_groups, "p7_ids": p7_ids, "p8_leaks": p8_leaks, "p8_found": p8_found, "p9_found": p9_found}
SQL = {
    "p2_terms": _TERMS_SQL + "SELECT * FROM marked",
    "p2_found": _TERMS_SQL + "SELECT field_name, term, freq_mark FROM marked WHERE freq_mark IS NOT NULL",
    "p5_found": _SPANS_SQL + "SELECT DISTINCT a.id AS id_a, b.id AS id_b FROM hashed a JOIN hashed b ON a.span = b.span AND a.id < b.id",
    "p5_shared": _SPANS_SQL + """, held AS (SELECT span, min(id) AS first_id FROM hashed GROUP BY span HAVING count(DISTINCT id) > 1),
covered AS (SELECT h.id, unnest(range(h.position, h.position + 12)) AS place, h.id <> k.first_id AS repeated FROM hashed h JOIN held k ON h.span = k.span),
per AS (SELECT id, count(DISTINCT place) AS shared_words, count(DISTINCT place) FILTER (repeated) AS repeated_words FROM covered GROUP BY id)
SELECT s.id, len(words) AS n_words, coalesce(shared_words, 0) AS shared_words, coalesce(repeated_words, 0) AS repeated_words,
  CASE WHEN len(words) > 0 THEN (100 * coalesce(shared_words, 0)) // len(words) ELSE 0 END AS shared_percent
FROM split s LEFT JOIN per p ON s.id = p.id""",
    "p1_found": """
WITH dims AS (SELECT model, dim AS usual FROM (SELECT model, dim, count(*) AS n FROM record_vectors WHERE model IS NOT NULL GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY model ORDER BY n DESC, dim) = 1),
v AS (SELECT DISTINCT r.model, r.dim, r.record_id, r.vec FROM record_vectors r JOIN dims d ON r.model = d.model AND r.dim = d.usual WHERE r.dtype = 'binary' AND r.record_id IS NOT NULL AND octet_length(r.vec) = (r.dim + 7) // 8 AND regexp_matches(hex(r.vec), '[1-9A-F]')),
near AS (SELECT a.model, a.dim, a.record_id AS a, b.record_id AS b, min(bit_count(xor(a.vec::BIT, b.vec::BIT))) AS d FROM v a JOIN v b ON a.model = b.model AND a.record_id <> b.record_id GROUP BY ALL),
best AS (SELECT * FROM near QUALIFY row_number() OVER (PARTITION BY model, a ORDER BY d, b) <= 10)
SELECT DISTINCT x.a AS id_a, x.b AS id_b FROM best x JOIN best y ON x.model = y.model AND x.a = y.b AND x.b = y.a WHERE x.a < x.b AND x.d * 100 <= x.dim * 15""",
    "p4_classes": _FORMS_SQL + "SELECT id, class_id, class_size, max(links) AS links FROM (SELECT a.id, min(b.id) AS class_id, count(DISTINCT b.id) AS class_size, count(DISTINCT b.id) FILTER (a.text_ar <> b.text_ar) AS links FROM forms a JOIN forms b ON a.form = b.form GROUP BY a.id, a.text_ar) GROUP BY ALL",
    "p4_found": _FORMS_SQL + "SELECT DISTINCT a.id AS id_a, b.id AS id_b FROM forms a JOIN forms b ON a.form = b.form AND a.id < b.id AND a.text_ar <> b.text_ar",
    "p5_classes": _SPANS_SQL + """, one_class AS (SELECT s.id, min(o.id) AS class_id, count(*) AS class_size FROM one s JOIN one o ON s.text = o.text GROUP BY s.id),
linked AS (SELECT a.id, count(DISTINCT o.text) AS links FROM hashed a JOIN hashed b ON a.span = b.span JOIN one m ON m.id = a.id JOIN one o ON o.id = b.id AND o.text <> m.text GROUP BY a.id)
SELECT s.id, class_id, class_size, coalesce(links, 0) AS links FROM split s JOIN one_class c ON c.id = s.id LEFT JOIN linked l ON l.id = s.id WHERE len(words) >= 12""",
    "p6_found": _NEAR_SQL + "SELECT id_a, id_b FROM alike",
    "p6_groups": _NEAR_SQL.replace("WITH ", "WITH RECURSIVE ", 1) + """, both_ways AS (SELECT id_a AS x, id_b AS y FROM alike UNION SELECT id_b, id_a FROM alike),
reach(x, y) AS (SELECT id, id FROM words WHERE len(w) >= 20 UNION SELECT r.x, b.y FROM reach r JOIN both_ways b ON r.y = b.x),
counted AS (SELECT a.x AS id, count(DISTINCT o.w) FILTER (o.w <> m.w) AS links FROM both_ways a JOIN words m ON m.id = a.x JOIN words o ON o.id = a.y GROUP BY a.x)
SELECT r.x AS id, min(r.y) AS group_id, any_value(c.class_id) AS class_id, coalesce(any_value(links), 0) AS links
FROM reach r JOIN (SELECT a.id, min(b.id) AS class_id FROM words a JOIN words b ON a.w = b.w GROUP BY a.id) c ON c.id = r.x LEFT JOIN counted k ON k.id = r.x GROUP BY r.x""",
    "p8_found": _LEAKS_SQL,
}
