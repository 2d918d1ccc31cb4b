"""Scalar text functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quotewright.functions.normalize import nfkd, normalize, squeeze

# Arabic blocks, the placeholder of redacted script, marks of transliteration, the digits that read as
# numbers, articles before a name, and page, milestone, part and quotation marks of annotated texts.
ARABIC_SCRIPT = "[\\x{600}-\\x{6ff}\\x{750}-\\x{77f}\\x{870}-\\x{8ff}\\x{fb50}-\\x{fdff}\\x{fe70}-\\x{feff}]"
REDACTED = "<arabic script redacted>"
TRANSLITERATION_MARKS = "ʿʻʾ’'"
DIGITS = ("٠١٢٣٤٥٦٧٨٩۰۱۲۳۴۵۶۷۸۹", "01234567890123456789")
ARTICLES = ["al", "ad", "adh", "an", "ar", "as", "ash", "at", "az"]
PAGE_MARK, MILESTONE, PART_MARK, QUOTE_MARK = "PageV\\d+P\\d+", "ms\\d+", "\\\\ \\d+ \\\\", "@QB@|@QE@"


def slug(name: Column) -> Column:
    """Letters a-z of a name, accents taken off."""
    return F.regexp_replace(F.lower(F.regexp_replace(nfkd(name), "[^\\x{0}-\\x{7f}]", "")), "[^a-z]", "")


def spelling_variants(name: Column) -> Column:
    """Array of the spellings of a name: with and without its article, with and without a final h, distinct and sorted."""
    base = slug(name)
    stems = [base, *[F.when(base.startswith(a) & (F.length(base) - len(a) >= 3), F.substr(base, F.lit(len(a) + 1))) for a in ARTICLES]]
    both = F.array_compact(F.flatten(F.array(*[F.array(s, F.when(s.endswith("h"), F.substr(s, F.lit(1), F.length(s) - 1))) for s in stems])))
    return F.array_sort(F.array_distinct(both))


def search_tokens(text: Column) -> Column:
    """Words of a query: everything but letters, digits, the underscore and Arabic becomes a space, single signs go."""
    clean = F.regexp_replace(text, "[^\\p{L}\\p{N}_\\x{600}-\\x{6ff} ]", " ")
    return F.filter(F.split(squeeze(clean), " "), lambda t: F.length(t) > 1)


def index_tokens(text: Column) -> Column:
    """Words of an indexed text: runs of letters and digits, lower case, without marks."""
    plain = F.regexp_replace(F.lower(text), "\\p{Mn}", "")
    return F.filter(F.split(F.regexp_replace(plain, "[^\\p{L}\\p{N}\\p{Co}]+", " "), " "), lambda t: t != "")


def query_text(q: Column) -> Column:
    """A search query: its Arabic part at the aggressive tier and its other part in lower case, joined."""
    arabic = normalize(q, "aggressive")
    other = squeeze(F.regexp_replace(F.lower(q), ARABIC_SCRIPT, " "))
    has = q.rlike(ARABIC_SCRIPT)
    return F.when(~has, squeeze(F.lower(q))).otherwise(F.trim(F.concat_ws(" ", F.nullif(arabic, F.lit("")), F.nullif(other, F.lit("")))))


def annotate(text: Column, names: list[str], mark: str) -> Column:
    """`mark` after each of the names that stands as a word, has no apostrophe and no mark after it. Repeating changes nothing."""
    words = "|".join(sorted(names, key=len, reverse=True))
    return F.regexp_replace(text, f"(?U)\\b({words})\\b(?!['’])(?!\\s*\\Q{mark[0]}\\E)", f"$1 {mark}")


def fold_diacritics(text: Column) -> Column:
    """Compatibility form without combining marks and marks of transliteration."""
    return F.translate(F.regexp_replace(nfkd(text), "\\p{M}", ""), TRANSLITERATION_MARKS, "")


def contains_arabic(text: Column) -> Column:
    return text.rlike(ARABIC_SCRIPT)


def redact_arabic(text: Column) -> Column:
    """Each run of Arabic script as one placeholder."""
    return F.regexp_replace(text, f"{ARABIC_SCRIPT}+", REDACTED)


def word_count(text: Column) -> Column:
    """Words between white space; 0 for a blank text."""
    plain = squeeze(text)
    return F.when(plain == "", 0).otherwise(F.size(F.split(plain, " ")))


def ascii_digits(text: Column) -> Column:
    return F.translate(text, *DIGITS)


def citation_number(digits: Column, largest: Column) -> Column:
    """The number a run of digits of any script names, from 1 to `largest`; else null. The run counts as a whole."""
    plain = F.ltrim(ascii_digits(digits), F.lit("0"))
    number = F.expr("try_cast(null as int)")
    number = F.when(F.length(plain).between(1, 9), plain.try_cast("int"))
    return F.when(number.between(1, 999_999_999) & (number <= largest), number)


def clean_markup(text: Column) -> Column:
    """Page, milestone, part and quotation marks as spaces; a milestone goes before a part mark."""
    for mark in (PAGE_MARK, MILESTONE, PART_MARK, QUOTE_MARK):
        text = F.regexp_replace(text, mark, " ")
    return squeeze(text)


def full_text(text: Column, addenda: Column) -> Column:
    """The text and, if there are any, its addenda, a space between."""
    return F.when(text.isNotNull(), F.concat_ws(" ", text, addenda))


def join_with_and(items: Column) -> Column:
    """a / a and b / a, b, and c; an empty array gives an empty string."""
    n = F.size(items)
    head = F.array_join(F.slice(items, 1, F.greatest(n - 1, F.lit(1))), ", ")
    last = F.element_at(items, -1)
    return F.when(n == 0, "").when(n == 1, F.element_at(items, 1)).when(n == 2, F.concat_ws(" and ", items)).otherwise(F.concat(head, F.lit(", and "), last))


def display_reference(title: Column, number: Column, occurrence: Column, repeat: Column) -> Column:
    """`Title 12`, `Title 12 (2)` for a later one of that number, `(repeat)` for a marked repetition."""
    return F.concat(title, F.lit(" "), number, F.when(occurrence > 1, F.concat(F.lit(" ("), occurrence.cast("string"), F.lit(")"))).otherwise(""), F.when(repeat, " (repeat)").otherwise(""))
