"""Quotation spans and citations of texts, and the citation nearest to each span, in one pass over a text.

A text is cut into tokens once: words, numbers, blanks and signs, with their offsets. Citations are shapes over tokens:
a collection's name is walked down a tree of the words of all names, and what may follow it is read token by token.

Offsets are code points, half open. A null or empty text has no spans; rows without an id are left out. What depends on the order of
matches within one text stays in plain Python per text; texts are independent, so the pass needs no shuffle.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quotewright.functions.spec import normalize
from quotewright.functions.text import ARTICLES
from quotewright.runtime import ship_code

# Signs that open and close a quotation, signs of a bare run of Arabic and its least length, the least letters
# of either kind of span, and the farthest a citation may stand from its quotation.
OPENERS, CLOSERS = "«“\"『【﴿", "»”\"』】﴾"
ARABIC, SHORTEST_RUN = "\u0600-\u06ff", 7
FLOORS = {"wrapped": 2, "arabic-run": 6}
WINDOW = 180
# Fixed values of citations: the longest distance of a qualifier and of a name from another citation, the least letters of a
# name without article, the longest number of a verse, words that qualify a chapter's name, words before a number, a book
# before the number, and words before an Arabic name.
NEARBY, LEAST_BARE, VERSE_DIGITS = 24, 5, 3
QUALIFIERS = ("surahs", "surah", "suras", "sura", "surat", "sūrah", "chapters", "chapter", "qur'an", "qur’an", "quran", "q")
NUMBER_WORDS, BOOK_WORDS = {"hadith", "hadeeth", "no", "number", "حديث", "رقم"}, {"book", "kitab"}
ARABIC_LEADS = {"صحيح", "رواه"}
COLONS = ":："


class Token(NamedTuple):
    """kind: `word`, `number`, `blank` or `sign`; a word is letters and marks that join them."""

    kind: str
    text: str
    start: int
    end: int


_TOKENS = re.compile(r"(?P<number>\d+)|(?P<word>[^\W\d]+)|(?P<blank>\s+)|(?P<sign>.)", re.DOTALL)


_DIGIT, _LATIN = re.compile(r"\d"), re.compile("[a-z]+")


def tokens_of(text: str) -> list[Token]:
    return [Token(m.lastgroup, m[0], m.start(), m.end()) for m in _TOKENS.finditer(text)]


@dataclass(frozen=True)
class Span:
    text: str
    start: int
    end: int
    kind: str


def letters(text: str) -> int:
    """Letters left of a text at the aggressive tier."""
    return len(normalize(text, "aggressive").replace(" ", ""))


_SIGNS = re.compile(f"[{re.escape(OPENERS + CLOSERS)}]")


def _wrapped(text: str) -> Iterator[tuple[int, int]]:
    """What stands between a sign that opens and the next that closes; one that opens while another is open is text."""
    opened = None
    for m in _SIGNS.finditer(text):
        i, sign = m.start(), m[0]
        if opened is not None and sign in CLOSERS and i > opened:
            yield opened, i
            opened = None
        elif opened is None or sign in CLOSERS:
            opened = i + 1 if sign in OPENERS else None


_RUNS = re.compile(rf"[{ARABIC}][{ARABIC}\s]*")


def _bare(text: str) -> Iterator[tuple[int, int]]:
    for m in _RUNS.finditer(text):
        if len(m[0]) >= SHORTEST_RUN:
            yield m.span()


def spans(text: str) -> list[Span]:
    """Wrapped quotations and bare Arabic runs long enough to be one; of overlapping spans the first, wrapped before bare."""
    offered = []
    for rank, (kind, places) in enumerate({"wrapped": _wrapped(text), "arabic-run": _bare(text)}.items()):
        for a, b in places:
            inner = text[a:b].strip()
            if letters(inner) >= FLOORS[kind]:
                start = text.index(inner, a)
                offered.append((start, rank, Span(inner, start, start + len(inner), kind)))
    out: list[Span] = []
    for _, _, s in sorted(offered, key=lambda o: o[:2]):
        if not out or s.start >= out[-1].end:
            out.append(s)
    return out


def slug(name: str) -> str:
    """The letters a to z of a name, accents taken off."""
    return "".join(c for c in unicodedata.normalize("NFKD", name).lower() if "a" <= c <= "z")


def spellings(name: str) -> list[str]:
    """A name with and without its article and its final h, the name itself first."""
    base = slug(name)
    stems = [base, *[base[len(a) :] for a in ARTICLES if base.startswith(a) and len(base) - len(a) >= 3]]
    return list(dict.fromkeys(v for s in stems for v in ([s, s[:-1]] if s.endswith("h") else [s])))


@dataclass(frozen=True)
class Citation:
    """family `verse` or `collection`; resolved is False for what reads as a citation and names nothing."""

    family: str
    surah: int | None
    ayah: int | None
    collection: str | None
    number: str | None
    raw: str
    start: int
    end: int
    resolved: bool


class _Reader:
    """A place among the tokens of a text, and what may be read from there."""

    def __init__(self, tokens: list[Token], at: int):
        self.tokens, self.at = tokens, at

    def peek(self, skip_blanks: bool = True) -> Token | None:
        k = self.at
        while skip_blanks and k < len(self.tokens) and self.tokens[k].kind == "blank":
            k += 1
        return self.tokens[k] if k < len(self.tokens) else None

    def take(self, *kinds: str, of=None) -> Token | None:
        """The next token after blanks, if it is of the kinds and, where `of` is given, satisfies it; else nothing moves."""
        k = self.at
        while k < len(self.tokens) and self.tokens[k].kind == "blank":
            k += 1
        if k < len(self.tokens) and self.tokens[k].kind in kinds and (of is None or of(self.tokens[k].text.lower())):
            self.at = k + 1
            return self.tokens[k]
        return None


def _touches(tokens: list[Token], k: int, step: int) -> bool:
    """Whether a word or number stands directly beside token k."""
    return 0 <= k + step < len(tokens) and tokens[k + step].kind in ("word", "number")


@dataclass(frozen=True)
class Grammar:
    """What citations may name, as data: Latin and Arabic names of collections, the largest number of each, chapters by
    name, and the verses of each chapter."""

    collections: dict[str, str]
    largest: dict[str, int]
    lengths: dict[int, int]
    chapters: dict[str, int] = field(default_factory=dict)
    arabic: dict[str, str] = field(default_factory=dict)

    @cached_property
    def tree(self) -> dict:
        """Names as paths of words; at the end of a path, under None, the collection. A Latin name may also be written as
        one word."""
        root: dict = {}
        for names, latin in ((self.collections, True), (self.arabic, False)):
            for name, collection in names.items():
                words = [t.text.lower() if latin else t.text for t in tokens_of(name) if t.kind in ("word", "number")]
                for path in [words, ["".join(words)]] if latin else [words]:
                    node = root
                    for w in path:
                        node = node.setdefault(w, {})
                    node.setdefault(None, collection)
        return root

    @cached_property
    def chapter_by_slug(self) -> dict[str, int]:
        out: dict[str, int] = {}
        for name, number in self.chapters.items():
            for s in spellings(name):
                out.setdefault(s, number)
        return out

    @cached_property
    def chapter_words(self) -> set[str]:
        """Words of which one stands wherever a chapter is named: its spellings, with and without what reads as an article."""
        return {w for s in self.chapter_by_slug for w in (s, *[s[len(a) :] for a in ARTICLES if s.startswith(a)])}

    def number(self, digits: str, collection: str) -> str | None:
        """The whole run as a number from 1 to the collection's largest."""
        plain = "".join(str(unicodedata.digit(d)) for d in digits).lstrip("0")
        largest = self.largest.get(collection, 0)
        return plain if plain and len(plain) <= len(str(largest)) and int(plain) <= largest else None

    def _names(self, tokens: list[Token], k: int) -> list[tuple[str, int]]:
        """(collection, token after the name) of the names that begin at token k, the longest first. Words of a name stand
        apart by one hyphen or by blanks."""
        if _touches(tokens, k, -1):
            return []
        found, node = [], self.tree
        while k < len(tokens) and tokens[k].kind in ("word", "number"):
            node = node.get(tokens[k].text.lower())
            if node is None:
                break
            if None in node and not _touches(tokens, k, 1):
                found.append((node[None], k + 1))
            k += 1
            if k < len(tokens) and (tokens[k].kind == "blank" or tokens[k].text == "-"):
                k += 1
        return found[::-1]

    def _collection(self, tokens: list[Token], k: int) -> tuple[str, Token, bool, int] | None:
        """(collection, number, whether a book or a second number makes it name nothing, token after) of a citation at k."""
        for collection, after in self._names(tokens, k):
            r = _Reader(tokens, after)
            r.take("sign", of=lambda t: t == ",")
            back = r.at
            book = r.take("word", of=BOOK_WORDS.__contains__) and r.take("number")
            if book:
                r.take("sign", of=lambda t: t == ",")
            else:
                r.at = back
            word = r.take("word", of=NUMBER_WORDS.__contains__)
            if word is None:
                r.take("sign", of=lambda t: t == "#")
            elif word.text.lower() == "no":
                r.take("sign", of=lambda t: t == ".")
            number = r.take("number")
            if number is None:
                continue
            back = r.at
            second = r.take("sign", of=COLONS.__contains__) and r.take("number")
            if not second:
                r.at = back
            return collection, number, bool(book or second), r.at
        return None

    def _verse(self, tokens: list[Token], k: int) -> tuple[int, int, int] | None:
        """(chapter, verse, token after) of two short numbers with a colon between that begin at k."""
        if len(tokens[k].text) > VERSE_DIGITS or _touches(tokens, k, -1):
            return None
        r = _Reader(tokens, k + 1)
        second = r.take("sign", of=COLONS.__contains__) and r.take("number", of=lambda t: len(t) <= VERSE_DIGITS)
        return (int(tokens[k].text), int(second.text), r.at) if second and not _touches(tokens, r.at - 1, 1) else None

    def _chapter(self, tokens: list[Token], k: int) -> tuple[str, int]:
        """(what may be a chapter's name, token after): a Latin word, or an article and the word that follows it at once or
        after one sign."""
        plain = lambda i: i < len(tokens) and tokens[i].kind == "word" and tokens[i].text.isascii() and tokens[i].text.isalpha() and len(tokens[i].text) >= 3 and not _touches(tokens, i, 1)
        joint = k + 1 < len(tokens) and (tokens[k + 1].text == "-" or (tokens[k + 1].kind == "blank" and len(tokens[k + 1].text) == 1))
        if tokens[k].text.lower() in ARTICLES and joint and plain(k + 2):
            return "".join(t.text for t in tokens[k : k + 3]), k + 3
        return (tokens[k].text, k + 1) if plain(k) else ("", k + 1)

    def citations(self, text: str) -> list[Citation]:
        """All that reads as a citation, in order. Collections claim their text first: what stands there is no verse, and a
        number within a book or a second number is recognised and names nothing. A chapter's name counts with an article
        or a qualifier before it, and not near a claimed citation."""
        numbers, chapters = bool(_DIGIT.search(text)), not self.chapter_words.isdisjoint(_LATIN.findall(text.lower()))
        if not numbers and not chapters:
            return []
        tokens = tokens_of(text)
        out: list[Citation] = []

        def add(family: str, first: int, after: int, resolved: bool = True, **address) -> None:
            place = {"surah": None, "ayah": None, "collection": None, "number": None} | address
            start, end = tokens[first].start, tokens[after - 1].end
            out.append(Citation(family, **place, raw=text[start:end], start=start, end=end, resolved=resolved))

        k = 0 if numbers else len(tokens)
        while k < len(tokens):
            read = self._collection(tokens, k) if tokens[k].text.lower() in self.tree else None
            if read:
                collection, digits, nothing, after = read
                number = None if nothing else self.number(digits.text, collection)
                led = k >= 2 and tokens[k - 1].kind == "blank" and tokens[k - 2].text in ARABIC_LEADS and not tokens[k].text.isascii()
                add("collection", k - 2 if led else k, after, number is not None, collection=collection, number=number)
                k = after
            else:
                k += 1
        taken = [(c.start, c.end) for c in out]
        k = 0 if numbers else len(tokens)
        while k < len(tokens):
            read = self._verse(tokens, k) if tokens[k].kind == "number" else None
            k_after = read[2] if read else k + 1
            if read and 1 <= read[1] <= self.lengths.get(read[0], 0) and not any(tokens[k].start < b and a < tokens[k_after - 1].end for a, b in taken):
                add("verse", k, k_after, surah=read[0], ayah=read[1])
            k = k_after
        claimed = [c.start for c in out]
        k = 0 if chapters else len(tokens)
        while k < len(tokens):
            low = tokens[k].text.lower() if tokens[k].kind == "word" else ""
            if (low not in self.chapter_by_slug and low not in ARTICLES) or _touches(tokens, k, -1):
                k += 1
                continue
            name, after = self._chapter(tokens, k)
            known, start = slug(name), tokens[k].start
            number = self.chapter_by_slug.get(known)
            marked = any(known.startswith(a) and len(known) > len(a) for a in ARTICLES)
            if number is not None and (marked or (len(known) >= LEAST_BARE and qualified(text, start))) and all(abs(start - c) >= NEARBY for c in claimed):
                add("verse", k, after, surah=number)
            k = after
        return sorted(out, key=lambda c: (c.start, c.end))


def qualified(text: str, start: int) -> bool:
    """Whether a word that announces a chapter stands right before `start`."""
    before = text[max(0, start - NEARBY) : start].rstrip().lower()
    return any(before.endswith(q) and not (before[: -len(q)][-1:].isalnum() or before[: -len(q)].endswith("_")) for q in QUALIFIERS)


def only_citation(span: Span, found: list[Citation]) -> bool:
    """Whether too few letters of a span lie outside citations for it to be one without them."""
    inside = [c for c in found if c.start < span.end and span.start < c.end]
    if not inside:
        return False
    rest = "".join(ch for i, ch in enumerate(span.text, span.start) if not any(c.start <= i < c.end for c in inside))
    return letters(rest) < FLOORS[span.kind]


def nearest(found: list[Citation], span: Span) -> Citation | None:
    """The resolved citation whose start is nearest to either end of a span, within WINDOW; the start's on a tie, and of
    two equally near the earlier."""
    near = [(abs(c.start - edge), side, n) for side, edge in enumerate((span.start, span.end)) for n, c in enumerate(found) if c.resolved and abs(c.start - edge) <= WINDOW]
    return found[min(near)[2]] if near else None


QUOTATIONS = "doc_id {id}, span_no int, quoted string, span_start int, span_end int, span_kind string, cited_family string, cited_surah int, cited_ayah int, cited_collection string, cited_number string, cited_raw string"
CITATIONS = "doc_id {id}, citation_no int, family string, surah int, ayah int, collection string, number string, raw string, citation_start int, citation_end int, resolved boolean"


def _texts(df: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, str]:
    ship_code(df.sparkSession)
    rows = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).where(F.col("text").isNotNull() & F.col("doc_id").isNotNull())
    return rows, rows.schema["doc_id"].dataType.simpleString()


def _table(rows: list[tuple], like: pa.DataType, schema: str) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "string": pa.string(), "boolean": pa.bool_()}
    named = [x.split() for x in schema.format(id="int").split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], like if i == 0 else kinds[kind]) for i, (_, kind) in enumerate(named)], names=[n for n, _ in named])


def quotations(df: DataFrame, id_col: str, text_col: str, grammar: Grammar) -> DataFrame:
    """A row per quotation span with the citation nearest to it; spans that are only a citation are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for key, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                got = spans(text)
                cited = grammar.citations(text) if got else []
                kept = [s for s in got if not only_citation(s, cited)]
                for n, s in enumerate(kept):
                    c = nearest(cited, s)
                    rows.append((key, n, s.text, s.start, s.end, s.kind, *((c.family, c.surah, c.ayah, c.collection, c.number, c.raw) if c else [None] * 6)))
            yield _table(rows, b.column(0).type, QUOTATIONS)

    rows, kind = _texts(df, id_col, text_col)
    return rows.mapInArrow(run, QUOTATIONS.format(id=kind))


def citations(df: DataFrame, id_col: str, text_col: str, grammar: Grammar) -> DataFrame:
    """A row per citation of a text, resolved or not."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [
                (key, n, c.family, c.surah, c.ayah, c.collection, c.number, c.raw, c.start, c.end, c.resolved)
                for key, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist())
                for n, c in enumerate(grammar.citations(text))
            ]
            yield _table(rows, b.column(0).type, CITATIONS)

    rows, kind = _texts(df, id_col, text_col)
    return rows.mapInArrow(run, CITATIONS.format(id=kind))


def grammar_of(records: DataFrame) -> Grammar:
    """The grammar that a corpus implies: its collections, as the ids of its records name them (`hadith:{collection}:{number}`,
    whatever their column was typed as), under their names and with the article, the largest number of each, its chapters'
    names and lengths. The driver holds a row per collection and chapter."""
    number = F.when(F.col("hadith_no").rlike("^[0-9]{1,9}$"), F.col("hadith_no").cast("int"))
    name = F.regexp_extract("id", "^hadith:([^:]+):", 1)
    held = records.groupBy(name.alias("collection")).agg(F.max(number).alias("largest")).where("collection <> '' and largest is not null").orderBy("collection").collect()
    chapters = records.where(F.col("surah").isNotNull() & F.col("ayah").isNotNull()).groupBy("surah").agg(F.max("ayah").alias("n"), F.min("surah_name_en").alias("name")).orderBy("surah").collect()
    names: dict[str, int] = {}
    for r in chapters:
        if r["name"]:
            names.setdefault(r["name"], r.surah)
    known = {f"al-{r.collection}": r.collection for r in held} | {r.collection: r.collection for r in held}  # a name beats an alias
    return Grammar(known, {r.collection: r.largest for r in held}, {r.surah: r.n for r in chapters}, names)
