"""Reader of annotated markdown books: headings, numbered units with chain and text, and rule-driven splitting.

A file is one row and is read by one task; files are read in parallel. Its lines are first told apart by what they are
(`kinds_of`), then put into groups that a line of a heading, a number or a unit begins (`groups_of`), and the groups are
read in order; only a heading whose brackets stay open reaches from one group into the next. Rows: UNIT_SCHEMA.

How a text is divided, what is taken from it and which rulings hold are data of a `Book`.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field, replace
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quotewright.runtime import ship_code

# Fixed values of the format: end of the header, marks within texts, heading words, the mark of a repetition, and what
# begins each kind of line (in the order in which they are tried).
HEADER_END = "#META#Header#End#"
MARKS = [r"PageV\d+P\d+", r"ms\d+", r"\\\s*\d+\s*\\", r"@QB@|@QE@"]
CHAPTER_WORD, BOOK_WORD, REPEAT_MARK = "باب", "كتاب", "م"
LINES = [
    ("more", r"~~(.*)"), ("number", r"###\s*\|\|\|+\s*(\d+)(?:\s+ms\d+)?\s*"), ("book", r"###\s*\|(?!\|)\s*(.*)"), ("chapter", r"###\s*\|\|(?!\|)\s*(.*)"),
    ("break", r"###(.*)"), ("noted", r"#\s*\|\s*1\s*(.*)"), ("unit", r"#\s(.*\S.*)"), ("empty", r"\s*#\s*()"), ("plain", r"(.*)"),
]
UNIT_SCHEMA = "file string, hadith_no string, record_id string, is_repeat boolean, book_no int, book_ar string, chapter_ar string, isnad_ar string, matn_ar string, addenda_ar string, unscorable_reason string, stray_signs string"
_NUMBERED = re.compile(rf"(\d+)\s+({REPEAT_MARK}\s+)?(.*)", re.DOTALL)
_LINES = [(kind, re.compile(pattern, re.DOTALL)) for kind, pattern in LINES]


class FormatError(ValueError):
    """Not a file of this format."""


class StalePin(ValueError):
    """A record's text isn't the one its ruling was made for."""


@dataclass(frozen=True)
class Chain:
    """When the words after a cut's match open a chain of names, and where the words before it attribute it.

    Of the first `most` + 1 words after the match the first that is a link or no part of a name decides; `first_no_link`
    doesn't link where it comes first. An `attribution` at most `most` names before the match, and no more than `window`
    signs, is where the cut is made; without a chain there must be one."""

    links: frozenset[str]
    no_names: frozenset[str]
    attribution: str
    first_no_link: str | None = None
    most: int = 3
    window: int = 25

    def opens(self, after: list[str]) -> bool:
        for i, word in enumerate(after[: self.most + 1]):
            if word in self.links:
                return i > 0 or word != self.first_no_link
            if word in self.no_names:
                return False
        return False

    def attributed(self, text: str, at: int) -> int | None:
        words = [(m[0], m.start()) for m in re.finditer(r"\S+", text[:at])]
        for names in range(self.most + 1):
            if names >= len(words):
                return None
            word, start = words[-1 - names]
            if re.fullmatch(self.attribution, word):
                return start if at - start <= self.window else None
            if word in self.no_names or len(word) == 1:
                return None
        return None


@dataclass(frozen=True)
class Cut:
    """Where a text's addenda begin: at the first match of `pattern` with at least `head` words before it and no more than
    `most` signs after it, unless the word before is one of `governing`, the text after the match begins with
    `addressee`, or a `chain` is asked for and there is none. An `only_as_fallback` rule is tried after the others
    found nothing."""

    pattern: str
    head: int = 2
    most: int = 1000
    governing: tuple[str, ...] = ()
    addressee: str | None = None
    only_as_fallback: bool = False
    chain: Chain | None = None

    def place(self, text: str) -> int | None:
        for m in re.finditer(self.pattern, text):
            at = m.start()
            if self.chain:
                led = self.chain.attributed(text, at)
                if led is None and not self.chain.opens(text[m.end() :].split()):
                    continue
                at = at if led is None else led
            before = text[:at].split()
            addressed = self.addressee and re.match(rf"\s*(?:{self.addressee})", text[m.end() :])
            if len(before) >= self.head and before[-1] not in self.governing and not addressed and len(text) - at <= self.most:
                return at
        return None


@dataclass(frozen=True)
class Strip:
    """What is taken out of a text after it is divided, unless nothing would be left."""

    pattern: str

    def of(self, text: str) -> str:
        return " ".join(re.sub(self.pattern, " ", text).split()) or text


@dataclass(frozen=True)
class Pin:
    """A ruling on one record, valid for the text it was made for: `never_cut`, `cut_at` a position, or `unscorable`."""

    sha256: str
    action: str
    argument: str = ""


@dataclass(frozen=True)
class Book:
    """How a collection is read: its name; its cuts in steps, of which each divides what the one before left; what is taken
    out of the whole file (pattern, replacement) and of divided texts; and rulings by record id."""

    collection: str
    cuts: tuple[Cut, ...] = ()
    pins: dict[str, Pin] = field(default_factory=dict)
    further: tuple[tuple[Cut, ...], ...] = ()
    removed: tuple[tuple[str, str], ...] = ()
    strips: tuple[Strip, ...] = ()


def case_forms(name: str, first: tuple[str, ...] = ("أبو", "أبا", "أبي")) -> str:
    """A pattern of a name in all forms of its first word, where that is one of `first`."""
    head, _, rest = name.partition(" ")
    return rf"(?:{'|'.join(first)}) {re.escape(rest)}" if head in first and rest else re.escape(name)


def clean(text: str) -> str:
    """Marks as spaces, white space squeezed. Milestones go before part marks, which would else hide their digits."""
    for mark in MARKS:
        text = re.sub(mark, " ", text)
    return " ".join(text.split())


def heading(text: str) -> str | None:
    """A heading without marks, brackets and its number; None if nothing is left."""
    plain = clean(text).strip("()[] ")
    return re.sub(r"^\d+\s+", "", plain).strip() or None


def split(text: str, book: Book, record_id: str) -> tuple[str, str | None, str | None]:
    """(text, addenda, reason for which it isn't scored). A ruling for another text raises StalePin."""
    pin = book.pins.get(record_id)
    if pin:
        if hashlib.sha256(text.encode()).hexdigest() != pin.sha256:
            raise StalePin(f"{record_id}: the text changed since its ruling")
        at = int(pin.argument) if pin.action == "cut_at" else len(text)
        return text[:at].rstrip(), text[at:].lstrip() or None, pin.argument if pin.action == "unscorable" else None
    addenda: list[str] = []
    for step in (book.cuts, *book.further):
        for fallback in (False, True):
            places = [p for p in (c.place(text) for c in step if c.only_as_fallback == fallback) if p is not None]
            if places:
                addenda.insert(0, text[min(places) :])
                text = text[: min(places)].rstrip()
                break
    for strip in book.strips:
        text = strip.of(text)
    return text, " ".join(addenda) or None, None


class Line(NamedTuple):
    kind: str
    text: str


def kinds_of(body: str) -> Iterator[Line]:
    """Each line with its kind; a noted line is a heading if it begins with a heading's word."""
    for raw in body.splitlines():
        kind, text = next((k, m[1]) for k, p in _LINES if (m := p.fullmatch(raw)))
        if kind == "noted":
            word = re.sub(r"^\d+\s+", "", clean(text).lstrip("( "))
            kind = "noted book" if word.startswith(BOOK_WORD) else "chapter" if word.startswith(CHAPTER_WORD) else kind
        yield Line(kind, text)


def groups_of(lines: Iterator[Line]) -> list[tuple[Line, list[Line]]]:
    """Lines that begin something, each with the lines that go on with it."""
    out: list[tuple[Line, list[Line]]] = []
    for line in lines:
        if line.kind in ("more", "plain", "noted"):
            if out:
                out[-1][1].append(line)
        elif line.kind != "empty":
            out.append((line, []))
    return out


@dataclass(frozen=True)
class Place:
    """Where a unit stands: the book and chapter above it, and the parts of a heading whose brackets aren't closed."""

    book_no: int = 0
    book: str | None = ""
    chapter: str | None = None
    kind: str = ""
    parts: tuple[str, ...] = ()

    def under(self, kind: str, parts: tuple[str, ...], new: bool = True, lasting: bool = True) -> Place:
        text = " ".join(parts)
        opened = lasting and text.count("(") > text.count(")")
        state = {"kind": kind, "parts": parts if opened else ()}
        if kind == "book":
            return replace(self, book_no=self.book_no + new, book=heading(text), chapter=None if new else self.chapter, **state)
        return replace(self, chapter=heading(text), **state)

    def closed(self) -> Place:
        return replace(self, parts=())


def _unit(text: str, place: Place, book: Book, seen: dict[str, int]) -> tuple[tuple | None, Place]:
    """(row or None, place after) of a unit's whole text: a narration, or a heading that is numbered like one."""
    m = _NUMBERED.match(text)
    if not m:
        return None, place
    number, repeated, rest = m[1], bool(m[2]), m[3]
    plain = clean(rest)
    if plain.startswith(BOOK_WORD):
        return None, replace(place, book_no=place.book_no + 1, book=plain, chapter=None)
    if plain.startswith(CHAPTER_WORD):
        return None, place
    chain, star, body = rest.partition("*")
    isnad, matn = (clean(chain), clean(body)) if star else (None, plain)
    if not matn:
        isnad, matn = None, clean(rest.replace("*", " "))
    seen[number] = seen.get(number, 0) + 1
    record = f"hadith:{book.collection}:{number}" + (f"-{seen[number]}" if seen[number] > 1 else "")
    matn, addenda, reason = split(matn, book, record) if isnad is not None or record in book.pins else (matn, None, None)
    stray = "".join(sorted({c for c in matn if not ("؀" <= c <= "ۿ" or c.isspace())}))
    return (number, record, repeated, place.book_no, place.book, place.chapter, isnad, matn, addenda, reason, stray or None), place


def units(raw: str, book: Book) -> list[tuple]:
    """The units of a file, in order. FormatError without the end of a header."""
    _, mark, body = raw.partition(HEADER_END)
    if not mark:
        raise FormatError(f"no {HEADER_END}")
    for pattern, by in book.removed:
        body = re.sub(pattern, by, body)
    place, pending, text, seen, rows = Place(), None, None, {}, []

    def complete() -> None:
        nonlocal place, text
        if text is not None:
            row, place = _unit(text, place, book, seen)
            rows.extend([row] if row else [])
            text = None

    for line, more in groups_of(kinds_of(body)):
        if line.kind != "unit":
            complete()
            place = place.closed()
            if line.kind == "number":
                pending = line.text
            elif line.kind != "break":
                place = place.under(line.kind.removeprefix("noted "), (line.text,), lasting=line.kind != "book")
            for kind, part in more:
                if kind == "more" and place.parts:
                    place = place.under(place.kind, (*place.parts, part), new=False)
            continue
        pieces = [p.text.strip().removeprefix("(").removesuffix(")") if p.kind == "noted" else p.text for p in more if p.kind != "noted" or not place.parts]
        if text is not None and _NUMBERED.match(text) and not _NUMBERED.match(line.text) and not place.parts:
            text = " ".join([text, line.text, *pieces])
            continue
        complete()
        whole = " ".join([*([pending] if pending else []), line.text, *pieces])
        pending = None
        if place.parts and not _NUMBERED.match(whole):
            place = place.under(place.kind, (*place.parts, whole), new=False)
        else:
            place, text = place.closed(), whole
    complete()
    return rows


def read(spark: SparkSession, path: str, book: Book) -> DataFrame:
    """The units of all files under a path."""
    ship_code(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = {"string": pa.string(), "boolean": pa.bool_(), "int": pa.int32()}
        named = [x.split() for x in UNIT_SCHEMA.split(", ")]
        for b in batches:
            rows = [(f, *u) for f, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for u in units(raw, book)]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds[k]) for i, (_, k) in enumerate(named)], names=[n for n, _ in named])

    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")
    return whole.mapInArrow(run, UNIT_SCHEMA)


def as_records(read_units: DataFrame, source_id: str, collection: str, title: str, scheme: str) -> DataFrame:
    """Units as source rows of the corpus, each with a citation that no other shows."""
    from quotewright.functions.text import display_reference

    nth = F.coalesce(F.regexp_extract("record_id", "-(\\d+)$", 1).try_cast("int"), F.lit(1))
    shown = display_reference(F.lit(title), F.col("hadith_no"), F.when(F.col("is_repeat"), 1).otherwise(nth), F.col("is_repeat"))
    return read_units.select(F.col("record_id").alias("id"), F.lit(source_id).alias("source_id"), F.lit("hadith").alias("kind"), F.lit(collection).alias("collection"), "book_no", "chapter_ar", "hadith_no", F.lit(scheme).alias("numbering_scheme"), F.col("matn_ar").alias("text_ar"), "isnad_ar", "addenda_ar", "unscorable_reason", shown.alias("reference_display"))
