"""Token ids of texts by a public byte-level BPE vocabulary.

Pre-tokenisation uses no regular expression: code points become symbols, every symbol is a transition function on
nine states, and composing the functions, which is associative, gives the state before each code point for blocks of
text at once. State, symbol and next symbol say where a token begins. The resulting slices of the UTF-8 bytes are
made distinct, and only words not seen before go through pair merging, many words at a time.

A null and an empty text give an empty list. Texts are taken as they are, whatever their length and characters; the
strings of special tokens are ordinary text. Decoding the ids gives the bytes back.
"""

from __future__ import annotations

import base64
import heapq
import sys
import unicodedata
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quotewright.llm.arrays import code_points, ranges, utf8
from quotewright.runtime import ship_code

#: Bytes of text handled at once by a task, and words remembered by it.
CHUNK_BYTES, REMEMBERED = 2 << 20, 400_000

# Symbols of code points. QUOTE1 and QUOTE2 are an apostrophe with a contraction of one or two letters after it.
LETTER, NUMBER, SPACE, BLANK, OTHER, QUOTE1, QUOTE2 = range(7)
FIRST = 7  # added to the symbol of the first code point of a text
# White space other than U+0020, and the contractions.
BLANKS = [*range(0x09, 0x0E), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
CONTRACTIONS = ["'s", "'t", "'re", "'ve", "'m", "'ll", "'d"]

# States: the kind of what was read last; two and one letters of a contraction to come; a contraction just ended.
BEGIN, IN_LETTERS, IN_NUMBERS, IN_OTHERS, AFTER_SPACE, AFTER_BLANK, TWO_TO_COME, ONE_TO_COME, CONTRACTED = range(9)
STATES, LANE = 9, 256


def _transitions() -> tuple[np.ndarray, np.ndarray]:
    """next state, and 'a token begins here', by symbol (14, with FIRST) and state; blanks are decided later."""
    after = {LETTER: IN_LETTERS, NUMBER: IN_NUMBERS, SPACE: AFTER_SPACE, BLANK: AFTER_BLANK, OTHER: IN_OTHERS}
    step, begins = np.zeros((14, STATES), np.uint8), np.zeros((14, STATES), bool)
    for s in range(7):
        for state in range(STATES):
            if s == LETTER and state == TWO_TO_COME:
                step[s, state], begins[s, state] = ONE_TO_COME, False
            elif s == LETTER and state == ONE_TO_COME:
                step[s, state], begins[s, state] = CONTRACTED, False
            elif s in (QUOTE1, QUOTE2):
                open_ = state not in (IN_OTHERS, AFTER_SPACE)  # else the apostrophe belongs to a run of signs
                step[s, state] = (ONE_TO_COME if s == QUOTE1 else TWO_TO_COME) if open_ else IN_OTHERS
                begins[s, state] = open_
            else:
                step[s, state] = after[s]
                begins[s, state] = state != AFTER_SPACE and state != after[s]
        step[s + FIRST], begins[s + FIRST] = step[s, BEGIN], True
    return step, begins


STEP, BEGINS = _transitions()
_KINDS: list[np.ndarray] = []


def kinds() -> np.ndarray:
    """The symbol of every code point, apostrophes as OTHER."""
    if not _KINDS:
        first = {"L": LETTER, "N": NUMBER}
        table = np.array([first.get(unicodedata.category(chr(c))[0], OTHER) for c in range(sys.maxunicode + 1)], np.uint8)
        table[BLANKS], table[0x20] = BLANK, SPACE
        _KINDS.append(table)
    return _KINDS[0]


def states_before(symbols: np.ndarray) -> np.ndarray:
    """The state before each symbol. Lanes of LANE symbols are composed side by side from every state, the lanes'
    functions one after another, and the lanes then run from the state they are entered with."""
    n = len(symbols)
    lanes = -(-n // LANE)
    padded = np.full(lanes * LANE, OTHER, np.uint8)
    padded[:n] = symbols
    columns = np.ascontiguousarray(padded.reshape(lanes, LANE).T)
    flat = STEP.ravel()
    whole = np.broadcast_to(np.arange(STATES, dtype=np.uint8), (lanes, STATES)).copy()
    for c in columns:
        whole = flat[c[:, None] * np.uint8(STATES) + whole]
    entered, state = np.empty(lanes, np.uint8), BEGIN
    for i, f in enumerate(whole.tolist()):
        entered[i] = state
        state = f[state]
    out = np.empty((LANE, lanes), np.uint8)
    for i, c in enumerate(columns):
        out[i] = entered
        entered = flat[c * np.uint8(STATES) + entered]
    return out.T.ravel()[:n]


def token_starts(points: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """For each code point whether a token begins with it. offsets: where the texts begin and end."""
    n = len(points)
    if not n:
        return np.zeros(0, bool)
    symbols = kinds()[points]
    first = np.zeros(n + 1, bool)
    first[offsets[:-1]] = True
    first = first[:n]
    quotes = np.flatnonzero(points == 0x27)
    if len(quotes):
        ends = offsets[np.searchsorted(offsets, quotes, "right")]
        padded = np.concatenate((points, np.zeros(2, points.dtype)))
        one, two = padded[quotes + 1], padded[quotes + 2]
        for c in CONTRACTIONS:
            hit = (one == ord(c[1])) & (quotes + len(c) <= ends) & ((two == ord(c[2])) if len(c) == 3 else True)
            symbols[quotes[hit]] = QUOTE1 if len(c) == 2 else QUOTE2
    symbols[first] += FIRST
    before = states_before(symbols)
    begins = BEGINS[symbols, before]
    plain = symbols % FIRST
    blank = (plain == SPACE) | (plain == BLANK)
    last = np.ones(n, bool)
    last[:-1] = first[1:]
    follows = np.zeros(n, bool)  # a non-blank follows in the same text
    follows[:-1] = ~blank[1:] & ~last[:-1]
    inside = blank & ~first & np.concatenate(([False], blank[:-1]))
    return np.where(inside, follows, np.where(blank, True, begins))


class Vocabulary:
    """Ranks of a byte-level BPE file: lines of a base64 token and its id, where the id is also the rank."""

    def __init__(self, ranks: bytes):
        self.id = {base64.b64decode(a): int(b) for a, b in (line.split() for line in ranks.splitlines() if line)}
        self.size = max(self.id.values()) + 1
        self.token = [b""] * self.size
        for t, i in self.id.items():
            self.token[i] = t
        self.length = np.array([len(t) for t in self.token], np.int64)
        self.byte = np.array([self.id[bytes([b])] for b in range(256)], np.int32)
        pairs = {}
        for t, i in self.id.items():
            for k in range(1, len(t)):
                a, b = self.id.get(t[:k]), self.id.get(t[k:])
                if a is not None and b is not None:
                    pairs[a * self.size + b] = i
        self.pairs = pairs
        self.none = self.size  # the rank of two tokens that don't merge
        self.keys = np.array(sorted(pairs), np.int64)
        self.merged = np.array([pairs[k] for k in self.keys.tolist()], np.int32)

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The id that two neighbours merge into, or `none`; a negative id stands for no neighbour."""
        key = a.astype(np.int64) * self.size + b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[at] == key) & (a >= 0) & (b >= 0), self.merged[at], self.none).astype(np.int32)

    def merge_long(self, word: bytes) -> list[int]:
        """One long word: a heap of neighbouring pairs over a linked list."""
        ids, n = self.byte[np.frombuffer(word, np.uint8)].tolist(), len(word)
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]
        get, size = self.pairs.get, self.size
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := get(ids[i] * size + ids[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i] if ids[i] == a else -1
            if j < 0 or ids[j] != b:
                continue
            ids[i], ids[j], after[i] = r, -1, after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y >= 0 and (k := get(ids[x] * size + ids[y])) is not None:
                    heapq.heappush(heap, (k, x, ids[x], ids[y]))
        return [i for i in ids if i >= 0]

    def merge(self, words: list[bytes]) -> list[np.ndarray]:
        """The ids of each word. Words of like length are merged together, one pair of each word in a round."""
        out: list[np.ndarray] = [np.zeros(0, np.int32)] * len(words)
        lengths = np.array([len(w) for w in words])
        for i in np.flatnonzero(lengths > 192):
            out[i] = np.array(self.merge_long(words[i]), np.int32)
        low = 0
        for high in (1, 4, 8, 12, 16, 24, 32, 64, 192):
            rows = np.flatnonzero((lengths > low) & (lengths <= high))
            low = high
            for part in np.array_split(rows, -(-len(rows) // 20000) or 1):
                if len(part):
                    self._merge_block([words[i] for i in part], lengths[part], part, out)
        return out

    def _merge_block(self, words: list[bytes], lengths: np.ndarray, at: np.ndarray, out: list) -> None:
        width = int(lengths.max())
        ids = np.full((len(words), width + 1), -1, np.int32)
        rows, columns = np.repeat(np.arange(len(words)), lengths), ranges(np.zeros(len(words), np.int64), lengths)
        ids[rows, columns] = self.byte[np.frombuffer(b"".join(words), np.uint8)]
        rank = self.rank(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(len(words), width)
        active, column = np.arange(len(words)), np.arange(width + 1)
        while True:
            best = rank.argmin(1)
            value = rank[np.arange(len(active)), best]
            going = value < self.none
            if not going.all():
                for k in np.flatnonzero(~going):
                    row = ids[k]
                    out[at[active[k]]] = row[row >= 0].copy()
                active, ids, rank, best, value = active[going], ids[going], rank[going], best[going], value[going]
            if not len(active):
                return
            r = np.arange(len(active))
            ids[r, best] = value
            moved = column[None, :-1] > best[:, None]
            ids[:, :-1] = np.where(moved, ids[:, 1:], ids[:, :-1])
            ids[:, -1] = -1
            rank[:, :-1] = np.where(moved[:, :-1], rank[:, 1:], rank[:, :-1])
            rank[:, -1] = self.none
            right = np.minimum(best + 1, width)
            rank[r, best] = self.rank(ids[r, best], ids[r, right])
            left = best > 0
            rank[r[left], best[left] - 1] = self.rank(ids[r[left], best[left] - 1], ids[r[left], best[left]])


class Encoder:
    """Encodes columns of texts and remembers the ids of words."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.forget()

    def forget(self) -> None:
        self.slot: dict[bytes, int] = {}
        self.flat, self.start, self.count = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _slots(self, words: list[bytes]) -> np.ndarray:
        if len(self.slot) + len(words) > REMEMBERED:
            self.forget()
        new = [w for w in words if w not in self.slot]
        if new:
            ids = self.v.merge(new)
            count = np.array([len(x) for x in ids], np.int64)
            self.start = np.concatenate((self.start, len(self.flat) + np.cumsum(count) - count))
            self.count = np.concatenate((self.count, count))
            self.flat = np.concatenate((self.flat, *ids))
            known = len(self.slot)
            self.slot.update((w, known + i) for i, w in enumerate(new))
        return np.fromiter(map(self.slot.__getitem__, words), np.int64, len(words))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids of all texts, offsets of the texts in them, byte at which each token ends in its text)."""
        data, offsets, _ = utf8(texts)
        points, at = code_points(data, offsets)
        begins = token_starts(points, at)
        lead = np.flatnonzero((data & 0xC0) != 0x80)
        cuts = lead[begins]
        words = pa.Array.from_buffers(pa.binary(), len(cuts), [None, pa.py_buffer(np.append(cuts, len(data)).astype(np.int32)), pa.py_buffer(data.tobytes())]).dictionary_encode()
        slots = self._slots(words.dictionary.to_pylist())[words.indices.to_numpy().astype(np.int64)]
        count = self.count[slots]
        ids = self.flat[ranges(self.start[slots], count)]
        so_far = np.concatenate(([0], np.cumsum(count)))
        of_text = so_far[np.concatenate(([0], np.cumsum(begins)))[at]]
        ends = np.cumsum(self.v.length[ids]) - np.repeat(offsets[:-1], np.diff(of_text))
        return ids, of_text, ends


def chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[pa.Array]:
    """Slices of a column of about `limit` bytes, a longer text alone."""
    _, offsets, _ = utf8(column)
    start = 0
    while start < len(column):
        end = max(start + 1, int(np.searchsorted(offsets, offsets[start] + limit, "right")) - 1)
        yield column.slice(start, end - start)
        start = end


def _encode(ranks, with_ends: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(Vocabulary(ranks.value))
        for b in batches:
            done = 0
            for part in chunks(b.column(1)):
                ids, at, ends = encoder.encode(part)
                lists = [pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(x, pa.int32())) for x in ([ids, ends] if with_ends else [ids])]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(done, len(part)), *lists], names=["doc_id", "ids", "byte_ends"][: 1 + len(lists)])
                done += len(part)

    return run


def encode(df: DataFrame, id_col: str, text_col: str, ranks_file: str, with_ends: bool = False) -> DataFrame:
    """doc_id, ids, a row per row of df; with_ends adds byte_ends, where each token ends in the text's UTF-8 bytes.

    The driver reads the vocabulary (`ranks_file`, under 1 MB) and broadcasts it; executors need no file.
    """
    spark = df.sparkSession
    ship_code(spark)
    ranks = spark.sparkContext.broadcast(Path(ranks_file).read_bytes())
    rows = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    schema = rows.select("doc_id").schema
    for name in ["ids", "byte_ends"][: 1 + with_ends]:
        schema = schema.add(name, T.ArrayType(T.IntegerType()))
    return rows.mapInArrow(_encode(ranks, with_ends), schema)


def decode(ids: list[int], vocabulary: Vocabulary) -> bytes:
    """The bytes of a list of ids."""
    return b"".join(vocabulary.token[i] for i in ids)
