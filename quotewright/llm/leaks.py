"""Evaluation texts that stand, whole or in part, in corpus documents: greedy string tiling.

The words of both sides are brought to one form. Runs of `run` words that a document shares with an item are the
seeds, found by running Karp-Rabin hashes and compared word for word; they extend to maximal matches, of which the
longest that is still free is marked again and again. A pair whose tiles cover the required share of the item is
accepted as it stands, whatever the order of its passages. Tiles must not overlap, while the share may be reached by
runs that do; for the pairs that tiles leave undecided, and only for them, the item's words in any shared run are
counted.

Letter case, punctuation, spacing, vowel signs, alef forms, kashida and typographic letter forms do not matter. Null
ids and texts take no part; an item of fewer than `run` words leaks nowhere; repeated rows give a pair once.
"""

from __future__ import annotations

import heapq
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quotewright.functions.spec import ALEFS, KASHIDA
from quotewright.llm.arrays import code_points, mix, ranges, slice_hashes, utf8
from quotewright.llm.tokenize import chunks
from quotewright.llm.words import windows, words_of_points
from quotewright.operators.bloom import filter_words, may_hold
from quotewright.operators.skew import spread_join
from quotewright.runtime import ship_code, written

#: Code points of item text whose index is broadcast; more items are joined on their seeds instead.
BLOCK_CHARS = 4_000_000
#: Seeds of a document and an item, for each word that they could share, beyond which tiles are found without a list of seeds.
DENSE = 8
_UNKNOWN = np.uint32(0xFFFFFFFF)
# Letters written in another way.
VARIANTS = ALEFS[0] + "کیھہە", ALEFS[1] + "كيههه"
_FOUND = "item_id long, doc_id long, item_words long, tiles long, tiled_words long, covered_words long"


class Folder:
    """Code points to one form: 0 is dropped, a space ends a word. The table fills as code points are met."""

    def __init__(self):
        self.table = np.full(0x110000, _UNKNOWN, np.uint32)

    @staticmethod
    def image(c: str) -> int:
        c = c.lower()[0]
        if c in VARIANTS[0]:
            c = VARIANTS[1][VARIANTS[0].index(c)]
        kind = unicodedata.category(c)
        if c == KASHIDA or kind in ("Mn", "Me", "Cf"):
            return 0
        return ord(c) if kind[0] in "LN" or kind == "Mc" else 0x20

    def words(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(hash of each word, offsets of the texts)."""
        plain = [t if t is None or t.isascii() else unicodedata.normalize("NFKC", t) for t in texts.to_pylist()]
        data, offsets, _ = utf8(pa.array(plain, pa.large_string()))
        points, at = code_points(data, offsets)
        folded = self.table[points]
        new = folded == _UNKNOWN
        if new.any():
            for p in np.unique(points[new]).tolist():
                self.table[p] = self.image(chr(p))
            folded = self.table[points]
        kept = folded != 0
        before = np.concatenate(([0], np.cumsum(kept)))
        return words_of_points(folded[kept], before[at])


def maximal_matches(group: np.ndarray, i: np.ndarray, j: np.ndarray, run: int) -> np.ndarray:
    """Rows (group, start in item, start in document, length) of the matches that seeds at (i, j) of each group add up to."""
    order = np.lexsort((i, j - i, group))
    group, i, j = group[order], i[order], j[order]
    cut = np.ones(len(i), bool)
    cut[1:] = (np.diff(i) != 1) | (np.diff(j) != 1) | (np.diff(group) != 0)
    first = np.flatnonzero(cut)
    return np.stack((group[first], i[first], j[first], np.diff(np.append(first, len(i))) + run - 1), 1)


def tile(matches: np.ndarray, run: int) -> list[tuple[int, int, int]]:
    """Tiles (start in item, start in document, length), the longest first, none overlapping another on either side.
    A match that is partly taken goes back with its free parts of at least `run` words."""
    heap = [(-int(n), int(i), int(j)) for i, j, n in matches]
    heapq.heapify(heap)
    item, document, tiles = set(), set(), []
    while heap:
        n, i, j = heapq.heappop(heap)
        n = -n
        free = [i + k not in item and j + k not in document for k in range(n)]
        if all(free):
            tiles.append((i, j, n))
            item.update(range(i, i + n))
            document.update(range(j, j + n))
            continue
        k = 0
        while k < n:
            m = k
            while m < n and free[m]:
                m += 1
            if m - k >= run:
                heapq.heappush(heap, (-(m - k), i + k, j + k))
            k = m + 1
    return tiles


def _free_runs(free: np.ndarray, size: int) -> np.ndarray:
    sums = np.concatenate(([0], np.cumsum(free)))
    return np.flatnonzero(sums[size:] - sums[:-size] == size) if len(free) >= size else np.zeros(0, np.int64)


def tile_words(item: np.ndarray, document: np.ndarray, run: int) -> list[tuple[int, int, int]]:
    """The tiles of `tile` from the words of both sides, for words that repeat so much that their seeds are a product.

    The longest run that both sides still have free is found by halving, its places are marked in order, and so on;
    work and memory grow with the words of both sides, not with the pairs of their places.
    """
    free_a, free_b, tiles = np.ones(len(item), bool), np.ones(len(document), bool), []
    high = min(len(item), len(document))
    while True:
        low, top, found = run, high, None
        while low <= top:
            size = (low + top) // 2
            s, t = _free_runs(free_a, size), _free_runs(free_b, size)
            x, y = slice_hashes(item, s, s + size), slice_hashes(document, t, t + size)
            there = np.isin(x, y)
            if there.any():
                found, low = (size, s[there], x[there], t, y), size + 1
            else:
                top = size - 1
        if found is None:
            return tiles
        size, s, x, t, y = found
        high = size
        order = np.argsort(y, kind="stable")
        keys, begin = np.unique(y[order], return_index=True)
        begin, slot = np.append(begin, len(y)), np.searchsorted(keys, x)
        place = begin[:-1].copy()  # places of a run before this one are taken
        for i, k in zip(s.tolist(), slot.tolist()):
            if not free_a[i : i + size].all():
                continue
            while place[k] < begin[k + 1]:
                j = int(t[order[place[k]]])
                place[k] += 1
                if free_b[j : j + size].all():
                    tiles.append((i, j, size))
                    free_a[i : i + size] = free_b[j : j + size] = False
                    break


def joined_runs(position: np.ndarray, words: np.ndarray, side: int) -> np.ndarray:
    """The words of a text that lie in runs (a row of `words` each, at `position`), with a sign of its own in each gap."""
    order = np.unique(position, return_index=True)[1]
    position, words = position[order], words[order]
    run = words.shape[1]
    where = (position[:, None] + np.arange(run)).ravel()
    places, first = np.unique(where, return_index=True)
    gap = np.concatenate(([0], np.cumsum(np.diff(places) > 1)))
    out = mix(np.arange(places.size + gap[-1] if len(gap) else 0, dtype=np.uint64) + np.uint64((side + 1) << 50))
    out[np.arange(len(places)) + gap] = words.ravel()[first]
    return out


@dataclass(frozen=True)
class Index:
    """Runs of the items: the distinct runs in order of hash; for each run the items that have it, and for each of those
    the places; and the items' words."""

    grams: np.ndarray
    begin: np.ndarray  # of a run's items, by run
    item: np.ndarray
    first: np.ndarray  # of a run's places in one item, and how many there are
    count: np.ndarray
    place: np.ndarray
    words: np.ndarray
    at: np.ndarray
    ids: np.ndarray

    @classmethod
    def of(cls, ids: list, texts: list, run: int) -> Index:
        words, at = Folder().words(pa.array(texts, pa.large_string()))
        hashes, item, place = windows(words, at, run)
        order = np.lexsort((place, item, hashes))
        hashes, item, place = hashes[order], item[order], place[order]
        new = np.ones(len(hashes), bool)
        new[1:] = (hashes[1:] != hashes[:-1]) | (item[1:] != item[:-1])
        first = np.flatnonzero(new)
        grams, begin = np.unique(hashes[first], return_index=True)
        return cls(grams, np.append(begin, len(first)), item[first], first, np.diff(np.append(first, len(hashes))), place, words, at, np.array(ids, np.int64))


def _enough(words: np.ndarray | int, whole: np.ndarray | int, share: tuple[int, int]):
    return words * share[1] >= whole * share[0]


def covered(first: np.ndarray, group: np.ndarray, size: np.ndarray, run: int) -> np.ndarray:
    """Words of each group's item that lie in runs beginning at `first`. size: words of the item, by group."""
    base = np.concatenate(([0], np.cumsum(size + 1)))
    change = np.zeros(base[-1] + 1, np.int64)
    at = base[group] + first
    np.add.at(change, at, 1)
    np.add.at(change, at + run, -1)
    inside = np.concatenate(([0], np.cumsum(np.cumsum(change) > 0)))
    return inside[base[1:]] - inside[base[:-1]]


def tiled(texts: np.ndarray, j: np.ndarray, slot: np.ndarray, words: np.ndarray, at: np.ndarray, index: Index, run: int, share: tuple[int, int]) -> list[np.ndarray]:
    """Columns (text, item, item's words, tiles, tiled words, covered words or -1) of every text and item with a shared run.
    texts, j, slot: runs of the texts that are in the index."""
    items = np.diff(index.begin)[slot]
    entry = ranges(index.begin[slot], items)
    text, j, item = np.repeat(texts, items), np.repeat(j, items), index.item[entry]
    order = np.lexsort((j, item, text))
    text, j, item, entry = text[order], j[order], item[order], entry[order]
    new = np.ones(len(text), bool)
    new[1:] = (text[1:] != text[:-1]) | (item[1:] != item[:-1])
    start = np.flatnonzero(new)
    group = np.cumsum(new) - 1
    text, item = text[start], item[start]
    size = np.diff(index.at)[item]
    tiles, length = np.zeros(len(start), np.int64), np.zeros(len(start), np.int64)

    many = index.count[entry]
    dense = np.bincount(group, many, len(start)) > DENSE * (np.diff(np.append(start, len(group))) + size)
    light = ~dense[group]
    seeds = ranges(index.first[entry[light]], many[light])
    m = maximal_matches(np.repeat(group[light], many[light]), index.place[seeds], np.repeat(j[light], many[light]), run)
    matches = np.bincount(m[:, 0], minlength=len(start))
    lone = m[matches[m[:, 0]] == 1]
    tiles[lone[:, 0]], length[lone[:, 0]] = 1, lone[:, 3]
    m = m[matches[m[:, 0]] > 1]
    cuts = np.flatnonzero(np.diff(m[:, 0], prepend=-1)) if len(m) else []
    for a, b in zip(cuts, np.append(cuts[1:], len(m)) if len(m) else []):
        found = tile(m[a:b, 1:], run)
        tiles[m[a, 0]], length[m[a, 0]] = len(found), sum(t[2] for t in found)
    ends = np.append(start, len(group))
    for g in np.flatnonzero(dense).tolist():
        rows = j[ends[g] : ends[g + 1]]
        there = words[at[text[g]] + rows[:, None] + np.arange(run)]
        found = tile_words(index.words[index.at[item[g]] : index.at[item[g] + 1]], joined_runs(rows, there, 1), run)
        tiles[g], length[g] = len(found), sum(t[2] for t in found)

    count = np.full(len(start), -1, np.int64)
    open_ = ~_enough(length, size, share)
    mine = open_[group]
    number = np.cumsum(open_) - 1
    runs = np.unique(np.stack((number[group[mine]], index.first[entry[mine]], many[mine]), 1), axis=0)
    places = ranges(runs[:, 1], runs[:, 2])
    count[open_] = covered(index.place[places], np.repeat(runs[:, 0], runs[:, 2]), size[open_], run)
    return [text, item, size, tiles, length, count]


def _row(columns: list) -> pa.RecordBatch:
    names = [c.split()[0] for c in _FOUND.split(", ")]
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, pa.int64(), mask=(c < 0) if n == "covered_words" else None) for n, c in zip(names, columns)], names=names)


def _search(held, run: int, share: tuple[int, int]):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index: Index = held.value
        sample = index.first[index.begin[:-1]]  # one place of each run, whose words a seed must have
        own = index.at[index.item[index.begin[:-1]]] + index.place[sample]
        folder = Folder()
        for b in batches:
            done = 0
            for part in chunks(b.column(1)):
                words, at = folder.words(part)
                hashes, text, j = windows(words, at, run)
                slot = np.minimum(np.searchsorted(index.grams, hashes), len(index.grams) - 1)
                hit = np.flatnonzero(index.grams[slot] == hashes)
                text, j, slot = text[hit], j[hit], slot[hit]
                same = np.ones(len(hit), bool)
                for k in range(run):
                    same &= words[at[text] + j + k] == index.words[own[slot] + k]
                c = tiled(text[same], j[same], slot[same], words, at, index, run, share)
                yield _row([index.ids[c[1]], b.column(0).take(pa.array(c[0] + done)), *c[2:]])
                done += len(part)

    return search


def _item_runs(run: int):
    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        folder = Folder()
        for b in batches:
            words, at = folder.words(b.column(1))
            h1, item, place = windows(words, at, run)
            h2 = _second(words, at, item, place, run)
            yield pa.RecordBatch.from_arrays([pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64)), b.column(0).take(pa.array(item)), pa.array(np.diff(at)[item], pa.int32()), pa.array(place, pa.int32())], names=["h1", "h2", "item_id", "item_words", "place"])

    return runs


def _second(words: np.ndarray, at: np.ndarray, text: np.ndarray, place: np.ndarray, run: int) -> np.ndarray:
    """Another hash of each run, so that both together stand for its words."""
    out = np.full(len(text), 0x5851F42D4C957F2D, np.uint64)
    for k in range(run):
        out = mix(out ^ words[at[text] + place + k])
    return out


def _document_runs(words_of_filter, run: int):
    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        folder, held = Folder(), words_of_filter.value
        for b in batches:
            done = 0
            for part in chunks(b.column(2)):
                words, at = folder.words(part)
                h1, text, place = windows(words, at, run)
                h2 = _second(words, at, text, place, run)
                keep = may_hold(held, h1, h2)
                h1, h2, text, place = h1[keep], h2[keep], text[keep], place[keep]
                row = pa.array(text + done)
                own = pa.ListArray.from_arrays(pa.array(np.arange(len(text) + 1) * run, pa.int32()), pa.array(words[(at[text] + place)[:, None] + np.arange(run)].ravel().view(np.int64)))
                yield pa.RecordBatch.from_arrays([b.column(0).take(row), b.column(1).take(row), pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64)), pa.array(place, pa.int32()), own], names=["doc_id", "copy", "h1", "h2", "j", "words"])
                done += len(part)

    return runs


def _tile_group(run: int, share: tuple[int, int]):
    def of(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        j, places = t["j"].to_numpy(), t["places"].combine_chunks()
        words = t["words"].combine_chunks().flatten().to_numpy().view(np.uint64).reshape(len(j), run)
        size, many = t["item_words"][0].as_py(), np.diff(places.offsets.to_numpy())
        i, seed = places.flatten().to_numpy(), np.repeat(np.arange(len(j)), many)
        if len(i) > DENSE * (len(j) + size):
            found = tile_words(joined_runs(i, words[seed], 0), joined_runs(j, words, 1), run)
        else:
            found = tile(maximal_matches(np.zeros(len(i), np.int64), i.astype(np.int64), j[seed].astype(np.int64), run)[:, 1:], run)
        length = sum(x[2] for x in found)
        count = -1 if _enough(length, size, share) else int(covered(np.unique(i).astype(np.int64), np.zeros(len(np.unique(i)), np.int64), np.array([size]), run)[0])
        return pa.Table.from_batches([_row([t["item_id"][:1].combine_chunks(), t["doc_id"][:1].combine_chunks(), *[np.array([x], np.int64) for x in (size, len(found), length, count)]])])

    return of


def _by_join(docs: DataFrame, items: DataFrame, run: int, share: tuple[int, int]) -> DataFrame:
    """For more items than may be broadcast: one pass over the documents, whose runs meet the items' runs by hash.

    A filter of bounded size first drops runs that no item has. A document's and an item's runs then meet in one
    group, which is as large as the document's shared part.
    """
    spark = docs.sparkSession
    made = items.select("item_id", "text").mapInArrow(_item_runs(run), "h1 long, h2 long, item_id long, item_words int, place int")
    places = written(made.groupBy("h1", "h2", "item_id", "item_words").agg(F.sort_array(F.collect_set("place")).alias("places")), "item_runs")
    keys = written(places.select("h1", "h2").distinct(), "item_keys")
    held = spark.sparkContext.broadcast(filter_words(keys, keys.count()))
    rows = docs.select("doc_id", F.xxhash64("text").alias("copy"), "text").mapInArrow(_document_runs(held, run), "doc_id long, copy long, h1 long, h2 long, j int, words array<long>")
    met = spread_join(written(rows, "document_runs"), places, ["h1", "h2"]).select("doc_id", "copy", "item_id", "item_words", "j", "words", "places").dropDuplicates(["doc_id", "copy", "item_id", "j"])
    return met.groupBy("doc_id", "copy", "item_id").applyInArrow(_tile_group(run, share), _FOUND)


def leaks(documents: DataFrame, doc_id: str, text_col: str, items: DataFrame, item_id: str, item_text: str, run: int = 5, share: tuple[int, int] = (1, 2)) -> DataFrame:
    """item_id, doc_id, item_words, tiles, tiled_words, covered_words of every item and document with a shared run.

    covered_words are the item's words in any shared run where the tiles alone don't reach `share` (a fraction), else
    null. The index of items up to BLOCK_CHARS code points is broadcast; more items are joined.
    """
    spark = documents.sparkSession
    ship_code(spark)
    docs = documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text_col).alias("text")).where(F.col("doc_id").isNotNull() & F.col("text").isNotNull())
    held = items.select(F.col(item_id).cast("long").alias("item_id"), F.col(item_text).alias("text")).where(F.col("item_id").isNotNull() & F.col("text").isNotNull()).distinct()
    if (held.agg(F.sum(F.length("text"))).first()[0] or 0) > BLOCK_CHARS:
        return _by_join(docs, held, run, share)
    rows = held.orderBy("item_id", "text").collect()
    index = Index.of([r.item_id for r in rows], [r.text for r in rows], run)
    if not len(index.grams):
        return spark.createDataFrame([], _FOUND)
    return docs.mapInArrow(_search(spark.sparkContext.broadcast(index), run, share), _FOUND)


def leaked(found: DataFrame, share: tuple[int, int] = (1, 2)) -> DataFrame:
    """item_id, doc_id where tiles hold `share` of the item's words, or, if they don't, its words in shared runs do."""
    part, whole = share
    reached = lambda c: F.col(c) * whole >= F.col("item_words") * part
    return found.where(reached("tiled_words") | F.coalesce(reached("covered_words"), F.lit(False))).select("item_id", "doc_id").distinct()
