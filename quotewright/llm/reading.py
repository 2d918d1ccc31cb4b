"""Reading level of documents.

Every sentence is classified by two regularised softmax models, one over words and one over the characters of its
words, that share a score per word. A document's sentences give a mean distribution over the levels, weighted by
their words, of its plain sentences, and an expected level of those that quote, cite, hold digits or are in another
script, with the share of words in them. A second regression calibrates both, by script, to the scale of the ratings, and so learns what
each says. It is fitted on sentences that the fold's models have not seen; the models learn from plain sentences.

Fitted on at most `SAMPLE` rated documents of up to FIT_CHARS code points, FIT_TOTAL in all, chosen by a hash of the
id (of a document rated twice, the mean of its ratings); every document is classified by all its sentences. Null and short texts (below `least_words` words between
blanks) get no level; equal texts get equal levels; without any rating there is no scale and no row.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quotewright.llm.arrays import code_points, mix, ranges, run_ids, slice_hashes, utf8
from quotewright.llm.tokenize import chunks
from quotewright.llm.words import word_slices
from quotewright.runtime import ship_code

#: Longest text that models are fitted on, and most text in all (in code points); classified are texts of any length.
FIT_CHARS, FIT_TOTAL = 20_000, 8_000_000
#: Rated documents to fit on, weights of the character model, levels, folds, rounds and step of the fit, and the penalty.
SAMPLE, GRAMS, LEVELS, FOLDS, ROUNDS, STEP, PENALTY = 4000, 1 << 15, 5, 2, 60, 0.3, 2e-4
SIZES, LEAST = (2, 3, 4), 4
_UNKNOWN = np.uint32(0xFFFFFFFF)
END = 0x0A
# Signs that end a sentence, and signs of quotation. The latter and digits mark a foreign sentence.
ENDS = ".!?؟۔…\n\r\u2028\u2029"
QUOTES = "«»“”„\"『』【】﴿﴾[]"
MARK = 0x1E


class Sentences:
    """Words and sentences of a column of texts."""

    table = np.full(0x110000, _UNKNOWN, np.uint32)

    @staticmethod
    def image(c: str) -> int:
        if c in ENDS:
            return END
        c = unicodedata.normalize("NFKC", c.lower())[:1] or " "
        kind = unicodedata.category(c)
        if c in QUOTES or kind[0] == "N":
            return MARK
        return 0 if kind in ("Mn", "Me", "Cf") or c == "ـ" else ord(c) if kind[0] == "L" else 0x20

    def __init__(self, texts: pa.Array):
        data, offsets, _ = utf8(texts)
        points, at = code_points(data, offsets)
        folded = self.table[points]
        if (new := folded == _UNKNOWN).any():
            for p in np.unique(points[new]).tolist():
                self.table[p] = self.image(chr(p))
            folded = self.table[points]
        kept = folded != 0
        at = np.concatenate(([0], np.cumsum(kept)))[at]
        folded = folded[kept]
        ended = np.cumsum(folded == END)
        marks = np.flatnonzero(folded == MARK)
        folded[(folded == END) | (folded == MARK)] = 0x20
        starts, ends = word_slices(folded, at)
        keys, first, self.word = np.unique(slice_hashes(folded.astype(np.uint64), starts, ends), return_index=True, return_inverse=True)
        self.keys = keys
        text = np.searchsorted(at, starts, "right") - 1
        part = ended[starts] + text  # sentences don't go from one text into the next
        new = np.ones(len(starts), bool)
        new[1:] = part[1:] != part[:-1]
        self.begin = np.flatnonzero(new)
        self.size = np.diff(np.append(self.begin, len(starts)))
        self.text = text[self.begin]
        arabic = (folded[starts] >= 0x600) & (folded[starts] <= 0x6FF)
        self.arabic = np.bincount(text, arabic, len(texts)) * 2 > np.bincount(text, minlength=len(texts))
        self._judge(part, arabic, ended[marks] + np.searchsorted(at, marks, "right") - 1)
        s, e = starts[first], ends[first]
        length = e - s
        padded = np.full(int((length + 2).sum()), 1, np.uint64)  # a sign before and after each word
        head = np.cumsum(length + 2) - (length + 2)
        padded[ranges(head + 1, length)] = folded[ranges(s, length)]
        grams, of = [], []
        for n in SIZES:
            count = np.maximum(0, length + 3 - n)
            g = ranges(head, count)
            grams.append(slice_hashes(padded, g, g + n) % np.uint64(GRAMS))
            of.append(run_ids(count))
        self.gram, self.gram_of = np.concatenate(grams).astype(np.int64), np.concatenate(of)
        self.grams_in = np.maximum(1, np.bincount(self.gram_of, minlength=len(keys)))

    def _judge(self, part: np.ndarray, arabic: np.ndarray, marked: np.ndarray) -> None:
        """own: which sentences are plain. Those with quotations, digits, words in another script or fewer than LEAST
        words aren't, unless the text has no other."""
        of = run_ids(self.size)
        in_arabic = np.bincount(of, arabic, len(self.begin))
        alien = np.where(self.arabic[self.text], in_arabic < self.size, in_arabic > 0)
        flagged = np.zeros(len(self.begin), bool)
        if len(self.begin) and len(marked):
            slot = np.minimum(np.searchsorted(part[self.begin], marked), len(self.begin) - 1)
            flagged[slot[part[self.begin][slot] == marked]] = True
        own = ~alien & ~flagged & (self.size >= LEAST)
        lone = np.bincount(self.text, own * self.size, len(self.arabic)) < 1
        self.own = np.where(lone[self.text], 1.0, own)

    def shape(self) -> np.ndarray:
        """log words, and its square, of each sentence."""
        n = np.log1p(self.size)
        return np.stack((np.ones(len(n)), n - 2.3, (n - 2.3) ** 2), 1)


def _sum_by(index: np.ndarray, values: np.ndarray, size: int) -> np.ndarray:
    return np.stack([np.bincount(index, values[:, k], size) for k in range(values.shape[1])], 1)


def _softmax(x: np.ndarray) -> np.ndarray:
    x = np.exp(x - x.max(1, keepdims=True))
    return x / x.sum(1, keepdims=True)


class Model:
    """Weights of the word model by word, of the character model by run of characters, and of the sentence's length."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        self.word, self.gram, self.length = np.zeros((len(keys), LEVELS)), np.zeros((GRAMS, LEVELS)), np.zeros((3, LEVELS))

    def word_scores(self, s: Sentences) -> np.ndarray:
        score = _sum_by(s.gram_of, self.gram[s.gram], len(s.keys)) / s.grams_in[:, None]
        if len(self.keys):
            at = np.minimum(np.searchsorted(self.keys, s.keys), len(self.keys) - 1)
            score += self.word[at] * (self.keys[at] == s.keys)[:, None]
        return score

    def levels(self, s: Sentences) -> np.ndarray:
        """The distribution over the levels of each sentence."""
        if not len(s.begin):
            return np.zeros((0, LEVELS))
        return _softmax(np.add.reduceat(self.word_scores(s)[s.word], s.begin) / s.size[:, None] + s.shape() @ self.length)

    @classmethod
    def fit(cls, s: Sentences, level: np.ndarray, use: np.ndarray) -> Model:
        """level: a target for each sentence, used where `use`. Adaptive gradient steps on all sentences at once."""
        seen = np.bincount(s.word, np.repeat(use, s.size), minlength=len(s.keys)) > 0
        m = cls(s.keys)
        weight = use * s.own * np.sqrt(s.size)
        weight = weight / weight.sum()
        target = np.zeros((len(level), LEVELS))
        low = np.clip(np.floor(level).astype(int) - 1, 0, LEVELS - 2)
        target[np.arange(len(level)), low] = 1 - (level - 1 - low)
        target[np.arange(len(level)), low + 1] = level - 1 - low
        of, shape = run_ids(s.size), s.shape()
        past = [np.full_like(x, 1e-8) for x in (m.word, m.gram, m.length)]
        for _ in range(ROUNDS):
            p = _softmax(np.add.reduceat(m.word_scores(s)[s.word], s.begin) / s.size[:, None] + shape @ m.length)
            d = (p - target) * weight[:, None]
            by_word = _sum_by(s.word, (d / s.size[:, None])[of], len(s.keys))
            by_gram = _sum_by(s.gram, (by_word / s.grams_in[:, None])[s.gram_of], GRAMS)
            for x, g, h, pen in zip((m.word, m.gram, m.length), (by_word, by_gram, shape.T @ d), past, (PENALTY, PENALTY, 0)):
                g = g + pen * x / max(1, len(s.keys))
                h += g * g
                x -= STEP * g / np.sqrt(h)
        m.word[~seen] = 0
        return m


def profile(models: list[tuple[Model, float]], s: Sentences, texts: int) -> np.ndarray:
    """Features of each text: the arithmetic and the geometric mean of its plain sentences' distributions over the levels,
    the mean score of their words, the expected level, the mean length of a sentence; the expected level of its other
    sentences and their share of the words; and all again for Arabic script."""
    p = sum(m.levels(s) * w for m, w in models)
    size = s.size * s.own
    total, count = np.maximum(1e-9, np.bincount(s.text, size, texts))[:, None], np.maximum(1e-9, np.bincount(s.text, s.own, texts))[:, None]
    mean = _sum_by(s.text, p * size[:, None], texts) / total
    logs = _sum_by(s.text, np.log(p + 1e-4) * size[:, None], texts) / total
    expected = (mean @ np.arange(LEVELS) - 2)[:, None]
    scores = np.zeros((0, LEVELS)) if not len(s.begin) else sum(np.add.reduceat(m.word_scores(s)[s.word], s.begin) * w for m, w in models)
    words = _sum_by(s.text, scores * s.own[:, None], texts) / total
    lengths = np.column_stack((np.log(total / count), _sum_by(s.text, (np.log(np.maximum(s.size, 1)) * s.own)[:, None], texts) / count))
    marked = s.size * (1 - s.own)
    in_marked = np.bincount(s.text, marked, texts)[:, None]
    other = (_sum_by(s.text, p * marked[:, None], texts) / np.maximum(1, in_marked)) @ (np.arange(LEVELS) - 2)
    share = in_marked / np.maximum(1, np.bincount(s.text, s.size, texts))[:, None]
    base = np.column_stack((mean, logs, words, expected, expected**2, lengths, lengths**2, words * lengths[:, :1], other, share, np.ones(texts)))
    return np.column_stack((base, base * s.arabic[:, None]))


class Calibration:
    """A ridge-penalised softmax regression from profiles to levels; the level is the median of its distribution."""

    def __init__(self, features: np.ndarray, ratings: np.ndarray, penalty: float = 3e-3, rounds: int = 400):
        self.middle, self.spread = features.mean(0), features.std(0) + 1e-6
        x = self._scaled(features)
        low = np.clip(np.floor(ratings).astype(int) - 1, 0, LEVELS - 2)
        target = np.zeros((len(ratings), LEVELS))
        rows = np.arange(len(ratings))
        target[rows, low], target[rows, low + 1] = 1 - (ratings - 1 - low), ratings - 1 - low
        self.weights, past = np.zeros((x.shape[1], LEVELS)), np.full((x.shape[1], LEVELS), 1e-8)
        for _ in range(rounds):
            g = x.T @ (_softmax(x @ self.weights) - target) / len(x) + penalty * self.weights
            past += g * g
            self.weights -= 0.3 * g / np.sqrt(past)

    def _scaled(self, features: np.ndarray) -> np.ndarray:
        return np.column_stack(((features - self.middle) / self.spread, np.ones(len(features))))

    def level(self, features: np.ndarray) -> np.ndarray:
        return 1 + (np.cumsum(_softmax(self._scaled(features) @ self.weights), 1) < 0.5).sum(1).clip(0, LEVELS - 1)


def fit(texts: list[str], ratings: np.ndarray) -> tuple:
    """(models with weights, calibration) from rated texts."""
    s = Sentences(pa.array(texts, pa.large_string()))
    level = ratings[s.text]
    fold = (mix(np.arange(len(texts), dtype=np.uint64)) % np.uint64(FOLDS)).astype(int)
    models, features = [], np.zeros((len(texts), 0))
    for k in range(FOLDS):
        m = Model.fit(s, level, fold[s.text] != k)
        mine = profile([(m, 1.0)], s, len(texts))
        features = mine if not features.size else np.where((fold == k)[:, None], mine, features)
        models.append((m, 1 / FOLDS))
    return models, Calibration(features, ratings)


def classify(fitted: tuple, texts: pa.Array) -> np.ndarray:
    """The level of each text."""
    models, calibration = fitted
    s = Sentences(texts)
    return calibration.level(profile(models, s, len(texts)))


def _levels(fitted, least_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            long_enough = pa.array([len(t.split()) >= least_words for t in b.column(1).to_pylist()], pa.bool_())
            b = b.filter(long_enough)
            done = 0
            for part in chunks(b.column(1)):
                yield pa.RecordBatch.from_arrays([b.column(0).slice(done, len(part)), pa.array(classify(fitted.value, part), pa.int32())], names=["doc_id", "reading_level"])
                done += len(part)

    return run


def reading_levels(documents: DataFrame, doc_id: str, text_col: str, ratings: DataFrame, rated_id: str, level_col: str, least_words: int = 40) -> DataFrame:
    """doc_id, reading_level of every document of at least `least_words` words."""
    spark = documents.sparkSession
    ship_code(spark)
    docs = documents.select(F.col(doc_id).alias("doc_id"), F.col(text_col).alias("text")).where(F.col("text").isNotNull())
    rated = ratings.where(F.col(level_col).between(1, LEVELS)).groupBy(F.col(rated_id).alias("doc_id")).agg(F.avg(level_col).alias("level"))
    fit_on = docs.where(F.length("text") <= FIT_CHARS).join(rated, "doc_id")
    sample = fit_on.orderBy(F.xxhash64("doc_id"), "doc_id", "text").limit(SAMPLE).select("doc_id", "text", "level", F.xxhash64("doc_id").alias("order"), F.length("text").cast("long").alias("signs")).toArrow()
    sample = sample.sort_by([("order", "ascending"), ("doc_id", "ascending"), ("text", "ascending")])
    sample = sample.slice(0, int((np.cumsum(sample["signs"].to_numpy()) <= FIT_TOTAL).sum())).sort_by("doc_id")
    schema = docs.select("doc_id").schema.add("reading_level", "integer")
    if not sample.num_rows:
        return spark.createDataFrame([], schema)
    fitted = spark.sparkContext.broadcast(fit(sample["text"].to_pylist(), sample["level"].to_numpy()))
    return docs.mapInArrow(_levels(fitted, least_words), schema)
