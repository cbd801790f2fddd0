"""A trained model for the last tier of language detection: letter trigrams.

Trigrams of code points of the lower-case text, a space before and after it, are numbered by a
sum modulo ``BUCKETS``. Training counts them per language in tasks and adds the counts up as a
grouped aggregate; what comes back has a bounded size, languages x buckets. A weight is
1000 log10 of a trigram's smoothed share, rounded, so a text's score is a sum of integers that
depends neither on order nor on platform. For the confidences a text counts as at most ``REACH``
trigrams: the shares of the languages then say how clear the text is, not how long.

An empty text counts as the two spaces around it. Rows without text or label are not learned from.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.plans.spread import widened

#: Trigram numbers, factors of a trigram's code points, added to every count, trigrams a text counts as at most.
BUCKETS, FACTORS, SMOOTHING, REACH = 1 << 16, (7919, 104_729, 1_299_709), 0.5, 30
#: Most languages of a model, which is a bound of its size.
LANGUAGES = 200
#: Characters turned into arrays at once.
SLICE = 1 << 20


def trigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Trigram numbers of all texts in a row, and where each text's begin."""
    padded = [f" {t.lower()} " for t in texts]
    points = np.frombuffer("".join(padded).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    sizes = np.array([len(p) for p in padded], dtype=np.int64)
    a, b, c = FACTORS
    if len(points) < 3:
        return np.zeros(0, np.int64), np.zeros(len(texts), np.int64)
    number = (points[:-2] * a + points[1:-1] * b + points[2:] * c) % BUCKETS
    ends = np.cumsum(sizes)
    inside = np.ones(len(points), dtype=bool)
    inside[ends - 1] = inside[ends - 2] = False  # trigrams that would run into the next text
    return number[inside[:-2]], np.cumsum(sizes - 2) - (sizes - 2)


def _sliced(texts: list[str]) -> Iterator[list[str]]:
    held, n = [], 0
    for t in texts:
        held.append(t)
        n += len(t)
        if n >= SLICE:
            yield held
            held, n = [], 0
    if held:
        yield held


@dataclass(frozen=True)
class TrigramModel:
    """Weights of each language's trigrams; called with texts it gives (language, confidence) pairs, best first."""

    languages: list[str]
    weights: np.ndarray

    def scores(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Sum of weights per text and language, and trigrams per text."""
        parts = []
        for own in _sliced(texts):
            numbers, begin = trigrams(own)
            sizes = np.diff(np.append(begin, len(numbers)))
            upto = np.concatenate([np.zeros((len(self.languages), 1), np.int64), np.cumsum(self.weights[:, numbers], axis=1)], axis=1)
            parts.append(((upto[:, begin + sizes] - upto[:, begin]).T, sizes))
        if not parts:
            return np.zeros((0, len(self.languages)), np.int64), np.zeros(0, np.int64)
        return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])

    def __call__(self, texts: list[str]) -> list[list[tuple[str, float]]]:
        total, n = self.scores(texts)
        if not len(self.languages):
            return [[] for _ in texts]
        each = total * (np.minimum(n, REACH) / np.maximum(n, 1) * (np.log(10) / 1000))[:, None]
        share = np.exp(each - each.max(axis=1, keepdims=True))
        share /= share.sum(axis=1, keepdims=True)
        order = np.argsort(-total, axis=1, kind="stable")
        return [[(self.languages[k], float(p[k])) for k in row] for row, p in zip(order, share, strict=True)]


def _counted(languages: list[str], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Trigram counts of a task's texts by language."""
    place = {name: k for k, name in enumerate(languages)}
    counts = np.zeros((len(languages), BUCKETS), dtype=np.int64)
    for batch in batches:
        held: dict[str, list[str]] = {}
        for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            held.setdefault(label, []).append(text)
        for label, texts in held.items():
            for own in _sliced(texts):
                counts[place[label]] += np.bincount(trigrams(own)[0], minlength=BUCKETS)
    language, bucket = np.nonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(language.astype(np.int32)), pa.array(bucket.astype(np.int32)), pa.array(counts[language, bucket])], ["language", "bucket", "n"])


def train(df: DataFrame, text: Column, label: Column) -> TrigramModel:
    """Learn from every row that has a text and a label; more than ``LANGUAGES`` labels are an error."""
    rows = widened(df).select(text.cast("string").alias("text"), label.cast("string").alias("label")).filter("text is not null and label is not null")
    names = sorted(r[0] for r in df.filter(text.isNotNull() & label.isNotNull()).select(label.cast("string")).distinct().limit(LANGUAGES + 1).collect())
    if len(names) > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} languages")
    each = rows.mapInArrow(lambda it: _counted(names, it), "language int, bucket int, n long")
    found = each.groupBy("language", "bucket").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros((len(names), BUCKETS), dtype=np.int64)
    counts[found.column("language").to_numpy(), found.column("bucket").to_numpy()] = found.column("n").to_numpy()
    total = counts.sum(axis=1, keepdims=True) + SMOOTHING * BUCKETS
    return TrigramModel(names, np.round(1000 * np.log10((counts + SMOOTHING) / total)).astype(np.int64))
