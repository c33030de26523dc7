"""Quality: ordinal cumulative-link regression on graded ratings over hashed text features.

One weight vector, shared by all grades, and ordered thresholds: P(grade <= k) = sigmoid(threshold_k - w.x). The
features of a text are the hashed words, their shapes (letter case, digits, symbols) and whether a word or a line
repeats, each averaged over the text, so a text of any length is scored by one pass of lookups.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import labelled_sample, remainder, send, slices

BUCKETS = 1 << 16
#: The last buckets are kept for repetition: a word like the one before it; a line seen before in the text, by words.
_SAME_WORD, _SAME_LINE = BUCKETS, BUCKETS + 1
#: Bounds of the training sample: rated documents, and characters of all of them.
TRAIN_ROWS, TRAIN_CHARS = 8_000, 24_000_000
EPOCHS, RATE, DECAY = 8, 0.3, 1e-4
_FOLD = 1 << 14
_runs = [(re.compile(rb"[a-z\x80-\xff]+"), b"a"), (re.compile(rb"[A-Z]+"), b"A"), (re.compile(rb"[0-9]+"), b"0"), (re.compile(rb"(.)\1+"), rb"\1")]


class Features(dict):
    """A word's two hashed ids, itself and its shape, in one number; remembered up to a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 400_000:
            self.clear()
        shape = word
        for run, to in _runs:
            shape = run.sub(to, shape)
        self[word] = both = (zlib.crc32(word.lower()) % BUCKETS) << 20 | zlib.crc32(b"shape " + shape) % BUCKETS
        return both

    def of(self, text: str | None) -> tuple[np.ndarray, int, int]:
        """The ids of a text's words, how many are like the word before, and how many stand in repeated lines."""
        data = (text or "").encode()
        words = data.split()
        ids = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        lines, seen, again = data.split(b"\n"), set(), 0
        if len(lines) > 1:
            for line in lines:
                if line in seen:
                    again += len(line.split())
                elif len(line) > 1:
                    seen.add(line)
        return ids, int((ids[1:] == ids[:-1]).sum()), again


@dataclass
class Ordinal:
    weights: np.ndarray  # BUCKETS + 2
    thresholds: np.ndarray  # ascending, one fewer than the grades
    grades: list[int]

    def position(self, features: tuple[np.ndarray, int, int]) -> float:
        ids, same_word, same_line = features
        if not len(ids):
            return 0.0
        total = sum(float(self.weights[ids[b : b + _FOLD] >> 20].sum() + self.weights[ids[b : b + _FOLD] & 0xFFFFF].sum()) for b in range(0, len(ids), _FOLD))
        return (total + same_word * float(self.weights[_SAME_WORD]) + same_line * float(self.weights[_SAME_LINE])) / len(ids)

    def probabilities(self, position: np.ndarray) -> np.ndarray:
        below = 1 / (1 + np.exp(-np.clip(self.thresholds[None, :] - position[:, None], -30, 30)))
        return np.diff(np.c_[np.zeros(len(position)), below, np.ones(len(position))], axis=1)


def gradients(model: Ordinal, at: np.ndarray, value: np.ndarray, y: int) -> tuple[float, np.ndarray]:
    """Of -log P(grade y) by the position (weights[at] @ value) and by the thresholds."""
    s = float(model.weights[at] @ value)
    below = 1 / (1 + np.exp(-np.clip(np.r_[-np.inf, model.thresholds, np.inf] - s, -30, 30)))
    below[0], below[-1] = 0, 1
    slope = below * (1 - below)
    p = max(below[y + 1] - below[y], 1e-9)
    by_threshold = np.zeros(len(model.thresholds))
    if y < len(model.thresholds):
        by_threshold[y] -= slope[y + 1] / p
    if y > 0:
        by_threshold[y - 1] += slope[y] / p
    return (slope[y + 1] - slope[y]) / p, by_threshold


def train(texts: list[tuple[np.ndarray, int, int]], y: np.ndarray, grades: list[int], seed: int = 42) -> Ordinal:
    """Adaptive gradient steps on the log-likelihood of the grades; thresholds are kept in order by their gaps."""
    rng = np.random.default_rng(seed)
    k = len(grades)
    share = np.cumsum(np.bincount(y, minlength=k) + 1)[:-1] / (len(y) + k)
    model = Ordinal(np.zeros(BUCKETS + 2, np.float32), np.log(share / (1 - share)), grades)
    sparse = []
    for ids, same_word, same_line in texts:
        at, count = np.unique(np.r_[ids >> 20, ids & 0xFFFFF, [_SAME_WORD] * (same_word > 0), [_SAME_LINE] * (same_line > 0)].astype(np.int64), return_counts=True)
        value = count.astype(np.float32)
        value[at == _SAME_WORD], value[at == _SAME_LINE] = same_word, same_line
        sparse.append((at, value / max(1, len(ids))))
    seen, seen_t = np.full(BUCKETS + 2, 1e-8, np.float32), np.full(k - 1, 1e-8)
    for _ in range(EPOCHS):
        for i in rng.permutation(len(sparse)):
            at, value = sparse[i]
            g, g_t = gradients(model, at, value, int(y[i]))
            grad = g * value + DECAY * model.weights[at]
            seen[at] += grad * grad
            model.weights[at] -= RATE * grad / np.sqrt(seen[at])
            seen_t += g_t * g_t
            model.thresholds = np.maximum.accumulate(model.thresholds - 0.1 * g_t / np.sqrt(seen_t + 1))
    return model


def fit(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS, train_chars: int = TRAIN_CHARS) -> Ordinal:
    """From a bounded sample of rated rows whose crc32(doc_id) mod 5 is not 0; the rest stay for testing."""
    rows = sorted(labelled_sample(docs, labels.where(remainder("doc_id", 5) != 0), "quality", train_rows, train_chars), key=lambda r: r["doc_id"])
    grades = sorted({r["y"] for r in rows})
    if len(grades) < 2:  # nothing to tell apart: every text has the one grade, or 1
        return Ordinal(np.zeros(BUCKETS + 2, np.float32), np.array([-30.0]), [*([g - 1 for g in grades] or [0]), *(grades or [1])])
    features = Features()
    return train([features.of(r["text"]) for r in rows], np.array([grades.index(r["y"]) for r in rows]), grades)


RESULTS = ("expected_grade", "tail_probability")


def quality(docs: DataFrame, model: Ordinal, tail_from: int | None = None, names: tuple[str, str] = RESULTS) -> DataFrame:
    """All columns of documents and two more: the expected grade, and the probability of a grade of ``tail_from`` (the highest) or more.

    Null and empty texts have no features: position 0 of the scale. Very long texts are summed in folds, whole. Ties,
    repeated rows and nulls elsewhere change nothing; an empty table gives no rows. A column of documents that has one
    of the ``names`` is an error, as either of the two would be lost; give other names then.
    """
    if clash := set(names) & set(docs.columns):
        raise ValueError(f"documents already have {', '.join(sorted(clash))}; give other names")
    sent = send(docs.sparkSession, model)
    first = model.grades.index(tail_from) if tail_from is not None else len(model.grades) - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features, model = Features(), sent()
        for batch in batches:
            for part in slices(batch):
                p = model.probabilities(np.array([model.position(features.of(t)) for t in part.column("text").to_pylist()]))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(p @ np.array(model.grades, float)), pa.array(p[:, first:].sum(axis=1))], [*part.schema.names, *names])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, *(T.StructField(n, T.DoubleType()) for n in names)]))


def select_quality(docs: DataFrame, labels: DataFrame, least: float = 0.5) -> DataFrame:
    """The documents, in their own columns, whose probability of the highest grade is at least ``least``.

    As in ``quality``; null and empty texts stay or go by the grades' own shares, repeated rows stay or go together.
    """
    sent = send(docs.sparkSession, fit(docs, labels))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features, model = Features(), sent()
        for batch in batches:
            for part in slices(batch):
                p = model.probabilities(np.array([model.position(features.of(t)) for t in part.column("text").to_pylist()]))
                yield part.filter(pa.array(p[:, -1] >= least))

    return docs.mapInArrow(run, T.StructType(docs.schema.fields))


def scored(docs: DataFrame, labels: DataFrame, least: float = 0.5) -> DataFrame:
    """(doc_id, held_out, expected_grade, tail_probability, kept) for every row; other columns but text are not read."""
    found = quality(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), fit(docs, labels))
    held = F.coalesce(remainder("doc_id", 5) == 0, F.lit(False))
    return found.select("doc_id", held.alias("held_out"), "expected_grade", "tail_probability", (F.col("tail_probability") >= least).alias("kept"))
