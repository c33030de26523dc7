"""Toxicity: a convolutional text classifier over hashed word embeddings, trained in numpy.

A word's embedding is the sum of the hashed vectors of the word and of its first letters, so inflected forms share
what their stem learned. Filters of several widths run over the words, max pooling keeps each filter's strongest
place, a logistic layer scores. A filter's value at a place is a sum of one number for each word under it, so after
training the embeddings and filters fold into a few numbers a word, and a text of any length is scored by lookups.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import labelled_sample, remainder, send, slices

#: Hashed words, numbers of an embedding, filter widths, filters of each width.
BUCKETS, DIM, WIDTHS, FILTERS = 1 << 17, 8, (1, 2, 3), 8
PREFIXES = (3, 4, 5, 6, 7)
#: Bounds of the training sample: labelled documents, and characters of all of them.
TRAIN_ROWS, TRAIN_CHARS = 8_000, 24_000_000
#: Passes over the sample, or as many more as make so many steps of BATCH texts.
EPOCHS, STEPS, BATCH, RATE = 3, 200, 32, 0.05
#: Most weight of a row of the rarer class; steps between two foldings of the embedding into the table used for search.
RARE, FOLDED_FOR = 2.0, 4
#: Of the embedding's first number, for each deviation of evidence.
EVIDENCE, MOST_EVIDENCE = 0.1, 1.0
_FOLD, _REMEMBERED = 4096, 150_000


def word_ids(word: str) -> list[int]:
    """The hashed ids of a word: itself and its beginnings of PREFIXES letters."""
    return [zlib.crc32(b"w" + word.encode()) % BUCKETS, *(zlib.crc32(b"%d" % n + word[:n].encode()) % BUCKETS for n in PREFIXES)]


def words_of(text: str | None) -> list[str]:
    return (text or "").lower().split()


class Rows:
    """The folded numbers of words, remembered up to a bound."""

    def __init__(self, table: np.ndarray) -> None:
        self.table, self.at = table, {}
        self.rows = np.empty((_REMEMBERED + _FOLD + max(WIDTHS), table.shape[1]), np.float32)

    def of(self, words: list[str]) -> np.ndarray:
        """Of at most a fold of words."""
        new = set(words).difference(self.at)
        if len(self.at) + len(new) > len(self.rows):
            self.at.clear()
            new = set(words)
        if new:
            n = len(self.at)
            self.rows[n : n + len(new)] = self.table[np.array([word_ids(w) for w in new])].sum(axis=1)
            self.at.update(zip(new, range(n, n + len(new)), strict=True))
        return self.rows[np.fromiter(map(self.at.__getitem__, words), np.int64, len(words))]


@dataclass
class Cnn:
    embedding: np.ndarray  # BUCKETS x DIM
    filters: list[np.ndarray]  # for each width: width x DIM x FILTERS
    biases: list[np.ndarray]
    out: np.ndarray
    out_bias: float

    def folded(self) -> tuple[np.ndarray, list[np.ndarray]]:
        """A word's numbers: for each width and each of its places, what the word adds to each filter there."""
        columns = [self.embedding @ f[k] for f in self.filters for k in range(len(f))]
        return np.concatenate(columns, axis=1), self.biases


def pooled(length: int, rows_of: Callable[[int, int], np.ndarray], biases: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
    """Each filter's largest value after the rectifier, and where; too short a text pools to zero.

    ``rows_of`` gives the folded numbers of a stretch of words; long texts go through in folds that overlap by the
    widest filter, so memory stays bounded.
    """
    best = [np.full(FILTERS, -np.inf, b.dtype) for b in biases]
    where = [np.zeros(FILTERS, np.int64) for _ in WIDTHS]
    for begin in range(0, length, _FOLD):
        rows = rows_of(begin, min(length, begin + _FOLD + max(WIDTHS) - 1))
        column = 0
        for n, width in enumerate(WIDTHS):
            m = len(rows) - width + 1
            if m > 0:
                v = rows[:m, column : column + FILTERS].copy()
                for k in range(1, width):
                    v += rows[k : m + k, column + k * FILTERS : column + (k + 1) * FILTERS]
                at = v.argmax(axis=0)
                top = v[at, np.arange(FILTERS)]
                better = top > best[n]
                best[n] = np.where(better, top, best[n])
                where[n] = np.where(better, at + begin, where[n])
            column += width * FILTERS
    values = [np.maximum(b + c, 0) for b, c in zip(best, biases, strict=True)]
    return np.concatenate(values), where


def gradients(net: Cnn, batch: list[np.ndarray], y: np.ndarray, weights: np.ndarray, folded: tuple[np.ndarray, list[np.ndarray]]) -> tuple[tuple[np.ndarray, np.ndarray], list[np.ndarray], float]:
    """Of the weighted log loss of some texts: (words, their gradients) of the embedding, of filters, biases and out, of the out bias.

    The gradient reaches the words under each filter's maximum.
    """
    table, biases = folded
    g_f, g_b, g_o, g_ob = [np.zeros_like(f) for f in net.filters], [np.zeros_like(b) for b in net.biases], np.zeros_like(net.out), 0.0
    touched, pulls = [np.zeros((0, 1 + len(PREFIXES)), np.int64)], [np.zeros((0, DIM), np.float32)]
    for ids, label, weight in zip(batch, y, weights, strict=True):
        h, where = pooled(len(ids), lambda a, b, ids=ids: table[ids[a:b]].sum(axis=1), biases)
        p = 1 / (1 + np.exp(-float(np.clip(h @ net.out + net.out_bias, -30, 30))))
        d = weight * (p - label)
        g_o += d * h
        g_ob += d
        dh = d * net.out * (h > 0)
        for n, width in enumerate(WIDTHS):
            if len(ids) < width:
                continue
            g = dh[n * FILTERS : (n + 1) * FILTERS]
            g_b[n] += g
            words = ids[where[n][:, None] + np.arange(width)]  # filters x width x ids of a word
            g_f[n] += (net.embedding[words].sum(axis=2) * g[:, None, None]).transpose(1, 2, 0)
            touched.append(words.reshape(-1, words.shape[2]))
            pulls.append((net.filters[n] * g).transpose(2, 0, 1).reshape(-1, DIM))
    words, of = np.unique(np.concatenate(touched), return_inverse=True)
    pull = np.repeat(np.concatenate(pulls), 1 + len(PREFIXES), axis=0)
    g = np.stack([np.bincount(of.ravel(), pull[:, j], len(words)) for j in range(DIM)], axis=1)
    return (words, g.astype(net.embedding.dtype)), [*g_f, *g_b, g_o], g_ob


def evidence(texts: list[np.ndarray], y: np.ndarray) -> np.ndarray:
    """For each hashed id, how far the texts of class 1 that have it are from its share of all texts, in deviations."""
    n = [np.zeros(BUCKETS, np.float32), np.zeros(BUCKETS, np.float32)]
    for ids, label in zip(texts, y, strict=True):
        n[int(label)][np.unique(ids)] += 1
    expected = (n[0] + n[1]) * (y.mean() if len(y) else 0)
    return (n[1] - expected) / np.sqrt(expected + 1)


def untrained(texts: list[np.ndarray], y: np.ndarray, seed: int = 42) -> Cnn:
    """Small random embeddings, but for the first number, which is the word's evidence: so the filters' maxima lie on
    telling words from the first step on, also where labels are few and most words are seen once."""
    rng = np.random.default_rng(seed)
    embedding = rng.normal(0, 0.02, (BUCKETS, DIM)).astype(np.float32)
    embedding[:, 0] += np.clip(EVIDENCE * evidence(texts, y), -MOST_EVIDENCE, MOST_EVIDENCE)
    filters = [rng.normal(0, 0.4, (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS]
    for f in filters:
        f[:, 0] = np.abs(f[:, 0]) / len(f)
    return Cnn(embedding, filters, [np.zeros(FILTERS, np.float32) for _ in WIDTHS], np.abs(rng.normal(0, 0.3, FILTERS * len(WIDTHS))).astype(np.float32), 0.0)


def train(texts: list[np.ndarray], y: np.ndarray, seed: int = 42) -> Cnn:
    """Backpropagation by adaptive gradient steps, at least STEPS of them however few the texts are.

    A text is an array of its words' ids, words x (1 + PREFIXES). A rare class weighs up to RARE times as much.
    """
    rng = np.random.default_rng(seed)
    net = untrained(texts, y, seed)
    seen = [np.full_like(net.embedding, 1e-6), *[np.full_like(f, 1e-6) for f in net.filters], *[np.full_like(b, 1e-6) for b in net.biases], np.full_like(net.out, 1e-6)]
    seen_bias = 1e-6
    if not len(texts):
        return net
    ones, zeros = int(y.sum()), int(len(y) - y.sum())
    weight = np.where(y == 1, min(RARE, max(1.0, zeros / max(1, ones))), min(RARE, max(1.0, ones / max(1, zeros)))).astype(np.float32)
    net.out_bias = float(np.log(((weight * y).sum() + 1) / ((weight * (1 - y)).sum() + 1)))
    epochs, step = max(EPOCHS, -(-STEPS * BATCH // len(texts))), 0
    for epoch in range(epochs):
        rate = RATE / (1 + epoch * EPOCHS / epochs) ** 0.5
        order = rng.permutation(len(texts))
        for begin in range(0, len(order), BATCH):
            part = order[begin : begin + BATCH]
            folded = net.folded() if step % FOLDED_FOR == 0 else folded  # noqa: F821
            step += 1
            (words, g), rest, g_ob = gradients(net, [texts[i] for i in part], y[part], weight[part], folded)
            seen[0][words] += g * g
            net.embedding[words] -= rate * g / np.sqrt(seen[0][words])
            for p_, g, s in zip([*net.filters, *net.biases, net.out], rest, seen[1:], strict=True):
                s += g * g
                p_ -= rate * g / np.sqrt(s)
            seen_bias += g_ob * g_ob
            net.out_bias -= rate * g_ob / seen_bias**0.5
    return net


def calibrate(scores: np.ndarray, y: np.ndarray, langs: list[str | None], least: int = 30) -> dict[str | None, float]:
    """For each language of the sample (and None, for all), the threshold with the best balanced accuracy."""

    def best(s: np.ndarray, t: np.ndarray) -> float:
        cuts = np.unique(np.r_[0.5, np.quantile(s, np.linspace(0.01, 0.99, 99))])
        rates = [((s >= c) & (t == 1)).sum() / max(1, (t == 1).sum()) + ((s < c) & (t == 0)).sum() / max(1, (t == 0).sum()) for c in cuts]
        good = cuts[np.array(rates) >= max(rates) - 1e-9]
        return float(good[np.abs(good - 0.5).argmin()])

    found: dict[str | None, float] = {None: best(scores, y) if len(y) else 0.5}
    for lang in {x for x in langs if x is not None}:
        at = np.array([x == lang for x in langs])
        if min((y[at] == 1).sum(), (y[at] == 0).sum()) >= least:
            found[lang] = best(scores[at], y[at])
    return found


def fit(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS, train_chars: int = TRAIN_CHARS) -> tuple[Cnn, dict[str | None, float]]:
    """The network and the thresholds, from labelled rows whose crc32(doc_id) mod 5 is not 0; a tenth calibrates."""
    able = labels.where(remainder("doc_id", 5) != 0)
    rows = sorted(labelled_sample(docs, able, "toxic", train_rows, train_chars), key=lambda r: r["doc_id"])
    known: dict[str, list[int]] = {}
    texts = []
    for r in rows:
        words = words_of(r["text"])
        if len(known) > 100_000:
            known.clear()
        for w in set(words).difference(known):
            known[w] = word_ids(w)
        texts.append(np.array([known[w] for w in words], np.int32).reshape(-1, 1 + len(PREFIXES)))
    y = np.array([min(1, r["y"]) for r in rows], int)
    apart = np.array([zlib.crc32(b"calibrate %d" % r["doc_id"]) % 10 == 0 for r in rows], bool)
    net = train([t for t, a in zip(texts, apart, strict=True) if not a], y[~apart])
    rows_of = Rows(net.folded()[0])
    scores = np.array([score(words_of(r["text"]), net, rows_of) for r, a in zip(rows, apart, strict=True) if a])
    chosen = [r["doc_id"] for r, a in zip(rows, apart, strict=True) if a]
    spark = docs.sparkSession
    langs = {}
    if chosen and "lang" in docs.columns:
        ids = spark.createDataFrame([(int(i),) for i in chosen], "doc_id long")
        langs = dict(docs.join(F.broadcast(ids), "doc_id").groupBy("doc_id").agg(F.min("lang")).collect())
    return net, calibrate(scores, y[apart], [langs.get(i) for i in chosen])


def score(words: list[str], net: Cnn, rows: Rows) -> float:
    h, _ = pooled(len(words), lambda a, b: rows.of(words[a:b]), net.biases)
    return float(1 / (1 + np.exp(-np.clip(h @ net.out + net.out_bias, -30, 30))))


def toxicity(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS, train_chars: int = TRAIN_CHARS) -> DataFrame:
    """(doc_id, held_out, score, predicted, lang_threshold, toxic_for_lang): a row per input row, from whole texts.

    The score depends on the text alone. ``predicted`` cuts it at 0.5; ``toxic_for_lang`` at the threshold calibrated
    for the row's language, or for all where the language is null, rare in the sample or missing.
    Null and empty texts get the score of no words; very long texts go through in folds of 4,096 words, whole.
    A null doc_id is not held out. Ties and repeated rows score alike; of rows that share a labelled doc_id the least
    text trains, so reruns agree. Without labels every score is that of an untrained network and thresholds are 0.5; an
    empty table gives no rows. Columns beside doc_id, text and lang are not read.
    """
    net, thresholds = fit(docs, labels, train_rows, train_chars)
    spark = docs.sparkSession
    table, biases = net.folded()
    sent = send(spark, (net.out, net.out_bias, table, biases))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, out_bias, table, biases = sent()
        net, rows = Cnn(None, None, biases, out, out_bias), Rows(table)
        for batch in batches:
            for part in slices(batch):
                scores = [score(words_of(t), net, rows) for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("lang"), pa.array(scores, pa.float64())], ["doc_id", "lang", "score"])

    lang = F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")
    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", lang.alias("lang")).mapInArrow(run, "doc_id long, lang string, score double")
    cut = F.lit(thresholds[None])
    for known, value in sorted((k, v) for k, v in thresholds.items() if k is not None):
        cut = F.when(F.col("lang") == known, value).otherwise(cut)
    return scored.select(
        "doc_id",
        F.coalesce(remainder("doc_id", 5) == 0, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
        cut.alias("lang_threshold"),
        (F.col("score") >= cut).cast("int").alias("toxic_for_lang"),
    )
