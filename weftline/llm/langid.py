"""Language identification: a bidirectional gated recurrent network over bytes, trained in numpy.

Backpropagation through time trains it on segments of labelled texts. Every byte of a text gets a distribution over
languages from the states of both directions at its place; a document's probabilities are the mean over its bytes.
Texts are laid end to end in segments that start from zero states, so thousands of them advance in one step.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import remainder, sample_rows, send

HIDDEN, SEGMENT = 8, 128
#: Bounds of the training sample: languages, documents of each, and the characters of a stretch that stands for a longer one.
TRAIN_LANGS, TRAIN_ROWS, TRAIN_CHARS = 64, 250, 20_000
STEPS, BATCH, RATE = 700, 128, 0.01
#: Segments that advance together.
_WIDE = 4096


@dataclass
class Gru:
    """One direction: byte table (256 x 3H), recurrent weights (H x 3H); gates in the order update, reset, candidate.

    The table and the weights of the two gates are halved, so that sigmoid(x) = (1 + tanh(x / 2)) / 2 needs no scaling.
    """

    table: np.ndarray
    u: np.ndarray

    def states(self, x: np.ndarray, keep: bool = False) -> tuple[list[np.ndarray], list]:
        """Hidden states for each step over x (steps x segments)."""
        n, out, kept = self.u.shape[0], [], []
        h = np.zeros((x.shape[1], n), np.float32)
        for row in x:
            g = self.table[row]
            a = h @ self.u
            gates = g[:, : 2 * n]
            gates += a[:, : 2 * n]
            np.tanh(gates, out=gates)
            gates += 1
            gates *= 0.5
            c = a[:, 2 * n :] * gates[:, n:]
            c += g[:, 2 * n :]
            np.tanh(c, out=c)
            new = h - c
            new *= gates[:, :n]
            new += c
            if keep:
                kept.append((h, gates, c, a[:, 2 * n :].copy()))
            h = new
            out.append(h)
        return out, kept

    def backward(self, x: np.ndarray, kept: list, d_out: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Gradients of the table and the recurrent weights from those of the states."""
        n = self.u.shape[0]
        g_table, g_u = np.zeros_like(self.table), np.zeros_like(self.u)
        d_h = np.zeros_like(d_out[0])
        for t in range(len(kept) - 1, -1, -1):
            h, gates, c, a_c = kept[t]
            z, r = gates[:, :n], gates[:, n:]
            d_h = d_h + d_out[t]
            d_c = d_h * (1 - z) * (1 - c * c)
            d_z = d_h * (h - c) * z * (1 - z) * 2
            d_r = d_c * a_c * r * (1 - r) * 2
            d_g = np.concatenate([d_z, d_r, d_c], axis=1)
            d_a = np.concatenate([d_z, d_r, d_c * r], axis=1)
            np.add.at(g_table, x[t], d_g)
            g_u += h.T @ d_a
            d_h = d_h * z + d_a @ self.u.T
        return g_table, g_u


@dataclass
class Model:
    langs: list[str]
    ahead: Gru
    back: Gru
    out: np.ndarray  # 2H x languages
    bias: np.ndarray

    def label(self, x: np.ndarray) -> np.ndarray:
        """Distributions over languages at every position of x (segments x steps): steps x segments x languages."""
        rows = np.ascontiguousarray(x.T)
        ahead, _ = self.ahead.states(rows)
        back, _ = self.back.states(rows[::-1])
        n = self.ahead.u.shape[0]
        logits = np.stack(ahead) @ self.out[:n]
        logits += np.stack(back[::-1]) @ self.out[n:]
        logits += self.bias
        logits -= logits.max(axis=2, keepdims=True)
        np.exp(logits, out=logits)
        logits /= logits.sum(axis=2, keepdims=True)
        return logits

    def pool(self, texts: list[bytes]) -> np.ndarray:
        """The mean distribution over each text's bytes; texts without bytes get the even one."""
        k = len(self.langs)
        sums, lengths = np.zeros((len(texts), k)), np.array([len(t) for t in texts])
        counts = -(-lengths // SEGMENT)
        owner = np.repeat(np.arange(len(texts)), counts)
        begin = np.cumsum(lengths) - lengths
        place = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
        first = np.repeat(begin, counts) + place * SEGMENT
        valid = np.minimum(SEGMENT, np.repeat(lengths, counts) - place * SEGMENT)
        data = np.frombuffer(b"".join(texts) + b"\0" * SEGMENT, np.uint8)
        steps = np.arange(SEGMENT)
        for b in range(0, len(owner), _WIDE):
            f, v, o = first[b : b + _WIDE], valid[b : b + _WIDE], owner[b : b + _WIDE]
            inside = steps[None, :] < v[:, None]
            p = self.label(np.where(inside, data[f[:, None] + steps], 0))
            for j in range(k):
                sums[:, j] += np.bincount(o, (p[:, :, j] * inside.T).sum(axis=0), len(texts))
        return np.where(lengths[:, None] > 0, sums / np.maximum(lengths, 1)[:, None], 1 / max(1, k))


def train(texts: list[bytes], y: np.ndarray, langs: list[str], seed: int = 42) -> Model:
    """Adam over random segments of 64 bytes, equal numbers of each language, the loss taken at every position."""
    rng = np.random.default_rng(seed)
    n, k = HIDDEN, len(langs)
    gru = lambda: Gru(rng.normal(0, 0.3, (256, 3 * n)).astype(np.float32), rng.normal(0, 0.3, (n, 3 * n)).astype(np.float32))
    model = Model(langs, gru(), gru(), rng.normal(0, 0.3, (2 * n, k)).astype(np.float32), np.zeros(k, np.float32))
    by_lang = [np.flatnonzero((y == j) & np.array([len(t) > 0 for t in texts], bool)) for j in range(k)]
    if k < 2 or not all(len(b) for b in by_lang):
        return model
    own = [model.ahead.table, model.ahead.u, model.back.table, model.back.u, model.out, model.bias]
    m, v = [np.zeros_like(p) for p in own], [np.zeros_like(p) for p in own]
    length = 64
    for step in range(1, STEPS + 1):
        lang = np.arange(BATCH) % k
        x = np.zeros((length, BATCH), np.int64)
        inside = np.zeros((length, BATCH), np.float32)
        for b in range(BATCH):
            text = texts[rng.choice(by_lang[lang[b]])]
            at = int(rng.integers(max(1, len(text) - length + 1)))
            piece = np.frombuffer(text[at : at + length], np.uint8)
            x[: len(piece), b], inside[: len(piece), b] = piece, 1
        ahead, kept_a = model.ahead.states(x, keep=True)
        back, kept_b = model.back.states(x[::-1], keep=True)
        both = np.concatenate([np.stack(ahead), np.stack(back[::-1])], axis=2)
        logits = both @ model.out + model.bias
        p = np.exp(logits - logits.max(axis=2, keepdims=True))
        p /= p.sum(axis=2, keepdims=True)
        p[:, np.arange(BATCH), lang] -= 1
        d = p * inside[:, :, None] / inside.sum()
        d_both = d @ model.out.T
        g_a = model.ahead.backward(x, kept_a, list(d_both[:, :, :n]))
        g_b = model.back.backward(x[::-1], kept_b, list(d_both[::-1, :, n:]))
        g_out = both.reshape(-1, 2 * n).T @ d.reshape(-1, k)
        rate = RATE * (1 - 0.9 * step / STEPS)
        for p_, g, m_, v_ in zip(own, [*g_a, *g_b, g_out, d.sum(axis=(0, 1))], m, v, strict=True):
            m_ += 0.1 * (g - m_)
            v_ += 0.01 * (g * g - v_)
            p_ -= (rate * (m_ / (1 - 0.9**step)) / (np.sqrt(v_ / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return model


def fit(docs: DataFrame, train_rows: int = TRAIN_ROWS, train_chars: int = TRAIN_CHARS, train_langs: int = TRAIN_LANGS) -> Model:
    """From the text and language of documents with crc32(doc_id) mod 4 not 2.

    At most ``train_rows`` documents of each of the ``train_langs`` languages with the most documents; languages beyond
    these are not learned. Of a longer text a stretch of ``train_chars`` from a hashed place is taken, as training looks
    at stretches of 64 bytes anyway.
    """
    able = docs.select("doc_id", "text", "lang").where((remainder("doc_id", 4) != 2) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    begin = F.pmod(F.xxhash64("doc_id", F.lit("stretch")), F.greatest(F.lit(1), F.length("text") - train_chars + 1)) + 1
    able = able.select("doc_id", F.substring("text", begin.cast("int"), F.lit(train_chars)).alias("text"), "lang")
    rows = sample_rows(able, "doc_id", train_rows, "lang", train_langs)
    langs = sorted({r["lang"] for r in rows})
    return train([r["text"].encode() for r in rows], np.array([langs.index(r["lang"]) for r in rows], int), langs)


def has_letter(text: str) -> bool:
    """Whether a character is a letter in Unicode's sense; digits, fractions and number signs of other kinds are none."""
    return any(map(str.isalpha, text))


def _groups(part: pa.RecordBatch, size: int = 1 << 21) -> Iterator[pa.RecordBatch]:
    """Pieces of about so many characters: many short texts at once, memory bounded by them and the longest text."""
    lengths = pc.fill_null(pc.utf8_length(part.column("text")), 0).to_numpy(zero_copy_only=False)
    group = np.cumsum(lengths) // size
    for g in np.unique(group):
        at = np.flatnonzero(group == g)
        yield part.slice(int(at[0]), len(at))


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for every row; see ``language``."""
    sent = send(docs.sparkSession, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent()
        for batch in batches:
            for part in _groups(batch):
                texts = [t or "" for t in part.column("text").to_pylist()]
                p = model.pool([t.encode() for t in texts]) if model.langs else np.zeros((len(texts), 1))
                known = np.array([bool(model.langs) and has_letter(t) for t in texts], bool)
                best = p.argmax(axis=1)
                lang = [model.langs[j] if ok else "und" for j, ok in zip(best.tolist(), known.tolist(), strict=True)]
                score = np.where(known, p[np.arange(len(p)), best], 0.0)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(lang, pa.string()), pa.array(np.clip(score, 0, 1), pa.float64())], ["doc_id", "lang_pred", "score"])

    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, lang_pred string, score double")
    return found.select("doc_id", F.coalesce(remainder("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")


def language(docs: DataFrame, train_rows: int = TRAIN_ROWS, train_chars: int = TRAIN_CHARS) -> DataFrame:
    """(doc_id, held_out, lang_pred, score): the language of every whole text, a row per input row.

    ``und`` with score 0 for null texts, texts without a letter, and where no language could be learned. Very long
    texts are labelled whole, in segments. Predictions depend on the text alone, so repeated rows agree and ties go to
    the language first by name; of rows that share a doc_id the least text trains, so reruns agree. A null doc_id is not
    held out. An empty table gives no rows; other columns are not read.
    """
    return predict(docs, fit(docs, train_rows, train_chars))
