"""Language identification by a linear-chain conditional random field.

Every word gets a label from affix, character n-gram and lexicon features and from
learned transitions between neighbouring labels, by forward-backward over stretches
of ``SEGMENT`` words; so each language of a code-switched text is found.  The
document's language is the one with the largest share of label probability.

The field is fitted here on a bounded sample of labelled documents; half of the
training stretches join words of two languages, so that switches are learned.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from civiclens.functions.frames import map_frames
from civiclens.llm.common import fold, id_and_text

PER_LANGUAGE, LANGUAGES = 120, 64  # documents of each language, and languages, that are learnt from
BUCKETS = 1 << 15
SEGMENT = 64
ROUNDS, STEP, DECAY = 40, 0.5, 1e-5
CACHE_WORDS = 400_000
BATCH_WORDS = 400_000
UNKNOWN = "und"
_EDGE = re.compile(r"^[\W\d_]+|[\W\d_]+$")


def words_of(text: str) -> list[str]:
    """The words of a whole text that hold a letter, without what stands around."""
    return [w for w in text.lower().split() if w.isalpha() or any(map(str.isalpha, w))]


def word_features(word: str) -> list[int]:
    """Buckets of a word's lexicon, affix and character n-gram features."""
    w = word if word.isalpha() else _EDGE.sub("", word)
    raw = [f"w{w}"]
    raw += [f"p{w[:n]}" for n in (1, 2, 3) if len(w) >= n]
    raw += [f"s{w[-n:]}" for n in (1, 2, 3) if len(w) >= n]
    raw += [w[i : i + 3] for i in range(len(w) - 2)]
    return [zlib.crc32(f.encode("utf-8", "surrogatepass")) % BUCKETS for f in raw]


def _flat(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of all words end to end, where each word's begin, and its weight."""
    lists = [word_features(w) for w in words]
    sizes = np.fromiter(map(len, lists), dtype=np.int64, count=len(lists))
    flat = np.fromiter((f for fs in lists for f in fs), dtype=np.int64, count=int(sizes.sum()))
    return flat, np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64), 1.0 / np.sqrt(np.maximum(sizes, 1))


def marginals(unary: np.ndarray, length: np.ndarray, start: np.ndarray, step: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Label probabilities ``(segments, words, labels)`` by forward-backward, and the
    summed probabilities of neighbouring label pairs.  ``length``: words of each
    segment; what lies beyond has probability 0."""
    n, t, k = unary.shape
    e = np.exp(unary - unary.max(axis=2, keepdims=True))
    inside = np.arange(t)[None, :] < length[:, None]
    trans = np.exp(step)
    a, b = np.zeros((n, t, k)), np.ones((n, t, k))
    cur = np.exp(start)[None, :] * e[:, 0]
    a[:, 0] = cur / cur.sum(axis=1, keepdims=True)
    for i in range(1, t):
        cur = (a[:, i - 1] @ trans) * e[:, i]
        a[:, i] = cur / cur.sum(axis=1, keepdims=True)
    for i in range(t - 2, -1, -1):
        cur = (b[:, i + 1] * e[:, i + 1]) @ trans.T
        cur /= cur.sum(axis=1, keepdims=True)
        b[:, i] = np.where(inside[:, i + 1, None], cur, 1.0)
    p = a * b
    p /= p.sum(axis=2, keepdims=True)
    p *= inside[:, :, None]
    pairs = np.zeros((k, k))
    for i in range(1, t):
        rows = np.flatnonzero(inside[:, i])
        if not len(rows):
            break
        q = a[rows, i - 1][:, :, None] * trans[None] * (b[rows, i] * e[rows, i])[:, None, :]
        pairs += (q / q.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
    return p, pairs


@dataclass
class Field:
    labels: list[str]
    weights: np.ndarray  # buckets x labels
    start: np.ndarray
    step: np.ndarray

    def unary(self, words: list[str]) -> np.ndarray:
        if not words:
            return np.zeros((0, len(self.labels)))
        flat, begin, scale = _flat(words)
        return np.add.reduceat(self.weights[flat], begin, axis=0) * scale[:, None]

    def label_words(self, texts: list[str]) -> list[np.ndarray]:
        """For each text, its words' label probabilities (words x labels)."""
        words = [words_of(t) for t in texts]
        known = sorted({w for ws in words for w in ws})
        place = {w: i for i, w in enumerate(known)}
        u = self.unary(known)
        out = []
        for ws in words:
            p = self._labelled(u, [np.fromiter(map(place.__getitem__, ws), dtype=np.int64, count=len(ws))])
            out.append(p)
        return out

    def _labelled(self, u: np.ndarray, docs: list[np.ndarray]) -> np.ndarray:
        """Word label probabilities of documents' words (rows of ``u``), end to end."""
        k = len(self.labels)
        segments = [d[i : i + SEGMENT] for d in docs for i in range(0, len(d), SEGMENT)]
        if not segments:
            return np.zeros((0, k))
        length = np.fromiter(map(len, segments), dtype=np.int64, count=len(segments))
        padded = np.zeros((len(segments), SEGMENT), dtype=np.int64)
        inside = np.arange(SEGMENT)[None, :] < length[:, None]
        padded[inside] = np.concatenate(segments)
        p, _ = marginals(u[padded], length, self.start, self.step)
        return p[inside]


class Labeller:
    """Documents' languages with a bounded cache of word scores for each worker."""

    def __init__(self, model: Field):
        self.model, self.place, self.u = model, {}, np.zeros((0, len(model.labels)), dtype=np.float32)

    def languages(self, texts: list[str]) -> list[tuple[str, float]]:
        out: list[tuple[str, float]] = []
        held: list[list[str]] = []
        for t in texts:
            held.append(words_of(t))
            if sum(map(len, held)) >= BATCH_WORDS:
                out += self._batch(held)
                held = []
        return out + self._batch(held)

    def _batch(self, docs: list[list[str]]) -> list[tuple[str, float]]:
        m = self.model
        if not docs:
            return []
        if not m.labels:
            return [(UNKNOWN, 0.0)] * len(docs)
        if len(self.place) > CACHE_WORDS:
            self.place, self.u = {}, self.u[:0]
        new = sorted({w for ws in docs for w in ws if w not in self.place})
        if new:
            self.place.update(zip(new, range(len(self.place), len(self.place) + len(new))))
            self.u = np.concatenate([self.u, m.unary(new).astype(np.float32)])
        rows = [np.fromiter(map(self.place.__getitem__, ws), dtype=np.int64, count=len(ws)) for ws in docs]
        p = m._labelled(self.u, rows)
        out, at = [], 0
        for r in rows:
            if not len(r):
                out.append((UNKNOWN, 0.0))
                continue
            share = p[at : at + len(r)].mean(axis=0)
            at += len(r)
            best = int(share.argmax())
            out.append((m.labels[best], float(min(1.0, share[best]))))
        return out


def train(texts: list[str], langs: list[str], seed: int = 0) -> Field:
    """A field from labelled documents; without any, one that knows no language."""
    labels = sorted(set(langs))
    k = len(labels)
    if not labels:
        return Field([], np.zeros((BUCKETS, 0)), np.zeros(0), np.zeros((0, 0)))
    docs = [(words_of(t), labels.index(g)) for t, g in zip(texts, langs)]
    known = sorted({w for ws, _ in docs for w in ws})
    place = {w: i for i, w in enumerate(known)}
    pieces = [([place[w] for w in ws[i : i + SEGMENT]], y) for ws, y in docs for i in range(0, len(ws), SEGMENT)]
    if not known:
        return Field(labels, np.zeros((BUCKETS, k)), np.zeros(k), np.zeros((k, k)))
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(pieces))
    rows, gold = [], []
    for at, i in enumerate(order):
        ids, y = pieces[i]
        tags = [y] * len(ids)
        if at % 2 and k > 1:  # a switch between two stretches
            other, z = pieces[order[at - 1]]
            cut, from_other = len(ids) // 2, max(1, len(other) // 2)
            ids, tags = ids[:cut] + other[:from_other], tags[:cut] + [z] * from_other
        rows.append(ids[:SEGMENT])
        gold.append(tags[:SEGMENT])
    length = np.asarray([len(r) for r in rows])
    inside = np.arange(SEGMENT)[None, :] < length[:, None]
    x, y = np.zeros((len(rows), SEGMENT), dtype=np.int64), np.zeros((len(rows), SEGMENT), dtype=np.int64)
    x[inside], y[inside] = np.concatenate(rows), np.concatenate(gold)
    one = np.eye(k)
    flat, begin, scale = _flat(known)
    sizes = np.diff(np.append(begin, len(flat)))
    want = np.zeros((k, k))
    for i in range(1, SEGMENT):
        r = inside[:, i]
        np.add.at(want, (y[r, i - 1], y[r, i]), 1.0)
    field = Field(labels, np.zeros((BUCKETS, k)), np.zeros(k), np.zeros((k, k)))
    squares = [np.full_like(v, 1e-6) for v in (field.weights, field.start, field.step)]
    total = float(inside.sum())
    for _ in range(ROUNDS):
        u = np.add.reduceat(field.weights[flat], begin, axis=0) * scale[:, None]
        p, pairs = marginals(u[x], length, field.start, field.step)
        g = ((one[y] - p) * inside[:, :, None])[inside]
        per_word = np.column_stack([np.bincount(x[inside], g[:, j], len(known)) for j in range(k)]) * scale[:, None]
        spread = np.repeat(per_word, sizes, axis=0)
        gw = np.column_stack([np.bincount(flat, spread[:, j], BUCKETS) for j in range(k)]) / total - DECAY * field.weights
        grads = (gw, (one[y[:, 0]] - p[:, 0]).mean(axis=0), (want - pairs) / total)
        for value, grad, square in zip((field.weights, field.start, field.step), grads, squares):
            square += grad * grad
            value += STEP * grad / np.sqrt(square)
    return field


def labelled_sample(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = PER_LANGUAGE,
    held_out: tuple[int, int] | None = (4, 2),
) -> tuple[list[str], list[str]]:
    """Texts and languages of at most ``per_language`` documents of each of at most
    ``LANGUAGES`` languages (the most frequent), chosen by a hash of the id."""
    known = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(lang_col).alias("lang")).where("doc_id is not null and lang is not null")
    if held_out:
        known = known.where(fold("doc_id", held_out[0]) != held_out[1])
    top = known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "lang").limit(LANGUAGES).select("lang")
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    chosen = (
        known.join(F.broadcast(top), "lang", "left_semi").withColumn("place", F.row_number().over(order)).where(F.col("place") <= per_language)
    ).select("doc_id", "lang")
    bound = per_language * LANGUAGES
    rows = id_and_text(docs, id_col, text_col).join(F.broadcast(chosen), "doc_id").orderBy("doc_id", "lang", "text").limit(bound).collect()
    return [r["text"] for r in rows], [r["lang"] for r in rows]


def identify(docs: DataFrame, model: Field, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, lang_pred, score`` of every whole text, one row per input row; a
    text without a letter (NULL and empty too) is ``und`` with score 0."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def label(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        labeller = Labeller(shared.value)
        for f in frames:
            got = labeller.languages(f["text"].tolist())
            yield pd.DataFrame(
                {"doc_id": f["doc_id"], "lang_pred": [g for g, _ in got], "score": np.asarray([s for _, s in got], dtype=float)}
            )

    return map_frames(id_and_text(docs, id_col, text_col), label, "doc_id long, lang_pred string, score double")
