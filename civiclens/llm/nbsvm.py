"""Quality classification by naive Bayes support vectors.

A text's features say which n-grams occur in it, not how often: sequences of one to
``BYTES`` bytes, and sequences of one to ``SHAPES`` word shapes.  A shape writes a
word's letters and digits by their kind, runs once, and says whether the word is the
one before it again.  Features are hashed to ``BUCKETS`` places.  Each indicator is
scaled by its log-count ratio between the classes, and a text's vector is divided by
the root of its number of features, so long and short texts weigh alike.  A linear
model with hinge loss is fitted to these vectors by dual coordinate descent.  The
score is a logistic function of the margin, fitted on margins of folds that the model
has not seen, each class weighted by its share of all labelled rows.

The model is fitted on at most ``MAX_GOOD`` and ``MAX_BAD`` labelled documents,
chosen by a hash of the id; every document is scored by its whole text.

Defined results: NULL text counts as empty; a text without features has the margin
of the bias alone; one row per input row, repeated and NULL ids too.  Without labels
the score is 0, with labels of one class it is that class's label.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from civiclens.functions.frames import map_frames
from civiclens.llm.common import fold, id_and_text
from civiclens.llm.toxicity import labelled_sample

MAX_GOOD, MAX_BAD = 1500, 1500  # labelled documents of each class that are learnt from
BUCKET_BITS = 18
BUCKETS = 1 << BUCKET_BITS
BYTES, SHAPES = 4, 3
CHUNK = 1 << 20  # bytes of a text that are hashed at a time
CACHE_WORDS = 400_000
PRIOR = 1.0  # added to each feature's count in each class
COST = 1.0  # of the hinge loss against the norm of the weights
ROUNDS, TOLERANCE = 200, 1e-3
FOLDS = 4
_U = np.uint64


def shape(word: str) -> str:
    """``A`` for capitals, ``a`` for other letters, ``0`` for digits, other
    characters as they are; each run once."""
    out = ""
    for c in word:
        kind = "0" if c.isdigit() else ("A" if c.isupper() else "a") if c.isalpha() else c
        if not out or out[-1] != kind:
            out += kind
    return out


class _Words(dict):
    """Word -> its number in ``shapes``, the hashes of the words' shapes."""

    def __init__(self) -> None:
        self.shapes: list[int] = []

    def __missing__(self, word: str) -> int:
        self.shapes.append(zlib.crc32(shape(word).encode("utf-8", "surrogatepass")) << 1)
        self[word] = len(self)
        return self[word]

    def fresh(self) -> None:
        if len(self) > CACHE_WORDS:
            self.clear()
            self.shapes.clear()


def _places(codes: np.ndarray, kind: int) -> np.ndarray:
    h = (codes ^ (codes >> _U(29)) ^ _U(kind << 56)) * _U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> _U(32))) * _U(0x94D049BB133111EB)
    return (h >> _U(64 - BUCKET_BITS)).astype(np.int64)


class Indicators:
    """The features of texts, one after the other."""

    def __init__(self) -> None:
        self.seen = np.zeros(BUCKETS, dtype=bool)
        self.words = _Words()

    def __call__(self, text: str) -> np.ndarray:
        """The places of a whole text's features, ascending."""
        raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8)
        for at in range(0, len(raw), CHUNK):
            part = raw[at : at + CHUNK + BYTES - 1].astype(np.uint64)
            code = part
            for n in range(1, BYTES + 1):
                if n > 1:
                    if len(part) < n:
                        break
                    code = (code[:-1] << _U(8)) | part[n - 1 :]
                self.seen[_places(code, n)] = True
        words = text.split()
        if words:
            self.words.fresh()
            ids = np.fromiter(map(self.words.__getitem__, words), dtype=np.int64, count=len(words))
            same = np.zeros(len(ids), dtype=np.uint64)
            same[1:] = ids[1:] == ids[:-1]
            marks = np.fromiter(map(self.words.shapes.__getitem__, ids.tolist()), dtype=np.uint64, count=len(ids)) | same
            code = marks
            for n in range(1, SHAPES + 1):
                if n > 1:
                    if len(marks) < n:
                        break
                    code = code[:-1] * _U(0x9E3779B97F4A7C15) + marks[n - 1 :]
                self.seen[_places(code, 16 + n)] = True
        places = np.flatnonzero(self.seen)
        self.seen[places] = False
        return places


@dataclass
class Model:
    weights: np.ndarray  # per place: log-count ratio times the fitted weight
    bias: float
    slope: tuple[float, float]  # of the logistic function: constant, margin
    constant: float | None = None  # the score where there is nothing to learn

    def margin(self, places: np.ndarray) -> float:
        return self.bias + (float(self.weights[places].sum()) / len(places) ** 0.5 if len(places) else 0.0)

    def score(self, places: np.ndarray) -> float:
        if self.constant is not None:
            return self.constant
        return float(1 / (1 + np.exp(-np.clip(self.slope[0] + self.slope[1] * self.margin(places), -30, 30))))


def log_count_ratios(rows: list[np.ndarray], y: np.ndarray) -> np.ndarray:
    """Per place: log of the share of the good class's counts over the bad one's."""
    counts = []
    for label in (1, 0):
        of = [r for r, v in zip(rows, y) if v == label]
        c = PRIOR + (np.bincount(np.concatenate(of), minlength=BUCKETS) if of else np.zeros(BUCKETS))
        counts.append(c / c.sum())
    return np.log(counts[0] / counts[1])


def descend(rows: list[np.ndarray], values: list[np.ndarray], y: np.ndarray, cost: float = COST, seed: int = 0) -> tuple[np.ndarray, float, np.ndarray]:
    """Weights, bias and dual variables of the hinge-loss model: each step sets one
    row's dual variable, between 0 and ``cost``, to its best value with the others
    held.  The bias is the weight of a feature that every row has.  Rounds end when
    no step's gradient was over the tolerance."""
    w, bias = np.zeros(BUCKETS), 0.0
    alpha = np.zeros(len(rows))
    signs = np.where(y == 1, 1.0, -1.0)
    squares = np.asarray([float(v @ v) + 1.0 for v in values])
    rng = np.random.default_rng(seed)
    for _ in range(ROUNDS):
        worst = 0.0
        for i in rng.permutation(len(rows)):
            r, v, s = rows[i], values[i], signs[i]
            gradient = s * (float(w[r] @ v) + bias) - 1.0
            free = min(gradient, 0.0) if alpha[i] == 0 else max(gradient, 0.0) if alpha[i] == cost else gradient
            if free:
                worst = max(worst, abs(free))
                new = min(cost, max(0.0, alpha[i] - gradient / squares[i]))
                step = (new - alpha[i]) * s
                w[r] += step * v
                bias += step
                alpha[i] = new
        if worst < TOLERANCE:
            break
    return w, bias, alpha


def _fit(rows: list[np.ndarray], y: np.ndarray) -> tuple[np.ndarray, float]:
    ratios = log_count_ratios(rows, y)
    values = [ratios[r] / max(1, len(r)) ** 0.5 for r in rows]
    w, bias, _ = descend(rows, values, y)
    return w * ratios, bias


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, rounds: int = 100, ridge: float = 1e-3) -> tuple[float, float]:
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(2)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + ridge * np.eye(2)
        w += np.clip(np.linalg.solve(h, x.T @ (weight * (y - p)) - ridge * w), -5, 5)
    return float(w[0]), float(w[1])


def train(texts: list[str], labels: list[int], good_share: float | None = None) -> Model:
    """A model of the sampled texts.  ``good_share``: the share of label 1 among
    all labelled rows (None: that of the sample)."""
    y = np.asarray(labels, dtype=np.int64)
    if not len(y) or y.min() == y.max():
        return Model(np.zeros(BUCKETS), 0.0, (0.0, 0.0), float(y[0]) if len(y) else 0.0)
    indicators = Indicators()
    rows = [indicators(t) for t in texts]
    share = float(y.mean()) if good_share is None else min(1 - 1e-6, max(1e-6, good_share))
    weight = np.where(y == 1, share / y.mean(), (1 - share) / (1 - y.mean()))
    of = np.where(y == 1, np.cumsum(y == 1), np.cumsum(y == 0)) % FOLDS  # folds of both classes
    margins, known = np.zeros(len(y)), np.zeros(len(y), dtype=bool)
    for h in range(FOLDS):
        learn, rest = np.flatnonzero(of != h), np.flatnonzero(of == h)
        if len(rest) and len(set(y[learn].tolist())) == 2:
            m = Model(*_fit([rows[i] for i in learn], y[learn]), (0.0, 1.0))
            margins[rest], known[rest] = [m.margin(rows[i]) for i in rest], True
    weights, bias = _fit(rows, y)
    slope = _logistic(margins[known], y[known], weight[known]) if known.any() else (0.0, 1.0)
    return Model(weights, bias, slope)


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "quality", held_out: tuple[int, int] | None = (5, 0)) -> Model:
    """A model of the labelled documents outside the held-out fold."""
    known = labels.where(fold("doc_id", held_out[0]) != held_out[1]) if held_out else labels
    counts = {r[0]: r[1] for r in known.where(F.col(label_col).isin(0, 1)).groupBy(F.col(label_col).cast("int")).count().collect()}
    texts, y = labelled_sample(docs, labels, label_col=label_col, max_toxic=MAX_GOOD, max_ordinary=MAX_BAD, held_out=held_out)
    return train(texts, y, counts.get(1, 0) / sum(counts.values()) if counts else None)


def score_documents(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, score double`` of every whole text, one row per input row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m, indicators = shared.value, Indicators()
        for f in frames:
            yield pd.DataFrame({"doc_id": f["doc_id"], "score": np.asarray([m.score(indicators(t)) for t in f["text"]], dtype=float)})

    return map_frames(id_and_text(docs, id_col, text_col), score, "doc_id long, score double")
