"""Toxicity by compression distance.

Two zstandard dictionaries are trained, one for each class.  Both begin with the
commonest words; one goes on with the strings of the toxic training documents that
are far likelier there, the other with as many bytes of ordinary words.  The strings
are parts of words, whole words of up to three bytes, and sequences of words none of
which is such a string itself.  A window that the toxic dictionary compresses shorter
is toxic evidence.  Windows are

* words with a space on each side, written three times over (zstandard stores very
  short blocks as they are); words of up to three bytes, which are too short for a
  match, are written with another mark after each repeat, so that only a dictionary
  that holds them so shortens them; a worker compresses a repeated word once,
* overlapping byte windows of words over ``WINDOW_BYTES``,
* every ``STRIDE`` words the next ``WINDOW_WORDS`` words, written twice.

The document's score is a logistic function, fitted on labelled documents that
the dictionaries have not seen, of its strongest and its summed evidence in words,
its length, and its strongest and its summed evidence in windows of many words.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from civiclens.functions.frames import freed_after, map_frames
from civiclens.llm.common import bounded_batches, fold, id_and_text

MAX_TOXIC, MAX_ORDINARY = 1500, 3000  # labelled documents of each class that are learnt from
BASE_BYTES, CLASS_BYTES = 8192, 32768
GRAM = 5  # bytes of the strings whose counts in the classes are compared
LEAST_DOCS, LEAST_SHARE, LEAST_RATIO = 3, 0.006, 20.0  # a toxic string is in so many (and such a share of the) toxic documents, and so many times likelier there
WINDOW_BYTES = 48  # longer words (links, runs without space) are cut into such windows, each half over the next
WINDOW_WORDS, STRIDE = 16, 8  # so a sequence of 9 words lies in one window
SHORT = 3  # bytes of a word that is too short for a match
REPEATS = 3
CHANCE = 1e-7  # the most likely that a toxic string's count may be if it were as frequent in ordinary text
FOLDS = 4
EVIDENCE = 3  # bytes saved from which a window counts
CACHE_ENTRIES = 500_000


_EDGE = b".,;:!?\"'()"


def words_of(text: str) -> list[bytes]:
    return [w for w in (x.strip(_EDGE) for x in text.lower().encode("utf-8", "replace").split()) if w]


def _cut(words: list[bytes]) -> list[bytes]:
    """Words, the long ones as overlapping byte windows."""
    if any(len(w) > WINDOW_BYTES for w in words):
        half = WINDOW_BYTES // 2
        words = [w[i : i + WINDOW_BYTES] for w in words for i in range(0, max(1, len(w) - half), half)]
    return words


def windows(text: str) -> list[bytes]:
    """The word windows of a whole text, in order."""
    return _cut(words_of(text))


def word_windows(words: list[bytes]) -> list[bytes]:
    """The overlapping windows of many words; long words are in none."""
    if any(len(w) > WINDOW_BYTES for w in words):
        words = [w if len(w) <= WINDOW_BYTES else b"" for w in words]
    return [b" ".join(words[i : i + WINDOW_WORDS]) for i in range(0, max(1, len(words) - STRIDE), STRIDE)] if len(words) > 1 else []


def _padded(word: bytes) -> bytes:
    return b" " + word + b" "


def _marked(word: bytes) -> bytes:
    """A short word, another mark after each repeat."""
    return b"".join(word + bytes([i]) for i in range(1, 7))


def _grams(word: bytes) -> set[bytes]:
    w = _padded(word)
    return {w[i : i + GRAM] for i in range(max(1, len(w) - GRAM + 1))}


def _spans(word: bytes, marks: set[bytes]) -> list[bytes]:
    """The stretches of a word that marked strings cover."""
    w, out, start, end = _padded(word), [], -1, -1
    for i in range(max(1, len(w) - GRAM + 1)):
        if w[i : i + GRAM] in marks:
            if i > end:
                if end > 0:
                    out.append(w[start:end])
                start = i
            end = i + GRAM
    return out + [w[start:end]] if end > 0 else out


def _filled(size: int, strings: list[bytes]) -> bytes:
    """Strings, the first ones last (the nearest are the cheapest to refer to), up
    to about ``size`` bytes."""
    out: list[bytes] = []
    for x in strings:
        if size <= 0:
            break
        out.append(x + b"\n")  # no match goes on from one string into the next
        size -= len(out[-1])
    return b"".join(reversed(out))


@dataclass
class Model:
    toxic: bytes
    ordinary: bytes
    weights: tuple[float, ...]  # of 1 and the values of evidence()

    def __post_init__(self) -> None:
        self._compress = None

    def __getstate__(self) -> dict:
        return {"toxic": self.toxic, "ordinary": self.ordinary, "weights": self.weights, "_compress": None}

    def saved(self, window: bytes) -> int:
        """Bytes that the toxic dictionary saves on a word against the ordinary one."""
        return self._saved(_marked(window) if len(window) <= SHORT else _padded(window) * REPEATS)

    def _saved(self, w: bytes) -> int:
        if self.toxic == self.ordinary:
            return 0
        if self._compress is None:
            import zstandard

            params = zstandard.ZstdCompressionParameters(
                strategy=zstandard.STRATEGY_LAZY2, min_match=4, window_log=17, hash_log=15, chain_log=16, search_log=7, target_length=64,
                write_content_size=False, write_checksum=False, write_dict_id=False,
            )
            pair = []
            for content in (self.ordinary, self.toxic):
                content += b"\n" * 16  # a dictionary's last bytes are never matched
                d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                d.precompute_compress(compression_params=params)
                pair.append(zstandard.ZstdCompressor(dict_data=d, compression_params=params).compress)
            self._compress = pair
        ordinary, toxic = self._compress
        return len(ordinary(w)) - len(toxic(w))

    def evidence(self, text: str, seen: dict[bytes, int]) -> tuple[float, ...]:
        """Of the words: the strongest, the sum over those that count, their number.
        Of the windows of many words: the strongest, the sum over those that count."""
        if len(seen) > CACHE_ENTRIES:
            seen.clear()
        whole = words_of(text)
        words = _cut(whole)
        for w in set(words):
            if w not in seen:
                seen[w] = self.saved(w)
        got = [v for v in map(seen.__getitem__, words) if v >= EVIDENCE]
        many = [v * n for v, n in ((self._saved((b" " + w + b" ") * 2), n) for w, n in Counter(word_windows(whole)).items()) if v >= EVIDENCE]
        return (
            float(max(got, default=0)), math.log1p(sum(got)), math.log1p(len(words)) if got or many else 0.0,
            float(max(many, default=0)), math.log1p(sum(many)),
        )

    def score(self, evidence: tuple[float, ...]) -> float:
        x = self.weights[0] + sum(w * v for w, v in zip(self.weights[1:], evidence))
        return 1.0 / (1.0 + math.exp(-max(-30.0, min(30.0, x))))


def _log_tail(n: int, mean: float) -> float:
    """log of a bound on the chance that a Poisson count reaches ``n``."""
    if mean >= n:
        return 0.0
    return -mean + n * math.log(mean) - math.lgamma(n + 1) - math.log(1 - mean / (n + 1))


def _likelier(n: int, others: int, scale: float, least: int) -> bool:
    """Whether a string of ``n`` toxic and ``others`` ordinary documents is toxic."""
    return n >= least and n * scale >= LEAST_RATIO * max(others, 0.5) and _log_tail(n, (others + 0.5) / scale) < math.log(CHANCE)


def _strings(word: bytes, marks: set[bytes]) -> list[bytes]:
    """What of a word goes into the toxic dictionary."""
    if len(word) <= SHORT:
        return [_marked(word)] if _padded(word) in marks else []
    return [x for x in _spans(word, marks) if len(x) > GRAM]


def sequences(toxic: list[str], ordinary: list[str], scale: float, least: int, marks: set[bytes]) -> Counter:
    """Sequences of words that are far likelier in toxic documents, and in how many
    of them they are.  None of their words is toxic itself.  Sequences that overlap
    are joined; the longest ones compared have ``WINDOW_WORDS`` words.  Toxic documents
    in which the words before and after are the same too count once: they are copies."""
    docs: Counter = Counter()
    for t in toxic:
        docs.update(set(words_of(t)))
    names = sorted(w for w, n in docs.items() if n >= least and len(w) <= WINDOW_BYTES and not _strings(w, marks))
    ids = {w: i for i, w in enumerate(names)}
    parts: list[np.ndarray] = []
    marks_of: list[np.ndarray] = []
    for t in (*toxic, *ordinary):
        words = [*words_of(t), b""]  # no sequence goes on from one document into the next
        parts.append(np.asarray([ids.get(w, -1) for w in words], dtype=np.int64))
        marks_of.append(np.asarray([zlib.crc32(w) for w in words], dtype=np.uint64))
    if not names or not parts:
        return Counter()
    word = np.concatenate(parts)
    mark = np.concatenate([[np.uint64(0)], *marks_of])  # of the word before; n + 1 places on: after
    doc = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
    gram, joined = word, np.zeros(len(word), dtype=bool)  # joined: with the word that follows
    for n in range(2, WINDOW_WORDS + 1):
        at = np.flatnonzero((gram[: len(word) - n + 1] >= 0) & (word[n - 1 :] >= 0))
        key = gram[at] * len(names) + word[at + n - 1]
        found, of = np.unique(key, return_inverse=True)
        once = np.unique(of * len(parts) + doc[at])  # a sequence counts once in a document
        is_toxic = once % len(parts) < len(toxic)
        counts = [np.bincount(once[x] // len(parts), minlength=len(found)) for x in (is_toxic, ~is_toxic)]
        often = counts[0] >= least  # longer ones are rare where a part is
        inside = often[of] & (doc[at] < len(toxic))
        places = np.unique(np.stack([of[inside].astype(np.uint64), mark[at[inside]] << np.uint64(32) | mark[at[inside] + n + 1]]), axis=1)[0]
        apart = np.minimum(counts[0], np.bincount(places.astype(np.int64), minlength=len(found)))
        chosen = np.zeros(len(found), dtype=bool)
        for i in np.flatnonzero(apart * scale >= LEAST_RATIO * np.maximum(counts[1], 0.5)):
            chosen[i] = _likelier(int(apart[i]), int(counts[1][i]), scale, least)
        for i in range(n - 1):
            joined[at[chosen[of]] + i] = True
        if not often.any():
            break
        gram = np.full(len(word), -1, dtype=np.int64)
        gram[at[often[of]]] = (np.cumsum(often) - 1)[of[often[of]]]
    joined &= doc < len(toxic)
    edge = np.diff(np.concatenate([[0], joined.astype(np.int8), [0]]))
    got: set[tuple[int, bytes]] = set()
    for a, b in zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist()):
        line = [names[i] for i in word[a : b + 1]]
        got.update((int(doc[a]), b" " + w + b" ") for w in (word_windows(line)))
    return Counter(x for _, x in got)


def dictionaries(toxic: Iterable[str], ordinary: Iterable[str]) -> tuple[bytes, bytes]:
    """The two dictionaries' contents from texts of the two classes."""
    toxic, ordinary = list(toxic), list(ordinary)
    in_toxic: Counter = Counter()
    in_ordinary: Counter = Counter()
    for texts, count in ((toxic, in_toxic), (ordinary, in_ordinary)):
        for t in texts:
            grams: set[bytes] = set()
            for w in set(words_of(t)):
                grams |= _grams(w)
            count.update(grams)
    scale = max(1, len(ordinary)) / max(1, len(toxic))
    least = max(LEAST_DOCS, math.ceil(LEAST_SHARE * len(toxic)))
    marks = {g for g, n in in_toxic.items() if _likelier(n, in_ordinary[g], scale, least)}
    spans: Counter = Counter()
    for t in toxic:
        of: set[bytes] = set()
        for w in set(windows(t)):
            of.update(_strings(w, marks))
        spans.update(of)
    spans.update(sequences(toxic, ordinary, scale, least, marks))
    plain: Counter = Counter()
    for t in ordinary:
        plain.update(b" " + w + b" " for w in set(windows(t)))
    common = [w for w, _ in sorted(plain.items(), key=lambda x: (-x[1], zlib.crc32(x[0]), x[0]))]
    base = _filled(BASE_BYTES, common)
    marked = _filled(CLASS_BYTES, [w for w, _ in sorted(spans.items(), key=lambda x: (-x[1], x[0]))])
    other = _filled(len(marked), common[len(common) // 2 :])
    return base + marked, base + other


def _logistic(x: np.ndarray, y: np.ndarray, rounds: int = 50, ridge: float = 1e-2) -> np.ndarray:
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        w += np.clip(np.linalg.solve(h, x.T @ (y - p) - ridge * w), -5, 5)
    return w


def train(texts: list[str], labels: list[int]) -> Model:
    """Dictionaries from all texts; the score's weights from folds whose evidence
    is taken with the dictionaries of the other folds.  Without both classes the score
    is the share of toxic labels (0 if there are none)."""
    y = np.asarray(labels, dtype=float)
    if not len(y) or y.min() == y.max():
        rate = float(y.mean()) if len(y) else 0.0
        return Model(b"", b"", (math.log((rate + 1e-9) / (1 - rate + 1e-9)),))
    of = np.where(y == 1, np.cumsum(y == 1), np.cumsum(y == 0)) % FOLDS  # folds of both classes
    x = np.zeros((len(y), 5))
    for h in range(FOLDS):
        learn = [i for i in range(len(y)) if of[i] != h]
        m = Model(*dictionaries([texts[i] for i in learn if y[i]], [texts[i] for i in learn if not y[i]]), ())
        seen: dict[bytes, int] = {}
        for i in np.flatnonzero(of == h):
            x[i] = m.evidence(texts[i], seen)
    toxic, ordinary = dictionaries([t for t, v in zip(texts, y) if v], [t for t, v in zip(texts, y) if not v])
    return Model(toxic, ordinary, tuple(_logistic(x, y).tolist()))


def labelled_sample(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
    max_toxic: int = MAX_TOXIC, max_ordinary: int = MAX_ORDINARY, held_out: tuple[int, int] | None = (5, 0),
) -> tuple[list[str], list[int]]:
    """Texts and labels of at most ``max_toxic`` and ``max_ordinary`` labelled rows,
    chosen by a hash of the id; rows of the held-out fold are never among them."""
    known = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("y")).where(
        F.col("doc_id").isNotNull() & F.col("y").isin(0, 1)
    )
    if held_out:
        known = known.where(fold("doc_id", held_out[0]) != held_out[1])
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    chosen = known.where("y = 1").orderBy(*order).limit(max_toxic).unionByName(known.where("y = 0").orderBy(*order).limit(max_ordinary))
    rows = (
        id_and_text(docs, id_col, text_col).join(F.broadcast(chosen), "doc_id").orderBy(*order, "y").limit(max_toxic + max_ordinary).collect()
    )
    return [r["text"] for r in rows], [r["y"] for r in rows]


def score_documents(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, score double`` of every whole text, one row per input row.  NULL
    and empty texts have no evidence and get the lowest score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m, seen = shared.value, {}
        for f in frames:
            scores = [m.score(m.evidence(t, seen)) for t in f["text"]]
            yield pd.DataFrame({"doc_id": f["doc_id"], "score": np.asarray(scores, dtype=float)})

    return map_frames(id_and_text(docs, id_col, text_col), score, "doc_id long, score double")


def drop_toxic(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that score under ``threshold``, all columns kept."""
    bounded_batches(docs.sparkSession)
    scores = score_column(model, docs)
    return docs.where(scores(F.coalesce(F.col(text_col), F.lit(""))) < threshold)


def score_column(model: Model, docs: DataFrame):
    """The score as a pandas UDF of a text column."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def scores(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        m, seen = shared.value, {}
        for text in texts:
            yield pd.Series([m.score(m.evidence(t, seen)) for t in text], dtype=float)

    @F.pandas_udf("double")
    def score(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        yield from freed_after(scores)(texts)

    return score
