"""Document fingerprints by a homomorphic multiset hash.

A paragraph is hashed to a wide vector: four 64-bit lanes of its whole text, and
``LANES`` 32-bit lanes to which each pair of neighbouring words adds or subtracts
one.  A document's fingerprint is the sum of its paragraphs' vectors, modulo 2^64
and 2^32 (no text has 2^31 pairs, so the narrow lanes keep their sign).  So it doesn't depend on the order of paragraphs, a paragraph is added
or taken away by its vector alone, equal multisets have equal fingerprints, and
the narrow lanes of two fingerprints tell how much the documents share.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from civiclens.functions.frames import map_frames
from civiclens.llm.common import bounded_batches, shuffle_width
from civiclens.llm.jaccard_join import _WORDS, mixed

LANES = 128
SAMPLED, BLOCKS = 16, 4  # rows sampled and blocks cut for each shuffle partition
ROWS = 1024  # results handed over at a time: two fingerprints each
_U = np.uint64


class Fingerprint:
    """``whole``: 4 lanes modulo 2^64; ``shared``: LANES lanes modulo 2^32."""

    __slots__ = ("whole", "shared")

    def __init__(self, whole: np.ndarray | None = None, shared: np.ndarray | None = None):
        self.whole = np.zeros(4, dtype=np.uint64) if whole is None else whole
        self.shared = np.zeros(LANES, dtype=np.uint32) if shared is None else shared

    def __add__(self, other: Fingerprint) -> Fingerprint:
        return Fingerprint(self.whole + other.whole, self.shared + other.shared)

    def __sub__(self, other: Fingerprint) -> Fingerprint:
        return Fingerprint(self.whole - other.whole, self.shared - other.shared)

    def __eq__(self, other: object) -> bool:
        return isinstance(other, Fingerprint) and bool((self.whole == other.whole).all() and (self.shared == other.shared).all())

    __hash__ = None

    def text(self) -> str:
        return base64.b64encode(self.whole.astype("<u8").tobytes() + self.shared.astype("<u4").tobytes()).decode()

    @staticmethod
    def read(text: str) -> Fingerprint:
        raw = base64.b64decode(text)
        return Fingerprint(np.frombuffer(raw[:32], dtype="<u8").copy(), np.frombuffer(raw[32:], dtype="<u4").copy())

    def likeness(self, other: Fingerprint) -> float:
        """1 for equal fingerprints, else the cosine of the narrow lanes, at least 0."""
        if self == other:
            return 1.0
        a, b = self.shared.view(np.int32).astype(np.float64), other.shared.view(np.int32).astype(np.float64)
        norm = float(np.sqrt((a @ a) * (b @ b)))
        return float(min(1.0, max(0.0, a @ b / norm))) if norm else 0.0


def paragraphs(text: str) -> list[str]:
    """The lines of a text that hold more than white space."""
    return [p for p in text.split("\n") if p and not p.isspace()]


def fingerprint(text: str) -> Fingerprint:
    """The sum over a whole text's paragraphs."""
    import xxhash

    parts = paragraphs(text)
    if not parts:
        return Fingerprint()
    whole = [0, 0, 0, 0]
    words: list[bytes] = []
    ends: list[int] = []
    for p in parts:
        raw = p.encode("utf-8", "surrogatepass")
        for seed in (0, 1):
            h = xxhash.xxh3_128_intdigest(raw, seed)
            whole[2 * seed] += h & 0xFFFFFFFFFFFFFFFF
            whole[2 * seed + 1] += h >> 64
        words += raw.split()
        ends.append(len(words))
    h = np.fromiter(map(_WORDS.__getitem__, words), dtype=np.uint64, count=len(words))
    last = np.zeros(len(words), dtype=bool)
    sizes = np.diff([0, *ends])
    marks = np.asarray(ends)[sizes > 0] - 1
    last[marks] = True
    pairs = mixed(h[:-1] * _U(0x100000001B3) + h[1:], 7)[~last[:-1]]
    lone = mixed(h[np.asarray(ends)[sizes == 1] - 1], 8)  # paragraphs of one word
    units = np.concatenate([pairs, lone])
    signs = np.where((units >> _U(32)) & _U(1), 1.0, -1.0)
    shared = np.bincount((units % _U(LANES)).astype(np.int64), signs, LANES).astype(np.int64)
    return Fingerprint(np.asarray([w & 0xFFFFFFFFFFFFFFFF for w in whole], dtype=np.uint64), (shared & 0xFFFFFFFF).astype(np.uint32))


def edited(text: str, following: str) -> str:
    """The last half of a text replaced by as much of the beginning of another."""
    k = len(text) // 2
    return text[: len(text) - k] + following[:k]


def fingerprint_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every document and of its text edited with the next one.

    The next document is that with the next smaller id (after the smallest: the
    largest).  Returns ``doc_id, n_chars, edited_sha256, fingerprint,
    edited_fingerprint, near_edited, near_next``, one row per input row.  NULL text
    counts as empty; the empty text's fingerprint is all zero.  A NULL id comes
    after all others; rows that share an id follow each other by their text's
    hash.  A single document is its own next one.

    Rows are ordered by id from the largest, then by their text's hash, then by
    their place in the input.  The order is cut into blocks at sampled rows, four to a
    partition; a row that a block begins with is also the end of the block before, so one
    shuffle of the texts gives each document its neighbour.  A repeated id is cut like
    any other rows.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    width = shuffle_width(spark)
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        # descending ids as ascending places: the bits turned over, NULL last
        F.when(F.col(id_col).isNull(), F.lit(1)).otherwise(F.lit(0)).alias("last"),
        F.coalesce(F.bitwise_not(F.col(id_col).cast("long")), F.lit(0).cast("long")).alias("place"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
        F.monotonically_increasing_id().alias("line"),
    ).withColumn("order", F.xxhash64("text"))
    key = ("last", "place", "order", "line")
    sample = sorted(tuple(r) for r in rows.select(*key).orderBy(F.xxhash64(*key)).limit(SAMPLED * width).collect())
    first = rows.select(*key).orderBy(*key).limit(1).collect()  # the blocks go round: the first row ends the last one
    blocks = min(len(sample), BLOCKS * width)
    heads = sorted({*(tuple(r) for r in first), *(sample[i * len(sample) // blocks] for i in range(blocks))}) if sample else []
    shared = spark.sparkContext.broadcast(heads)  # at most BLOCKS * width + 1 rows of four numbers

    @F.pandas_udf("array<int>")
    def blocks_of(last: pd.Series, place: pd.Series, order: pd.Series, line: pd.Series) -> pd.Series:
        """The block of a row, and the block it ends, if it begins one."""
        heads, out = shared.value, []
        for k in zip(last.tolist(), place.tolist(), order.tolist(), line.tolist()):
            at = bisect.bisect_right(heads, k) - 1
            out.append([at, (at - 1) % len(heads)] if heads[at] == k else [at])
        return pd.Series(out)

    dealt = (
        rows.select("doc_id", "text", *key, F.posexplode(blocks_of(*key)).alias("ends", "block"))
        .repartitionById(max(1, len(heads)), "block")
        .sortWithinPartitions("block", "ends", *key)
    )
    schema = (
        "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    )

    def walk(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None  # (block, doc_id, text, fingerprint) of the row before
        for f in frames:
            out = []
            for block, doc_id, text in zip(f["block"], f["doc_id"], f["text"]):
                own = fingerprint(text)
                if held is not None and held[0] == block:
                    t, mark = held[2], held[3]
                    changed = edited(t, text)
                    other = fingerprint(changed)
                    digest = hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest()
                    out.append((held[1], len(t), digest, mark.text(), other.text(), mark.likeness(other), mark.likeness(own)))
                    if len(out) == ROWS:
                        yield results(out)
                        out = []
                held = (block, doc_id, text, own)
            yield results(out)

    def results(out: list[tuple]) -> pd.DataFrame:
        result = pd.DataFrame(out, columns=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])
        return result.assign(doc_id=pd.array(result["doc_id"].tolist(), dtype="Int64"))

    return map_frames(dealt.select("block", "ends", "doc_id", "text"), walk, schema)
