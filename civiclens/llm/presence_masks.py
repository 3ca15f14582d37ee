"""Ranked lexical search by presence masks.

For each item (a query text) the documents of a block are grouped by which of the
item's terms they hold: the block has one bitmap per term, and an item's bitmaps side
by side give each document its mask.  A mask's maximum score is the sum of the most
that each of its terms adds to a document of the block.  Masks are evaluated by
descending maximum until the item's k-th best score lies above the next maximum;
documents under the masks that are left are never scored.  Best scores are carried
from block to block of a partition, so later blocks finish sooner.

Two passes over the documents: the first counts each document's terms and writes
those that items hold; number of documents, lengths and document frequencies are
aggregates of that table.  The second walks its blocks.  No document is shuffled: what
meets is at most k rows per item and partition, taken first per slice of an item.

Items are dealt into shards of about ``ITEM_BYTES`` of text by a hash (measured first;
one shard for a usual set), and a shard's terms are what is broadcast.

Weights and scores are whole numbers (see ``term_weights`` and ``parts``).  Defined
results: a NULL or empty text has no term; equal scores rank by ascending doc_id, NULL
last, then by the text's number of terms and its hash; repeated rows are documents of
their own; each row of items is an item of its own, also where ids repeat or are NULL.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from civiclens.llm.common import id_and_text, written

ITEM_BYTES = 8 << 20  # of a shard's item texts
BLOCK_BYTES = 16 << 20  # of a block's bitmaps while they are one byte per bit
BLOCK_DOCS = 4096
STEP_DOCS = 16  # documents scored before the next look at the maximum
SLICES = 64  # of an item's best rows before the last ranking

#: bytes of a term: digits, ASCII letters (capitals as small ones) and all of other characters; the rest parts terms
_TERM_BYTES = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256)
)


def terms_of(text: str) -> list[bytes]:
    """The terms of a whole text in order: the longest runs without ASCII marks,
    controls and spaces, A to Z as small letters."""
    return text.encode("utf-8", "surrogatepass").translate(_TERM_BYTES).split()


def term_weights(df: np.ndarray, n_docs: int) -> np.ndarray:
    """floor(1000 ln((2N+2)/(2df+1))) per term."""
    return np.asarray([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * d + 1))) for d in df.tolist()], dtype=np.int64)


def parts(tf: np.ndarray, n: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """What one unit of a term's weight adds: (10^9 tf) div (1000 tf + 8 m) with
    m = 100 - 90 + ((90 n N) div L)."""
    if len(n) and 90 * int(n.max()) * n_docs >= 1 << 63:
        m = np.asarray([10 + 90 * x * n_docs // n_terms for x in n.tolist()], dtype=np.int64)
    else:
        m = 10 + 90 * n * n_docs // max(1, n_terms)
    return 1_000_000_000 * tf // (1000 * tf + 8 * m)


class Best:
    """The k best (score, place) rows of one item; places break ties."""

    __slots__ = ("k", "rows", "least")

    def __init__(self, k: int):
        self.k, self.rows, self.least = k, [], 1  # only scores above 0 count

    def add(self, rows: list[tuple]) -> None:
        rows = [r for r in rows if r[0] >= self.least]
        if rows:
            self.rows = sorted(self.rows + rows, key=lambda r: (-r[0], r[1]))[: self.k]
            if len(self.rows) == self.k:
                self.least = self.rows[-1][0]


class Block:
    """Some documents' postings by term."""

    def __init__(self, doc: np.ndarray, term: np.ndarray, gain: np.ndarray, n_docs: int, n_terms: int):
        order = np.argsort(term, kind="stable")
        self.n_docs = n_docs
        self.keys = term[order].astype(np.int64) * n_docs + doc[order]
        self.gain = gain[order]
        self.present = np.zeros((n_terms, n_docs), dtype=np.uint8)
        self.present[term, doc] = 1
        self.most = np.zeros(n_terms, dtype=np.int64)
        if len(term):
            found, begin = np.unique(term[order], return_index=True)
            self.most[found] = np.maximum.reduceat(self.gain, begin)

    def scores(self, terms: np.ndarray, docs: np.ndarray) -> np.ndarray:
        """The whole scores of some documents."""
        held = self.present[terms[:, None], docs[None, :]] == 1
        at = np.searchsorted(self.keys, (terms[:, None] * self.n_docs + docs[None, :])[held])
        out = np.zeros(held.shape, dtype=np.int64)
        out[held] = self.gain[at]
        return out.sum(0)

    def rank(self, terms: np.ndarray, best: Best, place) -> int:
        """Adds the block's documents to an item's best; the number of documents
        that were scored.  ``place``: a document's tie-breaking key and identity."""
        most = self.most[terms]
        if int(most.sum()) < best.least:
            return 0
        bits = np.packbits(self.present[terms], axis=0).T  # document, byte of its mask
        wide = np.zeros((self.n_docs, -(-bits.shape[1] // 8) * 8), dtype=np.uint8)
        wide[:, : bits.shape[1]] = bits
        words = wide.view(np.uint64)
        if words.shape[1] == 1:
            _, first, of = np.unique(words[:, 0], return_index=True, return_inverse=True)
        else:
            _, first, of = np.unique(words, axis=0, return_index=True, return_inverse=True)
        of = of.reshape(-1)
        maxima = self.present[terms][:, first].T.astype(np.int64) @ most
        masks = np.argsort(-maxima, kind="stable")
        members = np.argsort(of, kind="stable")
        begin = np.searchsorted(of[members], np.arange(len(first) + 1))
        at = scored = 0
        while at < len(masks) and maxima[masks[at]] >= best.least:
            chosen, size = [], 0
            while at < len(masks) and size < STEP_DOCS and maxima[masks[at]] >= best.least:
                chosen.append(members[begin[masks[at]] : begin[masks[at] + 1]])
                size += len(chosen[-1])
                at += 1
            docs = np.concatenate(chosen)
            got = self.scores(terms, docs)
            good = np.flatnonzero(got >= best.least)
            best.add([(int(got[i]), place(int(docs[i]))) for i in good])
            scored += size
        return scored


def _profiles(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """Per document with a term: its number of terms, and of the items' terms their
    numbers and how often they occur."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for b in batches:
            rows, ends, terms, counts = [], [0], [], []
            for i, text in enumerate(b.column("text").to_pylist()):
                words = terms_of(text)
                if not words:
                    continue
                of = Counter(filter(None, map(known.get, words)))
                rows.append((i, len(words)))
                terms.extend(of)
                counts.extend(of.values())
                ends.append(len(terms))
            if rows:
                offsets = pa.array(ends, pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column("doc_id").take(pa.array([i for i, _ in rows])), b.column("mark").take(pa.array([i for i, _ in rows])),
                        pa.array([n for _, n in rows], pa.int64()), pa.ListArray.from_arrays(offsets, pa.array(terms, pa.int32())),
                        pa.ListArray.from_arrays(offsets, pa.array(counts, pa.int64())),
                    ],
                    names=["doc_id", "mark", "n", "terms", "counts"],
                )

    return docs.withColumn("mark", F.xxhash64("text")).mapInArrow(run, "doc_id long, mark long, n long, terms array<int>, counts array<long>")


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.diff(column.offsets.to_numpy())
    return sizes, column.flatten().to_numpy(zero_copy_only=False)


def _best_rows(profiles: DataFrame, items: list[np.ndarray], weights: np.ndarray, n_docs: int, n_terms: int, k: int) -> DataFrame:
    """``item, doc_id, n, mark, score, scored`` of each partition's best."""
    shared = profiles.sparkSession.sparkContext.broadcast((items, weights))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, weights = shared.value
        best = [Best(k) for _ in items]
        scored = [0] * len(items)
        size = max(64, min(BLOCK_DOCS, BLOCK_BYTES // max(1, len(weights))))
        for batch in batches:
            for at in range(0, batch.num_rows, size):
                b = batch.slice(at, size)
                sizes, terms = _flat(b.column("terms"))
                counts = _flat(b.column("counts"))[1]
                n = b.column("n").to_numpy()
                ids, marks = b.column("doc_id").to_pylist(), b.column("mark").to_pylist()
                doc = np.repeat(np.arange(b.num_rows), sizes)
                gain = weights[terms] * parts(counts, n[doc], n_docs, n_terms)
                block = Block(doc, terms, gain, b.num_rows, len(weights))
                place = lambda i: (ids[i] is None, ids[i] or 0, int(n[i]), marks[i])  # noqa: E731, B023
                for i, of in enumerate(items):
                    if len(of):
                        scored[i] += block.rank(of, best[i], place)
        out = [(i, None if p[0] else p[1], p[2], p[3], s, scored[i]) for i, b in enumerate(best) for s, p in b.rows]
        if out:
            kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=["item", "doc_id", "n", "mark", "score", "scored"])

    return profiles.mapInArrow(run, "item int, doc_id long, n long, mark long, score long, scored long")


def rank_documents(
    docs: DataFrame, items: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text"
) -> DataFrame:
    """``item_id, rank int, doc_id, score long, scored long`` of each item's ``k``
    highest-scoring documents with a score above 0.  ``scored``: how many documents
    of that row's partition were scored for the item."""
    spark = docs.sparkSession
    queries = items.select(F.col(item_col).cast("long").alias("item_id"), F.coalesce(item_text, F.lit("")).alias("text"))
    size = queries.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(1, -(-size // ITEM_BYTES))
    texts = id_and_text(docs, id_col, text_col)
    out = None
    for shard in range(shards):
        rows = queries.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(shards)) == shard).collect()  # about ITEM_BYTES of text
        words = [sorted(set(terms_of(r["text"]))) for r in rows]
        vocabulary = {w: i for i, w in enumerate(sorted({w for ws in words for w in ws}), 1)}  # 0 stands for no term
        if not vocabulary:
            continue
        profiles = written(_profiles(texts, vocabulary), "profiles")
        total = profiles.agg(F.count(F.lit(1)).alias("docs"), F.sum("n").alias("terms")).first()
        df = np.zeros(len(vocabulary) + 1, dtype=np.int64)
        for r in profiles.select(F.explode("terms").alias("term")).groupBy("term").count().collect():  # the shard's terms
            df[r["term"]] = r["count"]
        of_item = [np.asarray([vocabulary[w] for w in ws], dtype=np.int64) for ws in words]
        weights = term_weights(df, total["docs"])
        found = _best_rows(profiles.where(F.size("terms") > 0), of_item, weights, total["docs"], total["terms"] or 0, k)
        order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), "n", "mark"]
        by_slice = Window.partitionBy("item", "slice").orderBy(*order)
        by_item = Window.partitionBy("item").orderBy(*order)
        first = found.withColumn("slice", F.pmod(F.xxhash64("doc_id", "mark"), F.lit(SLICES))).withColumn("place", F.row_number().over(by_slice))
        ranked = first.where(F.col("place") <= k).withColumn("rank", F.row_number().over(by_item)).where(F.col("rank") <= k)
        names = spark.createDataFrame([(i, r["item_id"]) for i, r in enumerate(rows)], "item int, item_id long")  # the shard's items
        part = ranked.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score", "scored")
        out = part if out is None else out.unionByName(part)
    return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long, scored long") if out is None else out
