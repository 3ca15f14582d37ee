"""Repeated passages across documents, found with suffix automata.

A window of ``width`` words is removed when its words also start a window of a
document with a smaller id.  Passages that earlier documents hold are the
reference text; it is cut into shards, each shard becomes a suffix automaton over
words that is sent to every task that needs it, and the candidate spans of other
documents are streamed through it.  Their matching statistics tell, for every
window, whether and in which smallest document it occurs.

Only the shards that can match are sent to a span, not all to all:

1. Every window holds an anchor, its minimal ``GRAM``-word hash; neighbouring windows
   with one anchor are a run of at most ``width - GRAM + 1`` windows.  Tasks note in
   bitmaps of fixed size which anchors they saw once and which in two documents,
   the bitmaps are merged, and runs whose anchor is in one document only are
   done with.  (A full bitmap makes more work, not other results.)
2. The other runs are compared whole, by the hash of all their words: first within some
   documents of a task, so that a passage in very many documents leaves one row for
   those, then over all batches.  A run that an earlier document holds is a repeat of
   it.  Equal windows have equal anchors, so where all runs of an anchor are equal that
   is all; a bitmap notes the anchors whose runs differ, and the windows of such runs
   are compared one by one, in the same two steps.  The first of some equal runs, over
   all batches, stands for the others: it lies in the smallest document, and a second
   bitmap notes where.  Each repeat names an earlier document and place.
3. Neighbouring repeats are the candidate spans, and the places they name are the
   reference passages.  Both go to the earlier document's shard; a shard with
   many spans is sent to several tasks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from civiclens.functions.frames import frame_of, freed_after, map_frames
from civiclens.llm.common import bitmap_of, bounded_batches, id_and_text, ids_in, in_bitmap, likely, release, shuffle_width, written
from civiclens.llm.jaccard_join import EXACT, mixed, word_hashes

WIDTH = 13
GRAM = 7
BITS = 1 << 28
CHUNK_BYTES = 1 << 16
DIFFERING = 1 << 25  # bits of the bitmap of anchors whose runs differ
FIRSTS = 1 << 26  # bits of the bitmap of the places of first runs
SPAN_WORDS = 500_000  # words streamed through one copy of a shard
SLICE = 1500  # documents whose hashes a task holds at once
SLICE_CHARS = 1 << 20
_U = np.uint64
_FACTOR = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str) -> list[bytes]:
    """Words end at space, tab and line ends; nothing is changed."""
    return text.encode("utf-8", "surrogatepass").split()


def _grams(h: np.ndarray, n: int, seed: int) -> np.ndarray:
    """A hash for each run of ``n`` words: a polynomial of their mixed hashes."""
    m = len(h) - n + 1
    x = mixed(h, seed)
    out = x[:m].copy()
    for i in range(1, n):
        out *= _FACTOR
        out += x[i : i + m]
    return mixed(out, seed + 1)


def anchors(h: np.ndarray, width: int = WIDTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """Each window's anchor and the place of the (first) anchor, by the place where
    the window starts."""
    gram = min(gram, width)
    g = _grams(h, gram, 11)
    m = len(h) - width + 1
    out, at = g[:m].copy(), np.arange(m)
    for i in range(1, width - gram + 1):
        x = g[i : i + m]
        less = np.flatnonzero(x < out)
        out[less] = x[less]
        at[less] = less + i
    return out, at


def _runs(texts: list[str], width: int) -> tuple[np.ndarray, ...]:
    """Runs of neighbouring windows of a text that have one anchor.  Of each run: the
    anchor, the text's number, the first window's place in it, the number of windows,
    and its first word's number among the words of all texts, whose hashes come last.
    Windows across two texts are no windows."""
    h, counts = word_hashes(texts, EXACT)
    n = np.maximum(counts - width + 1, 0)
    if not n.sum():
        none = np.zeros(0, dtype=np.int64)
        return none.view(np.uint64), none, none, none, none, h
    doc = np.repeat(np.arange(len(texts)), n)
    place = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
    at = np.repeat(np.cumsum(counts) - counts, n) + place
    value, where = anchors(h, width)
    where = where[at]
    begin = np.flatnonzero(np.concatenate([[True], (where[1:] != where[:-1]) | (doc[1:] != doc[:-1])]))
    length = np.diff(np.concatenate([begin, [len(doc)]]))
    return value[at[begin]], doc[begin], place[begin], length, at[begin], h


def _windows(h: np.ndarray, at: np.ndarray, length: np.ndarray, width: int) -> np.ndarray:
    """The hashes of the windows of some runs, run after run."""
    first = np.repeat(at - (np.cumsum(length) - length), length) + np.arange(int(length.sum()))
    x = mixed(h, 17)
    out = x[first]
    for _ in range(1, width):
        first += 1
        out *= _FACTOR
        out += x[first]
    return mixed(out, 18)


def _mark(doc: np.ndarray, place: np.ndarray) -> np.ndarray:
    """A hash of a document's id and a place in it."""
    return mixed(mixed(doc.view(np.uint64), 31) + place.astype(np.uint64), 32)


def _whole(windows: np.ndarray, length: np.ndarray) -> np.ndarray:
    """A hash of each run from the hashes of its windows, in their order."""
    begin = np.cumsum(length) - length
    within = (np.arange(len(windows)) - np.repeat(begin, length)).astype(np.uint64)
    return mixed(np.add.reduceat(mixed(windows ^ (within * _FACTOR), 23), begin) + length.astype(np.uint64), 24)


class Automaton:
    """Suffix automaton of word sequences; each state knows the smallest document
    that holds its words."""

    def __init__(self) -> None:
        self.next: list[dict] = [{}]
        self.link, self.size, self.owner = [-1], [0], [2**63 - 1]
        self.last, self.breaks = 0, 0

    def add(self, words: list, doc: int) -> None:
        self.breaks -= 1
        for w in words:
            self._extend(w, doc)
        self._extend(self.breaks, doc)  # matches don't go from one passage into the next

    def _extend(self, w, doc: int) -> None:
        nxt, link, size, owner = self.next, self.link, self.size, self.owner
        cur = len(nxt)
        nxt.append({})
        size.append(size[self.last] + 1)
        link.append(0)
        owner.append(doc)
        p = self.last
        while p >= 0 and w not in nxt[p]:
            nxt[p][w] = cur
            p = link[p]
        if p >= 0:
            q = nxt[p][w]
            if size[p] + 1 == size[q]:
                link[cur] = q
            else:
                copy = len(nxt)
                nxt.append(dict(nxt[q]))
                size.append(size[p] + 1)
                link.append(link[q])
                owner.append(2**63 - 1)
                while p >= 0 and nxt[p].get(w) == q:
                    nxt[p][w] = copy
                    p = link[p]
                link[q] = link[cur] = copy
        self.last = cur

    def finish(self) -> Automaton:
        """A state's document is the smallest of its own and of the longer ones that
        end with its words."""
        for v in sorted(range(1, len(self.next)), key=self.size.__getitem__, reverse=True):
            u = self.link[v]
            if self.owner[v] < self.owner[u]:
                self.owner[u] = self.owner[v]
        return self

    def repeats(self, words: list, doc: int, width: int) -> list[tuple[int, int]]:
        """Maximal stretches ``(start, end)`` of the words covered by windows that
        also lie in a smaller document."""
        nxt, link, size, owner = self.next, self.link, self.size, self.owner
        out: list[tuple[int, int]] = []
        v = matched = 0
        for i, w in enumerate(words):
            while v and w not in nxt[v]:
                v = link[v]
                matched = size[v]
            if w in nxt[v]:
                v = nxt[v][w]
                matched += 1
            if matched >= width:
                while size[link[v]] >= width:  # longer contexts than the window don't count
                    v = link[v]
                    matched = size[v]
                if owner[v] < doc:
                    start = i + 1 - width
                    if out and start <= out[-1][1]:
                        out[-1] = (out[-1][0], i + 1)
                    else:
                        out.append((start, i + 1))
        return out


def _put(bitmap: np.ndarray, bits: np.ndarray) -> None:
    """Set sorted distinct bits of a bitmap of bytes."""
    if len(bits):
        at = bits >> 3
        starts = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
        bitmap[at[starts]] |= np.bitwise_or.reduceat(np.uint8(1) << (bits & 7).astype(np.uint8), starts)


def _shared_bits(rows: DataFrame, width: int) -> np.ndarray:
    """The bitmap of anchors that lie in two documents or more."""
    schema = "chunk int, part int, at binary, once binary, twice binary"

    def seen(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        once, twice = np.zeros(BITS // 8, dtype=np.uint8), np.zeros(BITS // 8, dtype=np.uint8)
        for f in _slices(frames):
            anchor, doc, *_ = _runs(f["text"].tolist(), width)
            key = np.unique((anchor % _U(BITS)).astype(np.int64) << 20 | doc)  # a bit counts once in a document
            if len(key):
                bits, docs = np.unique(key >> 20, return_counts=True)
                before = (once[bits >> 3] >> (bits & 7).astype(np.uint8)) & 1 == 1
                _put(once, bits)
                _put(twice, bits[before | (docs > 1)])
        part = TaskContext.get().partitionId() % 64
        out = []
        for c, begin in enumerate(range(0, BITS // 8, CHUNK_BYTES)):
            o = once[begin : begin + CHUNK_BYTES]
            at = np.flatnonzero(o)
            if len(at):
                out.append((c, part, at.astype(np.uint16).tobytes(), o[at].tobytes(), twice[begin : begin + CHUNK_BYTES][at].tobytes()))
            if len(out) == 64:  # few chunks are held a second time
                yield pd.DataFrame(out, columns=["chunk", "part", "at", "once", "twice"])
                out = []
        yield pd.DataFrame(out, columns=["chunk", "part", "at", "once", "twice"])

    def merge(f: pd.DataFrame, last: bool = False) -> pd.DataFrame:
        once, twice = np.zeros(CHUNK_BYTES, dtype=np.uint8), np.zeros(CHUNK_BYTES, dtype=np.uint8)
        for a, o, t in zip(f["at"], f["once"], f["twice"]):
            at, o = np.frombuffer(a, dtype=np.uint16), np.frombuffer(o, dtype=np.uint8)
            twice[at] |= np.frombuffer(t, dtype=np.uint8) | (once[at] & o)
            once[at] |= o
        at = np.flatnonzero(twice if last else once)
        row = (f["chunk"].iloc[0], 0, at.astype(np.uint16).tobytes(), once[at].tobytes(), twice[at].tobytes())
        return pd.DataFrame([row], columns=["chunk", "part", "at", "once", "twice"])

    def merge_part(f: pd.DataFrame) -> pd.DataFrame:
        return merge(f)

    def finish(f: pd.DataFrame) -> pd.DataFrame:
        return merge(f, last=True)

    merged = rows.mapInPandas(freed_after(seen), schema).groupBy("chunk", "part").applyInPandas(merge_part, schema).groupBy("chunk").applyInPandas(finish, schema)
    out = np.zeros(BITS // 8, dtype=np.uint8)
    for r in merged.select("chunk", "at", "twice").collect():  # at most BITS / 8 bytes and their places
        out[r["chunk"] * CHUNK_BYTES + np.frombuffer(r["at"], dtype=np.uint16).astype(np.int64)] = np.frombuffer(r["twice"], dtype=np.uint8)
    return out.view("<u8")


def _slices(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Frames of at most ``SLICE`` documents and about ``SLICE_CHARS`` characters."""
    for f in frames:
        if len(f):
            slot = np.maximum(np.arange(len(f)) // SLICE, 0) + np.cumsum(f["text"].str.len().to_numpy(dtype=np.int64)) // SLICE_CHARS
            for i in np.unique(slot):
                yield f[slot == i]


def _by_owner(w: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order by value then document, and each row's first row of its value."""
    order = np.lexsort((doc, w))
    new = np.concatenate([[True], w[order][1:] != w[order][:-1]])
    first = np.flatnonzero(new)[np.cumsum(new) - 1]
    return order, first


def repeated_spans(rows: DataFrame, width: int = WIDTH) -> DataFrame:
    """``doc_id, start, end``: stretches of words of ``rows`` (``doc_id, text``)
    covered by windows that also lie in a document with a smaller id."""
    spark = rows.sparkSession
    known = rows.where("doc_id is not null")

    bitmap = spark.sparkContext.broadcast(_shared_bits(known, width))

    def compared(batches: Iterator[pa.RecordBatch], mixed_bits: np.ndarray | None, first_bits: np.ndarray | None) -> Iterator[pa.RecordBatch]:
        """Candidate runs, or the windows of first runs (whose places are in
        ``first_bits``) with an anchor in ``mixed_bits``.  Those that a smaller document
        of the batch holds are repeats of it; each other one goes on to the other batches."""
        bits = bitmap.value
        for f in _slices(frame_of(b) for b in batches if b.num_rows):
            anchor, doc, place, n, at, h = _runs(f["text"].tolist(), width)
            hit = np.flatnonzero(in_bitmap(bits, anchor))
            ids = f["doc_id"].to_numpy(dtype=np.int64)
            if mixed_bits is not None:  # the other equal runs are known as repeats
                hit = hit[in_bitmap(mixed_bits, anchor[hit])]
                hit = hit[in_bitmap(first_bits, _mark(ids[doc[hit]], place[hit]))]
            if not len(hit):
                continue
            anchor, doc, place, n = anchor[hit], ids[doc[hit]], place[hit], n[hit]
            w = _windows(h, at[hit], n, width)
            if mixed_bits is None:
                key = _whole(w, n)
            else:
                key, place = w, np.arange(len(w)) - np.repeat((np.cumsum(n) - n) - place, n)
                anchor, doc, n = np.repeat(anchor, n), np.repeat(doc, n), np.ones(len(key), dtype=np.int64)
            order, first = _by_owner(key, doc)
            key, anchor, doc, place, n = key[order].view(np.int64), anchor[order].view(np.int64), doc[order], place[order], n[order]
            own = doc[first] == doc  # rows of the batch's smallest document
            columns = [np.where(own, key, 0), np.where(own, anchor, 0), doc, place.astype(np.int32), n.astype(np.int32)]
            columns += [np.where(own, 0, doc[first]), place[first].astype(np.int32), own]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=names)

    names = ["key", "anchor", "doc_id", "place", "n", "first_doc", "first_place", "open"]
    schema = "key long, anchor long, doc_id long, place int, n int, first_doc long, first_place int, open boolean"

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return compared(batches, None, None)

    def single(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return compared(batches, differing.value, firsts.value)

    def judged(found: DataFrame) -> DataFrame:
        """What is open, with the first document and place of all batches."""
        same = Window.partitionBy("key").orderBy("doc_id", "place")
        return (
            found.where("open")
            .select("key", "anchor", "doc_id", "place", "n", F.first(F.struct("doc_id", "place")).over(same).alias("first"))
            .select("key", "anchor", "doc_id", "place", "n", F.col("first.doc_id").alias("first_doc"), F.col("first.place").alias("first_place"))
        )

    def repeats(found: DataFrame, over_all: DataFrame) -> DataFrame:
        """What an earlier document holds too, with that document and place."""
        columns = ["doc_id", "place", "n", "first_doc", "first_place"]
        return found.where("not open").select(*columns).unionByName(over_all.where("first_doc < doc_id").select(*columns))

    def marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            doc, place = (b.column(i).to_numpy(zero_copy_only=False) for i in range(2))
            yield pa.RecordBatch.from_arrays([pa.array(_mark(doc, place).view(np.int64))], names=["mark"])

    wholes = written(known.mapInArrow(freed_after(whole), schema), "runs-of-windows")
    kinds = written(judged(wholes), "runs-judged")
    own = kinds.where("first_doc = doc_id")
    differ = written(own.groupBy("anchor").agg(F.min("key").alias("least"), F.max("key").alias("most")).where("least < most").select("anchor"), "differing")
    differing = spark.sparkContext.broadcast(bitmap_of(differ, "anchor", DIFFERING))
    places = own.select("doc_id", "place").mapInArrow(marks, "mark long")
    firsts = spark.sparkContext.broadcast(bitmap_of(places, "mark", FIRSTS))
    singles = written(known.mapInArrow(freed_after(single), schema), "windows")
    for b in (bitmap, differing, firsts):
        b.unpersist()  # no plan still to run reads them

    # spans of neighbouring repeats that name neighbouring places
    line = Window.partitionBy("doc_id", "first_doc", "shift").orderBy("place")
    runs = written(
        repeats(wholes, kinds).unionByName(repeats(singles, judged(singles))).withColumn("shift", F.col("first_place") - F.col("place"))
        .withColumn("new", F.coalesce((F.col("place") > F.lag(F.col("place") + F.col("n")).over(line)).cast("int"), F.lit(1)))
        .withColumn("run", F.sum("new").over(line))
        .groupBy("doc_id", "first_doc", "shift", "run")
        .agg(F.min("place").alias("start"), (F.max(F.col("place") + F.col("n")) + F.lit(width - 1)).alias("end"))
        .select("doc_id", "first_doc", "start", "end", (F.col("start") + F.col("shift")).alias("first_start"), (F.col("end") + F.col("shift")).alias("first_end")),
        "runs",
    )

    release(wholes, kinds, differ, singles)

    # the words of spans and of reference passages
    shards = 4 * shuffle_width(spark)
    shard = F.pmod(F.xxhash64("first_doc"), F.lit(shards)).cast("int").alias("shard")
    cuts = runs.select("doc_id", shard, "start", "end", F.lit(False).alias("reference")).unionByName(
        runs.select(F.col("first_doc").alias("doc_id"), shard, F.col("first_start").alias("start"), F.col("first_end").alias("end"), F.lit(True).alias("reference"))
    ).distinct()
    wanted = cuts.groupBy("doc_id").agg(F.collect_list(F.struct("shard", "start", "end", "reference")).alias("cuts"))

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for doc, text, cs in zip(f["doc_id"], f["text"], f["cuts"]):
                words = text.encode("utf-8", "surrogatepass").split()
                merged: list[list] = []  # overlapping stretches of one shard are one
                for sh, ref, s, e in sorted((c["shard"], c["reference"], c["start"], c["end"]) for c in cs):
                    if merged and merged[-1][:2] == [sh, ref] and s <= merged[-1][3]:
                        merged[-1][3] = max(merged[-1][3], e)
                    else:
                        merged.append([sh, ref, s, e])
                out += [(sh, ref, doc, s, e - s, b" ".join(words[s:e])) for sh, ref, s, e in merged]
            yield pd.DataFrame(out, columns=["shard", "reference", "doc_id", "start", "n", "words"])

    pieces = written(
        with_texts(known, wanted).mapInPandas(freed_after(cut), "shard int, reference boolean, doc_id long, start int, n int, words binary"), "passages"
    )
    parts = pieces.where("not reference").groupBy("shard").agg(F.ceil(F.sum("n") / F.lit(float(SPAN_WORDS))).cast("int").alias("parts"))
    dealt = pieces.join(F.broadcast(parts), "shard")  # at most `shards` rows
    spans = dealt.where("not reference").withColumn("part", F.pmod(F.xxhash64("doc_id", "start"), F.col("parts")).cast("int")).drop("parts", "reference")
    reference = dealt.where("reference").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts", "reference")
    reference = reference.select(*[F.col(c).alias(c) for c in reference.columns])  # columns of its own beside those of the spans

    def stream(ref: pd.DataFrame, span: pd.DataFrame) -> pd.DataFrame:
        automaton = Automaton()
        for doc, words in zip(ref["doc_id"], ref["words"]):
            automaton.add(words.split(), int(doc))
        automaton.finish()
        out = [
            (doc, start + s, start + e)
            for doc, start, words in zip(span["doc_id"], span["start"], span["words"])
            for s, e in automaton.repeats(words.split(), int(doc), width)
        ]
        return pd.DataFrame(out, columns=["doc_id", "start", "end"])

    return reference.groupBy("shard", "part").cogroup(spans.groupBy("shard", "part")).applyInPandas(stream, "doc_id long, start int, end int")


def with_texts(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """``rows`` joined with ``wanted`` by id; a bitmap of the wanted ids keeps other
    texts out of the shuffle."""
    wanted = written(wanted, "wanted")
    ids = rows.sparkSession.sparkContext.broadcast(bitmap_of(wanted, "doc_id"))
    return likely(rows, ids).join(wanted, "doc_id")


def remove_repeats(docs: DataFrame, width: int = WIDTH, id_col: str = "doc_id", text_col: str = "text", digests: bool = False) -> DataFrame:
    """Every document without the words that an earlier document's windows cover.

    Returns ``doc_id, n_words, n_removed, kept string`` (kept words joined by one
    space), or ``kept_sha256`` in its place with ``digests``; one row per input row.
    NULL and empty texts have no words.  Rows with a NULL id lose nothing and are no
    one's source; rows that share an id are one document, whose stretches are
    removed from each of its rows by place.
    """
    bounded_batches(docs.sparkSession)
    rows = id_and_text(docs, id_col, text_col)
    spans = written(repeated_spans(rows, width), "spans")
    wanted = written(spans.distinct().groupBy("doc_id").agg(F.collect_list(F.struct("start", "end")).alias("cuts")), "removed")
    schema = "doc_id long, n_words long, n_removed long, " + ("kept_sha256 string" if digests else "kept string")

    def remove(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for doc, text, cuts in zip(f["doc_id"], f["text"], f["cuts"]):
                words = words_of(text)
                stay, at = [], 0
                for s, e in sorted((c["start"], c["end"]) for c in cuts) if cuts is not None else ():
                    stay += words[at:s]  # none, where cuts overlap
                    at = max(at, e)
                stay += words[at:]
                kept = b" ".join(stay)
                out.append((doc, len(words), len(words) - len(stay), hashlib.sha256(kept).hexdigest() if digests else kept.decode("utf-8", "surrogatepass")))
            g = pd.DataFrame(out, columns=["doc_id", "n_words", "n_removed", "kept_sha256" if digests else "kept"])
            yield g.assign(doc_id=g["doc_id"].astype("Int64"))

    ids = docs.sparkSession.sparkContext.broadcast(bitmap_of(wanted, "doc_id"))

    def others(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows that lose nothing; one worker a task finds and writes them."""
        return remove(f[~ids_in(ids.value, f["doc_id"])].assign(cuts=None) for f in frames)

    touched = likely(rows, ids).join(wanted, "doc_id", "left").select("doc_id", "text", "cuts")
    return map_frames(touched, remove, schema).unionByName(map_frames(rows, others, schema))
