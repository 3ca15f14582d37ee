"""Exact Jaccard join of documents on word shingles, by several token orders.

Two sets whose Jaccard similarity is at least ``t`` share a token among the first
``n - ceil(t n) + 1`` of each, under every order of the tokens.  Candidates come
from the first order's prefix tokens, and must also share a prefix token under
two further orders; only then are the sets compared.  A shared token counts only where
its places in both sets leave room for the overlap that is needed.  All orders put frequent
tokens last (those that batches hold several times, most frequent in the whole corpus
first, a list of bounded length), so common passages do not make candidates of unlike
documents.

Groups of like documents are never expanded into all pairs:

1. documents with the same shingle set are one class with one representative;
2. in each prefix token's group a member is compared with the group's first member
   at most: that with the fewest tokens before it, so of near copies one with few
   changes, which most others link with.  A document is compared with the few first
   members it shares most tokens with; the links found make components;
3. for links between different components that share a prefix token, pairs of
   components are formed, not of members.  The Jaccard distance is a metric, so
   two components whose pivots are farther apart than their radii and the
   threshold allow have no link; for the rest, the same bound is applied to
   each member before members are paired.  Components that a link between the
   members nearest to their pivots already joins are not looked at further.  Links
   found from here on are kept as pairs of components, not of members.

A family of texts that are nearly like enough to link would still make candidates of
all its pairs.  Each set has a sketch: of every token's hashed place whether the set has
an odd number of tokens there.  Two sketches differ in no more places than the sets do
in tokens, so pairs whose sketches differ in too many places have no link; the bound is
part of the joins that pair members of large groups.

No candidate is dropped otherwise, so the components are exact.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from civiclens.functions.frames import freed_after, map_frames
from civiclens.llm.common import bitmap_of, bounded_batches, id_and_text, ids_in, likely, release, shuffle_width, written
from civiclens.llm.graph import components, merged

ORDERS = 3
STARS = 4  # first members that a document is compared with before components are formed
FREQUENT = 1 << 20  # tokens that all orders put last, at most
IN_BATCH = 3  # documents of a batch that hold a token from which on it is counted
COUNTED = 10_000, 1 << 23  # documents, or tokens, from which on such a batch is full
FEW = 1 << 14  # ids up to which texts are looked up without a bitmap of the ids
SIEVE = 1 << 24
SKETCH_WORDS = 16  # 64-bit words of a set's sketch
GROUP = 16  # documents with a prefix token from which on their sketches are compared
HUBS = 4  # members nearest to the pivot that stand for their component at first
PIECE = 1 << 17  # bytes of text that are hashed at a time: their running sums stay in the CPU's caches
SLICE = 1 << 20  # characters of text whose sets a task holds at a time
CACHE_WORDS = 400_000
_U = np.uint64


class _WordHash(dict):
    """word -> 64-bit hash."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= CACHE_WORDS:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


_WORDS = _WordHash()


def mixed(x: np.ndarray, seed: int) -> np.ndarray:
    """A permutation of the 64-bit integers for each seed."""
    x = x ^ _U((0x9E3779B97F4A7C15 * (2 * seed + 1)) & 0xFFFFFFFFFFFFFFFF)
    x ^= x >> _U(30)  # in place from here on: the first step made a copy
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


# The words of many texts are hashed at once: a polynomial of the bytes' random values,
# taken from running sums over the whole piece.  A-Z have the values of a-z.
EXACT = np.random.default_rng(20).integers(1, 1 << 63, 256, dtype=np.int64).view(np.uint64)
_VALUES = EXACT.copy()
_VALUES[65:91] = _VALUES[97:123]
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BASE = 0x9E3779B97F4A7C15
_powers: list[np.ndarray] = []


def _power(n: int) -> list[np.ndarray]:
    """The base's powers and its inverse's, at least ``n`` of each."""
    if not _powers or len(_powers[0]) < n:
        n = 1 << (n - 1).bit_length()  # not anew for each slightly longer text
        _powers[:] = [
            np.concatenate([[_U(1)], np.cumprod(np.full(max(n, PIECE) - 1, b, dtype=np.uint64))]) for b in (_U(_BASE), _U(pow(_BASE, -1, 1 << 64)))
        ]
    return _powers


def _hashed(raw: bytes, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of some bytes, and where they begin."""
    b = np.frombuffer(raw, dtype=np.uint8)
    word = np.concatenate([[False], ~_SPACE[b], [False]])
    edge = np.flatnonzero(word[1:] != word[:-1])
    begin, end = edge[::2], edge[1::2]
    up, down = _power(len(b) + 1)
    sums = np.concatenate([[_U(0)], np.cumsum(values[b] * up[: len(b)])])
    return mixed((sums[end] - sums[begin]) * down[begin] + (end - begin).astype(np.uint64), 5), begin


def _pieces(raw: bytes) -> Iterator[bytes]:
    """A text in pieces of about ``PIECE`` bytes that end at white space."""
    at = 0
    while len(raw) - at > PIECE:
        cut = max(raw.rfind(c, at, at + PIECE) for c in (b" ", b"\n", b"\t"))
        if cut <= at:  # one very long word
            cut = min((x for x in (raw.find(c, at + PIECE) for c in (b" ", b"\n", b"\t")) if x >= 0), default=len(raw))
        yield raw[at:cut]
        at = cut
    yield raw[at:]


def word_hashes(texts: list[str], values: np.ndarray = _VALUES) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all texts' words one after the other, and each text's number of
    words.  Words end at space, tab and line ends; A-Z count as a-z, unless ``values``
    is ``EXACT``."""
    raws = [t.encode("utf-8", "surrogatepass") for t in texts]
    out, counts = [], np.zeros(len(raws), dtype=np.int64)
    at = 0
    while at < len(raws):
        if len(raws[at]) > PIECE:
            for part in _pieces(raws[at]):
                out.append(_hashed(part, values)[0])
                counts[at] += len(out[-1])
            at += 1
            continue
        size, to = 0, at
        while to < len(raws) and size + len(raws[to]) <= PIECE:
            size += len(raws[to]) + 1
            to += 1
        h, begin = _hashed(b"\n".join(raws[at:to]), values)
        edges = np.cumsum([len(r) + 1 for r in raws[at:to]])
        counts[at:to] = np.diff(np.concatenate([[0], np.searchsorted(begin, edges)]))
        out.append(h)
        at = to
    return (np.concatenate(out) if out else np.zeros(0, dtype=np.uint64)), counts


def shingle_sets(texts: list[str], k: int) -> tuple[np.ndarray, np.ndarray]:
    """The texts' sets of distinct ``k``-word shingles as sorted 64-bit hashes, one set
    after the other, and the sets' sizes; fewer words than ``k`` are one shingle."""
    h, words = word_hashes(texts)
    first = np.cumsum(words) - words
    sizes = np.where(words >= k, words - k + 1, np.minimum(words, 1))
    to = np.cumsum(sizes)
    flat = np.zeros(int(sizes.sum()), dtype=np.uint64)
    if len(h) >= k:
        run = np.full(len(h) - k + 1, k, dtype=np.uint64)
        for i in range(k):
            run = mixed(run * _U(0x100000001B3) + h[i : i + len(run)], i)
        whole = words >= k
        at = np.repeat((first - (to - sizes))[whole], sizes[whole])  # from a set's place to its words'
        place = np.flatnonzero(np.repeat(whole, sizes))
        flat[place] = run[place + at]
    for d in np.flatnonzero((words > 0) & (words < k)).tolist():
        x = _U(int(words[d]))
        for i in range(int(words[d])):
            x = mixed(np.asarray([x * _U(0x100000001B3) + h[first[d] + i]], dtype=np.uint64), i)[0]
        flat[to[d] - 1] = x
    for a, b in zip((to - sizes).tolist(), to.tolist()):
        flat[a:b].sort()
    new = np.ones(len(flat), dtype=bool)
    new[1:] = flat[1:] != flat[:-1]
    new[(to - sizes)[sizes > 0]] = True
    kept = np.concatenate([[0], np.cumsum(new)])
    return flat[new], kept[to] - kept[to - sizes]


def shingles(text: str, k: int) -> np.ndarray:
    """One text's set."""
    return shingle_sets([text], k)[0]


def _split(flat: np.ndarray, sizes: np.ndarray) -> list[np.ndarray]:
    ends = np.cumsum(sizes)
    return [flat[a:b] for a, b in zip((ends - sizes).tolist(), ends.tolist())]


def set_hashes(flat: np.ndarray, sizes: np.ndarray, seed: int) -> np.ndarray:
    """A hash of each set: the sum of its tokens' hashes."""
    sums = np.concatenate([[_U(0)], np.cumsum(mixed(flat, seed))])
    ends = np.cumsum(sizes)
    return (sums[ends] - sums[ends - sizes]).view(np.int64)


def sieve(frequent: np.ndarray) -> np.ndarray:
    """By low bits: whether a token may be among the frequent ones."""
    maybe = np.zeros(SIEVE, dtype=bool)
    maybe[(frequent & _U(SIEVE - 1)).astype(np.int64)] = True
    return maybe


def are_frequent(flat: np.ndarray, frequent: np.ndarray, maybe: np.ndarray) -> np.ndarray:
    out = np.zeros(len(flat), dtype=bool)
    if len(frequent):
        hit = np.flatnonzero(maybe[(flat & _U(SIEVE - 1)).astype(np.int64)])
        at = np.minimum(np.searchsorted(frequent, flat[hit]), len(frequent) - 1)
        out[hit] = frequent[at] == flat[hit]
    return out


def prefixes(flat: np.ndarray, sizes: np.ndarray, order: int, percent: int, last: np.ndarray) -> list[np.ndarray]:
    """Each set's prefix tokens under an order; ``last``: tokens that come last."""
    key = (mixed(flat, order) >> _U(1)) | (last.astype(np.uint64) << _U(63))
    out, ends = [], np.cumsum(sizes)
    for a, b in zip((ends - sizes).tolist(), ends.tolist()):
        n, k = b - a, key[a:b]
        size = n - (percent * n + 99) // 100 + 1
        if n and size < n:
            least = np.argpartition(k, size - 1)[:size]
            least = least[np.argsort(k[least], kind="stable")]
        else:
            least = np.argsort(k, kind="stable")
        out.append(flat[a:b][least])
    return out


def sketches(flat: np.ndarray, sizes: np.ndarray) -> list[np.ndarray]:
    """Each set's sketch, as signed 64-bit integers."""
    bits, out, ends = 64 * SKETCH_WORDS, [], np.cumsum(sizes)
    place = (mixed(flat, 7) & _U(bits - 1)).astype(np.int64)
    for at in range(0, len(sizes), 1024):
        n, to = sizes[at : at + 1024], int(ends[min(at + 1024, len(sizes)) - 1])
        odd = np.bincount(np.repeat(np.arange(len(n)) * bits, n) + place[to - int(n.sum()) : to], minlength=len(n) * bits) & 1
        out += list(np.packbits(odd.astype(bool)).view(np.int64).reshape(len(n), SKETCH_WORDS))
    return out


def prefix(s: np.ndarray, order: int, percent: int, frequent: np.ndarray, maybe: np.ndarray) -> np.ndarray:
    """The prefix tokens of one set."""
    return prefixes(s, np.asarray([len(s)]), order, percent, are_frequent(s, frequent, maybe))[0]


def _slices(frames: Iterator[pd.DataFrame], limit: int = SLICE) -> Iterator[pd.DataFrame]:
    """Frames of at most about ``limit`` characters of text."""
    for f in frames:
        if not len(f):
            continue
        slot = np.cumsum(f["text"].str.len().to_numpy(dtype=np.int64)) // limit
        for i in np.unique(slot):
            yield f[slot == i]


def _profile(rows: DataFrame, k: int) -> DataFrame:
    """One row per document (``doc_id, n, h1, h2``), and rows with the tokens that
    several documents of a batch hold (``tokens, counts``)."""

    def profile(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[np.ndarray] = []
        docs = 0
        for f in frames:
            for g in _slices([f]):
                flat, sizes = shingle_sets(g["text"].tolist(), k)
                held.append(flat)
                yield pd.DataFrame(
                    {
                        "doc_id": g["doc_id"].reset_index(drop=True), "n": sizes, "h1": set_hashes(flat, sizes, 100), "h2": set_hashes(flat, sizes, 101),
                        "tokens": None, "counts": None,
                    }
                )
            docs += len(f)
            if docs >= COUNTED[0] or sum(map(len, held)) >= COUNTED[1]:
                yield from counted(held)
                docs = 0
        yield from counted(held)

    def counted(held: list[np.ndarray]) -> Iterator[pd.DataFrame]:
        tokens = np.concatenate([np.zeros(0, dtype=np.uint64), *held])
        held.clear()
        tokens.sort()  # in place: a batch's tokens are held once
        common = tokens[IN_BATCH - 1 :][tokens[IN_BATCH - 1 :] == tokens[: len(tokens) - IN_BATCH + 1]] if len(tokens) >= IN_BATCH else tokens[:0]
        common = common[np.concatenate([[True], common[1:] != common[:-1]])] if len(common) else common
        if len(common):
            counts = np.searchsorted(tokens, common, side="right") - np.searchsorted(tokens, common)
            one = pd.array([None], dtype="Int64")
            yield pd.DataFrame(
                {
                    "doc_id": one, "n": pd.array([-1], dtype="Int64"), "h1": one, "h2": one,
                    "tokens": [common.view(np.int64)], "counts": [counts.astype(np.int64)],
                }
            )

    return map_frames(rows, profile, "doc_id long, n long, h1 long, h2 long, tokens array<long>, counts array<long>")


def _frequent(profile: DataFrame) -> np.ndarray:
    """The tokens that come last, sorted: of those counted in batches the most
    frequent, down to the count that leaves at most ``FREQUENT``."""
    counts = written(
        profile.where("tokens is not null")
        .select(F.explode(F.arrays_zip("tokens", "counts")).alias("t"))
        .groupBy(F.col("t.tokens").alias("token"))
        .agg(F.sum("t.counts").alias("docs")),
        "token-counts",
    )
    level = F.floor(F.log2(F.col("docs").cast("double")) * 8).cast("int")
    least = total = 0
    for r in counts.groupBy(level.alias("level")).count().orderBy(F.col("level").desc()).collect():  # at most 8 * 64 levels
        total += r["count"]
        if total > FREQUENT:
            least = r["level"] + 1
            break

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.column(0).to_numpy().tobytes()], pa.binary())], names=["tokens"])

    kept = counts.where(level >= least).select("token").mapInArrow(packed, "tokens binary").collect()  # at most 8 bytes x FREQUENT, few rows
    release(counts)
    return np.sort(np.frombuffer(b"".join(bytes(r["tokens"]) for r in kept), dtype=np.uint64))


def _prefixes(rows: DataFrame, k: int, percent: int, frequent, copies) -> DataFrame:
    """``doc_id, n, sketch, p0, p1, ..., copied``: prefix tokens under each order, by their
    places; those of the further orders, which only filter, as their low 32 bits; whether
    the id may be in the bitmap ``copies``."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        common, maybe = frequent.value, sieve(frequent.value)
        for g in _slices(frames):
            flat, sizes = shingle_sets(g["text"].tolist(), k)
            last = are_frequent(flat, common, maybe)
            out = pd.DataFrame({"doc_id": g["doc_id"].to_numpy(), "n": sizes})
            out["sketch"] = sketches(flat, sizes)
            out["p0"] = [p.view(np.int64) for p in prefixes(flat, sizes, 0, percent, last)]
            for o in range(1, ORDERS):
                out[f"p{o}"] = [p.astype(np.uint32).view(np.int32) for p in prefixes(flat, sizes, o, percent, last)]
            out["copied"] = ids_in(copies.value, out["doc_id"])
            yield out

    further = "".join(f"p{o} array<int>, " for o in range(1, ORDERS))
    return rows.mapInPandas(freed_after(run), f"doc_id long, n long, sketch array<long>, p0 array<long>, {further}copied boolean")


def _sets(rows: DataFrame, k: int) -> DataFrame:
    """``node, tokens``: whole shingle sets."""

    def sets(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for g in _slices(frames):
            flat, sizes = shingle_sets(g["text"].tolist(), k)
            yield pd.DataFrame({"node": g["doc_id"].to_numpy(), "tokens": _split(flat.view(np.int64), sizes)})

    return rows.mapInPandas(freed_after(sets), "node long, tokens array<long>")


def _may_link(n1: str, n2: str, percent: int):
    """The smaller set is large enough for the larger one."""
    return F.lit(100) * F.least(n1, n2) >= F.lit(percent) * F.greatest(n1, n2)


def _differ(one: str, two: str):
    """The least number of tokens that two sets with these sketches differ in."""
    words = [F.bit_count(F.get(F.col(one), F.lit(i)).bitwiseXOR(F.get(F.col(two), F.lit(i)))) for i in range(SKETCH_WORDS)]
    return reduce(Column.__add__, words)


def _close(one: str, n1: str, two: str, n2: str, percent: int):
    """By their sketches, sets of these sizes may link: the union is half of both sizes
    and the difference."""
    return F.lit(100 + percent) * _differ(one, two) <= F.lit(100 - percent) * (F.col(n1) + F.col(n2))


def _within(one: str, n1: str, two: str, n2: str, away: Column):
    """By their sketches, two sets may have a Jaccard distance of ``away`` at most."""
    d = _differ(one, two).cast("double")
    return F.lit(2.0) * d <= away * (F.col(n1) + F.col(n2) + d)


def _room(n1: str, at1: str, n2: str, at2: str, percent: int, least1: str | None = None, least2: str | None = None):
    """From a shared token at these places on, the sets can overlap enough.  It holds
    for the first shared token of any two sets that link.  For groups of sets:
    the largest sizes, the first places, and the least sizes."""
    return (F.lit(100 + percent) * F.least(F.col(n1) - F.col(at1), F.col(n2) - F.col(at2))) >= F.lit(percent) * (
        F.col(least1 or n1) + F.col(least2 or n2)
    )


class _Join:
    """The steps of one join over class representatives."""

    def __init__(self, rows: DataFrame, table: DataFrame, k: int, percent: int):
        self.rows, self.table, self.k, self.percent = rows, table, k, percent
        self.tables: list[DataFrame] = []  # written for the steps

    def filtered(self, pairs: DataFrame) -> DataFrame:
        """Pairs ``a, b`` that share prefix tokens under all further orders."""
        orders = [f"p{o}" for o in range(1, ORDERS)]
        side = lambda name: self.table.select(F.col("doc_id").alias(name), *[F.col(p).alias(f"{name}_{p}") for p in orders])
        both = pairs.join(side("a"), "a").join(side("b"), "b")
        for p in orders:
            both = both.where(F.arrays_overlap(f"a_{p}", f"b_{p}"))
        return both.select(*pairs.columns)

    def compared(self, pairs: DataFrame, name: str) -> DataFrame:
        """``pairs`` (a stored table of distinct ``a, b``) with ``inter`` and
        ``total``, the sizes of the sets' intersection and union."""
        need = written(pairs.select(F.col("a").alias("doc_id")).unionByName(pairs.select(F.col("b").alias("doc_id"))).distinct(), f"{name}-docs")
        rows = self.rows
        if need.count() > FEW:  # a bitmap of the ids keeps other texts out of the shuffle
            rows = likely(rows, rows.sparkSession.sparkContext.broadcast(bitmap_of(need, "doc_id")))
        sets = written(_sets(rows.join(need, "doc_id", "left_semi"), self.k), f"{name}-sets")
        sized = (
            pairs.join(sets.select(F.col("node").alias("a"), F.col("tokens").alias("a_tokens")), "a")
            .join(sets.select(F.col("node").alias("b"), F.col("tokens").alias("b_tokens")), "b")
            .withColumn("inter", F.size(F.array_intersect("a_tokens", "b_tokens")))
            .withColumn("total", F.size("a_tokens") + F.size("b_tokens") - F.col("inter"))
        )
        found = written(sized.select(*pairs.columns, "inter", "total"), f"{name}-compared")
        release(need, sets)
        self.tables.append(found)
        return found

    def links(self, pairs: DataFrame, name: str) -> DataFrame:
        """The pairs ``a, b`` that link, with ``inter`` and ``total``."""
        near = written(self.filtered(pairs), f"{name}-pairs")
        found = self.compared(near, name)
        release(near)
        return found.where(F.lit(100) * F.col("inter") >= F.lit(self.percent) * F.col("total"))


def jaccard_components(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_shingles, component_id``, one row per input row.

    Documents link when ``100 * intersection >= percent * union`` of their sets of
    distinct ``k``-word shingles; ``component_id`` is the smallest id reachable by
    links.  Texts without words (NULL, empty, white space) link with nothing.
    Rows with a NULL id keep a NULL component and link with nothing.  An id on
    several rows is one document that links by any of its texts.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    rows = id_and_text(docs, id_col, text_col)
    profile = written(_profile(rows, k), "profile")
    known = profile.where((F.col("n") > 0) & F.col("doc_id").isNotNull())
    frequent = spark.sparkContext.broadcast(_frequent(profile))

    # a class that holds a large share of the rows is looked up without a shuffle
    classes = written(known.groupBy("h1", "h2").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies")), "classes")
    share = max(1.0, (classes.agg(F.sum("copies")).first()[0] or 0) / (4.0 * shuffle_width(spark)))
    hot = classes.where(F.col("copies") > share).select("h1", "h2", F.col("rep").alias("hot"))  # at most 4 rows per shuffle partition
    looked = known.select("doc_id", "h1", "h2").join(F.broadcast(hot), ["h1", "h2"], "left")
    cold = classes.where((F.col("copies") > 1) & (F.col("copies") <= share)).select("h1", "h2", "rep")
    alone = classes.where((F.col("copies") == 1) & (F.col("copies") <= share)).select(F.col("rep").alias("doc_id"), "rep")
    member = written(
        looked.where("hot is not null").select("doc_id", F.col("hot").alias("rep"))
        .unionByName(looked.where("hot is null").join(cold, ["h1", "h2"]).select("doc_id", "rep"))
        .unionByName(alone),
        "members",
    )
    reps = written(classes.select(F.col("rep").alias("doc_id")).distinct(), "representatives")
    # most documents are alone in their class: only those that may be copies are looked up
    copies = spark.sparkContext.broadcast(bitmap_of(member.where("doc_id <> rep"), "doc_id"))
    prefixed = written(_prefixes(rows.where("doc_id is not null"), k, percent, frequent, copies).where("n > 0"), "prefixes")
    copied = written(prefixed.where("copied").join(reps, "doc_id", "left_semi"), "prefixes-copied")
    table = prefixed.where("not copied").unionByName(copied).drop("copied")
    join = _Join(rows, table, k, percent)

    # 2. each token's group against its first member
    group = Window.partitionBy("token").orderBy("at", "doc_id")
    shared = written(
        table.select(F.posexplode("p0").alias("at", "token"), "doc_id", F.col("n").cast("int").alias("n"))
        .withColumn("first", F.first(F.struct("doc_id", "n", "at")).over(group))
        .withColumn("last", F.lead("doc_id").over(group).isNull())
        .where((F.col("first.doc_id") != F.col("doc_id")) | ~F.col("last"))
        .select(
            "token", "doc_id", "n", "at", F.col("first.doc_id").alias("center"), F.col("first.n").alias("center_n"), F.col("first.at").alias("center_at")
        ),
        "groups",
    )
    stars = shared.where(
        (F.col("center") != F.col("doc_id")) & _may_link("n", "center_n", percent) & _room("n", "at", "center_n", "center_at", percent)
    )
    # of each document's first members the STARS with most shared tokens; links that
    # the others would have found are found between components below
    best = Window.partitionBy("b").orderBy(F.col("shared").desc(), "a")
    star_pairs = (
        stars.groupBy(F.col("center").alias("a"), F.col("doc_id").alias("b"))
        .agg(F.count(F.lit(1)).alias("shared"))
        .withColumn("place", F.row_number().over(best))
        .where(F.col("place") <= STARS)
        .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        .distinct()
    )
    star_links = join.links(star_pairs, "stars")
    first = components(star_links)

    # 3. links between components
    placed = shared.join(first.withColumnRenamed("node", "doc_id"), "doc_id", "left").select(
        "token", "n", "at", F.coalesce("component", "doc_id").alias("component"), F.col("component").isNotNull().alias("many")
    )
    all_units = written(
        placed.groupBy("token", "component").agg(
            F.min("n").alias("least"), F.max("n").alias("most"), F.min("at").alias("at"), F.first("many").alias("many")
        ),
        "units",
    )
    release(shared)
    # single documents of large groups bring their sketches
    large = all_units.groupBy("token").count().where(F.col("count") > GROUP).select("token", F.lit(True).alias("large"))
    marked = all_units.join(large, "token", "left").withColumn("looked", F.coalesce("large", F.lit(False)) & ~F.col("many")).drop("large")
    units = (
        marked.where("looked").join(table.select(F.col("doc_id").alias("component"), "sketch"), "component").select("token", "component", "least", "most", "at", "many", "sketch")
        .unionByName(marked.where("not looked").select("token", "component", "least", "most", "at", "many", F.lit(None).cast("array<long>").alias("sketch")))
    )
    left, right = units.alias("l"), units.alias("r")
    meet = written(
        left.join(right, "token")
        .where(
            (F.col("l.component") < F.col("r.component"))
            & (F.lit(100) * F.col("l.most") >= F.lit(percent) * F.col("r.least"))
            & (F.lit(100) * F.col("r.most") >= F.lit(percent) * F.col("l.least"))
            & _room("l.most", "l.at", "r.most", "r.at", percent, "l.least", "r.least")
            & (F.col("l.sketch").isNull() | F.col("r.sketch").isNull() | _close("l.sketch", "l.most", "r.sketch", "r.most", percent))
        )
        .select(F.col("l.component").alias("a"), F.col("r.component").alias("b"), (F.col("l.many") | F.col("r.many")).alias("many"))
        .distinct(),
        "meetings",
    )
    single = join.links(meet.where("not many").select("a", "b"), "singles")

    # components with several members: pivots, radii, then members that can link
    grouped = meet.where("many").select("a", "b")
    inside = written(
        first.where("node <> component")
        .join(grouped.select(F.col("a").alias("component")).unionByName(grouped.select(F.col("b").alias("component"))).distinct(), "component", "left_semi")
        .select(F.col("component").alias("a"), F.col("node").alias("b")),
        "inside",
    )
    away = (F.lit(1.0) - F.col("inter") / F.col("total")).alias("away")
    # most members were compared with their pivot as a group's first member
    known_near = star_links.join(inside, ["a", "b"], "left_semi")
    rest = written(inside.join(star_links, ["a", "b"], "left_anti"), "inside-rest")
    near = known_near.unionByName(join.compared(rest, "inside")).select(F.col("a").alias("component"), F.col("b").alias("node"), away)
    pivots = grouped.select(F.col("a").alias("component")).unionByName(grouped.select(F.col("b").alias("component"))).distinct()
    members = written(near.unionByName(pivots.select("component", F.col("component").alias("node"), F.lit(0.0).alias("away"))), "members")
    radius = members.groupBy("component").agg(F.max("away").alias("radius"))
    reach = 1.0 - percent / 100.0 + 1e-9
    sketched = table.select(F.col("doc_id").alias("node"), F.col("n").cast("int").alias("n"), "sketch")

    # components whose members nearest to the pivots link are one
    nearest = Window.partitionBy("component").orderBy("away", "node")
    hubs = written(
        members.withColumn("place", F.row_number().over(nearest)).where(F.col("place") <= HUBS + 1).join(sketched, "node").drop("place", "away"), "hubs"
    )
    side = lambda unit, d: hubs.select(F.col("component").alias(unit), F.col("node").alias(d), F.col("n").alias(f"{d}_n"), F.col("sketch").alias(f"{d}_s"))
    met = grouped.join(side("a", "x"), "a").join(side("b", "y"), "b").where(_may_link("x_n", "y_n", percent) & _close("x_s", "x_n", "y_s", "y_n", percent))
    between = written(join.links(met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "hubs").select("a", "b"), "hub-links")
    whole = merged(first, single.select("a", "b").unionByName(between))
    label = lambda c: whole.select(F.col("node").alias(c), F.col("component").alias(f"{c}_label"))
    apart_yet = written(
        grouped.join(label("a"), "a", "left").join(label("b"), "b", "left").where(F.coalesce("a_label", "a") != F.coalesce("b_label", "b")).select("a", "b"), "apart"
    )
    pivot = lambda c: sketched.select(F.col("node").alias(c), F.col("n").alias(f"{c}_n"), F.col("sketch").alias(f"{c}_s"))
    apart = (
        join.compared(apart_yet, "pivots")
        .select("a", "b", away.alias("apart"))
        .join(radius.select(F.col("component").alias("a"), F.col("radius").alias("a_radius")), "a")
        .join(radius.select(F.col("component").alias("b"), F.col("radius").alias("b_radius")), "b")
        .where(F.col("apart") <= F.col("a_radius") + F.col("b_radius") + F.lit(reach))
        .join(pivot("b"), "b")
    )
    sized = members.join(sketched, "node")
    one = sized.select(F.col("component").alias("a"), F.col("node").alias("x"), F.col("away").alias("x_away"), F.col("n").alias("x_n"), F.col("sketch").alias("x_s"))
    two = sized.select(F.col("component").alias("b"), F.col("node").alias("y"), F.col("away").alias("y_away"), F.col("n").alias("y_n"), F.col("sketch").alias("y_s"))
    pairs = (
        apart.join(one, "a")
        .where(
            (F.col("x_away") + F.col("b_radius") + F.lit(reach) >= F.col("apart"))
            & _within("x_s", "x_n", "b_s", "b_n", F.col("b_radius") + F.lit(reach))
        )
        .join(two, "b")
        .where(
            (F.col("x_away") + F.col("y_away") + F.lit(reach) >= F.col("apart"))
            & _may_link("x_n", "y_n", percent)
            & _close("x_s", "x_n", "y_s", "y_n", percent)
        )
        .select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
        .distinct()
    )
    across = join.links(pairs, "across")
    final = merged(whole, across.select("a", "b"))
    release(prefixed, copied, all_units, meet, classes, reps, inside, rest, members, hubs, between, apart_yet, *join.tables)

    of = member.join(final.withColumnRenamed("node", "rep"), "rep", "left").groupBy("doc_id").agg(
        F.min(F.coalesce("component", "rep")).alias("component")
    )
    return (
        profile.where("n >= 0")
        .join(of, "doc_id", "left")
        .select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))
    )
