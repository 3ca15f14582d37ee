"""Packing token sequences by linear grouping.

Large lengths are sorted and cut into groups of equal cardinality; each length is
rounded up to the largest of its group.  That leaves a few sizes, for which the
configurations (which sizes share a sequence) are optimised by column generation.
Real documents take the slots of the rounded sizes, and what is left in each
sequence is filled best-fit with the small lengths.

The plan depends only on how many pieces have each length: at most ``capacity``
counts reach the driver, whatever the number of documents.  A plan row says that
the pieces ``rank .. rank + n`` of one length go to the sequences
``first .. first + n`` at one offset; their number depends on the lengths and
groups alone.  Executors rank the pieces of a length bucket by bucket, so a
length that a third of the pieces have is spread.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from civiclens.llm.bpe import Encoder, encoder, tree_encode
from civiclens.functions.frames import map_frames
from civiclens.llm.common import bounded_batches, id_and_text, shuffle_width, written

CAPACITY = 1024
GROUPS = 48
BATCH_CHARS = 1 << 20  # of the texts that are encoded together
SMALL = (2, 4)  # lengths up to capacity / 2, or up to a quarter, are small: the better plan is taken
PIECE_SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long"
EPS = 1e-9


def cut_points(n: int, capacity: int) -> list[tuple[int, int]]:
    """``(start, length)`` of the pieces of ``n`` ids; only the first is shorter."""
    if n <= capacity:
        return [(0, n)]
    first = (n - 1) % capacity + 1
    return [(0, first)] + [(s, capacity) for s in range(first, n, capacity)]


def encoded_texts(enc: Encoder, texts: list[str]) -> Iterator[bytes]:
    """The texts' packed ids: short texts together, those over ``BATCH_CHARS`` by the tree."""
    at = 0
    while at < len(texts):
        to, chars = at, 0
        while to < len(texts) and chars + len(texts[to]) <= BATCH_CHARS:
            chars += len(texts[to])
            to += 1
        if to > at:
            yield from enc.many(texts[at:to])
        else:
            yield tree_encode(enc, texts[at])
            to += 1
        at = to


def token_pieces(
    docs: DataFrame, tokenizer_path: str, end_id: int, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False
) -> DataFrame:
    """Every document's ids with ``end_id`` after them, cut into pieces.

    NULL text counts as empty (the end id alone)."""

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc, end = encoder(tokenizer_path), np.asarray([end_id], dtype="<u4").tobytes()
        for f in frames:
            out: list[tuple] = []
            ids: list[np.ndarray] = []
            for doc_id, packed in zip(f["doc_id"], encoded_texts(enc, f["text"].tolist())):
                packed += end
                for piece, (start, length) in enumerate(cut_points(len(packed) // 4, capacity)):
                    part = packed[4 * start : 4 * (start + length)]
                    out.append((doc_id, piece, start, length, zlib.crc32(part)))
                    if with_ids:
                        ids.append(np.frombuffer(part, dtype="<u4").astype(np.int32))
            g = pd.DataFrame(out, columns=["doc_id", "piece", "start", "length", "ids_crc32"])
            g["doc_id"] = g["doc_id"].astype("Int64")
            yield g.assign(ids=ids) if with_ids else g

    return map_frames(id_and_text(docs, id_col, text_col), cut, PIECE_SCHEMA + (", ids array<int>" if with_ids else ""))


def best_configuration(sizes: np.ndarray, worth: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The set of sizes (with repeats) worth most that fits: unbounded knapsack."""
    best = np.zeros(capacity + 1)
    take = np.full(capacity + 1, -1)
    for c in range(1, capacity + 1):
        best[c] = best[c - 1]
        fits = np.flatnonzero(sizes <= c)
        if len(fits):
            v = best[c - sizes[fits]] + worth[fits]
            k = int(v.argmax())
            if v[k] > best[c] + EPS:
                best[c], take[c] = v[k], fits[k]
    counts, c = np.zeros(len(sizes), dtype=int), capacity
    while c > 0:
        if take[c] < 0:
            c -= 1
        else:
            counts[take[c]] += 1
            c -= sizes[take[c]]
    return best[capacity], counts


def configurations(sizes: np.ndarray, demand: np.ndarray, capacity: int, rounds: int = 2000) -> list[tuple[np.ndarray, int]]:
    """Configurations and how often each is used, meeting no more than the demand:
    the linear programme's optimum by column generation, rounded down."""
    n = len(sizes)
    basis = np.diag(capacity // sizes).astype(float)
    for _ in range(rounds):
        use = np.linalg.solve(basis, demand.astype(float))
        worth = np.linalg.solve(basis.T, np.ones(n))
        value, counts = best_configuration(sizes, np.maximum(worth, 0), capacity)
        if value <= 1 + 1e-7:
            break
        step = np.linalg.solve(basis, counts.astype(float))
        ratio = np.where(step > EPS, np.maximum(use, 0) / np.where(step > EPS, step, 1), np.inf)
        basis[:, int(ratio.argmin())] = counts
    use = np.floor(np.maximum(np.linalg.solve(basis, demand.astype(float)), 0) + 1e-6).astype(np.int64)
    left, found = demand.astype(np.int64).copy(), []
    for k in np.argsort(-use, kind="stable"):
        column = basis[:, k].round().astype(np.int64)
        has = column > 0
        times = int(min(use[k], (left[has] // column[has]).min())) if has.any() else 0
        if times > 0:
            found.append((column, times))
            left -= column * times
    return found


class _Queue:
    """Runs ``(length, rank, n)`` of pieces that wait, longest first."""

    def __init__(self) -> None:
        self.runs: list[tuple[int, int, int]] = []
        self.at = 0

    def take(self, n: int) -> list[tuple[int, int, int]]:
        out = []
        while n:
            length, rank, have = self.runs[self.at]
            use = min(n, have)
            out.append((length, rank, use))
            n -= use
            if use == have:
                self.at += 1
            else:
                self.runs[self.at] = (length, rank + use, have - use)
        return out


PlanRow = tuple[int, int, int, int, int]


def sequences(plan: list[PlanRow]) -> int:
    """How many sequences a plan fills."""
    return max((first + n for _, _, n, first, _ in plan), default=0)


def plan_packing(counts: dict[int, int], capacity: int = CAPACITY, groups: int = GROUPS) -> list[PlanRow]:
    """Rows ``(length, rank, n, first sequence, offset)`` that place every piece."""
    return min((plan_once(counts, capacity, groups, small) for small in SMALL), key=sequences)


def plan_once(counts: dict[int, int], capacity: int, groups: int, small: int) -> list[PlanRow]:
    """A plan whose large lengths are those over ``capacity / small``."""
    plan: list[tuple[int, int, int, int, int]] = []
    counts = {int(k): int(v) for k, v in counts.items() if v}
    if any(k < 1 or k > capacity for k in counts):
        raise ValueError("lengths must lie between 1 and the capacity")
    sequence = counts.pop(capacity, 0)
    if sequence:
        plan.append((capacity, 0, sequence, 0, 0))
    room: dict[int, list[tuple[int, int]]] = defaultdict(list)  # room left -> runs (first, n) of sequences
    large = [(k, counts[k]) for k in sorted(counts, reverse=True) if k > capacity // small]
    total = sum(n for _, n in large)
    waiting: dict[int, list[tuple[int, int]]] = defaultdict(list)  # length -> runs (rank, n) not placed yet
    if total:
        each = -(-total // groups)
        queues, sizes, free = [_Queue()], [], max(each, large[0][1]) if len(large) <= groups else each
        for k, n in large:
            rank = 0
            if len(large) <= groups and queues[-1].runs:  # few lengths: each is a group
                free = 0
            while n:
                if free == 0:
                    queues.append(_Queue())
                    free = n if len(large) <= groups else each
                if not queues[-1].runs:
                    sizes.append(k)
                use = min(n, free)
                queues[-1].runs.append((k, rank, use))
                rank, n, free = rank + use, n - use, free - use
        demand = [sum(r[2] for r in q.runs) for q in queues]
        # groups rounded up to one size are one size of the programme
        merged: dict[int, list[int]] = defaultdict(list)
        for g, s in enumerate(sizes):
            merged[s].append(g)
        distinct = sorted(merged, reverse=True)
        line = []
        for s in distinct:
            q = _Queue()
            q.runs = [r for g in merged[s] for r in queues[g].runs]
            line.append(q)
        need = np.asarray([sum(demand[g] for g in merged[s]) for s in distinct])
        for column, times in configurations(np.asarray(distinct), need, capacity):
            slots = [line[i].take(times) for i in range(len(distinct)) for _ in range(column[i])]
            at = 0
            while at < times:  # stretches of sequences with the same real lengths
                n = min(s[0][2] for s in slots)
                offset = 0
                for s in slots:
                    length, rank, have = s[0]
                    plan.append((length, rank, n, sequence + at, offset))
                    offset += length
                    if have == n:
                        s.pop(0)
                    else:
                        s[0] = (length, rank + n, have - n)
                room[capacity - offset].append((sequence + at, n))
                at += n
            sequence += times
        for q in line:
            for length, rank, n in q.runs[q.at :]:
                waiting[length].append((rank, n))
    for k, n in counts.items():
        if k <= capacity // small:
            waiting[k].append((0, n))
    for k in sorted(waiting, reverse=True):
        for rank, n in waiting[k]:
            while n:
                r = next((r for r in range(k, capacity + 1) if room.get(r)), None)
                if r is None:  # as many new sequences as these pieces can fill
                    new = -(-n // (capacity // k))
                    room[capacity].append((sequence, new))
                    sequence, r = sequence + new, capacity
                first, have = room[r].pop()
                use = min(n, have)
                if use < have:
                    room[r].append((first + use, have - use))
                plan.append((k, rank, use, first, capacity - r))
                if r > k:
                    room[r - k].append((first, use))
                rank, n = rank + use, n - use
    return plan


def pack(pieces: DataFrame, capacity: int = CAPACITY, groups: int = GROUPS) -> DataFrame:
    """``pieces`` (``doc_id, piece, length`` and any other columns) with the
    ``sequence_id`` and ``offset`` that each gets.  Every piece is placed once, in
    sequences of at most ``capacity``, without gaps from offset 0.  Pieces must be a
    stored table: it is read twice."""
    spark = pieces.sparkSession
    buckets = shuffle_width(spark)
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most `capacity` rows
    plan = sorted(plan_packing(counts, capacity, groups))
    shared = spark.sparkContext.broadcast(np.asarray(plan, dtype=np.int64).reshape(-1, 5))

    bucketed = pieces.withColumn("__bucket", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(buckets)).cast("int"))
    per_bucket = bucketed.groupBy("length", "__bucket").agg(F.count(F.lit(1)).alias("n"))
    before = per_bucket.select(
        "length",
        "__bucket",
        (F.sum("n").over(Window.partitionBy("length").orderBy("__bucket")) - F.col("n")).alias("__before"),
    )
    rest = [c for c in pieces.columns if c not in ("doc_id", "piece")]
    order = Window.partitionBy("length", "__bucket").orderBy("doc_id", "piece", *[c for c in rest if c in ("start", "ids_crc32")])
    ranked = (
        bucketed.withColumn("__rank", F.row_number().over(order) - 1)
        .join(before, ["length", "__bucket"])
        .withColumn("__rank", F.col("__rank") + F.col("__before"))
        .drop("__before", "__bucket")
        .select(*pieces.columns, F.col("__rank").cast("long").alias("__rank"))
    )

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = shared.value
        key = rows[:, 0] << 44 | rows[:, 1]
        for f in frames:
            rank = f["__rank"].to_numpy()
            at = np.searchsorted(key, f["length"].to_numpy() << 44 | rank, side="right") - 1
            yield f.drop(columns="__rank").assign(sequence_id=rows[at, 3] + rank - rows[at, 1], offset=rows[at, 4])

    schema = ", ".join(f"`{n}` {t}" for n, t in pieces.dtypes)
    return map_frames(ranked, place, schema + ", sequence_id long, offset long")


def pack_documents(
    docs: DataFrame, tokenizer_path: str, end_id: int = 2, capacity: int = CAPACITY, groups: int = GROUPS, with_ids: bool = False
) -> DataFrame:
    """Documents as pieces in packed sequences: ``doc_id, piece, start, length,
    ids_crc32, sequence_id, offset`` (and ``ids`` if asked for).  NULL and empty
    texts are the end id alone; repeated rows are packed each for itself; an empty
    table gives no sequence."""
    bounded_batches(docs.sparkSession)
    return pack(written(token_pieces(docs, tokenizer_path, end_id, capacity, with_ids=with_ids), "pieces"), capacity, groups)
