"""Centroid clustering with ns-bounds.

Lloyd's rounds over integer vectors, exact in every assignment.  Each vector keeps the
squared distance to its own centroid and, for each group of centroids, the smallest
squared distance to one that is not its own, each with the round in which it was
measured.  All rounds' centroids are kept, so a bound is loosened by how far its
centroid is now from where it was then: the norm of the total displacement, which is
never more than the sum of the rounds' drifts.  Where a group's bound does not lie
clearly beyond the vector's own distance, first that distance is measured anew and
then the group's centroids are scanned in whole numbers; among equal distances the
smaller centroid number wins.

A vector and its bounds are a row of a written table, one table per round; the one
before is deleted.  What reaches the driver is centroids: ``k`` start vectors, then
``k`` sums a round.

Defined results: vectors of another length, with a NULL or not finite component, and
NULL vectors are left out.  Components are held within 2^27, so that a squared distance
is a long.  Fewer vectors than centroids: as many centroids as vectors.  Rows that
share an id are vectors of their own; a row with a NULL id is clustered, but is no
start centroid.  Without vectors the result is empty.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from civiclens.llm.common import release, written

GROUP = 10  # centroids of a group that share a lower bound
LARGEST = 1 << 27  # of a component
FAR = 1 << 62
SLACK = 1e-9  # relative error that float bounds are given
STATE = "vec_id long, v array<long>, cluster int, own long, own_round int, others array<long>, others_round array<int>, scans long"


def integer_vectors(vectors: DataFrame, dims: int, scale: float, id_col: str, vec_col: str) -> DataFrame:
    """``vec_id, v`` of the vectors that are kept: floor(scale * x) per component."""
    finite = F.forall(vec_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    whole = F.transform(
        vec_col,
        lambda x: F.least(F.greatest(F.floor(F.lit(float(scale)) * x.cast("double")).cast("long"), F.lit(-LARGEST)), F.lit(LARGEST)),
    )
    return vectors.where((F.size(vec_col) == dims) & finite).select(F.col(id_col).cast("long").alias("vec_id"), whole.alias("v"))


def groups_of(k: int) -> list[np.ndarray]:
    return np.array_split(np.arange(k), max(1, -(-k // GROUP)))


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows of ``x`` to rows of ``c`` as longs."""
    top = max(int(np.abs(x).max(initial=0)), int(np.abs(c).max(initial=0)))
    if top * top * x.shape[1] * 4 < 1 << 53:  # whole numbers that doubles hold
        a, b = x.astype(np.float64), c.astype(np.float64)
        return np.rint((a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)[None, :]).astype(np.int64)
    return np.stack([((x - row) ** 2).sum(1) for row in c], axis=1)


class Bounds:
    """One round's assignment, given the centroids of all rounds so far."""

    def __init__(self, history: np.ndarray):
        self.now = len(history) - 1
        self.centroids = history[-1]
        self.groups = groups_of(len(self.centroids))
        self.group_of = np.repeat(np.arange(len(self.groups)), [len(g) for g in self.groups])
        moved = np.sqrt(((history - self.centroids[None]).astype(np.float64) ** 2).sum(2))  # round, centroid
        self.moved = moved
        self.group_moved = np.stack([moved[:, g].max(1) for g in self.groups], axis=1)  # round, group

    def first(self, n: int) -> tuple[np.ndarray, ...]:
        """The state of ``n`` vectors that have no centroid yet."""
        g = len(self.groups)
        return (
            np.full(n, -1), np.full(n, FAR), np.zeros(n, dtype=np.int64), np.zeros((n, g), dtype=np.int64), np.zeros((n, g), dtype=np.int64), np.zeros(n, dtype=np.int64),
        )

    def assign(self, v: np.ndarray, cluster: np.ndarray, own: np.ndarray, own_round: np.ndarray, others: np.ndarray, others_round: np.ndarray, scans: np.ndarray, measure: bool = False) -> tuple[np.ndarray, ...]:
        """The state after this round's assignment.  ``measure``: own distances are
        those to this round's centroids."""
        cluster, own, own_round, others, others_round, scans = (x.copy() for x in (cluster, own, own_round, others, others_round, scans))
        fresh = cluster < 0
        held = np.maximum(cluster, 0)
        g = np.arange(len(self.groups))
        lower = np.sqrt(others) * (1 - SLACK) - self.group_moved[others_round, g[None, :]] * (1 + SLACK)
        upper = (np.sqrt(own) + self.moved[own_round, held]) * (1 + SLACK)
        fails = (lower <= upper[:, None]) | fresh[:, None]
        again = (fails.any(1) | measure) & ~fresh & (own_round < self.now)
        if again.any():
            own[again] = ((v[again] - self.centroids[cluster[again]]) ** 2).sum(1)
            own_round[again] = self.now
            scans[again] += 1
            fails[again] = lower[again] <= (np.sqrt(own[again]) * (1 + SLACK))[:, None]
        best, at = own.copy(), np.where(fresh, len(self.centroids), cluster)
        first = np.full(others.shape, FAR)
        second, where = first.copy(), np.full(others.shape, -1)
        for i, members in enumerate(self.groups):
            rows = np.flatnonzero(fails[:, i])
            if not len(rows):
                continue
            d = squared(v[rows], self.centroids[members])
            scans[rows] += len(members)
            j = d.argmin(1)
            line = np.arange(len(rows))
            first[rows, i], where[rows, i] = d[line, j], members[j]
            d[line, j] = FAR
            second[rows, i] = d.min(1)
            nearer = (first[rows, i] < best[rows]) | ((first[rows, i] == best[rows]) & (where[rows, i] < at[rows]))
            best[rows] = np.where(nearer, first[rows, i], best[rows])
            at[rows] = np.where(nearer, where[rows, i], at[rows])
        others = np.where(fails, np.where(where == at[:, None], second, first), others)
        others_round = np.where(fails, self.now, others_round)
        changed = np.flatnonzero((at != cluster) & ~fresh)
        # the centroid left behind is now one of its group's others; a group that was
        # not scanned has no other one as near
        left = self.group_of[cluster[changed]]
        apart = ~fails[changed, left]
        others[changed[apart], left[apart]] = own[changed[apart]]
        others_round[changed[apart], left[apart]] = self.now
        moved = np.flatnonzero(at != cluster)
        own[moved], own_round[moved] = best[moved], self.now
        return at, own, own_round, others, others_round, scans


def _lists(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _as_lists(x: np.ndarray, kind: pa.DataType) -> pa.Array:
    flat = pa.array(np.ascontiguousarray(x).ravel(), kind)
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), flat)


def _round(state: DataFrame, history: np.ndarray, last: bool) -> DataFrame:
    """All vectors assigned to the centroids of the history's last round."""
    shared = state.sparkSession.sparkContext.broadcast(history)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bounds, dims = Bounds(shared.value), shared.value.shape[2]
        width = len(bounds.groups)
        for b in batches:
            if not b.num_rows:
                continue
            v = _lists(b.column("v"), dims)
            if "cluster" in b.schema.names:
                plain = [b.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("cluster", "own", "own_round", "scans")]
                before = (*plain[:3], _lists(b.column("others"), width), _lists(b.column("others_round"), width).astype(np.int64), plain[3])
            else:
                before = bounds.first(len(v))
            cluster, own, own_round, others, others_round, scans = bounds.assign(v, *before, measure=last)
            yield pa.RecordBatch.from_arrays(
                [
                    b.column("vec_id"), b.column("v"), pa.array(cluster, pa.int32()), pa.array(own, pa.int64()), pa.array(own_round, pa.int32()),
                    _as_lists(others, pa.int64()), _as_lists(others_round, pa.int32()), pa.array(scans, pa.int64()),
                ],
                names=[f.split()[0] for f in STATE.split(", ")],
            )

    return state.mapInArrow(run, STATE)


def _sums(state: DataFrame) -> dict[int, tuple[int, list[int]]]:
    """Number and componentwise sum of each cluster's vectors: each task adds up its
    own rows, what is shuffled is one number per task, cluster and component."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, list] = {}
        for b in batches:
            if not b.num_rows:
                continue
            cluster, v = b.column("cluster").to_numpy(), _lists(b.column("v"), len(b.column("v")[0]))
            order = np.argsort(cluster, kind="stable")
            found, begin, count = np.unique(cluster[order], return_index=True, return_counts=True)
            for c, n, s in zip(found.tolist(), count.tolist(), np.add.reduceat(v[order], begin, axis=0)):
                held = total.setdefault(c, [0, np.zeros(v.shape[1], dtype=np.int64)])
                held[0] += n
                held[1] += s
        if total:
            yield pa.RecordBatch.from_arrays(
                [pa.array(total, pa.int32()), pa.array([n for n, _ in total.values()], pa.int64()), _as_lists(np.stack([s for _, s in total.values()]), pa.int64())],
                names=["cluster", "n", "total"],
            )

    parts = state.select("cluster", "v").mapInArrow(run, "cluster int, n long, total array<long>")
    wide = F.col("total").cast("decimal(38,0)")
    by_place = parts.select("cluster", "n", F.posexplode("total").alias("i", "total")).groupBy("cluster", "i").agg(F.sum("n").alias("n"), F.sum(wide).alias("total"))
    out: dict[int, tuple[int, list[int]]] = {}
    for r in by_place.orderBy("cluster", "i").collect():  # clusters x components
        out.setdefault(r["cluster"], (r["n"], []))[1].append(int(r["total"]))
    return out


def cluster_vectors(
    vectors: DataFrame, k: int = 40, rounds: int = 5, dims: int = 64, scale: float = 256.0, seed: str = "2:", id_col: str = "vec_id", vec_col: str = "embedding"
) -> DataFrame:
    """``vec_id, cluster int, distance long, cluster_inertia long, inertia long,
    centroid_sha256 string, scans long`` of every kept vector after ``rounds`` rounds
    and one more assignment.  Start centroids are the vectors with the smallest
    sha256 of ``seed`` and their id.  ``scans``: distances measured for the vector."""
    spark = vectors.sparkSession
    kept = integer_vectors(vectors, dims, scale, id_col, vec_col)
    start = (
        kept.where("vec_id is not null")
        .withColumn("h", F.sha2(F.concat(F.lit(seed), F.col("vec_id").cast("string")).cast("binary"), 256))
        .orderBy("h", "v")
        .limit(k)
        .collect()
    )
    result = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string, scans long"
    if not start:
        return spark.createDataFrame([], result)
    history = np.asarray([[r["v"] for r in start]], dtype=np.int64)
    state = kept
    for t in range(rounds + 1):
        before, state = state, written(_round(state, history, last=t == rounds), f"clusters-{t}")
        if t:
            release(before)
        if t < rounds:
            new = history[-1].copy()
            for c, (n, total) in _sums(state).items():
                new[c] = [s // n for s in total]
            history = np.concatenate([history, new[None]])
    inertia = {r["cluster"]: int(r["d"]) for r in state.groupBy("cluster").agg(F.sum(F.col("own").cast("decimal(38,0)")).alias("d")).collect()}
    whole = sum(inertia.values())
    fits = [whole if whole < 1 << 63 else None]
    marks = [
        (c, d if d < 1 << 63 else None, fits[0], hashlib.sha256(",".join(map(str, history[-1][c].tolist())).encode()).hexdigest()) for c, d in sorted(inertia.items())
    ]
    of_cluster = spark.createDataFrame(marks, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")  # k rows at most
    return state.select("vec_id", "cluster", F.col("own").alias("distance"), "scans").join(F.broadcast(of_cluster), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256", "scans"
    )
