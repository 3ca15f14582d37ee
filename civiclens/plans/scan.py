"""Ordered scans per key that stay parallel when one key is hot.

A plain ``Window.partitionBy(key).orderBy(t)`` puts every row of a key into
one task.  These helpers split the rows' order into buckets, run the window inside
each bucket, and carry on from bucket to bucket through a small summary (one row
per key and bucket).  The results equal the single-window version exactly.

``order_buckets`` cuts the order of *all* rows by key and order columns at splitters
from a sample of the rows themselves, so buckets hold about equally many rows
whatever the keys, the times, or the hour that most rows fall in.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _cols(cs: Sequence[str | Column]) -> list[Column]:
    return [F.col(c) if isinstance(c, str) else c for c in cs]


def join_null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """Join on ``keys`` with NULL equal to NULL; the keys stay once, from ``left``."""
    named = right.select(*[F.col(c).alias(f"_r_{c}") if c in keys else F.col(c) for c in right.columns])
    same = F.lit(True)
    for k in keys:
        same = same & left[k].eqNullSafe(named[f"_r_{k}"])
    return left.join(named, same, how).drop(*[f"_r_{k}" for k in keys])


SAMPLED = 16  # rows sampled for each bucket


def order_buckets(df: DataFrame, order_cols: Sequence[str | Column], name: str = "_bkt", parts: int | None = None) -> DataFrame:
    """``df`` with the number of each row's bucket in the order of ``order_cols``
    (ascending, NULL first): how many splitters its key reaches.

    Splitters are quantiles of the rows whose keys have the smallest hashes: the same
    ones whenever the plan runs, a subquery of at most ``SAMPLED`` keys per bucket, no
    job at planning time.  There are about as many buckets as shuffle partitions.
    Rows with equal keys share a bucket, so the order should end in a unique column.
    The splitter is found by halving, one small projection per step.
    """
    bits = max(1, (parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))).bit_length())
    key = F.struct(*[c.alias(f"k{i}") for i, c in enumerate(_cols(order_cols))])
    sample = df.select(key.alias("k")).orderBy(F.xxhash64("k")).limit(SAMPLED << bits).agg(F.array_sort(F.collect_list("k")).alias("s"))
    at = lambda i: F.get("s", F.floor(i * F.size("s") / F.lit(1 << bits)).cast("int"))
    splitters = sample.select(F.transform(F.sequence(F.lit(1), F.lit((1 << bits) - 1)), at)).scalar()
    out = df.withColumn("_key", key).withColumn(name, F.lit(0))
    for step in (1 << b for b in reversed(range(bits))):
        reached = F.get(splitters, F.col(name) + F.lit(step - 1)) <= F.col("_key")
        out = out.withColumn(name, F.col(name) + F.when(reached, F.lit(step)).otherwise(F.lit(0)))
    return out.drop("_key")


def running_index_and_max(
    df: DataFrame,
    group_cols: Sequence[str],
    order_cols: Sequence[str],
    bucket: Column,
    t_col: str,
    step: int,
    scale: int = 1,
    idx_col: str = "_idx",
    max_col: str = "_runmax",
    tmax_col: str = "_tmax",
) -> DataFrame:
    """For each row ``i`` (0-based position within its group in the order):

    * ``idx_col``  = i
    * ``max_col``  = max over j ≤ i of (t_j·scale − j·step)
    * ``tmax_col`` = max over j ≤ i of t_j·scale

    Exact in integer arithmetic: an interval that is no whole number of time units
    is the fraction ``step / scale``, in decimals of 38 digits.  NULL groups are
    groups like any other.  Inside a bucket the window is local; across buckets the offsets (row counts) and
    prefix maxima come from a per-bucket summary.  ``bucket`` must not fall in the
    order; None: measured buckets of ``order_buckets``.
    """
    g = list(group_cols)
    kind = "bigint" if scale == 1 else "decimal(38,0)"
    t = F.col(t_col).cast("bigint") if scale == 1 else (F.col(t_col).cast("decimal(19,0)") * F.lit(scale).cast("decimal(18,0)")).cast(kind)
    st = F.lit(int(step))
    j_step = (lambda j: j * st) if scale == 1 else (lambda j: (j.cast("decimal(19,0)") * F.lit(int(step)).cast("decimal(18,0)")).cast(kind))
    d = order_buckets(df, [*g, *order_cols]) if bucket is None else df.withColumn("_bkt", bucket)
    w_local = Window.partitionBy(*g, "_bkt").orderBy(*_cols(order_cols))
    w_run = w_local.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    d = d.withColumn("_lj", F.row_number().over(w_local) - 1)
    d = d.withColumn("_lmax", F.max(t - j_step(F.col("_lj"))).over(w_run)).withColumn("_ltmax", F.max(t).over(w_run))

    summary = d.groupBy(*g, "_bkt").agg(
        F.count(F.lit(1)).alias("_cnt"),
        F.max(t - j_step(F.col("_lj"))).alias("_bm"),
        F.max(t).alias("_btm"),
    )
    w_b = Window.partitionBy(*g).orderBy("_bkt").rowsBetween(Window.unboundedPreceding, -1)
    summary = (
        summary.withColumn("_off", F.coalesce(F.sum("_cnt").over(w_b), F.lit(0)).cast("bigint"))
        # bucket maxima shifted by their own offset before the prefix max
        .withColumn("_bm_abs", F.col("_bm") - j_step(F.col("_off")))
    )
    summary = summary.withColumn("_pmax", F.max("_bm_abs").over(w_b)).withColumn("_ptmax", F.max("_btm").over(w_b))
    d = join_null_safe(d, summary.select(*g, "_bkt", "_off", "_pmax", "_ptmax"), [*g, "_bkt"])
    local_abs = F.col("_lmax") - j_step(F.col("_off"))
    d = d.withColumn(idx_col, F.col("_off") + F.col("_lj"))
    d = d.withColumn(max_col, F.greatest(local_abs, F.coalesce(F.col("_pmax"), local_abs)))
    d = d.withColumn(tmax_col, F.greatest(F.col("_ltmax"), F.coalesce(F.col("_ptmax"), F.col("_ltmax"))))
    return d.drop("_bkt", "_lj", "_lmax", "_ltmax", "_off", "_pmax", "_ptmax")
