"""Grouped aggregates: keep-first, per-group top-k, value counts, KPIs.

All of them are hash aggregations with a map-side partial phase, so a key that
holds a third of the rows is combined on every mapper before the shuffle; none
collects a whole group into one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from civiclens.functions.exprs import col, to_double


def _order_struct(order_cols: Sequence[str | Column]) -> Column:
    if not order_cols:
        raise ValueError("order_cols must name at least one column ending in a unique key")
    return F.struct(*[col(c) for c in order_cols])


def keep_first(df: DataFrame, key_cols: Sequence[str], order_cols: Sequence[str | Column]) -> DataFrame:
    """First row per key in the given order (a NULL key is one group).

    ``min_by`` over a struct of all columns is a declarative aggregate with a
    partial phase, so hot keys are reduced map-side (no per-key sort of the
    whole group as a ``row_number`` window would do).
    """
    cols = df.columns
    picked = df.groupBy(*key_cols).agg(
        F.min_by(F.struct(*[F.col(c) for c in cols]), _order_struct(order_cols)).alias("_row")
    )
    return picked.select(*[F.col(f"_row.{c}").alias(c) for c in cols])


def keep_last(df: DataFrame, key_cols: Sequence[str], order_cols: Sequence[str | Column]) -> DataFrame:
    """Last row per key in the given order."""
    cols = df.columns
    picked = df.groupBy(*key_cols).agg(
        F.max_by(F.struct(*[F.col(c) for c in cols]), _order_struct(order_cols)).alias("_row")
    )
    return picked.select(*[F.col(f"_row.{c}").alias(c) for c in cols])


def topk_values_per_group(
    df: DataFrame,
    group_cols: Sequence[str],
    value_col: str,
    k: int = 3,
    exclude_upper: Sequence[str] | None = None,
    out_col: str = "top_values",
    count_col: str | None = None,
) -> DataFrame:
    """The ``k`` most frequent non-null values per group.

    Ties break by value ascending.  ``exclude_upper`` drops values whose
    upper-cased text is in the list (G03).  The window runs on the already
    aggregated (group, value) counts and Spark adds a partial window-group
    limit before its shuffle, so at most ``k`` rows per group and mapper move.
    ``count_col`` takes pre-aggregated counts (rows are summed instead of counted).
    """
    v = F.col(value_col)
    base = df.filter(v.isNotNull())
    if exclude_upper:
        base = base.filter(~F.upper(v.cast("string")).isin([e.upper() for e in exclude_upper]))
    n = F.sum(count_col) if count_col else F.count(F.lit(1))
    counts = base.groupBy(*group_cols, value_col).agg(n.alias("_n"))
    w = Window.partitionBy(*group_cols).orderBy(F.desc("_n"), F.asc(value_col))
    ranked = counts.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= k)
    return ranked.groupBy(*group_cols).agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct(F.col("_rn"), v.alias("v")))), lambda x: x["v"]
        ).alias(out_col)
    )


def value_counts(df: DataFrame, value_col: str, top: int | None = None) -> DataFrame:
    """Counts of non-null values, count desc then value asc; ``top`` rows when given."""
    out = (
        df.filter(F.col(value_col).isNotNull())
        .groupBy(value_col)
        .agg(F.count(F.lit(1)).alias("count"))
    )
    if top:
        # A top-k report: the limit is the feature (TakeOrderedAndProject).
        out = out.orderBy(F.desc("count"), F.asc(value_col)).limit(top)
    return out


def kpi_summary(
    df: DataFrame,
    injuries_col: str = "injuries_total",
    fatal_col: str = "injuries_fatal",
    damage_col: str = "damage",
    prefix_len: int = 20,
) -> DataFrame:
    """Count, injury and fatal sums, most common damage (first 20 chars).

    Absent columns give 0 / 'N/A' as on the dashboard.  One scan: rows are
    grouped by the damage value (partial aggregation on the map side), then the
    groups are folded into the totals and the most common non-null value (ties
    go to the smallest), so no buffer grows with the number of distinct values.
    """
    cols = set(df.columns)
    dmg = F.col(damage_col).cast("string") if damage_col in cols else F.lit(None).cast("string")
    inj = F.coalesce(F.sum(to_double(injuries_col)), F.lit(0.0)) if injuries_col in cols else F.lit(0.0)
    fat = F.coalesce(F.sum(to_double(fatal_col)), F.lit(0.0)) if fatal_col in cols else F.lit(0.0)
    groups = df.groupBy(dmg.alias("_d")).agg(F.count(F.lit(1)).alias("_n"), inj.alias("_inj"), fat.alias("_fat"))
    rank = F.when(F.col("_d").isNotNull(), F.struct((-F.col("_n")).alias("n"), F.col("_d").alias("d")))
    out = groups.agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("total_crashes"),
        F.coalesce(F.sum("_inj"), F.lit(0.0)).cast("bigint").alias("total_injuries"),
        F.coalesce(F.sum("_fat"), F.lit(0.0)).cast("bigint").alias("total_fatal"),
        F.min_by(F.col("_d"), rank).alias("_mode"),
    )
    return out.select(
        "total_crashes",
        "total_injuries",
        "total_fatal",
        F.coalesce(F.substring("_mode", 1, prefix_len), F.lit("N/A")).alias("most_common_damage"),
    )


def count_per_key(df: DataFrame, key_col: str, out_col: str = "n") -> DataFrame:
    """Rows per key."""
    return df.groupBy(key_col).agg(F.count(F.lit(1)).alias(out_col))
