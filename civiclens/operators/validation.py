"""Validation (V01-V03): rule violations, key uniqueness, referential checks.

Every check is one aggregation pass; rule results are unpivoted from a single
row of counters, so no row-level explode is needed.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """One schema rule: ``kind`` is required | enum | pattern | type | datetime | minimum."""

    column: str
    kind: str
    param: object = None


def violation(rule: Rule) -> Column:
    c = F.col(rule.column)
    if rule.kind == "required":
        return c.isNull()
    if rule.kind == "enum":
        return c.isNotNull() & ~c.cast("string").isin(list(rule.param))
    if rule.kind == "pattern":
        return c.isNotNull() & ~c.cast("string").rlike(str(rule.param))
    if rule.kind == "type":
        return c.isNotNull() & c.cast("string").try_cast(str(rule.param)).isNull()
    if rule.kind == "datetime":
        return c.isNotNull() & c.cast("string").try_cast("timestamp").isNull()
    if rule.kind == "minimum":
        return c.isNotNull() & (c.cast("string").try_cast("double") < F.lit(float(rule.param)))
    raise ValueError(f"unknown rule kind {rule.kind!r}")


def validate_rules(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Violations per (column, rule) — rules with no violation report 0."""
    counters = [F.sum(violation(r).cast("int")).alias(f"_v{i}") for i, r in enumerate(rules)]
    one = df.agg(*counters)
    rows = F.array(
        *[
            F.struct(F.lit(r.column).alias("column"), F.lit(r.kind).alias("rule"), F.coalesce(F.col(f"_v{i}"), F.lit(0)).cast("bigint").alias("violations"))
            for i, r in enumerate(rules)
        ]
    )
    return one.select(F.inline(rows))


def key_violations(df: DataFrame, key_cols: Sequence[str]) -> DataFrame:
    """Keys that occur more than once, with their count."""
    return df.groupBy(*key_cols).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)


def orphan_counts(parent: DataFrame, child: DataFrame, parent_key: str, child_fk: str) -> DataFrame:
    """Child rows whose FK has no parent, parents without children, NULL FKs.

    Both sides are counted by key together: one scan of each, one shuffle of counts
    (combined on the map side, so a hot key is one row per task), no join.
    """
    tagged = parent.select(F.col(parent_key).alias("k"), F.lit(1).alias("p"), F.lit(0).alias("c")).unionByName(
        child.select(F.col(child_fk).alias("k"), F.lit(0).alias("p"), F.lit(1).alias("c"))
    )
    keys = tagged.groupBy("k").agg(F.sum("p").alias("p"), F.sum("c").alias("c"))
    total = lambda n, where: F.coalesce(F.sum(F.when(where, F.col(n))), F.lit(0)).cast("bigint")
    one = keys.agg(
        total("c", F.col("k").isNotNull() & (F.col("p") == 0)).alias("orphan_children"),
        total("p", F.col("k").isNull() | (F.col("c") == 0)).alias("parents_without_children"),
        total("c", F.col("k").isNull()).alias("null_foreign_keys"),
    )
    return one.select(F.inline(F.array(*[F.struct(F.lit(c).alias("check"), F.col(c).alias("n")) for c in one.columns])))
