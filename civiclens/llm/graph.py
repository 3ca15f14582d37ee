"""Connected components of an edge table, in Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from civiclens.llm.common import release, written


def components(edges: DataFrame) -> DataFrame:
    """``(node, component)`` of the nodes of ``edges`` (``a, b``): the smallest node
    reachable.  Each round takes the smallest label among the neighbours and then
    the label of that label, so long chains shrink by halves; rounds end when no
    label changes.  Labels are written tables, nothing reaches the driver but a
    flag."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct()
    both = written(both, "edges")
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.least("node", F.min("b")).alias("component")), "labels")
    before = labels
    while True:
        near = (
            both.join(labels.select(F.col("node").alias("b"), F.col("component").alias("near")), "b")
            .groupBy(F.col("a").alias("node"))
            .agg(F.min("near").alias("near"))
        )
        lower = labels.join(near, "node").select("node", F.col("component").alias("old"), F.least("component", "near").alias("step"))
        jump = labels.select(F.col("node").alias("step"), F.col("component").alias("far"))
        new = written(lower.join(jump, "step").select("node", F.least("step", "far").alias("component"), "old"), "labels")
        release(before)
        before, labels = new, new.select("node", "component")
        if new.where("component <> old").isEmpty():
            release(both)
            return labels


def merged(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """The components (``node, component``) after ``edges`` too: however many edges join
    two of the components, they count as one."""
    of = lambda c: labels.select(F.col("node").alias(c), F.col("component").alias(f"{c}_label"))
    ends = edges.select("a", "b").join(of("a"), "a", "left").join(of("b"), "b", "left").select(
        F.coalesce("a_label", "a").alias("a"), F.coalesce("b_label", "b").alias("b")
    )
    joined = components(ends.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    further = joined.select(F.col("node").alias("component"), F.col("component").alias("further"))
    return written(
        labels.join(further, "component", "left").select("node", F.coalesce("further", "component").alias("component"))
        .unionByName(joined.join(labels, "node", "left_anti").select("node", "component")),
        "labels",
    )
