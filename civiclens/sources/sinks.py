"""Sinks (K01-K07): partitioned writes through the DataFrame writer.

Counts of written rows come from ``observe`` (A02), so no second pass over the
data is needed.  Upserts never overwrite the path being read: the merged table
is written to a new directory that the caller then points at.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from civiclens.operators.aggregates import keep_last


def rows_to_json(df: DataFrame, out_col: str = "json") -> DataFrame:
    """Each row as a JSON object text."""
    return df.select(F.to_json(F.struct(*[F.col(c) for c in df.columns])).alias(out_col))


def _write_counted(df: DataFrame, writer_fn) -> int:
    obs = Observation("written")
    observed = df.observe(obs, F.count(F.lit(1)).alias("rows"))
    writer_fn(observed)
    return int(obs.get["rows"])


def write_json(df: DataFrame, path: str, mode: str = "overwrite") -> int:
    """JSON Lines, returns the row count."""
    return _write_counted(df, lambda d: d.write.mode(mode).json(path))


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> int:
    """Header CSV."""
    return _write_counted(df, lambda d: d.write.mode(mode).option("header", True).csv(path))


def append(df: DataFrame, path: str, fmt: str = "parquet", partition_by: Sequence[str] = ()) -> int:
    """Append rows (feature table, plain insert)."""
    def w(d: DataFrame) -> None:
        writer = d.write.mode("append").format(fmt)
        if partition_by:
            writer = writer.partitionBy(*partition_by)
        writer.save(path)

    return _write_counted(df, w)


def sorted_union(frames: Sequence[DataFrame], fill: str = "") -> DataFrame:
    """Ragged frames stacked by name; columns = sorted union of all
    names; missing cells become ``fill``."""
    u = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [f.select([F.col(c).cast("string") for c in f.columns]) for f in frames])
    cols = sorted(u.columns)
    return u.select(*[F.coalesce(F.col(c), F.lit(fill)).alias(c) for c in cols])


def write_sorted_union(frames: Sequence[DataFrame], path: str) -> int:
    """Overwrite ``path`` with the sorted union; empty input writes nothing and returns 0."""
    u = sorted_union(frames)
    if u.isEmpty():
        return 0
    return write_csv(u, path)


def merge_upsert(existing: DataFrame, updates: DataFrame, key: str, order_cols: Sequence[str | Column]) -> DataFrame:
    """INSERT OR REPLACE semantics: the last update row per key replaces the
    stored row; untouched stored rows stay."""
    latest = keep_last(updates, [key], order_cols)
    kept = existing.join(latest.select(key), key, "left_anti")
    return kept.unionByName(latest.select(*existing.columns))


def upsert_table(spark: SparkSession, current_path: str, updates: DataFrame, key: str, order_cols: Sequence[str | Column], new_path: str) -> DataFrame:
    """K04 as a table operation: read ``current_path``, write the merge to
    ``new_path`` (never the path being read), return the new table."""
    if new_path.rstrip("/") == current_path.rstrip("/"):
        raise ValueError("upsert must write to a new path")
    merged = merge_upsert(spark.read.parquet(current_path), updates, key, order_cols)
    merged.write.mode("overwrite").parquet(new_path)
    return spark.read.parquet(new_path)


def typed_rows(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """CSV with a declared schema in FAILFAST mode: a bad cast aborts the job.
    ``published.AppendTable.append`` lands it, checks the key in the same pass and
    publishes it."""
    return spark.read.option("header", True).option("mode", "FAILFAST").schema(schema).csv(path)


def typed_load(spark: SparkSession, path: str, schema: StructType | str, key: Sequence[str]) -> DataFrame:
    """K07 without a table: the rows, after a primary-key check (a duplicate key
    aborts)."""
    df = typed_rows(spark, path, schema)
    dup = df.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)
    if not dup.isEmpty():
        raise ValueError(f"duplicate primary key in {path}")
    return df
