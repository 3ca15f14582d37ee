"""Structured Streaming forms of the batch operators.

Sources are file streams (new Parquet files landing in a folder); every job
takes a checkpoint location on shared storage, so a restarted driver or a lost
executor resumes from the last committed micro-batch.  ``run_available``
drives a query with the ``availableNow`` trigger (process what has landed,
then stop), which is also how the tests and the bindings run them.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from math import gcd, lcm

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from civiclens.operators.aggregates import keep_last
from civiclens.operators.rates import interval, simplest
from civiclens.session import ship_package
from civiclens.sources.published import KeyedTable


def file_stream(spark: SparkSession, path: str, schema: StructType | str, glob: str | None = None, max_files: int | None = None) -> DataFrame:
    """Parquet files landing under ``path``; ``max_files`` bounds a micro-batch."""
    r = spark.readStream.schema(schema)
    if glob:
        r = r.option("pathGlobFilter", glob)
    if max_files:
        r = r.option("maxFilesPerTrigger", max_files)
    return r.parquet(path)


def run_available(writer, checkpoint: str) -> StreamingQuery:
    q = writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return q


@contextmanager
def _state_store(spark: SparkSession):
    """Queries started inside keep their state in RocksDB with a changelog, unless
    the session names a store itself."""
    ours = {
        "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
        "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    }
    default = "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider"
    free = spark.conf.get(next(iter(ours)), default) == default
    before = {k: spark.conf.get(k, None) for k in ours} if free else {}
    for k in before:
        spark.conf.set(k, ours[k])
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def _run_into(stream: DataFrame, table: KeyedTable, checkpoint: str, mode: str, reduce=lambda d: d) -> StreamingQuery:
    """Run what has landed into a keyed table, one upsert per micro-batch; the batch
    id goes into the table's manifest, so a retried batch is applied once."""

    def merge(batch: DataFrame, epoch_id: int) -> None:
        table.upsert(reduce(batch), epoch_id)

    with _state_store(stream.sparkSession):
        q = run_available(stream.writeStream.outputMode(mode).foreachBatch(merge), checkpoint)
    if not table.versions():  # nothing has landed yet: an empty table
        table.upsert(stream.sparkSession.createDataFrame([], table.schema))
    q.table = table  # type: ignore[attr-defined]
    return q


# ------------------------------------------------------------------ T01

def keep_first_stream(stream: DataFrame, key_cols: Sequence[str], order_cols: Sequence[str], table_root: str, checkpoint: str,
                      buckets: int = 32) -> StreamingQuery:
    """The first row of each key by ``order_cols`` (A01 on a stream).

    The first row so far is state of its key in the state store.  A micro-batch gives
    the first rows of the keys it holds; a late row that comes before the one known is
    a correction.  They replace their keys' rows in a keyed table, which writes the
    buckets concerned only.  So the table does not depend on how the input is cut into
    micro-batches, nor on their order, and a restart goes on from state and manifest.
    """
    columns = [f.name for f in stream.schema.fields]
    first = F.min_by(F.struct(*columns), F.struct(*order_cols))
    firsts = stream.groupBy(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(key_cols)]).agg(first.alias("_row")).select("_row.*")
    table = KeyedTable(stream.sparkSession, table_root, stream.schema, key_cols, buckets)
    q = _run_into(firsts, table, checkpoint, "update")
    q.current_table = table.glob()  # type: ignore[attr-defined]
    return q


# ------------------------------------------------------------------ T02

def upsert_stream(stream: DataFrame, table_root: str, key: str, order_cols: Sequence[str], checkpoint: str,
                  initial_version: str, buckets: int = 32) -> StreamingQuery:
    """Each micro-batch is merged (K04) into a keyed table that begins as the
    rows of ``initial_version``: the last update of a key replaces its row.  Only the
    buckets of a batch's keys are written; a restart or a retried batch goes on from
    the manifest, not from driver memory.
    """
    spark = stream.sparkSession
    initial = spark.read.parquet(initial_version)
    table = KeyedTable(spark, table_root, initial.schema, [key], buckets)
    if not table.versions():
        table.upsert(initial)
    q = _run_into(stream, table, checkpoint, "append", lambda batch: keep_last(batch, [key], list(order_cols)).select(*initial.columns))
    q.current_table = table.glob()  # type: ignore[attr-defined]
    return q


# ------------------------------------------------------------------ T03

def token_bucket_stream(stream: DataFrame, key_col: str, order_cols: Sequence[str], t_us_col: str, capacity: float,
                        refill_per_s: float, out_cols: Sequence[str]) -> DataFrame:
    """Stateful token bucket per key with ``applyInPandasWithState``.

    State per key is three numbers (requests seen, running max of t_j − j·Δ,
    running max of t), so the closed form of W06 continues across batches with
    vectorised cumulative maxima.  Rows of a key inside one micro-batch are
    ordered by ``order_cols`` before they are admitted.
    """
    ship_package(stream.sparkSession)
    # as in rates.token_bucket_delay: exact fractions over one denominator
    delta = interval(refill_per_s)
    ahead = (1 - simplest(capacity)) * delta
    scale = lcm(delta.denominator, ahead.denominator)
    step, lead = int(delta * scale), int(ahead * scale)
    in_cols = [key_col, *[c for c in order_cols if c != key_col], t_us_col, *[c for c in out_cols if c not in (key_col, t_us_col, *order_cols)]]
    out_schema = ", ".join(
        [f"{c} {stream.schema[c].dataType.simpleString()}" for c in dict.fromkeys([key_col, *out_cols, t_us_col])]
        + ["admit_us long", "delay_us long"]
    )

    def fn(key, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(pdfs), ignore_index=True).sort_values(list(order_cols), kind="mergesort")
        n, m, tm = state.get if state.exists else (0, None, None)
        t = pdf[t_us_col].to_numpy(dtype=np.int64)
        number = np.int64 if scale == 1 else object  # whole numbers of any length for fractions
        idx = (n + np.arange(len(t), dtype=np.int64)).astype(number)
        scaled = t.astype(number) * scale
        run_m = np.maximum.accumulate(scaled - idx * step)
        run_t = np.maximum.accumulate(scaled)
        if m is not None:
            run_m = np.maximum(run_m, int(m))
            run_t = np.maximum(run_t, int(tm))
        admit = np.maximum(run_t, run_m + idx * step + lead)
        state.update((int(n + len(t)), str(run_m[-1]), str(run_t[-1])))
        if scale > 1:
            admit = np.asarray([(2 * a + scale) // (2 * scale) for a in admit], dtype=np.int64)
        out = pdf[list(dict.fromkeys([key_col, *out_cols, t_us_col]))].copy()
        out["admit_us"] = admit
        out["delay_us"] = admit - t
        yield out

    return stream.select(*dict.fromkeys(in_cols)).groupBy(key_col).applyInPandasWithState(
        fn, out_schema, "n long, m string, tm string", "append", GroupStateTimeout.NoTimeout
    )


# ------------------------------------------------------------------ T04

def sliding_segment_counts(stream: DataFrame, ts_col: str, segment: Column, window: str, slide: str, delay: str) -> DataFrame:
    """Crashes per segment over sliding windows, emitted once the watermark
    passes the window end (append mode)."""
    s = stream.withColumn(ts_col, F.col(ts_col).cast("timestamp")).withWatermark(ts_col, delay)
    return s.groupBy(F.window(ts_col, window, slide).alias("w"), segment.alias("segment")).agg(
        F.count(F.lit(1)).alias("crash_count")
    ).select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "segment", "crash_count")


def window_counts_stream(stream: DataFrame, ts_col: str, segment: Column, window: str, slide: str, table_root: str,
                         checkpoint: str, buckets: int = 8) -> StreamingQuery:
    """T04 with all windows, those still open among them, by panes: a row counts in
    one pane (the largest stretch of time that windows share whole), not in each window
    that holds it.  Pane counts are state in the state store and go into a keyed table;
    windows are sums of their panes.  No row is too late and no window waits for its
    end, so the counts do not depend on how the input is cut into micro-batches.  A
    day's slide in a week's window keeps a seventh of the rows of state.

    ``q.panes``: the keyed table; ``q.current_table``: the windows of its version.
    """
    spark = stream.sparkSession
    width = gcd(*(int(pd.Timedelta(x).total_seconds() * 1_000_000) for x in (window, slide)))
    pane = F.window(F.col(ts_col).cast("timestamp"), f"{width} microseconds")
    counts = stream.groupBy(pane.alias("p"), segment.alias("segment")).agg(F.count(F.lit(1)).alias("crash_count"))
    rows = counts.select(F.col("p.start").alias("pane_start"), "segment", "crash_count")
    panes = KeyedTable(spark, f"{table_root.rstrip('/')}/panes", rows.schema, ["pane_start", "segment"], buckets)
    q = _run_into(rows, panes, checkpoint, "update")
    held = panes.read().select(F.window("pane_start", window, slide).alias("w"), "segment", "crash_count")
    windows = held.groupBy(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "segment").agg(F.sum("crash_count").alias("crash_count"))
    q.panes = panes  # type: ignore[attr-defined]
    q.current_table = f"{table_root.rstrip('/')}/windows/v={panes.versions()[-1]}"  # type: ignore[attr-defined]
    windows.write.mode("overwrite").parquet(q.current_table)
    return q


def to_parquet(df: DataFrame, path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    return run_available(df.writeStream.format("parquet").option("path", path).outputMode(mode), checkpoint)

