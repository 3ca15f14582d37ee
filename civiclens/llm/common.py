"""Shared helpers of the training-data operators: table access, the column
rules every operator follows, and written intermediate tables.

Rules that hold for every operator here: a NULL text counts as the empty text
unless the operator says otherwise; extra columns of any name are ignored (the
operators select what they need first); an empty table gives an empty result
with the same columns.
"""

from __future__ import annotations

import gc
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from civiclens.functions.frames import free_memory, freed_after
from civiclens.session import ensure_checkpoint_dir, ship_package

ROW_GROUP_BYTES = 16 << 20  # of intermediate tables: a writing task holds one row group
BATCH_CONF = "spark.sql.execution.arrow.maxBytesPerBatch"
SPARK_BATCH_BYTES = f"{64 << 20}b"  # Spark's own limit
BATCH_BYTES = 8 << 20
IDS = 1 << 24  # bits of the bitmaps of document ids
DOCUMENT_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver tables, read by Spark from any store."""
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, text)`` with NULL text as the empty text; other columns go."""
    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    )


def shuffle_width(spark: SparkSession) -> int:
    """The session's number of shuffle partitions."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def fold(id_col: str | Column, folds: int) -> Column:
    """crc32 of the id's decimal text, modulo ``folds``."""
    return F.pmod(F.crc32((F.col(id_col) if isinstance(id_col, str) else id_col).cast("string").cast("binary")), F.lit(folds))


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder of ``spark.checkpoint.dir``:
    it cuts the lineage and outlives a lost executor."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/llm/{name}-{uuid.uuid4().hex}"
    df.write.option("parquet.block.size", ROW_GROUP_BYTES).parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table._scratch = path
    return table


def release(*tables: DataFrame) -> None:
    """Delete tables of ``written`` that no plan still to run reads."""
    for t in tables:
        spark = t.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(t._scratch)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def trimmed(value):
    """``value``, after the memory that making it has freed goes back to the system:
    the driver trains on a bounded sample and then plans many steps."""
    gc.collect()
    free_memory()
    return value


def bounded_batches(spark: SparkSession) -> None:
    """Batches of at most ``BATCH_BYTES`` go to Python workers, unless the session sets
    a limit of its own: Spark's 10,000 rows are as large as the texts are, and the
    executor and the worker hold several batches at once."""
    if spark.conf.get(BATCH_CONF, SPARK_BATCH_BYTES) == SPARK_BATCH_BYTES:
        spark.conf.set(BATCH_CONF, str(BATCH_BYTES))


def bitmap_of(values: DataFrame, column: str, size: int = IDS) -> np.ndarray:
    """A bitmap of ``size`` bits of a column's 64-bit values: at most size / 64 words
    reach the driver, whatever the input."""

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            columns = [pa.array([b.column(i).to_numpy(zero_copy_only=False).tobytes()], pa.binary()) for i in range(2)]
            yield pa.RecordBatch.from_arrays(columns, names=["at", "bits"])

    bit = F.pmod(F.col(column), F.lit(size))
    words = (
        values.where(F.col(column).isNotNull())
        .groupBy(F.shiftright(bit, 6).cast("int").alias("at"))
        .agg(F.bit_or(F.expr(f"shiftleft(1L, cast(pmod(`{column}`, 64) as int))")).alias("bits"))
    )
    out = np.zeros(size // 64, dtype=np.int64)
    for r in words.mapInArrow(freed_after(packed), "at binary, bits binary").collect():
        out[np.frombuffer(r["at"], dtype=np.int32)] = np.frombuffer(r["bits"], dtype=np.int64)
    return out.view(np.uint64)


def in_bitmap(bitmap: np.ndarray, values: np.ndarray) -> np.ndarray:
    at = (values.view(np.uint64) % np.uint64(64 * len(bitmap))).astype(np.int64)
    return (bitmap[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) == 1


def ids_in(bitmap: np.ndarray, ids: pd.Series) -> np.ndarray:
    """Which ids may be those of a bitmap; NULL is none of them."""
    known = ids.notna().to_numpy()
    return known & in_bitmap(bitmap, ids.fillna(0).to_numpy(dtype=np.int64))


def likely(rows: DataFrame, bitmap) -> DataFrame:
    """The rows whose ``doc_id`` may be in a broadcast bitmap, found by a join with its
    words (at most size / 64): a task that goes on in Python needs no second worker."""
    words = bitmap.value.view(np.int64)
    at = np.flatnonzero(words)
    noted = rows.sparkSession.createDataFrame(pa.table({"_at": pa.array(at, pa.int64()), "_bits": pa.array(words[at], pa.int64())}))
    place = F.shiftright(F.pmod(F.col("doc_id"), F.lit(64 * len(words)).cast("long")), 6)
    bit = F.getbit(F.col("_bits"), F.pmod(F.col("doc_id"), F.lit(64)).cast("int"))
    return rows.join(F.broadcast(noted), place == F.col("_at")).where(bit == 1).drop("_at", "_bits")
