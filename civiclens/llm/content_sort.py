"""Exact duplicates by a distributed content sort (DataFrame functions only).

Sampled splitters range-partition the rows by a short content key, Spark's
external sort puts equal texts next to each other, and neighbouring rows are
compared on the whole text.

* The splitter key is ``(first 32 characters, 64-bit hash of the whole text,
  slice)``.  Equal texts share it, so they meet; it stays short, so the sample of
  splitters that reaches the driver does not grow with the texts.  The window
  that compares neighbours is partitioned by that key and the whole text, which
  the range partitioning already satisfies: one shuffle of the texts, no more.
* A text with more copies than a quarter of an even share of rows is *hot*.  There
  are at most ``4 * partitions`` such texts, so their hashes are broadcast.  Their
  copies are dealt over slices in proportion to their number, each slice keeps
  its own head, and only the heads (at most ``5 * partitions`` rows) are compared
  again to find the head of the group.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from civiclens.llm.common import id_and_text, shuffle_width, written

SPLITTER_CHARS = 32


def hot_texts(rows: DataFrame, width: int) -> DataFrame:
    """``(content_hash, slices)`` of texts with over ``rows / (4 * width)`` copies:
    at most ``4 * width`` rows, whatever the input."""
    counts = rows.groupBy(F.xxhash64("text").alias("content_hash")).agg(F.count(F.lit(1)).alias("copies"))
    total = rows.agg(F.count(F.lit(1)).alias("total"))
    share = F.greatest(F.col("total") / F.lit(4.0 * width), F.lit(1.0))
    return (
        counts.where(F.col("copies") > 1)
        .join(F.broadcast(total), F.col("copies") > share)  # one row
        .select("content_hash", F.ceil(F.col("copies") / share).cast("int").alias("slices"))
    )


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "max") -> DataFrame:
    """Groups of documents whose texts are identical.

    Returns one row per input row: ``doc_id, keep_id, group_size, kept,
    text_sha256``.  ``keep`` says whether the smallest (``min``) or the largest
    (``max``) id of a group stays.  NULL text counts as empty.  A row repeated
    with the same id counts in ``group_size``; only one of its repeats is
    ``kept``.  A NULL id loses to any other id; if all are NULL, one NULL row is
    kept and ``keep_id`` is NULL.
    """
    spark = docs.sparkSession
    width = shuffle_width(spark)
    rows = id_and_text(docs, id_col, text_col)
    if keep == "max":
        best, first = F.max, F.col("doc_id").desc_nulls_last()
    else:
        best, first = F.min, F.col("doc_id").asc_nulls_last()

    keyed = (
        rows.withColumn("content_hash", F.xxhash64("text"))
        .join(F.broadcast(hot_texts(rows, width)), "content_hash", "left")
        .select(
            "doc_id",
            "text",
            "content_hash",
            F.substring("text", 1, SPLITTER_CHARS).alias("start"),
            F.coalesce(F.pmod(F.xxhash64(F.coalesce("doc_id", F.lit(-1)), F.lit("slice")), F.col("slices")), F.lit(-1))
            .cast("int")
            .alias("slice"),
        )
    )
    # one pass of sampled splitters, one shuffle, one external sort per partition
    dealt = keyed.repartitionByRange(width, "start", "content_hash", "slice")
    run = Window.partitionBy("start", "content_hash", "slice", "text")
    in_order = run.orderBy(first)
    compared = dealt.select(
        "doc_id",
        "slice",
        F.sha2("text", 256).alias("text_sha256"),
        F.row_number().over(in_order).alias("place"),
        F.first("doc_id").over(in_order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("head"),
        F.count(F.lit(1)).over(in_order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("run_size"),
        F.when((F.row_number().over(in_order) == 1) & (F.col("slice") >= 0), F.col("text")).alias("head_text"),
    )
    runs = written(compared, "content-sort")

    # the heads of the slices of hot texts, compared whole
    heads = runs.where((F.col("slice") >= 0) & (F.col("place") == 1))
    whole = heads.groupBy("head_text", "text_sha256").agg(
        best("head").alias("whole_head"),
        F.sum("run_size").alias("whole_size"),
        # the one slice whose head stays (ids repeated over slices meet in one slice)
        F.min(F.struct(F.col("head").isNull(), F.bitwise_not("head") if keep == "max" else F.col("head"), "slice"))
        .getField("slice")
        .alias("whole_slice"),
    ).drop("head_text")
    return runs.join(F.broadcast(whole), "text_sha256", "left").select(
        "doc_id",
        F.when(F.col("slice") >= 0, F.col("whole_head")).otherwise(F.col("head")).alias("keep_id"),
        F.coalesce("whole_size", "run_size").cast("long").alias("group_size"),
        ((F.col("place") == 1) & ((F.col("slice") < 0) | (F.col("slice") == F.col("whole_slice")))).alias("kept"),
        "text_sha256",
    )


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "max") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns: one row of each group of
    identical texts, that with the largest (``max``) or smallest id.  NULL text counts
    as empty, a NULL id loses to any other; rows repeated with the same id are copies.

    The same sort as above with the rows' columns carried along, so texts are
    shuffled once.  Of hot texts, the slice that holds the row that stays is found
    first: their rows are counted by (text, slice) on the map side.
    """
    spark = docs.sparkSession
    width = shuffle_width(spark)
    columns = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), columns)
    hot = written(hot_texts(rows.select("text"), width), "hot-texts")
    order = F.struct(F.col("doc_id").isNull(), F.bitwise_not("doc_id") if keep == "max" else F.col("doc_id"))
    keyed = (
        rows.withColumn("content_hash", F.xxhash64("text"))
        .join(F.broadcast(hot), "content_hash", "left")  # at most 4 rows per shuffle partition
        .withColumn("slice", F.coalesce(F.pmod(F.xxhash64(F.coalesce("doc_id", F.lit(-1)), F.lit("slice")), F.col("slices")), F.lit(-1)).cast("int"))
        .withColumn("start", F.substring("text", 1, SPLITTER_CHARS))
    )
    heads = keyed.where("slice >= 0").groupBy("content_hash", "text", "slice").agg(F.min(order).alias("head"))
    stays = heads.groupBy("content_hash", "text").agg(F.min(F.struct("head", "slice")).getField("slice").alias("stays"))
    stays = written(stays.select(F.col("content_hash").alias("h"), F.col("text").alias("t"), "stays"), "hot-heads")
    run = Window.partitionBy("start", "content_hash", "slice", "text").orderBy(F.col("doc_id").desc_nulls_last() if keep == "max" else F.col("doc_id").asc_nulls_last())
    first = keyed.repartitionByRange(width, "start", "content_hash", "slice").withColumn("place", F.row_number().over(run)).where("place = 1")
    calm = first.where("slice < 0").select("__row.*")
    held = first.where("slice >= 0").join(F.broadcast(stays), (F.col("content_hash") == F.col("h")) & (F.col("text") == F.col("t")) & (F.col("slice") == F.col("stays")), "left_semi")
    return calm.unionByName(held.select("__row.*"))
