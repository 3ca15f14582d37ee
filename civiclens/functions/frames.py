"""Python over Arrow batches with whole ids.

Spark hands a long column with NULLs to pandas as floats, which cannot hold every
id over 2^53.  ``map_frames`` is ``mapInPandas`` without that.  A Python worker outlives
its task; ``freed_after`` gives back the memory that the task has freed.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


def free_memory() -> None:
    """Memory that was freed goes back to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim:
        trim(0)


def freed_after(fn: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``fn`` over a task's batches; what it has freed goes back when the task ends."""

    def run(batches: Iterator) -> Iterator:
        try:
            yield from fn(batches)
        finally:
            free_memory()

    return run


def frame_of(batch: pa.RecordBatch) -> pd.DataFrame:
    """A batch as a frame; a long column with NULLs is ``Int64``."""
    frame = batch.to_pandas()
    for i, field in enumerate(batch.schema):
        column = batch.column(i)
        if field.type == pa.int64() and column.null_count:
            values, gone = column.fill_null(0).to_numpy(zero_copy_only=False), column.is_null().to_numpy(zero_copy_only=False)
            frame[field.name] = pd.arrays.IntegerArray(values.copy(), gone.copy())
    return frame


def map_frames(df: DataFrame, fn: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], schema: str) -> DataFrame:
    """``fn`` over the frames of Arrow batches, like ``mapInPandas``; empty batches
    are passed over."""
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in fn(frame_of(b) for b in batches if b.num_rows):
            yield pa.RecordBatch.from_pandas(frame, schema=arrow, preserve_index=False)

    return df.mapInArrow(freed_after(run), schema)
