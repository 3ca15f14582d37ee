"""Ordered step composition: each step is ``DataFrame -> DataFrame``."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import DataFrame

Step = Callable[[DataFrame], DataFrame]


def run_steps(df: DataFrame, steps: Sequence[Step]) -> DataFrame:
    """Apply the steps in order (lazily: one plan until an action)."""
    return reduce(lambda d, f: d.transform(f), steps, df)
