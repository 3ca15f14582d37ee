"""Rate analysis over request logs (W05, W06): the reference's in-process
limiters re-aimed as per-key ordered scans.

Both are closed forms of the limiter recurrences.  The interval is an exact
fraction of a microsecond (a rate of 3 per second has 1000000/3) and capacities may
be fractional; only the results are rounded, half up, to whole microseconds:

* fixed interval Δ = 1/rate:   start_i = i·Δ + max_{j≤i}(t_j − j·Δ)
* token bucket, capacity C, one token every Δ (refill rate 1/Δ), starting full:
      admit_i = max( max_{j≤i} t_j ,  max_{j≤i}(t_j − j·Δ) + (i + 1 − C)·Δ )

The running maxima come from :func:`civiclens.plans.scan.running_index_and_max`,
which keeps a hot key parallel by scanning buckets of about equally many rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from fractions import Fraction
from math import lcm

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from civiclens.plans.scan import running_index_and_max


def interval(rate_per_s: float) -> Fraction:
    """Microseconds between two permits: an exact fraction.  A float rate stands for
    the simplest fraction that it is the float of."""
    return 1_000_000 / simplest(rate_per_s)


def simplest(x: float) -> Fraction:
    """The fraction of the smallest power-of-ten bounded denominator that a float
    is nearest to (1/21600 and 0.7 are themselves)."""
    for digits in range(1, 17):
        f = Fraction(x).limit_denominator(10**digits)
        if float(f) == float(x):
            return f
    return Fraction(x)


def whole_us(value: Column, scale: int) -> Column:
    """``value / scale`` of an integer, rounded half up to whole microseconds."""
    if scale == 1:
        return value
    twice = (value * 2 + F.lit(scale)).cast("decimal(38,0)")
    unit = F.lit(2 * scale).cast("decimal(20,0)")
    return ((twice - F.pmod(twice, unit)) / unit).cast("bigint")


def times(n: Column, factor: int, scale: int) -> Column:
    """``n * factor``, in decimals when the interval is a fraction."""
    if scale == 1:
        return n * F.lit(factor)
    return (n.cast("decimal(19,0)") * F.lit(factor).cast("decimal(18,0)")).cast("decimal(38,0)")


def _bucket(t_col: str, width_us: int | None) -> Column | None:
    """Buckets of a fixed time; None: buckets measured from the rows."""
    return None if width_us is None else F.floor(F.col(t_col) / F.lit(width_us)).cast("bigint")


def throttle_slots(
    df: DataFrame,
    key_cols: Sequence[str],
    order_cols: Sequence[str],
    t_us_col: str,
    rate_per_s: float,
    bucket_us: int | None = None,
) -> DataFrame:
    """Slot start of each request under a fixed-interval limiter (per key)."""
    if rate_per_s <= 0:
        raise ValueError("rate must be greater than 0")
    step, scale = interval(rate_per_s).as_integer_ratio()
    d = running_index_and_max(df, key_cols, order_cols, _bucket(t_us_col, bucket_us), t_us_col, step, scale)
    start = whole_us(times(F.col("_idx"), step, scale) + F.col("_runmax"), scale)
    return d.withColumn("slot_start_us", start).withColumn("delay_us", start - F.col(t_us_col)).drop("_idx", "_runmax", "_tmax")


def token_bucket_delay(
    df: DataFrame,
    key_cols: Sequence[str],
    order_cols: Sequence[str],
    t_us_col: str,
    capacity: float,
    refill_per_s: float,
    bucket_us: int | None = None,
) -> DataFrame:
    """Admission time and delay of each unit-cost request (per key)."""
    if capacity <= 0:
        raise ValueError("capacity must be greater than 0")
    if refill_per_s <= 0:
        raise ValueError("refill_rate must be greater than 0")
    if capacity < 1:
        raise ValueError("a capacity under 1 never admits a unit request")
    # the interval and what (1 - capacity) intervals take, over one denominator
    delta = interval(refill_per_s)
    ahead = (1 - simplest(capacity)) * delta
    scale = lcm(delta.denominator, ahead.denominator)
    step, lead = int(delta * scale), int(ahead * scale)
    d = running_index_and_max(df, key_cols, order_cols, _bucket(t_us_col, bucket_us), t_us_col, step, scale)
    admit = whole_us(F.greatest(F.col("_tmax"), F.col("_runmax") + times(F.col("_idx"), step, scale) + F.lit(lead)), scale)
    return d.withColumn("admit_us", admit).withColumn("delay_us", admit - F.col(t_us_col)).drop("_idx", "_runmax", "_tmax")
