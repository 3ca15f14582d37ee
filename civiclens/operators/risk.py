"""Risk scoring and feature building (G10-G14): pure column expressions, one
projection over the scan, no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from civiclens.functions.exprs import (
    clamp,
    hour_or_default,
    literal_map,
    missing_flag,
    night_flag,
    parse_ts,
    py_fixed,
    safe_float,
    to_double,
)

# --------------------------------------------------------------------------
# Fixed values (levels and explanation texts must equal the reference's).
LEVELS = [(80, "critical"), (60, "high"), (40, "medium")]
LEVEL_DEFAULT = "low"
EXPLAIN_TAIL = {
    "critical": " Immediate monitoring and response planning are recommended.",
    "high": " Elevated preparedness and active monitoring are recommended.",
    "medium": " Continue routine monitoring and review trends regularly.",
    "low": " Current impact appears limited, maintain baseline monitoring.",
}
FEATURE_VERSION = "v1.0"
FEATURES = ["lat", "lon", "hour", "is_night", "missing_location"]
# --------------------------------------------------------------------------


def score_from_magnitude(mag: Column) -> Column:
    """Clamp to 0-10, scale to 0-100, round half-even to an integer."""
    return F.bround(clamp(mag, 0.0, 10.0) / 10.0 * 100, 0).cast("int")


def risk_level(score: Column) -> Column:
    expr = F.when(score >= LEVELS[0][0], F.lit(LEVELS[0][1]))
    for threshold, label in LEVELS[1:]:
        expr = expr.when(score >= threshold, F.lit(label))
    return expr.otherwise(F.lit(LEVEL_DEFAULT))


def risk_score(df: DataFrame, magnitude_col: str = "magnitude") -> DataFrame:
    """Adds ``magnitude`` (NULL or unparsable → 0), ``risk_score``, ``risk_level``."""
    mag = safe_float(magnitude_col) if magnitude_col in df.columns else F.lit(0.0)
    d = df.withColumn("_mag", mag)
    d = d.withColumn("risk_score", score_from_magnitude(F.col("_mag")))
    d = d.withColumn("risk_level", risk_level(F.col("risk_score")))
    return d.withColumn(magnitude_col if magnitude_col in df.columns else "magnitude", F.col("_mag")).drop("_mag")


def explanation(level: Column, score: Column, magnitude: Column) -> Column:
    """Sentence with level, score and ``%.1f`` magnitude plus a tail per level."""
    tail = F.coalesce(F.element_at(literal_map(EXPLAIN_TAIL), level), F.lit(EXPLAIN_TAIL["low"]))
    return F.concat(
        F.lit("Risk level is "),
        level,
        F.lit(" with score "),
        score.cast("string"),
        F.lit("/100 based on earthquake magnitude "),
        py_fixed(magnitude, 1),
        F.lit("."),
        tail,
    )


def risk_explain(df: DataFrame, magnitude_col: str = "magnitude") -> DataFrame:
    """Score, level and explanation in one projection."""
    d = risk_score(df, magnitude_col)
    return d.withColumn("explanation", explanation(F.col("risk_level"), F.col("risk_score"), F.col(magnitude_col)))


def severity_proxy_score(df: DataFrame, injuries_col: str = "injuries_total") -> DataFrame:
    """Magnitude proxy ``min(injuries / 10, 10)`` scored by G10."""
    proxy = F.least(safe_float(injuries_col) / 10.0, F.lit(10.0))
    return risk_score(df.withColumn("severity_proxy", proxy), "severity_proxy")


def feature_build(df: DataFrame, lat: str = "lat", lon: str = "lon", timestamp: str = "timestamp") -> DataFrame:
    """Coerced lat/lon, hour (−1 when unknown), is_night, missing_location."""
    cols = set(df.columns)
    d = df.withColumn("lat", to_double(lat) if lat in cols else F.lit(None).cast("double"))
    d = d.withColumn("lon", to_double(lon) if lon in cols else F.lit(None).cast("double"))
    d = d.withColumn("timestamp", parse_ts(timestamp) if timestamp in cols else F.lit(None).cast("timestamp"))
    d = d.withColumn("hour", hour_or_default("timestamp"))
    d = d.withColumn("is_night", night_flag("hour"))
    return d.withColumn("missing_location", missing_flag("lat", "lon"))
