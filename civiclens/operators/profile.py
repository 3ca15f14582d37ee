"""Dataset quality profile.

One grouped aggregation computes every metric for every group (city, source,
event type...) in a single pass; the duplicate rate needs a second grouped
pass keyed by the duplicate subset.  Both are hash aggregations with a partial
phase, so a group holding a third of all rows is combined on every mapper.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType

from civiclens.functions.exprs import days_between, parse_ts, py_fixed, py_round
from civiclens.plans.scan import join_null_safe

# --------------------------------------------------------------------------
# Fixed values (thresholds, weights and texts must equal the reference's).
CRITICAL_FIELDS = ["crash_date", "latitude", "longitude", "crash_join_id"]
WARN_MISSING_PCT = 20.0
WARN_DUPLICATE_RATE = 0.05
WARN_DELAY_DAYS = 14.0
WARN_STALENESS_DAYS = 30.0
WARN_CRITICAL_NULL = 5.0
MULTI_TITLE = ("Multi-City Dataset Quality Report (", " cities)\n")
MULTI_HEAD = ("City                           Source    Records  Score Issues", "-" * 65)
EMPTY_ISSUE = "Dataset is empty"
# --------------------------------------------------------------------------


def _is_missing(df: DataFrame, c: str) -> Column:
    """pandas ``isnull``: NULL, or NaN in a floating column."""
    dtype = df.schema[c].dataType
    if isinstance(dtype, (DoubleType, FloatType)):
        return F.col(c).isNull() | F.isnan(F.col(c))
    return F.col(c).isNull()


def _null_cells(df: DataFrame, cols: Sequence[str]) -> Column:
    expr = F.lit(0)
    for c in cols:
        expr = expr + _is_missing(df, c).cast("int")
    return expr


def quality_score(missing: Column, dup: Column, delay: Column, critical: Column, injury: Column) -> Column:
    """Weighted penalties, floored at 0."""
    s = (
        F.lit(100.0)
        - F.least(missing, F.lit(100.0)) * 0.30
        - F.least(critical, F.lit(100.0)) * 0.30
        - F.least(dup * 100, F.lit(100.0)) * 0.20
        - F.least(delay / 30, F.lit(1.0)) * 100 * 0.10
        - (F.lit(100.0) - F.least(injury, F.lit(100.0))) * 0.10
    )
    return F.greatest(F.lit(0.0), s)


def _fmt(x: Column, decimals: int) -> Column:
    return py_fixed(x, decimals)


def issue_flags(missing: Column, dup: Column, delay: Column, critical: Column, staleness: Column) -> Column:
    """Ordered list of issue texts for strict threshold breaches."""
    issues = F.array(
        F.when(missing > WARN_MISSING_PCT, F.concat(F.lit("High missing-field rate: "), _fmt(missing, 1), F.lit("% of cells are null."))),
        F.when(
            dup > WARN_DUPLICATE_RATE,
            F.concat(F.lit("Duplicate rate "), _fmt(dup * 100, 1), F.lit(f"% exceeds {WARN_DUPLICATE_RATE * 100:.0f}% threshold.")),
        ),
        F.when(delay > WARN_DELAY_DAYS, F.concat(F.lit("Avg ingestion delay "), _fmt(delay, 1), F.lit(" days — data may lag real events."))),
        F.when(
            critical > WARN_CRITICAL_NULL,
            F.concat(F.lit("Critical fields (lat/lon/date/id) have "), _fmt(critical, 1), F.lit("% nulls.")),
        ),
        F.when(
            staleness > WARN_STALENESS_DAYS,
            F.concat(F.lit("Most recent record is "), _fmt(staleness, 0), F.lit(" days old — feed may have stalled.")),
        ),
    )
    return F.filter(issues, lambda x: x.isNotNull())


def profile(
    df: DataFrame,
    group_cols: Sequence[str] = (),
    as_of: dt.datetime | str = "2024-02-15 00:00:00",
    crash_date_col: str = "crash_date",
    notified_date_col: str | None = "date_police_notified",
    dedup_subset: Sequence[str] | None = None,
    critical_fields: Sequence[str] = CRITICAL_FIELDS,
    injury_col: str = "injuries_total",
    source_type: str = "api",
) -> DataFrame:
    """One profile row per group (one row overall when ``group_cols`` is empty).

    ``as_of`` replaces the wall clock for staleness.  Metric columns are the
    unrounded values; :func:`profile_report` applies the reference's rounding.
    With no groups and no rows the empty-profile row (A04) is returned.
    """
    group_cols = list(group_cols)
    data_cols = [c for c in df.columns if c not in group_cols]
    ncols = len(data_cols)
    cols = set(data_cols)
    present_critical = [c for c in critical_fields if c in cols]

    aggs = [
        F.count(F.lit(1)).alias("total_records"),
        F.sum(_null_cells(df, data_cols)).alias("_null_cells"),
    ]
    if present_critical:
        aggs.append(F.sum(_null_cells(df, present_critical)).alias("_crit_cells"))
    if injury_col in cols:
        aggs.append(F.sum((~_is_missing(df, injury_col)).cast("int")).alias("_inj_present"))
    has_delay = notified_date_col is not None and crash_date_col in cols and notified_date_col in cols
    if has_delay:
        d = days_between(parse_ts(crash_date_col), parse_ts(notified_date_col))
        aggs.append(F.avg(F.when(d >= 0, d)).alias("_delay"))
    if crash_date_col in cols:
        aggs.append(F.max(parse_ts(crash_date_col)).alias("_latest"))

    base = df.groupBy(*group_cols).agg(*aggs) if group_cols else df.agg(*aggs)

    subset = [c for c in (dedup_subset or []) if c in cols] or data_cols
    dup = duplicate_rows(df, group_cols, subset)
    joined = join_null_safe(base, dup, group_cols) if group_cols else _attach_global(base, dup)

    n = F.col("total_records").cast("double")
    empty = F.col("total_records") == 0
    missing = F.when(empty, F.lit(100.0)).otherwise(F.col("_null_cells") / (n * ncols) * 100) if ncols else F.lit(0.0)
    dup_rate = F.when(empty, F.lit(0.0)).otherwise(F.coalesce(F.col("_dup_rows"), F.lit(0)) / n)
    delay = F.coalesce(F.col("_delay"), F.lit(0.0)) if has_delay else F.lit(0.0)
    delay = F.when(empty, F.lit(0.0)).otherwise(delay)
    if present_critical:
        critical = F.when(empty, F.lit(0.0)).otherwise(F.col("_crit_cells") / (n * len(present_critical)) * 100)
    else:
        critical = F.when(empty, F.lit(0.0)).otherwise(F.lit(100.0))
    if injury_col in cols:
        injury = F.when(empty, F.lit(100.0)).otherwise(F.col("_inj_present") / n * 100)
    else:
        injury = F.when(empty, F.lit(100.0)).otherwise(F.lit(0.0))
    if crash_date_col in cols:
        stale = F.greatest(F.lit(0.0), days_between(F.col("_latest"), F.lit(str(as_of)).cast("timestamp")))
        staleness = F.when(empty, F.lit(0.0)).otherwise(F.coalesce(stale, F.lit(0.0)))
    else:
        staleness = F.lit(0.0)

    out = joined.select(
        *group_cols,
        "total_records",
        missing.alias("missing_fields_pct"),
        dup_rate.alias("duplicate_rate"),
        delay.alias("avg_ingestion_delay_days"),
        critical.alias("critical_fields_null_pct"),
        injury.alias("injury_completeness_pct"),
        staleness.alias("staleness_days"),
    )
    m, dr, dl, cr, inj, st = (
        F.col("missing_fields_pct"),
        F.col("duplicate_rate"),
        F.col("avg_ingestion_delay_days"),
        F.col("critical_fields_null_pct"),
        F.col("injury_completeness_pct"),
        F.col("staleness_days"),
    )
    empty = F.col("total_records") == 0
    return out.select(
        "*",
        F.lit(source_type.lower().strip()).alias("data_source_type"),
        F.when(empty, F.lit(0.0)).otherwise(quality_score(m, dr, dl, cr, inj)).alias("quality_score"),
        F.when(empty, F.array(F.lit(EMPTY_ISSUE))).otherwise(issue_flags(m, dr, dl, cr, st)).alias("flagged_issues"),
    )


def duplicate_rows(df: DataFrame, group_cols: Sequence[str], subset: Sequence[str]) -> DataFrame:
    """Per group, rows that belong to a set of equal rows (over ``subset``)
    of size > 1 (pandas ``duplicated(keep=False)``; NULLs equal each other).

    One scan and one shuffle: equal rows are counted map-side first, so a value
    repeated in very many rows leaves one row per task.
    """
    g = list(group_cols)
    alike = df.groupBy(*dict.fromkeys([*g, *subset])).agg(F.count(F.lit(1)).alias("_n"))
    return alike.groupBy(*g).agg(F.sum(F.when(F.col("_n") > 1, F.col("_n")).otherwise(0)).alias("_dup_rows"))


def _attach_global(base: DataFrame, dup: DataFrame) -> DataFrame:
    """Both sides are single-row global aggregates: attach ``_dup_rows`` as a
    scalar subquery-free column by aggregating the union (no join needed)."""
    return (
        base.withColumn("_dup_rows", F.lit(None).cast("bigint"))
        .unionByName(dup.select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in base.schema.fields], "_dup_rows"))
        .agg(*[F.max(c).alias(c) for c in base.columns], F.max("_dup_rows").alias("_dup_rows"))
    )


def profile_report(profiled: DataFrame) -> DataFrame:
    """Reference rounding of the metric columns (Python ``round``: 2/4/2/2/2/1/1)."""
    rounding = {
        "missing_fields_pct": 2,
        "duplicate_rate": 4,
        "avg_ingestion_delay_days": 2,
        "critical_fields_null_pct": 2,
        "injury_completeness_pct": 2,
        "staleness_days": 1,
        "quality_score": 1,
    }
    return profiled.select(*[py_round(c, rounding[c]).alias(c) if c in rounding else F.col(c) for c in profiled.columns])


def ranked(profiled: DataFrame, tie_cols: Sequence[str]) -> DataFrame:
    """By quality score descending, ties by ``tie_cols``."""
    return profiled.orderBy(F.desc("quality_score"), *tie_cols)


def profile_text(report: DataFrame, name_col: str) -> DataFrame:
    """The fixed-width summary block of each profile row."""
    r = report
    lines = F.concat_ws(
        "\n",
        F.concat(F.lit("=== "), F.col(name_col).cast("string"), F.lit(" ("), F.upper("data_source_type"), F.lit(") ===")),
        F.concat(F.lit("  Records          : "), F.format_number(F.col("total_records"), 0)),
        F.concat(F.lit("  Quality score    : "), _fmt(F.col("quality_score"), 1), F.lit(" / 100")),
        F.concat(F.lit("  Missing fields   : "), _fmt(F.col("missing_fields_pct"), 1), F.lit("%")),
        F.concat(F.lit("  Duplicate rate   : "), _fmt(F.col("duplicate_rate") * 100, 1), F.lit("%")),
        F.concat(F.lit("  Ingestion delay  : "), _fmt(F.col("avg_ingestion_delay_days"), 1), F.lit(" days avg")),
        F.concat(F.lit("  Staleness        : "), _fmt(F.col("staleness_days"), 0), F.lit(" days since last record")),
        F.concat(F.lit("  Critical nulls   : "), _fmt(F.col("critical_fields_null_pct"), 1), F.lit("%")),
        F.concat(F.lit("  Injury complete  : "), _fmt(F.col("injury_completeness_pct"), 1), F.lit("%")),
        F.when(
            F.size("flagged_issues") > 0,
            F.concat(F.lit("  Issues:\n"), F.array_join(F.transform("flagged_issues", lambda x: F.concat(F.lit("    ⚠  "), x)), "\n")),
        ),
    )
    return r.select(F.col(name_col), lines.alias("summary"))


def _padded(c: Column, width: int, right: bool = False) -> Column:
    """``{:<n}`` and ``{:>n}``: longer texts stay whole."""
    pad = F.repeat(F.lit(" "), F.greatest(F.lit(0), F.lit(width) - F.length(c)))
    return F.concat(pad, c) if right else F.concat(c, pad)


def multi_profile_text(report: DataFrame, name_col: str) -> DataFrame:
    """The report over several datasets as rows ``section, quality_score, name,
    line``: title, column heads and rule (sections 0 to 2), then one line per dataset
    (section 3), best score first, equal scores by name.  ``ORDER BY section,
    quality_score DESC, name`` is the printed report."""
    name = F.col(name_col).cast("string")
    line = F.concat(
        _padded(name, 30), F.lit(" "), _padded(F.col("data_source_type"), 8), F.lit(" "),
        _padded(F.format_number(F.col("total_records"), 0), 8, True), F.lit(" "),
        _padded(_fmt(F.col("quality_score"), 1), 5, True), F.lit("  "), _padded(F.size("flagged_issues").cast("string"), 5, True),
    )
    cities = report.select(F.lit(3).alias("section"), F.col("quality_score"), name.alias("name"), line.alias("line"))
    title = F.concat(F.lit(MULTI_TITLE[0]), F.count(F.lit(1)).cast("string"), F.lit(MULTI_TITLE[1]))
    heads = report.agg(
        F.array(F.struct(F.lit(0).alias("section"), title.alias("line")), *[F.struct(F.lit(i).alias("section"), F.lit(x).alias("line")) for i, x in enumerate(MULTI_HEAD, 1)]).alias("h")
    ).select(F.inline("h"))
    return heads.select("section", F.lit(None).cast("double").alias("quality_score"), F.lit(None).cast("string").alias("name"), "line").unionByName(cities)
