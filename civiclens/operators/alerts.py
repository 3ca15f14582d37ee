"""Hot-spot clusters (G01-G05) and per-row support alerts.

One scan, one grouped aggregation per output: the segment aggregate and the two
per-segment top-k lists are hash aggregations joined on the segment key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from civiclens.functions.exprs import (
    floor_block,
    py_round,
    join_address,
    literal_map,
    rank_of,
    redact,
    strip_ws,
    to_double,
    upper_trim_default,
)

# --------------------------------------------------------------------------
# Fixed values (must equal the reference's texts and thresholds).
# Severity labels by unrounded score: >= 75 CRITICAL, >= 50 HIGH RISK,
# >= 25 ELEVATED, otherwise MONITOR.
SEVERITY_THRESHOLDS = [(75, "CRITICAL"), (50, "HIGH RISK"), (25, "ELEVATED"), (0, "MONITOR")]
RECOMMENDATIONS = {
    "CRITICAL": "Immediate engineering review required. Deploy traffic safety improvements (signals, barriers, repaving) within 30 days.",
    "HIGH RISK": "Schedule engineering assessment within 60 days. Review signal timing and sight-line obstructions.",
    "ELEVATED": "Flag for next quarterly road inspection cycle. Review posted speed limits.",
    "MONITOR": "Add to monthly monitoring list. No immediate action required.",
}
DEFECT_EXCLUSIONS = ["NO DEFECTS", "UNKNOWN", ""]
# Injury severity ranks; FATAL INJURY is the portal's spelling of FATAL.
SEVERITY_RANK = {
    "FATAL": 4,
    "FATAL INJURY": 4,
    "INCAPACITATING INJURY": 3,
    "NONINCAPACITATING INJURY": 2,
    "REPORTED, NOT EVIDENT": 1,
    "NO INDICATION OF INJURY": 0,
}
SUPPORT_RESOURCES = {
    "chicago": {
        "trauma": "https://www.chicago.gov/city/en/depts/cdph/supp_info/behavioral-health/trauma-informed-care.html",
        "legal_aid": "https://www.illinoislegalaid.org/",
        "road_complaint": "https://311.chicago.gov/s/",
        "insurance_help": "https://insurance.illinois.gov/consumer/InjuredInAnAccident.html",
        "victim_services": "https://www.chicago.gov/city/en/depts/fss/supp_info/victim-services.html",
    },
    "default": {
        "trauma": "https://www.samhsa.gov/find-help/national-helpline",
        "legal_aid": "https://www.lawhelp.org/",
        "road_complaint": "https://www.usa.gov/local-governments",
        "insurance_help": "https://www.naic.org/consumer_alert_auto.htm",
        "victim_services": "https://ovc.ojp.gov/help-for-crime-victims/find-help",
    },
}
NOTE_HIT_AND_RUN = "Hit-and-run — victim may need additional legal support."
NOTE_DEFECT = "Road defect recorded: {}."
NOTE_DEVICE = "Traffic device condition: {}."
NOTE_DEFECT_SKIP = ["", "NO DEFECTS", "UNKNOWN", "NAN"]
NOTE_DEVICE_SKIP = ["", "FUNCTIONING PROPERLY", "NAN"]
# --------------------------------------------------------------------------


def cluster_score(n: Column, injuries: Column, fatals: Column, injury_weight: float = 8.0, fatal_weight: float = 25.0) -> Column:
    """min(100, 15·ln(1+n) + w_i·injuries + w_f·fatals)."""
    return F.least(
        F.lit(100.0),
        F.log1p(n.cast("double")) * 15 + injuries * F.lit(float(injury_weight)) + fatals * F.lit(float(fatal_weight)),
    )


def cluster_label(score: Column) -> Column:
    """Label of the unrounded score."""
    expr = None
    for threshold, label in SEVERITY_THRESHOLDS[:-1]:
        expr = (F.when(score >= threshold, F.lit(label)) if expr is None else expr.when(score >= threshold, F.lit(label)))
    return expr.otherwise(F.lit(SEVERITY_THRESHOLDS[-1][1]))


def recommendation(label: Column, defects: Column) -> Column:
    """Text per label plus the known defects."""
    base = F.coalesce(F.element_at(literal_map(RECOMMENDATIONS), label), F.lit("Review with city traffic engineering team."))
    tail = F.when(F.size(defects) > 0, F.concat(F.lit(" Known road defects: "), F.array_join(defects, ", "), F.lit(".")))
    return F.concat(base, F.coalesce(tail, F.lit("")))


def _segment_frame(df: DataFrame, street_no: str, street_name: str, block_size: int) -> DataFrame:
    cols = set(df.columns)
    number = F.coalesce(to_double(street_no), F.lit(0.0)) if street_no in cols else F.lit(0.0)
    # pandas: to_numeric → fillna(0) → astype(int) truncates, then floor-divides.
    block = floor_block(F.coalesce(number.try_cast("bigint"), F.lit(0).cast("bigint")), block_size)
    street = upper_trim_default(street_name) if street_name in cols else F.lit("UNKNOWN")
    return df.withColumn("_block", block).withColumn("_street", street).withColumn(
        "_segment", F.concat(F.col("_block").cast("string"), F.lit(" "), F.col("_street"))
    )


def hotspot_clusters(
    df: DataFrame,
    street_no: str = "street_no",
    street_name: str = "street_name",
    injuries: str = "injuries_total",
    fatal: str = "injuries_fatal",
    cause: str = "prim_contributory_cause",
    defect: str = "road_defect",
    min_crashes: int = 3,
    block_size: int = 100,
    injury_weight: float = 8.0,
    fatal_weight: float = 25.0,
    top_k: int = 3,
) -> DataFrame:
    """Road segments (block + street) with at least ``min_crashes`` rows.

    Output: segment, street_name, block, crash_count, injury_count, fatal_count,
    risk_score (Python round to 1 decimal), severity, contributing_causes (array),
    road_defects (array), recommendation.  Sorted by score desc, then segment.
    """
    cols = set(df.columns)
    work = _segment_frame(df, street_no, street_name, block_size)
    inj = F.coalesce(to_double(injuries), F.lit(0.0)) if injuries in cols else F.lit(0.0)
    fat = F.coalesce(to_double(fatal), F.lit(0.0)) if fatal in cols else F.lit(0.0)

    # One scan, one shuffle of partial aggregates: every row counts for its cause
    # (kind 1, NULL too, so the causes add up to the segment) and its defect (kind 2).
    # Ranking and totals per (segment, kind) run on aggregated rows only, and the
    # final fold collects at most ``top_k`` values per list.
    cause_c = F.col(cause).cast("string") if cause in cols else F.lit(None).cast("string")
    defect_c = F.col(defect).cast("string") if defect in cols else F.lit(None).cast("string")
    kinds = F.array(
        F.struct(F.lit(1).alias("k"), cause_c.alias("v")),
        F.struct(F.lit(2).alias("k"), defect_c.alias("v")),
    )
    keys = ["_block", "_street"]  # the segment's text follows from them
    x = work.select(*keys, inj.alias("_i"), fat.alias("_f"), F.explode(kinds).alias("_kv"))
    agg = x.groupBy(*keys, F.col("_kv.k").alias("_k"), F.col("_kv.v").alias("_v")).agg(
        F.count(F.lit(1)).alias("_n"), F.sum("_i").alias("_inj"), F.sum("_f").alias("_fat")
    )
    excluded = F.upper(F.col("_v")).isin([e.upper() for e in DEFECT_EXCLUSIONS])
    listed = F.col("_v").isNotNull() & ((F.col("_k") == 1) | ~excluded)
    agg = agg.withColumn("_listed", listed).filter((F.col("_k") == 1) | listed)
    group = Window.partitionBy(*keys, "_k")
    in_order = group.orderBy(F.desc("_listed"), F.desc("_n"), F.asc("_v"))  # a NULL cause comes last
    ranked = agg.withColumn("_rn", F.row_number().over(in_order))
    for name, of in (("_cn", "_n"), ("_ci", "_inj"), ("_cf", "_fat")):
        ranked = ranked.withColumn(name, F.sum(of).over(group))
    ranked = ranked.filter(F.col("_rn") <= max(1, top_k))

    def top(kind: int) -> Column:
        items = F.array_sort(F.collect_list(F.when((F.col("_k") == kind) & F.col("_listed"), F.struct(F.col("_rn"), F.col("_v")))))
        return F.transform(items, lambda e: e["_v"])

    first = (F.col("_k") == 1) & (F.col("_rn") == 1)
    seg = (
        ranked.groupBy(*keys)
        .agg(
            F.max(F.when(first, F.col("_cn"))).alias("crash_count"),
            F.max(F.when(first, F.col("_ci"))).cast("bigint").alias("injury_count"),
            F.max(F.when(first, F.col("_cf"))).cast("bigint").alias("fatal_count"),
            top(1).alias("contributing_causes"),
            top(2).alias("road_defects"),
        )
        .filter(F.col("crash_count") >= min_crashes)
        .withColumn("_segment", F.concat(F.col("_block").cast("string"), F.lit(" "), F.col("_street")))
    )

    score = cluster_score(F.col("crash_count"), F.col("injury_count"), F.col("fatal_count"), injury_weight, fatal_weight)
    empty = F.array().cast("array<string>")
    out = (
        seg.withColumn("_score", score)
        .withColumn("contributing_causes", F.coalesce("contributing_causes", empty))
        .withColumn("road_defects", F.coalesce("road_defects", empty))
        .withColumn("severity", cluster_label(F.col("_score")))
        .select(
            F.col("_segment").alias("segment"),
            F.col("_street").alias("street_name"),
            F.col("_block").cast("string").alias("block"),
            "crash_count",
            "injury_count",
            "fatal_count",
            py_round("_score", 1).alias("risk_score"),
            "severity",
            "contributing_causes",
            "road_defects",
            recommendation(F.col("severity"), F.col("road_defects")).alias("recommendation"),
        )
    )
    return out.orderBy(F.desc("risk_score"), F.asc("segment"))


def export_clusters(clusters: DataFrame) -> DataFrame:
    """Flat export form, lists joined with `` | ``."""
    return clusters.select(
        "segment",
        "street_name",
        "block",
        "crash_count",
        "injury_count",
        "fatal_count",
        "risk_score",
        "severity",
        F.array_join("contributing_causes", " | ").alias("top_causes"),
        F.array_join("road_defects", " | ").alias("road_defects"),
        "recommendation",
    )


def _text(df_cols: set[str], name: str) -> Column:
    return F.col(name).cast("string") if name in df_cols else F.lit(None).cast("string")


def row_alerts(
    df: DataFrame,
    city: str = "chicago",
    min_severity_rank: int = 1,
    redact_contacts: bool = True,
    severity_ranks: dict[str, int] | None = None,
    id_col: str = "crash_join_id",
    date_col: str = "crash_date",
    severity_col: str = "most_severe_injury",
    street_no: str = "street_no",
    street_direction: str = "street_direction",
    street_name: str = "street_name",
    name_col: str = "driver_name",
    phone_col: str = "driver_phone",
    hit_and_run_col: str = "hit_and_run_i",
    defect_col: str = "road_defect",
    device_col: str = "device_condition",
) -> DataFrame:
    """One alert row per crash whose severity rank ≥ ``min_severity_rank``.

    Contacts are redacted unless ``redact_contacts`` is False.  Resource links of
    the city (or the default set) become ``resource_<kind>`` columns.
    """
    cols = set(df.columns)
    ranks = severity_ranks or SEVERITY_RANK
    sev = strip_ws(F.upper(F.coalesce(_text(cols, severity_col), F.lit(""))))
    rank = rank_of(sev, ranks)

    def clean(name: str) -> Column:
        return F.coalesce(strip_ws(_text(cols, name)), F.lit(""))

    def norm(name: str) -> Column:
        return strip_ws(F.upper(F.coalesce(_text(cols, name), F.lit(""))))

    notes = F.concat_ws(
        " ",
        F.when(norm(hit_and_run_col) == "Y", F.lit(NOTE_HIT_AND_RUN)),
        F.when(~norm(defect_col).isin(NOTE_DEFECT_SKIP), F.format_string(NOTE_DEFECT.replace("{}", "%s"), _text(cols, defect_col))),
        F.when(~norm(device_col).isin(NOTE_DEVICE_SKIP), F.format_string(NOTE_DEVICE.replace("{}", "%s"), _text(cols, device_col))),
    )
    name, phone = clean(name_col), clean(phone_col)
    if redact_contacts:
        name, phone = redact(name), redact(phone)
    resources = SUPPORT_RESOURCES.get(city.lower(), SUPPORT_RESOURCES["default"])
    return df.filter(rank >= min_severity_rank).select(
        F.coalesce(_text(cols, id_col), F.lit("")).alias("crash_join_id"),
        F.coalesce(_text(cols, date_col), F.lit("")).alias("crash_date"),
        sev.alias("injury_severity"),
        join_address(_text(cols, street_no), _text(cols, street_direction), _text(cols, street_name), drop_nan=True).alias("location"),
        name.alias("contact_name"),
        phone.alias("contact_phone"),
        notes.alias("notes"),
        *[F.lit(url).alias(f"resource_{kind}") for kind, url in resources.items()],
    )
