"""Bindings of every operator to the driver tables.

Each function takes ``(spark, sf_dir)`` and returns a DataFrame over the whole
tables.  The equivalent DuckDB SQL lives in :mod:`civiclens.plans.oracle`; the
column names of both sides are the same.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from civiclens.operators import alerts
from civiclens.plans.tables import table

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}


def register(name: str) -> Callable[[Query], Query]:
    def deco(fn: Query) -> Query:
        REGISTRY[name] = fn
        return fn

    return deco


# ----------------------------------------------------------------- hot-spots

def crash_view_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem ⋈ part as crash rows: number = l_orderkey, street = p_brand."""
    li = table(spark, sf_dir, "lineitem")
    part = table(spark, sf_dir, "part")
    return li.join(part, li.l_partkey == part.p_partkey).select(
        F.col("l_orderkey").alias("street_no"),
        F.col("p_brand").alias("street_name"),
        (F.col("l_quantity") >= 48).cast("int").alias("injuries_total"),
        (F.col("l_quantity") >= 50).cast("int").alias("injuries_fatal"),
        F.col("p_type").alias("prim_contributory_cause"),
        # 'NF' and 'NO' play the role of NO DEFECTS / UNKNOWN in this binding.
        F.when(F.concat("l_returnflag", "l_linestatus") == "NF", F.lit("NO DEFECTS"))
        .when(F.concat("l_returnflag", "l_linestatus") == "NO", F.lit("UNKNOWN"))
        .otherwise(F.concat("l_returnflag", "l_linestatus"))
        .alias("road_defect"),
    )


@register("hotspot_clusters")
def q_hotspot_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    crashes = crash_view_lineitem(spark, sf_dir)
    return alerts.export_clusters(alerts.hotspot_clusters(crashes, min_crashes=3))


# --------------------------------------------------------------------- joins

def _orders_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    c = table(spark, sf_dir, "customer")
    return o.join(c, o.o_custkey == c.c_custkey)


@register("fuzzy_join")
def q_fuzzy_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from civiclens.operators.joins import fuzzy_join

    oc = _orders_customers(spark, sf_dir)
    crashes = oc.select(
        F.concat(F.lit("C"), F.col("o_orderkey").cast("string")).alias("crash_record_id"),
        F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss.SSS").alias("crash_date"),
        (F.col("o_orderkey") % 50).cast("string").alias("street_no"),
        F.col("o_orderstatus").alias("street_direction"),
        F.col("c_mktsegment").alias("street_name"),
        F.col("o_orderkey").alias("ord"),
    )
    moved = F.when(F.col("o_orderkey") % 35 == 0, F.add_months("o_orderdate", 240)).otherwise(F.to_date("o_orderdate"))
    head = F.concat_ws(" ", (F.col("o_orderkey") % 50).cast("string"), F.col("o_orderstatus"))
    contacts = oc.select(
        F.concat(F.lit("K"), F.col("o_orderkey").cast("string")).alias("crash_join_id"),
        F.date_format(moved, "yyyy-MM-dd").alias("date"),
        F.when(
            F.col("o_orderkey") % 3 == 0,
            F.concat(head, F.lit(" "), F.col("c_mktsegment"), F.lit(" #"), (F.col("o_custkey") % 10).cast("string")),
        ).otherwise(F.concat(head, F.lit(" "), F.substring("c_mktsegment", 1, 5))).alias("address"),
    )
    return fuzzy_join(contacts, crashes, order_cols=["ord"])


def _merge_sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    o = table(spark, sf_dir, "orders")
    i = table(spark, sf_dir, "lineitem")
    # a few rows of fixed number on each side have no key and match one another
    left = o.select(
        F.when(F.col("o_orderkey") > 3, F.col("o_orderkey")).alias("crash_join_id"),
        F.col("o_orderkey").alias("order_no"),
        F.col("o_orderstatus").alias("status"),
        F.col("o_totalprice").alias("amount"),
    )
    right = i.select(
        F.when(F.col("l_orderkey") > 5, F.col("l_orderkey")).alias("crash_join_id"),
        "l_linenumber",
        F.col("l_linestatus").alias("status"),
        F.col("l_extendedprice").alias("amount"),
    )
    return left, right


@register("merge_suffix")
def q_merge_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from civiclens.operators.joins import merge_suffix

    left, right = _merge_sides(spark, sf_dir)
    return merge_suffix(left, right)


@register("ensure_key")
def q_ensure_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    from civiclens.operators.joins import ensure_key

    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("crash_id"), "o_orderstatus")
    return ensure_key(o)


def _sync_sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    c = table(spark, sf_dir, "customer")
    o = table(spark, sf_dir, "orders")
    k3 = F.col("c_custkey") % 3
    base = c.select(
        F.col("c_custkey").cast("string").alias("crash_join_id"),
        "c_name",
        F.when(k3 == 0, F.lit("")).when(k3 == 1, F.lit(None)).otherwise(F.lit("X")).alias("o_orderstatus"),
        F.when(F.col("c_custkey") % 5 == 0, F.col("c_mktsegment")).otherwise(F.lit("")).alias("o_orderpriority"),
    )
    meta = o.select(
        F.when(F.col("o_orderkey") % 13 == 0, F.lit("")).otherwise(F.col("o_custkey").cast("string")).alias("crash_join_id"),
        "o_orderkey",
        "o_orderstatus",
        F.when(F.col("o_orderkey") % 4 == 0, F.lit("")).otherwise(F.col("o_orderpriority")).alias("o_orderpriority"),
    )
    return base, meta


@register("overlay_join")
def q_overlay_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from civiclens.operators.joins import overlay_join

    base, meta = _sync_sides(spark, sf_dir)
    return overlay_join(base, meta, order_cols=["o_orderkey"])


@register("sync_fill")
def q_sync_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    from civiclens.operators.joins import sync_metadata

    base, meta = _sync_sides(spark, sf_dir)
    return sync_metadata(base, meta, order_cols=["o_orderkey"], overwrite=False)


@register("sync_overwrite")
def q_sync_overwrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    from civiclens.operators.joins import sync_metadata

    base, meta = _sync_sides(spark, sf_dir)
    return sync_metadata(base, meta, order_cols=["o_orderkey"], overwrite=True)


@register("enrich_flag")
def q_enrich_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    from civiclens.operators.joins import enrich_flag

    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("crash_id"), "c_name")
    o = table(spark, sf_dir, "orders").filter(F.col("o_orderstatus") == "F")
    lookup = o.select(F.col("o_custkey").alias("crash_id"), "o_orderkey", "o_totalprice")
    out = enrich_flag(c, lookup, "crash_id", order_cols=["o_orderkey"])
    return out.select(
        "crash_id",
        "c_name",
        F.col("contact.o_orderkey").alias("contact_orderkey"),
        F.col("contact.o_totalprice").alias("contact_totalprice"),
        "has_contact",
    )


@register("priority_resolve")
def q_priority_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    from civiclens.operators.joins import priority_resolve

    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("crash_id"))
    o = table(spark, sf_dir, "orders")
    sources = []
    for status in ("F", "O", "P"):
        s = (
            o.filter(F.col("o_orderstatus") == status)
            .groupBy("o_custkey")
            .agg(F.max("o_orderkey").alias("k"))
            .select(
                F.col("o_custkey").alias("crash_id"),
                # an empty value is not a result: the next source is asked
                F.when(F.col("k") % 9 == 0, F.lit("")).otherwise(F.concat(F.lit(status + "-"), F.col("k").cast("string"))).alias("v"),
            )
        )
        sources.append(s)
    return priority_resolve(c, sources, "crash_id", "v")


# relational chain: customer (crash) → orders (unit) → lineitem (person)

def _crashes(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("crash_record_id"), F.col("c_mktsegment").alias("crash_type"), F.col("c_nationkey")
    )


def _units(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("crash_unit_id"),
        F.col("o_custkey").alias("crash_record_id"),
        F.col("o_orderdate").alias("crash_date"),
        F.col("o_orderstatus").alias("make"),
        F.col("o_orderpriority").alias("model"),
    )


def _people(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("person_id"),
        F.col("l_orderkey").alias("crash_unit_id"),
        F.when(F.col("l_returnflag") == "R", F.lit("FATAL INJURY")).otherwise(F.lit("NO INDICATION OF INJURY")).alias("injury_type"),
        F.col("l_quantity").alias("age"),
    )


@register("join_inner_filtered")
def q_join_inner_filtered(spark, sf_dir):
    c, v = _crashes(spark, sf_dir), _units(spark, sf_dir)
    return c.filter(F.col("crash_type") == "BUILDING").join(v, "crash_record_id").select(
        "crash_record_id", "crash_type", "crash_unit_id", "crash_date", "make", "model"
    )


@register("join_unit")
def q_join_unit(spark, sf_dir):
    v, p = _units(spark, sf_dir), _people(spark, sf_dir)
    return v.filter(F.col("model") == "1-URGENT").join(p, "crash_unit_id").select(
        "crash_unit_id", "crash_record_id", "person_id", "injury_type", "age"
    )


@register("join_left_chain")
def q_join_left_chain(spark, sf_dir):
    c, v, p = _crashes(spark, sf_dir), _units(spark, sf_dir), _people(spark, sf_dir)
    return (
        c.filter(F.col("crash_type") == "MACHINERY")
        .join(v, "crash_record_id", "left")
        .join(p, "crash_unit_id", "left")
        .select("crash_record_id", "crash_type", "crash_unit_id", "make", "person_id", "injury_type")
    )


@register("join_direct")
def q_join_direct(spark, sf_dir):
    # crash ↔ person directly: orders as crashes, lineitem rows carry the crash id
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("crash_record_id"), F.col("o_orderdate").alias("crash_date"))
    p = _people(spark, sf_dir).withColumnRenamed("crash_unit_id", "crash_record_id")
    return o.join(p, "crash_record_id").select("crash_record_id", "crash_date", "person_id", "injury_type")


@register("count_per_key")
def q_count_per_key(spark, sf_dir):
    from civiclens.operators.aggregates import count_per_key

    v = count_per_key(_units(spark, sf_dir), "crash_record_id", "n").select(
        F.lit("vehicles_per_crash").alias("kind"), F.col("crash_record_id").alias("key"), "n"
    )
    p = count_per_key(_people(spark, sf_dir), "crash_unit_id", "n").select(
        F.lit("people_per_unit").alias("kind"), F.col("crash_unit_id").alias("key"), "n"
    )
    return v.unionByName(p)


@register("injury_summary")
def q_injury_summary(spark, sf_dir):
    c, v, p = _crashes(spark, sf_dir), _units(spark, sf_dir), _people(spark, sf_dir)
    # people are counted per unit before they meet the units
    per_unit = p.groupBy("crash_unit_id").agg(
        F.count("person_id").alias("people"), F.count(F.when(F.col("injury_type") == "FATAL INJURY", 1)).alias("fatal")
    )
    j = c.join(v, "crash_record_id").join(per_unit, "crash_unit_id", "left")
    return j.groupBy("crash_record_id", "crash_unit_id", "crash_date", "make", "model").agg(
        F.coalesce(F.sum("people"), F.lit(0)).alias("occupant_count"),
        F.coalesce(F.sum("fatal"), F.lit(0)).alias("fatalities"),
    )


# ids and ranges: landed reports are the 'F' orders

def _found_ids(spark, sf_dir):
    return table(spark, sf_dir, "orders").filter(F.col("o_orderstatus") == "F").select(
        F.col("o_orderkey").alias("report_id"), "o_totalprice"
    )


def _probe_ids(spark, sf_dir):
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("id")).distinct()


@register("lookup_hits")
def q_lookup_hits(spark, sf_dir):
    from civiclens.operators.joins import lookup_hits

    return lookup_hits(_probe_ids(spark, sf_dir), _found_ids(spark, sf_dir), "id", "report_id").select("id", "o_totalprice")


@register("lookup_misses")
def q_lookup_misses(spark, sf_dir):
    from civiclens.operators.joins import lookup_misses

    return lookup_misses(_probe_ids(spark, sf_dir), _found_ids(spark, sf_dir), "id", "report_id")


@register("range_scan")
def q_range_scan(spark, sf_dir):
    from civiclens.operators.joins import multi_range_scan

    # one range in every block of 600 ids that occurs
    blocks = table(spark, sf_dir, "orders").select(F.floor(F.col("o_orderkey") / 600).cast("bigint").alias("range_no")).distinct()
    ranges = blocks.select(
        "range_no",
        (F.col("range_no") * 600).alias("start"),
        (F.col("range_no") * 600 + 400).alias("end"),
        F.lit(None).cast("int").alias("limit"),
    )
    return multi_range_scan(_found_ids(spark, sf_dir), ranges, ordered=False)


@register("multi_range_scan")
def q_multi_range_scan(spark, sf_dir):
    from civiclens.operators.joins import multi_range_scan

    c = table(spark, sf_dir, "customer")
    ranges = c.select(
        F.col("c_custkey").alias("range_no"),
        (F.col("c_custkey") * 10).alias("start"),
        (F.col("c_custkey") * 10 + 5 + F.col("c_nationkey")).alias("end"),
        (F.col("c_custkey") % 4 + 1).cast("int").alias("limit"),
    )
    return multi_range_scan(_found_ids(spark, sf_dir), ranges, ordered=False)


# ------------------------------------------------------------------- profile

PROFILE_AS_OF = "2024-03-15 00:00:00"


def events_profile_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as incident rows with nulls and delays made by fixed rules."""
    e = table(spark, sf_dir, "events")
    shift_ms = ((F.col("value") - 10) * 3600000).cast("bigint")
    return e.select(
        "event_type",
        F.when(F.col("event_id") % 97 == 0, F.lit(None)).otherwise(F.col("event_id")).alias("crash_join_id"),
        F.col("ts").alias("crash_date"),
        F.timestamp_millis(F.unix_millis(F.col("ts").cast("timestamp")) + shift_ms).alias("date_police_notified"),
        F.get_json_object("props", "$.k").try_cast("double").alias("latitude"),
        F.when(F.col("user_id") % 5 == 0, F.lit(None)).otherwise(F.col("value")).alias("longitude"),
        F.when(F.col("event_id") % 4 == 0, F.lit(None)).otherwise(F.col("user_id") % 3).alias("injuries_total"),
        "user_id",
        F.to_date("ts").alias("crash_day"),
    )


def _type_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    from civiclens.operators.profile import profile, profile_report

    f = events_profile_frame(spark, sf_dir)
    return profile_report(profile(f, ["event_type"], as_of=PROFILE_AS_OF, dedup_subset=["user_id", "crash_day"]))


def _with_issue_text(df: DataFrame) -> DataFrame:
    return df.withColumn("issues", F.array_join("flagged_issues", " | ")).withColumn(
        "n_issues", F.size("flagged_issues")
    ).drop("flagged_issues")


@register("dataset_profile")
def q_dataset_profile(spark, sf_dir):
    from civiclens.operators.profile import profile, profile_report

    f = events_profile_frame(spark, sf_dir).drop("event_type")
    p = profile_report(profile(f, as_of=PROFILE_AS_OF, dedup_subset=["user_id", "crash_day"]))
    return _with_issue_text(p)


@register("profile_empty")
def q_profile_empty(spark, sf_dir):
    from civiclens.operators.profile import profile, profile_report

    f = events_profile_frame(spark, sf_dir).drop("event_type").filter(F.col("user_id") < 0)
    return _with_issue_text(profile_report(profile(f, as_of=PROFILE_AS_OF)))


@register("missing_pct")
def q_missing_pct(spark, sf_dir):
    return _type_profile(spark, sf_dir).select("event_type", "missing_fields_pct")


@register("duplicate_rate")
def q_duplicate_rate(spark, sf_dir):
    return _type_profile(spark, sf_dir).select("event_type", "duplicate_rate")


@register("critical_null_pct")
def q_critical_null_pct(spark, sf_dir):
    return _type_profile(spark, sf_dir).select("event_type", "critical_fields_null_pct")


@register("completeness_pct")
def q_completeness_pct(spark, sf_dir):
    return _type_profile(spark, sf_dir).select("event_type", "injury_completeness_pct")


@register("staleness_days")
def q_staleness_days(spark, sf_dir):
    return _type_profile(spark, sf_dir).select("event_type", "staleness_days")


@register("issue_flags")
def q_issue_flags(spark, sf_dir):
    return _with_issue_text(_type_profile(spark, sf_dir)).select("event_type", "issues", "n_issues")


@register("avg_delay_days")
def q_avg_delay_days(spark, sf_dir):
    from civiclens.operators.profile import profile, profile_report

    o = table(spark, sf_dir, "orders")
    li = table(spark, sf_dir, "lineitem")
    f = o.join(li, o.o_orderkey == li.l_orderkey).select(
        "o_orderpriority", F.col("o_orderdate").alias("crash_date"), F.col("l_shipdate").alias("date_police_notified")
    )
    p = profile_report(profile(f, ["o_orderpriority"], as_of=PROFILE_AS_OF))
    return p.select("o_orderpriority", "avg_ingestion_delay_days")


@register("multi_profile_ranked")
def q_multi_profile_ranked(spark, sf_dir):
    from civiclens.operators.profile import ranked

    return ranked(_with_issue_text(_type_profile(spark, sf_dir)), ["event_type"])


@register("profile_text")
def q_profile_text(spark, sf_dir):
    from civiclens.operators.profile import profile_text

    return profile_text(_type_profile(spark, sf_dir), "event_type")


# ------------------------------------------------------------------- audits

def request_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as a landed request log: portal = user, report id = hour number."""
    e = table(spark, sf_dir, "events")
    hour = F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / 3600).cast("bigint")
    return e.select(
        F.col("user_id").alias("portal"),
        F.col("event_id").alias("pos"),
        F.when(F.col("event_type") == "signup", F.lit("n/a")).otherwise(F.concat(F.lit("RPT-"), hour.cast("string"))).alias("report_id"),
        (F.col("event_type") != "error").alias("ok"),
    )


@register("id_gap_rate")
def q_id_gap_rate(spark, sf_dir):
    from civiclens.operators.audit import id_gap_rate

    return id_gap_rate(request_log(spark, sf_dir), ["portal"], "pos", "report_id")


@register("id_enumeration_report")
def q_id_enumeration_report(spark, sf_dir):
    from civiclens.operators.audit import id_enumeration_report

    r = id_enumeration_report(request_log(spark, sf_dir), ["portal"], "pos", "report_id", F.col("ok"))
    return r.select(
        "portal",
        "ids_probed",
        "hits",
        "hit_rate",
        "gap_rate",
        "severity",
        F.size("findings").alias("n_findings"),
        F.array_join(
            F.transform("findings", lambda f: F.concat_ws(" :: ", f["severity"], f["category"], f["description"], f["evidence"])), " || "
        ).alias("findings_text"),
        "recommendation",
    )


def text_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select(
        F.concat(F.lit("doc/"), F.col("doc_id").cast("string")).alias("source_url"), "text"
    )
    p = table(spark, sf_dir, "pages").select(F.col("url").alias("source_url"), F.col("html").alias("text"))
    # records built from customers hold every pattern
    k, digits = F.col("c_custkey"), lambda n, width: F.lpad(n.cast("string"), width, "0")
    c = table(spark, sf_dir, "customer").select(
        F.concat(F.lit("customer/"), k.cast("string")).alias("source_url"),
        F.concat(
            F.lit("Driver: Ann Lee, DOB: 1/"), (k % 28 + 1).cast("string"), F.lit("/1990, SSN "),
            digits(k % 500 + 100, 3), F.lit("-"), digits(k % 99 + 1, 2), F.lit("-"), digits(k % 9999 + 1, 4),
            F.lit(", License: A"), digits(k, 7), F.lit(", plate KX-"), digits(k % 900 + 100, 3), F.lit(", call ("),
            digits(k % 800 + 100, 3), F.lit(") 555-"), digits(k % 10000, 4), F.lit(", c"), k.cast("string"), F.lit("@mail.example.org"),
        ).alias("text"),
    )
    return d.unionByName(p).unionByName(c)


@register("pii_scan")
def q_pii_scan(spark, sf_dir):
    from civiclens.operators.audit import pii_scan

    f = pii_scan(text_corpus(spark, sf_dir), "text", "source_url")
    return f.select(
        "source_url", "pattern_name", "severity", "match_count", F.array_join("sample_matches", " | ").alias("samples")
    )


@register("pii_summary")
def q_pii_summary(spark, sf_dir):
    from civiclens.operators.audit import pii_scan, pii_summary

    return pii_summary(pii_scan(text_corpus(spark, sf_dir), "text", "source_url"))


@register("sequence_signature")
def q_sequence_signature(spark, sf_dir):
    from civiclens.operators.audit import sequence_signature

    e = table(spark, sf_dir, "events").withColumn("day", F.to_date("ts"))
    return sequence_signature(
        e, ["user_id", "day"], ["ts", "event_id"], "event_type", ["error", "purchase"], ["day", "user_id"]
    )


# -------------------------------------------------------------------- rates

def _user_requests(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.select("user_id", "event_id", "ts", F.unix_micros(F.col("ts").cast("timestamp")).alias("t_us"))


@register("throttle_slots")
def q_throttle_slots(spark, sf_dir):
    from civiclens.operators.rates import throttle_slots

    out = throttle_slots(_user_requests(spark, sf_dir), ["user_id"], ["ts", "event_id"], "t_us", rate_per_s=1 / 21600)
    return out.select("user_id", "event_id", "t_us", "slot_start_us", "delay_us")


@register("token_bucket_delay")
def q_token_bucket_delay(spark, sf_dir):
    from civiclens.operators.rates import token_bucket_delay

    out = token_bucket_delay(
        _user_requests(spark, sf_dir), ["user_id"], ["ts", "event_id"], "t_us", capacity=3, refill_per_s=1 / 14400
    )
    return out.select("user_id", "event_id", "t_us", "admit_us", "delay_us")


# --------------------------------------------------------------- validation



def _order_rules():
    from civiclens.operators.validation import Rule

    return [
        Rule("o_orderkey", "required"),
        Rule("o_custkey", "required"),
        Rule("o_orderstatus", "enum", ("F", "O")),
        Rule("o_orderpriority", "pattern", "^[1-5]-[A-Z ]+$"),
        Rule("o_orderpriority", "enum", ("1-URGENT", "2-HIGH", "3-MEDIUM")),
        Rule("o_orderdate", "datetime"),
        Rule("o_totalprice", "minimum", 10000),
        Rule("o_totalprice", "type", "double"),
    ]


@register("validate_rules")
def q_validate_rules(spark, sf_dir):
    from civiclens.operators.validation import validate_rules

    return validate_rules(table(spark, sf_dir, "orders"), _order_rules())


@register("key_violations")
def q_key_violations(spark, sf_dir):
    from civiclens.operators.validation import key_violations

    return key_violations(table(spark, sf_dir, "orders"), ["o_custkey", "o_orderstatus"])


@register("orphan_counts")
def q_orphan_counts(spark, sf_dir):
    from civiclens.operators.validation import orphan_counts

    o = table(spark, sf_dir, "orders").filter(F.col("o_orderstatus") != "P").select("o_orderkey")
    li = table(spark, sf_dir, "lineitem").select(
        F.when(F.col("l_linenumber") == 7, F.lit(None)).otherwise(F.col("l_orderkey")).alias("l_orderkey")
    )
    return orphan_counts(o, li, "o_orderkey", "l_orderkey")


# --------------------------------------------------------------- risk, features

def _quakes(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    # magnitude = value / 50; text 'x' on errors exercises the unparsable rule
    mag = F.when(F.col("event_type") == "error", F.lit("x")).otherwise((F.col("value") / 50).cast("string"))
    return e.select(F.col("event_id").alias("id"), mag.alias("magnitude"))


@register("risk_score")
def q_risk_score(spark, sf_dir):
    from civiclens.operators.risk import risk_score

    return risk_score(_quakes(spark, sf_dir)).select("id", "magnitude", "risk_score", "risk_level")


@register("risk_explain")
def q_risk_explain(spark, sf_dir):
    from civiclens.operators.risk import risk_explain

    return risk_explain(_quakes(spark, sf_dir)).select("id", "risk_score", "risk_level", "explanation")


@register("severity_proxy_score")
def q_severity_proxy_score(spark, sf_dir):
    from civiclens.operators.risk import severity_proxy_score

    li = table(spark, sf_dir, "lineitem").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("crash_record_id"), F.col("l_quantity").alias("injuries_total")
    )
    return severity_proxy_score(li).select("crash_record_id", "severity_proxy", "risk_score", "risk_level")


@register("feature_build")
def q_feature_build(spark, sf_dir):
    from civiclens.operators.risk import feature_build

    e = table(spark, sf_dir, "events").select(
        "event_id",
        F.get_json_object("props", "$.k").alias("lat"),
        F.when(F.col("event_type") == "error", F.lit("n/a")).otherwise(F.col("value").cast("string")).alias("lon"),
        F.when(F.col("event_type") == "signup", F.lit("junk")).otherwise(F.col("ts").cast("string")).alias("timestamp"),
    )
    return feature_build(e).select("event_id", "lat", "lon", "hour", "is_night", "missing_location")


# ------------------------------------------------- keep-first, counts, top-k

@register("dedup_keep_first")
def q_dedup_keep_first(spark, sf_dir):
    from civiclens.operators.aggregates import keep_first

    e = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value")
    return keep_first(e, ["user_id"], ["ts", "event_id"])


def _crash_view_dash(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    part = table(spark, sf_dir, "part")
    return li.join(part, li.l_partkey == part.p_partkey).select(
        F.col("p_type").alias("crash_type"),
        F.col("p_brand").alias("prim_contributory_cause"),
        F.col("l_linestatus").alias("weather_condition"),
        (F.col("l_quantity") >= 48).cast("int").alias("injuries_total"),
        (F.col("l_quantity") >= 50).cast("int").alias("injuries_fatal"),
        F.when(F.col("l_discount") > 0.05, F.lit("OVER $1,500")).when(F.col("l_discount") > 0.02, F.lit("$501 - $1,500"))
        .otherwise(F.lit("$500 OR LESS")).alias("damage"),
        F.col("l_returnflag").alias("most_severe_injury"),
    )


@register("kpi_summary")
def q_kpi_summary(spark, sf_dir):
    from civiclens.operators.aggregates import kpi_summary

    return kpi_summary(_crash_view_dash(spark, sf_dir))


@register("value_counts_top")
def q_value_counts_top(spark, sf_dir):
    from civiclens.operators.aggregates import value_counts

    return value_counts(_crash_view_dash(spark, sf_dir), "prim_contributory_cause", top=10)


@register("value_counts_all")
def q_value_counts_all(spark, sf_dir):
    from civiclens.operators.aggregates import value_counts

    return value_counts(_crash_view_dash(spark, sf_dir), "crash_type")


@register("map_points")
def q_map_points(spark, sf_dir):
    from civiclens.operators.mapping import map_points

    c = table(spark, sf_dir, "customer").select(
        F.when(F.col("c_custkey") % 7 == 0, F.lit("bad")).otherwise(F.col("c_acctbal").cast("string")).alias("latitude"),
        F.when(F.col("c_custkey") % 5 == 0, F.lit(None)).otherwise(F.col("c_nationkey")).alias("longitude"),
    )
    return map_points(c)


@register("topk_values_per_group")
def q_topk_values_per_group(spark, sf_dir):
    from civiclens.operators.aggregates import topk_values_per_group

    v = crash_view_lineitem(spark, sf_dir)
    seg = (F.col("street_no") - F.pmod(F.col("street_no"), F.lit(100))).cast("string")
    t = topk_values_per_group(v.withColumn("segment", seg), ["segment"], "prim_contributory_cause", 3)
    return t.select("segment", F.array_join("top_values", " | ").alias("top_values"))


@register("topk_values_excluding")
def q_topk_values_excluding(spark, sf_dir):
    from civiclens.operators.aggregates import topk_values_per_group

    v = crash_view_lineitem(spark, sf_dir)
    seg = (F.col("street_no") - F.pmod(F.col("street_no"), F.lit(100))).cast("string")
    t = topk_values_per_group(v.withColumn("segment", seg), ["segment"], "road_defect", 3, alerts.DEFECT_EXCLUSIONS)
    return t.select("segment", F.array_join("top_values", " | ").alias("top_values"))


@register("row_alerts")
def q_row_alerts(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    c = table(spark, sf_dir, "customer")
    sev = (
        F.when(F.col("o_orderpriority") == "1-URGENT", F.lit("FATAL INJURY"))
        .when(F.col("o_orderpriority") == "2-HIGH", F.lit("incapacitating injury "))
        .when(F.col("o_orderpriority") == "3-MEDIUM", F.lit("NONINCAPACITATING INJURY"))
        .when(F.col("o_orderpriority") == "4-NOT SPECIFIED", F.lit("REPORTED, NOT EVIDENT"))
        .otherwise(F.lit("NO INDICATION OF INJURY"))
    )
    rows = o.join(c, o.o_custkey == c.c_custkey).select(
        F.col("o_orderkey").cast("string").alias("crash_join_id"),
        F.col("o_orderdate").cast("string").alias("crash_date"),
        sev.alias("most_severe_injury"),
        (F.col("o_orderkey") % 5000).cast("string").alias("street_no"),
        F.when(F.col("o_orderkey") % 2 == 0, F.lit("N")).otherwise(F.lit("")).alias("street_direction"),
        F.col("c_mktsegment").alias("street_name"),
        F.col("c_name").alias("driver_name"),
        F.when(F.col("c_custkey") % 10 == 0, F.lit(None)).otherwise(F.format_string("555-01%02d", F.col("c_custkey") % 100)).alias("driver_phone"),
        F.when(F.col("o_orderstatus") == "F", F.lit("Y")).otherwise(F.lit("N")).alias("hit_and_run_i"),
        F.when(F.col("o_orderstatus") == "O", F.lit("RUT, HOLES")).when(F.col("o_orderstatus") == "P", F.lit("NO DEFECTS")).alias("road_defect"),
        F.when(F.col("o_totalprice") > 300000, F.lit("NOT FUNCTIONING")).otherwise(F.lit("FUNCTIONING PROPERLY")).alias("device_condition"),
    )
    return alerts.row_alerts(rows, city="chicago", min_severity_rank=2)


# --------------------------------------------------------------- HTML jobs

@register("html_links")
def q_html_links(spark, sf_dir):
    from civiclens.sources.html import html_links

    # landed pages carry no link titles: every link with text is a listing hit
    return html_links(table(spark, sf_dir, "pages"), title_phrase=None, source="pages")


def _report_pages(spark, sf_dir):
    """The landed pages and one built from each order: a table, a list, a form, ids,
    or a page that was not found."""
    o = table(spark, sf_dir, "orders")
    key = F.col("o_orderkey").cast("string")
    kind = F.col("o_orderkey") % 5
    html = (
        F.when(kind == 0, F.concat(
            F.lit("<table><tr><th>County</th><td>C"), F.col("o_custkey").cast("string"), F.lit("</td></tr><tr><td>Report Date</td><td> "),
            F.col("o_orderdate").cast("date").cast("string"), F.lit("</td></tr></table><p>Driver</p>")))
        .when(kind == 1, F.concat(
            F.lit("<dl><dt>Location of Crash</dt><dd>"), F.col("o_orderpriority"), F.lit("</dd><dt> troop </dt><dd>T"),
            (F.col("o_custkey") % 9).cast("string"), F.lit("</dd></dl>")))
        .when(kind == 2, F.concat(
            F.lit('<form action="find"><input name="'), F.when(F.col("o_orderkey") % 2 == 0, "report_number").otherwise("caseNumber"),
            F.lit('" value="'), key, F.lit('"><input type="hidden" name="csrf_token" value="t"><select name="s"><option value="a"><option value="'),
            F.col("o_orderstatus"), F.lit('" selected></select></form>')))
        .when(kind == 3, F.concat(F.lit('<div id="report_num">R'), key, F.lit('</div><p id="involved_party">Owner</p>')))
        .otherwise(F.lit("<p>No records found</p>"))
    )
    built = o.select((F.col("o_orderkey") + 1_000_000_000).alias("page_id"), F.concat(F.lit("http://built.example.com/p/"), key).alias("url"), html.alias("html"))
    return table(spark, sf_dir, "pages").select("page_id", "url", "html").unionByName(built)


@register("html_fields")
def q_html_fields(spark, sf_dir):
    from civiclens.sources.html import html_fields

    return html_fields(_report_pages(spark, sf_dir), default_troop="C", source="pages")


@register("html_forms")
def q_html_forms(spark, sf_dir):
    from civiclens.sources.html import html_forms

    forms = html_forms(_report_pages(spark, sf_dir), search_url="http://portal.example.com/lookup/")
    for c in ("fields", "hidden"):
        pairs = F.transform(F.map_entries(c), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
        forms = forms.withColumn(c, F.array_join(F.array_sort(pairs), "&"))
    return forms


@register("html_by_id")
def q_html_by_id(spark, sf_dir):
    from civiclens.sources.html import html_by_id

    return html_by_id(_report_pages(spark, sf_dir), agency="pages")


@register("html_valid")
def q_html_valid(spark, sf_dir):
    from civiclens.sources.html import html_valid

    return html_valid(_report_pages(spark, sf_dir))


# ------------------------------------------------------- landed files (sources)

def _scratch(spark: SparkSession, name: str) -> str:
    import uuid

    from civiclens.session import scratch_path

    return scratch_path(spark, f"{name}-{uuid.uuid4().hex[:12]}")


@register("scan_csv_limit")
def q_scan_csv_limit(spark, sf_dir):
    from civiclens.sources.files import scan_csv_limit

    path = _scratch(spark, "customer-csv")
    c = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("crash_record_id"), "c_name", "c_nationkey", "c_mktsegment"
    )
    c.write.mode("overwrite").option("header", True).csv(path)
    return scan_csv_limit(spark, path, limit=0)


@register("scan_newest_k")
def q_scan_newest_k(spark, sf_dir):
    from civiclens.sources.files import read_json, scan_newest_k

    path = _scratch(spark, "orders-json")
    o = table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_orderstatus", F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss.SSS").alias("crash_date")
    )
    o.write.mode("overwrite").json(path)
    return scan_newest_k(read_json(spark, path), 100, "crash_date", "o_orderkey")


@register("geojson_explode")
def q_geojson_explode(spark, sf_dir):
    from civiclens.sources.files import geojson_explode, read_geojson

    e = table(spark, sf_dir, "events")
    feature = F.struct(
        F.concat(F.lit("ev"), F.col("event_id").cast("string")).alias("id"),
        F.struct(
            F.unix_millis(F.col("ts").cast("timestamp")).alias("time"),
            F.when(F.col("event_type") == "signup", F.lit(None)).otherwise(F.col("value") / 10).alias("mag"),
        ).alias("properties"),
        F.when(
            F.col("event_type") != "error",
            F.struct(
                F.array(F.col("value"), F.get_json_object("props", "$.k").cast("double"), F.col("user_id").cast("double")).alias("coordinates")
            ),
        ).alias("geometry"),
    )
    # one FeatureCollection per 100 consecutive events: every document is bounded
    docs = e.groupBy(F.floor(F.col("event_id") / 100).alias("doc")).agg(
        F.to_json(F.struct(F.lit("FeatureCollection").alias("type"), F.collect_list(feature).alias("features"))).alias("value")
    )
    path = _scratch(spark, "geojson")
    docs.select("value").write.mode("overwrite").text(path)
    g = geojson_explode(read_geojson(spark, path))
    return g.select(
        "id", "timestamp", F.col("location")[0].alias("lon"), F.col("location")[1].alias("lat"), F.col("location")[2].alias("depth"), "magnitude"
    )


@register("arcgis_explode")
def q_arcgis_explode(spark, sf_dir):
    from civiclens.sources.files import arcgis_explode

    c = table(spark, sf_dir, "customer")
    attrs = F.to_json(F.struct(F.struct("c_custkey", "c_name", "c_nationkey").alias("attributes")))
    docs = c.groupBy(F.floor(F.col("c_custkey") / 50).alias("doc")).agg(
        # non-object elements (a number, a null) are part of the landed layer
        F.concat(F.lit('{"features":['), F.array_join(F.collect_list(attrs), ","), F.lit(',1,null]}')).alias("value")
    )
    path = _scratch(spark, "arcgis")
    docs.select("value").write.mode("overwrite").text(path)
    return arcgis_explode(spark.read.text(path), "value", "c_custkey bigint, c_name string, c_nationkey int")


@register("nested_case_ids")
def q_nested_case_ids(spark, sf_dir):
    from civiclens.sources.files import nested_case_ids

    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    case_number = F.when(k % 3 == 0, F.lit(None)).when(k % 3 == 1, F.lit("")).otherwise(F.concat(F.lit(" A"), k.cast("string"), F.lit(" ")))
    row = F.to_json(F.struct(case_number.alias("CaseNumber"), k.alias("StateCase")))
    g = F.floor(k / 20)
    docs = o.groupBy(g.alias("doc")).agg(F.array_join(F.array_sort(F.collect_list(F.struct(k.alias("k"), row.alias("r"))))["r"], ",").alias("rows"))
    docs = docs.select(
        "doc",
        F.when(F.col("doc") % 2 == 0, F.concat(F.lit('{"Results":[['), F.col("rows"), F.lit("]]}")))
        .otherwise(F.concat(F.lit('{"Results":['), F.col("rows"), F.lit("]}"))).alias("payload"),
    )
    return nested_case_ids(docs, "payload", ["doc"])


@register("csv_from_text")
def q_csv_from_text(spark, sf_dir):
    from civiclens.sources.files import csv_from_text

    o = table(spark, sf_dir, "orders")
    key = F.col("o_orderkey").cast("string")
    # one document per block of 20 orders (bounded); every other one has its columns
    # in another order, and priorities that span two lines
    doc = F.floor(F.col("o_orderkey") / 20)
    line = F.when(doc % 2 == 0, F.concat_ws(",", key, "o_orderstatus", "o_orderpriority")).otherwise(
        F.concat(F.lit('"'), F.col("o_orderpriority"), F.lit('\nnext",'), key, F.lit(","), F.col("o_orderstatus"))
    )
    head = F.when(doc % 2 == 0, F.lit("crash_join_id,status,priority")).otherwise(F.lit("priority,crash_join_id,status"))
    docs = o.select(doc.alias("doc"), head.alias("head"), line.alias("line")).groupBy("doc").agg(
        F.concat(F.first("head"), F.lit("\r\n"), F.array_join(F.array_sort(F.collect_list("line")), "\r\n")).alias("text")
    )
    return csv_from_text(docs, "text", ["crash_join_id", "status", "priority"], ["doc"])


@register("drop_corrupt")
def q_drop_corrupt(spark, sf_dir):
    from civiclens.operators.mapping import drop_corrupt

    o = table(spark, sf_dir, "orders")
    line = F.when(F.col("o_orderkey") % 10 == 0, F.lit("[1, 2, 3]")).otherwise(
        F.to_json(F.struct("o_orderkey", "o_custkey", "o_orderstatus"))
    )
    path = _scratch(spark, "ragged-json")
    o.select(line.alias("value")).write.mode("overwrite").text(path)
    return drop_corrupt(spark.read.text(path), "value", "o_orderkey bigint, o_custkey bigint, o_orderstatus string")


# ----------------------------------------------------------------- sinks

@register("rows_to_json")
def q_rows_to_json(spark, sf_dir):
    from civiclens.sources.sinks import rows_to_json, write_json

    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment")
    path = _scratch(spark, "customer-json")
    write_json(c, path)
    return rows_to_json(spark.read.schema(c.schema).json(path))


@register("sorted_union_columns")
def q_sorted_union_columns(spark, sf_dir):
    from civiclens.sources.files import read_csv_strings
    from civiclens.sources.sinks import write_sorted_union

    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("crash_join_id"), F.col("c_name").alias("name"), "c_mktsegment")
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("crash_join_id"), F.col("s_name").alias("name"), "s_nationkey")
    path = _scratch(spark, "sorted-union")
    write_sorted_union([c, s], path)
    return read_csv_strings(spark, path).na.fill("")


def _upsert_inputs(spark, sf_dir):
    """Stored table = every order; updates = every returned line item (status
    'R', its own price), several per order: the last in (line number, part,
    supplier, price) order wins (line numbers repeat in this data)."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    li = table(spark, sf_dir, "lineitem").filter(F.col("l_returnflag") == "R")
    updates = li.select(
        F.col("l_orderkey").alias("o_orderkey"),
        F.lit("R").alias("o_orderstatus"),
        F.col("l_extendedprice").alias("o_totalprice"),
        F.col("l_linenumber").alias("seq"),
        "l_partkey",
        "l_suppkey",
    )
    return o, updates


UPSERT_ORDER = ["seq", "l_partkey", "l_suppkey", "o_totalprice"]


@register("upsert_by_key")
def q_upsert_by_key(spark, sf_dir):
    from civiclens.operators.aggregates import keep_last
    from civiclens.sources.published import KeyedTable

    stored, updates = _upsert_inputs(spark, sf_dir)
    kept = KeyedTable(spark, _scratch(spark, "store"), stored.schema, ["o_orderkey"])
    kept.upsert(stored)
    kept.upsert(keep_last(updates, ["o_orderkey"], UPSERT_ORDER).select(*stored.columns))
    return kept.read()


@register("typed_load")
def q_typed_load(spark, sf_dir):
    from civiclens.sources.published import AppendTable
    from civiclens.sources.sinks import typed_rows

    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")
    path = _scratch(spark, "orders-csv")
    o.write.mode("overwrite").option("header", True).csv(path)
    schema = "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_orderpriority string"
    loaded = AppendTable(spark, _scratch(spark, "orders-table"), schema)
    loaded.append(typed_rows(spark, path, schema), batch="orders", key=["o_orderkey"])
    return loaded.read()


@register("append_insert")
def q_append_insert(spark, sf_dir):
    """Events landed in three batches, the second one twice."""
    from civiclens.sources.published import AppendTable

    e = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value")
    landed = AppendTable(spark, _scratch(spark, "inserts"), e.schema)
    for batch in (0, 1, 1, 2):
        landed.append(e.where(F.col("event_id") % 3 == batch), batch=batch)
    return landed.read()


@register("append_features")
def q_append_features(spark, sf_dir):
    """Features of the events, appended in two batches."""
    from civiclens.sources.published import AppendTable

    features = q_feature_build(spark, sf_dir)
    landed = AppendTable(spark, _scratch(spark, "features"), features.schema)
    for night in (0, 1):
        landed.append(features.where(F.col("is_night") == night), batch=f"night={night}")
    return landed.read()


@register("scan_csv_first")
def q_scan_csv_first(spark, sf_dir):
    """The first 100 rows of many files, in file order."""
    from civiclens.sources.files import scan_csv_limit

    path = _scratch(spark, "customer-csv")
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("crash_record_id"), "c_name")
    c.repartitionByRange(16, "crash_record_id").sortWithinPartitions("crash_record_id").write.option("header", True).csv(path)
    return scan_csv_limit(spark, path, limit=100)


@register("inferred_types")
def q_inferred_types(spark, sf_dir):
    """The types of a table that landed as text."""
    from civiclens.sources.files import infer_types, read_csv_strings

    path = _scratch(spark, "lineitem-csv")
    li = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_quantity", "l_returnflag", (F.col("l_linenumber") > 3).alias("late"),
        F.when(F.col("l_linenumber") == 1, F.col("l_partkey")).alias("part_of_first"),
        F.when(F.col("l_orderkey") % 1000 == 7, F.lit("n/a")).otherwise(F.col("l_suppkey").cast("string")).alias("supplier_text"),
    )
    li.write.option("header", True).csv(path)
    return infer_types(read_csv_strings(spark, path))


@register("geojson_strict")
def q_geojson_strict(spark, sf_dir):
    """Features that must have an id."""
    from civiclens.sources.files import geojson_explode

    e = table(spark, sf_dir, "events")
    feature = F.struct(
        F.concat(F.lit("ev"), F.col("event_id").cast("string")).alias("id"),
        F.struct(F.unix_millis(F.col("ts").cast("timestamp")).alias("time"), F.col("value").cast("double").alias("mag")).alias("properties"),
        F.struct(F.array(F.col("value").cast("double")).alias("coordinates")).alias("geometry"),
    )
    return geojson_explode(e.select(F.array(feature).alias("features")), strict=True).select("id", "timestamp", "magnitude")


@register("map_report")
def q_map_report(spark, sf_dir):
    """Found reports as text columns."""
    from civiclens.operators.mapping import map_report

    o = table(spark, sf_dir, "orders").select(
        "o_orderkey", F.when(F.col("o_orderkey") % 4 != 0, F.concat(F.lit("https://p/"), F.col("o_custkey").cast("string"))).alias("url"),
        F.when(F.col("o_orderstatus") == "F", F.lit(200)).alias("code"),
    )
    return map_report(o, "o_orderkey", "url", "code", "portal")


@register("distinct_sources")
def q_distinct_sources(spark, sf_dir):
    """The sources of the documents."""
    from civiclens.operators.mapping import distinct_values

    return distinct_values(table(spark, sf_dir, "documents"), "source")


@register("link_kinds")
def q_link_kinds(spark, sf_dir):
    """Links of the landed pages: whether they are URLs, the export link
    where one is a sheet, and a comma list taken apart."""
    from civiclens.functions.exprs import comma_list, is_url, sheet_csv_url

    p = table(spark, sf_dir, "pages")
    n = F.col("page_id").cast("string")
    link = (
        F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("https://docs.google.com/spreadsheets/d/S"), n, F.lit("/edit?gid="), n))
        .when(F.col("page_id") % 3 == 1, F.concat(F.lit("files/"), n)).otherwise(F.col("url"))
    )
    rows = p.select("page_id", link.alias("link"), F.concat(F.lit(" a"), n, F.lit(" ,, b ,"), n).alias("listed"))
    return rows.select("page_id", is_url("link").alias("is_url"), sheet_csv_url("link").alias("export"), F.array_join(comma_list("listed"), "|").alias("items"))


@register("combined_columns")
def q_combined_columns(spark, sf_dir):
    """Two datasets stacked with a tag, then steps one after the other."""
    from civiclens.plans.compose import run_steps

    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), F.col("c_nationkey").alias("nation"), F.lit("customer").alias("dataset"))
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_nationkey").alias("nation"), F.lit("supplier").alias("dataset"))
    return run_steps(
        c.unionByName(s),
        [
            lambda d: d.filter(F.col("nation") < 20),
            lambda d: d.groupBy("dataset", "nation").agg(F.count(F.lit(1)).alias("rows"), F.min("key").alias("first_key")),
        ],
    )


@register("range_scan_reports")
def q_range_scan_reports(spark, sf_dir):
    """Lookups normalised by a hook, then scanned by range: the first two found
    reports of each block of 100 ids."""
    from civiclens.operators.joins import scan_reports

    lookups = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    blocks = lookups.select(F.floor(F.col("o_orderkey") / 100).cast("bigint").alias("range_no")).distinct()
    ranges = blocks.select("range_no", (F.col("range_no") * 100).alias("start"), (F.col("range_no") * 100 + 100).alias("end"), F.lit(2).alias("limit"))

    def normalize(raw):
        return raw.where(F.col("o_orderstatus") != "P").select("o_orderkey", F.col("o_orderkey").cast("string").alias("crash_join_id"), F.round("o_totalprice", 0).alias("price"))

    return scan_reports(lookups, ranges, normalize, "o_orderkey").select("range_no", "crash_join_id", "price")


@register("multi_profile_text")
def q_multi_profile_text(spark, sf_dir):
    from civiclens.operators.profile import multi_profile_text

    return multi_profile_text(_type_profile(spark, sf_dir), "event_type").select("section", "name", "line")


# ----------------------------------------------------------------- mappings

@register("normalize_records")
def q_normalize_records(spark, sf_dir):
    from civiclens.operators.mapping import normalize_records

    o = table(spark, sf_dir, "orders").select(
        F.when(F.col("o_orderkey") % 4 == 0, F.lit("")).when(F.col("o_orderkey") % 4 == 1, F.lit(None))
        .otherwise(F.concat(F.lit("J"), F.col("o_orderkey").cast("string"))).alias("crash_join_id"),
        F.col("o_orderkey").cast("string").alias("crash_record_id"),
        F.col("o_orderdate").cast("string").alias("crash_date"),
        (F.col("o_orderkey") % 7000).cast("string").alias("street_no"),
        F.when(F.col("o_orderkey") % 5 == 0, F.lit(" ")).otherwise(F.col("o_orderstatus")).alias("street_direction"),
        F.col("o_orderpriority").alias("street_name"),
    )
    return normalize_records(o)


@register("map_trim_key")
def q_map_trim_key(spark, sf_dir):
    from civiclens.operators.mapping import map_trim_key

    c = table(spark, sf_dir, "customer").select(
        F.when(F.col("c_custkey") % 9 == 0, F.lit(None)).otherwise(F.concat(F.lit("  "), F.col("c_custkey").cast("string"), F.lit(" "))).alias("collision_id"),
        "c_name",
    )
    return map_trim_key(c, "collision_id")


@register("map_coalesce_key")
def q_map_coalesce_key(spark, sf_dir):
    from civiclens.operators.mapping import map_coalesce_key

    c = table(spark, sf_dir, "customer").select(
        F.when(F.col("c_custkey") % 3 == 0, F.lit(None)).otherwise(F.concat(F.lit(" D"), F.col("c_custkey").cast("string"))).alias("crash_id"),
        F.when(F.col("c_custkey") % 6 == 0, F.lit(None)).otherwise(F.col("c_custkey")).alias("OBJECTID"),
        "c_name",
    )
    return map_coalesce_key(c, "crash_id", "OBJECTID", "detroit")


@register("clean_ids")
def q_clean_ids(spark, sf_dir):
    from civiclens.operators.mapping import clean_ids

    o = table(spark, sf_dir, "orders").select(
        F.when(F.col("o_orderkey") % 8 == 0, F.lit("   ")).otherwise(F.concat(F.lit(" "), F.col("o_orderkey").cast("string"))).alias("report_id")
    )
    return clean_ids(o, "report_id")


@register("clean_phones")
def q_clean_phones(spark, sf_dir):
    from civiclens.operators.mapping import clean_phones

    c = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("crash_join_id"),
        F.when(F.col("c_custkey") % 7 == 0, F.lit("n/a")).otherwise(F.format_string("555-%03d-%04d", F.col("c_nationkey"), F.col("c_custkey"))).alias("driver_phone"),
        F.when(F.col("c_custkey") % 5 == 0, F.lit(None)).otherwise(F.format_string("(555) %03d.%04d", F.col("c_nationkey"), F.col("c_custkey") % 10000)).alias("owner_phone"),
        "c_name",
    )
    return clean_phones(c)


# --------------------------------------------------------------- case catalogue

def accidents(spark, sf_dir):
    """orders as accident cases: state = customer nation, county = segment,
    vehicles = line items."""
    o = table(spark, sf_dir, "orders")
    c = table(spark, sf_dir, "customer")
    li = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("vehicles"))
    return (
        o.join(c, o.o_custkey == c.c_custkey)
        .join(li, o.o_orderkey == li.l_orderkey, "left")
        .select(
            F.col("o_orderkey").alias("st_case"),
            F.col("c_nationkey").alias("state"),
            F.year("o_orderdate").alias("year"),
            F.col("c_mktsegment").alias("county"),
            F.coalesce(F.col("vehicles"), F.lit(0)).alias("vehicles"),
            F.col("o_orderpriority").alias("make"),
            F.col("o_orderstatus").alias("model"),
            F.col("o_totalprice").alias("body_value"),
            F.col("o_orderdate").alias("crash_date"),
        )
    )


def persons(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("st_case"),
        F.col("l_quantity").cast("int").alias("age"),
        F.col("l_returnflag").alias("sex"),
        F.col("l_linenumber").alias("seat_pos"),
        F.col("l_linestatus").alias("injury_severity"),
        (F.col("l_linenumber") <= 4).alias("occupant"),
    )


@register("case_list")
def q_case_list(spark, sf_dir):
    from civiclens.operators.catalogue import case_list

    return case_list(accidents(spark, sf_dir), "st_case", "state", "year", "vehicles", 7, 1997, 1997, 1, date_col="crash_date")


@register("case_details")
def q_case_details(spark, sf_dir):
    from civiclens.operators.catalogue import case_details

    return case_details(accidents(spark, sf_dir), {"state": 3, "year": 1998, "county": "BUILDING"}).drop("crash_date")


@register("search_by_person")
def q_search_by_person(spark, sf_dir):
    from civiclens.operators.catalogue import search_by_person

    return search_by_person(
        accidents(spark, sf_dir), persons(spark, sf_dir), "st_case", {"sex": "R", "injury_severity": "F", "age": 25},
        "year", 1995, 1999, "state", None, "occupant", include_occupants=True, include_non_occupants=False, date_col="crash_date",
    ).select("st_case", "state", "year")


@register("search_by_location")
def q_search_by_location(spark, sf_dir):
    from civiclens.operators.catalogue import search_by_location

    return search_by_location(accidents(spark, sf_dir), "year", 1996, 1998, "state", 12, "county", "MACHINERY", date_col="crash_date").select(
        "st_case", "state", "year", "county"
    )


@register("variable_catalogue")
def q_variable_catalogue(spark, sf_dir):
    from civiclens.operators.catalogue import variable_catalogue

    return variable_catalogue(accidents(spark, sf_dir).drop("st_case", "crash_date"), "year")


@register("attribute_domain")
def q_attribute_domain(spark, sf_dir):
    from civiclens.operators.catalogue import attribute_domain

    return attribute_domain(accidents(spark, sf_dir), "make")


@register("attribute_domain_scoped")
def q_attribute_domain_scoped(spark, sf_dir):
    from civiclens.operators.catalogue import attribute_domain

    return attribute_domain(accidents(spark, sf_dir), "model", {"make": "1-URGENT"})


@register("attribute_domain_scoped2")
def q_attribute_domain_scoped2(spark, sf_dir):
    from civiclens.operators.catalogue import attribute_domain

    return attribute_domain(accidents(spark, sf_dir), "county", {"make": "2-HIGH", "model": "F"})


@register("dataset_slice")
def q_dataset_slice(spark, sf_dir):
    from civiclens.operators.catalogue import dataset_slice, write_partitioned

    path = _scratch(spark, "accidents-by-year-state")
    write_partitioned(accidents(spark, sf_dir).select("st_case", "vehicles", "make", "year", "state"), path, ["year", "state"])
    return dataset_slice(spark, path, "year", 1996, 1997, "state", 5, "csv")


# ---------------------------------------------------------------- streaming

def _events_stream(spark, sf_dir):
    from civiclens.streaming.jobs import file_stream

    schema = table(spark, sf_dir, "events").schema
    return file_stream(spark, sf_dir, schema, glob="events.parquet")


@register("stream_keep_first")
def q_stream_keep_first(spark, sf_dir):
    from civiclens.streaming.jobs import keep_first_stream

    s = _events_stream(spark, sf_dir)
    q = keep_first_stream(s, ["user_id", "event_type"], ["ts", "event_id"], _scratch(spark, "t01-out"), _scratch(spark, "t01-ckpt"))
    return spark.read.parquet(q.current_table)


@register("stream_upsert")
def q_stream_upsert(spark, sf_dir):
    from civiclens.streaming.jobs import file_stream, upsert_stream

    stored, updates = _upsert_inputs(spark, sf_dir)
    v0 = _scratch(spark, "t02-v0")
    stored.write.mode("overwrite").parquet(v0)
    landing = _scratch(spark, "t02-landing")
    updates.write.mode("overwrite").parquet(landing)
    q = upsert_stream(
        file_stream(spark, landing, updates.schema), _scratch(spark, "t02-table"), "o_orderkey", UPSERT_ORDER, _scratch(spark, "t02-ckpt"), v0
    )
    return spark.read.parquet(q.current_table)


@register("stream_token_bucket")
def q_stream_token_bucket(spark, sf_dir):
    from civiclens.streaming.jobs import to_parquet, token_bucket_stream

    s = _events_stream(spark, sf_dir).select("user_id", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("t_us"))
    out, ckpt = _scratch(spark, "t03-out"), _scratch(spark, "t03-ckpt")
    tb = token_bucket_stream(s, "user_id", ["t_us", "event_id"], "t_us", capacity=3, refill_per_s=1 / 14400, out_cols=["event_id"])
    to_parquet(tb, out, ckpt)
    return spark.read.parquet(out)


@register("stream_window_counts_all")
def q_stream_window_counts_all(spark, sf_dir):
    from civiclens.streaming.jobs import window_counts_stream

    q = window_counts_stream(
        _events_stream(spark, sf_dir), "ts", F.col("event_type"), "7 days", "1 day", _scratch(spark, "t04-table"), _scratch(spark, "t04-all-ckpt")
    )
    return spark.read.parquet(q.current_table)


@register("pii_text_summary")
def q_pii_text_summary(spark, sf_dir):
    from civiclens.operators.audit import pii_scan, pii_text_summary

    texts = text_corpus(spark, sf_dir)
    return pii_text_summary(pii_scan(texts, "text", "source_url"), texts)


@register("wkt_points")
def q_wkt_points(spark, sf_dir):
    from civiclens.functions.exprs import wkt_point

    c = table(spark, sf_dir, "customer")
    # every 9th location is written without the space after POINT (invalid)
    loc = F.when(F.col("c_custkey") % 9 == 0, F.format_string("POINT(%s %s)", F.col("c_nationkey"), F.col("c_custkey"))).otherwise(
        F.format_string("POINT (%s %s)", F.col("c_nationkey"), F.col("c_custkey"))
    )
    pts = c.select("c_custkey", wkt_point(loc).alias("p"))
    return pts.select("c_custkey", F.col("p.lon").alias("lon"), F.col("p.lat").alias("lat"))


@register("calendar_parts")
def q_calendar_parts(spark, sf_dir):
    from civiclens.functions.exprs import calendar_parts

    e = table(spark, sf_dir, "events")
    return e.select("event_id", *calendar_parts("ts"))
