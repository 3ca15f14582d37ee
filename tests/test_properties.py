"""Properties: same rows under any partitioning, keep-first is
idempotent, the overlay join keeps the base row count, scores stay in range."""

import os

import pytest
from pyspark.sql import functions as F

from civiclens.operators import aggregates, alerts, audit, joins, profile
from civiclens.plans.tables import table

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver test data not present")


def bag(df):
    return sorted(map(repr, (tuple(r) for r in df.collect())))


def test_same_rows_under_repartition(spark):
    e = table(spark, SF, "events")
    for frame in (e, e.repartition(7), e.repartition(3, "user_id")):
        assert bag(aggregates.keep_first(frame, ["user_id"], ["ts", "event_id"])) == bag(
            aggregates.keep_first(e, ["user_id"], ["ts", "event_id"])
        )
    log = e.select(F.col("user_id").alias("portal"), F.col("event_id").alias("pos"), F.col("event_id").cast("string").alias("rid"), "event_type")
    base = bag(audit.id_enumeration_report(log, ["portal"], "pos", "rid", F.col("event_type") != "error"))
    assert bag(audit.id_enumeration_report(log.repartition(7), ["portal"], "pos", "rid", F.col("event_type") != "error", bucket_size=50)) == base


def test_hotspot_and_profile_partition_invariant(spark):
    li = table(spark, SF, "lineitem").select(
        F.col("l_orderkey").alias("street_no"), F.col("l_returnflag").alias("street_name"),
        (F.col("l_quantity") > 40).cast("int").alias("injuries_total"), F.lit(0).alias("injuries_fatal"),
        F.col("l_linestatus").alias("prim_contributory_cause"), F.col("l_returnflag").alias("road_defect"),
    )
    a = bag(alerts.hotspot_clusters(li))
    b = bag(alerts.hotspot_clusters(li.repartition(7)))
    assert a == b
    scores = [r.risk_score for r in alerts.hotspot_clusters(li).collect()]
    assert all(0 <= s <= 100 for s in scores)
    e = table(spark, SF, "events").select("event_type", F.col("event_id").alias("crash_join_id"), F.col("ts").alias("crash_date"), "value")
    p1 = bag(profile.profile_report(profile.profile(e, ["event_type"])))
    p2 = bag(profile.profile_report(profile.profile(e.repartition(7), ["event_type"])))
    assert p1 == p2


def test_keep_first_idempotent_and_overlay_count(spark):
    e = table(spark, SF, "events")
    once = aggregates.keep_first(e, ["user_id"], ["ts", "event_id"])
    twice = aggregates.keep_first(once, ["user_id"], ["ts", "event_id"])
    assert bag(once) == bag(twice)
    c = table(spark, SF, "customer").select(F.col("c_custkey").cast("string").alias("crash_join_id"), "c_name")
    o = table(spark, SF, "orders").select(F.col("o_custkey").cast("string").alias("crash_join_id"), "o_orderkey", "o_orderstatus")
    assert joins.overlay_join(c, o, ["o_orderkey"]).count() == c.count()
    assert joins.sync_metadata(c, o, ["o_orderkey"]).count() == c.count()


def test_fuzzy_join_partition_invariant(spark):
    o = table(spark, SF, "orders")
    crashes = o.select(
        F.col("o_orderkey").cast("string").alias("crash_record_id"), F.col("o_orderdate").cast("string").alias("crash_date"),
        (F.col("o_orderkey") % 7).cast("string").alias("street_no"), F.col("o_orderstatus").alias("street_direction"),
        F.col("o_orderpriority").alias("street_name"), "o_orderkey",
    )
    contacts = o.select(
        F.col("o_custkey").cast("string").alias("crash_join_id"), F.to_date("o_orderdate").cast("string").alias("date"),
        F.concat_ws(" ", (F.col("o_custkey") % 7).cast("string"), F.col("o_orderstatus")).alias("address"),
    )
    a = bag(joins.fuzzy_join(contacts, crashes, ["o_orderkey"]))
    b = bag(joins.fuzzy_join(contacts.repartition(5), crashes.repartition(7), ["o_orderkey"]))
    assert a == b


def test_duplicate_rows_matches_pandas(spark):
    import random

    import pandas as pd

    from civiclens.operators.profile import duplicate_rows

    rnd = random.Random(8)
    rows = [(rnd.choice("ab"), rnd.choice([None, 1, 2]), rnd.choice([None, "x", "y", "z"]), rnd.randrange(3)) for _ in range(600)]
    pdf = pd.DataFrame(rows, columns=["g", "a", "b", "c"])
    df = spark.createDataFrame(rows, "g string, a int, b string, c int")
    got = {r.g: r._dup_rows for r in duplicate_rows(df, ["g"], ["a", "b", "c"]).collect()}
    want = {g: int(part.duplicated(subset=["a", "b", "c"], keep=False).sum()) for g, part in pdf.groupby("g")}
    assert {g: got.get(g, 0) for g in want} == want
    total = duplicate_rows(df, [], ["a", "b", "c"]).first()._dup_rows
    assert total == int(pdf.duplicated(subset=["a", "b", "c"], keep=False).sum())
