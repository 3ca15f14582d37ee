"""Fixtures F1, F9, F10, F11, F14 (FIXTURES.md)."""

from pyspark.sql import functions as F

from civiclens.operators import joins


def rows(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)


def test_fuzzy_join_f1(spark):
    contacts = spark.createDataFrame(
        [("K1", "2023-06-13", "100 N ELM", "Ann Doe", "555"), ("K2", "2023-06-14", "499 N MAPL", "B", "5"),
         ("K3", "2023-06-14", "3311 W BIRCH", "C", "5"), ("K0", "2000-01-01", "1 W NOWHERE", "D", "5"),
         ("K5", "2023-06-13", "100 N. Elm Dr Apt 4", "E", "5"), ("K6", None, "100 N ELM", "F", "5"),
         ("K7", "2023-06-13", "", "G", "5")],
        "crash_join_id string, date string, address string, unit1_name string, unit1_phone string",
    )
    crashes = spark.createDataFrame(
        [("HASH_A", "2023-06-13T08:15:00.000", "100", "N", "ELM DR", 1), ("HASH_B", "2023-06-14T14:30:00.000", "499", "N", "MAPLE DR", 2),
         ("HASH_C", "2023-06-14T09:00:00.000", "3311", "W", "BIRCH AVE", 3), ("HASH_DECOY", "2023-06-15T00:00:00.000", "100", "N", "ELM DR", 4),
         ("HASH_A2", "2023-06-13T09:00:00.000", "100", "N", "ELM DR", 5)],
        "crash_record_id string, crash_date string, street_no string, street_direction string, street_name string, ord int",
    )
    out = {r["crash_join_id"]: r for r in joins.fuzzy_join(contacts, crashes, ["ord"]).collect()}
    assert out["K1"]["matched_crash_record_id"] == "HASH_A"  # first of two matches
    assert out["K1"]["matched_crash_address"] == "100 N ELM DR"
    assert out["K2"]["matched_crash_record_id"] == "HASH_B"
    assert out["K3"]["matched_crash_record_id"] == "HASH_C"
    assert out["K0"]["match_status"] == "unmatched" and out["K0"]["matched_crash_record_id"] is None
    assert out["K5"]["matched_crash_record_id"] == "HASH_A"  # right shorter than left; punctuation dropped
    assert out["K6"]["match_status"] == "unmatched" and out["K7"]["match_status"] == "unmatched"
    assert out["K1"]["unit1_name"] == "Ann Doe"


def test_merge_and_overlay_f11(spark):
    left = spark.createDataFrame([("x", 1), (None, 2)], "crash_join_id string, v int")
    right = spark.createDataFrame([(None, 7, 0), ("x", 8, 1), ("x", 9, 2)], "crash_join_id string, v int, seq int")
    m = joins.merge_suffix(left, right)
    assert rows(m, "crash_join_id", "v", "v_contact") == sorted([("x", 1, 8), ("x", 1, 9), (None, 2, 7)], key=repr)
    o = joins.overlay_join(left, right, ["seq"])
    assert o.count() == 2
    assert {(r["crash_join_id"], r["v"]) for r in o.collect()} == {("x", 9), (None, 7)}


def test_ensure_key_chain(spark):
    df = spark.createDataFrame([(1, "a")], "rd int, x string")
    assert joins.ensure_key(df).columns[-1] == "crash_join_id"
    import pytest

    with pytest.raises(ValueError):
        joins.ensure_key(spark.createDataFrame([(1,)], "other int"))


def test_sync_metadata_f10(spark):
    base = spark.createDataFrame([("A", "", "1"), ("B", "keep", "2"), ("", "v", "3"), ("D", "v", "4")], "k string, x string, y string")
    meta = spark.createDataFrame([("A", "p", "q", 1), ("A", "r", "", 2), ("B", "new", "s", 3), ("", "w", "t", 4)], "k string, x string, z string, seq int")
    meta_fields = ["x", "z"]
    fill = {r["k"]: r for r in joins.sync_metadata(base, meta, ["seq"], key="k", fields=meta_fields).collect()}
    assert (fill["A"]["x"], fill["A"]["y"], fill["A"]["z"]) == ("r", "1", None)
    assert (fill["B"]["x"], fill["B"]["z"]) == ("keep", "s")
    assert (fill[""]["x"], fill[""]["z"]) == ("v", None)
    assert (fill["D"]["x"], fill["D"]["z"]) == ("v", None)
    over = {r["k"]: r for r in joins.sync_metadata(base, meta, ["seq"], key="k", fields=meta_fields, overwrite=True).collect()}
    assert over["B"]["x"] == "new" and over["A"]["x"] == "r" and over[""]["x"] == "v"


def test_enrich_flag_f14(spark):
    crashes = spark.createDataFrame([("C-1001", "x", "high"), ("C-1002", "x", "low"), ("C-1003", "y", "low")], "crash_id string, city string, severity string")
    lookup = spark.createDataFrame([("C-1001", "n1", 1), ("C-1003", "n3", 1)], "crash_id string, name string, seq int")
    out = {r["crash_id"]: r["has_contact"] for r in joins.enrich_flag(crashes, lookup, "crash_id", ["seq"]).collect()}
    assert out == {"C-1001": True, "C-1002": False, "C-1003": True}


def test_priority_resolve(spark):
    ids = spark.createDataFrame([(1,), (2,), (3,)], "k int")
    s1 = spark.createDataFrame([(1, ""), (2, "a")], "k int, v string")
    s2 = spark.createDataFrame([(1, "b"), (2, "c")], "k int, v string")
    out = {r["k"]: r["resolved"] for r in joins.priority_resolve(ids, [s1, s2], "k", "v").collect()}
    assert out == {1: "b", 2: "a", 3: None}


def test_range_scans_f9(spark):
    def run(ids, ranges):
        i = spark.createDataFrame([(x,) for x in ids], "report_id bigint")
        r = spark.createDataFrame(ranges, "range_no int, start bigint, end bigint, limit int")
        return [(x["range_no"], x["report_id"]) for x in joins.multi_range_scan(i, r).collect()]

    assert run([100, 102], [(0, 100, 103, None)]) == [(0, 100), (0, 102)]
    assert run([200, 201, 202], [(0, 200, 205, 2)]) == [(0, 200), (0, 201)]
    assert run([10, 12, 20, 21], [(0, 10, 13, None), (1, 20, 22, None)]) == [(0, 10), (0, 12), (1, 20), (1, 21)]
    assert run([5], [(0, 5, 6, None), (1, 0, 10, None)]) == [(0, 5), (1, 5)]
    assert run([7], [(0, 7, 7, None)]) == []


def test_range_join_wide_and_narrow(spark):
    import random

    rnd = random.Random(3)
    ids = sorted(rnd.sample(range(0, 200_000), 3000))
    ranges = []
    for n in range(60):
        s = rnd.randrange(0, 200_000)
        w = rnd.choice([1, 5, 50, 2000, 90_000])
        ranges.append((n, s, s + w, rnd.choice([None, 0, 1, 3, 50])))
    i = spark.createDataFrame([(x,) for x in ids], "report_id bigint")
    r = spark.createDataFrame(ranges, "range_no int, start bigint, end bigint, limit int")
    got = sorted((x["range_no"], x["report_id"]) for x in joins.multi_range_scan(i, r).collect())
    want = []
    for n, s, e, lim in ranges:
        hits = [x for x in ids if s <= x < e]
        want += [(n, x) for x in (hits[:lim] if lim else hits)]
    assert got == sorted(want)


def _brute_ranges(ids, ranges):
    want = []
    for n, s, e, lim in ranges:
        hits = [x for x in sorted(ids) if s <= x < e]
        want += [(n, x) for x in (hits[:lim] if lim else hits)]
    return sorted(want)


def _scan(spark, ids, ranges):
    i = spark.createDataFrame([(x,) for x in ids], "report_id bigint").repartition(5)
    r = spark.createDataFrame(ranges, "range_no int, start bigint, end bigint, limit int")
    return sorted((x["range_no"], x["report_id"]) for x in joins.multi_range_scan(i, r, ordered=False).collect())


def test_range_scan_of_repeated_ids_and_the_ends_of_the_long_range(spark):
    ids = [5] * 3000 + [6, 6, 7] + [-(2**63), 2**63 - 1, 2**62, 0]
    ranges = [(0, -(2**63), 2**63 - 1, None), (1, 5, 8, 2), (2, 5, 8, 3001), (3, 6, 7, 1), (4, 8, 9, None), (5, 9, 2, None), (6, 0, 2**63 - 1, 5000), (7, 5, 6, 0)]
    assert _scan(spark, ids, ranges) == _brute_ranges(ids, ranges)


def test_ranges_that_all_overlap(spark):
    import random

    rnd = random.Random(11)
    ids = rnd.sample(range(10**9), 400)
    ranges = [(n, 0, 10**9, rnd.choice([1, 2])) for n in range(10_000)] + [(10_000, 0, 10**9, None)]
    assert _scan(spark, ids, ranges) == _brute_ranges(ids, ranges)


def test_one_range_over_everything_is_many_equal_keys(spark):
    """Dense and sparse stretches, one range: every join key holds 1,024 ids."""
    ids = spark.range(60_000).select(F.when(F.col("id") < 50_000, F.col("id")).otherwise(F.col("id") * 1_000_003).alias("report_id"))
    ranges = spark.createDataFrame([(0, 0, 2**62)], "range_no int, start bigint, end bigint")
    line = joins._positions(ids, ranges, "report_id").where("_id = 1")
    sizes = [r["count"] for r in line.groupBy(F.shiftright("_i", joins.BLOCK_BITS).alias("b")).count().collect()]
    assert sorted(sizes)[1:] == [1024] * (len(sizes) - 1)
    assert joins.range_join(ids, ranges).count() == 60_000


def test_measured_buckets_split_a_hot_hour(spark):
    from civiclens.plans.scan import order_buckets

    rows = spark.range(20_000).select(
        F.when(F.col("id") % 10 < 9, F.lit("hot")).otherwise(F.concat(F.lit("k"), F.col("id") % 50)).alias("key"),
        F.when(F.col("id") % 10 < 9, F.col("id") % 7).otherwise(F.col("id") * 10**6).alias("t"), F.col("id").alias("seq"),
    )
    got = order_buckets(rows, ["key", "t", "seq"])
    sizes = sorted(r["count"] for r in got.groupBy("_bkt").count().collect())
    assert sum(sizes) == 20_000 and len(sizes) >= 8 and sizes[-1] < 2 * sizes[len(sizes) // 2]
    order = [r["_bkt"] for r in got.orderBy("key", "t", "seq").collect()]
    assert order == sorted(order)
    empty = order_buckets(rows.limit(0), ["key"])
    assert empty.count() == 0 and empty.columns == [*rows.columns, "_bkt"]
    nulls = order_buckets(spark.createDataFrame([(None, 1), ("a", None), (None, None)], "k string, t int"), ["k", "t"])
    assert nulls.count() == 3
