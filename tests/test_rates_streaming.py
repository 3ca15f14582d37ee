"""Fixture F13, brute-force limiter simulators, and the streaming twins."""

import random
from collections import Counter
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from civiclens.operators import rates
from civiclens.plans.scan import running_index_and_max


def simulate_slots(ts, interval):
    out, nxt = [], None
    for t in ts:
        s = t if nxt is None else max(t, nxt)
        out.append(s)
        nxt = s + interval
    return out


def simulate_bucket(ts, cap, step):
    """Token bucket starting full at the first request; unit cost; one token per ``step``."""
    tokens, last, out, clock = float(cap), ts[0], [], ts[0]
    for t in ts:
        clock = max(clock, t)
        tokens = min(cap, tokens + (clock - last) / step)
        last = clock
        if tokens < 1:
            wait = (1 - tokens) * step
            clock += wait
            tokens = min(cap, tokens + wait / step)
            last = clock
        tokens -= 1
        out.append(clock)
    return out


def _frame(spark, traces):
    rows = [(k, i, t) for k, ts in traces.items() for i, t in enumerate(ts)]
    return spark.createDataFrame(rows, "key string, seq long, t_us long")


def test_f13(spark):
    df = _frame(spark, {"a": [0, 0, 100_000, 3_000_000, 3_100_000, 3_100_000]})
    got = [r.slot_start_us for r in rates.throttle_slots(df, ["key"], ["seq"], "t_us", 2.0).orderBy("seq").collect()]
    assert got == [0, 500_000, 1_000_000, 3_000_000, 3_500_000, 4_000_000]
    df = _frame(spark, {"a": [0, 0, 0, 0, 5_000_000]})
    got = [r.admit_us for r in rates.token_bucket_delay(df, ["key"], ["seq"], "t_us", 2, 1.0).orderBy("seq").collect()]
    assert got == [0, 0, 1_000_000, 2_000_000, 5_000_000]


def test_limiters_match_simulators(spark):
    rnd = random.Random(11)
    traces = {}
    for k in range(6):
        t, ts = 0, []
        for _ in range(rnd.randrange(1, 120)):
            t += rnd.choice([0, 0, 1, 50_000, 400_000, 2_000_000, 9_000_000])
            ts.append(t)
        traces[f"k{k}"] = ts
    df = _frame(spark, traces)
    # a small bucket width forces many buckets per key (the two-level path)
    slots = rates.throttle_slots(df, ["key"], ["seq"], "t_us", 2.0, bucket_us=1_000_000).collect()
    bucket = rates.token_bucket_delay(df, ["key"], ["seq"], "t_us", 3, 2.0, bucket_us=1_000_000).collect()
    for k, ts in traces.items():
        s = [r.slot_start_us for r in sorted((r for r in slots if r.key == k), key=lambda r: r.seq)]
        assert s == simulate_slots(ts, 500_000)
        b = [r.admit_us for r in sorted((r for r in bucket if r.key == k), key=lambda r: r.seq)]
        assert b == pytest.approx(simulate_bucket(ts, 3, 500_000))


def test_running_scan_matches_single_window(spark):
    from pyspark.sql import Window

    rnd = random.Random(5)
    rows = [(rnd.choice("ab"), i, rnd.randrange(0, 10_000)) for i in range(2000)]
    df = spark.createDataFrame(rows, "g string, o long, t long")
    got = running_index_and_max(df, ["g"], ["o"], F.floor(F.col("o") / 37), "t", 3)
    w = Window.partitionBy("g").orderBy("o")
    ref = df.withColumn("i", F.row_number().over(w) - 1).withColumn(
        "m", F.max(F.col("t") - F.col("i") * 3).over(w.rowsBetween(Window.unboundedPreceding, 0))
    )
    a = {(r.g, r.o): (r._idx, r._runmax) for r in got.collect()}
    b = {(r.g, r.o): (r.i, r.m) for r in ref.collect()}
    assert a == b


def test_token_bucket_stream_equals_batch(spark, tmp_path):
    """Two micro-batches (one file each, in time order): the state carried
    between them gives the same admissions as the batch operator."""
    from civiclens.streaming.jobs import file_stream, to_parquet, token_bucket_stream

    rnd = random.Random(2)
    rows = [(f"u{rnd.randrange(4)}", i, i * 700_000 + rnd.randrange(0, 600_000)) for i in range(300)]
    df = spark.createDataFrame(rows, "user string, event_id long, t_us long")
    src = str(tmp_path / "src")
    df.filter("event_id < 150").coalesce(1).write.parquet(src)
    df.filter("event_id >= 150").coalesce(1).write.mode("append").parquet(src)
    s = file_stream(spark, src, df.schema, max_files=1)
    tb = token_bucket_stream(s, "user", ["t_us", "event_id"], "t_us", 3, 1.0, ["event_id"])
    out = str(tmp_path / "out")
    to_parquet(tb, out, str(tmp_path / "ckpt"))
    streamed = {r.event_id: r.admit_us for r in spark.read.parquet(out).collect()}
    batch = {r.event_id: r.admit_us for r in rates.token_bucket_delay(df, ["user"], ["t_us", "event_id"], "t_us", 3, 1.0).collect()}
    assert streamed == batch


def test_upsert_stream_versions_chain(spark, tmp_path):
    """Two micro-batches: epoch 1 reads the version written by epoch 0."""
    from civiclens.streaming.jobs import file_stream, upsert_stream

    base = spark.createDataFrame([(1, "a", 0), (2, "b", 0), (3, "c", 0)], "k int, v string, seq int")
    v0 = str(tmp_path / "v0")
    base.write.parquet(v0)
    landing = str(tmp_path / "landing")
    spark.createDataFrame([(1, "a1", 1), (1, "a2", 2)], "k int, v string, seq int").coalesce(1).write.parquet(landing)
    spark.createDataFrame([(2, "b1", 3), (4, "d", 4)], "k int, v string, seq int").coalesce(1).write.mode("append").parquet(landing)
    q = upsert_stream(file_stream(spark, landing, base.schema, max_files=1), str(tmp_path / "table"), "k", ["seq"], str(tmp_path / "ck"), v0)
    got = {r.k: r.v for r in spark.read.parquet(q.current_table).collect()}
    assert got == {1: "a2", 2: "b1", 3: "c", 4: "d"}


def test_null_safe_join(spark):
    from civiclens.plans.scan import join_null_safe

    left = spark.createDataFrame([("a", 1), (None, 2), ("b", 3)], "k string, v int")
    right = spark.createDataFrame([("a", 10), (None, 20)], "k string, w int")
    assert {(r.k, r.v, r.w) for r in join_null_safe(left, right, ["k"]).collect()} == {("a", 1, 10), (None, 2, 20), ("b", 3, None)}


@pytest.mark.parametrize("rate,capacity", [(3, 2.5), (0.7, 1.25), (2, 3), (2_500_000, 4)])
def test_rates_are_exact_fractions(spark, rate, capacity):
    """Against the recurrences in exact fractions; NULL keys are a key of their own."""
    from fractions import Fraction
    from math import floor

    rnd = random.Random(5)
    rows = [(rnd.choice(["x", None]), i, rnd.randrange(0, 8_000_000)) for i in range(400)]
    df = spark.createDataFrame(rows, "k string, e int, t long")
    slots = {r.e: r.slot_start_us for r in rates.throttle_slots(df, ["k"], ["t", "e"], "t", rate, bucket_us=500_000).collect()}
    admits = {r.e: r.admit_us for r in rates.token_bucket_delay(df, ["k"], ["t", "e"], "t", capacity, rate, bucket_us=500_000).collect()}
    delta, half = 1_000_000 / Fraction(str(rate)), Fraction(1, 2)
    for key in ("x", None):
        free, tokens, now = Fraction(0), Fraction(str(capacity)), None
        for _, e, t in sorted((r for r in rows if r[0] == key), key=lambda r: (r[2], r[1])):
            start = max(Fraction(t), free)
            free = start + delta
            assert slots[e] == floor(start + half)
            at = Fraction(t) if now is None else max(Fraction(t), now)
            if now is not None:
                tokens = min(Fraction(str(capacity)), tokens + (at - now) / delta)
            if tokens < 1:
                at += (1 - tokens) * delta
                tokens = Fraction(1)
            tokens, now = tokens - 1, at
            assert admits[e] == floor(at + half)


def test_tenth_request_at_three_per_second(spark):
    df = spark.createDataFrame([("x", i, 0) for i in range(10)], "k string, e int, t long")
    assert max(r.slot_start_us for r in rates.throttle_slots(df, ["k"], ["e"], "t", 3).collect()) == 3_000_000


@pytest.mark.parametrize("files", [1, 4])
def test_keep_first_stream_does_not_depend_on_batches(spark, tmp_path, files):
    from civiclens.streaming.jobs import file_stream, keep_first_stream

    rnd = random.Random(3)
    rows = [(rnd.randrange(40), i, f"v{i}") for i in range(400)]
    rnd.shuffle(rows)
    landing = str(tmp_path / "in")
    for n in range(files):
        spark.createDataFrame(rows[n::files], "k int, o int, v string").coalesce(1).write.mode("append").parquet(landing)
    s = file_stream(spark, landing, "k int, o int, v string", max_files=1)
    q = keep_first_stream(s, ["k"], ["o"], str(tmp_path / "t"), str(tmp_path / "c"))
    got = {r.k: (r.o, r.v) for r in spark.read.parquet(q.current_table).collect()}
    assert got == {k: min((o, v) for kk, o, v in rows if kk == k) for k, *_ in rows}


def test_window_counts_hold_open_windows_and_late_rows(spark, tmp_path):
    from civiclens.streaming.jobs import file_stream, window_counts_stream

    rows = [(datetime(2024, 1, d, 12), s) for d, s in ((20, "a"), (20, "a"), (1, "a"), (19, None), (21, "b"))]  # the third comes late
    landing = str(tmp_path / "in")
    for part in (rows[:2], rows[2:]):
        spark.createDataFrame(part, "ts timestamp, s string").coalesce(1).write.mode("append").parquet(landing)
    want = Counter()
    for ts, s in rows:
        for back in range(7):
            want[datetime(ts.year, ts.month, ts.day) - timedelta(days=back), s] += 1
    for max_files in (None, 1):
        stream = lambda: file_stream(spark, landing, "ts timestamp, s string", max_files=max_files)  # noqa: B023, E731
        at = str(tmp_path / f"t{max_files}"), str(tmp_path / f"c{max_files}")
        for _ in range(2):  # the second run finds no new files
            q = window_counts_stream(stream(), "ts", F.col("s"), "7 days", "1 day", *at)
            got = {(r.window_start, r.segment): r.crash_count for r in spark.read.parquet(q.current_table).collect()}
            assert got == want
