"""Tables published by a manifest: appends, keyed upserts, streams into them."""

import random

import pytest
from pyspark.sql import functions as F

from civiclens.sources.published import AppendTable, KeyedTable


def test_append_is_whole_or_not_at_all(spark, tmp_path):
    t = AppendTable(spark, str(tmp_path / "t"), "id int, v string")
    assert t.read().count() == 0
    a = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    assert t.append(a, batch=0, key=["id"]) == 2 and t.append(a, batch=0, key=["id"]) == 0  # a retry
    with pytest.raises(ValueError):
        t.append(spark.createDataFrame([(3, "c"), (3, "d")], "id int, v string"), batch=1, key=["id"])
    (tmp_path / "bad.csv").write_text("id,v\n4,x\nfour,y\n")
    from civiclens.sources.sinks import typed_rows

    with pytest.raises(Exception):  # noqa: B017
        t.append(typed_rows(spark, str(tmp_path / "bad.csv"), "id int, v string"), batch=1)
    assert sorted(r.id for r in t.read().collect()) == [1, 2]
    assert t.append(a.limit(0), batch=2, key=["id"]) == 0 and t.append(a, batch=3) == 2
    assert sorted(r.id for r in t.read().collect()) == [1, 1, 2, 2]
    assert len(t._names(f"{t.root}/data")) == len(t.current()["folders"])  # nothing else is left


def test_one_changed_key_writes_one_bucket(spark, tmp_path):
    rows = spark.range(1000).select(F.col("id").alias("k"), F.lit("a").alias("v"))
    t = KeyedTable(spark, str(tmp_path / "t"), rows.schema, ["k"], buckets=16)
    assert len(t.upsert(rows, 0)) == 16
    before = {f["bucket"]: f["path"] for f in t.current()["folders"]}
    one = spark.createDataFrame([(7, "b")], "k long, v string")
    assert len(t.upsert(one, 1)) == 1 and t.upsert(one, 1) == [] and t.upsert(one, 0) == []  # retries
    after = {f["bucket"]: f["path"] for f in t.current()["folders"]}
    assert sum(before[b] != after[b] for b in before) == 1
    got = {r.k: r.v for r in t.read().collect()}
    assert len(got) == 1000 and got[7] == "b" and list(got.values()).count("b") == 1
    for i in range(5):
        t.upsert(spark.createDataFrame([(None, f"n{i}"), (10_000 + i, "c")], "k long, v string"))
    assert t.read().count() == 1006 and t.read().where("k is null").first().v == "n4"  # NULL is a key
    assert len(t.versions()) == 2 and spark.read.parquet(t.glob()).count() == 1006


@pytest.mark.parametrize("files", [1, 2, 4, 7])
def test_streams_equal_batch_for_any_cut_and_restart(spark, tmp_path, files):
    from civiclens.streaming.jobs import file_stream, keep_first_stream, upsert_stream

    rnd = random.Random(files)
    rows = [(rnd.choice([None, *range(30)]), i, f"v{i}") for i in range(300)]
    rnd.shuffle(rows)
    schema = "k int, o int, v string"
    landing, first, up, v0 = (str(tmp_path / n) for n in ("in", "first", "up", "v0"))
    spark.createDataFrame([(1, -1, "old"), (99, -1, "kept")], schema).write.parquet(v0)
    for n in range(files):
        spark.createDataFrame(rows[n::files], schema).coalesce(1).write.mode("append").parquet(landing)
        s = lambda: file_stream(spark, landing, schema, max_files=1)
        for _ in range(2):  # the second run finds nothing new
            q = keep_first_stream(s(), ["k"], ["o"], first, f"{first}-c", buckets=4)
        u = upsert_stream(s(), up, "k", ["o"], f"{up}-c", v0, buckets=4)
    want = {k: min((o, v) for kk, o, v in rows if kk == k) for k, *_ in rows}
    assert {r.k: (r.o, r.v) for r in q.table.read().collect()} == want
    assert {r.k: (r.o, r.v) for r in spark.read.parquet(q.current_table).collect()} == want
    assert q.table.read().count() == len(want)
    merged = {r.k: r.v for r in u.table.read().collect()}
    assert set(merged) == {99, 1, *want} and merged[99] == "kept" and u.table.read().count() == len(merged)


def test_stream_over_nothing_gives_an_empty_table(spark, tmp_path):
    from civiclens.streaming.jobs import file_stream, keep_first_stream

    landing = tmp_path / "in"
    landing.mkdir()
    q = keep_first_stream(file_stream(spark, str(landing), "k int, o int"), ["k"], ["o"], str(tmp_path / "t"), str(tmp_path / "c"))
    assert q.table.read().count() == 0


def test_panes_are_fewer_rows_than_windows(spark, tmp_path):
    from civiclens.streaming.jobs import file_stream, window_counts_stream

    landing = str(tmp_path / "in")
    spark.range(1000).select(F.timestamp_seconds(F.col("id") * 3600 * 5).alias("ts"), (F.col("id") % 2).cast("string").alias("s")).write.parquet(landing)
    q = window_counts_stream(file_stream(spark, landing, "ts timestamp, s string"), "ts", F.col("s"), "7 days", "1 day", str(tmp_path / "t"), str(tmp_path / "c"))
    windows = spark.read.parquet(q.current_table)
    assert windows.agg(F.sum("crash_count")).first()[0] == 7000
    assert q.panes.read().count() < windows.count() and q.panes.read().agg(F.sum("crash_count")).first()[0] == 1000
