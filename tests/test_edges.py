"""Edge rows: empty tables, NULL keys, duplicate right keys,
negative numbers, non-ASCII text."""

from pyspark.sql import functions as F

from civiclens.functions import exprs as X
from civiclens.operators import aggregates, alerts, audit, joins, risk

CRASH = "street_no string, street_name string, injuries_total string, injuries_fatal string, prim_contributory_cause string, road_defect string"


def test_empty_inputs(spark):
    empty = spark.createDataFrame([], CRASH)
    assert alerts.hotspot_clusters(empty).count() == 0
    assert alerts.row_alerts(spark.createDataFrame([], "crash_join_id string, most_severe_injury string")).count() == 0
    contacts = spark.createDataFrame([("K1", "2024-01-01", "1 main st")], "crash_join_id string, date string, address string")
    crashes = spark.createDataFrame([], "crash_record_id string, crash_date string, street_no string, street_direction string, street_name string, o int")
    out = joins.fuzzy_join(contacts, crashes, ["o"]).collect()
    assert [r.match_status for r in out] == ["unmatched"]
    base = spark.createDataFrame([("a", "1")], "crash_join_id string, v string")
    assert joins.overlay_join(base, spark.createDataFrame([], "crash_join_id string, v string, s int"), ["s"]).collect()[0].v == "1"
    k = aggregates.kpi_summary(spark.createDataFrame([], "injuries_total int, injuries_fatal int, damage string")).first()
    assert (k.total_crashes, k.total_injuries, k.most_common_damage) == (0, 0, "N/A")


def test_coercions_and_negatives(spark):
    df = spark.createDataFrame([("-50", "x", "2", "junk", "A", "RUT")] * 3 + [("12.7", "y", "1.9", "0", "B", None)] * 3, CRASH)
    got = {r.segment: r for r in alerts.hotspot_clusters(df).collect()}
    assert set(got) == {"-100 X", "0 Y"}  # 12.7 truncates to 12, floors to block 0
    assert got["-100 X"].injury_count == 6 and got["-100 X"].fatal_count == 0
    assert got["0 Y"].injury_count == 5  # int(1.9 * 3) = int(5.7)
    r = risk.risk_score(spark.createDataFrame([("-0.5",), ("nan",), ("1e3",)], "magnitude string")).collect()
    assert [x.risk_score for x in r] == [0, 100, 100]


def test_non_ascii_text(spark):
    df = spark.createDataFrame([("  Calle Niño 5, Piso 2 ",), (" 100 N. Élm ",)], "a string")
    got = [r[0] for r in df.select(X.normalize_address("a")).collect()]
    assert got == ["calle nio 5 piso 2", "100 n lm"]
    text = "Nom: Émile Zola, tél 06 12 34 56 78, mail émile@exemple.fr, ana@ex.fr, Driver: Ana Ruiz"
    texts = spark.createDataFrame([("u", text)], "source_url string, text string")
    found = {r.pattern_name: r for r in audit.pii_scan(texts, "text", "source_url", redact_samples=False).collect()}
    assert found["Full Name (labeled)"].sample_matches == ["Driver: Ana Ruiz"]
    # Unicode word boundaries as in Python's re: no boundary between 'é' and 'm'
    assert found["Email"].sample_matches == ["ana@ex.fr"]


def test_duplicate_right_keys_multiply_only_in_merge(spark):
    left = spark.createDataFrame([("k", 1)], "crash_join_id string, v int")
    right = spark.createDataFrame([("k", 2, 1), ("k", 3, 2), (None, 4, 3)], "crash_join_id string, w int, s int")
    assert joins.merge_suffix(left, right).count() == 2
    assert joins.overlay_join(left, right, ["s"]).count() == 1
    assert joins.enrich_flag(left, right, "crash_join_id", ["s"]).first().contact.w == 3
