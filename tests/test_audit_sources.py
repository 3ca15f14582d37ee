"""Fixtures F5-F8, F10, F12 (FIXTURES.md)."""

import json

import pandas as pd
import pytest
from pyspark.sql import functions as F

from civiclens.functions import exprs as X
from civiclens.operators import audit, mapping, risk
from civiclens.sources import files, html

PII_TEXT = "<p>Driver: Jane Sample</p><p>SSN: 123-45-6789</p><p>Phone: (555) 202-1234</p><p>Email: js@example.com</p>"


def test_pii_scan_f5(spark):
    texts = spark.createDataFrame([("u1", PII_TEXT), ("u2", "<p>nothing here</p>"), ("u3", "a@b.io a@b.io a@b.io a@b.io 000-12-3456")], "source_url string, text string")
    got = {(r.source_url, r.pattern_name): r for r in audit.pii_scan(texts, "text", "source_url").collect()}
    assert got[("u1", "SSN")].sample_matches == ["1*********9"] and got[("u1", "SSN")].severity == "CRITICAL"
    assert got[("u1", "Phone")].sample_matches == ["(************4"] and got[("u1", "Phone")].severity == "HIGH"
    assert got[("u1", "Email")].sample_matches == ["j************m"]
    assert got[("u1", "Full Name (labeled)")].sample_matches == ["D*****************e"]
    assert not any(k[0] == "u2" for k in got)
    assert got[("u3", "Email")].match_count == 4 and got[("u3", "Email")].sample_matches == ["a****o"]
    assert ("u3", "SSN") not in got
    raw = {(r.source_url, r.pattern_name): r for r in audit.pii_scan(texts, "text", "source_url", redact_samples=False).collect()}
    assert raw[("u1", "Email")].sample_matches == ["js@example.com"]
    order = [r.pattern_name for r in audit.pii_scan(texts.filter("source_url = 'u1'"), "text", "source_url").collect()]
    assert order[0] == "SSN" and order[1] == "Phone"


def test_redact_short(spark):
    df = spark.createDataFrame([("abcd",), ("ab",), ("abcde",)], "s string")
    assert [r[0] for r in df.select(X.redact("s")).collect()] == ["****", "**", "a***e"]


def _log(spark, ids, status):
    return spark.createDataFrame([("p", i, x, status) for i, x in enumerate(ids)], "portal string, pos int, report_id string, status_code int")


def test_id_density_f6(spark):
    r = audit.id_enumeration_report(_log(spark, [str(x) for x in range(2501001, 2501006)], 200), ["portal"], "pos", "report_id", F.col("status_code") == 200).collect()[0]
    assert (r.hit_rate, r.gap_rate, r.severity) == (1.0, 1.0, "CRITICAL")
    assert r.findings[0].evidence == "Valid IDs confirmed: ['2501001', '2501002', '2501003', '2501004', '2501005']"
    r = audit.id_enumeration_report(_log(spark, ["2501001", "2501002"], 404), ["portal"], "pos", "report_id", F.col("status_code") == 200).collect()[0]
    assert (r.hit_rate, r.gap_rate, r.severity) == (0.0, 1.0, "INFO")
    assert [f.category for f in r.findings] == ["Predictable ID Pattern"]
    for ids, want in ([["100", "101", "102", "103"], 1.0], [["100", "200", "300"], 0.0], [["A-7", "xx", "A-8"], 1.0], [["5"], 0.0]):
        g = audit.id_gap_rate(_log(spark, ids, 200), ["portal"], "pos", "report_id").collect()[0]
        assert g.gap_rate == want


def test_id_gap_rate_buckets_match_single_window(spark):
    import random

    rnd = random.Random(7)
    data = [("p" + str(rnd.randrange(3)), i, str(rnd.choice([rnd.randrange(1000), i])), 200) for i in range(4000)]
    df = spark.createDataFrame(data, "portal string, pos int, report_id string, status_code int")
    small = {r.portal: r.gap_rate for r in audit.id_gap_rate(df, ["portal"], "pos", "report_id", bucket_size=7).collect()}
    want = {}
    for p in {d[0] for d in data}:
        nums = [int(d[2]) for d in data if d[0] == p]
        want[p] = sum(abs(b - a) == 1 for a, b in zip(nums, nums[1:])) / (len(nums) - 1)
    assert small == pytest.approx(want)


def test_sequence_signature(spark):
    ev = spark.createDataFrame(
        [(1, "s1", 1, "view"), (2, "s1", 2, "error"), (3, "s2", 1, "view"), (4, "s2", 2, "error"), (5, "s3", 1, "view")],
        "id int, session string, t int, name string",
    )
    out = audit.sequence_signature(ev, ["session"], ["t", "id"], "name", ["error"]).collect()
    assert [(r.signature, r.session) for r in out] == [("view-error", "s1")]


def test_csv_source_f7(spark, tmp_path):
    p = tmp_path / "c.csv"
    p.write_text("crash_record_id,crash_date,street_no,street_direction,street_name\nabc123,2023-01-01T00:00:00.000,41,W,WACKER DR\n"
                 "def456,2023-01-02,1,N,ELM\nghi789,2023-01-03,2,S,OAK\n")
    assert files.scan_csv_limit(spark, str(p)).count() == 3
    assert files.scan_csv_limit(spark, str(p), limit=2).count() == 2
    assert files.scan_csv_limit(spark, str(p), limit=0).count() == 3
    r = files.scan_csv_limit(spark, str(p)).orderBy("crash_record_id").first()
    assert r.crash_join_id == "abc123" and r.crash_date == "2023-01-01T00:00:00.000"
    n = mapping.normalize_records(files.scan_csv_limit(spark, str(p))).orderBy("crash_join_id").first()
    assert n.address == "41 W WACKER DR"
    empty = spark.createDataFrame([("k", None, "", " ")], "crash_join_id string, street_no string, street_direction string, street_name string")
    assert mapping.normalize_records(empty).first().address is None
    with pytest.raises(Exception):
        files.scan_csv_limit(spark, str(tmp_path / "missing.csv")).count()


PAGES = [
    (1, "http://x/1", "<body><p>No records found for that accident number.</p></body>"),
    (2, "http://x/2", "<table><tr><th>Report Date</th><td>2025-01-11</td></tr><tr><th>County</th><td>New Madrid</td></tr>"
                      "<tr><td>Location</td><td>US-61 at Milepost 14</td></tr><tr><th>Troop</th><td>E</td></tr></table><p>Driver: J. Doe</p>"),
    (3, "http://x/3", "<p>just a paragraph</p>"),
    (4, "http://x/4", '<a href="/r/250111396" title="Details for Report 250111396">250111396</a>'
                      '<a href="/r/2" title="Other">2</a><a href="/r/250201258" title="details for report">250201258</a>'),
    (5, "http://x/5", ""),
    (6, "http://x/6", '<form action="/lookup"><input type="text" name="report_number" value="">'
                      '<input type="hidden" name="csrf_token" value="t0k"><input type="submit" name="go" value="Go">'
                      '<input type="checkbox" name="opt"><select name="county"><option value="a">A</option>'
                      '<option value="b" selected>B</option></select></form>'),
    (7, "http://x/7", '<div id="report_num"> R-77 </div>'),
    (8, "http://x/8", "<p>Invalid report number</p><script>var s='invalid';</script>"),
    (9, "http://x/9", "<p>ok</p><script>var s='invalid';</script>"),
]


def test_html_jobs_f8(spark):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    f = {r.page_id: r for r in html.html_fields(pages, default_troop="C").collect()}
    assert 1 not in f
    assert (f[2].report_date, f[2].county, f[2].location, f[2].troop, f[2].contact_found) == ("2025-01-11", "New Madrid", "US-61 at Milepost 14", "E", True)
    assert (f[3].report_date, f[3].troop, f[3].contact_found) == ("", "C", False)
    links = html.html_links(pages).collect()
    assert [(r.page_id, r.crash_join_id, r.status, r.contact_found) for r in links] == [(4, "250111396", "Found", False), (4, "250201258", "Found", False)]
    forms = {r.page_id: r for r in html.html_forms(pages).collect()}
    assert forms[6].has_form and forms[6].action == "http://x/lookup"
    assert forms[6].fields == {"report_number": "", "csrf_token": "t0k", "county": "b"}
    assert forms[6].id_field == "report_number" and forms[6].has_token
    assert not forms[3].has_form
    ids = {r.page_id: r for r in html.html_by_id(pages).collect()}
    assert ids[7].crash_join_id == "R-77" and not ids[7].contact_found and ids[3].crash_join_id == ""
    valid = {r.page_id: r.valid for r in html.html_valid(pages).collect()}
    # "No records found" holds none of the validity markers; script text is not visible
    assert valid[1] is True and valid[2] is True and valid[8] is False and valid[9] is True


def test_sheet_url_f10(spark):
    df = spark.createDataFrame(
        [("https://docs.google.com/spreadsheets/d/SHEET/edit?gid=42#gid=0",), ("https://docs.google.com/spreadsheets/d/SHEET/edit#gid=7",),
         ("https://docs.google.com/spreadsheets/d/SHEET/edit",), ("https://example.com/spreadsheets/d/SHEET/edit",)], "u string")
    got = [r[0] for r in df.select(X.sheet_csv_url("u")).collect()]
    base = "https://docs.google.com/spreadsheets/d/SHEET/export?format=csv"
    assert got == [base + "&gid=42", base + "&gid=7", base, None]


def test_csv_from_text(spark):
    docs = spark.createDataFrame(
        [(1, "crash_join_id,target_id\nC-1001,TGT-1\n"), (2, 'target_id,crash_join_id\r\n"T,\n2",C-2\r\n\r\nT3\r\n'), (3, None), (4, "other\nx")],
        "doc int, text string",
    )
    out = files.csv_from_text(docs, "text", ["crash_join_id", "target_id"], ["doc"]).collect()
    assert sorted(map(tuple, out), key=str) == [
        (1, 1, "C-1001", "TGT-1"), (2, 1, "C-2", "T,\n2"), (2, 2, None, "T3"), (4, 1, None, None)]


def test_ids_of_any_length_and_null_portals(spark):
    from civiclens.functions.exprs import digits_as_number, next_number
    from civiclens.operators.audit import id_enumeration_report, id_gap_rate

    long = 10**39 + 999
    rows = [(None, 0, f"A{long}"), (None, 1, f"A0{long + 1}"), ("p", 0, "x9"), ("p", 1, "x10"), ("p", 2, "x12"), ("p", 3, "none")]
    log = spark.createDataFrame(rows, "portal string, pos long, id string")
    got = {r.portal: r.gap_rate for r in id_gap_rate(log, ["portal"], "pos", "id", bucket_size=1).collect()}
    assert got == {None: 1.0, "p": 0.5}
    report = {r.portal: r for r in id_enumeration_report(log, ["portal"], "pos", "id", F.lit(True), bucket_size=1).collect()}
    assert report[None].hits == 2 and str(long) in report[None].findings[0].evidence
    n = spark.createDataFrame([("009",), ("999",), ("٣",), ("a",)], "s string").select(digits_as_number("s").alias("d"), next_number(digits_as_number("s")).alias("n"))
    assert [tuple(r) for r in n.collect()] == [("9", "10"), ("999", "1000"), ("3", "4"), (None, None)]


def test_null_group_duplicates_and_blank_address_parts(spark):
    from civiclens.operators.mapping import normalize_records
    from civiclens.operators.profile import profile

    df = spark.createDataFrame([("a", 1), ("a", 2), (None, 3), (None, 3)], "g string, v int")
    assert {r.g: r.duplicate_rate for r in profile(df, ["g"], as_of="2024-01-01").collect()} == {"a": 0.0, None: 1.0}
    r = normalize_records(spark.createDataFrame([("", "k", "10", " ", "MAIN "), (None, "k", None, "", None)],
                          "crash_join_id string, crash_record_id string, street_no string, street_direction string, street_name string")).collect()
    assert [(x.crash_join_id, x.address, x.status) for x in r] == [("k", "10  MAIN", "normalized"), ("k", None, "normalized")]


def test_shared_folder_is_required_off_local_masters():
    from civiclens.session import is_local

    assert is_local("local") and is_local("local[8]")
    assert not is_local("local-cluster[3,2,1024]") and not is_local("spark://h:7077") and not is_local("yarn")


def test_geojson_and_ids_f12(spark, tmp_path):
    doc = {"type": "FeatureCollection", "features": [
        {"id": "us1", "properties": {"mag": 6.25, "time": 1700000000000}, "geometry": {"coordinates": [-70.1, 18.2, 10]}},
        {"id": "us1", "properties": {"mag": 6.25, "time": 1700000000000}, "geometry": {"coordinates": [-70.1, 18.2, 10]}},
        {"id": "us2", "properties": {"mag": None, "time": 1700000000001}}]}
    p = tmp_path / "q.json"
    p.write_text(json.dumps(doc))
    recs = files.geojson_explode(files.read_geojson(spark, str(p)))
    from civiclens.operators.aggregates import keep_first

    kept = {r.id: r for r in keep_first(recs, ["id"], ["timestamp"]).collect()}
    assert set(kept) == {"us1", "us2"} and kept["us1"].location == [-70.1, 18.2, 10.0] and kept["us2"].location is None
    payloads = spark.createDataFrame(
        [(1, '{"Results":[[{"CaseNumber":null,"StateCase":10001},{"CaseNumber":" A1 "}]]}'), (2, '{"Results":[{"StateCase":7}]}'), (3, '{"Results":[]}')],
        "doc int, p string")
    ids = [(r.doc, r.case_id) for r in files.nested_case_ids(payloads, "p", ["doc"]).orderBy("doc", "pos").collect()]
    assert ids == [(1, "10001"), (1, "A1"), (2, "7")]


def test_risk_f12(spark):
    df = spark.createDataFrame([("6.25",), ("9.9",), ("4.0",), (None,), ("x",), ("12",), ("-3",)], "magnitude string")
    got = [(r.risk_score, r.risk_level) for r in risk.risk_explain(df).collect()]
    assert got == [(62, "high"), (99, "critical"), (40, "medium"), (0, "low"), (0, "low"), (100, "critical"), (0, "low")]
    e = risk.risk_explain(spark.createDataFrame([("4.0",)], "magnitude string")).first().explanation
    assert e == "Risk level is medium with score 40/100 based on earthquake magnitude 4.0. Continue routine monitoring and review trends regularly."
    sp = risk.severity_proxy_score(spark.createDataFrame([(10,)], "injuries_total int")).first()
    assert sp.risk_score == 10


def test_features_f12(spark):
    df = spark.createDataFrame([("41.0", "-87.0", "2024-01-01 21:15:00"), ("1", "2", "2024-01-01 20:59:00"), ("1", "2", "2024-01-01 05:59:00"),
                                ("abc", "2", "junk")], "lat string, lon string, timestamp string")
    got = [(r.hour, r.is_night, r.missing_location, r.lat) for r in risk.feature_build(df).collect()]
    assert got == [(21, 1, 0, 41.0), (20, 0, 0, 1.0), (5, 1, 0, 1.0), (-1, 0, 1, None)]


def test_phones_and_ids(spark):
    df = spark.createDataFrame([("555-201-1001", "5552011001"), ("n/a", None)], "driver_phone string, owner_phone string")
    got = [(r.driver_phone, r.owner_phone) for r in mapping.clean_phones(df).collect()]
    assert got == [("5552011001", "5552011001"), (None, None)]
    ids = spark.createDataFrame([(" a ",), ("  ",), ("b",)], "id string")
    assert [r.id for r in mapping.clean_ids(ids, "id").collect()] == ["a", "b"]


def test_python_rounding(spark):
    vals = [0.05, 0.25, 0.35, 2.675, 99.95, 6.25]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    got = df.select(X.py_round("x", 1).alias("r1"), X.py_round("x", 2).alias("r2"), X.py_fixed("x", 1).alias("f")).collect()
    assert [r.r1 for r in got] == [round(v, 1) for v in vals]
    assert [r.r2 for r in got] == [round(v, 2) for v in vals]
    assert [r.f for r in got] == [f"{v:.1f}" for v in vals]


def test_sequence_signature_two_level(spark):
    import random

    rnd = random.Random(4)
    rows = [(i, f"s{rnd.randrange(5)}", rnd.randrange(0, 500), rnd.choice(["a", "b", "error"])) for i in range(400)]
    ev = spark.createDataFrame(rows, "id int, session string, t int, name string")
    one = {(r.signature, r.session) for r in audit.sequence_signature(ev, ["session"], ["t", "id"], "name", ["error"]).collect()}
    two = {(r.signature, r.session) for r in audit.sequence_signature(ev, ["session"], ["t", "id"], "name", ["error"], bucket=F.floor(F.col("t") / 37)).collect()}
    assert one == two and len(one) >= 1


def test_expression_helpers(spark):
    df = spark.createDataFrame([("POINT (-87.6 41.8)", " a, b ,,c ", "https://x", "2024-03-03 21:15:00", 0.125)], "p string, l string, u string, ts string, r double")
    r = df.select(
        X.wkt_point("p").alias("pt"), X.comma_list("l").alias("l"), X.is_url("u").alias("u"), X.percent_text("r").alias("pct"),
        *X.calendar_parts(X.parse_ts("ts")),
        X.join_address(F.lit(" 1 "), F.lit(None), F.lit("nan"), drop_nan=True).alias("addr"),
        X.two_way_prefix(F.lit("abc"), F.lit("ab")).alias("pre"), X.first_truthy(F.lit(""), F.lit("b")).alias("ft"),
    ).first()
    assert (r.pt.lon, r.pt.lat) == (-87.6, 41.8) and r.l == ["a", "b", "c"] and r.u is True
    assert r.pct == "12.5%" and (r.crash_hour, r.crash_day_of_week, r.crash_month) == (21, 1, 3)
    assert r.addr == "1" and r.pre is True and r.ft == "b"


def test_catalogues_and_config(spark, tmp_path):
    p1 = tmp_path / "crashes.json"
    p1.write_text(json.dumps([{"name": "Crash Date", "fieldName": "crash_date", "dataTypeName": "calendar_date"}, {"fieldName": "x"}]))
    p2 = tmp_path / "vehicles.json"
    p2.write_text(json.dumps([{"name": "Unit", "fieldName": "unit_no", "dataTypeName": "number", "description": "d"}]))
    c1 = files.column_catalogue(spark, str(p1))
    rows = sorted((r.name, r.fieldName, r.dataTypeName, r.description) for r in c1.collect())
    assert rows == [("", "x", "", ""), ("Crash Date", "crash_date", "calendar_date", "")]
    comb = files.combined_catalogue({"crashes": c1, "vehicles": files.column_catalogue(spark, str(p2))})
    counts = {r.dataset: r.columns_in_dataset for r in comb.collect()}
    assert counts == {"crashes": 2, "vehicles": 1}
    profiles = spark.createDataFrame([("stl", None, " 1, ,2 "), ("kc", "KCPD", "9")], "key string, agency string, seed_ids string")
    seeds = files.profile_seeds(profiles, "stl").collect()
    assert [(r.agency, r.seed_id) for r in seeds] == [("stl", "1"), ("stl", "2")]
    with pytest.raises(KeyError):
        files.profile_seeds(profiles, "nowhere")
    sched = spark.createDataFrame([("Chicago", "0 * * * *"), ("NYC", "*/15 * * * *")], "city string, cron string")
    assert files.schedule_lookup(sched, "chicago").first().cron == "0 * * * *"
    assert files.schedule_lookup(sched).count() == 2
    with pytest.raises(KeyError):
        files.schedule_lookup(sched, "paris")


def test_sinks(spark, tmp_path):
    from civiclens.sources import sinks

    a = spark.createDataFrame([("1", "x")], "crash_join_id string, b string")
    b = spark.createDataFrame([("2", "y")], "crash_join_id string, a string")
    assert sinks.sorted_union([a, b]).columns == ["a", "b", "crash_join_id"]
    assert sinks.write_sorted_union([a.limit(0)], str(tmp_path / "none")) == 0
    assert sinks.write_sorted_union([a, b], str(tmp_path / "u")) == 2
    assert sinks.write_json(a, str(tmp_path / "j")) == 1
    csv = tmp_path / "typed.csv"
    csv.write_text("id,v\n1,a\n1,b\n")
    with pytest.raises(ValueError):
        sinks.typed_load(spark, str(csv), "id int, v string", ["id"])
    bad = tmp_path / "bad.csv"
    bad.write_text("id,v\nx,a\n")
    with pytest.raises(Exception):
        sinks.typed_load(spark, str(bad), "id int, v string", ["id"])
    with pytest.raises(ValueError):
        sinks.upsert_table(spark, str(tmp_path / "t"), a, "crash_join_id", ["b"], str(tmp_path / "t"))


def test_small_library_pieces(spark, tmp_path):
    from civiclens.operators.aggregates import kpi_summary
    from civiclens.plans.compose import run_steps

    df = spark.createDataFrame([("b", 1, 0), ("a", 2, 1), ("b", None, None), ("a", 1, 0), (None, 3, 0)], "damage string, injuries_total int, injuries_fatal int")
    k = kpi_summary(df).first()
    assert (k.total_crashes, k.total_injuries, k.total_fatal, k.most_common_damage) == (5, 7, 1, "a")
    assert kpi_summary(df.drop("damage")).first().most_common_damage == "N/A"
    out = run_steps(df, [lambda d: d.filter("damage is not null"), lambda d: d.select("damage")])
    assert out.count() == 4
    r = mapping.map_report(spark.createDataFrame([(7, None, 200)], "id int, url string, code int"), "id", "url", "code", "lapd").first()
    assert (r.report_id, r.portal_url, r.status_code, r.source) == ("7", "", "200", "lapd")
    p = tmp_path / "u.csv"
    p.write_text("a,b\n1,x\n2,y\n")
    assert dict(files.read_csv_inferred(spark, str(p)).dtypes)["a"] == "int"


def test_drop_corrupt_counts(spark):
    lines = spark.createDataFrame([('{"a": 1, "b": "x"}',), ("[1, 2, 3]",), ('{"a": 2}',), ("not json",), ('"s"',), ('{"a": "zz"}',), ("{}",)], "value string")
    out = mapping.drop_corrupt(lines, "value", "a bigint, b string")
    assert out.count() == 4  # count alone works (no corrupt-record column)
    assert sorted((r.a, r.b) for r in out.collect() if r.a is not None) == [(1, "x"), (2, None)]


def test_geojson_strict_raises(spark, tmp_path):
    p = tmp_path / "g.json"
    p.write_text(json.dumps({"features": [{"properties": {"mag": 1.0}}]}))
    with pytest.raises(Exception):
        files.geojson_explode(files.read_geojson(spark, str(p)), strict=True).collect()


def test_append_and_distinct(spark, tmp_path):
    from civiclens.sources import sinks

    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a")], "id int, src string")
    path = str(tmp_path / "feat")
    assert sinks.append(df, path, partition_by=["src"]) == 3
    assert sinks.append(df.limit(1), path, partition_by=["src"]) == 1
    assert spark.read.parquet(path).count() == 4
    assert sorted(r.src for r in mapping.distinct_values(df, "src").collect()) == ["a", "b"]


def test_deep_pages_and_flat_rows(spark):
    deep = "<p>" * 5000 + "x" + "<div>" * 5000 + "no such thing"
    table = ("<table><tr><th><b>County</b></th><td> Cole </td></tr><tr><td>Date of Crash</td><th>2024-01-02</th></tr></table>"
             "<dl><dt>Troop</dt><dd>F</dd></dl><span id=report_num>R<i>1</i></span><p>Owner: x</p>")
    form = ("<form action='go?x=1'><input name=a value=1><input type=checkbox name=b value=2><input type=radio name=c value=3 checked>"
            "<select name=s><option value=u><option value=v selected></select><textarea name=t> hi </textarea>"
            "<input type=submit name=z><input name=a value=9><input type=hidden name=csrf_token value=k></form><form><input name=q></form>")
    pages = spark.createDataFrame([(1, "http://h/p/", deep), (2, "http://h/p/", table), (3, "http://h/p/", form), (4, None, None)],
                                  "page_id long, url string, html string")
    f = {r.page_id: r for r in html.html_fields(pages, default_troop="C").collect()}
    assert (f[2].county, f[2].report_date, f[2].location, f[2].troop, f[2].contact_found) == ("Cole", "2024-01-02", "", "F", True)
    assert f[1].county == "" and f[4].troop == "C"
    forms = {r.page_id: r for r in html.html_forms(pages).collect()}
    assert forms[3].action == "http://h/p/go?x=1" and forms[3].has_token and forms[3].id_field == "a"
    assert forms[3].fields == {"a": "9", "c": "3", "s": "v", "t": "hi", "csrf_token": "k"}
    assert not forms[2].has_form and forms[2].action == "http://h/p/search" and forms[2].id_field == "report_number" and forms[2].token is None
    assert forms[3].token == "k" and forms[3].hidden == {"z": "", "csrf_token": "k"}
    assert {r.action for r in html.html_forms(pages.where("page_id = 2"), search_url="http://portal/x/").collect()} == {"http://portal/x/search"}
    ids = {r.page_id: r.crash_join_id for r in html.html_by_id(pages).collect()}
    assert ids == {1: "", 2: "R1", 3: "", 4: ""}


def test_scan_is_linear_in_the_page(spark):
    import time

    from civiclens.sources.html import PageScan

    for page in ("<td>" * 250_000 + "x", "<td>x" * 200_000, '<p id="a">' * 100_000 + "y", "<td>" * 120_000 + "</b>" * 120_000, "<textarea>" * 50_000 + "z"):
        started = time.process_time()
        scan = PageScan("http://h/", "/s")
        scan.feed(page)
        scan.finish()
        assert sum(len(x) for x in scan.pieces) < len(page) and time.process_time() - started < 8
    pages = spark.createDataFrame([(1, "http://h/", "<table><tr><th>County</th><td>" + "<td>x" * 50_000)], "page_id long, url string, html string")
    assert html.html_fields(pages).first().county == "x" * 50_000


def test_page_ids_beside_null(spark):
    ids = [2**53 + 1, 2**53 + 3, None]
    pages = spark.createDataFrame([(i, "http://h/", "<p>ok</p>") for i in ids], "page_id long, url string, html string").coalesce(1)
    assert sorted((r.page_id for r in html.html_valid(pages).collect()), key=str) == sorted(ids, key=str)


def test_tokens_of_the_whole_page(spark):
    rows = [(1, '<input name="csrf_token" value="a"><form><input name="csrf_token" value="b"></form>'), (2, '<input name="csrf_token">'), (3, "<form></form>"),
            (4, '<input type=hidden name=v value=1><input type=submit name=go><input type=hidden name=v value=2><input type=text name=t value=3>')]
    pages = spark.createDataFrame([(i, "http://h/", h) for i, h in rows], "page_id long, url string, html string")
    got = {r.page_id: r for r in html.html_forms(pages).collect()}
    assert [got[i].token for i in (1, 2, 3)] == ["a", None, None]
    assert got[1].fields == {"csrf_token": "b"} and got[4].hidden == {"v": "2", "go": ""} and got[4].fields == {}


def test_first_rows_in_file_order(spark, tmp_path):
    for n in range(9):
        (tmp_path / f"part-{n}.csv").write_text("crash_record_id,v\n" + "".join(f"{n}-{i},x\n" for i in range(40)))
    for limit in (1, 39, 40, 41, 100, 360, 1000):
        got = [r.crash_record_id for r in files.scan_csv_limit(spark, str(tmp_path), limit).collect()]
        assert got == [f"{n}-{i}" for n in range(9) for i in range(40)][:limit]
    assert files.scan_csv_limit(spark, str(tmp_path), 0).count() == 360


def test_inferred_types(spark):
    rows = [("1", "1", "true", "1.5", "x", "", "01"), ("-2", "", "False", "2", "1", None, "2e3"), (" 3 ", "2.", "true", "1e3", "true", " ", "9" * 30)]
    df = spark.createDataFrame(rows, "a string, b string, c string, d string, e string, f string, g string")
    want = {"a": ("int", 3), "b": ("double", 2), "c": ("boolean", 3), "d": ("double", 3), "e": ("string", 3), "f": ("string", 0), "g": ("double", 3)}
    for frame in (df, df.repartition(3), df.coalesce(1)):
        assert {r["column"]: (r["type"], r["cells"]) for r in files.infer_types(frame).collect()} == want
    got = files.typed(df)
    assert dict(got.dtypes)["a"] == "int" and sorted(r.a for r in got.collect()) == [-2, 1, 3] and [r.b for r in got.orderBy("a").collect()] == [None, 1.0, 2.0]
    assert {r["type"] for r in files.infer_types(df.limit(0)).collect()} == {"string"}


def test_long_sessions_are_many_pieces(spark):
    from pyspark.sql import functions as F

    from civiclens.operators.audit import sequence_signature

    events = spark.range(40_000).select(F.when(F.col("id") < 30_000, F.lit("hot")).otherwise(F.concat(F.lit("s"), F.col("id") % 200)).alias("session"),
                                        F.col("id").alias("at"), F.concat(F.lit("e"), F.col("id") % 3).alias("name"))
    one = {r.signature: (r.session, r.n_events) for r in sequence_signature(events, ["session"], ["at"], "name", ["e1"]).collect()}
    two = {r.signature: (r.session, r.n_events) for r in sequence_signature(events, ["session"], ["at"], "name", ["e1"], bucket=F.lit(0)).collect()}
    assert one == two and max(n for _, n in one.values()) == 30_000
    nulls = spark.createDataFrame([(None, 1, "e1"), (None, 2, None), ("a", 3, "e1"), ("a", 4, None), ("b", 5, "q")], "session string, at int, name string")
    got = sequence_signature(nulls, ["session"], ["at"], "name", ["e1"]).collect()
    assert [(r.signature, r.session, r.n_events) for r in got] == [("e1-", None, 2)]


def test_clean_texts_and_several_datasets(spark):
    from civiclens.operators.audit import NO_PII, pii_scan, pii_text_summary
    from civiclens.operators.profile import multi_profile_text

    texts = spark.createDataFrame([("a", "SSN 123-45-6789"), ("b", "nothing"), ("c", None), (None, "clean")], "source_url string, text string")
    got = {r.source_url: r.summary for r in pii_text_summary(pii_scan(texts, "text", "source_url"), texts).collect()}
    assert got["a"].startswith("PII Scan") and {got["b"], got["c"], got[None]} == {NO_PII}
    report = spark.createDataFrame(
        [("Chicago", "csv", 1234567, 91.25, ["x"]), ("A city with a name of over thirty letters", "api", 5, 100.0, []), ("Bonn", "csv", 10, 91.25, ["x", "y"])],
        "city string, data_source_type string, total_records long, quality_score double, flagged_issues array<string>",
    )
    lines = [r.line for r in multi_profile_text(report, "city").orderBy("section", "quality_score", "name").collect()]
    assert lines[0] == "Multi-City Dataset Quality Report (3 cities)\n" and lines[2] == "-" * 65
    assert lines[1] == "City                           Source    Records  Score Issues"
    assert set(lines[3:]) == {
        "Bonn                           csv            10  91.2      2", "Chicago                        csv      1,234,567  91.2      1",
        "A city with a name of over thirty letters api             5 100.0      0",
    }


def test_scan_holds_the_rows_of_few_pages(spark):
    size = 200_000
    batch = pd.DataFrame({"page_id": range(40), "url": "u", "html": ["x" * size] * 38 + [None, ""]})
    parts = list(html._parts(batch))
    assert max(len(p) for p in parts) <= html.PART_CHARS // size + 1
    assert pd.concat(parts).equals(batch)
    small = pd.DataFrame({"page_id": range(2500), "url": "u", "html": "<p>a</p>"})
    assert [len(p) for p in html._parts(small)] == [1000, 1000, 500]
    pages = spark.createDataFrame([(i, f"http://x/{i}", None if i % 7 == 0 else f'<form action="a{i}"><input name="n" value="{i}"></form>') for i in range(2300)], "page_id long, url string, html string").coalesce(1)
    got = {r.page_id: (r.has_form, r.fields.get("n")) for r in html.html_forms(pages).collect()}
    assert got == {i: (i % 7 != 0, None if i % 7 == 0 else str(i)) for i in range(2300)}
