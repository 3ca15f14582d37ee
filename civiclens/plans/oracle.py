"""DuckDB SQL equivalents of the registered queries (same column names)."""

from __future__ import annotations

ORACLE: dict[str, str] = {}

_CRASH_VIEW_LINEITEM = """
  SELECT l.l_orderkey AS street_no, p.p_brand AS street_name,
         CAST(l.l_quantity >= 48 AS INTEGER) AS injuries_total,
         CAST(l.l_quantity >= 50 AS INTEGER) AS injuries_fatal,
         p.p_type AS prim_contributory_cause,
         CASE l.l_returnflag || l.l_linestatus WHEN 'NF' THEN 'NO DEFECTS' WHEN 'NO' THEN 'UNKNOWN'
              ELSE l.l_returnflag || l.l_linestatus END AS road_defect
  FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey
"""

ORACLE["hotspot_clusters"] = f"""
WITH c AS ({_CRASH_VIEW_LINEITEM}),
w AS (
  SELECT CAST(floor(CAST(trunc(COALESCE(TRY_CAST(CAST(street_no AS VARCHAR) AS DOUBLE), 0)) AS BIGINT) / 100.0) * 100 AS BIGINT) AS blk,
         trim(upper(COALESCE(street_name, 'UNKNOWN'))) AS street,
         COALESCE(TRY_CAST(CAST(injuries_total AS VARCHAR) AS DOUBLE), 0) AS inj,
         COALESCE(TRY_CAST(CAST(injuries_fatal AS VARCHAR) AS DOUBLE), 0) AS fat,
         prim_contributory_cause AS cause, road_defect AS defect
  FROM c),
s AS (
  SELECT CAST(blk AS VARCHAR) || ' ' || street AS segment, street, blk,
         count(*) AS crash_count, CAST(sum(inj) AS BIGINT) AS injury_count, CAST(sum(fat) AS BIGINT) AS fatal_count
  FROM w GROUP BY 1, 2, 3 HAVING count(*) >= 3),
sc AS (
  SELECT *, least(100.0, ln(1 + crash_count) * 15 + injury_count * 8.0 + fatal_count * 25.0) AS score FROM s),
cc AS (
  SELECT CAST(blk AS VARCHAR) || ' ' || street AS segment, cause AS v, count(*) AS n FROM w WHERE cause IS NOT NULL GROUP BY 1, 2),
cr AS (SELECT segment, v, row_number() OVER (PARTITION BY segment ORDER BY n DESC, v) AS rn FROM cc),
ca AS (SELECT segment, string_agg(v, ' | ' ORDER BY rn) AS top_causes FROM cr WHERE rn <= 3 GROUP BY 1),
dc AS (
  SELECT CAST(blk AS VARCHAR) || ' ' || street AS segment, defect AS v, count(*) AS n FROM w
  WHERE defect IS NOT NULL AND upper(defect) NOT IN ('NO DEFECTS', 'UNKNOWN', '') GROUP BY 1, 2),
dr AS (SELECT segment, v, row_number() OVER (PARTITION BY segment ORDER BY n DESC, v) AS rn FROM dc),
da AS (SELECT segment, string_agg(v, ', ' ORDER BY rn) AS d_comma, string_agg(v, ' | ' ORDER BY rn) AS road_defects
       FROM dr WHERE rn <= 3 GROUP BY 1),
lab AS (
  SELECT sc.*, CASE WHEN score >= 75 THEN 'CRITICAL' WHEN score >= 50 THEN 'HIGH RISK'
                    WHEN score >= 25 THEN 'ELEVATED' ELSE 'MONITOR' END AS severity
  FROM sc)
SELECT lab.segment, lab.street AS street_name, CAST(lab.blk AS VARCHAR) AS block, crash_count, injury_count, fatal_count,
       CAST(printf('%.1f', score) AS DOUBLE) AS risk_score, severity,
       COALESCE(ca.top_causes, '') AS top_causes, COALESCE(da.road_defects, '') AS road_defects,
       CASE severity
         WHEN 'CRITICAL' THEN 'Immediate engineering review required. Deploy traffic safety improvements (signals, barriers, repaving) within 30 days.'
         WHEN 'HIGH RISK' THEN 'Schedule engineering assessment within 60 days. Review signal timing and sight-line obstructions.'
         WHEN 'ELEVATED' THEN 'Flag for next quarterly road inspection cycle. Review posted speed limits.'
         ELSE 'Add to monthly monitoring list. No immediate action required.' END
       || COALESCE(' Known road defects: ' || da.d_comma || '.', '') AS recommendation
FROM lab LEFT JOIN ca ON lab.segment = ca.segment LEFT JOIN da ON lab.segment = da.segment
"""

_NORM = "regexp_replace(trim(lower(coalesce({x}, ''))), '[^a-z0-9 ]', '', 'g')"

ORACLE["fuzzy_join"] = f"""
WITH oc AS (SELECT * FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey),
r AS (
  SELECT 'C' || o_orderkey AS crash_record_id, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S.000') AS crash_date,
         CAST(o_orderkey % 50 AS VARCHAR) AS street_no, o_orderstatus AS street_direction, c_mktsegment AS street_name,
         o_orderkey AS ord FROM oc),
r2 AS (SELECT *, concat_ws(' ', CASE WHEN street_no <> '' THEN trim(street_no) END,
                               CASE WHEN street_direction <> '' THEN trim(street_direction) END,
                               CASE WHEN street_name <> '' THEN trim(street_name) END) AS addr FROM r),
l AS (
  SELECT 'K' || o_orderkey AS crash_join_id,
         strftime(CASE WHEN o_orderkey % 35 = 0 THEN o_orderdate + INTERVAL 20 YEAR ELSE o_orderdate END, '%Y-%m-%d') AS date,
         CASE WHEN o_orderkey % 3 = 0
              THEN CAST(o_orderkey % 50 AS VARCHAR) || ' ' || o_orderstatus || ' ' || c_mktsegment || ' #' || CAST(o_custkey % 10 AS VARCHAR)
              ELSE CAST(o_orderkey % 50 AS VARCHAR) || ' ' || o_orderstatus || ' ' || substr(c_mktsegment, 1, 5) END AS address
  FROM oc),
ln AS (SELECT *, NULLIF(substr(trim(date), 1, 10), '') AS d, {_NORM.format(x='address')} AS a FROM l),
rn AS (SELECT *, NULLIF(substr(trim(crash_date), 1, 10), '') AS d, {_NORM.format(x='addr')} AS a FROM r2),
m AS (
  SELECT ln.crash_join_id, arg_min(rn.crash_record_id, rn.ord) AS mid, arg_min(rn.crash_date, rn.ord) AS mdate,
         arg_min(rn.addr, rn.ord) AS maddr
  FROM ln JOIN rn ON ln.d = rn.d AND length(ln.a) > 0 AND length(rn.a) > 0
                 AND (starts_with(ln.a, rn.a) OR starts_with(rn.a, ln.a))
  GROUP BY ln.crash_join_id)
SELECT l.crash_join_id, l.date, l.address, m.mid AS matched_crash_record_id, m.mdate AS matched_crash_date,
       m.maddr AS matched_crash_address, CASE WHEN m.mid IS NULL THEN 'unmatched' ELSE 'matched' END AS match_status
FROM l LEFT JOIN m ON l.crash_join_id = m.crash_join_id
"""

_MERGE_SIDES = """
l AS (SELECT CASE WHEN o_orderkey > 3 THEN o_orderkey END AS crash_join_id, o_orderkey AS order_no,
             o_orderstatus AS status, o_totalprice AS amount FROM orders),
r AS (SELECT CASE WHEN l_orderkey > 5 THEN l_orderkey END AS crash_join_id, l_linenumber,
             l_linestatus AS status_contact, l_extendedprice AS amount_contact FROM lineitem)
"""

ORACLE["merge_suffix"] = f"""
WITH {_MERGE_SIDES}
SELECT l.crash_join_id, l.order_no, l.status, l.amount, r.l_linenumber, r.status_contact, r.amount_contact
FROM l LEFT JOIN r ON l.crash_join_id IS NOT DISTINCT FROM r.crash_join_id
"""

ORACLE["ensure_key"] = "SELECT o_orderkey AS crash_id, o_orderstatus, o_orderkey AS crash_join_id FROM orders"

_SYNC_SIDES = """
b AS (SELECT CAST(c_custkey AS VARCHAR) AS crash_join_id, c_name,
             CASE c_custkey % 3 WHEN 0 THEN '' WHEN 1 THEN NULL ELSE 'X' END AS o_orderstatus,
             CASE WHEN c_custkey % 5 = 0 THEN c_mktsegment ELSE '' END AS o_orderpriority FROM customer),
m AS (SELECT CASE WHEN o_orderkey % 13 = 0 THEN '' ELSE CAST(o_custkey AS VARCHAR) END AS crash_join_id, o_orderkey,
             o_orderstatus, CASE WHEN o_orderkey % 4 = 0 THEN '' ELSE o_orderpriority END AS o_orderpriority FROM orders)
"""

ORACLE["overlay_join"] = f"""
WITH {_SYNC_SIDES},
ml AS (SELECT * FROM (SELECT COALESCE(crash_join_id, '') AS k, o_orderkey, o_orderstatus, o_orderpriority,
                      row_number() OVER (PARTITION BY COALESCE(crash_join_id, '') ORDER BY o_orderkey DESC) AS rn FROM m) WHERE rn = 1)
SELECT b.crash_join_id, b.c_name,
       CASE WHEN ml.k IS NOT NULL THEN ml.o_orderstatus ELSE b.o_orderstatus END AS o_orderstatus,
       CASE WHEN ml.k IS NOT NULL THEN ml.o_orderpriority ELSE b.o_orderpriority END AS o_orderpriority,
       ml.o_orderkey
FROM b LEFT JOIN ml ON COALESCE(b.crash_join_id, '') = ml.k
"""


def _sync_sql(overwrite: bool) -> str:
    def pick(f: str, cur: str) -> str:
        inc = f"ml.{f}"
        ok = f"({inc} IS NOT NULL AND {inc} <> '')"
        take = ok if overwrite else f"{ok} AND ({cur} IS NULL OR {cur} = '')"
        return f"CASE WHEN {take} THEN {inc} ELSE {cur} END AS {f}"

    return f"""
WITH {_SYNC_SIDES},
ml AS (SELECT * FROM (SELECT crash_join_id AS k, CAST(o_orderkey AS VARCHAR) AS o_orderkey, o_orderstatus, o_orderpriority,
                      row_number() OVER (PARTITION BY crash_join_id ORDER BY o_orderkey DESC) AS rn
                      FROM m WHERE crash_join_id IS NOT NULL AND crash_join_id <> '') WHERE rn = 1)
SELECT b.crash_join_id, b.c_name, {pick('o_orderstatus', 'b.o_orderstatus')}, {pick('o_orderpriority', 'b.o_orderpriority')},
       {pick('o_orderkey', 'CAST(NULL AS VARCHAR)')}
FROM b LEFT JOIN ml ON b.crash_join_id = ml.k
"""


ORACLE["sync_fill"] = _sync_sql(False)
ORACLE["sync_overwrite"] = _sync_sql(True)

ORACLE["enrich_flag"] = """
WITH lk AS (SELECT o_custkey AS crash_id, arg_max(o_orderkey, o_orderkey) AS contact_orderkey,
                   arg_max(o_totalprice, o_orderkey) AS contact_totalprice
            FROM orders WHERE o_orderstatus = 'F' GROUP BY o_custkey)
SELECT c.c_custkey AS crash_id, c.c_name, lk.contact_orderkey, lk.contact_totalprice, lk.crash_id IS NOT NULL AS has_contact
FROM customer c LEFT JOIN lk ON c.c_custkey = lk.crash_id
"""

ORACLE["priority_resolve"] = """
WITH s AS (
  SELECT o_custkey AS crash_id, o_orderstatus AS st, max(o_orderkey) AS k FROM orders GROUP BY 1, 2),
v AS (SELECT crash_id, CASE st WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END AS p,
             CASE WHEN k % 9 = 0 THEN '' ELSE st || '-' || CAST(k AS VARCHAR) END AS v FROM s),
b AS (SELECT crash_id, arg_min(v, p) AS resolved, min(p) AS source_rank FROM v WHERE v IS NOT NULL AND v <> '' GROUP BY 1)
SELECT c.c_custkey AS crash_id, b.resolved, b.source_rank FROM customer c LEFT JOIN b ON c.c_custkey = b.crash_id
"""

_CHAIN = """
cr AS (SELECT c_custkey AS crash_record_id, c_mktsegment AS crash_type, c_nationkey FROM customer),
un AS (SELECT o_orderkey AS crash_unit_id, o_custkey AS crash_record_id, o_orderdate AS crash_date,
              o_orderstatus AS make, o_orderpriority AS model FROM orders),
pe AS (SELECT l_orderkey * 10 + l_linenumber AS person_id, l_orderkey AS crash_unit_id,
              CASE WHEN l_returnflag = 'R' THEN 'FATAL INJURY' ELSE 'NO INDICATION OF INJURY' END AS injury_type,
              l_quantity AS age FROM lineitem)
"""

ORACLE["join_inner_filtered"] = f"""
WITH {_CHAIN}
SELECT cr.crash_record_id, cr.crash_type, un.crash_unit_id, un.crash_date, un.make, un.model
FROM cr JOIN un ON cr.crash_record_id = un.crash_record_id WHERE cr.crash_type = 'BUILDING'
"""

ORACLE["join_unit"] = f"""
WITH {_CHAIN}
SELECT un.crash_unit_id, un.crash_record_id, pe.person_id, pe.injury_type, pe.age
FROM un JOIN pe ON un.crash_unit_id = pe.crash_unit_id WHERE un.model = '1-URGENT'
"""

ORACLE["join_left_chain"] = f"""
WITH {_CHAIN}
SELECT cr.crash_record_id, cr.crash_type, un.crash_unit_id, un.make, pe.person_id, pe.injury_type
FROM cr LEFT JOIN un ON cr.crash_record_id = un.crash_record_id LEFT JOIN pe ON un.crash_unit_id = pe.crash_unit_id
WHERE cr.crash_type = 'MACHINERY'
"""

ORACLE["join_direct"] = f"""
WITH {_CHAIN}
SELECT o.o_orderkey AS crash_record_id, o.o_orderdate AS crash_date, pe.person_id, pe.injury_type
FROM orders o JOIN pe ON o.o_orderkey = pe.crash_unit_id
"""

ORACLE["count_per_key"] = f"""
WITH {_CHAIN}
SELECT 'vehicles_per_crash' AS kind, crash_record_id AS key, count(*) AS n FROM un GROUP BY crash_record_id
UNION ALL
SELECT 'people_per_unit' AS kind, crash_unit_id AS key, count(*) AS n FROM pe GROUP BY crash_unit_id
"""

ORACLE["injury_summary"] = f"""
WITH {_CHAIN}
SELECT cr.crash_record_id, un.crash_unit_id, un.crash_date, un.make, un.model,
       count(pe.person_id) AS occupant_count, count(CASE WHEN pe.injury_type = 'FATAL INJURY' THEN 1 END) AS fatalities
FROM cr JOIN un ON cr.crash_record_id = un.crash_record_id LEFT JOIN pe ON un.crash_unit_id = pe.crash_unit_id
GROUP BY cr.crash_record_id, un.crash_unit_id, un.crash_date, un.make, un.model
"""

_FOUND = "found AS (SELECT o_orderkey AS report_id, o_totalprice FROM orders WHERE o_orderstatus = 'F')"

ORACLE["lookup_hits"] = f"""
WITH {_FOUND}, ids AS (SELECT DISTINCT event_id AS id FROM events)
SELECT ids.id, found.o_totalprice FROM ids JOIN found ON ids.id = found.report_id
"""

ORACLE["lookup_misses"] = f"""
WITH {_FOUND}, ids AS (SELECT DISTINCT event_id AS id FROM events)
SELECT ids.id FROM ids WHERE NOT EXISTS (SELECT 1 FROM found WHERE found.report_id = ids.id)
"""

ORACLE["range_scan"] = f"""
WITH {_FOUND}
SELECT report_id // 600 AS range_no, report_id FROM found WHERE report_id % 600 < 400
"""

ORACLE["multi_range_scan"] = f"""
WITH {_FOUND},
r AS (SELECT c_custkey AS range_no, c_custkey * 10 AS s, c_custkey * 10 + 5 + c_nationkey AS e, c_custkey % 4 + 1 AS lim FROM customer),
j AS (SELECT r.range_no, f.report_id, r.lim, row_number() OVER (PARTITION BY r.range_no ORDER BY f.report_id) AS rn
      FROM r JOIN found f ON f.report_id >= r.s AND f.report_id < r.e)
SELECT range_no, report_id FROM j WHERE rn <= lim
"""

_PROFILE_FRAME = """
f AS (
  SELECT event_type, CASE WHEN event_id % 97 = 0 THEN NULL ELSE event_id END AS crash_join_id, ts AS crash_date,
         epoch_ms(epoch_us(ts) // 1000 + CAST(trunc((value - 10) * 3600000) AS BIGINT)) AS date_police_notified,
         TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) AS latitude,
         CASE WHEN user_id % 5 = 0 THEN NULL ELSE value END AS longitude,
         CASE WHEN event_id % 4 = 0 THEN NULL ELSE user_id % 3 END AS injuries_total,
         user_id, CAST(ts AS DATE) AS crash_day
  FROM events)
"""


def _profile_sql(group: str | None) -> str:
    g = f"{group}, " if group else ""
    gb = f"GROUP BY {group}" if group else ""
    on = f"USING ({group})" if group else "ON TRUE"
    nulls = " + ".join(
        f"CAST({c} IS NULL{' OR isnan(' + c + ')' if c in ('latitude', 'longitude') else ''} AS INTEGER)"
        for c in ["crash_join_id", "crash_date", "date_police_notified", "latitude", "longitude", "injuries_total", "user_id", "crash_day"]
    )
    crit = " + ".join(
        f"CAST({c} IS NULL{' OR isnan(' + c + ')' if c in ('latitude', 'longitude') else ''} AS INTEGER)"
        for c in ["crash_date", "latitude", "longitude", "crash_join_id"]
    )
    return f"""
{_PROFILE_FRAME},
d AS (SELECT *, (epoch_us(date_police_notified) - epoch_us(crash_date)) / 86400e6 AS dd FROM f),
a AS (SELECT {g} count(*) AS total_records, sum({nulls}) AS nc, sum({crit}) AS cc,
             sum(CAST(injuries_total IS NOT NULL AS INTEGER)) AS ip, avg(CASE WHEN dd >= 0 THEN dd END) AS dl,
             max(crash_date) AS latest FROM d {gb}),
dc AS (SELECT {g} user_id, crash_day, count(*) AS n FROM f GROUP BY {g} user_id, crash_day),
dr AS (SELECT {g} sum(CASE WHEN n > 1 THEN n ELSE 0 END) AS dup_rows FROM dc {gb}),
m AS (
  SELECT {g} total_records,
         CASE WHEN total_records = 0 THEN 100.0 ELSE nc / (total_records * 8.0) * 100 END AS mp,
         CASE WHEN total_records = 0 THEN 0.0 ELSE COALESCE(dup_rows, 0) / CAST(total_records AS DOUBLE) END AS du,
         CASE WHEN total_records = 0 THEN 0.0 ELSE COALESCE(dl, 0.0) END AS de,
         CASE WHEN total_records = 0 THEN 0.0 ELSE cc / (total_records * 4.0) * 100 END AS cr,
         CASE WHEN total_records = 0 THEN 100.0 ELSE ip / CAST(total_records AS DOUBLE) * 100 END AS ij,
         CASE WHEN total_records = 0 THEN 0.0
              ELSE COALESCE(greatest(0.0, (epoch_us(TIMESTAMP '2024-03-15 00:00:00') - epoch_us(latest)) / 86400e6), 0.0) END AS st
  FROM a LEFT JOIN dr {on}),
s AS (
  SELECT *, CASE WHEN total_records = 0 THEN 0.0 ELSE greatest(0.0, 100.0 - least(mp, 100.0) * 0.30 - least(cr, 100.0) * 0.30
            - least(du * 100, 100.0) * 0.20 - least(de / 30, 1.0) * 100 * 0.10 - (100.0 - least(ij, 100.0)) * 0.10) END AS qs,
         CASE WHEN total_records = 0 THEN ['Dataset is empty'] ELSE list_filter([
           CASE WHEN mp > 20 THEN 'High missing-field rate: ' || printf('%.1f', mp) || '% of cells are null.' END,
           CASE WHEN du > 0.05 THEN 'Duplicate rate ' || printf('%.1f', du * 100) || '% exceeds 5% threshold.' END,
           CASE WHEN de > 14 THEN 'Avg ingestion delay ' || printf('%.1f', de) || ' days — data may lag real events.' END,
           CASE WHEN cr > 5 THEN 'Critical fields (lat/lon/date/id) have ' || printf('%.1f', cr) || '% nulls.' END,
           CASE WHEN st > 30 THEN 'Most recent record is ' || printf('%.0f', st) || ' days old — feed may have stalled.' END
         ], lambda x: x IS NOT NULL) END AS iss
  FROM m),
r AS (
  SELECT {g} total_records, CAST(printf('%.2f', mp) AS DOUBLE) AS missing_fields_pct, CAST(printf('%.4f', du) AS DOUBLE) AS duplicate_rate,
         CAST(printf('%.2f', de) AS DOUBLE) AS avg_ingestion_delay_days, CAST(printf('%.2f', cr) AS DOUBLE) AS critical_fields_null_pct,
         CAST(printf('%.2f', ij) AS DOUBLE) AS injury_completeness_pct, CAST(printf('%.1f', st) AS DOUBLE) AS staleness_days, 'api' AS data_source_type,
         CAST(printf('%.1f', qs) AS DOUBLE) AS quality_score, array_to_string(iss, ' | ') AS issues, CAST(len(iss) AS INTEGER) AS n_issues, iss
  FROM s)
"""


ORACLE["dataset_profile"] = "WITH " + _profile_sql(None) + " SELECT * EXCLUDE (iss) FROM r"
ORACLE["profile_empty"] = ("WITH " + _profile_sql(None) + " SELECT * EXCLUDE (iss) FROM r").replace(
    "FROM events)", "FROM events WHERE user_id < 0)"
)
_TYPE = "WITH " + _profile_sql("event_type")
ORACLE["missing_pct"] = _TYPE + " SELECT event_type, missing_fields_pct FROM r"
ORACLE["duplicate_rate"] = _TYPE + " SELECT event_type, duplicate_rate FROM r"
ORACLE["critical_null_pct"] = _TYPE + " SELECT event_type, critical_fields_null_pct FROM r"
ORACLE["completeness_pct"] = _TYPE + " SELECT event_type, injury_completeness_pct FROM r"
ORACLE["staleness_days"] = _TYPE + " SELECT event_type, staleness_days FROM r"
ORACLE["issue_flags"] = _TYPE + " SELECT event_type, issues, n_issues FROM r"
ORACLE["multi_profile_ranked"] = (
    _TYPE + " SELECT * EXCLUDE (iss) FROM r ORDER BY quality_score DESC, event_type"
)


def _fmt1(x: str, d: int = 1) -> str:
    return f"printf('%.{d}f', {x})"


ORACLE["profile_text"] = _TYPE + f"""
SELECT event_type, concat_ws(chr(10),
  '=== ' || event_type || ' (' || upper(data_source_type) || ') ===',
  '  Records          : ' || format('{{:,}}', total_records),
  '  Quality score    : ' || {_fmt1('quality_score')} || ' / 100',
  '  Missing fields   : ' || {_fmt1('missing_fields_pct')} || '%',
  '  Duplicate rate   : ' || {_fmt1('duplicate_rate * 100')} || '%',
  '  Ingestion delay  : ' || {_fmt1('avg_ingestion_delay_days')} || ' days avg',
  '  Staleness        : ' || {_fmt1('staleness_days', 0)} || ' days since last record',
  '  Critical nulls   : ' || {_fmt1('critical_fields_null_pct')} || '%',
  '  Injury complete  : ' || {_fmt1('injury_completeness_pct')} || '%',
  CASE WHEN len(iss) > 0 THEN '  Issues:' || chr(10) || array_to_string(list_transform(iss, lambda x: '    ⚠  ' || x), chr(10)) END
) AS summary FROM r
"""

ORACLE["avg_delay_days"] = """
WITH d AS (SELECT o_orderpriority, (epoch_us(l_shipdate) - epoch_us(o_orderdate)) / 86400e6 AS dd
           FROM orders JOIN lineitem ON o_orderkey = l_orderkey)
SELECT o_orderpriority, CAST(printf('%.2f', COALESCE(avg(CASE WHEN dd >= 0 THEN dd END), 0.0)) AS DOUBLE) AS avg_ingestion_delay_days
FROM d GROUP BY 1
"""

_REQUEST_LOG = """
rl AS (SELECT user_id AS portal, event_id AS pos,
              CASE WHEN event_type = 'signup' THEN 'n/a' ELSE 'RPT-' || CAST(CAST(floor(epoch(ts) / 3600) AS BIGINT) AS VARCHAR) END AS report_id,
              event_type <> 'error' AS ok FROM events),
nm AS (SELECT portal, pos, TRY_CAST(NULLIF(regexp_replace(report_id, '\\D', '', 'g'), '') AS DECIMAL(38,0)) AS num FROM rl),
nv AS (SELECT *, lag(num) OVER (PARTITION BY portal ORDER BY pos) AS prev FROM nm WHERE num IS NOT NULL),
ng AS (SELECT portal, count(*) AS n, sum(CAST(abs(num - prev) = 1 AS INTEGER)) AS c FROM nv GROUP BY 1),
gap AS (SELECT portal, CASE WHEN n < 2 THEN 0.0 ELSE COALESCE(c, 0) / CAST(n - 1 AS DOUBLE) END AS gap_rate FROM ng)
"""

ORACLE["id_gap_rate"] = f"WITH {_REQUEST_LOG} SELECT portal, gap_rate FROM gap"

ORACLE["id_enumeration_report"] = f"""
WITH {_REQUEST_LOG},
b AS (SELECT portal, count(*) AS ids_probed, CAST(sum(CAST(ok AS INTEGER)) AS BIGINT) AS hits FROM rl GROUP BY 1),
h AS (SELECT portal, report_id, row_number() OVER (PARTITION BY portal ORDER BY pos) AS rn, pos FROM rl WHERE ok),
ev AS (SELECT portal, string_agg('''' || report_id || '''', ', ' ORDER BY pos) AS ids FROM h WHERE rn <= 5 GROUP BY 1),
r AS (SELECT b.portal, ids_probed, hits, hits / CAST(ids_probed AS DOUBLE) AS hr, COALESCE(gap.gap_rate, 0.0) AS gr, ev.ids
      FROM b LEFT JOIN gap USING (portal) LEFT JOIN ev USING (portal)),
s AS (SELECT *, CASE WHEN hr >= 0.9 AND gr >= 0.7 THEN 'CRITICAL' WHEN hr >= 0.75 THEN 'HIGH' WHEN hr >= 0.5 THEN 'MEDIUM'
                     WHEN hr > 0 THEN 'LOW' ELSE 'INFO' END AS severity FROM r),
f AS (SELECT *, list_filter([
        CASE WHEN hr > 0 THEN concat_ws(' :: ', severity, 'Sequential ID Enumeration',
             printf('%.0f', hr * 100) || '% of probed IDs returned valid records. An attacker can enumerate all crash records by iterating IDs.',
             'Valid IDs confirmed: [' || COALESCE(ids, '') || ']' || CASE WHEN hits > 5 THEN '…' ELSE '' END) END,
        CASE WHEN gr >= 0.7 THEN concat_ws(' :: ', 'HIGH', 'Predictable ID Pattern',
             printf('%.0f', gr * 100) || '% of consecutive IDs differ by 1. Report IDs are strictly sequential and therefore fully predictable.',
             '') END], lambda x: x IS NOT NULL) AS fl FROM s)
SELECT portal, ids_probed, hits, CAST(printf('%.4f', hr) AS DOUBLE) AS hit_rate, CAST(printf('%.4f', gr) AS DOUBLE) AS gap_rate, severity,
       CAST(len(fl) AS INTEGER) AS n_findings, array_to_string(fl, ' || ') AS findings_text,
       CASE severity
         WHEN 'CRITICAL' THEN 'URGENT: Implement token-based access control. Replace sequential IDs with non-guessable UUIDs. Add authentication for full-record retrieval. Consider rate-limiting and CAPTCHA on the search form.'
         WHEN 'HIGH' THEN 'Replace sequential numeric report IDs with opaque tokens or UUIDs. Add per-IP rate limiting and an audit log for bulk enumeration attempts.'
         WHEN 'MEDIUM' THEN 'Monitor for bulk access patterns. Consider switching to non-sequential IDs and adding rate limiting to the search endpoint.'
         WHEN 'LOW' THEN 'Low enumeration risk detected. Monitor access logs for sequential request patterns and review whether all returned fields are intended for public access.'
         ELSE 'No enumeration vulnerability detected in this sample. Re-test with a larger ID range to confirm.' END AS recommendation
FROM f
"""

ORACLE["sequence_signature"] = """
WITH s AS (SELECT user_id, CAST(ts AS DATE) AS day, string_agg(event_type, '-' ORDER BY ts, event_id) AS signature,
                  count(*) AS n_events, max(CAST(event_type IN ('error', 'purchase') AS INTEGER)) AS flag
           FROM events GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY signature ORDER BY day, user_id) AS rn FROM s WHERE flag = 1)
SELECT signature, user_id, day, n_events FROM r WHERE rn = 1
"""

ORACLE["throttle_slots"] = """
WITH e AS (SELECT user_id, event_id, ts, epoch_us(ts) AS t,
                  row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i FROM events),
r AS (SELECT *, max(t - i * 21600000000) OVER (PARTITION BY user_id ORDER BY ts, event_id
                                              ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS m FROM e)
SELECT user_id, event_id, t AS t_us, i * 21600000000 + m AS slot_start_us, i * 21600000000 + m - t AS delay_us FROM r
"""

ORACLE["token_bucket_delay"] = """
WITH e AS (SELECT user_id, event_id, ts, epoch_us(ts) AS t,
                  row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i FROM events),
r AS (SELECT *, max(t - i * 14400000000) OVER w AS m, max(t) OVER w AS tm FROM e
      WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT user_id, event_id, t AS t_us, greatest(tm, m + (i + 1 - 3) * 14400000000) AS admit_us,
       greatest(tm, m + (i + 1 - 3) * 14400000000) - t AS delay_us FROM r
"""

ORACLE["validate_rules"] = """
SELECT * FROM (VALUES
  ('o_orderkey', 'required', (SELECT count(*) FROM orders WHERE o_orderkey IS NULL)),
  ('o_custkey', 'required', (SELECT count(*) FROM orders WHERE o_custkey IS NULL)),
  ('o_orderstatus', 'enum', (SELECT count(*) FROM orders WHERE o_orderstatus IS NOT NULL AND o_orderstatus NOT IN ('F', 'O'))),
  ('o_orderpriority', 'pattern', (SELECT count(*) FROM orders WHERE o_orderpriority IS NOT NULL AND NOT regexp_matches(o_orderpriority, '^[1-5]-[A-Z ]+$'))),
  ('o_orderpriority', 'enum', (SELECT count(*) FROM orders WHERE o_orderpriority IS NOT NULL AND o_orderpriority NOT IN ('1-URGENT', '2-HIGH', '3-MEDIUM'))),
  ('o_orderdate', 'datetime', (SELECT count(*) FROM orders WHERE o_orderdate IS NOT NULL AND TRY_CAST(CAST(o_orderdate AS VARCHAR) AS TIMESTAMP) IS NULL)),
  ('o_totalprice', 'minimum', (SELECT count(*) FROM orders WHERE o_totalprice IS NOT NULL AND o_totalprice < 10000)),
  ('o_totalprice', 'type', (SELECT count(*) FROM orders WHERE o_totalprice IS NOT NULL AND TRY_CAST(CAST(o_totalprice AS VARCHAR) AS DOUBLE) IS NULL))
) t("column", rule, violations)
"""

ORACLE["key_violations"] = """
SELECT o_custkey, o_orderstatus, count(*) AS n FROM orders GROUP BY 1, 2 HAVING count(*) > 1
"""

ORACLE["orphan_counts"] = """
WITH o AS (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P'),
li AS (SELECT CASE WHEN l_linenumber = 7 THEN NULL ELSE l_orderkey END AS l_orderkey FROM lineitem)
SELECT 'orphan_children' AS "check", (SELECT count(*) FROM li WHERE l_orderkey IS NOT NULL AND l_orderkey NOT IN (SELECT o_orderkey FROM o)) AS n
UNION ALL
SELECT 'parents_without_children', (SELECT count(*) FROM o WHERE NOT EXISTS (SELECT 1 FROM li WHERE li.l_orderkey = o.o_orderkey))
UNION ALL
SELECT 'null_foreign_keys', (SELECT count(*) FROM li WHERE l_orderkey IS NULL)
"""

# PII patterns for RE2 (SSN's look-aheads become a filter on plain candidates).
_PII_SQL = [
    ("SSN", "CRITICAL", 0,
     "list_filter(regexp_extract_all(text, '\\b\\d{3}[-\\s]\\d{2}[-\\s]\\d{4}\\b'), lambda x: "
     "substr(x, 1, 3) NOT IN ('000', '666') AND substr(x, 1, 1) <> '9' AND substr(x, 5, 2) <> '00' AND substr(x, 8, 4) <> '0000')"),
    ("Phone", "HIGH", 1, "regexp_extract_all(text, '(?:\\+?1[-.\\s]?)?(?:\\(\\d{3}\\)[-.\\s]?|\\d{3}[-.\\s])\\d{3}[-.\\s]\\d{4}')"),
    ("Email", "MEDIUM", 2, "regexp_extract_all(text, '\\b[a-zA-Z0-9._%+\\-]+@[a-zA-Z0-9.\\-]+\\.[a-zA-Z]{2,}\\b')"),
    ("Date of Birth", "HIGH", 3, "regexp_extract_all(text, '(?i)\\b(?:DOB|Date of Birth|Born)[:\\s]+\\d{1,2}[/\\-]\\d{1,2}[/\\-]\\d{2,4}\\b')"),
    ("Driver License", "HIGH", 4, "regexp_extract_all(text, '(?i)\\b(?:DL|License)[#\\s:]+[A-Z0-9]{6,12}\\b')"),
    ("License Plate", "MEDIUM", 5, "regexp_extract_all(text, '\\b[A-Z]{1,3}[-\\s]?\\d{3,4}[-\\s]?[A-Z]{0,3}\\b')"),
    ("Full Name (labeled)", "MEDIUM", 6, "regexp_extract_all(text, '(?i)\\b(?:Driver|Owner|Name)[:\\s]+[A-Z][a-z]+\\s[A-Z][a-z]+\\b')"),
]

_PII_FINDINGS = (
    "corpus AS (SELECT 'doc/' || CAST(doc_id AS VARCHAR) AS source_url, text FROM documents "
    "UNION ALL SELECT url AS source_url, html AS text FROM pages "
    "UNION ALL SELECT 'customer/' || c_custkey, 'Driver: Ann Lee, DOB: 1/' || (c_custkey % 28 + 1) || '/1990, SSN ' || (c_custkey % 500 + 100) || '-' "
    "|| lpad(CAST(c_custkey % 99 + 1 AS VARCHAR), 2, '0') || '-' || lpad(CAST(c_custkey % 9999 + 1 AS VARCHAR), 4, '0') || ', License: A' "
    "|| lpad(CAST(c_custkey AS VARCHAR), 7, '0') || ', plate KX-' || (c_custkey % 900 + 100) || ', call (' || (c_custkey % 800 + 100) || ') 555-' "
    "|| lpad(CAST(c_custkey % 10000 AS VARCHAR), 4, '0') || ', c' || c_custkey || '@mail.example.org' FROM customer),\n"
    "m AS (\n"
    + "\n  UNION ALL\n".join(
        f"  SELECT source_url, '{n}' AS pattern_name, '{s}' AS severity, {p} AS pattern_pos, {e} AS ms FROM corpus"
        for n, s, p, e in _PII_SQL
    )
    + "),\n"
    "f AS (SELECT source_url, pattern_name, severity, pattern_pos, CAST(len(ms) AS INTEGER) AS match_count,\n"
    "             list_slice(list_filter(ms, lambda x, i: list_position(ms, x) = i), 1, 3) AS smp FROM m WHERE len(ms) > 0)"
)

ORACLE["pii_scan"] = f"""
WITH {_PII_FINDINGS}
SELECT source_url, pattern_name, severity, match_count,
       array_to_string(list_transform(smp, lambda x: CASE WHEN length(x) <= 4 THEN repeat('*', length(x))
                       ELSE left(x, 1) || repeat('*', length(x) - 2) || right(x, 1) END), ' | ') AS samples
FROM f
"""

ORACLE["pii_summary"] = f"""
WITH {_PII_FINDINGS}
SELECT pattern_name, severity, count(*) AS texts_with_matches, CAST(sum(match_count) AS BIGINT) AS total_matches,
       printf('  [%-8s] %s: %d match(es) in %d text(s)', severity, pattern_name, sum(match_count), count(*)) AS line
FROM f GROUP BY 1, 2
"""

_QUAKES = """
q AS (SELECT event_id AS id, CASE WHEN event_type = 'error' THEN 'x' ELSE CAST(value / 50 AS VARCHAR) END AS magnitude FROM events),
qs AS (SELECT id, COALESCE(TRY_CAST(magnitude AS DOUBLE), 0.0) AS mag FROM q),
sc AS (SELECT id, mag, CAST(round_even(greatest(0.0, least(10.0, mag)) / 10.0 * 100, 0) AS INTEGER) AS risk_score FROM qs),
lv AS (SELECT *, CASE WHEN risk_score >= 80 THEN 'critical' WHEN risk_score >= 60 THEN 'high'
                      WHEN risk_score >= 40 THEN 'medium' ELSE 'low' END AS risk_level FROM sc)
"""

ORACLE["risk_score"] = f"WITH {_QUAKES} SELECT id, mag AS magnitude, risk_score, risk_level FROM lv"

ORACLE["risk_explain"] = f"""
WITH {_QUAKES}
SELECT id, risk_score, risk_level,
       'Risk level is ' || risk_level || ' with score ' || CAST(risk_score AS VARCHAR) || '/100 based on earthquake magnitude '
       || printf('%.1f', mag) || '.' || CASE risk_level
         WHEN 'critical' THEN ' Immediate monitoring and response planning are recommended.'
         WHEN 'high' THEN ' Elevated preparedness and active monitoring are recommended.'
         WHEN 'medium' THEN ' Continue routine monitoring and review trends regularly.'
         ELSE ' Current impact appears limited, maintain baseline monitoring.' END AS explanation
FROM lv
"""

ORACLE["severity_proxy_score"] = """
WITH p AS (SELECT l_orderkey * 10 + l_linenumber AS crash_record_id,
                  least(COALESCE(TRY_CAST(CAST(l_quantity AS VARCHAR) AS DOUBLE), 0.0) / 10.0, 10.0) AS severity_proxy FROM lineitem),
s AS (SELECT *, CAST(round_even(greatest(0.0, least(10.0, severity_proxy)) / 10.0 * 100, 0) AS INTEGER) AS risk_score FROM p)
SELECT crash_record_id, severity_proxy, risk_score,
       CASE WHEN risk_score >= 80 THEN 'critical' WHEN risk_score >= 60 THEN 'high' WHEN risk_score >= 40 THEN 'medium' ELSE 'low' END AS risk_level
FROM s
"""

ORACLE["feature_build"] = """
WITH e AS (SELECT event_id, json_extract_string(props, '$.k') AS lat,
                  CASE WHEN event_type = 'error' THEN 'n/a' ELSE CAST(value AS VARCHAR) END AS lon,
                  CASE WHEN event_type = 'signup' THEN 'junk' ELSE CAST(ts AS VARCHAR) END AS "timestamp" FROM events),
f AS (SELECT event_id, TRY_CAST(lat AS DOUBLE) AS lat, TRY_CAST(lon AS DOUBLE) AS lon,
             CAST(COALESCE(hour(TRY_CAST("timestamp" AS TIMESTAMP)), -1) AS INTEGER) AS hour FROM e)
SELECT event_id, lat, lon, hour, CASE WHEN hour <> -1 AND (hour < 6 OR hour > 20) THEN 1 ELSE 0 END AS is_night,
       CAST(lat IS NULL OR lon IS NULL AS INTEGER) AS missing_location
FROM f
"""

ORACLE["dedup_keep_first"] = """
SELECT event_id, ts, user_id, event_type, value FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events) WHERE rn = 1
"""

_DASH = """
d AS (SELECT p.p_type AS crash_type, p.p_brand AS prim_contributory_cause, l.l_linestatus AS weather_condition,
             CAST(l.l_quantity >= 48 AS INTEGER) AS injuries_total, CAST(l.l_quantity >= 50 AS INTEGER) AS injuries_fatal,
             CASE WHEN l.l_discount > 0.05 THEN 'OVER $1,500' WHEN l.l_discount > 0.02 THEN '$501 - $1,500'
                  ELSE '$500 OR LESS' END AS damage, l.l_returnflag AS most_severe_injury
      FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey)
"""

ORACLE["kpi_summary"] = f"""
WITH {_DASH},
m AS (SELECT damage FROM d WHERE damage IS NOT NULL GROUP BY damage ORDER BY count(*) DESC, damage LIMIT 1)
SELECT count(*) AS total_crashes, CAST(COALESCE(sum(injuries_total), 0) AS BIGINT) AS total_injuries,
       CAST(COALESCE(sum(injuries_fatal), 0) AS BIGINT) AS total_fatal,
       COALESCE((SELECT substr(damage, 1, 20) FROM m), 'N/A') AS most_common_damage
FROM d
"""

ORACLE["value_counts_top"] = f"""
WITH {_DASH}
SELECT prim_contributory_cause, count(*) AS count FROM d WHERE prim_contributory_cause IS NOT NULL
GROUP BY 1 ORDER BY count DESC, prim_contributory_cause LIMIT 10
"""

ORACLE["value_counts_all"] = f"""
WITH {_DASH}
SELECT crash_type, count(*) AS count FROM d WHERE crash_type IS NOT NULL GROUP BY 1
"""

ORACLE["map_points"] = """
WITH c AS (SELECT CASE WHEN c_custkey % 7 = 0 THEN 'bad' ELSE CAST(c_acctbal AS VARCHAR) END AS latitude,
                  CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE c_nationkey END AS longitude FROM customer),
n AS (SELECT TRY_CAST(latitude AS DOUBLE) AS latitude, TRY_CAST(CAST(longitude AS VARCHAR) AS DOUBLE) AS longitude
      FROM c WHERE latitude IS NOT NULL AND longitude IS NOT NULL)
SELECT * FROM n WHERE latitude IS NOT NULL AND longitude IS NOT NULL
"""


def _topk_sql(value: str, excl: str = "") -> str:
    return f"""
WITH c AS ({_CRASH_VIEW_LINEITEM}),
s AS (SELECT CAST(street_no - (street_no % 100) AS VARCHAR) AS segment, {value} AS v FROM c
      WHERE {value} IS NOT NULL {excl}),
n AS (SELECT segment, v, count(*) AS n FROM s GROUP BY 1, 2),
r AS (SELECT segment, v, row_number() OVER (PARTITION BY segment ORDER BY n DESC, v) AS rn FROM n)
SELECT segment, string_agg(v, ' | ' ORDER BY rn) AS top_values FROM r WHERE rn <= 3 GROUP BY 1
"""


ORACLE["topk_values_per_group"] = _topk_sql("prim_contributory_cause")
ORACLE["topk_values_excluding"] = _topk_sql("road_defect", "AND upper(road_defect) NOT IN ('NO DEFECTS', 'UNKNOWN', '')")

ORACLE["row_alerts"] = """
WITH r AS (
  SELECT CAST(o_orderkey AS VARCHAR) AS crash_join_id, CAST(o_orderdate AS VARCHAR) AS crash_date,
         CASE o_orderpriority WHEN '1-URGENT' THEN 'FATAL INJURY' WHEN '2-HIGH' THEN 'incapacitating injury '
              WHEN '3-MEDIUM' THEN 'NONINCAPACITATING INJURY' WHEN '4-NOT SPECIFIED' THEN 'REPORTED, NOT EVIDENT'
              ELSE 'NO INDICATION OF INJURY' END AS most_severe_injury,
         CAST(o_orderkey % 5000 AS VARCHAR) AS street_no, CASE WHEN o_orderkey % 2 = 0 THEN 'N' ELSE '' END AS street_direction,
         c_mktsegment AS street_name, c_name AS driver_name,
         CASE WHEN c_custkey % 10 = 0 THEN NULL ELSE printf('555-01%02d', c_custkey % 100) END AS driver_phone,
         CASE WHEN o_orderstatus = 'F' THEN 'Y' ELSE 'N' END AS hit_and_run_i,
         CASE o_orderstatus WHEN 'O' THEN 'RUT, HOLES' WHEN 'P' THEN 'NO DEFECTS' END AS road_defect,
         CASE WHEN o_totalprice > 300000 THEN 'NOT FUNCTIONING' ELSE 'FUNCTIONING PROPERLY' END AS device_condition
  FROM orders JOIN customer ON o_custkey = c_custkey),
s AS (SELECT *, trim(upper(COALESCE(most_severe_injury, ''))) AS sev,
             COALESCE(trim(driver_name), '') AS nm, COALESCE(trim(driver_phone), '') AS ph FROM r),
k AS (SELECT *, CASE sev WHEN 'FATAL' THEN 4 WHEN 'FATAL INJURY' THEN 4 WHEN 'INCAPACITATING INJURY' THEN 3
                          WHEN 'NONINCAPACITATING INJURY' THEN 2 WHEN 'REPORTED, NOT EVIDENT' THEN 1 ELSE 0 END AS rk FROM s)
SELECT COALESCE(crash_join_id, '') AS crash_join_id, COALESCE(crash_date, '') AS crash_date, sev AS injury_severity,
       concat_ws(' ', NULLIF(trim(street_no), ''), NULLIF(trim(street_direction), ''), NULLIF(trim(street_name), '')) AS location,
       CASE WHEN length(nm) <= 4 THEN repeat('*', length(nm)) ELSE left(nm, 1) || repeat('*', length(nm) - 2) || right(nm, 1) END AS contact_name,
       CASE WHEN length(ph) <= 4 THEN repeat('*', length(ph)) ELSE left(ph, 1) || repeat('*', length(ph) - 2) || right(ph, 1) END AS contact_phone,
       concat_ws(' ',
         CASE WHEN trim(upper(COALESCE(hit_and_run_i, ''))) = 'Y' THEN 'Hit-and-run — victim may need additional legal support.' END,
         CASE WHEN trim(upper(COALESCE(road_defect, ''))) NOT IN ('', 'NO DEFECTS', 'UNKNOWN', 'NAN') THEN 'Road defect recorded: ' || road_defect || '.' END,
         CASE WHEN trim(upper(COALESCE(device_condition, ''))) NOT IN ('', 'FUNCTIONING PROPERLY', 'NAN') THEN 'Traffic device condition: ' || device_condition || '.' END
       ) AS notes,
       'https://www.chicago.gov/city/en/depts/cdph/supp_info/behavioral-health/trauma-informed-care.html' AS resource_trauma,
       'https://www.illinoislegalaid.org/' AS resource_legal_aid,
       'https://311.chicago.gov/s/' AS resource_road_complaint,
       'https://insurance.illinois.gov/consumer/InjuredInAnAccident.html' AS resource_insurance_help,
       'https://www.chicago.gov/city/en/depts/fss/supp_info/victim-services.html' AS resource_victim_services
FROM k WHERE rk >= 2
"""

ORACLE["scan_csv_limit"] = """
SELECT CAST(c_custkey AS VARCHAR) AS crash_record_id, c_name, CAST(c_nationkey AS VARCHAR) AS c_nationkey, c_mktsegment,
       CAST(c_custkey AS VARCHAR) AS crash_join_id FROM customer
"""

ORACLE["scan_newest_k"] = """
SELECT o_orderkey, o_custkey, o_orderstatus, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S.000') AS crash_date
FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 100
"""

ORACLE["geojson_explode"] = """
SELECT 'ev' || CAST(event_id AS VARCHAR) AS id, epoch_us(ts) // 1000 AS "timestamp",
       CASE WHEN event_type <> 'error' THEN value END AS lon,
       CASE WHEN event_type <> 'error' THEN CAST(json_extract_string(props, '$.k') AS DOUBLE) END AS lat,
       CASE WHEN event_type <> 'error' THEN CAST(user_id AS DOUBLE) END AS depth,
       CASE WHEN event_type = 'signup' THEN NULL ELSE value / 10 END AS magnitude
FROM events
"""

ORACLE["arcgis_explode"] = "SELECT c_custkey, c_name, c_nationkey FROM customer"

ORACLE["nested_case_ids"] = """
SELECT CAST(floor(o_orderkey / 20) AS BIGINT) AS doc,
       CAST(row_number() OVER (PARTITION BY floor(o_orderkey / 20) ORDER BY o_orderkey) - 1 AS INTEGER) AS pos,
       CASE WHEN o_orderkey % 3 = 2 THEN 'A' || CAST(o_orderkey AS VARCHAR) ELSE CAST(o_orderkey AS VARCHAR) END AS case_id
FROM orders
"""

ORACLE["csv_from_text"] = """
WITH l AS (
  SELECT o_orderkey // 20 AS doc, CAST(o_orderkey AS VARCHAR) AS crash_join_id, o_orderstatus AS status,
         CASE WHEN (o_orderkey // 20) % 2 = 0 THEN o_orderpriority ELSE o_orderpriority || chr(10) || 'next' END AS priority
  FROM orders)
SELECT doc, CAST(row_number() OVER (PARTITION BY doc ORDER BY CASE WHEN doc % 2 = 0
         THEN crash_join_id || ',' || status || ',' || priority
         ELSE '"' || priority || '",' || crash_join_id || ',' || status END) AS INTEGER) AS line_no,
       crash_join_id, status, priority
FROM l
"""

ORACLE["drop_corrupt"] = "SELECT o_orderkey, o_custkey, o_orderstatus FROM orders WHERE o_orderkey % 10 <> 0"

ORACLE["rows_to_json"] = """
SELECT '{"c_custkey":' || CAST(c_custkey AS VARCHAR) || ',"c_name":"' || c_name || '","c_nationkey":'
       || CAST(c_nationkey AS VARCHAR) || ',"c_mktsegment":"' || c_mktsegment || '"}' AS json FROM customer
"""

ORACLE["sorted_union_columns"] = """
SELECT c_mktsegment, CAST(c_custkey AS VARCHAR) AS crash_join_id, c_name AS name, '' AS s_nationkey FROM customer
UNION ALL
SELECT '' AS c_mktsegment, CAST(s_suppkey AS VARCHAR), s_name, CAST(s_nationkey AS VARCHAR) FROM supplier
"""

ORACLE["upsert_by_key"] = """
WITH u AS (SELECT l_orderkey AS o_orderkey, 'R' AS o_orderstatus, l_extendedprice AS o_totalprice,
                  row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber DESC, l_partkey DESC, l_suppkey DESC, l_extendedprice DESC) AS rn
           FROM lineitem WHERE l_returnflag = 'R')
SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderkey NOT IN (SELECT o_orderkey FROM u)
UNION ALL
SELECT o_orderkey, o_orderstatus, o_totalprice FROM u WHERE rn = 1
"""

ORACLE["typed_load"] = "SELECT o_orderkey, o_custkey, o_orderstatus, o_orderpriority FROM orders"

ORACLE["normalize_records"] = """
SELECT COALESCE(NULLIF(CASE WHEN o_orderkey % 4 = 0 THEN '' WHEN o_orderkey % 4 = 1 THEN NULL ELSE 'J' || CAST(o_orderkey AS VARCHAR) END, ''),
                NULLIF(CAST(o_orderkey AS VARCHAR), '')) AS crash_join_id,
       CAST(o_orderdate AS VARCHAR) AS crash_date,
       CAST(o_orderkey % 7000 AS VARCHAR) || ' ' || CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE o_orderstatus END
         || ' ' || trim(o_orderpriority) AS address,
       'normalized' AS status
FROM orders
"""

ORACLE["map_trim_key"] = """
SELECT CASE WHEN c_custkey % 9 = 0 THEN NULL ELSE '  ' || CAST(c_custkey AS VARCHAR) || ' ' END AS collision_id, c_name,
       CASE WHEN c_custkey % 9 = 0 THEN '' ELSE CAST(c_custkey AS VARCHAR) END AS crash_join_id
FROM customer
"""

ORACLE["map_coalesce_key"] = """
SELECT CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE ' D' || CAST(c_custkey AS VARCHAR) END AS crash_id,
       CASE WHEN c_custkey % 6 = 0 THEN NULL ELSE c_custkey END AS OBJECTID, c_name,
       COALESCE(trim(CASE WHEN c_custkey % 3 = 0 THEN CASE WHEN c_custkey % 6 = 0 THEN NULL ELSE CAST(c_custkey AS VARCHAR) END
                          ELSE ' D' || CAST(c_custkey AS VARCHAR) END), '') AS crash_join_id,
       'detroit' AS source
FROM customer
"""

ORACLE["clean_ids"] = """
SELECT CAST(o_orderkey AS VARCHAR) AS report_id FROM orders WHERE o_orderkey % 8 <> 0
"""

ORACLE["clean_phones"] = """
SELECT c_custkey AS crash_join_id,
       CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE printf('555%03d%04d', c_nationkey, c_custkey) END AS driver_phone,
       CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE printf('555%03d%04d', c_nationkey, c_custkey % 10000) END AS owner_phone,
       c_name
FROM customer
"""

_ACC = """
acc AS (SELECT o.o_orderkey AS st_case, c.c_nationkey AS state, CAST(year(o.o_orderdate) AS INTEGER) AS year, c.c_mktsegment AS county,
               COALESCE(v.vehicles, 0) AS vehicles, o.o_orderpriority AS make, o.o_orderstatus AS model, o.o_totalprice AS body_value
        FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey
        LEFT JOIN (SELECT l_orderkey, count(*) AS vehicles FROM lineitem GROUP BY 1) v ON o.o_orderkey = v.l_orderkey),
per AS (SELECT l_orderkey AS st_case, CAST(l_quantity AS INTEGER) AS age, l_returnflag AS sex, l_linenumber AS seat_pos,
               l_linestatus AS injury_severity, l_linenumber <= 4 AS occupant FROM lineitem)
"""

ORACLE["case_list"] = f"WITH {_ACC} SELECT st_case FROM acc WHERE state = 7 AND year BETWEEN 1997 AND 1997 AND vehicles >= 1"
ORACLE["case_details"] = f"WITH {_ACC} SELECT * FROM acc WHERE state = 3 AND year = 1998 AND county = 'BUILDING'"
ORACLE["search_by_person"] = f"""
WITH {_ACC} SELECT st_case, state, year FROM acc WHERE year BETWEEN 1995 AND 1999
AND st_case IN (SELECT st_case FROM per WHERE sex = 'R' AND injury_severity = 'F' AND age = 25 AND occupant)
"""
ORACLE["search_by_location"] = f"""
WITH {_ACC} SELECT st_case, state, year, county FROM acc WHERE year BETWEEN 1996 AND 1998 AND state = 12 AND county = 'MACHINERY'
"""
ORACLE["variable_catalogue"] = f"""
WITH {_ACC}
SELECT year, variable, count(value) AS non_null, any_value(dt) AS data_type FROM (
  SELECT year, 'state' AS variable, CAST(state AS VARCHAR) AS value, 'int' AS dt FROM acc
  UNION ALL SELECT year, 'county', county, 'string' FROM acc
  UNION ALL SELECT year, 'vehicles', CAST(vehicles AS VARCHAR), 'bigint' FROM acc
  UNION ALL SELECT year, 'make', make, 'string' FROM acc
  UNION ALL SELECT year, 'model', model, 'string' FROM acc
  UNION ALL SELECT year, 'body_value', CAST(body_value AS VARCHAR), 'double' FROM acc) GROUP BY 1, 2
"""
ORACLE["attribute_domain"] = f"WITH {_ACC} SELECT make AS value, count(*) AS n FROM acc WHERE make IS NOT NULL GROUP BY 1"
ORACLE["attribute_domain_scoped"] = f"""
WITH {_ACC} SELECT model AS value, count(*) AS n FROM acc WHERE make = '1-URGENT' AND model IS NOT NULL GROUP BY 1
"""
ORACLE["attribute_domain_scoped2"] = f"""
WITH {_ACC} SELECT county AS value, count(*) AS n FROM acc WHERE make = '2-HIGH' AND model = 'F' AND county IS NOT NULL GROUP BY 1
"""
ORACLE["dataset_slice"] = f"""
WITH {_ACC} SELECT CAST(st_case AS VARCHAR) || ',' || CAST(vehicles AS VARCHAR) || ',' || make || ',' || CAST(year AS VARCHAR) || ',' || CAST(state AS VARCHAR) AS line
FROM acc WHERE year BETWEEN 1996 AND 1997 AND state = 5
"""

ORACLE["stream_keep_first"] = """
SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) = 1
"""
ORACLE["stream_upsert"] = ORACLE["upsert_by_key"]
ORACLE["stream_token_bucket"] = ORACLE["token_bucket_delay"]
# all windows, those still open at the end among them
ORACLE["stream_window_counts_all"] = """
WITH w AS (SELECT event_type AS segment, date_trunc('day', ts) - to_days(CAST(unnest(range(0, 7)) AS INTEGER)) AS window_start
           FROM events WHERE ts IS NOT NULL)
SELECT window_start, window_start + INTERVAL 7 DAY AS window_end, segment, count(*) AS crash_count FROM w GROUP BY 1, 2, 3
"""

# HTML jobs: regex forms of the parser rules, valid for well-formed pages like
# the driver's (comments, script, style and template bodies removed, tags
# stripped, label cells matched within one row).
_VISIBLE = (
    "regexp_replace(regexp_replace(regexp_replace(html, "
    "'(?s)<!--.*?-->|<script\\b.*?</script>|<style\\b.*?</style>|<template\\b.*?</template>', ' ', 'g'), "
    "'<[^>]*>', ' ', 'g'), '\\s+', ' ', 'g')"
)
_ALLTEXT = "regexp_replace(regexp_replace(html, '(?s)<!--.*?-->', ' ', 'g'), '<[^>]*>', ' ', 'g')"

ORACLE["html_links"] = """
WITH l AS (SELECT page_id,
                  regexp_extract_all(html, '<a\\s[^>]*href="([^"]*)"[^>]*>([^<]*)</a>', 1) AS hrefs,
                  regexp_extract_all(html, '<a\\s[^>]*href="([^"]*)"[^>]*>([^<]*)</a>', 2) AS texts FROM pages),
u AS (SELECT page_id, unnest(hrefs) AS href, trim(unnest(texts)) AS t, unnest(range(len(texts))) AS i FROM l),
f AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY i) - 1 AS pos FROM u WHERE t <> '')
SELECT page_id, CAST(pos AS INTEGER) AS link_pos, t AS crash_join_id, href, 'pages' AS source, '' AS agency, '' AS troop,
       false AS contact_found, 'Found' AS status
FROM f
"""

ORACLE["html_valid"] = f"""
SELECT page_id, NOT regexp_matches(lower({_VISIBLE}), 'not found|no report|no results|invalid|unable to locate') AS valid FROM pages
"""

ORACLE["html_by_id"] = """
SELECT page_id, trim(regexp_extract(html, 'id="report_num"[^>]*>([^<]*)<', 1)) AS crash_join_id, 'pages' AS agency,
       regexp_matches(html, 'id="involved_party"') AS contact_found
FROM pages
"""


def _label(labels: list[str]) -> str:
    parts = []
    for lab in labels:
        parts.append(f"NULLIF(trim(regexp_extract(html, '(?i)<t[hd][^>]*>\\s*{lab}\\s*</t[hd]>\\s*<t[hd][^>]*>([^<]*)<', 1)), '')")
        parts.append(f"NULLIF(trim(regexp_extract(html, '(?i)<dt[^>]*>\\s*{lab}\\s*</dt>\\s*<dd[^>]*>([^<]*)<', 1)), '')")
    return "COALESCE(" + ", ".join(parts) + ", '')"


ORACLE["html_fields"] = f"""
SELECT page_id, url, 'pages' AS source, '' AS agency,
       CASE WHEN {_label(['Troop'])} = '' THEN 'C' ELSE {_label(['Troop'])} END AS troop,
       {_label(['Report Date', 'Date of Crash', 'Crash Date'])} AS report_date,
       {_label(['County'])} AS county,
       {_label(['Location', 'Location of Crash'])} AS location,
       regexp_matches(lower({_ALLTEXT}), 'driver|owner|pedestrian|involved party') AS contact_found
FROM pages
WHERE NOT regexp_matches(lower({_VISIBLE}), 'no records found|no accident report|not found|invalid accident number')
"""

ORACLE["pii_text_summary"] = f"""
WITH {_PII_FINDINGS},
l AS (SELECT source_url, pattern_pos,
             CASE severity WHEN 'CRITICAL' THEN 0 WHEN 'HIGH' THEN 1 WHEN 'MEDIUM' THEN 2 WHEN 'LOW' THEN 3 ELSE 4 END AS r,
             printf('  [%-8s] %s: %d match(es) — e.g. %s', severity, pattern_name, match_count,
                    '[' || array_to_string(list_transform(smp, lambda x: '''' ||
                        CASE WHEN length(x) <= 4 THEN repeat('*', length(x)) ELSE left(x, 1) || repeat('*', length(x) - 2) || right(x, 1) END
                        || ''''), ', ') || ']') AS line
      FROM f)
SELECT source_url, printf('PII Scan — %d finding(s):', count(*)) || chr(10) || string_agg(line, chr(10) ORDER BY r, pattern_pos) AS summary
FROM l GROUP BY source_url
UNION ALL
SELECT DISTINCT source_url, 'No PII patterns detected.' FROM corpus WHERE source_url NOT IN (SELECT source_url FROM l)
"""

ORACLE["wkt_points"] = """
WITH c AS (SELECT c_custkey, CASE WHEN c_custkey % 9 = 0 THEN 'POINT(' ELSE 'POINT (' END
                  || CAST(c_nationkey AS VARCHAR) || ' ' || CAST(c_custkey AS VARCHAR) || ')' AS loc FROM customer)
SELECT c_custkey,
       CASE WHEN regexp_matches(loc, '^POINT \\((-?[0-9.]+) (-?[0-9.]+)\\)$')
            THEN TRY_CAST(regexp_extract(loc, '^POINT \\((-?[0-9.]+) (-?[0-9.]+)\\)$', 1) AS DOUBLE) END AS lon,
       CASE WHEN regexp_matches(loc, '^POINT \\((-?[0-9.]+) (-?[0-9.]+)\\)$')
            THEN TRY_CAST(regexp_extract(loc, '^POINT \\((-?[0-9.]+) (-?[0-9.]+)\\)$', 2) AS DOUBLE) END AS lat
FROM c
"""

ORACLE["calendar_parts"] = """
SELECT event_id, CAST(hour(ts) AS INTEGER) AS crash_hour, CAST(dayofweek(ts) + 1 AS INTEGER) AS crash_day_of_week,
       CAST(month(ts) AS INTEGER) AS crash_month FROM events
"""

# the landed pages and those that the bindings build from orders
_REPORT_PAGES = """WITH all_pages AS (
  SELECT page_id, url, html FROM pages
  UNION ALL
  SELECT 1000000000 + o_orderkey, 'http://built.example.com/p/' || o_orderkey,
         CASE o_orderkey % 5
           WHEN 0 THEN '<table><tr><th>County</th><td>C' || o_custkey || '</td></tr><tr><td>Report Date</td><td> '
                       || CAST(CAST(o_orderdate AS DATE) AS VARCHAR) || '</td></tr></table><p>Driver</p>'
           WHEN 1 THEN '<dl><dt>Location of Crash</dt><dd>' || o_orderpriority || '</dd><dt> troop </dt><dd>T' || (o_custkey % 9) || '</dd></dl>'
           WHEN 3 THEN '<div id="report_num">R' || o_orderkey || '</div><p id="involved_party">Owner</p>'
           WHEN 4 THEN '<p>No records found</p>'
           ELSE '<form></form>' END
  FROM orders)
"""
for _k in ("html_fields", "html_by_id", "html_valid"):
    ORACLE[_k] = _REPORT_PAGES + ORACLE[_k].replace("FROM pages", "FROM all_pages")
ORACLE["html_forms"] = """
SELECT page_id, false AS has_form, 'http://portal.example.com/lookup/search' AS action, '' AS fields, 'report_number' AS id_field, false AS has_token,
       CAST(NULL AS VARCHAR) AS token, '' AS hidden FROM pages
UNION ALL
SELECT 1000000000 + o_orderkey, o_orderkey % 5 = 2, CASE WHEN o_orderkey % 5 = 2 THEN 'http://built.example.com/p/find' ELSE 'http://portal.example.com/lookup/search' END,
       CASE WHEN o_orderkey % 5 <> 2 THEN ''
            WHEN o_orderkey % 2 = 0 THEN 'csrf_token=t&report_number=' || o_orderkey || '&s=' || o_orderstatus
            ELSE 'caseNumber=' || o_orderkey || '&csrf_token=t&s=' || o_orderstatus END,
       CASE WHEN o_orderkey % 5 <> 2 OR o_orderkey % 2 = 0 THEN 'report_number' ELSE 'caseNumber' END,
       o_orderkey % 5 = 2, CASE WHEN o_orderkey % 5 = 2 THEN 't' END, CASE WHEN o_orderkey % 5 = 2 THEN 'csrf_token=t' ELSE '' END
FROM orders
"""

ORACLE["append_insert"] = "SELECT event_id, ts, user_id, event_type, value FROM events"

ORACLE["append_features"] = ORACLE["feature_build"]

ORACLE["scan_csv_first"] = """
SELECT CAST(c_custkey AS VARCHAR) AS crash_record_id, c_name, CAST(c_custkey AS VARCHAR) AS crash_join_id FROM customer ORDER BY c_custkey LIMIT 100
"""

ORACLE["inferred_types"] = """
WITH t AS (SELECT CAST(l_orderkey AS VARCHAR) AS l_orderkey, CAST(l_quantity AS VARCHAR) AS l_quantity, l_returnflag,
                  CASE WHEN l_linenumber > 3 THEN 'true' ELSE 'false' END AS late,
                  CASE WHEN l_linenumber = 1 THEN CAST(l_partkey AS VARCHAR) END AS part_of_first,
                  CASE WHEN l_orderkey % 1000 = 7 THEN 'n/a' ELSE CAST(l_suppkey AS VARCHAR) END AS supplier_text FROM lineitem),
u AS (UNPIVOT t ON l_orderkey, l_quantity, l_returnflag, late, part_of_first, supplier_text INTO NAME "column" VALUE v)
SELECT "column", CASE WHEN bool_and(v IN ('true', 'false')) THEN 'boolean'
                      WHEN bool_and(regexp_full_match(v, '[+-]?[0-9]+') AND TRY_CAST(v AS INTEGER) IS NOT NULL) THEN 'int'
                      WHEN bool_and(regexp_full_match(v, '[+-]?[0-9]+') AND TRY_CAST(v AS BIGINT) IS NOT NULL) THEN 'bigint'
                      WHEN bool_and(TRY_CAST(v AS DOUBLE) IS NOT NULL) THEN 'double' ELSE 'string' END AS type, count(*) AS cells
FROM u WHERE v <> '' GROUP BY 1
"""

ORACLE["geojson_strict"] = """
SELECT 'ev' || CAST(event_id AS VARCHAR) AS id, epoch_us(ts) // 1000 AS "timestamp", CAST(value AS DOUBLE) AS magnitude FROM events
"""

ORACLE["map_report"] = """
SELECT CAST(o_orderkey AS VARCHAR) AS report_id, CAST(o_orderkey AS VARCHAR) AS crash_join_id, 'portal' AS source,
       CASE WHEN o_orderkey % 4 <> 0 THEN 'https://p/' || CAST(o_custkey AS VARCHAR) ELSE '' END AS portal_url,
       CASE WHEN o_orderstatus = 'F' THEN '200' ELSE '' END AS status_code FROM orders
"""

ORACLE["distinct_sources"] = "SELECT DISTINCT source FROM documents"

ORACLE["link_kinds"] = """
SELECT page_id, CASE WHEN page_id % 3 = 0 THEN true WHEN page_id % 3 = 1 THEN false ELSE regexp_matches(url, '^https?://') END AS is_url,
       CASE WHEN page_id % 3 = 0 THEN 'https://docs.google.com/spreadsheets/d/S' || page_id || '/export?format=csv&gid=' || page_id END AS export,
       'a' || page_id || '|b|' || page_id AS items FROM pages
"""

ORACLE["combined_columns"] = """
SELECT dataset, nation, count(*) AS rows, min("key") AS first_key FROM (
  SELECT c_custkey AS "key", c_nationkey AS nation, 'customer' AS dataset FROM customer
  UNION ALL SELECT s_suppkey, s_nationkey, 'supplier' FROM supplier) WHERE nation < 20 GROUP BY 1, 2
"""

ORACLE["range_scan_reports"] = """
SELECT o_orderkey // 100 AS range_no, CAST(o_orderkey AS VARCHAR) AS crash_join_id, round(o_totalprice, 0) AS price FROM orders
WHERE o_orderstatus <> 'P' QUALIFY row_number() OVER (PARTITION BY o_orderkey // 100 ORDER BY o_orderkey) <= 2
"""

ORACLE["multi_profile_text"] = _TYPE + f"""
SELECT 0 AS section, CAST(NULL AS VARCHAR) AS name, 'Multi-City Dataset Quality Report (' || count(*) || ' cities)' || chr(10) AS line FROM r
UNION ALL SELECT 1, NULL, 'City                           Source    Records  Score Issues'
UNION ALL SELECT 2, NULL, repeat('-', 65)
UNION ALL SELECT 3, event_type, rpad(event_type, 30, ' ') || ' ' || rpad(data_source_type, 8, ' ') || ' ' || lpad(format('{{:,}}', total_records), 8, ' ') || ' '
       || lpad({_fmt1('quality_score')}, 5, ' ') || '  ' || lpad(CAST(len(iss) AS VARCHAR), 5, ' ') FROM r
"""
