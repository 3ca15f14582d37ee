"""Audits: id-enumeration risk over request logs (A20, A21, G07), PII scan
(G08, G09) and first-seen session signatures (G16).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from civiclens.functions.exprs import digits_as_number, literal_map, next_number, py_fixed, py_round, redact
from civiclens.plans.scan import join_null_safe, order_buckets

# --------------------------------------------------------------------------
# Fixed values (must equal the reference's thresholds, texts and patterns).
HIT_MEDIUM, HIT_HIGH, HIT_CRITICAL, GAP_THRESHOLD = 0.50, 0.75, 0.90, 0.70
SEVERITY_ORDER = ["CRITICAL", "HIGH", "MEDIUM", "LOW", "INFO"]
ENUM_RECOMMENDATION = {
    "CRITICAL": "URGENT: Implement token-based access control. Replace sequential IDs with non-guessable UUIDs. Add authentication for full-record retrieval. Consider rate-limiting and CAPTCHA on the search form.",
    "HIGH": "Replace sequential numeric report IDs with opaque tokens or UUIDs. Add per-IP rate limiting and an audit log for bulk enumeration attempts.",
    "MEDIUM": "Monitor for bulk access patterns. Consider switching to non-sequential IDs and adding rate limiting to the search endpoint.",
    "LOW": "Low enumeration risk detected. Monitor access logs for sequential request patterns and review whether all returned fields are intended for public access.",
    "INFO": "No enumeration vulnerability detected in this sample. Re-test with a larger ID range to confirm.",
}
ENUM_CATEGORY = "Sequential ID Enumeration"
ENUM_DESCRIPTION = "{pct} of probed IDs returned valid records. An attacker can enumerate all crash records by iterating IDs."
PREDICTABLE_CATEGORY = "Predictable ID Pattern"
PREDICTABLE_DESCRIPTION = "{pct} of consecutive IDs differ by 1. Report IDs are strictly sequential and therefore fully predictable."
# PII patterns in the reference's order, with severity and case-insensitivity.
PII_PATTERNS = [
    ("SSN", r"\b(?!000|666|9\d{2})\d{3}[-\s](?!00)\d{2}[-\s](?!0000)\d{4}\b", "CRITICAL", False),
    ("Phone", r"(?:\+?1[-.\s]?)?(?:\(\d{3}\)[-.\s]?|\d{3}[-.\s])\d{3}[-.\s]\d{4}", "HIGH", False),
    ("Email", r"\b[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}\b", "MEDIUM", False),
    ("Date of Birth", r"\b(?:DOB|Date of Birth|Born)[:\s]+\d{1,2}[/\-]\d{1,2}[/\-]\d{2,4}\b", "HIGH", True),
    ("Driver License", r"\b(?:DL|License)[#\s:]+[A-Z0-9]{6,12}\b", "HIGH", True),
    ("License Plate", r"\b[A-Z]{1,3}[-\s]?\d{3,4}[-\s]?[A-Z]{0,3}\b", "MEDIUM", False),
    ("Full Name (labeled)", r"\b(?:Driver|Owner|Name)[:\s]+[A-Z][a-z]+\s[A-Z][a-z]+\b", "MEDIUM", True),
]
NO_PII = "No PII patterns detected."
# Necessary conditions used to skip a pattern cheaply: every match of these
# patterns contains a digit (\d outside optional parts) or an '@'.
NEEDS_DIGIT = {"SSN", "Phone", "Date of Birth", "License Plate"}
NEEDS_AT = {"Email"}
# --------------------------------------------------------------------------


def java_pattern(pattern: str, ignore_case: bool) -> str:
    """Python ``re`` on ``str`` is Unicode-aware (``\\d``, ``\\s``, ``\\b``); Java
    needs the ``U`` flag for the same classes and ``iu`` for case folding."""
    return ("(?iuU)" if ignore_case else "(?U)") + pattern


def _severity_rank(sev: Column) -> Column:
    return F.element_at(literal_map({s: i for i, s in enumerate(SEVERITY_ORDER)}), sev)


def _pct0(x: Column) -> Column:
    """``{:.0%}``."""
    return F.concat(py_fixed(x * 100, 0), F.lit("%"))


# ------------------------------------------------------------ A20 / A21 / G07

def _numbers(digits: str) -> Column:
    """A number's digits as a long up to 18 digits, beyond that as they are."""
    text = F.col(digits)
    short = F.length(text) <= 18
    return F.when(
        text.isNotNull(), F.struct(F.when(short, text.cast("bigint")).alias("small"), F.when(~short, text).alias("big"))
    )


def _neighbours(a: Column, b: Column) -> Column:
    """Whether two numbers of ``_numbers`` differ by 1."""
    text = lambda x: F.coalesce(x["big"], x["small"].cast("string"))
    return F.when(a["small"].isNotNull() & b["small"].isNotNull(), F.abs(a["small"] - b["small"]) == 1).otherwise(
        (text(a) == next_number(text(b))) | (text(b) == next_number(text(a)))
    )


def _sequence_stats(
    log: DataFrame,
    group_cols: Sequence[str],
    pos_col: str,
    id_col: str,
    ok: Column | None,
    bucket_size: int | None,
    first_hits: int = 5,
) -> DataFrame:
    """Per group, in one bucketed pass over the log: probes, hits, numeric ids,
    neighbouring numeric ids with |Δ| = 1, and the first ``first_hits`` hit ids.

    The log's order by (group, position) is cut into measured buckets of about
    equally many rows (``bucket_size``: into fixed stretches of positions instead).
    A bucket leaves one row per group: its counts, its first and last numeric id and
    its first hits.  Neighbours across buckets are the last id of one and the first
    of the next; a hot group stays parallel, and nothing is joined back to the log.
    """
    g = list(group_cols)
    okc = F.coalesce(ok.cast("boolean"), F.lit(False)) if ok is not None else F.lit(False)
    rows = log.select(*g, F.col(pos_col).alias("_pos"), F.col(id_col).cast("string").alias("_id"), okc.alias("_ok"))
    rows = rows.withColumn("_digits", digits_as_number("_id")).withColumn("_num", _numbers("_digits")).drop("_digits")
    if bucket_size is None:
        rows = order_buckets(rows, [*g, "_pos"])
    else:
        rows = rows.withColumn("_bkt", F.floor(F.col("_pos") / F.lit(bucket_size)))
    here = Window.partitionBy(*g, "_bkt").orderBy("_pos")
    before = here.rowsBetween(Window.unboundedPreceding, -1)
    d = rows.withColumn("_prev", F.last("_num", ignorenulls=True).over(before)).withColumn("_rank", F.sum(F.col("_ok").cast("int")).over(here.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    at = F.when(F.col("_num").isNotNull(), F.col("_pos"))
    bucket = d.groupBy(*g, "_bkt").agg(
        F.count(F.lit(1)).alias("_probes"),
        F.sum(F.col("_ok").cast("int")).alias("_hits"),
        F.count("_num").alias("_ids"),
        F.sum((F.col("_num").isNotNull() & F.col("_prev").isNotNull() & _neighbours(F.col("_num"), F.col("_prev"))).cast("int")).alias("_steps"),
        F.min_by("_num", at).alias("_head"),
        F.max_by("_num", at).alias("_tail"),
        F.collect_list(F.when(F.col("_ok") & (F.col("_rank") <= first_hits), F.struct(F.col("_pos"), F.col("_id")))).alias("_some"),
    )
    back = Window.partitionBy(*g).orderBy("_bkt").rowsBetween(Window.unboundedPreceding, -1)
    joint = F.last("_tail", ignorenulls=True).over(back)
    # the first hits lie in the buckets before which fewer hits are known
    early = F.coalesce(F.sum("_hits").over(back), F.lit(0)) < first_hits
    bucket = bucket.withColumn("_joint", joint).withColumn("_some", F.when(early, F.col("_some")).otherwise(F.slice("_some", 1, 0)))
    over = (F.col("_head").isNotNull() & F.col("_joint").isNotNull() & _neighbours(F.col("_head"), F.col("_joint"))).cast("int")
    return bucket.groupBy(*g).agg(
        F.sum("_probes").alias("ids_probed"),
        F.sum("_hits").alias("hits"),
        F.sum("_ids").alias("_n"),
        F.sum(F.col("_steps") + over).alias("_consec"),
        F.slice(F.array_sort(F.flatten(F.collect_list("_some"))), 1, max(1, first_hits)).alias("_first"),
    )


def _gap() -> Column:
    return F.when(F.col("_n") < 2, F.lit(0.0)).otherwise(F.col("_consec") / (F.col("_n") - 1).cast("double"))


def id_gap_rate(
    log: DataFrame,
    group_cols: Sequence[str],
    pos_col: str,
    id_col: str,
    bucket_size: int | None = None,
) -> DataFrame:
    """Per group, share of neighbouring ids (in ``pos`` order, ids
    without digits skipped) whose numeric values differ by exactly 1.
    Fewer than two numeric ids → 0.
    """
    stats = _sequence_stats(log, group_cols, pos_col, id_col, None, bucket_size, first_hits=0)
    return stats.select(*group_cols, F.coalesce(_gap(), F.lit(0.0)).alias("gap_rate"))


def enumeration_severity(hit: Column, gap: Column) -> Column:
    return (
        F.when((hit >= HIT_CRITICAL) & (gap >= GAP_THRESHOLD), F.lit("CRITICAL"))
        .when(hit >= HIT_HIGH, F.lit("HIGH"))
        .when(hit >= HIT_MEDIUM, F.lit("MEDIUM"))
        .when(hit > 0, F.lit("LOW"))
        .otherwise(F.lit("INFO"))
    )


def id_enumeration_report(
    log: DataFrame,
    group_cols: Sequence[str],
    pos_col: str,
    id_col: str,
    ok: Column,
    url_col: str | None = None,
    bucket_size: int | None = None,
) -> DataFrame:
    """Per portal (group) over a landed request log: probes, hit rate, gap
    rate (both Python-rounded to 4), severity, findings and recommendation.
    ``url_col``, when given, must be one of ``group_cols`` (the portal URL).
    """
    if url_col is not None and url_col not in group_cols:
        raise ValueError("url_col must be one of group_cols")
    g = list(group_cols)
    r = _sequence_stats(log, g, pos_col, id_col, ok, bucket_size).withColumn("gap_rate", _gap())
    hit = F.col("hits") / F.col("ids_probed").cast("double")
    gap = F.coalesce(F.col("gap_rate"), F.lit(0.0))
    r = r.withColumn("_hit", hit).withColumn("_gap", gap).withColumn("severity", enumeration_severity(F.col("_hit"), F.col("_gap")))
    ids_repr = F.concat(
        F.lit("["),
        F.array_join(F.transform(F.coalesce(F.col("_first"), F.array()), lambda x: F.concat(F.lit("'"), x["_id"], F.lit("'"))), ", "),
        F.lit("]"),
    )
    evidence = F.concat(F.lit("Valid IDs confirmed: "), ids_repr, F.when(F.col("hits") > 5, F.lit("…")).otherwise(F.lit("")))
    url = F.col(url_col) if url_col else F.lit("")
    f_enum = F.when(
        F.col("_hit") > 0,
        F.struct(
            F.col("severity").alias("severity"),
            F.lit(ENUM_CATEGORY).alias("category"),
            F.concat(_pct0(F.col("_hit")), F.lit(ENUM_DESCRIPTION.split("{pct}")[1])).alias("description"),
            evidence.alias("evidence"),
            url.alias("url"),
        ),
    )
    f_pred = F.when(
        F.col("_gap") >= GAP_THRESHOLD,
        F.struct(
            F.lit("HIGH").alias("severity"),
            F.lit(PREDICTABLE_CATEGORY).alias("category"),
            F.concat(_pct0(F.col("_gap")), F.lit(PREDICTABLE_DESCRIPTION.split("{pct}")[1])).alias("description"),
            F.lit("").alias("evidence"),
            url.alias("url"),
        ),
    )
    return r.select(
        *g,
        "ids_probed",
        "hits",
        py_round("_hit", 4).alias("hit_rate"),
        py_round("_gap", 4).alias("gap_rate"),
        "severity",
        F.filter(F.array(f_enum, f_pred), lambda x: x.isNotNull()).alias("findings"),
        F.element_at(literal_map(ENUM_RECOMMENDATION), F.col("severity")).alias("recommendation"),
    )


# ------------------------------------------------------------------ G08 / G09

def pii_scan(
    texts: DataFrame,
    text_col: str,
    source_col: str,
    redact_samples: bool = True,
    patterns: Sequence[tuple[str, str, str, bool]] = PII_PATTERNS,
) -> DataFrame:
    """Per text and pattern with at least one match: match count, the first
    three distinct matches (redacted unless ``redact_samples`` is False) and the
    severity.  Within a text the order is ``severity_rank``, ``pattern_pos``.
    """
    spec = F.array(
        *[
            F.struct(F.lit(i).alias("pos"), F.lit(name).alias("name"), F.lit(sev).alias("severity"))
            for i, (name, _p, sev, _ic) in enumerate(patterns)
        ]
    )
    # One regexp_extract_all per pattern, all in one projection over the scan;
    # a pattern runs only on texts that can hold a match (a digit, an '@').
    empty = F.array().cast("array<string>")
    has_digit = F.col("_has_digit")
    has_at = F.instr(F.col(text_col), "@") > 0

    def extract(name: str, p: str, ic: bool) -> Column:
        m = F.regexp_extract_all(F.col(text_col), F.lit(java_pattern(p, ic)), 0)
        if name in NEEDS_DIGIT:
            return F.when(has_digit, m).otherwise(empty)
        if name in NEEDS_AT:
            return F.when(has_at, m).otherwise(empty)
        return m

    matches = F.array(*[extract(n, p, ic) for n, p, _s, ic in patterns])
    texts = texts.withColumn("_has_digit", F.coalesce(F.col(text_col).rlike(r"(?U)\d"), F.lit(False)))
    per = texts.select(
        F.col(source_col).alias("source_url"),
        F.posexplode(F.arrays_zip(spec.alias("p"), matches.alias("m"))).alias("_i", "_z"),
    )
    per = per.select(
        "source_url",
        F.col("_z.p.pos").alias("pattern_pos"),
        F.col("_z.p.name").alias("pattern_name"),
        F.col("_z.p.severity").alias("severity"),
        F.col("_z.m").alias("_m"),
    ).filter(F.size("_m") > 0)
    samples = F.slice(F.array_distinct("_m"), 1, 3)
    if redact_samples:
        samples = F.transform(samples, lambda x: redact(x))
    out = per.select(
        "source_url",
        "pattern_name",
        "severity",
        F.size("_m").alias("match_count"),
        samples.alias("sample_matches"),
        "pattern_pos",
    )
    return out.withColumn("severity_rank", _severity_rank(F.col("severity")))


def pii_summary(findings: DataFrame) -> DataFrame:
    """Corpus summary per pattern: texts with a finding, total matches, and
    the summary line."""
    agg = findings.groupBy("pattern_name", "severity").agg(
        F.count(F.lit(1)).alias("texts_with_matches"), F.sum("match_count").alias("total_matches")
    )
    line = F.format_string("  [%-8s] %s: %d match(es) in %d text(s)", "severity", "pattern_name", "total_matches", "texts_with_matches")
    return agg.withColumn("line", line)


def pii_text_summary(findings: DataFrame, sources: DataFrame | None = None, source_col: str = "source_url") -> DataFrame:
    """G09 per text: the reference's multi-line summary of one scan.  ``sources``: the
    texts that were scanned; those without a finding get the line that says so."""
    w_rows = F.array_sort(
        F.collect_list(
            F.struct(
                _severity_rank(F.col("severity")).alias("r"),
                F.col("pattern_pos").alias("p"),
                F.format_string(
                    "  [%-8s] %s: %d match(es) — e.g. %s",
                    "severity",
                    "pattern_name",
                    "match_count",
                    F.concat(F.lit("["), F.array_join(F.transform("sample_matches", lambda x: F.concat(F.lit("'"), x, F.lit("'"))), ", "), F.lit("]")),
                ).alias("line"),
            )
        )
    )
    per = findings.groupBy("source_url").agg(w_rows.alias("_l"))
    per = per.select(
        "source_url",
        F.concat(
            F.format_string("PII Scan — %d finding(s):\n", F.size("_l")),
            F.array_join(F.transform("_l", lambda x: x["line"]), "\n"),
        ).alias("summary"),
    )
    if sources is None:
        return per
    every = sources.select(F.col(source_col).alias("source_url")).distinct()
    return join_null_safe(every, per, ["source_url"]).withColumn("summary", F.coalesce("summary", F.lit(NO_PII)))


# ------------------------------------------------------------------ G16

HASHES = ((2_147_483_647, 1_000_003), (2_147_483_629, 998_244_353), (2_147_483_587, 754_974_721))  # a prime and a base each


def _piece_hash(names: str, prime: int, base: int) -> Column:
    """The polynomial hash ``h`` of a list of names, and ``w``, the base to the power
    of its length; both modulo the prime."""
    zero = F.struct(F.lit(0).cast("bigint").alias("h"), F.lit(1).cast("bigint").alias("w"))
    code = lambda x: F.pmod(F.xxhash64(x), F.lit(prime))
    step = lambda a, x: F.struct(((a["h"] * F.lit(base) + code(x)) % F.lit(prime)).alias("h"), (a["w"] * F.lit(base) % F.lit(prime)).alias("w"))
    return F.aggregate(names, zero, step)


def _joined_hash(pieces: str, field: str, prime: int) -> Column:
    """The hash of pieces one after the other."""
    return F.aggregate(pieces, F.lit(0).cast("bigint"), lambda a, x: (a * x[field]["w"] + x[field]["h"]) % F.lit(prime))


def sequence_signature(
    events: DataFrame,
    session_cols: Sequence[str],
    order_cols: Sequence[str],
    name_col: str,
    watch: Sequence[str],
    session_order: Sequence[str] | None = None,
    bucket: Column | None = None,
) -> DataFrame:
    """signature = event names of a session joined with '-' in event order;
    a session is flagged when any name is in ``watch``; only the first flagged
    session (in ``session_order``) per signature is kept.

    The order of all events is cut into measured buckets (or by ``bucket``, which must
    not fall in the event order), so a long session is many pieces.  A piece leaves its
    length and a polynomial hash of its names, with the power of the base that its
    length stands for: hashes of neighbouring pieces join into that of both, whatever
    the cuts.  Sessions are compared by (length, hashes) alone, three numbers modulo
    primes near 2^31; no text is a shuffle key, and texts are put together only for
    the sessions that are kept.
    """
    s = list(session_cols)
    so = list(session_order or s)
    names = events.select(*dict.fromkeys([*s, *so, *order_cols]), F.coalesce(F.col(name_col), F.lit("")).alias("_name"), bucket.alias("_b") if bucket is not None else F.lit(0).alias("_b"))
    if bucket is None:
        names = order_buckets(names.drop("_b"), [*s, *order_cols], "_b")
    ordered = F.transform(F.array_sort(F.collect_list(F.struct(*[F.col(c) for c in order_cols], F.col("_name")))), lambda x: x["_name"])
    pieces = names.groupBy(*s, "_b").agg(ordered.alias("_names"), F.max(F.col("_name").isin(list(watch)).cast("int")).alias("_flag"))
    hashed = [_piece_hash("_names", prime, base).alias(f"_p{i}") for i, (prime, base) in enumerate(HASHES)]
    marks = pieces.select(*s, "_b", "_flag", F.size("_names").cast("bigint").alias("_n"), *hashed)
    line = F.array_sort(F.collect_list(F.struct("_b", *[f"_p{i}" for i in range(len(HASHES))])))
    sessions = marks.groupBy(*s).agg(line.alias("_line"), F.sum("_n").alias("n_events"), F.max("_flag").alias("_flag"))
    joined = [_joined_hash("_line", f"_p{i}", prime).alias(f"_h{i}") for i, (prime, _) in enumerate(HASHES)]
    flagged = sessions.filter(F.col("_flag") == 1).select(*s, "n_events", *joined)
    kept = flagged.groupBy("n_events", *[f"_h{i}" for i in range(len(HASHES))]).agg(
        F.min(F.struct(*[F.col(c) for c in so], *[F.col(c).alias(f"_s_{c}") for c in s])).alias("_m")
    )
    kept = kept.select(*[F.col(f"_m._s_{c}").alias(c) for c in s], "n_events")
    # the texts of the sessions kept
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_b", "_piece"))), lambda x: x["_piece"]), "-")
    parts = join_null_safe(pieces.select(*s, "_b", F.array_join("_names", "-").alias("_piece")), kept, s, "inner")
    return parts.groupBy(*s, "n_events").agg(text.alias("signature")).select("signature", *s, "n_events")
