"""Scalar column expressions shared by the operators.

Every function takes and returns ``Column`` objects so that it stays inside
Catalyst (constant folding, codegen).  ANSI mode is assumed to be on, so all
coercions go through ``try_cast`` / ``try_to_timestamp`` and never raise.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnOrName = Column | str


def col(c: ColumnOrName) -> Column:
    return F.col(c) if isinstance(c, str) else c


# ---------------------------------------------------------------- text helpers

# The characters Python's ``str.strip()`` removes (``str.isspace``), derived by
# rule rather than listed: ASCII controls, NBSP, the Unicode space separators.
PY_WHITESPACE = "".join(chr(i) for i in range(0x3001) if chr(i).isspace())


def strip_ws(c: ColumnOrName) -> Column:
    """Remove leading and trailing whitespace exactly as ``str.strip()`` does."""
    return F.btrim(col(c), F.lit(PY_WHITESPACE))


def empty_to_null(c: ColumnOrName) -> Column:
    """'' → NULL."""
    return F.nullif(col(c), F.lit(""))


def first_truthy(*cols: ColumnOrName) -> Column:
    """First value that is neither NULL nor ''."""
    return F.coalesce(*[empty_to_null(col(c)) for c in cols])


def key_text(c: ColumnOrName) -> Column:
    """Trimmed text of a key; NULL stays NULL."""
    return strip_ws(col(c).cast("string"))


def normalize_address(c: ColumnOrName) -> Column:
    """Lower, strip, keep only ``[a-z0-9 ]``; NULL or '' → ''."""
    lowered = strip_ws(F.lower(F.coalesce(col(c).cast("string"), F.lit(""))))
    return F.regexp_replace(lowered, "[^a-z0-9 ]", "")


def join_address(*parts: ColumnOrName, empty_as_null: bool = False, drop_nan: bool = False, keep_blank: bool = False) -> Column:
    """Truthy parts, stripped, joined with one space.

    ``empty_as_null`` gives NULL instead of '' when no part survives;
    ``drop_nan`` also drops parts spelled ``nan`` (any case); ``keep_blank`` keeps
    the empty slot of a part that holds only white space.
    """
    cleaned = []
    for p in parts:
        t = strip_ws(col(p).cast("string"))
        t = F.when(col(p).cast("string") != "", t) if keep_blank else F.nullif(t, F.lit(""))
        if drop_nan:
            t = F.when(F.lower(t) == "nan", F.lit(None)).otherwise(t)
        cleaned.append(t)
    joined = F.concat_ws(" ", *cleaned)
    return empty_to_null(joined) if empty_as_null else joined


def date_part10(c: ColumnOrName) -> Column:
    """First 10 characters of the stripped text; NULL/'' → NULL."""
    return empty_to_null(F.substring(strip_ws(col(c).cast("string")), 1, 10))


def two_way_prefix(a: ColumnOrName, b: ColumnOrName) -> Column:
    """Non-empty and one is a prefix of the other."""
    a, b = col(a), col(b)
    return (F.length(a) > 0) & (F.length(b) > 0) & (F.startswith(a, b) | F.startswith(b, a))


def digits_only(c: ColumnOrName) -> Column:
    """Strip non-digits; '' → NULL."""
    return empty_to_null(F.regexp_replace(col(c).cast("string"), r"(?U)\D", ""))


# Every decimal digit of Unicode and its ASCII digit, by rule.
_DIGITS = [chr(i) for i in range(0x110000) if unicodedata.category(chr(i)) == "Nd"]
_ASCII_DIGITS = "".join(str(unicodedata.decimal(d)) for d in _DIGITS)


def digits_as_number(c: ColumnOrName) -> Column:
    """X05 as an integer of any length: its decimal text without leading zeros."""
    text = col(c).cast("string")
    plain = F.octet_length(text) == F.length(text)  # ASCII alone needs no look at other scripts' digits
    digits = F.when(plain, empty_to_null(F.regexp_replace(text, "[^0-9]", ""))).otherwise(
        F.translate(digits_only(text), "".join(_DIGITS), _ASCII_DIGITS)
    )
    return F.regexp_replace(digits, r"^0+(?=.)", "")


def next_number(c: ColumnOrName) -> Column:
    """The decimal text of a number text plus one: the digit before the trailing
    nines goes up, the nines become zeros."""
    c = col(c)
    nines = F.length(F.regexp_extract(c, "(9*)$", 1))
    head = F.substring(c, F.lit(1), F.length(c) - nines)
    last = (F.right(head, F.lit(1)).try_cast("int") + 1).cast("string")
    raised = F.when(F.length(head) == 0, F.lit("1")).otherwise(
        F.concat(F.substring(head, F.lit(1), F.length(head) - 1), last)
    )
    return F.concat(raised, F.repeat(F.lit("0"), nines))


def to_double(c: ColumnOrName) -> Column:
    """Coerce to double, bad → NULL (numbers cast directly, text parsed)."""
    return col(c).try_cast("double")


def safe_float(c: ColumnOrName) -> Column:
    """Coerce to double, NULL or bad → 0."""
    return F.coalesce(to_double(c), F.lit(0.0))


def clamp(c: ColumnOrName, lo: float, hi: float) -> Column:
    """X08."""
    return F.greatest(F.lit(lo), F.least(F.lit(hi), col(c)))


def floor_block(n: ColumnOrName, size: int) -> Column:
    """X11: floor to a multiple of ``size`` (negatives floor too); exact for integers."""
    n = col(n).cast("bigint")
    return n - F.pmod(n, F.lit(size).cast("bigint"))


def parse_ts(c: ColumnOrName) -> Column:
    """Timestamp from text or timestamp; unparsable → NULL."""
    return F.coalesce(
        col(c).cast("string").try_cast("timestamp"),
        F.try_to_timestamp(col(c).cast("string")),
    )


def hour_or_default(ts: ColumnOrName, default: int = -1) -> Column:
    """X13."""
    return F.coalesce(F.hour(col(ts)), F.lit(default))


def night_flag(hour: ColumnOrName) -> Column:
    """1 when hour is known and (< 6 or > 20)."""
    h = col(hour)
    return F.when((h != -1) & ((h < 6) | (h > 20)), F.lit(1)).otherwise(F.lit(0))


def missing_flag(*cols: ColumnOrName) -> Column:
    """1 when any of the columns is NULL."""
    cond = F.lit(False)
    for c in cols:
        cond = cond | col(c).isNull()
    return cond.cast("int")


def days_between(start: ColumnOrName, end: ColumnOrName) -> Column:
    """Fractional days ``end - start``."""
    return (F.unix_micros(col(end).cast("timestamp")) - F.unix_micros(col(start).cast("timestamp"))) / F.lit(86400e6)


def upper_trim_default(c: ColumnOrName, default: str = "UNKNOWN") -> Column:
    """NULL → default, then upper and strip."""
    return strip_ws(F.upper(F.coalesce(col(c).cast("string"), F.lit(default))))


def not_in_ci(c: ColumnOrName, values: Iterable[str]) -> Column:
    """Upper-cased, stripped value not in the list (NULL counts as '')."""
    v = strip_ws(F.upper(F.coalesce(col(c).cast("string"), F.lit(""))))
    return ~v.isin([x.upper() for x in values])


def redact(c: ColumnOrName) -> Column:
    """Length ≤ 4 → all stars; else first char, stars, last char."""
    c = col(c)
    n = F.length(c)
    return F.when(n <= 4, F.repeat(F.lit("*"), n)).otherwise(
        F.concat(F.substring(c, 1, 1), F.repeat(F.lit("*"), n - 2), F.substring(c, -1, 1))
    )


def marker_search(c: ColumnOrName, markers: Iterable[str]) -> Column:
    """Any marker (literal text) occurs, case-insensitive."""
    import re

    pattern = "|".join(re.escape(m.lower()) for m in markers)
    return F.lower(col(c)).rlike(pattern)


def literal_map(mapping: Mapping[str, object]) -> Column:
    """Literal map column."""
    items = []
    for k, v in mapping.items():
        items.extend([F.lit(k), F.lit(v)])
    return F.create_map(*items)


def rank_of(c: ColumnOrName, ranks: Mapping[str, int], default: int = 0) -> Column:
    """Dictionary lookup with default on the upper-cased, stripped value."""
    key = strip_ws(F.upper(F.coalesce(col(c).cast("string"), F.lit(""))))
    return F.coalesce(F.element_at(literal_map(ranks), key), F.lit(default))


def comma_list(c: ColumnOrName) -> Column:
    """Split on commas, strip, drop empties."""
    parts = F.transform(F.split(col(c), ","), lambda x: strip_ws(x))
    return F.filter(parts, lambda x: x != "")


def is_url(c: ColumnOrName) -> Column:
    """X25."""
    return F.coalesce(col(c).rlike("^https?://"), F.lit(False))


def sheet_csv_url(c: ColumnOrName) -> Column:
    """Spreadsheet link → CSV export link; NULL when the link is not a sheet.

    The host must be the sheets host, the path ``/spreadsheets/d/<id>/...``;
    ``gid`` comes from the query string, else from ``#gid=`` in the fragment.
    """
    u = col(c)
    host = F.parse_url(u, F.lit("HOST"))
    path = F.coalesce(F.parse_url(u, F.lit("PATH")), F.lit(""))
    parts = F.split(path, "/")
    sheet_id = F.element_at(parts, 4)
    ok = (host == "docs.google.com") & (F.element_at(parts, 2) == "spreadsheets") & \
        (F.element_at(parts, 3) == "d") & (F.coalesce(sheet_id, F.lit("")) != "")
    gid_query = empty_to_null(F.regexp_extract(F.coalesce(F.parse_url(u, F.lit("QUERY")), F.lit("")), r"(?:^|&)gid=([^&]*)", 1))
    gid_frag = empty_to_null(F.regexp_extract(F.coalesce(F.parse_url(u, F.lit("REF")), F.lit("")), r"gid=([^&]*)", 1))
    gid = F.coalesce(gid_query, gid_frag)
    base = F.concat(F.lit("https://docs.google.com/spreadsheets/d/"), sheet_id, F.lit("/export?format=csv"))
    return F.when(ok, F.when(gid.isNotNull(), F.concat(base, F.lit("&gid="), gid)).otherwise(base))


def wkt_point(c: ColumnOrName) -> Column:
    """``POINT (x y)`` → struct(lon, lat); other text → NULL."""
    pat = r"^POINT \((-?[0-9.]+) (-?[0-9.]+)\)$"
    ok = col(c).rlike(pat)
    return F.when(
        ok,
        F.struct(
            F.regexp_extract(col(c), pat, 1).try_cast("double").alias("lon"),
            F.regexp_extract(col(c), pat, 2).try_cast("double").alias("lat"),
        ),
    )


def calendar_parts(ts: ColumnOrName) -> list[Column]:
    """Hour, day of week (Sunday = 1), month."""
    t = col(ts)
    return [F.hour(t).alias("crash_hour"), F.dayofweek(t).alias("crash_day_of_week"), F.month(t).alias("crash_month")]


def percent_text(c: ColumnOrName, decimals: int = 1) -> Column:
    """X23 ``{:.1%}`` (Python rounding of the exact value)."""
    return F.concat(py_fixed(col(c) * 100, decimals), F.lit("%"))


def py_fixed(c: ColumnOrName, decimals: int) -> Column:
    """Python ``f"{x:.Nf}"``: half-even on the exact binary value.

    ``format_number`` formats with ``DecimalFormat`` (HALF_EVEN on the exact
    double), which is what Python does; the grouping commas are removed.
    """
    return F.regexp_replace(F.format_number(col(c), decimals), ",", "")


def py_round(c: ColumnOrName, decimals: int) -> Column:
    """Python ``round(x, N)`` for doubles (exact binary value, half-even).

    ``bround`` rounds the shortest decimal text of the double instead, which
    differs on values such as 0.35 (binary 0.34999…).  For N = 0 both agree.
    """
    if decimals == 0:
        return F.bround(col(c), 0)
    return py_fixed(c, decimals).cast("double")
