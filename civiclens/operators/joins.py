"""Entity-matching joins.

Four reference joins have four different key and null rules; each is one
function here.  None of them emits all pairs inside a key group:

* the fuzzy join turns its two-way prefix test into equi-joins on
  (date, prefix) against pre-aggregated sides;
* last-wins / first-wins reductions are ``max_by`` / ``min_by`` aggregates
  (partial aggregation on the map side);
* the interval join turns ranges into positions among the sorted ids and joins on
  blocks of positions, so every key holds equally many ids.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from civiclens.functions.exprs import col, date_part10, normalize_address, strip_ws
from civiclens.plans.scan import order_buckets

KEY_CHAIN = ("crash_join_id", "crash_record_id", "crash_id", "rd")


# ------------------------------------------------------------------ J01 fuzzy

def _truthy_parts_address(parts: Sequence[str]) -> Column:
    """Crash address: parts that are non-null and non-empty, stripped, space-joined."""
    kept = [F.when(col(p).isNotNull() & (col(p).cast("string") != ""), strip_ws(col(p).cast("string"))) for p in parts]
    return F.concat_ws(" ", *kept)


def _prefixes(c: Column) -> Column:
    """All non-empty prefixes of a string as an array (length-bounded by the text)."""
    return F.transform(F.sequence(F.lit(1), F.length(c)), lambda i: F.substring(c, F.lit(1), i))


def fuzzy_join(
    contacts: DataFrame,
    crashes: DataFrame,
    order_cols: Sequence[str | Column],
    contact_date: str = "date",
    contact_address: str = "address",
    crash_id: str = "crash_record_id",
    crash_date: str = "crash_date",
    address_parts: Sequence[str] = ("street_no", "street_direction", "street_name"),
) -> DataFrame:
    """Each contact takes the first crash (in ``order_cols`` order) with the
    same date (first 10 chars) whose normalised address is a prefix of the
    contact's, or has the contact's as a prefix.  Unmatched contacts stay.

    The match depends only on (date, normalised address), so it is computed once
    per distinct left key:

    * right is a prefix of left: cut the left key at every length that a right
      address has and equi-join with the right side reduced to the first row per
      (date, address);
    * left is a prefix of right: cut right addresses at every length that a left key
      has, reduce to the first row per (date, prefix), and look the left key up.

    Each side is first reduced to one row per (date, address); the lengths that occur
    come from the same shuffle, as two scalar subqueries (sets of small numbers), so
    there is no join on the date alone.  Cuts of a right address and the address
    itself are rows of one table, keyed by (date, text) and reduced with a map-side
    phase, so a busy date or a common prefix leaves one row per text; both lookups
    read that table in one join.
    """
    order = F.struct(*[col(c) for c in order_cols])
    right = crashes.select(
        date_part10(crash_date).alias("_d"),
        normalize_address(_truthy_parts_address(address_parts)).alias("_a"),
        F.struct(
            order.alias("o"),
            col(crash_id).alias("id"),
            col(crash_date).alias("date"),
            _truthy_parts_address(address_parts).alias("addr"),
        ).alias("_m"),
    ).filter(F.col("_d").isNotNull() & (F.length("_a") > 0))
    keyed = contacts.withColumn("_d", date_part10(contact_date)).withColumn("_a", normalize_address(contact_address))
    left = keyed.select("_d", "_a").filter(F.col("_d").isNotNull() & (F.length("_a") > 0)).distinct()
    # the filter keeps the value in the lengths' plan too, so that both read one shuffle
    right = right.groupBy("_d", "_a").agg(F.min("_m").alias("_m")).filter(F.col("_m").isNotNull())

    # per text: the first row that has it as its address, and the first that begins with it
    texts = (
        _cuts(right, _lengths(left), "_m")
        .groupBy("_d", "_p")
        .agg(F.min(F.when(F.col("_whole"), F.col("_m"))).alias("_is"), F.min("_m").alias("_begins"))
    )
    # a whole left key may begin a right address, a cut of it may be one
    wanted = _cuts(left, _lengths(right), None)
    found = wanted.join(texts, ["_d", "_p"]).select("_d", "_a", F.when(F.col("_whole"), F.col("_begins")).otherwise(F.col("_is")).alias("_m"))
    best = found.groupBy("_d", "_a").agg(F.min("_m").alias("_m")).filter(F.col("_m").isNotNull())

    out = keyed.join(best, ["_d", "_a"], "left")
    matched = F.col("_m").isNotNull()
    return out.select(
        *[F.col(c) for c in contacts.columns],
        F.col("_m.id").alias("matched_crash_record_id"),
        F.col("_m.date").alias("matched_crash_date"),
        F.col("_m.addr").alias("matched_crash_address"),
        F.when(matched, F.lit("matched")).otherwise(F.lit("unmatched")).alias("match_status"),
    )


def _lengths(keys: DataFrame) -> Column:
    """The lengths of all addresses, as a scalar subquery."""
    return keys.agg(F.sort_array(F.collect_set(F.length("_a")))).scalar()


def _cuts(keys: DataFrame, lengths: Column, value: str | None) -> DataFrame:
    """``_d, _a, _p, _whole`` (and a value): each address whole, and cut at those of
    the lengths that are under its own."""
    n = F.length("_a")
    return (
        keys.withColumn("_L", F.explode(F.array_union(lengths, F.array(n))))
        .where(F.col("_L") <= n)
        .select("_d", "_a", F.substring("_a", F.lit(1), F.col("_L")).alias("_p"), (F.col("_L") == n).alias("_whole"), *([value] if value else []))
    )


# ------------------------------------------------------- P02 / J02 key + merge

def ensure_key(df: DataFrame, key: str = "crash_join_id", chain: Sequence[str] = KEY_CHAIN) -> DataFrame:
    """Schema-level fallback: the first column of ``chain`` present becomes ``key``."""
    if key in df.columns:
        return df
    for c in chain:
        if c in df.columns:
            return df.withColumn(key, F.col(c))
    raise ValueError(f"DataFrame must include one of {list(chain)}")


def merge_suffix(left: DataFrame, right: DataFrame, key: str = "crash_join_id", suffix: str = "_contact") -> DataFrame:
    """Left join on ``key`` after P02 on both sides; NULL keys match NULL keys
    (pandas merge semantics); 1:N multiplies rows; clashing right columns get
    ``suffix``.
    """
    left, right = ensure_key(left, key), ensure_key(right, key)
    clash = set(left.columns) & set(right.columns) - {key}
    r = right.select(*[F.col(c).alias(f"{c}{suffix}" if c in clash else c) for c in right.columns])
    r = r.withColumnRenamed(key, "_rk")
    joined = left.join(r, left[key].eqNullSafe(r["_rk"]), "left")
    return joined.drop("_rk")


# ----------------------------------------------------------- J03 overlay join

def overlay_join(base: DataFrame, overlay: DataFrame, order_cols: Sequence[str | Column], key: str = "crash_join_id") -> DataFrame:
    """The last overlay row per key (NULL key = '') overrides same-named base
    columns, even with empty text; new overlay columns are appended; the base
    row count never changes.
    """
    from civiclens.operators.aggregates import keep_last

    ov = overlay.withColumn(key, F.coalesce(F.col(key).cast("string"), F.lit("")))
    last = keep_last(ov, [key], order_cols)
    rcols = [c for c in last.columns if c != key]
    r = last.select(F.col(key).alias("_k"), F.lit(True).alias("_hit"), *[F.col(c).alias(f"_r_{c}") for c in rcols])
    j = base.join(r, F.coalesce(base[key].cast("string"), F.lit("")) == r["_k"], "left")
    hit = F.col("_hit").isNotNull()
    out = []
    for c in base.columns:
        out.append(F.when(hit, F.col(f"_r_{c}")).otherwise(F.col(c)).alias(c) if c in rcols else F.col(c))
    out += [F.col(f"_r_{c}").alias(c) for c in rcols if c not in base.columns]
    return j.select(*out)


# ------------------------------------------------------------ J04 metadata sync

def sync_metadata(
    base: DataFrame,
    meta: DataFrame,
    order_cols: Sequence[str | Column],
    key: str = "crash_join_id",
    fields: Sequence[str] | None = None,
    overwrite: bool = False,
) -> DataFrame:
    """Fill (or overwrite) base fields from the last metadata row per
    non-empty key.  Empty incoming values are ignored; fields default to the
    sorted metadata columns without the key; new fields are appended.
    """
    from civiclens.operators.aggregates import keep_last

    flds = sorted(c for c in meta.columns if c != key) if fields is None else [f for f in fields if f != key]
    m = meta.filter(F.col(key).isNotNull() & (F.col(key).cast("string") != ""))
    last = keep_last(m, [key], order_cols)
    present = [f for f in flds if f in meta.columns]
    r = last.select(F.col(key).cast("string").alias("_k"), *[F.col(f).cast("string").alias(f"_i_{f}") for f in present])
    j = base.join(r, base[key].cast("string") == r["_k"], "left")

    def synced(f: str) -> Column:
        if f not in present:
            return F.col(f) if f in base.columns else F.lit(None).cast("string")
        inc = F.col(f"_i_{f}")
        cur = F.col(f) if f in base.columns else F.lit(None).cast("string")
        inc_ok = inc.isNotNull() & (inc != "")
        take = inc_ok if overwrite else inc_ok & (cur.isNull() | (cur.cast("string") == ""))
        return F.when(take, inc).otherwise(cur.cast("string") if f in base.columns else cur)

    out = [synced(c).alias(c) if c in flds else F.col(c) for c in base.columns]
    out += [synced(f).alias(f) for f in flds if f not in base.columns]
    return j.select(*out)


# ---------------------------------------------------- J05 / J06 enrichment

def enrich_flag(
    left: DataFrame,
    lookup: DataFrame,
    key: str,
    order_cols: Sequence[str | Column],
    struct_name: str = "contact",
    flag_name: str = "has_contact",
) -> DataFrame:
    """Attach the lookup row (one per key, last wins) as a struct and a found flag.

    The lookup is an aggregate, so counting it up front would run it twice;
    AQE measures its shuffle output and broadcasts it when that is small.
    """
    from civiclens.operators.aggregates import keep_last

    one = keep_last(lookup, [key], order_cols)
    payload = [c for c in one.columns if c != key]
    r = one.select(F.col(key).alias("_k"), F.struct(*payload).alias(struct_name))
    j = left.join(r, left[key] == r["_k"], "left").drop("_k")
    return j.withColumn(flag_name, F.col(struct_name).isNotNull())


def priority_resolve(
    ids: DataFrame,
    sources: Sequence[DataFrame],
    key: str,
    value: str,
    out_col: str = "resolved",
) -> DataFrame:
    """The first source (in the given order) with a truthy value wins.

    Sources are tagged with their position, unioned, empties dropped, and the
    winner per key picked by ``min_by(value, priority)``.
    """
    tagged = None
    for i, s in enumerate(sources):
        t = s.select(F.col(key).alias("_k"), F.col(value).alias("_v"), F.lit(i).alias("_p"))
        tagged = t if tagged is None else tagged.unionByName(t)
    truthy = tagged.filter(F.col("_v").isNotNull() & (F.col("_v").cast("string") != ""))
    best = truthy.groupBy("_k").agg(F.min_by(F.struct("_v", "_p"), F.struct("_p", "_v")).alias("_b"))
    j = ids.join(best, ids[key] == best["_k"], "left")
    return j.select(*[ids[c] for c in ids.columns], F.col("_b._v").alias(out_col), F.col("_b._p").alias("source_rank"))


# ----------------------------------------------------------- J11 / J12 lookups

def lookup_hits(ids: DataFrame, reports: DataFrame, id_col: str, report_key: str, limit: int | None = None) -> DataFrame:
    """Ids that have a report, with the report columns.  ``limit`` (falsy =
    all) keeps the first ``limit`` ids of the list ordered by id."""
    if limit:
        ids = ids.orderBy(id_col).limit(limit)
    return ids.join(reports, ids[id_col] == reports[report_key], "inner")


def lookup_misses(ids: DataFrame, reports: DataFrame, id_col: str, report_key: str) -> DataFrame:
    """Ids without a report (anti join)."""
    return ids.join(reports, ids[id_col] == reports[report_key], "left_anti")


# ----------------------------------------------------- J13 / J14 range scans

BLOCK_BITS = 10  # distinct ids of a block, and blocks of a stretch, as a power of two


def _positions(ids: DataFrame, ranges: DataFrame, id_col: str) -> DataFrame:
    """Distinct ids and range ends on one line, each with how many distinct ids
    (``_i``) and how many rows of ids (``_rows``) lie before it."""
    counted = ids.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("bigint").alias("_v")).agg(F.count(F.lit(1)).alias("_c"))
    no = {c: F.lit(None).cast(ranges.schema[c].dataType).alias(c) for c in ranges.columns}
    points = counted.select("_v", "_c", F.lit(1).alias("_id"), F.lit(None).cast("bigint").alias("_range"), *no.values())
    ends = (
        ranges.where(F.col("end") > F.col("start"))
        .withColumn("_range", F.monotonically_increasing_id())
        .withColumn("_v", F.explode(F.array(F.col("start").cast("bigint"), F.col("end").cast("bigint"))))
        .select("_v", F.lit(0).cast("bigint").alias("_c"), F.lit(0).alias("_id"), "_range", *ranges.columns)
    )
    # an end comes before the id of its value
    line = order_buckets(points.unionByName(ends), ["_v", "_id", "_range"])
    before = Window.partitionBy("_bkt").orderBy("_v", "_id", "_range").rowsBetween(Window.unboundedPreceding, -1)
    line = line.withColumn("_li", F.coalesce(F.sum("_id").over(before), F.lit(0))).withColumn("_lr", F.coalesce(F.sum("_c").over(before), F.lit(0)))
    earlier = Window.orderBy("_bkt").rowsBetween(Window.unboundedPreceding, -1)  # one row per bucket
    carry = (
        line.groupBy("_bkt")
        .agg(F.sum("_id").alias("_n"), F.sum("_c").alias("_m"))
        .select("_bkt", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_ci"), F.coalesce(F.sum("_m").over(earlier), F.lit(0)).alias("_cr"))
    )
    return line.join(carry, "_bkt").select(
        "_v", "_c", "_id", "_range", *ranges.columns, (F.col("_li") + F.col("_ci")).alias("_i"), (F.col("_lr") + F.col("_cr")).alias("_rows")
    )


def _steps(lo: str, hi: str, bits: int) -> Column:
    """The numbers of the stretches of 2^bits positions that [lo, hi) touches."""
    return F.explode(F.sequence(F.shiftright(lo, bits), F.shiftright(F.col(hi) - 1, bits)))


def range_join(ids: DataFrame, ranges: DataFrame, id_col: str = "report_id") -> DataFrame:
    """Interval join ids × [start, end): ``id_col`` and the ranges' columns, one row
    per row of ids in a range; with a ``limit`` column (NULL or 0: all) the smallest
    ``limit`` of them, repeats counted.

    Ids and range ends are put on one line and counted along it, which turns a range
    into the positions [a, b) of its ids among all distinct ids; a limit cuts b to what
    is needed before any id is touched.  Positions are cut into blocks of 1,024, and
    one equi-join on the block gives the pairs.  Blocks hold equally many ids, so dense
    stretches, wide ranges and ranges one over the other are all many equal keys; a
    range's blocks are listed in two steps with a shuffle between, so a range over
    everything is spread too.
    """
    keep = ranges.columns
    limited = "limit" in keep
    line = _positions(ids, ranges, id_col)
    points = line.where("_id = 1").select(F.shiftright("_i", BLOCK_BITS).alias("_block"), "_i", "_v", "_c", "_rows")
    spans = (
        line.where("_id = 0")
        .groupBy("_range")
        .agg(F.min("_i").alias("_a"), F.max("_i").alias("_b"), F.min("_rows").alias("_first"), *[F.first(c).alias(c) for c in keep])
    )
    limit = F.coalesce(F.col("limit").cast("bigint"), F.lit(0)) if limited else F.lit(0).cast("bigint")
    spans = spans.withColumn("_limit", limit).withColumn("_b", F.when(F.col("_limit") > 0, F.least("_b", F.col("_a") + F.col("_limit"))).otherwise(F.col("_b")))
    stretches = spans.where("_b > _a").withColumn("_s", _steps("_a", "_b", 2 * BLOCK_BITS)).repartition("_range", "_s")
    first, last = F.greatest("_a", F.shiftleft("_s", 2 * BLOCK_BITS)), F.least("_b", F.shiftleft(F.col("_s") + 1, 2 * BLOCK_BITS))
    blocks = stretches.withColumn("_lo", first).withColumn("_hi", last).withColumn("_block", _steps("_lo", "_hi", BLOCK_BITS))
    pairs = blocks.join(points, "_block").where((F.col("_i") >= F.col("_a")) & (F.col("_i") < F.col("_b")))
    left = F.when(F.col("_limit") > 0, F.least("_c", F.col("_first") + F.col("_limit") - F.col("_rows"))).otherwise(F.col("_c"))
    # repeats of an id, listed in two steps as well
    copies = pairs.withColumn("_n", left).where("_n > 0").withColumn("_part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.shiftright(F.col("_n") - 1, BLOCK_BITS))))
    size = F.least(F.lit(1 << BLOCK_BITS), F.col("_n") - F.shiftleft("_part", BLOCK_BITS)).cast("int")
    return copies.select(F.explode(F.array_repeat("_v", size)).alias(id_col), *keep)


def multi_range_scan(ids: DataFrame, ranges: DataFrame, id_col: str = "report_id", ordered: bool = True) -> DataFrame:
    """Per range (range_no, start, end, limit) the first ``limit`` ids
    in [start, end) ascending (NULL or 0 limit = all); overlapping ranges repeat
    ids.  Output: range_no, id; ``ordered``: sorted by (range_no, id), which is one
    more exchange.
    """
    out = range_join(ids.select(id_col), ranges.select("range_no", "start", "end", "limit"), id_col).select("range_no", id_col)
    return out.orderBy("range_no", id_col) if ordered else out


def scan_reports(
    lookups: DataFrame, ranges: DataFrame, normalize: Callable[[DataFrame], DataFrame], id_col: str = "report_id"
) -> DataFrame:
    """A range scan with a normalise hook.  ``normalize`` turns landed lookups
    into records (and drops those that found nothing); per range the records of the
    first ``limit`` found ids are returned, a record for each of its id's rows."""
    records = normalize(lookups)
    hits = range_join(records.select(id_col).distinct(), ranges.select("range_no", "start", "end", "limit"), id_col).select("range_no", id_col)
    return hits.join(records, id_col)
