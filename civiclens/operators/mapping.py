"""Row mappings onto the shared crash key (P01-P10, R16): projections only,
so they fuse into the scan's whole-stage codegen.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from civiclens.functions.exprs import digits_only, first_truthy, join_address, key_text, strip_ws, to_double


def normalize_records(
    df: DataFrame,
    key: str = "crash_join_id",
    fallback: str = "crash_record_id",
    date_col: str = "crash_date",
    address_parts: Sequence[str] = ("street_no", "street_direction", "street_name"),
    status: str = "normalized",
) -> DataFrame:
    """key = key or fallback (empty counts as missing), date, address, constant status."""
    cols = set(df.columns)

    def c(name: str):
        return F.col(name).cast("string") if name in cols else F.lit(None).cast("string")

    return df.select(
        first_truthy(c(key), c(fallback)).alias("crash_join_id"),
        c(date_col).alias("crash_date"),
        join_address(*[c(p) for p in address_parts], empty_as_null=True, keep_blank=True).alias("address"),
        F.lit(status).alias("status"),
    )


def map_trim_key(df: DataFrame, source_key: str, key: str = "crash_join_id") -> DataFrame:
    """All columns plus ``key`` = trimmed text of ``source_key`` (NULL → '')."""
    return df.withColumn(key, F.coalesce(key_text(source_key), F.lit("")))


def map_coalesce_key(df: DataFrame, primary: str, secondary: str, source: str, key: str = "crash_join_id") -> DataFrame:
    """key = trimmed primary, else secondary; NULL → ''; constant source tag."""
    k = F.coalesce(F.col(primary).cast("string"), F.col(secondary).cast("string"))
    return df.withColumn(key, F.coalesce(key_text(k), F.lit(""))).withColumn("source", F.lit(source))


def map_points(df: DataFrame, lat: str = "latitude", lon: str = "longitude") -> DataFrame:
    """Two columns, drop NULLs, coerce to numbers, drop unparsable."""
    pts = df.select(F.col(lat).alias("latitude"), F.col(lon).alias("longitude")).dropna()
    pts = pts.select(to_double("latitude").alias("latitude"), to_double("longitude").alias("longitude"))
    return pts.dropna()


def drop_corrupt(lines: DataFrame, text_col: str, schema: str) -> DataFrame:
    """Keep the rows that are JSON objects (``isinstance(row, dict)``) and
    parse them with ``schema``; arrays, scalars and broken text are dropped.

    ``json_object_keys`` is NULL exactly for text that is not a JSON object.
    Working on the text lines avoids the reader's corrupt-record column, which
    Spark refuses to query alone (a bare ``count()`` would fail).
    """
    objs = lines.filter(F.json_object_keys(F.col(text_col)).isNotNull())
    return objs.select(F.from_json(F.col(text_col), schema).alias("_r")).select("_r.*")


def clean_ids(df: DataFrame, id_col: str) -> DataFrame:
    """P10: strip ids and drop the empty ones."""
    return df.withColumn(id_col, strip_ws(F.col(id_col).cast("string"))).filter(F.col(id_col) != "")


def clean_phones(df: DataFrame) -> DataFrame:
    """Every column whose name contains ``phone``: digits only, '' → NULL.

    Phones stay text, so digit-only values never pass through a float column.
    """
    return df.select(*[digits_only(c).alias(c) if "phone" in c.lower() else F.col(c) for c in df.columns])


def map_report(df: DataFrame, id_col: str, url_col: str, status_col: str, source: str) -> DataFrame:
    """Successful lookups as five text columns."""
    return df.select(
        F.col(id_col).cast("string").alias("report_id"),
        F.col(id_col).cast("string").alias("crash_join_id"),
        F.lit(source).alias("source"),
        F.coalesce(F.col(url_col).cast("string"), F.lit("")).alias("portal_url"),
        F.coalesce(F.col(status_col).cast("string"), F.lit("")).alias("status_code"),
    )


def distinct_values(df: DataFrame, col_name: str) -> DataFrame:
    """The distinct values of a column (e.g. the registered sources)."""
    return df.select(col_name).distinct()
