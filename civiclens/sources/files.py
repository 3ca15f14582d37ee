"""File sources (R01-R06, R16-R26): landed CSV / JSON / GeoJSON documents.

All readers go through ``spark.read`` with a declared schema or all-string
columns, so the scan is split by Spark and column pruning reaches the files.
JSON documents are read one per line (JSON Lines) unless ``multi_line`` is
set for pretty-printed single documents.
"""

from __future__ import annotations

import csv
import io
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StringType, StructField, StructType

from civiclens.functions.exprs import col, comma_list, empty_to_null, strip_ws


# ------------------------------------------------------------------ CSV

def read_csv_strings(spark: SparkSession, path: str | list[str], header: bool = True) -> DataFrame:
    """Header CSV with every column as text (no inference)."""
    return spark.read.option("header", header).option("inferSchema", False).option("mode", "PERMISSIVE").csv(path)


#: what a cell of each type looks like, from the narrowest type to the widest
CELL_PATTERNS = {
    "boolean": "^(?:true|false|True|False|TRUE|FALSE)$",
    "int": "^[+-]?[0-9]+$",
    "bigint": "^[+-]?[0-9]+$",
    "double": r"^[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?$",
}


def infer_types(df: DataFrame) -> DataFrame:
    """``column, type, cells`` of a table of texts: the narrowest of boolean,
    int, bigint, double and string that takes all non-empty cells of the column (string if
    there are none).  Each cell's types are flags, a column's are those that all its
    cells share: one aggregate over all rows, the same however they are partitioned.
    """
    folds = []
    for c in df.columns:
        text = strip_ws(F.col(f"`{c}`"))
        full = text != ""
        fits = {t: text.rlike(p) & text.try_cast(t).isNotNull() for t, p in CELL_PATTERNS.items()}
        takes = lambda t: F.min(F.when(full, fits[t]).otherwise(F.lit(None)))  # noqa: B023, E731
        kind = F.coalesce(*[F.when(takes(t), F.lit(t)) for t in CELL_PATTERNS], F.lit("string"))
        folds.append(F.struct(F.lit(c).alias("column"), kind.alias("type"), F.count(F.when(full, 1)).alias("cells")))
    return df.agg(F.array(*folds).alias("t")).select(F.inline("t"))


def typed(df: DataFrame) -> DataFrame:
    """A table of texts with the inferred types (one row per column reaches the
    driver); empty cells of a column with another type are NULL."""
    kinds = {r["column"]: r["type"] for r in infer_types(df).collect()}
    return df.select(*[F.col(f"`{c}`") if kinds[c] == "string" else strip_ws(F.col(f"`{c}`")).try_cast(kinds[c]).alias(c) for c in df.columns])


def read_csv_inferred(spark: SparkSession, path: str) -> DataFrame:
    """An uploaded CSV with inferred types (one extra pass over the file)."""
    return typed(read_csv_strings(spark, path))


def scan_csv_limit(
    spark: SparkSession, path: str, limit: int | None = None, id_col: str = "crash_record_id", key: str = "crash_join_id"
) -> DataFrame:
    """All-string CSV rows plus ``key`` = ``id_col`` ('' when the column is
    missing); ``limit`` 0 or None reads everything (O04), otherwise the first rows in
    the order of files and of lines in them."""
    df = read_csv_strings(spark, path)
    if limit:
        df = first_rows(df, limit, lambda files: read_csv_strings(spark, files))
    return df.withColumn(key, F.coalesce(F.col(id_col), F.lit("")) if id_col in df.columns else F.lit(""))


def first_rows(df: DataFrame, limit: int, read: Callable[[list[str]], DataFrame]) -> DataFrame:
    """The first ``limit`` rows of a file table in the order of file names, of
    blocks in a file and of rows in a block.  ``read`` gives the rows of some of its
    files: the first files are taken, twice as many each time, until they hold enough
    rows; later ones are never opened."""
    files = sorted(df.inputFiles())
    n = 1
    while n < len(files) and read(files[:n]).limit(limit).count() < limit:
        n = min(len(files), 2 * n)
    some = read(files[:n]) if files else df
    line = some.select("*", F.col("_metadata.file_path").alias("_f"), F.col("_metadata.file_block_start").alias("_s"), F.monotonically_increasing_id().alias("_l"))
    return line.orderBy("_f", "_s", "_l").limit(limit).drop("_f", "_s", "_l")


# ------------------------------------------------------------------ JSON

def read_json(spark: SparkSession, path: str, schema: StructType | str | None = None, multi_line: bool = False) -> DataFrame:
    r = spark.read.option("multiLine", multi_line).option("mode", "PERMISSIVE")
    if schema is not None:
        r = r.schema(schema)
    return r.json(path)


def scan_newest_k(df: DataFrame, k: int, order_col: str, key_col: str) -> DataFrame:
    """Newest ``k`` rows by ``order_col`` (ties by key): a top-k report,
    planned as TakeOrderedAndProject (a per-partition top-k, then a merge)."""
    return df.orderBy(F.desc(order_col), F.asc(key_col)).limit(k)


def json_objects(raw: Column, element_schema: StructType | str) -> Column:
    """Elements of a raw JSON array that are objects, parsed with ``element_schema``
    (P09: numbers, strings and nulls inside the array are dropped)."""
    elems = F.from_json(raw, ArrayType(StringType()))
    objs = F.filter(elems, lambda e: F.json_object_keys(e).isNotNull())
    return F.transform(objs, lambda e: F.from_json(e, element_schema))


def arcgis_explode(docs: DataFrame, doc_col: str, attributes_schema: StructType | str) -> DataFrame:
    """``features[].attributes`` of feature-layer documents, one row per
    object feature; attribute fields become columns."""
    feats = json_objects(F.get_json_object(F.col(doc_col), "$.features"), f"attributes struct<{_ddl(attributes_schema)}>")
    exploded = docs.select(F.explode(feats).alias("f")).filter(F.col("f.attributes").isNotNull())
    return exploded.select("f.attributes.*")


def _ddl(schema: StructType | str) -> str:
    if isinstance(schema, str):
        return schema
    return ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schema.fields)


# ------------------------------------------------------------------ GeoJSON

GEOJSON_SCHEMA = StructType(
    [
        StructField(
            "features",
            ArrayType(
                StructType(
                    [
                        StructField("id", StringType()),
                        StructField("properties", StructType([StructField("time", LongType()), StructField("mag", DoubleType())])),
                        StructField("geometry", StructType([StructField("coordinates", ArrayType(DoubleType()))])),
                    ]
                )
            ),
        )
    ]
)


def geojson_explode(collections: DataFrame, strict: bool = False) -> DataFrame:
    """One record per feature: id, timestamp (epoch ms), location, magnitude;
    missing parts give NULL.  ``strict`` (R04) fails the job on a feature without id."""
    f = collections.select(F.explode("features").alias("f"))
    fid = F.col("f.id")
    if strict:
        fid = F.when(fid.isNull(), F.raise_error(F.lit("feature without id"))).otherwise(fid)
    return f.select(
        fid.alias("id"),
        F.col("f.properties.time").alias("timestamp"),
        F.col("f.geometry.coordinates").alias("location"),
        F.col("f.properties.mag").alias("magnitude"),
    )


def read_geojson(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    return read_json(spark, path, GEOJSON_SCHEMA, multi_line)


# ------------------------------------------------------------------ nested ids

def nested_case_ids(docs: DataFrame, doc_col: str, key_cols: Sequence[str] = ()) -> DataFrame:
    """Case ids from ``{"Results": [...]}`` payloads whose list holds objects
    or wraps them as its first element.  id = CaseNumber, or StateCase when
    CaseNumber is missing/empty; trimmed; empty ids dropped; order kept (pos)."""
    v = F.try_parse_json(F.col(doc_col))
    results = F.try_variant_get(v, "$.Results", "array<variant>")
    first = F.try_variant_get(v, "$.Results[0]", "variant")
    kind = F.schema_of_variant(first)
    rows = (
        F.when(kind.startswith("ARRAY"), F.try_variant_get(first, "$", "array<variant>"))
        .when(kind.startswith("OBJECT"), results)
        .otherwise(F.array().cast("array<variant>"))
    )
    objs = F.filter(rows, lambda x: F.schema_of_variant(x).startswith("OBJECT"))
    out = docs.select(*key_cols, F.posexplode(objs).alias("pos", "_row"))
    cn = F.try_variant_get(F.col("_row"), "$.CaseNumber", "string")
    sc = F.try_variant_get(F.col("_row"), "$.StateCase", "string")
    raw = F.when(cn.isNull() | (cn == ""), sc).otherwise(cn)
    return out.select(*key_cols, "pos", empty_to_null(strip_ws(raw)).alias("case_id")).filter(F.col("case_id").isNotNull())


# ------------------------------------------------------------------ CSV text

def csv_from_text(docs: DataFrame, text_col: str, columns: Sequence[str], key_cols: Sequence[str] = ()) -> DataFrame:
    """One CSV document per row, read as ``csv.DictReader`` does: each
    document's own first record names its columns, quoted fields may span lines,
    blank lines are skipped.  Returns the keys, the record number and ``columns`` as
    text; a column that a document lacks, or a short record's, is NULL.
    """
    keys, wanted = list(key_cols), list(columns)
    kinds = dict(docs.select(*keys).dtypes)
    schema = ", ".join([f"`{k}` {kinds[k]}" for k in keys] + ["line_no int"] + [f"`{c}` string" for c in wanted])

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for row in f.itertuples(index=False, name=None):
                records = csv.DictReader(io.StringIO(row[-1] or "", newline=""))
                for n, r in enumerate(records, 1):
                    out.append((*row[:-1], n, *[r.get(c) for c in wanted]))
            yield pd.DataFrame(out, columns=[*keys, "line_no", *wanted])

    return docs.select(*keys, F.col(text_col).alias("_text")).mapInPandas(read, schema)


# ------------------------------------------------------------------ catalogues

CATALOGUE_FIELDS = ["name", "fieldName", "dataTypeName", "description"]


def column_catalogue(spark: SparkSession, path: str, dataset: str | None = None) -> DataFrame:
    """Column specs (JSON array documents) → name, fieldName, dataTypeName,
    description; missing keys → ''."""
    schema = StructType([StructField(f, StringType()) for f in CATALOGUE_FIELDS])
    df = spark.read.option("multiLine", True).schema(schema).json(path)
    out = df.select(*[F.coalesce(F.col(f), F.lit("")).alias(f) for f in CATALOGUE_FIELDS])
    return out.withColumn("dataset", F.lit(dataset)) if dataset else out


def combined_catalogue(catalogues: dict[str, DataFrame]) -> DataFrame:
    """Catalogues stacked with a dataset tag and a per-dataset column count."""
    from functools import reduce

    tagged = [c.withColumn("dataset", F.lit(name)) for name, c in catalogues.items()]
    u = reduce(lambda a, b: a.unionByName(b), tagged)
    counts = u.groupBy("dataset").agg(F.count(F.lit(1)).alias("columns_in_dataset"))
    return u.join(counts, "dataset").withColumn(
        "line", F.format_string("%s: %s (%s) — %s", "dataset", "fieldName", "dataTypeName", "name")
    )


# ------------------------------------------------------------------ config tables

def profile_seeds(profiles: DataFrame, key: str, key_col: str = "key", seeds_col: str = "seed_ids", agency_col: str = "agency") -> DataFrame:
    """Seeds of one profile (missing profile raises): agency defaults to the
    key; seed ids trimmed, empty ones dropped.  ``seeds_col`` is an array or a
    comma list."""
    p = profiles.filter(F.col(key_col) == key)
    if p.limit(1).count() == 0:
        raise KeyError(f"unknown profile {key!r}")
    seeds = F.col(seeds_col)
    if isinstance(profiles.schema[seeds_col].dataType, StringType):
        seeds = comma_list(seeds_col)
    return p.select(
        F.col(key_col),
        F.coalesce(empty_to_null(col(agency_col)), F.lit(key)).alias("agency") if agency_col in profiles.columns else F.lit(key).alias("agency"),
        F.posexplode(seeds).alias("seed_pos", "seed_id"),
    ).withColumn("seed_id", strip_ws("seed_id")).filter(F.col("seed_id") != "")


def schedule_lookup(schedules: DataFrame, city: str | None = None, city_col: str = "city") -> DataFrame:
    """All ingestion jobs, or the one of ``city`` (case-insensitive; missing raises)."""
    if city is None:
        return schedules
    hit = schedules.filter(F.lower(F.col(city_col)) == city.lower())
    if hit.limit(1).count() == 0:
        raise KeyError(f"no ingestion job for {city!r}")
    return hit
