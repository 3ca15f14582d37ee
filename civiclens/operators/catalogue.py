"""Case catalogue over landed accident tables (R07-R15): predicate searches,
point lookups, value domains and dataset slices.  Predicates are plain Column
expressions, so Catalyst pushes them into the Parquet scan, and filters on
partition columns prune whole directories.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _eq_all(filters: Mapping[str, object]) -> Column:
    cond = F.lit(True)
    for c, v in filters.items():
        if v is not None:
            cond = cond & (F.col(c) == F.lit(v))
    return cond


def year_range(year_col: str, year_from: int, year_to: int, date_col: str | None = None) -> Column:
    """Inclusive year range; with the raw ``date_col`` the same range is also
    stated on the date itself, a predicate Parquet row-group statistics can use
    (Catalyst pushes it through joins into the scan)."""
    cond = F.col(year_col).between(year_from, year_to)
    if date_col is not None:
        lo = F.make_date(F.lit(year_from), F.lit(1), F.lit(1))
        hi = F.make_date(F.lit(year_to + 1), F.lit(1), F.lit(1))
        cond = cond & (F.col(date_col) >= lo) & (F.col(date_col) < hi)
    return cond


def case_list(accidents: DataFrame, id_col: str, state_col: str, year_col: str, vehicles_col: str,
              state: object, year_from: int, year_to: int | None = None, min_vehicles: int = 1,
              date_col: str | None = None) -> DataFrame:
    """Ids of cases in ``state`` within the inclusive year range having at least ``min_vehicles``."""
    year_to = year_from if year_to is None else year_to
    return accidents.filter(
        (F.col(state_col) == F.lit(state)) & year_range(year_col, year_from, year_to, date_col) & (F.col(vehicles_col) >= min_vehicles)
    ).select(id_col)


def case_details(accidents: DataFrame, keys: Mapping[str, object]) -> DataFrame:
    """Rows matching every key (equality, pushed down to the scan)."""
    return accidents.filter(_eq_all(keys))


def search_by_person(crashes: DataFrame, people: DataFrame, crash_key: str, person_filters: Mapping[str, object],
                     year_col: str, year_from: int, year_to: int, state_col: str, state: object | None,
                     occupant_col: str, include_occupants: bool = True, include_non_occupants: bool = True,
                     date_col: str | None = None) -> DataFrame:
    """Crashes (year range, state) that have at least one person matching
    all given attributes; the two flags choose occupants / non-occupants."""
    if not (include_occupants or include_non_occupants):
        return crashes.limit(0)
    p = people.filter(_eq_all(person_filters))
    if not include_occupants:
        p = p.filter(~F.col(occupant_col))
    if not include_non_occupants:
        p = p.filter(F.col(occupant_col))
    c = crashes.filter(year_range(year_col, year_from, year_to, date_col))
    if state is not None:
        c = c.filter(F.col(state_col) == F.lit(state))
    return c.join(p.select(crash_key), crash_key, "left_semi")


def search_by_location(crashes: DataFrame, year_col: str, year_from: int, year_to: int, state_col: str, state: object,
                       county_col: str, county: object | None = None, date_col: str | None = None) -> DataFrame:
    """Crashes in the inclusive year range, state and (optional) county."""
    cond = year_range(year_col, year_from, year_to, date_col) & (F.col(state_col) == F.lit(state))
    if county is not None:
        cond = cond & (F.col(county_col) == F.lit(county))
    return crashes.filter(cond)


def variable_catalogue(df: DataFrame, year_col: str) -> DataFrame:
    """Per year, every variable (column) with its type and non-null count.

    One grouped aggregation (a counter per column), then the small per-year
    result is unpivoted into (year, variable) rows.
    """
    values = [c for c in df.columns if c != year_col]
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    counts = df.groupBy(year_col).agg(*[F.count(F.col(c)).alias(c) for c in values])
    long = counts.unpivot([year_col], values, "variable", "non_null")
    type_map = F.create_map(*[x for c in values for x in (F.lit(c), F.lit(types[c]))])
    return long.withColumn("data_type", F.element_at(type_map, F.col("variable")))


def attribute_domain(df: DataFrame, variable: str, parents: Mapping[str, object] | None = None) -> DataFrame:
    """Values a variable takes (optionally given parent values), with counts."""
    d = df.filter(_eq_all(parents)) if parents else df
    return d.filter(F.col(variable).isNotNull()).groupBy(F.col(variable).alias("value")).agg(F.count(F.lit(1)).alias("n"))


def write_partitioned(df: DataFrame, path: str, partition_cols: Sequence[str]) -> None:
    """Land a table partitioned for slicing (year, state)."""
    df.write.mode("overwrite").partitionBy(*partition_cols).parquet(path)


def dataset_slice(spark: SparkSession, path: str, year_col: str, year_from: int, year_to: int,
                  state_col: str, state: object, fmt: str = "csv") -> DataFrame:
    """Slice of a partitioned table (partition pruning on year and state),
    rendered as CSV or JSON text lines."""
    d = spark.read.parquet(path).filter(F.col(year_col).between(year_from, year_to) & (F.col(state_col) == F.lit(state)))
    cols = [F.col(c) for c in d.columns]
    if fmt == "json":
        return d.select(F.to_json(F.struct(*cols)).alias("line"))
    if fmt == "csv":
        return d.select(F.to_csv(F.struct(*cols)).alias("line"))
    raise ValueError("fmt must be csv or json")
