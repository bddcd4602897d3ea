"""Joins (J01 to J12) and unions."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def fill_from(left: DataFrame, right: DataFrame, key: str, columns: Sequence[str] | None = None) -> DataFrame:
    """Left with its nulls filled, and its missing columns taken, from right; key is unique in right. Left wins."""
    columns = [c for c in (columns or right.columns) if c != key and c in right.columns]
    renamed = right.select(key, *(F.col(c).alias(f"__r_{c}") for c in columns))
    out = left.join(renamed, key, "left")
    return out.withColumns({c: F.coalesce(c, f"__r_{c}") if c in left.columns else F.col(f"__r_{c}") for c in columns}).drop(*(f"__r_{c}" for c in columns))


def road_context(points: DataFrame, context: DataFrame, defaults: dict[str, object], lat: str = "latitude", lon: str = "longitude") -> DataFrame:
    """Context by coordinates rounded to four decimals, with defaults where there is none."""
    keyed = points.withColumns({"lat_key": F.round(lat, 4), "lon_key": F.round(lon, 4)})
    out = keyed.join(context, ["lat_key", "lon_key"], "left")
    return out.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in defaults.items()}).drop("lat_key", "lon_key")


def backfill_coordinates(df: DataFrame, others: Sequence[DataFrame], keys: Sequence[str], lat: str = "lat", lon: str = "lon") -> DataFrame:
    """Null coordinates from the mean coordinates of a lower-cased key, table by table and key by key."""
    for other in others:
        for key in keys:
            if key not in df.columns or key not in other.columns:
                continue
            means = other.where(F.col(lat).isNotNull() & F.col(lon).isNotNull() & (F.trim(key) != "")).groupBy(F.lower(F.trim(key)).alias("__k")).agg(F.avg(lat).alias("__lat"), F.avg(lon).alias("__lon"))
            joined = df.withColumn("__k", F.lower(F.trim(key))).join(means, "__k", "left")
            df = joined.withColumns({lat: F.coalesce(lat, "__lat"), lon: F.coalesce(lon, "__lon")}).drop("__k", "__lat", "__lon")
    return df


def first_by(df: DataFrame, key: str | Sequence[str], *order: str | Column) -> DataFrame:
    """The first row of a key in an order."""
    keys = [key] if isinstance(key, str) else list(key)
    return df.withColumn("__k", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__k = 1").drop("__k")


def union_first(tables: Sequence[DataFrame], key: str) -> DataFrame:
    """All rows by column name, one per key, from the first table that has it."""
    tagged = [t.withColumn("__t", F.lit(i)) for i, t in enumerate(tables)]
    return first_by(reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged), key, "__t").drop("__t")
