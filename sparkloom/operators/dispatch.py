"""Plans from scores: allocation of units (K20) and greedy routes."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.tables import EARTH_M, EPS, ROUTE_SPEED


def allocate(df: DataFrame, key: str, score: str, units: int = 15, most: int = 3, eligible: float = 40.0) -> DataFrame:
    """df with patrols. Rows of a score of eligible or more take part (if none does: the best `units`). With more of them than
    units, the best get one each; else each gets one, and what is left goes out in proportion to the score: whole parts, then
    by the largest remainder. At most `most` each.
    """
    order = Window.orderBy(F.desc(score), key)
    wide = df.crossJoin(F.broadcast(df.agg(F.count_if(F.col(score) >= eligible).alias("__e"))))
    wide = wide.withColumn("__in", F.when(F.col("__e") > 0, F.col(score) >= eligible)).withColumn("__r", F.row_number().over(order))
    wide = wide.withColumn("__in", F.coalesce("__in", F.col("__r") <= units))
    n, total = F.count_if("__in").over(Window.partitionBy()), F.sum(F.when(F.col("__in"), F.col(score)).otherwise(0.0)).over(Window.partitionBy())
    wide = wide.withColumns({"__n": n, "__t": total})
    remain = F.greatest(F.lit(0), F.lit(units) - F.col("__n"))
    extra = F.when(F.col("__in"), F.col(score) / F.greatest(F.col("__t"), F.lit(EPS)) * remain).otherwise(0.0)
    wide = wide.withColumns({"__x": extra, "__w": F.floor(extra)})
    wide = wide.withColumn("__left", remain - F.sum("__w").over(Window.partitionBy()))
    by_rest = F.row_number().over(Window.orderBy(F.desc("__in"), F.desc(F.round(F.col("__x") - F.col("__w"), 12)), F.desc(score), key))
    few = 1 + F.col("__w") + F.when(by_rest <= F.col("__left"), 1).otherwise(0)
    got = F.when(~F.col("__in"), 0).when(F.col("__n") > units, (F.col("__r") <= units).cast("int")).otherwise(few)
    return wide.withColumn("patrols", F.least(F.lit(most), got).cast("long")).drop("__e", "__in", "__r", "__n", "__t", "__x", "__w", "__left")


def _metres(a, b) -> float:
    p, q = math.radians(a[0]), math.radians(b[0])
    h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2
    return 2 * EARTH_M * math.atan2(math.sqrt(h), math.sqrt(1 - h))


def greedy_route(df: DataFrame, key: str, score: str, depot: tuple[float, float], lat: str = "lat", lon: str = "lon", stops: int = 12) -> DataFrame:
    """The best `stops` rows in nearest-neighbour order from the depot: seq, key, leg_m, total_m. A top-k of the table is all that reaches the driver."""
    rows = [(r[0], (r[1], r[2])) for r in df.where(F.col(lat).isNotNull() & F.col(lon).isNotNull()).orderBy(F.desc(score), key).limit(stops).select(key, lat, lon).collect()]
    here, out, total = depot, [], 0.0
    while rows:
        best = min(range(len(rows)), key=lambda i: (_metres(here, rows[i][1]), i))
        name, place = rows.pop(best)
        leg = _metres(here, place)
        total += leg
        out.append((len(out) + 1, name, leg, total))
        here = place
    return df.sparkSession.createDataFrame(out, f"seq int, {key} {dict(df.dtypes)[key]}, leg_m double, total_m double")


def weighted_route(df: DataFrame, key: str, score: str, depot: tuple[float, float], lat: str = "lat", lon: str = "lon", road: str = "road_class", stops: int = 12, pull: float = 0.02, least_minutes: float = 3.0) -> DataFrame:
    """As greedy_route, but the next stop has the least km - pull * score, and a leg's minutes follow the road's speed: seq, key, leg_km, total_km, eta_min."""
    rows = [(r[0], (r[1], r[2]), r[3] or 0.0, r[4]) for r in df.where(F.col(lat).isNotNull() & F.col(lon).isNotNull()).orderBy(F.desc(score), key).limit(stops).select(key, lat, lon, score, road).collect()]
    here, out, total, clock = depot, [], 0.0, 0.0
    while rows:
        best = min(range(len(rows)), key=lambda i: (_metres(here, rows[i][1]) / 1000 - pull * rows[i][2], i))
        name, place, _, kind = rows.pop(best)
        leg = _metres(here, place) / 1000
        total += leg
        clock += max(least_minutes, 60 * leg / ROUTE_SPEED.get((kind or "road").strip().lower(), 24.0))
        out.append((len(out) + 1, name, leg, total, clock))
        here = place
    return df.sparkSession.createDataFrame(out, f"seq int, {key} {dict(df.dtypes)[key]}, leg_km double, total_km double, eta_min double")
