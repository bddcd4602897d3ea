"""Spatial joins (J13 to J16): cells of the search radius as an equi-join key, then the exact distance."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import haversine_m, local_xy
from .checkpoint import cut


def cells(df: DataFrame, x: str, y: str, size: float, time: str | None = None, days: float = 1.0, around: bool = False) -> DataFrame:
    """df with the cell of each row, or, around, one row for each of the neighbouring cells."""
    parts = [F.floor(F.col(x) / size).cast("long"), F.floor(F.col(y) / size).cast("long")]
    if time:
        parts.append(F.floor(F.col(time) / days).cast("long"))
    if not around:
        return df.withColumn("cell", F.struct(*(p.alias(f"c{i}") for i, p in enumerate(parts))))
    steps = [[]]
    for _ in parts:
        steps = [s + [d] for s in steps for d in (-1, 0, 1)]
    return df.withColumn("cell", F.explode(F.array(*[F.struct(*((p + d).alias(f"c{i}") for i, (p, d) in enumerate(zip(parts, s, strict=True)))) for s in steps])))


def projected(df: DataFrame, lat: str = "latitude", lon: str = "longitude") -> DataFrame:
    """x and y in metres around the mean point."""
    wide = df.crossJoin(F.broadcast(df.agg(F.avg(lat).alias("__la"), F.avg(lon).alias("__lo"))))
    x, y = local_xy(lat, lon, "__la", "__lo")
    return wide.withColumns({"x": x, "y": y}).drop("__la", "__lo")


def near_pairs(df: DataFrame, key: str, x: str = "x", y: str = "y", radius: float = 150.0, time: str | None = None, days: float = 3.0) -> DataFrame:
    """Pairs (a, b), in both orders and with each row itself, within radius and, with time, within days."""
    keep = [key, x, y] + ([time] if time else [])
    left = cells(df.select(*keep), x, y, radius, time, days).select("cell", *(F.col(k).alias(f"a_{k}") for k in keep))
    right = cells(df.select(*keep), x, y, radius, time, days, around=True).select("cell", *(F.col(k).alias(f"b_{k}") for k in keep))
    near = F.pow(F.col(f"a_{x}") - F.col(f"b_{x}"), 2) + F.pow(F.col(f"a_{y}") - F.col(f"b_{y}"), 2) <= radius * radius
    if time:
        near = near & (F.abs(F.col(f"a_{time}") - F.col(f"b_{time}")) <= days)
    return left.join(right, "cell").where(near).select(F.col(f"a_{key}").alias("a"), F.col(f"b_{key}").alias("b"))


def near_counts(df: DataFrame, key: str, x: str = "x", y: str = "y", radius: float = 150.0, time: str | None = None, days: float = 3.0, most: int = 250_000) -> DataFrame:
    """A, n: how many rows near_pairs gives each key, counted without making the pairs, whose number grows with the square.

    Rows of one place and time are one spot with a weight. Spots meet in cells four radii wide and four time bands long, where
    near_weights() counts whole boxes of places at once. A cell of more than `most` spots is dealt to parts of about so many,
    and each part of those that ask meets each part of those that are met: no group is larger, and the counts add up.
    """
    rows = df.select(F.col(key).alias("a"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"), (F.col(time).cast("double") if time else F.lit(0.0)).alias("t"))
    rows = cut(rows)  # means that are summed in another order would give other places
    known = rows
    for c in "xyt":  # missing, NaN and infinite values are near nothing
        known = known.where(F.abs(c) < float("inf"))
    spots = known.groupBy("x", "y", "t").agg(F.count("*").alias("w"))
    met, own, cell = spots, F.lit(True), ["cx", "cy", "ct"]
    for c, reach, size in (("x", radius, 4 * radius), ("y", radius, 4 * radius), ("t", days, 4 * days)):
        at = lambda v, size=size: F.floor(v / size).cast("long")
        far = F.lit(reach * 1.000001) + F.abs(c) * 1e-12  # wider than rounding
        met = met.withColumn(f"c{c}", F.explode(F.sequence(at(F.col(c) - far), at(F.col(c) + far))))
        own = own & (F.col(f"c{c}") == at(F.col(c)))
    met = met.withColumn("own", own)
    parts = lambda n: F.greatest(F.ceil(n / most), F.lit(1)).cast("int")
    large = met.groupBy(cell).agg(F.count_if("own").alias("asks"), F.count("*").alias("n")).where(F.col("n") > most)
    met = met.join(F.broadcast(large.select(*cell, parts(F.col("asks")).alias("p"), parts(F.col("n")).alias("q"))), cell, "left").fillna(1, ["p", "q"])
    part = lambda n: F.pmod(F.xxhash64("x", "y", "t"), F.col(n)).cast("int")
    # a spot goes to its row of parts (i) if it asks, and to its column of parts (j) to be met
    role = lambda i, j: F.struct(i.alias("i"), j.alias("j"), (F.col("own") & (i == part("p"))).alias("asks"), (j == part("q")).alias("met"))
    column = F.transform(F.sequence(F.lit(0), F.col("p") - 1), lambda i: role(i, part("q")))
    row = F.transform(F.filter(F.sequence(F.lit(0), F.col("q") - 1), lambda j: j != part("q")), lambda j: role(part("p"), j))
    to = F.when((F.col("p") == 1) & (F.col("q") == 1), F.array(role(F.lit(0), F.lit(0)))).when(F.col("own"), F.concat(column, row)).otherwise(column)
    dealt = met.select(*cell, "x", "y", "t", "w", F.inline(to))

    def one(group: pa.Table) -> pa.Table:
        group = group.select(["x", "y", "t", "w", "asks", "met"]).sort_by("t")
        a, b = ({c: group[c].to_numpy()[group[to].to_numpy()] for c in "xytw"} for to in ("asks", "met"))
        times, rank = np.unique(b["t"], return_inverse=True)
        low, high = time_ranks(a["t"], times, days)
        n = near_weights(a["x"], a["y"], low, high, b["x"], b["y"], rank, b["w"], radius * radius)
        return pa.table({"x": a["x"], "y": a["y"], "t": a["t"], "n": n})

    counted = dealt.groupBy(*cell, "i", "j").applyInArrow(one, "x double, y double, t double, n long")
    return rows.join(counted.groupBy("x", "y", "t").agg(F.sum("n").alias("n")), ["x", "y", "t"]).groupBy("a").agg(F.sum("n").alias("n"))


def time_ranks(at: np.ndarray, times: np.ndarray, days: float) -> tuple[np.ndarray, np.ndarray]:
    """For each of at, begin and end of the times (sorted, distinct) with |at - time| <= days, as that comparison rounds."""
    low, high = np.searchsorted(times, at - days, "left"), np.searchsorted(times, at + days, "right")
    padded = np.concatenate([[-np.inf], times, [np.inf]])
    near = lambda i: np.abs(at - padded[i + 1]) <= days
    while (m := near(low - 1)).any():
        low = low - m
    while (m := (low < high) & ~near(low)).any():
        low = low + m
    while (m := near(high)).any():
        high = high + m
    while (m := (low < high) & ~near(high - 1)).any():
        high = high - m
    return low, high


def near_weights(ax, ay, low, high, bx, by, rank, weight, limit: float, leaf: int = 16) -> np.ndarray:
    """For each point a, the weight of the points b with dx * dx + dy * dy <= limit and low <= rank < high; b sorted by rank.

    Boxes of points a are halved. Points b that are near all of a box are counted by their ranks and points b that are near
    none are left out, so only those near its border go on to its halves. Rounding keeps the order of distances, so the bounds
    of a box tell the same as each of its points.
    """
    out = np.zeros(len(ax), np.int64)
    todo = [(np.arange(len(ax)), bx, by, rank, weight)] if len(ax) else []
    while todo:
        a, bx, by, rank, weight = todo.pop()
        x, y = ax[a], ay[a]
        x0, x1, y0, y1 = x.min(), x.max(), y.min(), y.max()
        whole = np.maximum(x1 - bx, bx - x0) ** 2 + np.maximum(y1 - by, by - y0) ** 2 <= limit
        total, ranks = np.concatenate([[0], np.cumsum(weight[whole])]), rank[whole]
        out[a] += total[np.searchsorted(ranks, high[a])] - total[np.searchsorted(ranks, low[a])]
        some = ~whole & (np.maximum(np.maximum(x0 - bx, bx - x1), 0) ** 2 + np.maximum(np.maximum(y0 - by, by - y1), 0) ** 2 <= limit)
        if not some.any():
            continue
        bx, by, rank, weight = bx[some], by[some], rank[some], weight[some]
        if len(a) <= leaf:
            near = ((x[:, None] - bx) ** 2 + (y[:, None] - by) ** 2 <= limit) & (rank >= low[a, None]) & (rank < high[a, None])
            out[a] += near @ weight
            continue
        side = x if x1 - x0 >= y1 - y0 else y
        middle = np.partition(side, len(side) // 2)[len(side) // 2]
        left = side < middle if middle > side.min() else side <= middle
        todo += [(a[left], bx, by, rank, weight), (a[~left], bx, by, rank, weight)]
    return out


def within(df: DataFrame, key: str, lat: str, lon: str, radius_m: float) -> DataFrame:
    """Pairs a < b of rows with 0 < distance_m <= radius_m on the sphere. Cells in degrees; east-west widened by latitude."""
    size = math.degrees(radius_m / 6371000.0) * 1.0000001
    rows = df.select(key, lat, lon)
    # a cell's width in longitude holds the radius up to 85 degrees; nearer to the poles cells are wider than needed there
    wide = rows.withColumns({"__y": F.col(lat), "__x": F.col(lon) * F.greatest(F.cos(F.radians(F.ceil(F.abs(lat)) + 1)), F.lit(0.05))})
    band = F.ceil(F.abs(lat)).cast("long")
    left = cells(wide.withColumn("__b", band), "__x", "__y", size).select("cell", "__b", F.col(key).alias("a"), F.col(lat).alias("la"), F.col(lon).alias("lo"))
    # a neighbour may lie in the next band of latitude, where longitudes are scaled otherwise: it is entered in that band too
    near = wide.withColumn("__b", F.explode(F.array_distinct(F.array(F.ceil(F.abs(F.col(lat)) - size).cast("long"), band, F.ceil(F.abs(F.col(lat)) + size).cast("long")))))
    near = near.withColumn("__x", F.col(lon) * F.greatest(F.cos(F.radians(F.col("__b") + 1)), F.lit(0.05)))
    right = cells(near, "__x", "__y", size, around=True).select("cell", "__b", F.col(key).alias("b"), F.col(lat).alias("lb"), F.col(lon).alias("lob"))
    d = haversine_m("la", "lo", "lb", "lob")
    return left.join(right, ["cell", "__b"]).where("a < b").select("a", "b", d.alias("distance_m")).where((F.col("distance_m") > 0) & (F.col("distance_m") <= radius_m)).distinct()


def nearest(points: DataFrame, key: str, targets: DataFrame, target: str, lat: str = "lat", lon: str = "lon", start_m: float = 250.0) -> DataFrame:
    """Key, target and distance_m of the nearest target (ties: the smallest); the radius grows until each point has one.

    Each round is a cell join of the points still without a target; a target found within the radius is the nearest. Points
    and targets without coordinates take no part. The rounds end at half the Earth's circumference, where every target is
    within reach, so only points far from all targets meet many of them.
    """
    known = lambda df: df.where(F.col(lat).isNotNull() & F.col(lon).isNotNull() & ~F.isnan(F.col(lat).cast("double")) & ~F.isnan(F.col(lon).cast("double")))
    left, out, radius = known(points).select(key, lat, lon), None, start_m
    # a target beyond the date line is entered on this side too
    around = known(targets).select(target, F.col(lat), F.explode(F.array(lon, F.col(lon) + 360, F.col(lon) - 360)).alias(lon))
    scale, half = 111194.93, 20_015_100.0
    while True:
        # longitudes differ by up to the radius over the cosine of the latitude; cells are cut in plain degrees, four times as wide
        size = 4 * radius / scale
        near = cells(around, lon, lat, size, around=True).select("cell", target, F.col(lat).alias("tl"), F.col(lon).alias("to"))
        d = cells(left, lon, lat, size).join(near, "cell").withColumn("distance_m", haversine_m(lat, lon, "tl", "to")).where(F.col("distance_m") <= radius)
        found = cut(d.groupBy(key).agg(F.min(F.struct("distance_m", target)).alias("__m")).select(key, f"__m.{target}", "__m.distance_m"))
        out = found if out is None else out.unionByName(found)
        left = cut(left.join(found.select(key), key, "left_anti"))  # else each round would hold all before it twice
        if radius > half or left.isEmpty():
            return out
        radius *= 4
