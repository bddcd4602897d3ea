"""Clusters in space and time (K10), hulls (K13), and an isolation forest."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .checkpoint import cut
from .graph import components
from .spatial import projected


def st_dbscan(df: DataFrame, key: str = "id", time: str = "days", order: tuple[str, ...] = ("days", "id"), eps_m: float = 150.0, eps_days: float = 3.0, min_points: int = 15) -> DataFrame:
    """df with cluster_id (from 1, by the first core row in order; -1 is noise) and is_core.

    df has key, latitude, longitude and time in days; rows without a place or time are noise. A row is core if at least
    min_points rows, itself included, are near it. Clusters are the components of core rows near each other; any other row
    near a core one joins the lowest-numbered cluster that it is near to. That is what a scan in that order, growing one
    cluster after the other, gives.

    Rows of one cell (eps / sqrt 2 wide, eps_days long) are all near each other. A cell of min_points rows is dense: its rows
    are core and stand for one node, so rows of a crowded place are never paired with each other. Pairs are made only from
    rows of the other cells, which hold fewer than min_points each; whether two dense cells touch is told from the extents of
    their sub-cells, and by rows only where these can't tell.
    """
    side = eps_m / math.sqrt(2) * (1 - 1e-9)
    xyt = projected(df.where("latitude IS NOT NULL AND longitude IS NOT NULL").where(F.col(time).isNotNull()))
    rows = xyt.select(F.col(key).alias("k"), "x", "y", F.col(time).cast("double").alias("t"), F.struct(*(F.col(o).alias(f"o{i}") for i, o in enumerate(order))).alias("o"))
    at = lambda c, size: F.floor(F.col(c) / size).cast("long")
    rows = rows.withColumn("cell", F.struct(at("x", side).alias("a"), at("y", side).alias("b"), at("t", eps_days).alias("c")))
    cells = cut(rows.groupBy("cell").agg(F.count("*").alias("n"), F.min("k").alias("rep"), F.min("o").alias("first")))
    dense = cells.where(F.col("n") >= min_points)
    rows = cut(rows.join(dense.select("cell", "rep"), "cell", "left"))
    steps = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(c).alias("c")) for a in range(-2, 3) for b in range(-2, 3) for c in (-1, 0, 1)])

    def around(d: DataFrame) -> DataFrame:
        return d.withColumn("__s", F.explode(steps)).withColumn("cell", F.struct(*((F.col(f"cell.{c}") + F.col(f"__s.{c}")).alias(c) for c in "abc"))).drop("__s")

    other = lambda d, name: d.select("cell", *(F.col(c).alias(f"{c}_{name}") for c in ("k", "x", "y", "t", "rep")))
    near = lambda p, q: (F.pow(F.col(f"x_{p}") - F.col(f"x_{q}"), 2) + F.pow(F.col(f"y_{p}") - F.col(f"y_{q}"), 2) <= eps_m * eps_m) & (F.abs(F.col(f"t_{p}") - F.col(f"t_{q}")) <= eps_days)
    loose = rows.where("rep IS NULL")
    asks = other(around(loose), "p")
    pairs = cut(asks.join(other(loose, "q"), "cell").where(near("p", "q")).select(F.col("k_p").alias("p"), F.col("k_q").alias("q")))
    touches = cut(asks.join(other(rows.where("rep IS NOT NULL"), "q"), "cell").where(near("p", "q")).groupBy(F.col("k_p").alias("p"), F.col("rep_q").alias("q")).agg(F.count("*").alias("n")))
    total = pairs.groupBy("p").agg(F.count("*").alias("n")).unionByName(touches.select("p", "n")).groupBy("p").agg(F.sum("n").alias("n"))
    core = cut(total.where(F.col("n") >= min_points).select("p"))

    links = pairs.join(core, "p", "left_semi").join(core.withColumnRenamed("p", "q"), "q", "left_semi").where("p < q").select("p", "q")
    links = links.unionByName(touches.join(core, "p", "left_semi").select("p", "q")).unionByName(_dense_links(rows, dense, around, near, other, side, eps_m, eps_days))
    found = components(links, "p", "q").withColumnRenamed("node", "k")
    nodes = core.join(rows.select(F.col("k").alias("p"), "o"), "p").select(F.col("p").alias("k"), "o").unionByName(dense.select(F.col("rep").alias("k"), F.col("first").alias("o")))
    nodes = cut(nodes.join(found, "k", "left").withColumn("component", F.coalesce("component", "k")))
    # one row per cluster
    numbers = nodes.groupBy("component").agg(F.min("o").alias("o")).select("component", F.row_number().over(Window.orderBy("o")).cast("long").alias("cluster_id"))
    of = cut(nodes.join(numbers, "component").select("k", "cluster_id"))
    border = pairs.select("p", "q").unionByName(touches.select("p", "q")).join(of.withColumnRenamed("k", "q"), "q").groupBy(F.col("p").alias("k")).agg(F.min("cluster_id").alias("near_id"))
    known = rows.withColumn("node", F.coalesce("rep", "k")).join(of.withColumnRenamed("k", "node"), "node", "left").join(border, "k", "left")
    known = known.select(F.col("k").alias(key), F.coalesce("cluster_id", "near_id", F.lit(-1).cast("long")).alias("cluster_id"), F.col("cluster_id").isNotNull().cast("int").alias("is_core"))
    return df.drop("cluster_id", "is_core").join(known, key, "left").fillna({"cluster_id": -1, "is_core": 0})


def _dense_links(rows, dense, around, near, other, side: float, eps_m: float, eps_days: float, parts: int = 4) -> DataFrame:
    """Pairs (p, q) of dense cells' nodes that have rows near each other."""
    sub = lambda c, size: F.floor(F.col(c) * parts / size).cast("long")
    inside = rows.where("rep IS NOT NULL").withColumn("sub", F.struct(sub("x", side).alias("a"), sub("y", side).alias("b"), sub("t", eps_days).alias("c")))
    extents = cut(inside.groupBy("cell", "rep", "sub").agg(*(f(c).alias(f"{c}{n}") for c in "xyt" for n, f in (("0", F.min), ("1", F.max)))))
    boxes = lambda d, name: d.select("cell", *(F.col(c).alias(f"{c}_{name}") for c in ("rep", "sub", "x0", "x1", "y0", "y1", "t0", "t1")))
    both = boxes(around(extents), "p").join(boxes(extents, "q"), "cell").where("rep_p < rep_q")
    least = lambda c: F.greatest(F.lit(0.0), F.col(f"{c}0_q") - F.col(f"{c}1_p"), F.col(f"{c}0_p") - F.col(f"{c}1_q"))
    most = lambda c: F.greatest(F.col(f"{c}1_q") - F.col(f"{c}0_p"), F.col(f"{c}1_p") - F.col(f"{c}0_q"))
    possible = (F.pow(least("x"), 2) + F.pow(least("y"), 2) <= eps_m * eps_m) & (least("t") <= eps_days)
    sure = (F.pow(most("x"), 2) + F.pow(most("y"), 2) <= eps_m * eps_m) & (most("t") <= eps_days)
    told = cut(both.where(possible).select(F.col("rep_p").alias("p"), F.col("rep_q").alias("q"), "sub_p", "sub_q", sure.alias("sure")))
    yes = told.where("sure").select("p", "q").distinct()
    open_ = told.join(yes, ["p", "q"], "left_anti").select(F.col("p").alias("rep_p"), F.col("q").alias("rep_q"), "sub_p", "sub_q")
    points = lambda name: inside.select(*(F.col(c).alias(f"{c}_{name}") for c in ("rep", "sub", "x", "y", "t")))
    seen = open_.join(points("p"), ["rep_p", "sub_p"]).join(points("q"), ["rep_q", "sub_q"]).where(near("p", "q"))
    return yes.unionByName(seen.select(F.col("rep_p").alias("p"), F.col("rep_q").alias("q")).distinct())


def hull(points: np.ndarray) -> np.ndarray:
    """The corners of the convex hull, counter-clockwise."""
    points = np.unique(points, axis=0)
    if len(points) <= 2:
        return points

    def half(sequence):
        out: list = []
        for p in sequence:
            while len(out) >= 2 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(p)
        return out[:-1]

    return np.array(half(points) + half(points[::-1]))


def polygon_area(corners: np.ndarray) -> float:
    if len(corners) < 3:
        return 0.0
    x, y = corners[:, 0], corners[:, 1]
    return float(abs(np.dot(x, np.roll(y, -1)) - np.dot(y, np.roll(x, -1))) / 2)


def hull_area(df: DataFrame, key: str, x: str = "x", y: str = "y", least: float = 1000.0, pad: float = 10.0, grid: float = 0.01) -> DataFrame:
    """Key, area_m2: the hull's area; for a degenerate hull that of the box, padded; at least `least`.

    Only the extreme points of each x step can be corners, so a key's points are first reduced, map-side, to two per step.
    """
    step = F.floor(F.col(x) / grid)
    ends = df.groupBy(key, step.alias("s")).agg(F.min(F.struct(y, x)).alias("lo"), F.max(F.struct(y, x)).alias("hi"), F.min(F.struct(x, y)).alias("west"), F.max(F.struct(x, y)).alias("east"))
    pts = ends.select(key, F.explode(F.array(*[F.struct(F.col(f"{n}.{x}").alias("x"), F.col(f"{n}.{y}").alias("y")) for n in ("lo", "hi", "west", "east")])).alias("p")).select(key, "p.x", "p.y").distinct()

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        p = pdf[["x", "y"]].to_numpy()
        area = polygon_area(hull(p)) if len(p) > 1 else 0.0
        if area <= 0 and len(p) > 1:
            area = float((np.ptp(p[:, 0]) + pad) * (np.ptp(p[:, 1]) + pad))
        return pd.DataFrame({key: [pdf[key].iloc[0]], "area_m2": [max(area, least)]})

    return pts.groupBy(key).applyInPandas(one, f"{key} {dict(df.dtypes)[key]}, area_m2 double")


def robust_scaled(df: DataFrame, columns: list[str]) -> DataFrame:
    """(x - median) / interquartile range, by exact quantiles; a range of zero counts as 1."""
    wide = df.crossJoin(F.broadcast(df.agg(*(F.percentile(c, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias(f"__q_{c}") for c in columns))))
    q = lambda c, i: F.get(f"__q_{c}", F.lit(i))
    return wide.withColumns({c: (F.col(c) - q(c, 1)) / F.when(q(c, 2) - q(c, 0) == 0, 1.0).otherwise(q(c, 2) - q(c, 0)) for c in columns}).drop(*(f"__q_{c}" for c in columns))


def isolation_scores(df: DataFrame, key: str, columns: list[str], trees: int = 300, sample: int = 256, seed: int = 42) -> DataFrame:
    """Key, anomaly in (0, 1), higher for rows that random cuts isolate sooner.

    Every tree grows on a bounded sample of rows, chosen by a hash of key and seed; the forest is broadcast (trees * 2 * sample
    nodes at most) and all rows are scored in Arrow batches.
    """
    spark = df.sparkSession
    pool = df.select(key, *columns).orderBy(F.xxhash64(F.col(key), F.lit(seed)), key).limit(sample * 16).toPandas()
    x = pool[columns].fillna(0.0).to_numpy(float)
    r = np.random.default_rng(seed)
    size = min(sample, len(x))

    def grow(rows, depth, limit):
        if depth >= limit or len(rows) <= 1:
            return len(rows)
        spread = np.ptp(rows, axis=0)
        open_ = np.flatnonzero(spread > 0)
        if not len(open_):
            return len(rows)
        f = int(r.choice(open_))
        cutoff = r.uniform(rows[:, f].min(), rows[:, f].max())
        low = rows[:, f] < cutoff
        return f, cutoff, grow(rows[low], depth + 1, limit), grow(rows[~low], depth + 1, limit)

    def steps(n):
        return 0.0 if n <= 1 else 1.0 if n == 2 else 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n

    limit = int(np.ceil(np.log2(max(2, size))))
    forest = [grow(x[r.choice(len(x), size, replace=False)], 0, limit) for _ in range(trees)] if len(x) else []
    shared = spark.sparkContext.broadcast((forest, steps(size) or 1.0))

    def depth_of(tree, rows, depth=0):
        if not isinstance(tree, tuple):
            return np.full(len(rows), depth + steps(tree))
        f, cutoff, low, high = tree
        out = np.empty(len(rows))
        left = rows[:, f] < cutoff
        if left.any():
            out[left] = depth_of(low, rows[left], depth + 1)
        if not left.all():
            out[~left] = depth_of(high, rows[~left], depth + 1)
        return out

    def run(batches):
        trees_, usual = shared.value
        for pdf in batches:
            rows = pdf[columns].fillna(0.0).to_numpy(float)
            mean = np.mean([depth_of(t, rows) for t in trees_], axis=0) if trees_ else np.zeros(len(rows))
            yield pd.DataFrame({key: pdf[key], "anomaly": 2 ** (-mean / usual)})

    return df.select(key, *columns).mapInPandas(run, f"{key} {dict(df.dtypes)[key]}, anomaly double")
