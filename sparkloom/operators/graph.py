"""Connected components over an edge table, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .checkpoint import cut, cut_and_sum, forget


def components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60) -> DataFrame:
    """Rows (node, component): the smallest node that is reachable over the edges, in either direction.

    Nodes without an edge (self loops and nulls are dropped first) get no row. Each round links every node to the
    smallest of its neighbours, so the table shrinks to stars in few rounds; whether a round changed anything is told by
    sums gathered as its table is written, and the table before is deleted. Every step is a grouped minimum (combined
    map-side) and an equi-join on a node, which adaptive execution splits where a node has many edges; no list of a
    node's neighbours is ever gathered. Rounds are cut by tables in the shared checkpoint folder.
    """
    e = edges.select(F.greatest(src, dst).alias("u"), F.least(src, dst).alias("v")).where("u <> v").distinct()
    e = cut(e)
    last = None
    for _ in range(max_rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.unionByName(low.where("m < u").select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        old = e
        e, now = cut_and_sum(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), n=F.count(F.lit(1)), hash=F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")))
        forget(old)
        if now == last:
            break
        last = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def pagerank(nodes: DataFrame, edges: DataFrame, node: str = "node", src: str = "src", dst: str = "dst", weight: str = "weight", alpha: float = 0.85, rounds: int = 200, tolerance: float = 1e-6, cut_every: int = 5) -> DataFrame:
    """Rows (node, pagerank) that sum to 1. Edges without weight don't count; a node without any passes its rank to all.

    A round is one join on the source and one grouped sum; every few rounds a table in the shared folder cuts the lineage.
    """
    n = nodes.select(node).distinct().count()
    if not n:
        return nodes.select(F.col(node).alias("node"), F.lit(0.0).alias("pagerank"))
    good = edges.where(F.col(weight) > 0).groupBy(F.col(src).alias("s"), F.col(dst).alias("d")).agg(F.sum(weight).alias("w"))
    links = cut(good.join(good.groupBy("s").agg(F.sum("w").alias("total")), "s").select("s", "d", (F.col("w") / F.col("total")).alias("p")))
    rank = cut(nodes.select(F.col(node).alias("node")).distinct().join(links.select(F.col("s").alias("node"), F.lit(True).alias("linked")).distinct(), "node", "left").select("node", F.coalesce("linked", F.lit(False)).alias("linked"), F.lit(1.0 / n).alias("x")))
    for k in range(rounds):
        given = rank.join(links, rank["node"] == links["s"]).groupBy(F.col("d").alias("node")).agg(F.sum(F.col("x") * F.col("p")).alias("got"))
        dangling = rank.where("NOT linked").agg(F.coalesce(F.sum("x"), F.lit(0.0)).alias("spare"))
        new = rank.withColumnRenamed("x", "old").join(given, "node", "left").crossJoin(F.broadcast(dangling))
        new = new.select("node", "linked", (alpha * (F.coalesce("got", F.lit(0.0)) + F.col("spare") / n) + (1 - alpha) / n).alias("x"), "old")
        if k % cut_every == cut_every - 1:
            new = cut(new)
            if new.agg(F.sum(F.abs(F.col("x") - F.col("old")))).first()[0] < n * tolerance:
                rank = new.drop("old")
                break
        rank = new.drop("old")
    return rank.select("node", F.col("x").alias("pagerank"))


def betweenness(nodes: DataFrame, edges: DataFrame, node: str = "node", src: str = "src", dst: str = "dst", most_exact: int = 5000, sample: int | None = None, seed: int = 42, most_edges: int = 5_000_000) -> DataFrame:
    """Normalised betweenness of an undirected graph without weights: exact, or from a sample of sources if nodes are more than most_exact.

    Sources are dealt over the tasks, each of which runs Brandes' algorithm on a broadcast adjacency. A graph of over most_edges
    edges is refused, so that what is broadcast has a bound.
    """
    import random

    import pandas as pd

    spark = nodes.sparkSession
    m = edges.count()
    if m > most_edges:
        raise ValueError(f"{m} edges; betweenness is limited to {most_edges}")
    names = sorted(r[0] for r in nodes.select(node).distinct().collect())
    at = {x: i for i, x in enumerate(names)}
    near: list[list[int]] = [[] for _ in names]
    for a, b in {(min(at[r[0]], at[r[1]]), max(at[r[0]], at[r[1]])) for r in edges.select(src, dst).collect() if r[0] in at and r[1] in at and r[0] != r[1]}:
        near[a].append(b)
        near[b].append(a)
    n = len(names)
    chosen = list(range(n)) if n <= most_exact else sorted(random.Random(seed).sample(range(n), sample or min(200, max(50, n // 200))))
    shared = spark.sparkContext.broadcast(near)

    def run(batches):
        graph = shared.value
        total = [0.0] * len(graph)
        for batch in batches:
            for s in batch["s"]:
                order, before, paths, far = [], [[] for _ in graph], [0.0] * len(graph), [-1] * len(graph)
                paths[s], far[s], queue = 1.0, 0, [s]
                for v in queue:
                    order.append(v)
                    for w in graph[v]:
                        if far[w] < 0:
                            far[w] = far[v] + 1
                            queue.append(w)
                        if far[w] == far[v] + 1:
                            paths[w] += paths[v]
                            before[w].append(v)
                gain = [0.0] * len(graph)
                for w in reversed(order):
                    for v in before[w]:
                        gain[v] += paths[v] / paths[w] * (1 + gain[w])
                    if w != s:
                        total[w] += gain[w]
        yield pd.DataFrame({"i": range(len(graph)), "x": total})

    if n < 3:
        return nodes.select(F.col(node).alias("node"), F.lit(0.0).alias("betweenness")).distinct()
    scale = n / len(chosen) / ((n - 1) * (n - 2))
    sums = spark.createDataFrame([(s,) for s in chosen], "s int").repartition(8).mapInPandas(run, "i int, x double").groupBy("i").agg((F.sum("x") * scale).alias("betweenness"))
    ids = spark.createDataFrame(list(enumerate(names)), ["i", "node"])
    return ids.join(sums, "i").select("node", "betweenness")
