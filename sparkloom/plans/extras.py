"""Round trips through files, display and repair rules, splits, scalers, streams."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import columns as c
from ..functions import tables as t
from ..operators import aggs as a
from ..operators import forecast, joins, scoring
from ..operators.checkpoint import shared_dir
from ..operators.cluster import robust_scaled
from ..sources import readers
from ..sources.adapter import violations
from ..streaming import events as stream
from .hotspots import _CENTRES, _DIST, _SUMMARY, centres, cluster_summary, spillover
from .registry import cluster_events, query

r = c.rounded


@query("S01_S06_T01_csv_round_trip", "SELECT CAST(id AS VARCHAR) AS id, round(latitude, 6) + 0.0 AS latitude, violation_type, police_station FROM v", "v")
def _(spark, d):
    to = f"{shared_dir(spark)}/events.csv"
    readers.write(violations(spark, d).select(*readers.REQUIRED), to, "csv")
    got, _ = readers.first_existing(spark, [f"{to}.missing", to], schema=readers.RAW_EVENTS)
    return readers.require(got).select("id", r("latitude").alias("latitude"), "violation_type", "police_station")


@query("S02_S04_S07_S08_bundle", "SELECT cluster_id, records FROM (" + _SUMMARY + ")", "c")
def _(spark, d):
    top = shared_dir(spark)
    readers.write(cluster_summary(cluster_events(spark, d)).select("cluster_id", "records"), f"{top}/clusters.parquet")
    return readers.bundle(spark, top, ["clusters", "forecast"])["clusters"]


@query("S09_S11_T07_road_graph", f"WITH {_CENTRES} SELECT cluster_id AS node_id, (SELECT count(*) FROM ctr b WHERE b.cluster_id <> a.cluster_id AND {_DIST.format(a='a', b='b')} <= 1200) AS degree FROM ctr a", "c")
def _(spark, d):
    top, ev = shared_dir(spark), cluster_events(spark, d)
    readers.write(centres(ev).select(F.col("cluster_id").alias("node_id"), "lat", "lon"), f"{top}/nodes.parquet")
    readers.write(spillover(ev).select(F.col("src").alias("u"), F.col("dst").alias("v"), F.col("distance_m").alias("length_m")), f"{top}/edges.parquet")
    nodes, edges = readers.road_graph(spark, top)
    degree = readers.cached(spark, f"{top}/degree.parquet", lambda: edges.groupBy(F.col("u").alias("node_id")).agg(F.count("*").alias("degree")))
    return nodes.join(degree, "node_id", "left").select("node_id", F.coalesce("degree", F.lit(0).cast("long")).alias("degree"))


@query("F31_F52_display", f"SELECT cluster_id, printf('%,.2f', CAST(records AS DOUBLE)) AS shown, 'score=' || printf('%.1f', CAST(records AS DOUBLE)) || ' | window=07:00-10:00' AS notes FROM ({_SUMMARY})", "c")
def _(spark, d):
    return _display(cluster_summary(cluster_events(spark, d)))


def _display(x):
    return x.select("cluster_id", c.shown("records").alias("shown"), F.concat_ws(" | ", F.format_string("score=%.1f", F.col("records").cast("double")), F.concat(F.lit("window="), c.time_window(F.lit(8)))).alias("notes"))


@query("F50_corridor_ratios", f"""WITH s AS ({_SUMMARY}), x AS (SELECT cluster_id, 250.0 * 60 / (30.0 * 1000) AS free, severity_mean AS eta, days AS model FROM s)
SELECT cluster_id, round(eta / (free + 1e-9), 6) + 0.0 AS ratio, round(100 * model / (free + 1e-9), 4) + 0.0 AS delay_pct FROM x""", "c")
def _(spark, d):
    x = cluster_summary(cluster_events(spark, d)).withColumn("free", c.free_flow_minutes(F.lit(250.0), F.lit(30.0)))
    return x.select("cluster_id", r(c.ratio("severity_mean", "free")).alias("ratio"), r(100 * c.ratio("days", "free"), 4).alias("delay_pct"))


@query("J06_J07_U03_weekly_with_scores", f"SELECT cluster_id, CAST(week_start AS VARCHAR) AS week_start, n, records, n >= 5 AS busy FROM w JOIN ({_SUMMARY}) USING (cluster_id)", "w")
def _(spark, d):
    ev = cluster_events(spark, d)
    out = joins.fill_from(a.weekly(ev, "cluster_id"), cluster_summary(ev).select("cluster_id", "records"), "cluster_id")
    return out.withColumns({"busy": F.col("n") >= 5, "week_start": F.col("week_start").cast("string")}).select("cluster_id", "week_start", "n", "records", "busy")


@query("K12_robust_scaled", "WITH g AS (SELECT cluster_id, CAST(count(*) AS DOUBLE) AS n FROM c GROUP BY 1), q AS (SELECT quantile_cont(n, 0.25) AS a, quantile_cont(n, 0.5) AS b, quantile_cont(n, 0.75) AS z FROM g) SELECT cluster_id, round((n - b) / CASE WHEN z = a THEN 1 ELSE z - a END, 6) + 0.0 AS n FROM g, q", "c")
def _(spark, d):
    g = cluster_events(spark, d).groupBy("cluster_id").agg(F.count("*").cast("double").alias("n"))
    return robust_scaled(g, ["n"]).select("cluster_id", r("n").alias("n"))


@query("K23_temporal_split", "WITH d AS (SELECT week_start, row_number() OVER (ORDER BY week_start) AS i, count(*) OVER () AS n FROM (SELECT DISTINCT week_start FROM w)) SELECT cluster_id, CAST(week_start AS VARCHAR) AS week_start, i > d.n - greatest(1, CAST(round_even(d.n * 0.2, 0) AS INTEGER)) AS is_test FROM w JOIN d USING (week_start)".replace("i > d.n", "d.i > d.n"), "w")
def _(spark, d):
    w = a.weekly(cluster_events(spark, d), "cluster_id").select("cluster_id", "week_start")
    return forecast.temporal_split(w, "week_start").select("cluster_id", F.col("week_start").cast("string").alias("week_start"), "is_test")


@query("W16_running_total", "SELECT cluster_id, CAST(week_start AS VARCHAR) AS week_start, CAST(sum(n) OVER (PARTITION BY cluster_id ORDER BY week_start) AS BIGINT) AS total FROM w", "w")
def _(spark, d):
    w = Window.partitionBy("cluster_id").orderBy("week_start")
    return a.weekly(cluster_events(spark, d), "cluster_id").select("cluster_id", F.col("week_start").cast("string").alias("week_start"), F.sum("n").over(w).alias("total"))


@query("J13_J16_click", f"WITH {_CENTRES}, k AS (SELECT cluster_id, pow(lat - 12.95, 2) + pow(lon - 77.505, 2) AS z FROM ctr) SELECT cluster_id FROM k ORDER BY z, cluster_id LIMIT 1", "c")
def _(spark, d):
    x = centres(cluster_events(spark, d))
    return x.orderBy(F.pow(F.col("lat") - 12.95, 2) + F.pow(F.col("lon") - 77.505, 2), "cluster_id").limit(1).select("cluster_id")


def _streamed(spark, d, make):
    """What a stream over the events' files writes in one run, read back."""
    top, v = shared_dir(spark), violations(spark, d)
    v.write.parquet(f"{top}/in")
    out = make(stream.event_stream(spark, f"{top}/in", v.schema))
    stream.write_table(out, f"{top}/out", f"{top}/state").awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{top}/out")


@query("stream_weekly_counts", """WITH g AS (SELECT police_station, date_trunc('week', created_datetime) AS s, count(*) AS n FROM v GROUP BY 1, 2) SELECT police_station, strftime(s, '%Y-%m-%d') AS week_start, n FROM g WHERE s + INTERVAL 7 DAY <= (SELECT max(created_datetime) FROM v) - INTERVAL 7 DAY""", "v")
def _(spark, d):
    got = _streamed(spark, d, lambda s: stream.weekly_counts(s, "police_station"))
    return got.select("police_station", F.date_format("week_start", "yyyy-MM-dd").alias("week_start"), "n")


@query("stream_sessions")
def _(spark, d):
    got = _streamed(spark, d, lambda s: stream.sessions(s, ["vehicle_number", "site"]))
    return got.select("vehicle_number", "site", "n", r("dwell_minutes").alias("dwell_minutes"))
