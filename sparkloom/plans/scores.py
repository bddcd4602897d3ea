"""Composite scores by cluster (N12, N13, N14, N17, N18, N20, N22, N23, N25), with all of their components."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import columns as c
from ..functions import tables as t
from ..operators import aggs as a
from ..operators import scoring
from ..operators.checkpoint import cut
from .hotspots import _CCS, _EDGES, _ROBUST, _TREND, _WEEKS, ccs, spillover, trends, weekly_features
from .registry import cluster_events, events, query

r = c.rounded


def metrics(spark, d) -> DataFrame:
    """One row per cluster with the components of the scores, under their names.

    What the events can't tell (answers of outside services) comes from the id; the share of escalating weeks and the mean of
    four-week means stand for the forecasts, the neighbours' influence for betweenness.
    """
    ev = cluster_events(spark, d)
    x = ccs(ev).select("cluster_id", "ccs_score", F.col("band").alias("risk_band"), "delay", F.col("growth").alias("growth_pct_change"), F.col("multiplier").alias("growth_multiplier"), "records", "severity_sum", "distinct_days", "lam")
    tr = trends(ev).select("cluster_id", "recent", "slope", "peak_ratio", F.col("volatility").alias("tvs"), F.col("resurgence").alias("resurgence_score"))
    days = ev.agg((F.date_diff(F.max("service_date"), F.min("service_date")) + 1).alias("span"))
    tags = a.entropy(ev.select("cluster_id", F.explode("tags").alias("tag")).groupBy("cluster_id", "tag").agg(F.count("*").alias("n")), "cluster_id").withColumnRenamed("diversity", "vdi")
    seen = events(spark, d).groupBy((F.col("site") + 1).cast("long").alias("cluster_id")).agg(F.count("*").alias("total"), F.count_if(F.col("status") != "").alias("present"), F.count_if(F.col("status") == "approved").alias("ok"))
    seen = seen.select("cluster_id", c.clip(1 - c.ratio("present", "total") * F.coalesce(F.col("ok") / (F.nullif("present", F.lit(0)) + t.EPS), F.lit(0.0)), 0.0, 1.0).alias("validation_uncertainty"))
    weeks = weekly_features(ev).groupBy("cluster_id").agg(F.avg(F.col("escalation").cast("double")).alias("probability_of_escalation"), F.avg("mean4").alias("predicted_next_week_ccs_score"), F.max_by("pressure", "week_start").alias("current_week_ccs_proxy_score"))
    vehicles = ev.groupBy("cluster_id", "vehicle_number").agg(F.count("*").alias("n")).groupBy("cluster_id").agg(F.count_if(F.col("n") >= 2).alias("repeat_vehicles"), F.count_if(F.col("n") >= 5).alias("chronic_vehicles"))
    e = spillover(ev)
    out = e.groupBy(F.col("src").alias("cluster_id")).agg(F.sum("weight").alias("spillover_out_score"), F.count_distinct("dst").alias("degree"))
    into = e.groupBy(F.col("dst").alias("cluster_id")).agg(F.sum("weight").alias("spillover_in_score"))
    x = x.join(tr, "cluster_id").join(tags, "cluster_id", "left").join(seen, "cluster_id", "left").join(weeks, "cluster_id").join(vehicles, "cluster_id").join(out, "cluster_id", "left").join(into, "cluster_id", "left").crossJoin(F.broadcast(days))
    x = x.fillna(0.0, ["vdi", "spillover_out_score", "spillover_in_score"]).fillna(0, ["degree"])
    x = x.withColumns({"rop": c.ratio("distinct_days", "span"), "persistence_score": c.ratio("distinct_days", "span"), "spillover_total_score": F.col("spillover_out_score") + F.col("spillover_in_score"), "road_node_betweenness": F.col("spillover_in_score")})
    x = x.withColumns({k: F.round(k, 9) for k in _ROUNDED})
    x = x.withColumns({
        "layer_b_priority_boost": (F.col("cluster_id") % 5) * 0.1, "context_multiplier": 1 + (F.col("cluster_id") % 4) * 0.2, "anomaly_score": (F.col("cluster_id") % 7) / 7, "network_pagerank": F.col("spillover_total_score"),
        "nearby_sensitive_poi_count": F.col("cluster_id") % 3, "future_risk_band": F.when(F.col("cluster_id") % 6 == 0, "High").otherwise("Watch"),
    })
    # N14
    x = scoring.minmax(x, ["degree", "road_node_betweenness"])
    return cut(x.withColumn("criticality_factor", F.round(1 + 0.5 * F.col("degree_norm") + 0.5 * F.col("road_node_betweenness_norm"), 9)).drop("degree_norm", "road_node_betweenness_norm"))


_ROUNDED = ("ccs_score", "delay", "growth_pct_change", "growth_multiplier", "recent", "slope", "peak_ratio", "tvs", "resurgence_score", "vdi", "validation_uncertainty", "probability_of_escalation", "predicted_next_week_ccs_score", "current_week_ccs_proxy_score", "spillover_out_score", "spillover_in_score", "spillover_total_score", "road_node_betweenness", "rop", "persistence_score")
_OWN = re.sub(r"\b([hqg])\b", r"t\1", _TREND).replace("WITH ", "", 1)
_WK = re.sub(r"\bg\b", "gw", _WEEKS)
_METRICS = f"""{_CCS}, {_OWN}, {_WK}, {_EDGES},
vt AS (SELECT cluster_id, tag, count(*) AS n FROM (SELECT cluster_id, unnest(tags) AS tag FROM c) GROUP BY 1, 2), vp AS (SELECT cluster_id, n / sum(n) OVER (PARTITION BY cluster_id) AS p FROM vt),
vd AS (SELECT cluster_id, CASE WHEN count(*) <= 1 THEN 0 ELSE sum(-p * ln(p + 1e-9)) / ln(count(*) + 1e-9) END AS vdi FROM vp GROUP BY 1),
un AS (SELECT site + 1 AS cluster_id, count(*) AS total, count(*) FILTER (status <> '') AS present, count(*) FILTER (status = 'approved') AS ok FROM e GROUP BY 1),
wk AS (SELECT cluster_id, avg(CAST(escalation AS DOUBLE)) AS probability_of_escalation, avg(mean4) AS predicted_next_week_ccs_score, max_by(pressure, week_start) AS current_week_ccs_proxy_score FROM gw GROUP BY 1),
vh AS (SELECT cluster_id, count(*) FILTER (n >= 2) AS repeat_vehicles, count(*) FILTER (n >= 5) AS chronic_vehicles FROM (SELECT cluster_id, vehicle_number, count(*) AS n FROM c GROUP BY 1, 2) GROUP BY 1),
ou AS (SELECT src AS cluster_id, sum(weight) AS x, count(DISTINCT dst) AS degree FROM ed GROUP BY 1), inn AS (SELECT dst AS cluster_id, sum(weight) AS y FROM ed GROUP BY 1),
m0 AS (SELECT cluster_id, ccs_score, band AS risk_band, greatest(delay, 0) AS delay, cc.growth AS growth_pct_change, cc.multiplier AS growth_multiplier, records, severity_sum, distinct_days, lam, tr.recent, tr.slope, tr.peak_ratio, tr.volatility AS tvs, tr.resurgence AS resurgence_score, coalesce(vdi, 0) AS vdi,
 least(greatest(1 - (present / (total + 1e-9)) * coalesce(ok / (nullif(present, 0) + 1e-9), 0), 0), 1) AS validation_uncertainty, probability_of_escalation, predicted_next_week_ccs_score, current_week_ccs_proxy_score, repeat_vehicles, chronic_vehicles, coalesce(x, 0) AS spillover_out_score, coalesce(y, 0) AS spillover_in_score,
 coalesce(x, 0) + coalesce(y, 0) AS spillover_total_score, coalesce(y, 0) AS road_node_betweenness, coalesce(degree, 0) AS degree, distinct_days / ((SELECT date_diff('day', min(service_date), max(service_date)) + 1 FROM c) + 1e-9) AS rop, distinct_days / ((SELECT date_diff('day', min(service_date), max(service_date)) + 1 FROM c) + 1e-9) AS persistence_score
 FROM cc JOIN tr USING (cluster_id) LEFT JOIN vd USING (cluster_id) LEFT JOIN un USING (cluster_id) JOIN wk USING (cluster_id) JOIN vh USING (cluster_id) LEFT JOIN ou USING (cluster_id) LEFT JOIN inn USING (cluster_id)),
m1 AS (SELECT * REPLACE ({', '.join(f'round({k}, 9) AS {k}' for k in _ROUNDED)}), (cluster_id % 5) * CAST(0.1 AS DOUBLE) AS layer_b_priority_boost, 1 + (cluster_id % 4) * CAST(0.2 AS DOUBLE) AS context_multiplier, (cluster_id % 7) / 7 AS anomaly_score, cluster_id % 3 AS nearby_sensitive_poi_count,
 CASE WHEN cluster_id % 6 = 0 THEN 'High' ELSE 'Watch' END AS future_risk_band, greatest(round(growth_pct_change, 9), 0) AS growth_surge, (cluster_id % 4) * CAST(0.2 AS DOUBLE) AS context_boost, round(spillover_total_score, 9) AS network_pagerank FROM m0),
mt AS (SELECT *, round(1 + 0.5 * coalesce((degree - min(degree) OVER ()) / nullif(max(degree) OVER () - min(degree) OVER () + 1e-9, 0), 0) + 0.5 * coalesce((road_node_betweenness - min(road_node_betweenness) OVER ()) / (max(road_node_betweenness) OVER () - min(road_node_betweenness) OVER () + 1e-9), 0), 9) AS criticality_factor FROM m1)"""


def _norm(k: str) -> str:
    """Within 0 and 1 over all rows; null for a flat column."""
    return f"(CASE WHEN max({k}) OVER () > min({k}) OVER () THEN ({k} - min({k}) OVER ()) / (max({k}) OVER () - min({k}) OVER () + 1e-9) END)"


def _sum(weights: dict[str, float]) -> str:
    return "(" + " + ".join(f"{w} * coalesce({_norm(k)}, 0)" for k, w in weights.items()) + ")"


def _active(weights: dict[str, float]) -> str:
    total = " + ".join(f"CASE WHEN {_norm(k)} IS NULL THEN 0 ELSE {w} END" for k, w in weights.items())
    return f"coalesce(100 * least(1, greatest(0, {_sum(weights)} / nullif({total}, 0))), 0)"


_PRESSURE = f"{_METRICS}, pr1 AS (SELECT *, {_active(t.PRESSURE_WEIGHTS)} AS p0 FROM mt), ps AS (SELECT *, CASE WHEN max(p0) OVER () <> 0 THEN p0 WHEN max(ccs_score) OVER () > min(ccs_score) OVER () THEN 100 * {_norm('ccs_score')} ELSE 50.0 END AS source_pressure_score FROM pr1)"
_VULNERABLE = f"{_PRESSURE}, vu AS (SELECT *, {_active(t.VULNERABILITY_WEIGHTS)} AS network_vulnerability_score FROM ps)"
_BAND = "CASE WHEN {x} >= 80 THEN 'Critical' WHEN {x} >= 60 THEN 'High' WHEN {x} >= 40 THEN 'Moderate' ELSE 'Watch' END"


@query("N13_layer_c_index", f"WITH {_METRICS}, nn AS (SELECT cluster_id, {_sum(t.NOVELTY_WEIGHTS)} AS x FROM mt) SELECT cluster_id, round(x, 5) + 0.0 AS layer_c_index FROM nn", "w")
def _(spark, d):
    return scoring.novelty(metrics(spark, d)).select("cluster_id", r("layer_c_index", 5).alias("layer_c_index"))


@query("N17_source_pressure", f"WITH {_PRESSURE} SELECT cluster_id, round(source_pressure_score, 4) + 0.0 AS source_pressure_score FROM ps", "w")
def _(spark, d):
    return scoring.source_pressure(metrics(spark, d)).select("cluster_id", r("source_pressure_score", 4).alias("source_pressure_score"))


@query("N18_vulnerability", f"WITH {_VULNERABLE} SELECT cluster_id, round(network_vulnerability_score, 4) + 0.0 AS network_vulnerability_score FROM vu", "w")
def _(spark, d):
    return scoring.vulnerability(scoring.source_pressure(metrics(spark, d))).select("cluster_id", r("network_vulnerability_score", 4).alias("network_vulnerability_score"))


@query("N14_N20_priority", f"""WITH {_VULNERABLE}, pp AS (SELECT cluster_id, future_risk_band, 100 * least(1, greatest(0, {_sum(t.PRIORITY_WEIGHTS)} / {sum(t.PRIORITY_WEIGHTS.values())})) AS s FROM vu), pb AS (SELECT *, {_BAND.format(x='round(s, 6)')} AS priority_band FROM pp)
SELECT cluster_id, round(s, 4) + 0.0 AS priority_score, priority_band, CASE WHEN priority_band IN ('Moderate', 'Watch') AND future_risk_band = 'High' THEN 'High' ELSE priority_band END AS final_risk_band FROM pb""", "w")
def _(spark, d):
    x = scoring.priority(scoring.vulnerability(scoring.source_pressure(metrics(spark, d))))
    return x.select("cluster_id", r("priority_score", 4).alias("priority_score"), "priority_band", "final_risk_band")


@query("N22_N23_prescriptive", f"""WITH {_METRICS}, d1 AS (SELECT *, 100 * {_sum(t.DISPATCH_WEIGHTS)} AS dispatch_priority_score, {_sum(t.OFFENDER_WEIGHTS)} AS offender_pressure FROM mt),
 d2 AS (SELECT *, round(100 * ({_sum({k: w for k, w in t.PRESCRIPTIVE_WEIGHTS.items() if k != 'offender_pressure'})} + 0.04 * offender_pressure), 6) AS s FROM d1), dq AS (SELECT quantile_cont(s, 0.85) AS a, quantile_cont(s, 0.6) AS b, quantile_cont(s, 0.35) AS k FROM d2),
 d3 AS (SELECT *, risk_band IN ('Critical', 'High') OR future_risk_band IN ('Critical', 'High') OR probability_of_escalation >= 0.5 OR chronic_vehicles >= 1 AS tow_readiness FROM d2, dq)
SELECT cluster_id, round(dispatch_priority_score, 4) + 0.0 AS dispatch_priority_score, round(s, 4) + 0.0 AS phase8_priority_score, CASE WHEN s >= a THEN 'Tier 1' WHEN s >= b THEN 'Tier 2' WHEN s >= k THEN 'Tier 3' ELSE 'Tier 4' END AS tier, CASE WHEN s >= a THEN 3 WHEN s >= b THEN 2 ELSE 1 END AS patrols, tow_readiness,
 CASE WHEN tow_readiness THEN 'Tow standby + patrol' WHEN risk_band = 'Critical' THEN 'Immediate patrol deployment' WHEN risk_band = 'High' THEN 'Targeted enforcement' ELSE 'Routine monitoring' END AS prescriptive_action FROM d3""", "w")
def _(spark, d):
    x = scoring.prescriptive(metrics(spark, d))
    return x.select("cluster_id", r("dispatch_priority_score", 4).alias("dispatch_priority_score"), r("phase8_priority_score", 4).alias("phase8_priority_score"), "tier", "patrols", "tow_readiness", "prescriptive_action")


def _trend_features(spark, d) -> DataFrame:
    return cut(scoring.emerging_norms(metrics(spark, d).select("cluster_id", "recent", F.col("growth_pct_change").alias("growth"), "slope", F.col("resurgence_score").alias("resurgence"), "peak_ratio", "severity_sum", "records")))


_LOGGED = {"recent": "ln(1 + recent)", "growth": "growth_pct_change", "slope": "slope", "resurgence": "ln(1 + resurgence_score)", "peak_ratio": "peak_ratio", "severity_sum": "severity_sum", "records": "ln(1 + records)"}


@query("N25_emerging_norms", f"WITH {_METRICS}, rr AS (SELECT cluster_id, {', '.join(f'round({x}, 9) AS {k}_' for k, x in _LOGGED.items())} FROM mt) SELECT cluster_id, {', '.join(f'round({_ROBUST(k + chr(95))}, 5) + 0.0 AS {k}_norm' for k in _LOGGED)} FROM rr", "w")
def _(spark, d):
    return _trend_features(spark, d).select("cluster_id", *(r(f"{k}_norm", 5).alias(f"{k}_norm") for k in scoring.EMERGING))


@query("K11_N12_emerging")
def _(spark, d):
    """N12 with K11's anomaly over the scaled norms: no SQL, as the forest has none."""
    from ..operators.cluster import isolation_scores, robust_scaled

    x = _trend_features(spark, d)
    names = [f"{k}_norm" for k in scoring.EMERGING]
    found = isolation_scores(robust_scaled(x.select("cluster_id", *names), names), "cluster_id", names)
    return scoring.emerging(x.join(found, "cluster_id")).select("cluster_id", r("anomaly").alias("anomaly"), r("emerging_hotspot_score", 4).alias("emerging_hotspot_score"))
