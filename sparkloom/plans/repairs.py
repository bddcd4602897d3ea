"""Queries of the repair of cluster tables (N14, N15, N16, N19), their collapse (A42), actions and tow rule (F43, F44), explained weights (F54), and the chain from K10 to the score."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import columns as c
from ..functions import tables as t
from ..operators import repairs, scoring
from ..operators.checkpoint import cut
from ..operators.cluster import st_dbscan
from ..sources.adapter import approved_or_all
from .hotspots import _CCS, _LOAD, _sql_norm, ccs, load_table
from .registry import CTES, cluster_events, events, query
from .scores import _BAND, _METRICS, _VULNERABLE, _sum, metrics

r = c.rounded


# ---- repairs --------------------------------------------------------------------------------------------------------

#: Gaps by id, as the events leave none: (column, SQL that Spark and DuckDB both read).
_GAPS = {
    "severity_sum": "CASE WHEN k % 5 <> 0 THEN CAST(severity_sum AS DOUBLE) END", "severity_mean": "CASE WHEN k % 5 <> 1 THEN severity_mean END", "lam": "CASE WHEN k % 4 <> 0 THEN lam END",
    "mu": "CASE WHEN k % 3 <> 0 THEN mu END", "dwell": "CASE WHEN k % 6 <> 0 THEN 60 / mu END", "load": "CASE WHEN k % 2 = 1 THEN load END",
    "lanes": "CAST(CASE k % 3 WHEN 0 THEN 3 WHEN 2 THEN 1 END AS DOUBLE)", "carriageway": "CASE WHEN k % 2 = 0 THEN CAST(9 AS DOUBLE) END", "road": "CASE k % 4 WHEN 0 THEN 'primary' WHEN 1 THEN 'residential' WHEN 2 THEN 'footway' END",
    "base": "CASE WHEN k % 4 = 0 THEN CAST(3200 AS DOUBLE) END", "reduced": "CASE WHEN k % 3 = 0 THEN CAST(2000 AS DOUBLE) END",
}
#: What the table tells of loss, delay and the road graph: in one case something, in the other nothing.
_TOLD = {
    "kept": {"loss": "CASE WHEN k % 7 <> 0 THEN CAST(k % 9 AS DOUBLE) END", "delay": "CASE WHEN k % 8 <> 0 THEN CAST(1 + k % 6 AS DOUBLE) END", "degree": "CASE WHEN k % 7 <> 0 THEN CAST(k % 5 AS DOUBLE) END", "centrality": "CAST(k % 10 AS DOUBLE)"},
    "rebuilt": {"loss": "CASE WHEN k % 2 = 0 THEN CAST(95 AS DOUBLE) END", "delay": "CAST(k % 2 AS DOUBLE)", "degree": "CAST(3 AS DOUBLE)", "centrality": "CAST(NULL AS DOUBLE)"},
}
_FILLED = ("lam", "dwell", "mu", "load", "delay", "severity_sum", "severity_mean", "loss", "base", "reduced")
_REPAIRED_OUT = (*_FILLED, "lanes", "carriageway", "effective", "criticality_factor")
_LANE = " ".join(f"WHEN '{k}' THEN CAST({v} AS DOUBLE)" for k, v in t.LANE_CAPACITY.items())


def _norm0(k: str, table: str) -> str:
    return f"coalesce({_sql_norm(k, table)}, 0)"


def _repaired_sql(case: str) -> str:
    gaps = ", ".join(f"{x} AS {k}" for k, x in (_GAPS | _TOLD[case]).items())
    return f"""WITH {_LOAD}, r0 AS (SELECT cluster_id AS k, * EXCLUDE (cluster_id) FROM l), rin AS (SELECT k, records, vehicles, peak_records, distinct_days, {gaps} FROM r0),
 r1 AS (SELECT * REPLACE (coalesce(severity_sum, severity_mean * greatest(records, 1)) AS severity_sum, coalesce(severity_mean, severity_sum / greatest(records, 1)) AS severity_mean, coalesce(lam, peak_records / (greatest(distinct_days, 1) * 5.0)) AS lam,
  coalesce(mu, 60 / (dwell + 1e-9)) AS mu, coalesce(lanes, CASE WHEN carriageway IS NOT NULL THEN greatest(1, round_even(carriageway / 3.5, 0)) END) AS lanes, coalesce(carriageway, CASE WHEN lanes IS NOT NULL THEN greatest(lanes, 1) * 3.5 END) AS carriageway) FROM rin),
 r2 AS (SELECT * REPLACE (coalesce(load, lam / (mu + 1e-9)) AS load, coalesce(base, (CASE road {_LANE} ELSE CAST(1600 AS DOUBLE) END) * greatest(coalesce(lanes, 1), 1)) AS base) FROM r1),
 r3 AS (SELECT *, coalesce(load, 0) AS load0, coalesce(severity_sum, 0) AS severity0, lam / (mu + 1e-9) AS used FROM r2),
 rs AS (SELECT median(used) AS used_m, median(mu) AS mu_m, median(dwell) AS dwell_m, count(DISTINCT loss) AS losses, count(DISTINCT delay) AS delays, median(delay) AS delay_m FROM r3),
 r4 AS (SELECT r3.*, rs.*, {_norm0('load0', 'r3')} AS nl, {_norm0('severity0', 'r3')} AS ns, {_norm0('records', 'r3')} AS nr FROM r3, rs),
 r5 AS (SELECT * REPLACE (CASE WHEN losses <= 1 THEN least(greatest(100 * (0.40 * least(greatest(least(greatest(coalesce(used, used_m, 0), 0), 5) / 1.5, 0), 1) + 0.25 * nl + 0.20 * ns + 0.15 * nr), 0), 95) ELSE loss END AS loss,
  CASE WHEN delays <= 2 OR coalesce(delay_m, 0) < 0.05 THEN least(greatest(least(greatest(coalesce(dwell, dwell_m, 2), 0.5), 180) * (1 + 0.4 * ns + 0.3 * nl) * (1 + greatest(least(greatest(coalesce(lam, 0), 0) / (greatest(coalesce(mu, mu_m, 1), 0.1) + 1e-9), 5) - 1, 0)), 0.5), 60) ELSE delay END AS delay) FROM r4),
 r6 AS (SELECT * REPLACE (coalesce(reduced, base * (1 - coalesce(loss, 0) / 100)) AS reduced) FROM r5),
 r7 AS (SELECT * REPLACE ({', '.join(f'coalesce({k}, 0) AS {k}' for k in _FILLED)}), reduced AS effective, coalesce(degree, (SELECT median(degree) FROM r6)) AS fd, coalesce(centrality, (SELECT median(centrality) FROM r6)) AS fc, (SELECT count(DISTINCT degree) FROM r6) AS kd, (SELECT count(DISTINCT centrality) FROM r6) AS kc FROM r6),
 r8 AS (SELECT *, CASE WHEN kd > 1 OR kc > 1 THEN 1 + 0.55 * CASE WHEN kd > 1 THEN {_norm0('fd', 'r7')} ELSE 0 END + 0.45 * CASE WHEN kc > 1 THEN {_norm0('fc', 'r7')} ELSE 0 END
  ELSE 1 + 0.5 * least(1, 0.30 * {_norm0('records', 'r7')} + 0.20 * {_norm0('vehicles', 'r7')} + 0.20 * {_norm0('load', 'r7')} + 0.15 * {_norm0('loss', 'r7')} + 0.15 * {_norm0('severity_sum', 'r7')}) END AS criticality_factor FROM r7)
SELECT k AS cluster_id, {', '.join(f'round({x}, 5) + 0.0 AS {x}' for x in _REPAIRED_OUT)} FROM r8"""


def _repaired(spark, d, case: str) -> DataFrame:
    x = cut(load_table(cluster_events(spark, d))).withColumn("k", F.col("cluster_id"))
    x = x.select("cluster_id", "records", "vehicles", "peak_records", "distinct_days", *(F.expr(sql).alias(k) for k, sql in (_GAPS | _TOLD[case]).items()))
    return repairs.criticality(cut(repairs.repaired(x))).select("cluster_id", *(r(k, 5).alias(k) for k in _REPAIRED_OUT))


@query("N14_N16_repaired", _repaired_sql("kept"), "c")
def _(spark, d):
    return _repaired(spark, d, "kept")


@query("N14_N15_N16_rebuilt", _repaired_sql("rebuilt"), "c")
def _(spark, d):
    return _repaired(spark, d, "rebuilt")


@query("N19_feature_defaults", f"""WITH {_METRICS} SELECT cluster_id, greatest(growth_pct_change, 0) + 0.0 AS resurgence_score, round(100 * {_sum(t.PERSISTENCE_WEIGHTS)}, 5) + 0.0 AS persistence_score, validation_uncertainty, CAST(0 AS DOUBLE) AS anomaly_score,
 round(context_multiplier - 1, 6) + 0.0 AS context_boost, FALSE AS layer_b_alert_flag FROM mt""", "w")
def _(spark, d):
    x = repairs.feature_defaults(metrics(spark, d).drop("resurgence_score", "persistence_score", "anomaly_score", "layer_b_alert_flag"))
    return x.select("cluster_id", "resurgence_score", r("persistence_score", 5).alias("persistence_score"), "validation_uncertainty", "anomaly_score", r("context_boost").alias("context_boost"), "layer_b_alert_flag")


# ---- collapse -------------------------------------------------------------------------------------------------------

#: Columns that the scores' table has; the others are made from ids, with gaps.
_HAS = (
    "ccs_score", "delay", "records", "distinct_days", "severity_sum", "growth_pct_change", "growth_multiplier", "risk_band", "resurgence_score", "persistence_score", "anomaly_score", "rop", "tvs", "vdi", "validation_uncertainty",
    "context_multiplier", "layer_b_priority_boost", "nearby_sensitive_poi_count", "spillover_out_score", "spillover_in_score", "spillover_total_score", "road_node_betweenness", "network_pagerank",
)
_KIND = {k: "flag" if way == "any" else "text" if way == "top" else "number" for (way, _), names in t.COLLAPSE_RULES.items() for k in names}
_MADE = {
    k: f"CASE WHEN cluster_id % 6 <> 0 THEN " + {"flag": f"cluster_id % {i % 3 + 3} = 0", "text": f"concat('x', CAST(cluster_id % {i + 3} AS VARCHAR(9)))", "number": f"CAST(cluster_id * {i + 3} % 11 AS DOUBLE) / 2"}[_KIND[k]] + " END"
    for i, k in enumerate(x for x in _KIND if x not in _HAS)
}
_TOP = "ORDER BY ccs_score DESC, delay DESC, records DESC, cluster_id"


def _collapse_sql() -> str:
    lit = lambda v: f"'{v}'" if isinstance(v, str) else str(v).upper()
    out = []
    for (way, instead), names in t.COLLAPSE_RULES.items():
        for k in names:
            x = k if instead is None else f"coalesce({k}, {lit(instead)})"
            got = {"max": f"max({x})", "sum": f"sum({x})", "mean": f"avg({x})", "any": f"bool_or({x})", "top": f"first({x} {_TOP})", "first": f"first({x} ORDER BY cluster_id)"}[way]
            out.append(f"round(CAST({got} AS DOUBLE), 5) + 0.0 AS {k}" if _KIND[k] == "number" else f"{got} AS {k}")
    made = ", ".join(f"{x} AS {k}" for k, x in _MADE.items())
    return f"""WITH {_METRICS}, pl AS (SELECT concat('P', CAST(cluster_id % 5 AS VARCHAR)) AS place, cluster_id, {', '.join(_HAS)}, {made} FROM mt)
SELECT place, array_to_string(list_sort(list(DISTINCT CAST(cluster_id AS VARCHAR))), '|') AS merged_ids, first(cluster_id {_TOP}) AS cluster_id, {', '.join(out)} FROM pl GROUP BY 1"""


@query("A42_collapse", _collapse_sql(), "w")
def _(spark, d):
    x = metrics(spark, d).select(F.expr("concat('P', cluster_id % 5)").alias("place"), "cluster_id", *_HAS, *(F.expr(sql).alias(k) for k, sql in _MADE.items()))
    out = repairs.collapse(x, "place")
    return out.select("place", "merged_ids", "cluster_id", *(r(F.col(k).cast("double"), 5).alias(k) if kind == "number" else F.col(k) for k, kind in _KIND.items()))


# ---- actions, tow rule, explanations --------------------------------------------------------------------------------

_ROADS = {"road": "CASE cluster_id % 3 WHEN 0 THEN 'primary' WHEN 1 THEN 'Service' END", "width": "CASE WHEN cluster_id % 2 = 0 THEN CAST(9 AS DOUBLE) END", "lanes": "CASE WHEN cluster_id % 4 = 0 THEN 2 ELSE 4 END", "patrols": "cluster_id % 4"}


def _actions_sql(band: str, wording: dict) -> str:
    return f"CASE {band} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in wording.items()) + " ELSE 'Routine monitoring' END"


@query("F43_F44_dispatch", f"""WITH {_VULNERABLE}, pp AS (SELECT *, round(100 * least(1, greatest(0, {_sum(t.PRIORITY_WEIGHTS)} / {sum(t.PRIORITY_WEIGHTS.values())})), 6) AS s, {', '.join(f'{x} AS {k}' for k, x in _ROADS.items())} FROM vu), pb AS (SELECT *, {_BAND.format(x='s')} AS priority_band FROM pp),
 pf AS (SELECT *, CASE WHEN priority_band IN ('Moderate', 'Watch') AND future_risk_band = 'High' THEN 'High' ELSE priority_band END AS final_risk_band, (SELECT quantile_cont(road_node_betweenness, 0.75) FROM pb) AS central FROM pb),
 pt AS (SELECT *, (s >= 70 OR final_risk_band IN ('Critical', 'High') OR probability_of_escalation >= 0.5) AND (coalesce(lower(road), 'road') IN ('motorway', 'trunk', 'primary', 'secondary', 'tertiary', 'road') OR coalesce(width, 7) <= 7.5 OR lanes <= 2 OR road_node_betweenness >= central)
  AND (chronic_vehicles >= 1 OR repeat_vehicles >= 3 OR s >= 80) AS tow FROM pf)
SELECT cluster_id, tow, {_actions_sql('risk_band', c.HOTSPOT_ACTIONS)} AS action, {_actions_sql('final_risk_band', c.FORECAST_ACTIONS)} AS forecast_action,
 CASE final_risk_band WHEN 'Critical' THEN CASE WHEN tow THEN 'Immediate patrol + tow standby + camera watch' ELSE 'Immediate patrol deployment' END WHEN 'High' THEN CASE WHEN tow THEN 'Targeted patrol + tow readiness' ELSE 'Targeted patrol + close monitoring' END
  WHEN 'Moderate' THEN CASE WHEN patrols >= 2 THEN 'Scheduled patrol + peak-window checks' ELSE 'Peak-window checks' END ELSE 'Routine monitoring' END AS dispatch_action FROM pt""", "w")
def _(spark, d):
    x = scoring.priority(scoring.vulnerability(scoring.source_pressure(metrics(spark, d))))
    x = scoring.with_stats(cut(x.withColumns({k: F.expr(sql) for k, sql in _ROADS.items()})), central=F.percentile("road_node_betweenness", 0.75))
    tow = c.tow_required(F.round("priority_score", 6), "final_risk_band", "probability_of_escalation", "road", "width", "lanes", F.col("road_node_betweenness") >= F.col("central"), "chronic_vehicles", "repeat_vehicles")
    x = x.withColumn("tow", tow)
    return x.select("cluster_id", "tow", c.action("risk_band").alias("action"), c.action("final_risk_band", c.FORECAST_ACTIONS).alias("forecast_action"), c.dispatch_action("final_risk_band", "tow", "patrols").alias("dispatch_action"))


@query("F54_explained_weights", f"""WITH {_METRICS}, x AS (SELECT cluster_id, [delay, lam, CAST(severity_sum AS DOUBLE), growth_multiplier, criticality_factor] AS v FROM mt), n AS (SELECT cluster_id, list_max(v) > list_min(v) AS varied, list_transform(v, lambda y: (y - list_min(v)) / (list_max(v) - list_min(v) + 1e-9)) AS n FROM x)
SELECT cluster_id, {', '.join(f"CASE WHEN varied THEN round(100 * n[{i}] / (list_sum(n) + 1e-9), 4) + 0.0 ELSE CAST(20 AS DOUBLE) END AS w{i}" for i in range(1, 6))} FROM n""", "w")
def _(spark, d):
    parts = c.explained(["delay", "lam", "severity_sum", "growth_multiplier", "criticality_factor"])
    return metrics(spark, d).select("cluster_id", *(r(F.get(parts, F.lit(i)), 4).alias(f"w{i + 1}") for i in range(5)))


# ---- from clustering to the score -----------------------------------------------------------------------------------

#: Labels of K10 under the names of the later stages: c holds the events with their cluster, w their weekly counts.
_CHAIN = f"""ka AS (SELECT * FROM e WHERE status = 'approved'), km AS (SELECT avg(latitude) AS la, avg(longitude) AS lo FROM ka),
 kp AS (SELECT id, 6371000 * radians(longitude - lo) * cos(radians(la)) AS x, 6371000 * radians(latitude - la) AS y, epoch_us(created_datetime) / 1e6 / 86400 AS days FROM ka, km),
 kn AS (SELECT s.id AS p, o.id AS q FROM kp s JOIN kp o ON abs(s.x - o.x) <= 150 AND abs(s.days - o.days) <= 3 AND pow(s.x - o.x, 2) + pow(s.y - o.y, 2) <= 22500),
 kc AS (SELECT p FROM kn GROUP BY p HAVING count(*) >= 15), ke AS (SELECT kn.p, q FROM kn JOIN kc ON kc.p = kn.p JOIN kc o ON o.p = kn.q),
 kr AS (SELECT p AS node, p AS far FROM kc UNION SELECT kr.node, ke.q FROM kr JOIN ke ON ke.p = kr.far), kt AS (SELECT node, min(far) AS t FROM kr GROUP BY 1),
 ku AS (SELECT t, row_number() OVER (ORDER BY min({{'d': days, 'i': id}})) AS cid FROM kt JOIN kp ON kp.id = kt.node GROUP BY t), kl AS (SELECT node, cid FROM kt JOIN ku USING (t)),
 kb AS (SELECT kn.p AS id, min(cid) AS cid FROM kn JOIN kl ON kl.node = kn.q GROUP BY 1),
 c AS (SELECT ka.*, CAST(coalesce(kl.cid, kb.cid) AS BIGINT) AS cluster_id FROM ka LEFT JOIN kl ON kl.node = ka.id LEFT JOIN kb ON kb.id = ka.id WHERE coalesce(kl.cid, kb.cid) IS NOT NULL), w AS ({CTES['w']})"""


@query("K10_N07_N08_chain", f"WITH {_CHAIN}, {_CCS} SELECT cluster_id, records, round(ccs_score, 5) + 0.0 AS ccs_score, band FROM cc", "e")
def _(spark, d):
    """K10's clusters, without noise, through dwell, load and delay to the score and its bands."""
    ev = approved_or_all(events(spark, d)).withColumn("days", F.unix_micros("created_datetime") / 1e6 / 86400)
    found = cut(st_dbscan(ev.select("id", "latitude", "longitude", "days")).where("cluster_id <> -1").select("id", "cluster_id"))
    return ccs(ev.join(found, "id")).select("cluster_id", "records", r("ccs_score", 5).alias("ccs_score"), "band")
