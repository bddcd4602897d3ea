"""Profile and severity stages: scalar functions on events, value counts, rates, summaries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import columns as c
from ..functions import tables as t
from ..operators import aggs as a
from ..operators import joins
from ..sources.adapter import approved_or_all, violations
from .registry import cluster_events, events, query, sql_mode

r = c.rounded


def _case(column: str, values: dict, default, quote: bool = False) -> str:
    q = (lambda x: f"'{x}'") if quote else (lambda x: f"CAST({x} AS DOUBLE)")
    return f"CASE {column} {' '.join(f'WHEN {chr(39)}{k}{chr(39)} THEN {q(v)}' for k, v in values.items())} ELSE {q(default)} END"


@query("S05_P03_required_columns", "SELECT count(*) AS n FROM v WHERE latitude IS NOT NULL AND longitude IS NOT NULL AND created_datetime IS NOT NULL", "v")
def _(spark, d):
    from ..sources.readers import require

    return require(violations(spark, d)).na.drop(subset=["latitude", "longitude", "created_datetime"]).agg(F.count("*").alias("n"))


@query("F01_F08_text", r"""SELECT id, trim(junction_name) AS junction, upper(replace(trim(police_station), '&', 'AND')) AS station_tag, tag_count, severity_exact, severity, first_tag,
  coalesce(tags[1], 'NO PARKING') AS dominant, hotspot_unit, array_to_string(tags, '|') AS tags FROM e""")
def _(spark, d):
    e = events(spark, d)
    return e.select("id", c.clean_text("junction_name").alias("junction"), c.normalize_tag("police_station").alias("station_tag"), "tag_count", "severity_exact", "severity", "first_tag",
                    c.dominant_matched(F.col("tags")).alias("dominant"), "hotspot_unit", F.array_join("tags", "|").alias("tags"))


@query("F09_F15_time_and_flags", """SELECT id, strftime(local_ts, '%Y-%m-%d %H:%M:%S') AS local_ts, hour, day_name, month, is_weekend, CAST(week_start AS VARCHAR) AS week_start, CAST(service_date AS VARCHAR) AS service_date, peak, validation_score,
  CASE WHEN severity = 5 THEN 1 ELSE 0 END AS very_high, severity / 5.0 + 0.0 AS severity_norm FROM e""")
def _(spark, d):
    return events(spark, d).select("id", F.date_format("local_ts", "yyyy-MM-dd HH:mm:ss").alias("local_ts"), "hour", "day_name", "month", "is_weekend", F.col("week_start").cast("string").alias("week_start"), F.col("service_date").cast("string").alias("service_date"), "peak", "validation_score",
                                   (F.col("severity") == 5).cast("int").alias("very_high"), (F.col("severity") / 5).alias("severity_norm"))


@query("F16_F19_F55_fallbacks_and_numbers", """SELECT id, CASE WHEN id % 3 = 0 THEN 'U' || vehicle_number ELSE vehicle_number END AS vehicle, CAST(TRY_CAST(CASE WHEN id % 5 = 0 THEN 'x' ELSE CAST(id AS VARCHAR) END AS DOUBLE) AS DOUBLE) AS number,
  id % 7 <> 0 AS valid, CASE WHEN id % 2 = 0 THEN 1 ELSE 0 END AS flag, CASE WHEN site = 0 THEN round(id / 1e-9, 0) ELSE round(id / (site + 1e-9), 4) END + 0.0 AS ratio FROM e""")
def _(spark, d):
    return _fallbacks(events(spark, d))


def _fallbacks(e):
    e = e.withColumn("updated", F.when(F.col("id") % 3 == 0, F.concat(F.lit("U"), "vehicle_number")).otherwise(" "))
    return e.select("id", c.first_non_blank("updated", "vehicle_number").alias("vehicle"), c.number(F.when(F.col("id") % 5 == 0, "x").otherwise(F.col("id").cast("string"))).alias("number"),
                    c.valid_coords(F.when(F.col("id") % 7 == 0, 95.0).otherwise(F.col("latitude")), "longitude").alias("valid"), c.flag(F.when(F.col("id") % 4 == 1, None).otherwise(F.col("id") % 2 == 0)).alias("flag"), F.when(F.col("site") == 0, r(c.ratio("id", "site"), 0)).otherwise(r(c.ratio("id", "site"), 4)).alias("ratio"))  # a divisor of 1e-9 leaves no room for four digits


@query("F20_F23_geometry", """WITH m AS (SELECT avg(latitude) AS la, avg(longitude) AS lo FROM e)
SELECT id, round(6371000 * radians(longitude - lo) * cos(radians(la)), 4) + 0.0 AS x, round(6371000 * radians(latitude - la), 4) + 0.0 AS y,
  round(2 * 6371000 * asin(sqrt(least(1.0, pow(sin(radians(la - latitude) / 2), 2) + cos(radians(latitude)) * cos(radians(la)) * pow(sin(radians(lo - longitude) / 2), 2)))), 3) + 0.0 AS d,
  round(degrees(asin(sin(radians(latitude)) * cos(800.0 / 6371000) + cos(radians(latitude)) * sin(800.0 / 6371000) * cos(radians(90)))), 8) + 0.0 AS east_lat,
  round(degrees(radians(longitude) + atan2(sin(radians(90)) * sin(800.0 / 6371000) * cos(radians(latitude)), cos(800.0 / 6371000) - sin(radians(latitude)) * sin(asin(sin(radians(latitude)) * cos(800.0 / 6371000) + cos(radians(latitude)) * sin(800.0 / 6371000) * cos(radians(90)))))), 8) + 0.0 AS east_lon
FROM e, m""")
def _(spark, d):
    e = events(spark, d)
    e = e.crossJoin(F.broadcast(e.agg(F.avg("latitude").alias("la"), F.avg("longitude").alias("lo"))))
    x, y = c.local_xy("latitude", "longitude", "la", "lo")
    p, q = c.offset_point("latitude", "longitude", F.lit(800.0), F.lit(90.0))
    return e.select("id", r(x, 4).alias("x"), r(y, 4).alias("y"), r(c.haversine_atan_m("latitude", "longitude", "la", "lo"), 3).alias("d"), r(p, 8).alias("east_lat"), r(q, 8).alias("east_lon"))


@query("F24_F28_roads", f"""WITH h AS (SELECT *, CASE id % 6 WHEN 0 THEN 'primary_link' WHEN 1 THEN 'residential' WHEN 2 THEN 'living_street' WHEN 3 THEN 'path' WHEN 4 THEN 'service' ELSE 'trunk' END AS hw FROM e),
k AS (SELECT *, CASE hw WHEN 'primary_link' THEN 'primary' WHEN 'path' THEN 'road' ELSE hw END AS rc FROM h)
SELECT id, {_case('vehicle_type', t.VEHICLE_WIDTH, 1.9)} AS width, rc AS road_class, {_case('rc', t.ROAD_SPEED, 30.0)} AS speed, {_case('rc', t.ROUTE_SPEED, 24.0)} AS route_speed, {_case('rc', t.LANE_CAPACITY, 1600.0)} AS capacity,
  CAST(greatest(1, id % 5) AS INTEGER) AS lanes, CAST(id % 9 AS DOUBLE) + 0.5 AS carriageway FROM k""")
def _(spark, d):
    e = events(spark, d).withColumn("hw", F.element_at(F.array(*[F.lit(x) for x in ("primary_link", "residential", "living_street", "path", "service", "trunk")]), (F.col("id") % 6 + 1).cast("int")))
    rc = c.road_class("hw")
    return e.select("id", c.vehicle_width("vehicle_type").alias("width"), rc.alias("road_class"), c.road_speed(rc).alias("speed"), c.road_speed(rc, True).alias("route_speed"), c.lane_capacity(rc).alias("capacity"),
                    c.lane_count(F.concat((F.col("id") % 5).cast("string"), F.lit(" lanes"))).alias("lanes"), c.width_m(F.concat((F.col("id") % 9).cast("string"), F.lit(",5 m"))).alias("carriageway"))


@query("F29_F32_keys_and_labels", """SELECT id, CASE WHEN id % 2 = 0 THEN CAST(id AS VARCHAR) ELSE 'k' || id END AS key, lower(hotspot_unit) || '|' || printf('%.5f', round(latitude, 5)) || '|' || printf('%.5f', round(longitude, 5)) AS physical,
  hotspot_unit || ' (Cluster ' || id || ')' AS label, trim(regexp_replace(lower(hotspot_unit), '[^a-z0-9]+', ' ', 'g')) AS search, contains(trim(regexp_replace(lower(hotspot_unit), '[^a-z0-9]+', ' ', 'g')), 'j1') AS found FROM e""")
def _(spark, d):
    e = events(spark, d)
    s = c.search_text("hotspot_unit")
    return e.select("id", c.cluster_key(F.when(F.col("id") % 2 == 0, F.concat(F.col("id").cast("string"), F.lit(".0"))).otherwise(F.concat(F.lit("k"), F.col("id").cast("string")))).alias("key"),
                    c.physical_key("hotspot_unit", "latitude", "longitude").alias("physical"), c.display_label("hotspot_unit", "id").alias("label"), s.alias("search"), F.contains(s, F.lit("j1")).alias("found"))


@query("P01_approved", "SELECT id FROM e WHERE status = 'approved'")
def _(spark, d):
    return events(spark, d).where("status = 'approved'").select("id")


@query("P02_approved_or_all", "SELECT id, status FROM e WHERE site = 3 AND status <> 'approved'")
def _(spark, d):
    return approved_or_all(events(spark, d).where("site = 3 AND status <> 'approved'")).select("id", "status")


@query("P04_P05_noise_and_blank_vehicles", "SELECT id, cluster_id FROM c WHERE trim(vehicle_number) <> ''", "c")
def _(spark, d):
    return cluster_events(spark, d).where(c.clean_text("vehicle_number") != "").select("id", "cluster_id")


@query("P08_J12_filters", """WITH top AS (SELECT hotspot_unit, count(*) AS n FROM e GROUP BY 1 HAVING count(*) >= 50) SELECT id, hotspot_unit FROM e WHERE severity = 5 AND hotspot_unit IN (SELECT hotspot_unit FROM top)""")
def _(spark, d):
    e = events(spark, d)
    top = e.groupBy("hotspot_unit").agg(F.count("*").alias("n")).where("n >= 50")
    return e.where("severity = 5").join(top, "hotspot_unit", "left_semi").select("id", "hotspot_unit")


@query("A01_value_counts", "SELECT CASE WHEN status = '' THEN 'missing' ELSE status END AS value, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 6) + 0.0 AS pct FROM e GROUP BY 1")
def _(spark, d):
    return a.value_counts(events(spark, d), "status")


_RATES = """count(*) AS total, count(*) FILTER (status = 'approved') AS approved, count(*) FILTER (status = 'rejected') AS rejected, round(avg(CASE WHEN status = 'approved' THEN 1.0 ELSE 0 END), 6) + 0.0 AS approved_rate,
 round(avg(CASE WHEN status = 'processing' THEN 1.0 ELSE 0 END), 6) + 0.0 AS processing_rate, round(avg(1 - abs(2 * validation_score - 1)), 6) + 0.0 AS uncertainty"""
for _name, _key in (("A02_validation_by_type", "vehicle_type"), ("A03_validation_by_station", "police_station"), ("A04_validation_by_hotspot", "hotspot_unit")):
    query(_name, f"SELECT {_key}, {_RATES} FROM e GROUP BY 1")(lambda spark, d, k=_key: a.validation_rates(events(spark, d), k))


@query("A05_P07_vehicle_summary", f"""WITH m AS ({sql_mode('e', 'vehicle_number', 'vehicle_type', 'mode_type')})
SELECT e.vehicle_number, count(*) AS n, count(DISTINCT hotspot_unit) AS hotspots, count(DISTINCT CASE WHEN junction_name = 'No Junction' THEN '' ELSE junction_name END) AS junctions, strftime(min(local_ts), '%Y-%m-%d %H:%M:%S') AS first_seen, strftime(max(local_ts), '%Y-%m-%d %H:%M:%S') AS last_seen,
  any_value(mode_type) AS mode_type, count(*) FILTER (status = 'approved') AS approved, count(DISTINCT service_date) AS days, CASE WHEN count(*) >= 5 THEN 1 ELSE 0 END AS chronic, CASE WHEN count(*) >= 2 THEN 1 ELSE 0 END AS repeat
FROM e JOIN m USING (vehicle_number) GROUP BY 1""")
def _(spark, d):
    g = events(spark, d).groupBy("vehicle_number").agg(
        F.count("*").alias("n"), F.count_distinct("hotspot_unit").alias("hotspots"), F.count_distinct(F.when(F.upper("junction_name") == "NO JUNCTION", "").otherwise(F.col("junction_name"))).alias("junctions"),
        F.date_format(F.min("local_ts"), "yyyy-MM-dd HH:mm:ss").alias("first_seen"), F.date_format(F.max("local_ts"), "yyyy-MM-dd HH:mm:ss").alias("last_seen"), a.mode("vehicle_type").alias("mode_type"),
        F.count_if(F.col("status") == "approved").alias("approved"), F.count_distinct("service_date").alias("days"))
    return g.withColumns({"chronic": (F.col("n") >= 5).cast("int"), "repeat": (F.col("n") >= 2).cast("int")})


@query("A06_type_summary", "SELECT vehicle_type, count(*) AS n, round(avg(severity), 6) + 0.0 AS mean_severity, median(severity) AS median_severity, CAST(sum(severity) AS BIGINT) AS severity_sum, count(DISTINCT vehicle_number) AS vehicles FROM e WHERE status = 'approved' GROUP BY 1")
def _(spark, d):
    return events(spark, d).where("status = 'approved'").groupBy("vehicle_type").agg(F.count("*").alias("n"), r(F.avg("severity")).alias("mean_severity"), F.median("severity").alias("median_severity"), F.sum("severity").alias("severity_sum"), F.count_distinct("vehicle_number").alias("vehicles"))


@query("A07_time_counts", """SELECT 'hour' AS kind, CAST(hour AS VARCHAR) AS value, count(*) AS n FROM e GROUP BY 2 UNION ALL SELECT 'day', CAST(dow AS VARCHAR), count(*) FROM e GROUP BY 2
 UNION ALL SELECT 'week', CAST(week_start AS VARCHAR), count(*) FROM e GROUP BY 2 UNION ALL SELECT 'month', CAST(month AS VARCHAR), count(*) FROM e GROUP BY 2""")
def _(spark, d):
    kinds = {"hour": "hour", "day": "dow", "week": "week_start", "month": "month"}
    # one pass: each event counts once under each kind
    it = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(v).cast("string").alias("value")) for k, v in kinds.items()]))
    return events(spark, d).select(it.alias("x")).groupBy("x.kind", "x.value").agg(F.count("*").alias("n"))


for _name, _keys in (("A08_hour_by_type", "hour, vehicle_type"), ("A08_day_by_status", "day_name, status"), ("A08_hotspot_by_week", "hotspot_unit, CAST(week_start AS VARCHAR) AS week_start")):
    _cols = [k.split(" AS ")[-1] if " AS " in k else k for k in _keys.split(", ")]
    query(_name, f"SELECT {_keys}, count(*) AS n FROM e GROUP BY 1, 2")(lambda spark, d, k=_cols: events(spark, d).withColumn("week_start", F.col("week_start").cast("string")).groupBy(*k).agg(F.count("*").alias("n")))


@query("A09_peaks", "SELECT (SELECT hour FROM e GROUP BY hour ORDER BY count(*) DESC, hour LIMIT 1) AS peak_hour, (SELECT day_name FROM e GROUP BY day_name, dow ORDER BY count(*) DESC, dow LIMIT 1) AS peak_day")
def _(spark, d):
    counts = events(spark, d).groupBy("hour", "dow", "day_name").agg(F.count("*").alias("n"))
    hour = counts.groupBy("hour").agg(F.sum("n").alias("n")).agg(F.max_by("hour", F.struct("n", -F.col("hour"))).alias("peak_hour"))
    day = counts.groupBy("dow", "day_name").agg(F.sum("n").alias("n")).agg(F.max_by("day_name", F.struct("n", -F.col("dow"))).alias("peak_day"))
    return hour.crossJoin(F.broadcast(day))


@query("A10_tag_summary", "SELECT tag, count(*) AS n, round(avg(severity), 6) + 0.0 AS mean_severity, count(DISTINCT vehicle_number) AS vehicles, count(DISTINCT hotspot_unit) AS hotspots FROM (SELECT *, unnest(CASE WHEN len(tags) = 0 THEN [''] ELSE tags END) AS tag FROM e) GROUP BY 1")
def _(spark, d):
    x = events(spark, d).select("severity", "vehicle_number", "hotspot_unit", F.explode_outer("tags").alias("tag")).fillna("", ["tag"])
    return x.groupBy("tag").agg(F.count("*").alias("n"), r(F.avg("severity")).alias("mean_severity"), F.count_distinct("vehicle_number").alias("vehicles"), F.count_distinct("hotspot_unit").alias("hotspots"))


@query("A11_severity_by_type", "SELECT vehicle_type, severity, count(*) AS n FROM e GROUP BY 1, 2")
def _(spark, d):
    return events(spark, d).groupBy("vehicle_type", "severity").agg(F.count("*").alias("n"))


@query("A12_tag_combinations", "SELECT array_to_string(list_sort(tags), ' | ') AS combination, count(*) AS n FROM e GROUP BY 1")
def _(spark, d):
    return events(spark, d).groupBy(F.array_join(F.array_sort("tags"), " | ").alias("combination")).agg(F.count("*").alias("n"))


_SEVERITY = """SELECT hotspot_unit, count(*) AS approved_records, round(avg(severity), 6) + 0.0 AS mean_severity, median(severity) AS median_severity, CAST(sum(severity) AS BIGINT) AS severity_sum,
 count(*) FILTER (severity = 5) AS very_high, count(*) FILTER (severity = 4) AS high, count(*) FILTER (severity = 3) AS moderate, count(*) FILTER (severity = 2) AS low, count(*) FILTER (severity = 1) AS baseline, count(DISTINCT vehicle_number) AS vehicles FROM e WHERE status = 'approved' GROUP BY 1"""


def hotspot_severity(e):
    """Severity of approved records by hotspot."""
    levels = {"very_high": 5, "high": 4, "moderate": 3, "low": 2, "baseline": 1}
    return e.where("status = 'approved'").groupBy("hotspot_unit").agg(
        F.count("*").alias("approved_records"), r(F.avg("severity")).alias("mean_severity"), F.median("severity").alias("median_severity"), F.sum("severity").alias("severity_sum"),
        *(F.count_if(F.col("severity") == k).alias(n) for n, k in levels.items()), F.count_distinct("vehicle_number").alias("vehicles"))


@query("A13_hotspot_severity", _SEVERITY)
def _(spark, d):
    return hotspot_severity(events(spark, d))


@query("A14_W13_severity_priority", f"""WITH h AS ({_SEVERITY}), s AS (SELECT *, severity_sum / CAST(sum(severity_sum) OVER () AS DOUBLE) AS share,
 100 * (0.5 * severity_sum / (max(severity_sum) OVER () + 1e-9) + 0.3 * mean_severity / 5.0 + 0.2 * approved_records / (max(approved_records) OVER () + 1e-9)) AS p FROM h)
SELECT hotspot_unit, round(share, 6) + 0.0 AS share, round(p, 5) + 0.0 AS priority, row_number() OVER (ORDER BY round(p, 7) DESC, hotspot_unit) AS rank FROM s""")
def _(spark, d):
    h = hotspot_severity(events(spark, d))
    top = h.agg(F.sum("severity_sum").alias("total"), F.max("severity_sum").alias("ms"), F.max("approved_records").alias("mr"))
    s = h.crossJoin(F.broadcast(top)).withColumn("p", 100 * (0.5 * c.ratio("severity_sum", "ms") + 0.3 * F.col("mean_severity") / 5 + 0.2 * c.ratio("approved_records", "mr")))
    # ranks are over hotspots, of which there are few
    rank = F.row_number().over(Window.orderBy(F.desc(F.round("p", 7)), "hotspot_unit")).cast("long")
    return s.select("hotspot_unit", r(F.col("severity_sum") / F.col("total")).alias("share"), r("p", 5).alias("priority"), rank.alias("rank"))


@query("A15_severity_by_status", "SELECT status, count(*) AS n, round(avg(severity), 6) + 0.0 AS mean_severity FROM e GROUP BY 1")
def _(spark, d):
    return events(spark, d).groupBy("status").agg(F.count("*").alias("n"), r(F.avg("severity")).alias("mean_severity"))


@query("W01_group_broadcast", "SELECT id, count(id) OVER (PARTITION BY hotspot_unit) AS hotspot_n, round(avg(severity) OVER (PARTITION BY vehicle_type), 6) + 0.0 AS type_mean FROM e")
def _(spark, d):
    # joined to grouped sums instead of windows: rows of a group never have to meet
    e = events(spark, d).select("id", "hotspot_unit", "vehicle_type", "severity")
    n = e.groupBy("hotspot_unit").agg(F.count("id").alias("hotspot_n"))
    m = e.groupBy("vehicle_type").agg(r(F.avg("severity")).alias("type_mean"))
    return e.join(n, "hotspot_unit").join(m, "vehicle_type").select("id", "hotspot_n", "type_mean")


@query("O01_O03_sort_top", "SELECT vehicle_number, count(*) AS n FROM e GROUP BY 1 ORDER BY n DESC, vehicle_number LIMIT 25")
def _(spark, d):
    return events(spark, d).groupBy("vehicle_number").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "vehicle_number").limit(25)


@query("O04_U01_focus_and_top", """WITH g AS (SELECT hotspot_unit, count(*) AS n FROM e GROUP BY 1), t AS (SELECT * FROM g ORDER BY n DESC, hotspot_unit LIMIT 5), f AS (SELECT * FROM g WHERE hotspot_unit = 'POLICE_STATION::PS0')
SELECT DISTINCT hotspot_unit, n FROM (SELECT * FROM t UNION ALL SELECT * FROM f)""")
def _(spark, d):
    g = events(spark, d).groupBy("hotspot_unit").agg(F.count("*").alias("n"))
    return joins.union_first([g.where("hotspot_unit = 'POLICE_STATION::PS0'"), g.orderBy(F.desc("n"), "hotspot_unit").limit(5)], "hotspot_unit")


@query("U02_distinct_points", "SELECT DISTINCT round(latitude, 4) + 0.0 AS lat, round(longitude, 4) + 0.0 AS lon FROM e")
def _(spark, d):
    return events(spark, d).select(r("latitude", 4).alias("lat"), r("longitude", 4).alias("lon")).distinct()


@query("T02_empty_result", "SELECT id, hour FROM e WHERE hour > 24")
def _(spark, d):
    return events(spark, d).where("hour > 24").select("id", "hour")


@query("T03_run_summary", "SELECT count(*) AS n, count(DISTINCT hotspot_unit) AS hotspots, count(*) FILTER (status = 'approved') AS approved, round(avg(severity), 6) + 0.0 AS mean_severity, max(severity) AS top FROM e")
def _(spark, d):
    return events(spark, d).agg(F.count("*").alias("n"), F.count_distinct("hotspot_unit").alias("hotspots"), F.count_if(F.col("status") == "approved").alias("approved"), r(F.avg("severity")).alias("mean_severity"), F.max("severity").alias("top"))
