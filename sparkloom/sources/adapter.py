"""The driver's events table as parking events, in SQL that Spark and DuckDB both run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as c

#: Integer arithmetic on ids only, so that any engine gives the same rows.
EVENTS_SQL = """
SELECT event_id AS id, site, CAST(ts AS TIMESTAMP) AS created_datetime,
  1290e-2 + CAST(site AS DOUBLE) * 8e-3 + CAST(event_id % 13 - 6 AS DOUBLE) * 1e-4 AS latitude,
  7750e-2 + CAST(site % 4 AS DOUBLE) * 5e-3 + CAST((event_id * 5) % 11 - 5 AS DOUBLE) * 1e-4 AS longitude,
  concat('V', CAST(user_id * 3 + event_id % 3 AS VARCHAR(20))) AS vehicle_number,
  CASE (event_id * 11) % 7 WHEN 0 THEN 'CAR' WHEN 1 THEN 'SCOOTER' WHEN 2 THEN 'MOTOR CYCLE'
    WHEN 3 THEN 'PASSENGER AUTO' WHEN 4 THEN 'VAN' WHEN 5 THEN 'LORRY' ELSE 'OTHERS' END AS vehicle_type,
  CASE WHEN event_id % 17 = 0 THEN NULL
    WHEN event_type = 'view' THEN '["NO PARKING"]'
    WHEN event_type = 'click' THEN '["WRONG PARKING","NO PARKING"]'
    WHEN event_type = 'purchase' THEN '["PARKING ON FOOTPATH"]'
    WHEN event_type = 'signup' THEN '["PARKING IN MAIN ROAD","WRONG PARKING"]'
    ELSE '["DOUBLE PARKING"]' END AS violation_type,
  concat('PS', CAST(site % 5 AS VARCHAR(20))) AS police_station,
  CASE WHEN site % 3 = 0 THEN 'No Junction' ELSE concat('J', CAST(site AS VARCHAR(20))) END AS junction_name,
  CASE WHEN event_id % 10 < 6 THEN 'approved' WHEN event_id % 10 < 8 THEN 'rejected'
    WHEN event_id % 10 = 8 THEN 'processing' WHEN event_id % 20 = 9 THEN NULL ELSE 'duplicate' END AS validation_status
FROM (SELECT *, least(event_id % 23, (event_id * 31) % 19) AS site FROM {events}) AS b
"""


def violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw events, with site, a number that stands for the place."""
    return spark.sql(EVENTS_SQL, events=spark.read.parquet(f"{sf_dir}/events.parquet"))


def enriched(raw: DataFrame) -> DataFrame:
    """F01 to F16 on raw events: wall clock, tags, severity, hotspot unit, validation status and score."""
    e = raw.withColumn("local_ts", c.local_time("created_datetime"))
    e = e.withColumns({
        "hour": F.hour("local_ts").cast("long"), "day_name": F.date_format("local_ts", "EEEE"), "month": F.month("local_ts").cast("long"),
        "dow": F.weekday("local_ts").cast("long"), "week_start": c.week_start("local_ts").cast("date"), "service_date": F.to_date("local_ts"),
        "tags": c.parse_list("violation_type"), "status": F.lower(c.clean_text("validation_status")), "hotspot_unit": c.hotspot_unit(),
        "validation_score": c.validation_score("validation_status"),
    })
    return e.withColumns({
        "is_weekend": F.col("dow").isin(5, 6).cast("int"), "tag_count": F.size("tags").cast("long"), "severity": c.severity(F.col("tags")),
        "severity_exact": c.severity_exact(F.col("tags")), "first_tag": c.dominant_tag(F.col("tags")), "peak": c.peak_flag("hour"),
    })


def clustered(events: DataFrame) -> DataFrame:
    """Approved events (all, if none is) with cluster_id from the place; -1 is noise."""
    return approved_or_all(events).withColumn("cluster_id", F.when(F.col("id") % 29 == 0, F.lit(-1)).otherwise(F.col("site") + 1).cast("long"))


def approved_or_all(events: DataFrame) -> DataFrame:
    """Approved rows, or all rows if none is approved."""
    any_approved = events.agg(F.coalesce(F.max(F.col("status") == "approved"), F.lit(False)).alias("__any"))
    return events.crossJoin(F.broadcast(any_approved)).where((F.col("status") == "approved") | ~F.col("__any")).drop("__any")
