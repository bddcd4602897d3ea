"""Queries by name, each with the DuckDB SQL that gives the same rows where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..functions.tables import SEVERITY_EXACT, SEVERITY_PATTERNS, VALIDATION_SCORE
from ..sources.adapter import EVENTS_SQL, clustered, enriched, violations

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _sql_severity(tag: str, exact: bool) -> str:
    rules = SEVERITY_EXACT if exact else SEVERITY_PATTERNS
    cases = " ".join(f"WHEN {' OR '.join(f'{tag} = {chr(39)}{p}{chr(39)}' if exact else f'contains({tag}, {chr(39)}{p}{chr(39)})' for p in rules[s])} THEN {s}" for s in sorted(rules, reverse=True))
    return f"CASE {cases} ELSE 1 END"


#: Common table expressions of the twins: v raw, e enriched, a approved, cl clustered (c without noise), w weekly counts.
CTES = {
    "v": EVENTS_SQL.format(events="events"),
    "e0": "SELECT *, created_datetime + INTERVAL 330 MINUTE AS local_ts, CASE WHEN violation_type IS NULL THEN [] ELSE CAST(CAST(violation_type AS JSON) AS VARCHAR[]) END AS tags, lower(trim(coalesce(validation_status, ''))) AS status FROM v",
    "e": f"""SELECT *, hour(local_ts) AS hour, dayname(local_ts) AS day_name, month(local_ts) AS month, CAST(isodow(local_ts) - 1 AS BIGINT) AS dow,
  CAST(date_trunc('week', local_ts) AS DATE) AS week_start, CAST(local_ts AS DATE) AS service_date, len(tags) AS tag_count,
  CASE WHEN isodow(local_ts) >= 6 THEN 1 ELSE 0 END AS is_weekend, CASE WHEN hour(local_ts) BETWEEN 8 AND 12 THEN 1 ELSE 0 END AS peak,
  coalesce(list_max(list_transform(tags, lambda t: {_sql_severity('t', False)})), 1) AS severity,
  coalesce(list_max(list_transform(tags, lambda t: {_sql_severity('t', True)})), 1) AS severity_exact, upper(coalesce(tags[1], '')) AS first_tag,
  CASE WHEN junction_name = 'No Junction' THEN 'POLICE_STATION::' || police_station ELSE 'JUNCTION::' || junction_name END AS hotspot_unit,
  CAST(CASE status {' '.join(f"WHEN '{k}' THEN {v}" for k, v in VALIDATION_SCORE.items())} ELSE 0.5 END AS DOUBLE) AS validation_score FROM e0""",
    "cl": "SELECT *, CAST(CASE WHEN id % 29 = 0 THEN -1 ELSE site + 1 END AS BIGINT) AS cluster_id FROM e WHERE status = 'approved'",
    "c": "SELECT * FROM cl WHERE cluster_id <> -1",
    "w": "SELECT cluster_id, week_start, count(*) AS n, row_number() OVER (PARTITION BY cluster_id ORDER BY week_start) AS i, count(*) OVER (PARTITION BY cluster_id) AS weeks FROM c GROUP BY cluster_id, week_start",
}
NEEDS = {"v": [], "e0": ["v"], "e": ["e0"], "cl": ["e"], "c": ["cl"], "w": ["c"]}


def with_ctes(sql: str, needs: list[str]) -> str:
    """sql with the tables it needs before it."""
    order: list[str] = []

    def add(name):
        for n in NEEDS[name]:
            add(n)
        if name not in order:
            order.append(name)

    for n in needs:
        add(n)
    head = ",\n".join(f"{n} AS ({CTES[n]})" for n in order)
    body = sql.strip()
    if not head:
        return body
    return f"WITH RECURSIVE {head},\n{body[5:]}" if body[:5].upper() == "WITH " else f"WITH RECURSIVE {head}\n{body}"


def query(name: str, sql: str | None = None, needs: str = "e"):
    """Registers a query; sql may use the tables named in needs (letters of CTES, blank-separated)."""

    def put(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = with_ctes(sql, needs.split())
        return f

    return put


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return enriched(violations(spark, sf_dir))


def cluster_events(spark: SparkSession, sf_dir: str, noise: bool = False) -> DataFrame:
    out = clustered(events(spark, sf_dir))
    return out if noise else out.where("cluster_id <> -1")


def sql_mode(source: str, keys: str, column: str, alias: str, where: str = "TRUE") -> str:
    """The smallest of the most frequent values."""
    return f"SELECT {keys}, {column} AS {alias} FROM (SELECT {keys}, {column}, row_number() OVER (PARTITION BY {keys} ORDER BY count(*) DESC, {column}) AS k FROM {source} WHERE {column} IS NOT NULL AND {where} GROUP BY {keys}, {column}) WHERE k = 1"
