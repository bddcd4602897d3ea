"""Sources and sinks."""

from __future__ import annotations

import os
from collections.abc import Sequence
from dataclasses import dataclass, fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

RAW_EVENTS = T.StructType([
    T.StructField("id", T.StringType()), T.StructField("latitude", T.DoubleType()), T.StructField("longitude", T.DoubleType()), T.StructField("vehicle_number", T.StringType()),
    T.StructField("vehicle_type", T.StringType()), T.StructField("violation_type", T.StringType()), T.StructField("created_datetime", T.TimestampType()),
    T.StructField("police_station", T.StringType()), T.StructField("junction_name", T.StringType()), T.StructField("validation_status", T.StringType()),
])
REQUIRED = RAW_EVENTS.names


def exists(spark: SparkSession, path: str) -> bool:
    """Through Hadoop, so that any store that Spark reads counts."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return bool(p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p))


def read_any(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """CSV with a header, or Parquet, ORC or JSON, by the path's ending."""
    kind = path.rstrip("/").rpartition(".")[2].lower()
    reader = spark.read.schema(schema) if schema else spark.read
    if kind in ("csv", "gz", "txt"):
        return reader.option("header", True).option("mode", "PERMISSIVE").option("escape", '"').csv(path)
    if kind in ("json", "jsonl", "ndjson"):
        return reader.json(path)
    return reader.orc(path) if kind == "orc" else reader.parquet(path)


def first_existing(spark: SparkSession, folders: Sequence[str], names: Sequence[str] | None = None, schema: T.StructType | None = None) -> tuple[DataFrame | None, str | None]:
    """The table at the first path that exists, and the path; (None, None) if none does."""
    paths = [f"{d.rstrip('/')}/{n}" for d in folders for n in names] if names else list(folders)
    for path in paths:
        if exists(spark, path):
            return read_any(spark, path, schema), path
    return None, None


def all_existing(spark: SparkSession, paths: Sequence[str], needs: Sequence[str] = ()) -> list[DataFrame]:
    """Every table that exists, can be read and has one of the columns needed."""
    out = []
    for path in paths:
        if not exists(spark, path):
            continue
        try:
            df = read_any(spark, path)
        except Exception:  # an unreadable file is skipped, as asked for
            continue
        if not needs or set(needs) & set(df.columns):
            out.append(df)
    return out


def require(df: DataFrame, columns: Sequence[str] = REQUIRED) -> DataFrame:
    """Raises if a column is missing."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def resolve(df: DataFrame, candidates: Sequence[str], name: str) -> DataFrame:
    """The first of the candidates under one name; a null column of text if there is none."""
    found = next((c for c in candidates if c in df.columns), None)
    return df.withColumn(name, F.col(found) if found else F.lit(None).cast("string"))


def with_defaults(df: DataFrame, defaults: dict[str, tuple[str, object]]) -> DataFrame:
    """Columns that are missing or null get (type, default)."""
    return df.withColumns({c: F.coalesce(F.col(c).cast(kind), F.lit(value).cast(kind)) if c in df.columns else F.lit(value).cast(kind) for c, (kind, value) in defaults.items()})


def bundle(spark: SparkSession, folder: str, names: Sequence[str]) -> dict[str, DataFrame]:
    """The stored tables that exist, by name."""
    return {n: spark.read.parquet(f"{folder}/{n}.parquet") for n in names if exists(spark, f"{folder}/{n}.parquet")}


def road_graph(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Nodes (node_id, lat, lon) and edges (u, v, length_m, highway, lanes, width) of a stored road graph.

    Downloading a graph is left to whoever prepares the folder; nothing here calls a service.
    """
    return spark.read.parquet(f"{folder}/nodes.parquet"), spark.read.parquet(f"{folder}/edges.parquet")


def cached(spark: SparkSession, path: str, make) -> DataFrame:
    """The table at the path, made and written if it isn't there."""
    if not exists(spark, path):
        write(make(), path)
    return spark.read.parquet(path)


def answers(requests: DataFrame, stored: DataFrame, key: str = "request") -> DataFrame:
    """Requests with their stored answers (request, status, payload); status 204 is an empty answer, no row no answer."""
    out = requests.join(stored, key, "left")
    return out.withColumn("ok", F.coalesce(F.col("status").between(200, 299) & (F.col("status") != 204), F.lit(False))).withColumn("payload", F.when(F.col("status") != 204, F.col("payload")))


@dataclass
class Settings:
    """Parameters, each of which an environment variable of its upper-case name overrides."""

    patrol_units: int = 15
    max_patrols: int = 3
    eligibility_score: float = 40.0
    route_stops: int = 12
    spillover_radius_m: float = 1200.0
    spillover_decay_m: float = 600.0
    eps_m: float = 150.0
    eps_days: float = 3.0
    min_points: int = 15

    @classmethod
    def from_environment(cls, prefix: str = "SPARKLOOM_") -> Settings:
        out = cls()
        for f in fields(cls):
            if (said := os.environ.get(prefix + f.name.upper())) is not None:
                setattr(out, f.name, type(getattr(out, f.name))(said))
        return out


def write(df: DataFrame, path: str, kind: str = "parquet") -> None:
    """Overwrites the table at the path; CSV has a header and no index."""
    w = df.write.mode("overwrite")
    w.option("header", True).option("escape", '"').csv(path) if kind == "csv" else w.format(kind).save(path)


def empty(spark: SparkSession, schema: T.StructType | str) -> DataFrame:
    """No rows of a schema."""
    return spark.createDataFrame([], schema)
