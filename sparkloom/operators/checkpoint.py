"""Cutting lineage through the folder that the cluster shares."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """A new folder's path under spark.checkpoint.dir. Where that is unset, a temporary folder on one machine; on a cluster an error, as executors share no local folder."""
    top = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not top:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        top = "file://" + os.path.join(tempfile.gettempdir(), "sparkloom-checkpoints")
    return f"{top.rstrip('/')}/{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Writes df as Parquet into the shared folder and reads it again: ends its lineage and survives lost executors."""
    spark = df.sparkSession
    to = shared_dir(spark)
    df.write.parquet(to)
    return spark.read.schema(df.schema).parquet(to)


def cut_and_sum(df: DataFrame, **sums: Column) -> tuple[DataFrame, dict]:
    """cut(df), and aggregates over all of it, gathered while it is written."""
    seen = Observation()
    out = cut(df.observe(seen, *(v.alias(k) for k, v in sums.items())))
    return out, seen.get


def forget(*tables: DataFrame) -> None:
    """Deletes the files that tables, results of cut(), read; only once nothing is left to be computed from them."""
    for df in tables:
        context = df.sparkSession.sparkContext
        for path in {f.rpartition("/")[0] for f in df.inputFiles()}:
            where = context._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(context._jsc.hadoopConfiguration()).delete(where, True)
