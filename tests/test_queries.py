"""Every query against DuckDB on the smallest tables, and the entry module with and without its optional parts."""

import math
import os
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__ as entry
from sparkloom.plans import queries as plans

ROWS_ONLY = set(plans.QUERIES) - set(plans.SQL)


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}") + 0.0
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else str(v) if hasattr(v, "isoformat") else v


def close(a, b):
    if isinstance(a, float) or isinstance(b, float):
        return a is not None and b is not None and abs(a - b) <= 1e-8 * max(1, abs(a), abs(b))
    return a == b


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for f in os.listdir(sf):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{sf}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(plans.SQL))
def test_query_equals_its_sql(spark, sf, duck, name):
    df = plans.QUERIES[name](spark, sf)
    r = duck.execute(plans.SQL[name])
    names = sorted(df.columns)
    assert names == sorted(d[0] for d in r.description)
    at = [[d[0] for d in r.description].index(n) for n in names]
    mine = sorted((tuple(plain(x[n]) for n in names) for x in df.collect()), key=repr)
    theirs = sorted((tuple(plain(x[i]) for i in at) for x in r.fetchall()), key=repr)
    assert len(mine) == len(theirs)
    assert all(close(a, b) for x, y in zip(mine, theirs, strict=True) for a, b in zip(x, y, strict=True))


@pytest.mark.parametrize("name", sorted(ROWS_ONLY - {"K21_K26_forecast"}))
def test_query_without_sql_gives_rows(spark, sf, name):
    assert plans.QUERIES[name](spark, sf).count() > 0


def test_entry_gives_the_live_ranking(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_without_the_optional_parts(tmp_path):
    here = os.path.dirname(os.path.abspath(entry.__file__))
    for x in ("__spark_entry__.py", "sparkloom"):
        subprocess.run(["cp", "-r", os.path.join(here, x), tmp_path], check=True)
    subprocess.run(["rm", "-rf", tmp_path / "sparkloom" / "llm"], check=True)
    code = "import __spark_entry__ as e; assert len(e.queries()) > 80 and 'pipeline' not in e.queries()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})


def test_streams(spark, tmp_path):
    from pyspark.sql import functions as F

    from sparkloom.sources.adapter import violations
    from sparkloom.streaming import events as stream

    sf = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
    v = violations(spark, sf)
    v.repartition(2).write.parquet(f"{tmp_path}/in")
    s = stream.event_stream(spark, f"{tmp_path}/in", v.schema)
    q = stream.weekly_counts(s, "police_station", late="1000 days").writeStream.format("memory").queryName("weeks").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/c1").start()
    q.awaitTermination()
    want = v.groupBy("police_station", F.date_trunc("week", "created_datetime").alias("week_start")).agg(F.count("*").alias("n"))
    assert sorted(map(tuple, spark.table("weeks").collect())) == sorted(map(tuple, want.collect()))
    q = stream.write_table(stream.sessions(s, ["vehicle_number", "site"]), f"{tmp_path}/out", f"{tmp_path}/c2")
    q.awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/out").where("dwell_minutes < 0").count() == 0
