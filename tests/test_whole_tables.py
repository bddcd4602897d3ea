"""Queries that answer for whole tables."""

import math

import pytest
from pyspark.sql import functions as F

from sparkloom.operators import cluster
from sparkloom.plans import queries as plans
from sparkloom.plans.hotspots import trends
from sparkloom.plans.registry import cluster_events


@pytest.mark.parametrize("name", ["J05_road_context", "J15_J16_nearest"])
def test_joins_answer_for_every_event(spark, sf, name):
    ids = lambda df: sorted(r.id for r in df.select("id").collect())
    assert ids(plans.QUERIES[name](spark, sf)) == ids(plans.events(spark, sf))


def test_display_holds_clusters_that_need_a_thousands_separator(spark, sf):
    large = sf.replace("0.001", "0.1")
    want = {r.cluster_id: f"{r.n:,.2f}" for r in cluster_events(spark, large).groupBy("cluster_id").agg(F.count("*").alias("n")).collect()}
    assert {r.cluster_id: r.shown for r in plans.QUERIES["F31_F52_display"](spark, large).collect()} == want
    assert any("," in x for x in want.values())


def test_ratio_answers_for_site_0(spark, sf):
    e = {r.id: r.site for r in plans.events(spark, sf).select("id", "site").collect()}
    got = {r.id: r.ratio for r in plans.QUERIES["F16_F19_F55_fallbacks_and_numbers"](spark, sf).collect()}
    assert got.keys() == e.keys() and 0 in e.values()
    assert all(math.isclose(got[i], i / (s + 1e-9), rel_tol=1e-9, abs_tol=1e-4) for i, s in e.items())


def test_isolation_forest_is_registered_with_300_trees(spark, sf):
    x = trends(cluster_events(spark, sf)).select("cluster_id", "recent", "growth", "slope", "resurgence", "peak_ratio")
    want = cluster.isolation_scores(cluster.robust_scaled(x, x.columns[1:]), "cluster_id", x.columns[1:], trees=300)
    got = {r.cluster_id: r.anomaly for r in plans.QUERIES["K11_K12_isolation_forest"](spark, sf).collect()}
    assert got == {r.cluster_id: pytest.approx(r.anomaly, abs=1e-6) for r in want.collect()}
