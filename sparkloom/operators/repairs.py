"""Repair of incomplete cluster tables (N14, N15, N16, N19) and their collapse to physical places."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import columns as c
from ..functions import tables as t
from ..functions.columns import finite
from .scoring import minmax, with_stats


def _within(x, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def repaired(df: DataFrame) -> DataFrame:
    """Df with every missing measure made from the others, per row, and then those that tell nothing rebuilt.

    Columns: records, severity_sum, severity_mean, peak_records, distinct_days, lam, mu, dwell, load, lanes, carriageway,
    road, base, loss, reduced, delay. A loss that is empty or has one value throughout is replaced by a proxy of use, blocking,
    severity and volume; a delay that has at most two values, or a median under 0.05, by the dwell time, raised by the same.
    effective is the reduced capacity before measures that are still missing become 0.
    """
    some = lambda k: F.greatest(F.col(k), F.lit(1))
    x = df.withColumns({
        "severity_sum": F.coalesce("severity_sum", F.col("severity_mean") * some("records")),
        "severity_mean": F.coalesce("severity_mean", F.col("severity_sum") / some("records")),
        "lam": F.coalesce("lam", F.col("peak_records") / (some("distinct_days") * 5.0)),
        "mu": F.coalesce("mu", c.departures_per_hour("dwell")),
        "lanes": F.coalesce(F.col("lanes").cast("double"), F.when(F.col("carriageway").isNotNull(), F.greatest(F.lit(1.0), F.rint(F.col("carriageway") / 3.5)))),
        "carriageway": F.coalesce("carriageway", F.when(F.col("lanes").isNotNull(), some("lanes") * 3.5)),
    })
    x = x.withColumns({"load": F.coalesce("load", c.load("lam", "mu")), "base": F.coalesce("base", c.lane_capacity("road") * F.greatest(F.coalesce("lanes", F.lit(1.0)), F.lit(1.0)))})
    x = minmax(x, ["severity_sum", "load", "records"], "__n")
    use = c.load("lam", "mu")
    x = with_stats(x, __use=F.median(use), __mu=F.median("mu"), __dwell=F.median("dwell"), __losses=F.count_distinct("loss"), __delays=F.count_distinct("delay"), __delay=F.median("delay"))

    busy = _within(F.coalesce(finite(use), "__use", F.lit(0.0)), 0.0, 5.0)
    proxy = 0.40 * _within(busy / 1.5, 0.0, 1.0) + 0.25 * F.col("load__n") + 0.20 * F.col("severity_sum__n") + 0.15 * F.col("records__n")
    x = x.withColumn("loss", F.when(F.col("__losses") <= 1, _within(100 * proxy, 0.0, 95.0)).otherwise(F.col("loss")))
    x = x.withColumn("reduced", F.coalesce("reduced", F.col("base") * (1 - F.coalesce("loss", F.lit(0.0)) / 100)))

    leaving = F.greatest(F.coalesce(finite("mu"), "__mu", F.lit(1.0)), F.lit(0.1))
    over = F.greatest(_within(F.coalesce(finite(c.load(F.greatest(F.coalesce("lam", F.lit(0.0)), F.lit(0.0)), leaving)), F.lit(0.0)), 0.0, 5.0) - 1, F.lit(0.0))
    rebuilt = _within(F.coalesce("dwell", "__dwell", F.lit(2.0)), 0.5, 180.0) * (1 + 0.4 * F.col("severity_sum__n") + 0.3 * F.col("load__n")) * (1 + over)
    useless = (F.col("__delays") <= 2) | (F.coalesce("__delay", F.lit(0.0)) < 0.05)
    x = x.withColumns({"delay": F.when(useless, _within(rebuilt, 0.5, 60.0)).otherwise(F.col("delay")), "effective": F.col("reduced")})
    x = x.drop(*(k for k in x.columns if k.startswith("__") or k.endswith("__n")))
    return x.fillna(0.0, ["lam", "dwell", "mu", "load", "delay", "severity_sum", "severity_mean", "loss", "base", "reduced"])


def criticality(df: DataFrame, degree: str = "degree", centrality: str = "centrality") -> DataFrame:
    """criticality_factor from degree and betweenness (missing: the median), or, if neither varies, from load, volume, loss and severity."""
    wide = with_stats(df, **{f"__{w}_{k}": f(k) for k in (degree, centrality) for w, f in (("k", F.count_distinct), ("m", F.median))})
    wide = wide.withColumns({f"__f_{k}": F.coalesce(F.col(k).cast("double"), F.col(f"__m_{k}")) for k in (degree, centrality)})
    proxies = {"records": 0.30, "vehicles": 0.20, "load": 0.20, "loss": 0.15, "severity_sum": 0.15}
    wide = minmax(wide, [f"__f_{degree}", f"__f_{centrality}", *proxies], "__n")
    varies = lambda k: F.col(f"__k_{k}") > 1
    graph = 1 + 0.55 * F.when(varies(degree), F.col(f"__f_{degree}__n")).otherwise(0.0) + 0.45 * F.when(varies(centrality), F.col(f"__f_{centrality}__n")).otherwise(0.0)
    proxy = 1 + 0.5 * _within(sum(w * F.col(f"{k}__n") for k, w in proxies.items()), 0.0, 1.0)
    out = wide.withColumn("criticality_factor", F.when(varies(degree) | varies(centrality), graph).otherwise(proxy))
    return out.drop(*(k for k in out.columns if k.startswith("__") or k.endswith("__n")))


def feature_defaults(df: DataFrame) -> DataFrame:
    """Df with the components that other layers would give; a column that is absent or empty throughout counts as not given.

    Then resurgence is the growth (else the multiplier less 1) where positive, persistence comes from volume, days and repeated
    vehicles, uncertainty and anomaly are 0. context_boost is the context's multiplier less 1.
    """
    out = df.withColumns({k: F.lit(v).cast("boolean" if isinstance(v, bool) else "double") for k, v in t.FEATURE_DEFAULTS.items() if k not in df.columns})
    parts = [k for k in t.PERSISTENCE_WEIGHTS if k in out.columns]
    made = ["resurgence_score", "persistence_score", "validation_uncertainty", "anomaly_score"]
    out = with_stats(minmax(out, parts, "__n"), **{f"__given_{k}": F.count(k) for k in made})
    surge = F.col("growth_pct_change") if "growth_pct_change" in df.columns else F.col("growth_multiplier") - 1 if "growth_multiplier" in df.columns else F.lit(0.0)
    persistence = 100 * sum((t.PERSISTENCE_WEIGHTS[k] * F.col(f"{k}__n") for k in parts), F.lit(0.0))
    instead = {"resurgence_score": F.greatest(F.coalesce(surge, F.lit(0.0)), F.lit(0.0)), "persistence_score": persistence, "validation_uncertainty": F.lit(0.0), "anomaly_score": F.lit(0.0)}
    out = out.withColumns({k: F.when(F.col(f"__given_{k}") > 0, F.col(k)).otherwise(v) for k, v in instead.items()})
    out = out.withColumn("context_boost", F.coalesce("context_multiplier", F.lit(1.0)) - 1)
    return out.drop(*(f"__given_{k}" for k in made), *(f"{k}__n" for k in parts))


def collapse(df: DataFrame, key: str, order: tuple[str, ...] = ("ccs_score", "delay", "records"), id_: str = "cluster_id") -> DataFrame:
    """One row per physical place. Each column that df has goes by its rule in COLLAPSE_RULES.

    top takes the value of the row that is first by the order, descending (ties: the smallest id); first that of the smallest
    id. merged_ids joins the distinct ids, as sorted text, by ``|``. One aggregate, combined before the shuffle.
    """
    best = F.struct(*(F.coalesce(F.col(k).cast("double"), F.lit(float("-inf"))) for k in order), -F.col(id_))
    ways = {
        "max": F.max, "sum": lambda x: F.sum(x).cast("double"), "mean": F.avg, "any": F.bool_or, "top": lambda x: F.max_by(x, best), "first": lambda x: F.min_by(x, id_),
    }
    aggs = [F.array_join(F.array_sort(F.collect_set(F.col(id_).cast("string"))), "|").alias("merged_ids"), F.max_by(id_, best).alias(id_)]
    for (way, instead), names in t.COLLAPSE_RULES.items():
        for k in names:
            if k in df.columns and k not in (key, id_):
                aggs.append(ways[way](F.col(k) if instead is None else F.coalesce(F.col(k), F.lit(instead))).alias(k))
    return df.groupBy(key).agg(*aggs)
