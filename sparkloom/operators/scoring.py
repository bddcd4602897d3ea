"""Normalisation, banding and scores (N01 to N25). Global statistics come from one aggregate, joined back as one row."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import band, finite
from ..functions import tables as t
from ..functions.columns import worse_band
from ..functions.tables import EPS


def with_stats(df: DataFrame, **stats: Column) -> DataFrame:
    """df with aggregates over all of it as columns: one row, broadcast."""
    return df.crossJoin(F.broadcast(df.agg(*(v.alias(k) for k, v in stats.items()))))


def minmax(df: DataFrame, columns: Sequence[str], suffix: str = "_norm", nulls: str = "zero") -> DataFrame:
    """N01 (nulls count as zero), N02 (infinities are null, nulls count as the least): (x - min) / (max - min + eps), 0 if constant."""
    value = {k: F.coalesce(F.col(k).cast("double"), F.lit(0.0)) if nulls == "zero" else finite(k) for k in columns}
    wide = with_stats(df, **{f"__lo_{k}": F.min(v) for k, v in value.items()}, **{f"__hi_{k}": F.max(v) for k, v in value.items()})
    out = {}
    for k, v in value.items():
        lo, hi = F.col(f"__lo_{k}"), F.col(f"__hi_{k}")
        out[k + suffix] = F.when(hi.isNull() | (hi - lo <= 0), 0.0).otherwise((F.coalesce(v, lo) - lo) / (hi - lo + EPS))
    return wide.withColumns(out).drop(*(f"__{x}_{k}" for k in columns for x in ("lo", "hi")))


def active_minmax(df: DataFrame, columns: Sequence[str], suffix: str = "_norm") -> DataFrame:
    """As minmax by N02, but null for a column that is constant or empty; a null value counts as the least."""
    wide = with_stats(df, **{f"__lo_{k}": F.min(finite(k)) for k in columns}, **{f"__hi_{k}": F.max(finite(k)) for k in columns})
    out = {k + suffix: F.when(F.col(f"__hi_{k}") - F.col(f"__lo_{k}") > 0, (F.coalesce(finite(k), F.col(f"__lo_{k}")) - F.col(f"__lo_{k}")) / (F.col(f"__hi_{k}") - F.col(f"__lo_{k}") + EPS)) for k in columns}
    return wide.withColumns(out).drop(*(f"__{x}_{k}" for k in columns for x in ("lo", "hi")))


def smooth(norm: Column, floor: float = 0.2) -> Column:
    """N04."""
    return floor + (1 - floor) * norm


def robust(df: DataFrame, columns: Sequence[str], suffix: str = "_norm", low: float = 0.05, high: float = 0.95) -> DataFrame:
    """Between two exact quantiles, clipped to [0, 1]; 0 if they are equal."""
    wide = with_stats(df, **{f"__q_{k}": F.percentile(F.coalesce(finite(k), F.lit(0.0)), F.array(F.lit(low), F.lit(high))) for k in columns})
    out = {}
    for k in columns:
        a, b = F.get(f"__q_{k}", F.lit(0)), F.get(f"__q_{k}", F.lit(1))
        out[k + suffix] = F.when(b - a <= EPS, 0.0).otherwise(F.least(F.greatest((F.coalesce(finite(k), F.lit(0.0)) - a) / (b - a + EPS), F.lit(0.0)), F.lit(1.0)))
    return wide.withColumns(out).drop(*(f"__q_{k}" for k in columns))


def weighted(df: DataFrame, weights: dict[str, float], name: str) -> DataFrame:
    """0 to 100, the weighted mean of the columns that are not constant; 0 if all are."""
    wide = active_minmax(df, list(weights), "__n")
    total = sum(F.when(F.col(k + "__n").isNotNull(), w).otherwise(0.0) for k, w in weights.items())
    got = sum(w * F.coalesce(F.col(k + "__n"), F.lit(0.0)) for k, w in weights.items())
    return wide.withColumn(name, F.when(total > 0, 100 * F.least(F.lit(1.0), F.greatest(F.lit(0.0), got / F.greatest(total, F.lit(EPS))))).otherwise(0.0)).drop(*(k + "__n" for k in weights))


def linear(df: DataFrame, weights: dict[str, float], name: str, scale: float = 100.0, over_all: bool = False) -> DataFrame:
    """Weighted sum of minmax norms, times scale; over_all divides by the weights' sum."""
    wide = minmax(df, list(weights), "__n")
    got = sum(w * F.col(k + "__n") for k, w in weights.items())
    return wide.withColumn(name, scale * got / (sum(weights.values()) if over_all else 1.0)).drop(*(k + "__n" for k in weights))


def geometric(df: DataFrame, weights: dict[str, float], name: str = "ccs_score") -> DataFrame:
    """100 times the weighted geometric mean of norms, each at least 1e-6; a constant column counts as 0.5."""
    wide = active_minmax(df, list(weights), "__n")
    total = sum(weights.values())
    logs = sum(w / total * F.log(F.least(F.greatest(F.coalesce(F.col(k + "__n"), F.lit(0.5)), F.lit(1e-6)), F.lit(1.0))) for k, w in weights.items())
    return wide.withColumn(name, 100 * F.exp(logs)).drop(*(k + "__n" for k in weights))


def quantile_bands(df: DataFrame, score: str, name: str, levels=(0.8, 0.6, 0.4), names=("Critical", "High", "Moderate", "Watch"), fixed: Sequence[float] | None = None, spread: float = 5.0) -> DataFrame:
    """Bands by exact quantiles. N08: with fixed limits, these hold unless P90 - P10 is under spread."""
    qs = [*levels, 0.9, 0.1]
    wide = with_stats(df, __q=F.percentile(score, F.array(*[F.lit(float(x)) for x in qs])))
    q = [F.get("__q", F.lit(i)) for i in range(len(qs))]
    cuts = q[: len(levels)]
    if fixed:
        tight = q[-2] - q[-1] < spread
        cuts = [F.when(tight, x).otherwise(F.lit(float(f))) for x, f in zip(cuts, fixed, strict=True)]
    return wide.withColumn(name, band(score, cuts, names) if len(levels) == 3 else F.when(F.col(score) >= cuts[0], names[0]).when(F.col(score) >= cuts[1], names[1]).otherwise(names[2])).drop("__q")


def source_pressure(df: DataFrame) -> DataFrame:
    """source_pressure_score from 12 components; if all of them are flat, the scaled ccs_score, and if that is flat too, 50."""
    surge = F.greatest(F.coalesce(F.col("growth_pct_change"), F.lit(0.0)), F.lit(0.0))
    wide = df.withColumns({"growth_surge": surge, "context_boost": F.coalesce("context_multiplier", F.lit(1.0)) - 1})
    wide = minmax(weighted(wide, t.PRESSURE_WEIGHTS, "__p"), ["ccs_score"], "__f")
    wide = with_stats(wide, __top=F.max("__p"), __spread=F.max("ccs_score__f"))
    score = F.when(F.col("__top") != 0, F.col("__p")).when(F.col("__spread") > 0, 100 * F.col("ccs_score__f")).otherwise(50.0)
    return wide.withColumn("source_pressure_score", score).drop("__p", "__top", "__spread", "ccs_score__f")


def vulnerability(df: DataFrame) -> DataFrame:
    """network_vulnerability_score from 7 components."""
    return weighted(df, t.VULNERABILITY_WEIGHTS, "network_vulnerability_score")


def priority(df: DataFrame) -> DataFrame:
    """priority_score from 16 components over the sum of their weights, its band, and the worse of that and the forecast's band."""
    out = linear(df, t.PRIORITY_WEIGHTS, "__s", 1.0, True)
    out = out.withColumn("priority_score", 100 * F.least(F.greatest(F.col("__s"), F.lit(0.0)), F.lit(1.0))).drop("__s")
    own = band(F.round("priority_score", 6), (80.0, 60.0, 40.0), ("Critical", "High", "Moderate", "Watch"))
    return out.withColumn("priority_band", own).withColumn("final_risk_band", worse_band(F.col("priority_band"), F.coalesce("future_risk_band", F.lit("Watch"))))


def prescriptive(df: DataFrame) -> DataFrame:
    """dispatch_priority_score from 5 components; phase8_priority_score from 7, its tiers by quantiles, patrols, tow readiness and the action."""
    out = linear(linear(df, t.DISPATCH_WEIGHTS, "dispatch_priority_score"), t.OFFENDER_WEIGHTS, "offender_pressure", 1.0)
    # the offenders' pressure is already a sum of norms
    weights = {k: w for k, w in t.PRESCRIPTIVE_WEIGHTS.items() if k != "offender_pressure"}
    out = linear(out, weights, "__s", 1.0)
    out = out.withColumn("phase8_priority_score", F.round(100 * (F.col("__s") + t.PRESCRIPTIVE_WEIGHTS["offender_pressure"] * F.col("offender_pressure")), 6)).drop("__s")
    out = quantile_bands(out, "phase8_priority_score", "tier", (0.85, 0.6, 0.35), ("Tier 1", "Tier 2", "Tier 3", "Tier 4"))
    tow = F.col("risk_band").isin("Critical", "High") | F.col("future_risk_band").isin("Critical", "High") | (F.col("probability_of_escalation") >= 0.5) | (F.col("chronic_vehicles") >= 1)
    action = F.when(tow, "Tow standby + patrol").when(F.col("risk_band") == "Critical", "Immediate patrol deployment").when(F.col("risk_band") == "High", "Targeted enforcement").otherwise("Routine monitoring")
    return out.withColumns({"tow_readiness": tow, "prescriptive_action": action, "patrols": F.when(F.col("tier") == "Tier 1", 3).when(F.col("tier") == "Tier 2", 2).otherwise(1)})


def novelty(df: DataFrame) -> DataFrame:
    """layer_c_index from persistence, volatility, diversity, uncertainty (missing: the median, else 0.5; within 0 and 1) and resurgence."""
    wide = with_stats(df, __m=F.median("validation_uncertainty"))
    sure = F.least(F.greatest(F.coalesce("validation_uncertainty", "__m", F.lit(0.5)), F.lit(0.0)), F.lit(1.0))
    return linear(wide.withColumn("validation_uncertainty", sure).drop("__m"), t.NOVELTY_WEIGHTS, "layer_c_index", 1.0)


def emerging_norms(df: DataFrame) -> DataFrame:
    """Seven robust norms; recent volume, resurgence and records by log1p first."""
    zero = lambda k: F.coalesce(F.col(k).cast("double"), F.lit(0.0))
    wide = df.withColumns({"recent": F.log1p(zero("recent")), "resurgence": F.log1p(zero("resurgence")), "records": F.log1p(zero("records"))})
    wide = wide.withColumns({k: F.round(zero(k), 9) for k in EMERGING})
    return robust(wide, EMERGING)


EMERGING = ["recent", "growth", "slope", "resurgence", "peak_ratio", "severity_sum", "records"]


def emerging(df: DataFrame, anomaly: str = "anomaly") -> DataFrame:
    """emerging_hotspot_score, 0 to 100, from the scaled anomaly and four of the norms of emerging_norms."""
    wide = minmax(df, [anomaly], "__n")
    got = sum(w * F.col(f"{anomaly}__n" if k == "anomaly" else k) for k, w in t.EMERGING_WEIGHTS.items())
    return wide.withColumn("emerging_hotspot_score", F.least(F.greatest(100 * got, F.lit(0.0)), F.lit(100.0))).drop(f"{anomaly}__n")
