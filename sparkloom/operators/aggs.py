"""Aggregations (A01 to A48) that take a table and column names, and give grouped plans that Spark combines map-side."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import clean_text, rounded
from ..functions.tables import EPS


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """Value, n, pct; blank and null are missing."""
    v = F.when(clean_text(column) == "", "missing").otherwise(clean_text(column))
    counts = df.groupBy(v.alias("value")).agg(F.count("*").alias("n"))
    total = df.agg(F.count("*").alias("total"))
    return counts.crossJoin(F.broadcast(total)).select("value", "n", rounded(100.0 * F.col("n") / F.col("total")).alias("pct"))


def validation_rates(df: DataFrame, *keys: str) -> DataFrame:
    """Total, approved, rejected, processing, rates and mean uncertainty."""
    s = F.col("status")
    share = lambda x: rounded(F.avg((s == x).cast("double")))
    return df.groupBy(*keys).agg(
        F.count("*").alias("total"), F.count_if(s == "approved").alias("approved"), F.count_if(s == "rejected").alias("rejected"), share("approved").alias("approved_rate"),
        share("processing").alias("processing_rate"), rounded(F.avg(1 - F.abs(2 * F.col("validation_score") - 1))).alias("uncertainty"))


def mode(column) -> Column:
    """The smallest of the most frequent values."""
    return F.mode(column, True)


def dominant(column: str, *excluded: str) -> Column:
    """Mode of what is neither blank nor excluded."""
    v = clean_text(column)
    return F.mode(F.when((v != "") & ~F.upper(v).isin(*excluded) if excluded else v != "", v), True)


def shares(counts: DataFrame, key: str, n: str = "n") -> DataFrame:
    """N as a share of its key's sum."""
    return counts.withColumn("share", rounded(F.col(n) / F.sum(n).over(Window.partitionBy(key))))


def weekly(df: DataFrame, key: str, week: str = "week_start") -> DataFrame:
    """A18, with i, the place of a week among those that its key has, and weeks, their number. Weeks without rows are absent."""
    return df.groupBy(key, week).agg(F.count("*").alias("n")).withColumns({"i": F.row_number().over(Window.partitionBy(key).orderBy(week)).cast("long"), "weeks": F.count("*").over(Window.partitionBy(key))})


def half_growth(weeks: DataFrame, key: str, smooth: float = 0.0) -> DataFrame:
    """Means of the first and second half of the weeks observed, growth, and the multiplier 1 + positive growth."""
    half = F.greatest(F.lit(1), F.floor(F.col("weeks") / 2))
    first = F.avg(F.when(F.col("i") <= half, F.col("n").cast("double")))
    second = F.avg(F.when(F.col("i") > half, F.col("n").cast("double")))
    g = weeks.groupBy(key).agg(first.alias("first_half"), F.coalesce(second, first).alias("second_half"))
    growth = (F.col("second_half") - F.col("first_half")) / (F.col("first_half") + smooth + EPS)
    return g.withColumn("growth", growth).withColumn("multiplier", 1 + F.greatest(F.lit(0.0), F.col("growth")))


def recent_means(weeks: DataFrame, key: str, window: int = 4) -> DataFrame:
    """Means of the last weeks and of as many before (with fewer weeks: of the halves)."""
    back = F.col("weeks") - F.col("i") + 1
    n = F.col("n").cast("double")
    g = weeks.groupBy(key).agg(F.max("weeks").alias("weeks"), F.avg(F.when(back <= window, n)).alias("r"), F.avg(F.when((back > window) & (back <= 2 * window), n)).alias("p"))
    halves = half_growth(weeks, key)
    enough = F.col("weeks") >= 2 * window
    out = g.join(halves, key).withColumns({"recent": F.when(enough, F.col("r")).otherwise(F.col("second_half")), "previous": F.when(enough, F.col("p")).otherwise(F.col("first_half"))})
    ratio = (F.col("recent") + 1) / (F.col("previous") + 1)
    return out.select(key, "weeks", "first_half", "second_half", "growth", "multiplier", "recent", "previous", ratio.alias("recent_ratio"), (ratio * F.col("multiplier")).alias("resurgence"))


def slope(y: str = "n", x: str = "i") -> Column:
    """Least-squares slope; 0 for fewer than two rows."""
    return F.coalesce(F.regr_slope(F.col(y).cast("double"), F.col(x).cast("double")), F.lit(0.0))


def volatility(n: str = "n") -> Column:
    """Population standard deviation over the mean; 0 for one row."""
    return F.when(F.count("*") <= 1, 0.0).otherwise(F.stddev_pop(n) / (F.avg(n) + EPS))


def resurgence(weeks: DataFrame, key: str) -> DataFrame:
    """Last two weeks against the earlier ones, both + 1, clipped to [0, 5]; one week gives 1."""
    n = F.col("n").cast("double")
    late = F.col("i") > F.col("weeks") - 2
    early = F.when(F.col("weeks") > 2, ~late).otherwise(F.col("i") < F.col("weeks"))
    g = weeks.groupBy(key).agg(F.max("weeks").alias("weeks"), F.avg(F.when(late, n)).alias("a"), F.avg(F.when(early, n)).alias("b"))
    return g.select(key, F.when(F.col("weeks") == 1, 1.0).otherwise(F.least(F.greatest((F.col("a") + 1) / (F.col("b") + 1), F.lit(0.0)), F.lit(5.0))).alias("resurgence"))


def entropy(counts: DataFrame, key: str, n: str = "n") -> DataFrame:
    """Shannon diversity of the counts of a key, over the logarithm of their number."""
    p = F.col(n) / F.sum(n).over(Window.partitionBy(key))
    g = counts.withColumn("p", p).groupBy(key).agg(F.sum(-F.col("p") * F.log(F.col("p") + EPS)).alias("h"), F.count("*").alias("k"))
    return g.select(key, F.when(F.col("k") <= 1, 0.0).otherwise(F.col("h") / F.log(F.col("k") + EPS)).alias("diversity"))


def hour_profile(df: DataFrame, key: str, hour: str = "hour") -> DataFrame:
    """Peak hour, start of the best trailing three-hour window, its share, and the three commonest hours, over all 24 hours."""
    keys = df.select(key).distinct().crossJoin(F.broadcast(df.sparkSession.range(24).select(F.col("id").alias("h"))))
    counts = keys.join(df.groupBy(key, F.col(hour).alias("h")).agg(F.count("*").alias("k")), [key, "h"], "left").fillna(0, ["k"])
    counts = counts.withColumn("t", F.sum("k").over(Window.partitionBy(key).orderBy("h").rowsBetween(-2, 0)))
    best = lambda value: F.max_by("h", F.struct(F.col(value), -F.col("h")))
    g = counts.groupBy(key).agg(best("k").alias("peak_hour"), best("t").alias("start_hour"), F.sum("k").alias("total"), F.slice(F.array_sort(F.collect_list(F.struct((-F.col("k")).alias("m"), "h"))), 1, 3).alias("top"), F.collect_list(F.struct("h", "k")).alias("all"))
    window = F.aggregate(F.filter("all", lambda x: (x["h"] >= F.col("start_hour")) & (x["h"] < F.col("start_hour") + 3)), F.lit(0).cast("long"), lambda a, x: a + x["k"])
    return g.select(key, "peak_hour", "start_hour", F.least(F.lit(24), F.col("start_hour") + 3).cast("long").alias("end_hour"), F.array_join(F.transform("top", lambda x: x["h"].cast("string")), ",").alias("top3"), rounded(window / (F.col("total") + EPS)).alias("window_share"))


def describe(df: DataFrame, column: str) -> DataFrame:
    """Count, mean, standard deviation, minimum, exact quartiles, maximum."""
    q = F.percentile(column, F.array(*[F.lit(x) for x in (0.25, 0.5, 0.75)]))
    out = df.agg(F.count(column).alias("n"), F.avg(column).alias("mean"), F.stddev_samp(column).alias("std"), F.min(column).alias("low"), q.alias("q"), F.max(column).alias("high"))
    return out.select("n", rounded("mean").alias("mean"), rounded("std").alias("std"), rounded("low").alias("low"), *(rounded(F.get("q", F.lit(i))).alias(f"q{25 * (i + 1)}") for i in range(3)), rounded("high").alias("high"))
