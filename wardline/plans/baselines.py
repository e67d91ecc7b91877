"""Weekly baselines of station and head: dense weeks, rolling moments, EWMA, season, dispersion, control limit and z.

A series' whole plan is windows over (station, head): its rows are dealt out once. What a week is expected to count is
the EWMA of the weeks before it, times the season of its week of the year; the first week of a series expects none.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wardline.functions.scalars import half_up, iso_week
from wardline.functions.stats import control_limit

ALPHA = 0.25
KEYS = ("station", "head")
#: Weeks of a series at most: weights of the EWMA are powers of 1 - ALPHA, which stay within doubles so long.
MOST_WEEKS = 2000
#: Fixed value: what a week counts at least to be an alert.
LEAST = 5


def weekly_counts(incidents: DataFrame) -> DataFrame:
    """One row for every week of each series between the first and the last week of all."""
    week = F.to_date(F.date_trunc("week", F.col("registered_on")))
    counts = incidents.groupBy(*KEYS, week.alias("week_start")).agg(F.count("*").alias("n"))
    ends = incidents.select(week.alias("w")).agg(F.min("w").alias("a"), F.max("w").alias("b"))
    by = counts.groupBy(*KEYS).agg(F.map_from_entries(F.collect_list(F.struct("week_start", "n"))).alias("seen"))
    by = by.withColumn("a", ends.select("a").scalar()).withColumn("b", ends.select("b").scalar())
    rows = by.select(*KEYS, "seen", F.explode(F.sequence("a", "b", F.expr("INTERVAL 7 DAYS"))).alias("week_start"))
    return rows.select(*KEYS, "week_start", F.coalesce(F.try_element_at("seen", "week_start"), F.lit(0).cast("long")).alias("fir_count"))


def moments(incidents: DataFrame) -> DataFrame:
    """All of a week's row but its control limit, unrounded."""
    df = weekly_counts(incidents).withColumn("iso_week", iso_week(F.col("week_start")))
    series = W.partitionBy(*KEYS)
    ordered = series.orderBy("week_start")
    past, upto = ordered.rowsBetween(-52, -1), ordered.rowsBetween(W.unboundedPreceding, 0)
    x = F.col("fir_count")
    # Moments are kept as integers, so that variance and mean compare exactly.
    n, total, square = F.count(x).over(past), F.coalesce(F.sum(x).over(past), F.lit(0)), F.coalesce(F.sum(x * x).over(past), F.lit(0))
    df = df.withColumn("window_observations", n).withColumn("_total", total).withColumn("_spread", n * square - total * total)
    n, total = F.col("window_observations"), F.col("_total")
    df = df.withColumn("mean_52", F.when(n > 0, total / n).otherwise(0.0)).withColumn("variance_52", F.when(n > 0, F.col("_spread") / (n * n)).otherwise(0.0))
    # The EWMA in closed form: each week weighs ALPHA * (1 - ALPHA) ** age, the first one all that is left.
    age = F.row_number().over(ordered) - 1
    df = df.withColumn("_age", F.when(age > MOST_WEEKS, F.raise_error(F.lit("series of too many weeks")).cast("int")).otherwise(age))
    weight = F.when(F.col("_age") == 0, 1.0).otherwise(ALPHA * F.pow(F.lit(1 - ALPHA), -F.col("_age")))
    df = df.withColumn("ewma", F.pow(F.lit(1 - ALPHA), F.col("_age")) * F.sum(weight * x).over(upto))
    season, whole = F.substring("iso_week", 7, 2), F.avg(x).over(series)
    df = df.withColumn("seasonality_index", F.when(whole > 0, F.avg(x).over(W.partitionBy(*KEYS, season)) / whole).otherwise(1.0))
    df = df.withColumn("expected_count", F.coalesce(F.lag("ewma").over(ordered), F.lit(0.0)) * F.col("seasonality_index"))
    df = df.withColumn("dispersion_r", F.when((F.col("_spread") > n * total) & (total > 0), total * total / (F.col("_spread") - n * total)))
    e = F.col("expected_count")
    spread = e + F.when(F.col("dispersion_r").isNotNull(), e * e / F.col("dispersion_r")).otherwise(0.0)
    df = df.withColumn("z_score", F.when(spread > 0, (x - e) / F.sqrt(spread)).otherwise(x.cast("double")))
    return df.select(*KEYS, "week_start", "iso_week", "fir_count", "window_observations", "ewma", "expected_count", "mean_52", "variance_52", "seasonality_index", "dispersion_r", "z_score")


def limited(rows: DataFrame) -> DataFrame:
    return rows.withColumn("ucl_99", control_limit(F.col("expected_count"), F.col("dispersion_r")))


def baselines(incidents: DataFrame) -> DataFrame:
    df = limited(moments(incidents))
    # An EWMA's early values end in ties, which the closed form may miss by its last digit.
    df = df.withColumns({c: F.col(c) + 1e-9 for c in ("ewma", "expected_count")})
    return df.withColumns({c: half_up(F.col(c), 6) for c in ("ewma", "expected_count", "mean_52", "variance_52", "seasonality_index", "dispersion_r", "z_score")})


def alerts(rows: DataFrame, least: int = LEAST, since: str | None = None) -> DataFrame:
    """Weeks beyond their control limit with so many incidents at least, from a day on. Limits are worked out for weeks that count enough only, if rows have none yet."""
    few = rows.filter(F.col("fir_count") >= least)
    if since is not None:
        few = few.filter(F.col("week_start") >= F.lit(since).cast("date"))
    if "ucl_99" not in few.columns:
        few = limited(few)
    return few.filter(F.col("fir_count") > F.col("ucl_99"))


#: Fixed value: alerts of a feed at most.
FEED = 30


def feed(rows: DataFrame, places: DataFrame, weight: Callable[[Column], Column], severity: Callable[[Column], Column], since: str, history: int = 13) -> DataFrame:
    """The alerts with the highest score, their last weeks' counts and where their station's incidents are.

    rows: weeks of `moments`; places (station, latitude, longitude, coordinate_records); weight and severity: Columns of a head and of a score.
    """
    last = W.partitionBy(*KEYS).orderBy("week_start").rowsBetween(1 - history, 0)
    seen = rows.withColumn("history", F.array_join(F.collect_list(F.col("fir_count").cast("string")).over(last), ","))
    found = alerts(seen, since=since).withColumn("severity_weight", weight(F.col("head"))).withColumn("score", F.col("z_score") * F.col("severity_weight"))
    order = [F.col("score").desc(), F.col("week_start").desc(), F.col("station"), F.col("head")]
    # FEED rows at most from here on.
    top = found.orderBy(*order).limit(FEED).withColumn("k", F.row_number().over(W.orderBy(*order)))
    z = half_up(F.col("z_score"), 1).cast("string")
    out = top.join(places, "station", "left")
    return out.select(
        F.concat(F.lit("alert-"), F.lpad(F.col("k").cast("string"), 2, "0")).alias("alert_id"), F.col("head").alias("title"), "station", "week_start", F.col("fir_count").alias("observed_count"),
        half_up(F.col("expected_count"), 1).alias("expected_count"), "ucl_99", half_up(F.col("z_score"), 2).alias("z_score"),
        F.when(F.col("z_score") > 20, "20+σ").otherwise(F.concat(F.regexp_replace(z, "\\.0$", ""), F.lit("σ"))).alias("shown"), "severity_weight", half_up(F.col("score"), 2).alias("rank_score"),
        severity(F.col("score")).alias("severity"), "history", half_up(F.col("latitude"), 6).alias("latitude"), half_up(F.col("longitude"), 6).alias("longitude"), F.coalesce("coordinate_records", F.lit(0)).cast("long").alias("coordinate_records"),
        F.floor((F.col("k") - 1) * 60000.0 / (FEED - 1) + 0.5).cast("long").alias("replay_offset_ms"),
    )
