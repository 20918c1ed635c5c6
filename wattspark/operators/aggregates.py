"""Aggregations over workouts and their efforts."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wattspark.functions.calendar import PERIODS, period_key
from wattspark.functions.numeric import half_up, two_point_ftp, zone
from wattspark.operators.joins import asof


def efforts(workouts: DataFrame, segments: DataFrame, motorsport: bool = False) -> DataFrame:
    """Segments with their workout's user, time and periods; motor sport left out unless asked for."""
    w = workouts if motorsport else workouts.filter(F.col("workout_type") != "motorsport")
    return segments.join(w.select(F.col("id").alias("wid"), "uid", "start_time", *PERIODS.values()), "wid")


def ftp_by_period(rows: DataFrame, period: str = "quarter") -> DataFrame:
    """Exact 95th percentiles of the 8 and 15 minute efforts of each user and period, FTP and its confidence."""
    column = PERIODS.get(period, PERIODS["quarter"])
    used = rows.filter(F.col("duration").isin(480, 900) & F.col("avg_power").isNotNull())
    power = lambda d: F.when(F.col("duration") == d, F.col("avg_power"))
    each = used.groupBy("uid", F.col(column).alias("period")).agg(
        F.percentile(power(480), 0.95).alias("cp8"),
        F.percentile(power(900), 0.95).alias("cp15"),
        F.count(power(480)).alias("_n8"),
        F.count(power(900)).alias("_n15"),
    )
    return each.select("uid", "period", "cp8", "cp15", two_point_ftp(F.col("cp8"), F.col("cp15")).alias("ftp"), F.least("_n8", "_n15").alias("confidence"))


def efforts_by_workout(rows: DataFrame, durations: tuple[int, ...]) -> DataFrame:
    """A row a workout with its best power for each duration."""
    best = [F.max(F.when(F.col("duration") == d, F.col("avg_power"))).alias(f"power_{d}") for d in durations]
    return rows.groupBy("uid", "wid", "start_time").agg(*best)


def best_efforts(rows: DataFrame, grouping: str, durations: tuple[int, ...]) -> DataFrame:
    """The best effort of each user, period and duration; equal powers go to the earlier start, then the smaller id."""
    if grouping not in PERIODS:
        raise ValueError(f"unknown grouping {grouping}")
    used = rows.filter(F.col("duration").isin(*durations) & F.col("avg_power").isNotNull())
    order = Window.partitionBy("uid", "period", "duration").orderBy(F.desc("avg_power"), "start_time", "wid", "start_offset")
    return used.withColumn("period", F.col(PERIODS[grouping])).withColumn("_rank", F.row_number().over(order)).filter("_rank = 1").select("uid", "period", "duration", "avg_power", "wid", "start_offset")


def summary(df: DataFrame, by: list[str]) -> DataFrame:
    """Counts and sums, 0 where there is nothing."""
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("workouts"), F.coalesce(F.sum("total_distance"), F.lit(0.0)).alias("distance"), F.coalesce(F.sum("total_timer_time"), F.lit(0.0)).alias("seconds"))


def histogram(samples: DataFrame, width: int = 5, most: int = 1000) -> DataFrame:
    """Seconds by power bin of each workout; zero and missing seconds apart. The last bin takes all from `most` up."""
    power = F.col("power")
    held = samples.groupBy("workout_id").agg(F.count_if(power == 0).alias("zero_seconds"), F.count_if(power.isNull()).alias("missing_seconds"))
    bins = samples.filter(power > 0).groupBy("workout_id", F.least(F.lit(most // width), F.greatest(F.lit(0), F.floor((power - 1) / width))).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("seconds"))
    each = bins.groupBy("workout_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("bin", "seconds")))).alias("bins"))
    return held.join(each, "workout_id", "left")


def zone_distribution(bins: DataFrame, snapshots: DataFrame, period: str, width: int = 5) -> DataFrame:
    """Seconds by zone of each user and period.

    `bins` has (uid, start_time, bin, seconds), `snapshots` (uid, start_time, ftp). A bin's power is its
    middle; its FTP the latest snapshot's; seconds before the first snapshot are unclassified.
    """
    dated = asof(bins.withColumnRenamed("start_time", "at"), snapshots, ["uid"], "at", "start_time", ["ftp"])
    watts = F.col("bin") * width + (width + 1) / 2
    z = dated.withColumn("zone", F.when(F.col("ftp").isNotNull(), zone(watts, F.col("ftp")))).withColumn("period", period_key(F.col("at"), period))
    seconds = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("seconds"))), F.lit(0)).cast("long")
    return z.groupBy("uid", "period").agg(*[seconds(F.col("zone") == i).alias(f"z{i}") for i in range(1, 8)], seconds(F.col("zone").isNull()).alias("unclassified"), F.sum("seconds").cast("long").alias("active"))


def merged_sessions(sessions: DataFrame, by: list[str]) -> DataFrame:
    """Several sessions as one: sums, means weighted by time, extremes."""
    t = F.col("total_timer_time")
    weighted = lambda c: (F.sum(F.when(F.col(c).isNotNull(), F.col(c) * t)) / F.sum(F.when(F.col(c).isNotNull(), t))).alias(c)
    return sessions.groupBy(*by).agg(
        F.sum("total_timer_time").alias("total_timer_time"),
        F.sum("total_distance").alias("total_distance"),
        F.sum("total_ascent").alias("total_ascent"),
        weighted("avg_power"),
        weighted("avg_normalized_power"),
        F.min("start_time").alias("start_time"),
        F.min("min_lat").alias("min_lat"),
        F.min("min_lng").alias("min_lng"),
        F.max("max_lat").alias("max_lat"),
        F.max("max_lng").alias("max_lng"),
    )


def daily_load(rows: DataFrame) -> DataFrame:
    """(uid, day, tss) with every day between a user's first and last, 0 where nothing was done."""
    sums = rows.groupBy("uid", F.to_date("start_time").alias("day")).agg(F.sum("tss").alias("tss"))
    span = sums.groupBy("uid").agg(F.min("day").alias("first"), F.max("day").alias("last"))
    days = span.select("uid", F.explode(F.sequence("first", "last", F.expr("INTERVAL 1 DAY"))).alias("day"))
    return days.join(sums, ["uid", "day"], "left").select("uid", "day", F.coalesce("tss", F.lit(0.0)).alias("tss"))


def fitness(daily: DataFrame, chronic: float = 42, acute: float = 7) -> DataFrame:
    """Chronic and acute load by day and their balance. Each day's loads are rounded before the next takes
    them up, so this is a walk over a user's days, not a window; a group is one user's days, which time bounds."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("day")
        c = a = 0.0
        rows = []
        for x in pdf["tss"].tolist():
            c = math.floor(c + (x - c) / chronic + 0.5)
            a = math.floor(a + (x - a) / acute + 0.5)
            rows.append((c, a, math.floor(c - a + 0.5)))
        return pdf.assign(**{n: [float(r[i]) for r in rows] for i, n in enumerate(("ctl", "atl", "tsb"))})

    kind = daily.schema["uid"].dataType.simpleString()
    return daily.select("uid", "day", "tss").groupBy("uid").applyInPandas(run, f"uid {kind}, day date, tss double, ctl double, atl double, tsb double")


def fitness_by_period(daily_fitness: DataFrame, period: str) -> DataFrame:
    """Load of each period: its sum, first and last chronic load, rounded means of balance and acute load."""
    p = daily_fitness.withColumn("period", period_key(F.col("day"), period))
    return p.groupBy("uid", "period").agg(F.sum("tss").alias("tss"), F.min_by("ctl", "day").alias("ctl_start"), F.max_by("ctl", "day").alias("ctl_end"), half_up(F.avg("tsb")).alias("tsb"), half_up(F.avg("atl")).alias("atl"))


def quantile_at(values: Column, p: float) -> Column:
    """The value at index floor(n p) of the sorted values, not interpolated."""
    ordered = F.array_sort(values)
    return F.get(ordered, F.least(F.size(ordered) - 1, F.floor(F.size(ordered) * F.lit(p)).cast("int")))


def largest_remainder(df: DataFrame, by: list[str], share: str, item: str, total: int = 255) -> DataFrame:
    """Whole parts of `total` in proportion to `share` within `by`: floors first, the rest to the largest remainders."""
    w = Window.partitionBy(*by)
    exact = F.col(share) / F.sum(share).over(w) * total
    floors = df.withColumn("_exact", exact).withColumn("_floor", F.floor("_exact")).withColumn("_left", F.lit(total) - F.sum("_floor").over(w))
    rank = F.row_number().over(w.orderBy(F.desc(F.col("_exact") - F.col("_floor")), item))
    return floors.withColumn("parts", (F.col("_floor") + F.when(rank <= F.col("_left"), 1).otherwise(0)).cast("long")).drop("_exact", "_floor", "_left")
