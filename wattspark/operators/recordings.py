"""Smoothing, laps, ranges and pedal figures of recordings, as windows and joins over samples (workout, idx)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wattspark.functions.numeric import calories, half_up
from wattspark.operators import windows

#: Speed is stored in steps of half a metre a second; fixed values in km/h.
SPEED_STEP = 1.8
SPEED_TOLERANCE = 0.05
#: Metres of a degree of latitude in the local projection.
DEGREE_METRES = 111_320.0
#: Lap triggers of the file format: 0 manual, 7 end of the session.
MANUAL_TRIGGER, SESSION_TRIGGER = 0, 7
MANUAL_SEGMENT, AUTO_SEGMENT = 3, 1


def _finite(x: Column) -> Column:
    return F.coalesce(F.abs(x) < F.lit(float("inf")), F.lit(False))


def _all(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions)


def _neighbours(column: str, first: int, last: int, by: str) -> Column:
    """The values from `first` to `last` places away as an array; null where there is no sample."""
    w, x = Window.partitionBy(by).orderBy("idx"), F.col(column).cast("double")
    return F.array(*[F.lag(x, -k).over(w) if k < 0 else F.lead(x, k).over(w) if k else x for k in range(first, last + 1)])


def stabilised(samples: DataFrame, column: str, weights: tuple[float, ...], most_range: float, most_correction: float, by: str = "workout_id", positive: bool = True) -> DataFrame:
    """Samples with `column` replaced by the weighted mean around it.

    A sample stays where its window leaves the series, holds a missing (with `positive` also a non-positive) value or
    spans more than `most_range`, and where it would change by more than `most_correction`.
    """
    if len(weights) < 3 or len(weights) % 2 == 0 or sum(weights) <= 0:
        raise ValueError("an odd number of weights of positive sum is needed")
    radius = len(weights) // 2
    held = samples.withColumn("__near", _neighbours(column, -radius, radius, by))
    near = [F.col("__near")[k] for k in range(len(weights))]
    usable = _all([_finite(v) & (v > 0) if positive else _finite(v) for v in near])
    mean = reduce(lambda a, b: a + b, [v * F.lit(float(x)) for v, x in zip(near, weights)]) / float(sum(weights))
    x = F.col(column).cast("double")
    small = (F.greatest(*near) - F.least(*near) <= most_range) & (F.abs(mean - x) <= most_correction)
    return held.withColumn(column, F.when(usable & small, mean).otherwise(x)).drop("__near")


def dequantised_speed(samples: DataFrame, speed: str = "speed", distance: str = "distance", by: str = "workout_id") -> DataFrame:
    """Samples with speeds (km/h) that lie on a storage step replaced by that of five intervals of distance (km).

    Only where distance grows in all five, and the speed changes by at most two steps.
    """
    held = samples.withColumn("__near", _neighbours(distance, -3, 2, by))
    near = [F.col("__near")[k] for k in range(6)]
    raw = F.col(speed).cast("double")
    on_step = F.abs(raw - F.floor(raw / SPEED_STEP + 0.5) * F.lit(SPEED_STEP)) <= SPEED_TOLERANCE
    moving = _all([_finite(v) for v in near] + [b > a for a, b in zip(near, near[1:])])
    measured = (near[5] - near[0]) * 3600.0 / 5.0
    usable = _finite(raw) & (raw > 0) & on_step & moving & (F.abs(measured - raw) <= 2 * SPEED_STEP)
    return held.withColumn(speed, F.when(usable, measured).otherwise(raw)).drop("__near")


def lap_segments(laps: DataFrame, recordings: DataFrame, by: str = "workout_id") -> DataFrame:
    """(by, lap_index, type, start, end, duration): the laps of each recording as ranges of its samples.

    `laps`: by, lap_index, lap_trigger, start_time, timestamp (its end), total_timer_time, total_elapsed_time; `recordings`:
    by, record_count, base_time; times in seconds; lap_index tells the laps of a recording apart. A lap's own times are taken
    where they lie within the recording; else the laps' durations share the samples in proportion. A sole lap, the session's envelope and laps without length go, as do
    those of recordings of under two samples or without a base time. An unknown trigger counts as automatic.
    """
    timer = F.coalesce("total_timer_time", "total_elapsed_time")
    length = F.when(_finite(timer) & (timer > 0), timer).otherwise(F.lit(0.0)).cast("decimal(18,3)")
    whole = Window.partitionBy(by)
    upto = whole.orderBy("lap_index").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = laps.withColumn("__length", length).select(
        by,
        "lap_index",
        "lap_trigger",
        F.col("start_time").alias("__from"),
        F.when(_finite(F.col("timestamp")) & (~_finite(F.col("start_time")) | (F.col("timestamp") > F.col("start_time"))), F.col("timestamp")).otherwise(F.col("start_time") + timer).alias("__to"),
        F.col("__length").cast("double").alias("__length"),
        F.sum("__length").over(upto).cast("double").alias("__upto"),
        F.sum("__length").over(whole).cast("double").alias("__total"),
        F.count(F.lit(1)).over(whole).alias("__laps"),
    )
    known = recordings.filter("record_count >= 2").filter(_finite(F.col("base_time"))).select(by, F.col("record_count").alias("__n"), F.col("base_time").alias("__base"))
    rows = placed.filter("__laps > 1").join(known, by)
    n, a, b = F.col("__n"), F.col("__from") - F.col("__base"), F.col("__to") - F.col("__base")
    direct = F.coalesce(_finite(a) & _finite(b) & (a >= -1) & (b > a) & (a <= n) & (b <= n + 1), F.lit(False))
    shared = (F.col("__total") > 0) & (F.col("__length") > 0)
    scale = (n - 1) / F.col("__total")

    def place(seconds: Column) -> Column:
        return F.greatest(F.lit(0).cast("long"), F.least(n - 1, half_up(seconds).cast("long")))

    start = F.when(direct, place(a)).when(shared, place((F.col("__upto") - F.col("__length")) * scale))
    end = F.when(direct, place(b)).when(shared, place(F.col("__upto") * scale))
    ranges = rows.withColumn("start", start).withColumn("end", F.greatest("start", end))
    envelope = F.coalesce(F.col("lap_trigger") == SESSION_TRIGGER, F.lit(False)) & (F.col("start") <= 1) & (F.col("end") >= n - 2)
    kind = F.when(F.col("lap_trigger") == MANUAL_TRIGGER, MANUAL_SEGMENT).otherwise(AUTO_SEGMENT).alias("type")
    return ranges.filter(~envelope & (F.col("end") > F.col("start"))).select(by, "lap_index", kind, "start", "end", (F.col("end") - F.col("start")).alias("duration"))


def range_means(ranges: DataFrame, samples: DataFrame, columns: list[str], by: str = "workout_id") -> DataFrame:
    """Ranges (by, start, end) with mean_<column> over the samples from start up to, not including, end.

    Sums run once over the samples and are looked up at both ends, so overlapping ranges cost nothing more. Missing
    values count as 0; ranges that leave the recording go.
    """
    before = Window.partitionBy(by).orderBy("idx").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("decimal(28,6)")
    run = samples.select(by, "idx", *[F.coalesce(F.sum(F.col(c).cast("decimal(18,6)")).over(before), zero).alias(c) for c in columns])
    first = run.select(by, F.col("idx").alias("start"), *[F.col(c).alias(f"__a_{c}") for c in columns])
    last = run.select(by, F.col("idx").alias("end"), *[F.col(c).alias(f"__b_{c}") for c in columns])
    met = ranges.join(first, [by, "start"]).join(last, [by, "end"])
    means = [((F.col(f"__b_{c}") - F.col(f"__a_{c}")).cast("double") / (F.col("end") - F.col("start"))).alias(f"mean_{c}") for c in columns]
    return met.select(*ranges.columns, *means)


def manual_segments(ranges: DataFrame, samples: DataFrame, columns: list[str], altitude: str | None = None, by: str = "workout_id") -> DataFrame:
    """Segments from ranges (by, a, b) marked in either direction: start, end, duration, rounded means, gain of altitude.

    Ranges of under two samples give none. The gain is the difference of altitude between both ends.
    """
    marked = ranges.select(by, F.least("a", "b").cast("long").alias("start"), F.greatest("a", "b").cast("long").alias("end"))
    found = range_means(marked.filter("end - start >= 2"), samples, columns, by)
    if altitude is not None:
        low = samples.select(by, F.col("idx").alias("start"), F.col(altitude).alias("__low"))
        high = samples.select(by, F.col("idx").alias("end"), F.col(altitude).alias("__high"))
        found = found.join(low, [by, "start"]).join(high, [by, "end"]).withColumn("altimeters", F.col("__high") - F.col("__low"))
    rounded = [half_up(F.col(f"mean_{c}")).cast("double").alias(f"avg_{c}") for c in columns]
    more = ["altimeters"] if altitude is not None else []
    return found.select(by, "start", "end", (F.col("end") - F.col("start")).alias("duration"), *rounded, *more)


def pedal_metrics(samples: DataFrame, by: str = "workout_id") -> DataFrame:
    """What a session says of power and cadence, computed anew from repaired samples of one a second.

    Means are rounded, over known power and over cadence above 0, and 0 without any; energy is the work done.
    """
    turning = F.when(F.col("cadence") > 0, F.col("cadence"))

    def mean(x: Column) -> Column:
        return F.coalesce(half_up(F.sum(x.cast("decimal(18,6)")).cast("double") / F.nullif(F.count(x), F.lit(0))), F.lit(0)).cast("double")

    totals = samples.groupBy(by).agg(
        mean(F.col("power")).alias("avg_power"),
        F.coalesce(F.max("power"), F.lit(0.0)).alias("max_power"),
        mean(turning).alias("avg_cadence"),
        F.coalesce(F.max(turning), F.lit(0)).cast("double").alias("max_cadence"),
        F.count(F.lit(1)).alias("seconds"),
    )
    energy = calories(F.lit(None).cast("double"), F.col("avg_power"), F.col("seconds").cast("double"))
    return totals.withColumn("total_calories", energy).join(windows.normalized_power(samples, by), by)


def local_projection(track: DataFrame, by: str = "workout_id") -> DataFrame:
    """Track points (by, idx, lat, lng) with x and y in metres from the first one, on a plane at the track's mean latitude.

    Tracks of one point go.
    """
    whole = Window.partitionBy(by)
    ahead = whole.orderBy("idx")
    middle = F.sum(F.col("lat").cast("decimal(18,9)")).over(whole).cast("double") / F.count("lat").over(whole)
    held = track.select("*", F.first("lat").over(ahead).alias("__lat"), F.first("lng").over(ahead).alias("__lng"), middle.alias("__middle"), F.count(F.lit(1)).over(whole).alias("__n"))
    x = (F.col("lng") - F.col("__lng")) * F.cos(F.radians("__middle")) * DEGREE_METRES
    y = (F.col("lat") - F.col("__lat")) * DEGREE_METRES
    return held.filter("__n >= 2").select(*track.columns, x.alias("x"), y.alias("y"))
