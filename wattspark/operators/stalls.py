"""What stalls, climbs and corrupt ends say about a recording, from windows and groups over its samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Metres of a unit of stored distance.
UNIT_METRES = 0.5
#: What counts as riding while distance stands still.
ACTIVE_POWER, ACTIVE_CADENCE = 50, 30
#: Blocks of a minute, the shortest kept, and what makes one a climb or a descent.
BLOCK, LEAST_BLOCK = 60, 30
CLIMB_KMH, CLIMB_POWER, CLIMB_CADENCE = 18, 180, 40
DESCENT_KMH, DESCENT_POWER = 30, 120
#: A corrupt end: shortest recording, zeros at its end, seconds looked back, seconds of the baseline, least length, least samples.
TAIL_RECORDS, TAIL_ZEROS, TAIL_SEARCH, TAIL_BASELINE, TAIL_LENGTH, TAIL_SAMPLES = 16, 3, 24, 6, 10, 5

#: The figures by which a workout's type is told, as `classify.workout_type` names them.
TYPE_FIGURES = {
    "distance_active_ratio": "distance_active_ratio",
    "step_dominance_ratio": "step_dominance_ratio",
    "speed_variation": "speed_variation",
    "stall_active_ratio": "stall_ratio",
    "longest_stall_seconds": "longest_stall_seconds",
    "moving_speed_kmh": "moving_speed",
    "road_climb_minutes": "climb_minutes",
    "longest_road_climb_minutes": "longest_climb",
    "road_descent_minutes": "descent_minutes",
    "longest_road_descent_minutes": "longest_descent",
    "climb_before_descent": "climb_first",
}


def _yes(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False))


def _sum_of(condition: Column, value: Column | int = 1) -> Column:
    return F.coalesce(F.sum(F.when(condition, value)), F.lit(0))


def _mean(column: str) -> Column:
    return F.coalesce(F.sum(F.col(column).cast("decimal(18,6)")).cast("double") / F.nullif(F.count(column), F.lit(0)), F.lit(0.0))


def stall_metrics(samples: DataFrame, by: str = "workout_id") -> DataFrame:
    """How distance moves in each recording: samples (by, idx, distance in half metres, power, cadence), gaps in distance null.

    Gives the share of seconds that move, that of their two commonest steps, the variation of moving speed (infinite without
    any), the share of seconds that ride on the spot and the longest run of them, moving speed, and the minutes and longest
    runs of road climbs and descents, and whether a climb comes before a descent.
    """
    w = Window.partitionBy(by).orderBy("idx")
    rows = samples.select(by, "idx", "power", "cadence", (F.col("distance") - F.lag("distance").over(w)).cast("long").alias("step"))
    riding = (F.col("power") >= ACTIVE_POWER) | (F.col("cadence") >= ACTIVE_CADENCE)
    rows = rows.withColumn("stalled", _yes((F.col("step") == 0) & riding))
    moves = F.col("step") > 0

    totals = rows.groupBy(by).agg(
        F.count(F.lit(1)).alias("n"),
        F.count("step").alias("known"),
        _sum_of(moves).alias("moving"),
        _sum_of(moves, F.col("step")).alias("way"),
        _sum_of(moves, F.col("step") * F.col("step")).alias("squares"),
        _sum_of(F.col("stalled")).alias("stalled"),
    )
    runs = rows.filter("stalled").select(by, (F.col("idx") - F.row_number().over(w)).alias("run")).groupBy(by, "run").agg(F.count(F.lit(1)).alias("n"))
    longest = runs.groupBy(by).agg(F.max("n").alias("longest_stall_seconds"))
    steps = rows.filter(moves).groupBy(by, "step").agg(F.count(F.lit(1)).alias("n"))
    place = F.row_number().over(Window.partitionBy(by).orderBy(F.desc("n"), "step"))
    common = steps.withColumn("place", place).filter("place <= 2").groupBy(by).agg(F.sum("n").alias("common"))

    size = F.count(F.lit(1))
    blocks = rows.filter("idx >= 1").groupBy(by, F.floor((F.col("idx") - 1) / BLOCK).alias("block"))
    blocks = blocks.agg(size.alias("size"), F.sum(F.greatest("step", F.lit(0))).alias("way"), _mean("power").alias("power"), _mean("cadence").alias("cadence"))
    kmh = F.col("way") * UNIT_METRES / F.col("size") * 3.6
    climb = (kmh <= CLIMB_KMH) & (F.col("power") >= CLIMB_POWER) & (F.col("cadence") >= CLIMB_CADENCE)
    descent = (kmh >= DESCENT_KMH) & (F.col("power") <= DESCENT_POWER)
    kinds = blocks.filter(F.col("size") >= LEAST_BLOCK).select(by, "block", F.when(climb, "climb").when(descent, "descent").alias("kind")).filter("kind IS NOT NULL")
    alike = Window.partitionBy(by, "kind").orderBy("block")
    hills = kinds.select(by, "kind", "block", (F.col("block") - F.row_number().over(alike)).alias("run")).groupBy(by, "kind", "run").agg(F.count(F.lit(1)).alias("n"), F.min("block").alias("first"), F.max("block").alias("last"))
    up, down = F.col("kind") == "climb", F.col("kind") == "descent"
    hills = hills.groupBy(by).agg(
        _sum_of(up, F.col("n")).alias("road_climb_minutes"),
        F.max(F.when(up, F.col("n"))).alias("longest_road_climb_minutes"),
        _sum_of(down, F.col("n")).alias("road_descent_minutes"),
        F.max(F.when(down, F.col("n"))).alias("longest_road_descent_minutes"),
        _yes(F.min(F.when(up, F.col("first"))) < F.max(F.when(down, F.col("last")))).alias("climb_before_descent"),
    )

    met = totals.join(longest, by, "left").join(common, by, "left").join(hills, by, "left")
    moving = F.greatest(F.lit(1), F.col("moving"))
    mean = F.col("way") / moving
    spread = F.sqrt(F.greatest(F.lit(0.0), F.col("squares") / moving - mean * mean))
    whole = ["longest_stall_seconds", "road_climb_minutes", "longest_road_climb_minutes", "road_descent_minutes", "longest_road_descent_minutes"]
    return met.select(
        by,
        (F.col("moving") / F.greatest(F.lit(1), F.col("known"))).alias("distance_active_ratio"),
        (F.coalesce("common", F.lit(0)) / moving).alias("step_dominance_ratio"),
        F.when(F.col("way") > 0, spread / mean).otherwise(F.lit(float("inf"))).alias("speed_variation"),
        (F.col("stalled") / F.greatest(F.lit(1), F.col("n") - 1)).alias("stall_active_ratio"),
        (mean * UNIT_METRES * 3.6).alias("moving_speed_kmh"),
        *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in whole],
        _yes(F.col("climb_before_descent")).alias("climb_before_descent"),
    )


def with_type_figures(workouts: DataFrame, samples: DataFrame, key: str = "id", by: str = "workout_id") -> DataFrame:
    """Workouts with the figures of their recordings that `classify.workout_type` reads; null without a recording."""
    figures = stall_metrics(samples, by).select(F.col(by).alias(key), *[F.col(a).alias(b) for a, b in TYPE_FIGURES.items()])
    return workouts.join(figures, key, "left")


def tail_trimmed(samples: DataFrame, by: str = "workout_id") -> DataFrame:
    """Samples (by, idx, power, cadence, heart_rate, speed) without a corrupt end.

    Such an end is a leap of power and cadence over the seconds before, followed by high values without heart rate or speed
    and at last by zeros only; everything from the leap on goes. Other recordings stay as they are. Missing values are
    neither zeros nor high.
    """
    columns = samples.columns
    whole = Window.partitionBy(by)
    before = whole.orderBy("idx").rowsBetween(-TAIL_BASELINE, -1)
    power, cadence, idx = F.col("power"), F.col("cadence"), F.col("idx")
    empty = _yes((power == 0) & (cadence == 0) & (F.col("heart_rate") == 0) & (F.col("speed") == 0))
    rows = samples.select(
        "*",
        F.count(F.lit(1)).over(whole).alias("__n"),
        (F.coalesce(F.max(F.when(~empty, idx)).over(whole), F.lit(-1)) + 1).alias("__zeros"),
        F.count(power + cadence).over(before).alias("__known"),
        (F.sum(power).over(before) / TAIL_BASELINE).alias("__power"),
        (F.sum(cadence).over(before) / TAIL_BASELINE).alias("__cadence"),
    )
    leap = (power >= 600) & (cadence >= 130) & (power - F.col("__power") >= 250) & (cadence - F.col("__cadence") >= 25) & (F.col("__power") < 500) & (F.col("__cadence") < 120)
    near = (F.col("__known") == TAIL_BASELINE) & (idx >= F.col("__zeros") - TAIL_SEARCH) & (idx < F.col("__zeros"))
    rows = rows.withColumn("__cut", F.min(F.when(near & leap, idx)).over(whole))
    inside = (idx >= F.col("__cut")) & (idx < F.col("__zeros"))
    signs = [power >= 900, cadence >= 140, (F.col("speed") == 0) & (power >= 500), (F.col("heart_rate") == 0) & (power >= 500)]
    counts = [F.count(F.when(inside & s, 1)).over(whole).alias(f"__sign{i}") for i, s in enumerate(signs)]
    rows = rows.select("*", *counts)
    corrupt = (F.col("__n") >= TAIL_RECORDS) & (F.col("__n") - F.col("__zeros") >= TAIL_ZEROS) & (F.col("__n") - F.col("__cut") >= TAIL_LENGTH)
    for i in range(len(signs)):
        corrupt = corrupt & (F.col(f"__sign{i}") >= TAIL_SAMPLES)
    return rows.filter(~(_yes(corrupt) & (idx >= F.col("__cut")))).select(*columns)
