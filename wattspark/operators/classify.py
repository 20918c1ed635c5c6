"""Decision lists over the figures of a workout, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

INDOOR_METRES = 2000.0


def _n(name: str, default: float = 0.0) -> Column:
    return F.greatest(F.lit(0.0), F.coalesce(F.col(name).cast("double"), F.lit(default)))


def workout_type() -> Column:
    """indoor, road, mountain, motorsport or unknown, of a row with valid_gps, span_metres, total_distance,
    total_timer_time, total_ascent, avg_speed, max_speed, avg_power, avg_cadence, gps_path_metres and the
    climbing figures climb_minutes, longest_climb, descent_minutes, longest_descent, climb_first; without GPS also of
    distance_active_ratio, step_dominance_ratio, speed_variation, stall_ratio, longest_stall_seconds and moving_speed.
    Missing figures are 0, a missing speed_variation is without bound."""
    metres, seconds, speed, span = _n("total_distance"), _n("total_timer_time"), _n("avg_speed"), _n("span_metres")
    gps = F.coalesce(F.col("valid_gps"), F.lit(False))
    drive = (_n("avg_power") > 0) | (_n("avg_cadence") > 0)
    climb_rate = F.when(metres > 0, _n("total_ascent") / (metres / 1000)).otherwise(F.lit(0.0))
    first = F.coalesce(F.col("climb_first"), F.lit(False))
    long_climb = (_n("climb_minutes") >= 20) & (_n("longest_climb") >= 10) & (_n("descent_minutes") >= 3) & first
    circuit = gps & (metres >= 5000) & (speed >= 45) & (_n("max_speed") >= 100) & span.between(250.0, 1500.0) & (metres >= 10 * span) & ~drive
    on_the_spot = gps & (span <= 250)
    hilly = ((speed <= 23.5) & (climb_rate >= 14)) | ((speed <= 21) & (climb_rate >= 12)) | ((speed <= 18) & (climb_rate >= 6))
    return (
        F.when((seconds < 300) | ~((metres >= 1000) | drive), "unknown")
        .when(~gps & (metres <= INDOOR_METRES), "indoor")
        .when(~gps & (_n("total_ascent") <= 1) & (_n("distance_active_ratio") >= 0.9) & (_n("step_dominance_ratio") >= 0.9) & (_n("speed_variation", float("inf")) <= 0.06) & drive, "indoor")
        .when(~gps & (_n("stall_ratio") >= 0.15) & (_n("longest_stall_seconds") >= 60) & (_n("moving_speed") >= 23.5), "road")
        .when(~gps & long_climb & (_n("longest_descent") >= 3), "road")
        .when(circuit, "motorsport")
        .when(on_the_spot & ((metres <= INDOOR_METRES) | ((metres >= 5000) & (_n("gps_path_metres") > 0) & (metres >= 5 * _n("gps_path_metres")))), "indoor")
        .when(on_the_spot | (metres < 5000) | (speed <= 0), "unknown")
        .when(gps & (speed <= 24) & (climb_rate >= 15) & long_climb, "mountain")
        .when(hilly, "mountain")
        .when((speed >= 24) | ((speed >= 20) & (climb_rate < 12)), "road")
        .otherwise("unknown")
    )


def allowance(used: Column, limit: Column) -> Column:
    """allowed, warning from 80 % of a limit, or denied at it; without a limit allowed."""
    return F.when(limit.isNull(), "allowed").when(used >= limit, "denied").when(used >= limit * 0.8, "warning").otherwise("allowed")


def match_status(score: Column) -> Column:
    return F.when(score >= 0.85, "completed").when(score >= 0.6, "partial").when(score >= 0.35, "loose").otherwise("missed")


def match_score(duration: Column, intensity: Column, objective: Column, timing: Column) -> Column:
    return 0.32 * duration + 0.26 * intensity + 0.24 * objective + 0.18 * timing


def activity_problem() -> Column:
    """Why a manual activity is no good, or null: of a row with start_time, duration_seconds, activity_type, average_power."""
    return (
        F.when(F.col("start_time").isNull(), "start missing")
        .when(F.col("duration_seconds").isNull() | (F.col("duration_seconds") <= 0), "duration missing")
        .when(F.col("duration_seconds") > 7 * 86400, "too long")
        .when(F.col("activity_type").isNull() | (F.trim("activity_type") == ""), "type missing")
        .when((F.col("average_power") < 0) | (F.col("average_power") > 3000), "power out of range")
    )
