"""Stalls, road climbs and corrupt ends on series made by hand."""

import math

from wattspark.operators import classify, stalls


def test_stalls_and_hills(spark):
    rows, at = [], 0
    for i in range(181):  # a minute's climb, a minute on the spot, a minute's descent
        at += 0 if i == 0 else 8 if i <= 60 else 0 if i <= 120 else 20
        rows.append((1, i, at, 250.0 if i <= 60 else 60.0, 80))
    rows += [(2, i, 7, 0.0, 0) for i in range(40)]
    rows += [(3, 0, None, None, None), (3, 1, 5, 10.0, None), (3, 2, None, 100.0, 90), (3, 3, 9, 100.0, 90)]
    s = spark.createDataFrame(rows, "workout_id long, idx long, distance long, power double, cadence int")
    got = {r.workout_id: r for r in stalls.stall_metrics(s).collect()}
    one = got[1]
    assert (one.road_climb_minutes, one.longest_road_climb_minutes, one.road_descent_minutes, one.longest_road_descent_minutes, one.climb_before_descent) == (1, 1, 1, 1, True)
    assert (one.longest_stall_seconds, one.stall_active_ratio, one.distance_active_ratio, one.step_dominance_ratio) == (60, 60 / 180, 120 / 180, 1.0)
    assert math.isclose(one.moving_speed_kmh, 14 * 0.5 * 3.6) and math.isclose(one.speed_variation, 6 / 14)
    assert got[2].speed_variation == math.inf and got[2].longest_stall_seconds == 0 and not got[2].climb_before_descent
    assert got[3].distance_active_ratio == 0.0 and got[3].stall_active_ratio == 0.0
    assert stalls.stall_metrics(s.limit(0)).count() == 0


def recording(key, high, zeros, heart=0.0):
    steady = [(200.0, 90.0, 140.0, 30.0)] * 30
    rows = steady + [(950.0, 150.0, heart, 0.0)] * high + [(0.0, 0.0, 0.0, 0.0)] * zeros
    return [(key, i, *r) for i, r in enumerate(rows)]


def test_only_corrupt_ends_go(spark):
    rows = recording(1, 10, 5) + recording(2, 10, 2) + recording(3, 4, 8) + recording(4, 10, 5, heart=150.0) + recording(5, 0, 10)
    rows += [(6, i, 0.0, 0.0, 0.0, 0.0) for i in range(20)] + [(7, i, None, None, None, None) for i in range(20)]
    s = spark.createDataFrame(rows, "workout_id long, idx long, power double, cadence double, heart_rate double, speed double")
    left = {r.workout_id: r["count"] for r in stalls.tail_trimmed(s).groupBy("workout_id").count().collect()}
    assert left == {1: 30, 2: 42, 3: 42, 4: 45, 5: 40, 6: 20, 7: 20}


def test_the_type_of_a_ride_without_gps_follows_from_its_samples(spark):
    rows, at = [], 0
    for i in range(29 * 60 + 1):  # 25 minutes up, 4 down
        up = i <= 25 * 60
        at += 0 if i == 0 else 8 if up else 20
        rows.append((1, i, at, 250.0 if up else 60.0, 80))
    s = spark.createDataFrame(rows, "workout_id long, idx long, distance long, power double, cadence int")
    same = (False, 0, 20_000.0, 1800.0, 500.0, 15.0, 60.0, 200.0, 80.0, 0.0)
    names = "valid_gps boolean, span_metres int, total_distance double, total_timer_time double, total_ascent double, avg_speed double, max_speed double, avg_power double, avg_cadence double, gps_path_metres double"
    w = spark.createDataFrame([(1, *same), (2, *same)], f"id long, {names}")
    found = stalls.with_type_figures(w, s).withColumn("kind", classify.workout_type())
    got = {r.id: r for r in found.collect()}
    assert (got[1].climb_minutes, got[1].descent_minutes, got[1].climb_first) == (25, 4, True)
    assert got[1].kind == "road" and got[2].climb_minutes is None and got[2].kind == "mountain"
