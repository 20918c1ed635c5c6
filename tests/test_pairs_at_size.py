"""Pairs by shared groups and by boxes: right rows, and plans whose cost doesn't hang on copies or on the driver."""

import random

from pyspark.sql import functions as F

from wattspark import registry
from wattspark.functions.numeric import rounded
from wattspark.operators import grouped, joins

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_group_pairs_are_made_once(spark):
    r = random.Random(6)
    bridge = lambda n: [(r.choice([None, *range(30)]), r.choice([None, *range(8)])) for _ in range(n)]
    left, right = spark.createDataFrame(bridge(90), "w long, group_id long"), spark.createDataFrame(bridge(120), "u long, group_id long")
    want = left.join(right, "group_id").select("w", "u").distinct()
    got = joins.shared_group_pairs(left, right, "w", "u")
    assert got.columns == ["w", "u"]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)
    # pairs are unfolded last of all, and not made distinct
    assert not got._jdf.queryExecution().optimizedPlan().toString().startswith("Aggregate")


def test_group_pairs_are_made_by_many_tasks(spark):
    # small sides of few sets, as all pairs of a table come from little input
    left, right = spark.range(400).selectExpr("id AS w", "id % 2 AS group_id"), spark.range(300).selectExpr("id AS u", "id % 2 AS group_id")
    tasks = [n for _, n in joins.shared_group_pairs(left, right, "w", "u").groupBy(F.spark_partition_id()).count().collect()]
    assert sum(tasks) == 2 * 200 * 150 and len(tasks) > 16 and max(tasks) < sum(tasks) / 6


def test_a_segment_is_matched_once(spark):
    got = plan(registry.queries()["krn18_segment_matches"](spark, SF))
    kernel = next(x for x in got.split("\n") if "MapInPandas" in x)
    assert kernel.index("MapInPandas") > next(x for x in got.split("\n") if "Join" in x).index("Join")
    assert "Join" not in got[got.index("MapInPandas") :].split("Scan parquet")[0] and "Broadcast" not in got


def test_tracks_are_not_sent_through_the_driver(spark):
    assert "Broadcast" not in plan(registry.queries()["krn19_route_similarity"](spark, SF))


def test_tracks_are_compared_once_a_box(spark):
    # below the join of the workouts, not above it
    got = plan(registry.queries()["krn19_route_similarity"](spark, SF))
    assert got.index("MapInPandas") > got.index("Join")


def test_routes_by_box_are_the_similar_ones(spark):
    r, inf, nan = random.Random(8), float("inf"), float("nan")
    places = [(40 + i / 50, 5 + j / 50) for i in range(3) for j in range(2)]
    odd = [None, nan, inf, 0.0, -0.0, -5.0, 0.3, 1e308, 1.7e308]

    def row(i):
        lat, lng = r.choice([*places, (None, 5.0), (nan, 5.0)])
        return (i % 190, r.choice([None, 1, 2]), lat, lng, lat and lat + 0.05, lng + 0.05, r.choice([*odd, *[r.uniform(800, 1300) for _ in odd]]), r.choice([*odd, *[r.uniform(80, 130) for _ in odd]]))

    table = spark.createDataFrame([row(i) for i in range(200)], "id long, uid long, min_lat double, min_lng double, max_lat double, max_lng double, total_distance double, total_ascent double")
    names = ["uid", "workout_id_a", "workout_id_b"]
    want = joins.similar_routes(table, 0.2, 0.3, 3000.0).select(*names).collect()
    got = joins.similar_routes_by_box(table, lambda boxes: boxes, 0.2, 0.3, 3000.0).select(*names).collect()
    assert len(want) > 100 and sorted(map(tuple, got)) == sorted(map(tuple, want))


def test_scores_are_those_of_the_kernel(spark):
    from wattspark.operators import tracks

    r = random.Random(9)
    lines = [[(40 + s + i * 1e-4 * t, 5 + i * 1e-4) for i in range(30)] for s in (0, 1e-4, 5e-3) for t in (1.0, 1.1)]
    rows = [(i, r.choice(lines), r.choice(lines), *[r.uniform(0, 2) for _ in range(4)]) for i in range(60)]
    pairs = spark.createDataFrame(rows, "id long, track_a array<struct<lat:double,lng:double>>, track_b array<struct<lat:double,lng:double>>, total_distance_a double, total_distance_b double, total_ascent_a double, total_ascent_b double")
    got = {x.id: x.score for x in grouped.common_routes(pairs).select("id", grouped.route_score().alias("score")).collect()}
    import numpy as np

    want = {x[0]: tracks.similarity(np.array(x[1]), np.array(x[2]), (x[3], x[4]), (x[5], x[6])) for x in rows}
    assert got == {k: v for k, v in want.items() if v} and 0 < len(got) < 60


def test_rounding_is_that_of_spark(spark):
    r = random.Random(10)
    odd = [None, float("nan"), float("inf"), -0.00005, -0.0, 1e300, 123456.00005, *[(n + 0.5) / 1e4 for n in range(200)], *[r.random() for _ in range(500)]]
    rows = spark.createDataFrame([(x,) for x in odd], "x double").select(rounded(F.col("x"), 4), F.round("x", 4)).collect()
    assert all(repr(a) == repr(b) for a, b in rows)
