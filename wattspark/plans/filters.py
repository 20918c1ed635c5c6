"""Filters, projections, sorts and paging."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from wattspark import analog
from wattspark.analog import oracle
from wattspark.functions.geo import haversine, within_degrees
from wattspark.operators import query
from wattspark.operators.aggregates import quantile_at
from wattspark.registry import register

ALLOWED = ("id", "uid", "total_distance", "total_ascent", "total_timer_time", "avg_power", "avg_normalized_power", "total_calories", "total_work", "workout_type", "intensity_tags", "year", "year_month")
NUMERIC = tuple(c for c in ALLOWED if c != "workout_type")
TEXT = ("workout_type", "id", "year_month")


def _filtered(filters):
    return lambda spark, d: analog.workouts(spark, d).filter(query.predicate(filters, ALLOWED, NUMERIC, TEXT)).select("id", "uid")


for _name, _filters, _sql in (
    ("flt01_descriptor", [{"field": "total_distance", "type": ">=", "value": "100000"}, {"field": "nothing", "type": "=", "value": 1}, {"field": "workout_type", "type": "odd", "value": "road"}, {"field": "avg_power", "type": "<", "value": 250}], "total_distance >= 100000 AND workout_type = 'road' AND avg_power < 250"),
    ("flt02_like", [{"field": "workout_type", "type": "like", "value": "OUNT"}], "workout_type ILIKE '%OUNT%'"),
    ("flt03_bit_any", [{"field": "intensity_tags", "type": "bit_any", "value": 20.7}, {"field": "intensity_tags", "type": "bit_any", "value": 64}], "(intensity_tags & 20) <> 0"),
    ("flt04_search_number", [{"field": "__search", "value": "power >= 280"}], "avg_power >= 280"),
    ("flt05_search_column", [{"field": "__search", "value": "np: 17"}], "CAST(CAST(round(avg_normalized_power) AS BIGINT) AS VARCHAR) ILIKE '%17%'"),
    ("flt06_search_all", [{"field": "__search", "value": "road"}], "workout_type ILIKE '%road%' OR id::VARCHAR ILIKE '%road%' OR year_month::VARCHAR ILIKE '%road%'"),
    ("flt07_alias", [{"field": "__search", "value": "distance < 90000"}, {"field": "__search", "value": "type: moun"}], "total_distance < 90000 AND workout_type ILIKE '%moun%'"),
):
    register(_name, oracle("workouts", f"SELECT id, uid FROM workouts WHERE {_sql}"))(_filtered(_filters))


@register("flt08_drill_down", oracle("workouts", "SELECT id, start_time FROM workouts WHERE start_time >= TIMESTAMP '1997-04-01' AND start_time < TIMESTAMP '1997-07-01'"))
def flt08(spark, d):
    t = F.col("start_time")
    return analog.workouts(spark, d).filter((t >= F.lit("1997-04-01").cast("timestamp_ntz")) & (t < F.lit("1997-07-01").cast("timestamp_ntz"))).select("id", "start_time")


@register("flt09_not_motorsport", oracle("workouts", "SELECT id, CASE WHEN id % 10 = 0 THEN NULL ELSE workout_type END AS kind FROM workouts WHERE (CASE WHEN id % 10 = 0 THEN NULL ELSE workout_type END) IS DISTINCT FROM 'motorsport'"))
def flt09(spark, d):
    kind = F.when(F.col("id") % 10 != 0, F.col("workout_type"))
    return analog.workouts(spark, d).select("id", kind.alias("kind")).filter(~F.col("kind").eqNullSafe("motorsport"))


@register("flt10_motorsport_excluded", oracle("workouts", "SELECT id FROM workouts WHERE CASE WHEN id % 10 = 0 THEN NULL ELSE workout_type END <> 'motorsport'"))
def flt10(spark, d):
    return analog.workouts(spark, d).filter(F.when(F.col("id") % 10 != 0, F.col("workout_type")) != "motorsport").select("id")


@register("flt11_recent", oracle("workouts", "SELECT id FROM workouts WHERE start_time >= TIMESTAMP '2001-08-02' - INTERVAL 90 DAY"))
def flt11(spark, d):
    now = F.lit("2001-08-02").cast("timestamp_ntz")  # a parameter, so that reruns agree
    return analog.workouts(spark, d).filter(F.col("start_time") >= now - F.expr("INTERVAL 90 DAYS")).select("id")


@register("flt13_bounds", oracle("gps_segments", "SELECT id, name FROM gps_segments WHERE min_lat <= 42 AND max_lat >= 41 AND min_lng <= 8 AND max_lng >= 6 AND NOT (id IN (3, 14, 15)) ORDER BY id LIMIT 100"))
def flt13(spark, d):
    box = (F.col("min_lat") <= 42) & (F.col("max_lat") >= 41) & (F.col("min_lng") <= 8) & (F.col("max_lng") >= 6)
    return analog.gps_segments(spark, d).filter(box & ~F.col("id").isin(3, 14, 15)).orderBy("id").limit(100).select("id", "name")


@register("flt16_near_start", oracle("workouts", "SELECT id, round(2 * 6371000.0 * asin(least(1.0, sqrt(pow(sin(radians(min_lat - 42.0) / 2), 2) + cos(radians(42.0)) * cos(radians(min_lat)) * pow(sin(radians(min_lng - 8.0) / 2), 2)))), 3) AS metres FROM workouts WHERE 2 * 6371000.0 * asin(least(1.0, sqrt(pow(sin(radians(min_lat - 42.0) / 2), 2) + cos(radians(42.0)) * cos(radians(min_lat)) * pow(sin(radians(min_lng - 8.0) / 2), 2)))) <= 60000 AND abs(42.0 - min_lat) <= 60000 / 110000.0 AND abs(8.0 - min_lng) <= 60000 / 110000.0 / greatest(0.01, cos(radians(42.0)))"))
def flt16(spark, d):
    at = F.lit(42.0), F.lit(8.0), F.col("min_lat"), F.col("min_lng")
    return analog.workouts(spark, d).filter(within_degrees(*at, 60_000.0)).filter(haversine(*at) <= 60_000).select("id", F.round(haversine(*at), 3).alias("metres"))


@register("flt19_valid_efforts", oracle("segments", "SELECT wid, count(*) AS n FROM segments WHERE avg_power > 0 AND isfinite(avg_power) AND duration IN (360, 480, 720, 900, 960) GROUP BY wid"))
def flt19(spark, d):
    p = F.col("avg_power")
    good = (p > 0) & ~F.isnan(p) & (p != float("inf")) & F.col("duration").isin(360, 480, 720, 900, 960)
    return analog.segments(spark, d).filter(good).groupBy("wid").agg(F.count(F.lit(1)).alias("n"))


for _scope, _sql in (
    ("mine", "uid = 7"),
    ("shared", "uid <> 7 AND id IN (SELECT workout_id FROM shares SEMI JOIN (SELECT group_id FROM group_members WHERE user_id = 7) m USING (group_id))"),
    ("all", "uid = 7 OR id IN (SELECT workout_id FROM shares SEMI JOIN (SELECT group_id FROM group_members WHERE user_id = 7) m USING (group_id))"),
):
    register(f"flt20_access_{_scope}", oracle("workouts shares group_members", f"SELECT id, uid FROM workouts WHERE {_sql}"))(
        lambda spark, d, scope=_scope: query.access(analog.workouts(spark, d), 7, scope, analog.shares(spark, d), analog.group_members(spark, d)).select("id", "uid")
    )


@register("flt22_long_enough", oracle("samples", "SELECT workout_id, count(*) AS records FROM samples GROUP BY workout_id HAVING count(*) >= 60"))
def flt22(spark, d):
    return analog.samples(spark, d).groupBy("workout_id").agg(F.count(F.lit(1)).alias("records")).filter("records >= 60")


@register("prj01_default_projection", oracle("workouts shares", "SELECT id, uid = 7 AS is_owned, id % 13 = 0 AS is_favorite, (SELECT count(*) FROM shares s WHERE s.workout_id = w.id) AS share_group_count FROM workouts w"))
def prj01(spark, d):
    counts = analog.shares(spark, d).groupBy(F.col("workout_id").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    favourites = analog.workouts(spark, d).filter("id % 13 = 0").select("id").withColumn("fav", F.lit(True))
    w = analog.workouts(spark, d).join(counts, "id", "left").join(favourites, "id", "left")
    return w.select("id", (F.col("uid") == 7).alias("is_owned"), F.coalesce("fav", F.lit(False)).alias("is_favorite"), F.coalesce("n", F.lit(0)).alias("share_group_count"))


@register("prj03_manual_projection", oracle("activities", "SELECT id, start_time, start_time + to_seconds(CAST(duration_seconds AS INTEGER)) AS end_time, CAST(NULL AS DOUBLE) AS total_distance, 'manual' AS entity_type FROM activities"))
def prj03(spark, d):
    end = F.col("start_time") + F.make_dt_interval(secs=F.col("duration_seconds").cast("decimal(18,6)"))
    return analog.activities(spark, d).select("id", "start_time", end.alias("end_time"), F.lit(None).cast("double").alias("total_distance"), F.lit("manual").alias("entity_type"))


@register("prj04_sport", oracle("workouts", "SELECT id, CASE WHEN workout_type = 'motorsport' THEN 'other' ELSE 'cycling' END AS sport FROM workouts"))
def prj04(spark, d):
    return analog.workouts(spark, d).select("id", F.when(F.col("workout_type") == "motorsport", "other").otherwise("cycling").alias("sport"))


@register("prj09_known_values", oracle("workouts", "SELECT id, CASE WHEN workout_type IN ('road', 'gravel') THEN workout_type ELSE 'unknown' END AS kind FROM workouts"))
def prj09(spark, d):
    return analog.workouts(spark, d).select("id", F.when(F.col("workout_type").isin("road", "gravel"), F.col("workout_type")).otherwise("unknown").alias("kind"))


@register("srt01_page", oracle("workouts", "SELECT id, total_calories FROM (SELECT * FROM workouts ORDER BY total_calories DESC NULLS LAST, avg_power ASC NULLS LAST, id DESC LIMIT 50 OFFSET 100)"))
def srt01(spark, d):
    keys = query.order([{"field": "total_calories", "dir": "desc"}, {"field": "avg_power", "dir": "up"}, {"field": "odd"}], ALLOWED, ties=[F.col("id").desc()])
    return query.page(analog.workouts(spark, d), keys, 3, 50).select("id", "total_calories")


@register("srt02_null_order", oracle("workouts", "SELECT id FROM workouts ORDER BY avg_normalized_power DESC NULLS FIRST, id LIMIT 40"))
def srt02(spark, d):
    keys = query.order([{"field": "avg_normalized_power", "dir": "DESC"}, {"field": "id"}], ALLOWED)
    return analog.workouts(spark, d).orderBy(*keys).limit(40).select("id")


@register("srt05_fastest", oracle("segments", "SELECT sid, wid, duration, start_offset FROM (SELECT *, row_number() OVER (PARTITION BY sid ORDER BY duration, wid, start_offset, avg_power) AS rn FROM segments) WHERE rn <= 5"))
def srt05(spark, d):
    w = Window.partitionBy("sid").orderBy("duration", "wid", "start_offset", "avg_power")
    return analog.segments(spark, d).withColumn("rn", F.row_number().over(w)).filter("rn <= 5").select("sid", "wid", "duration", "start_offset")


@register("srt07_nearest_distance", oracle("workouts", "SELECT id FROM workouts WHERE total_distance BETWEEN 200000 * 0.9 AND 200000 * 1.1 ORDER BY abs(total_distance - 200000), id LIMIT 60"))
def srt07(spark, d):
    t = F.col("total_distance")
    return analog.workouts(spark, d).filter(t.between(180_000.0, 200_000 * 1.1)).orderBy(F.abs(t - 200_000), "id").limit(60).select("id")


@register("srt09_baseline", oracle("samples", "SELECT workout_id, (list_sort(list(power)))[1 + CAST(floor(0.3 * count(*)) AS INTEGER)] AS baseline FROM samples GROUP BY workout_id"))
def srt09(spark, d):
    return analog.samples(spark, d).groupBy("workout_id").agg(quantile_at(F.collect_list("power"), 0.3).alias("baseline"))


@register("srt10_every_tenth", oracle("samples", "SELECT workout_id, idx, power FROM (SELECT *, max(idx) OVER (PARTITION BY workout_id) AS top FROM samples) WHERE idx % 10 = 0 OR idx = top"))
def srt10(spark, d):
    top = F.max("idx").over(Window.partitionBy("workout_id"))
    return analog.samples(spark, d).withColumn("top", top).filter("idx % 10 = 0 OR idx = top").select("workout_id", "idx", "power")


@register("srt11_even_samples", oracle("samples", "SELECT workout_id, i AS k, p[1 + CAST(floor(i * (len(p) - 1) / 9.0 + 0.5) AS INTEGER)] AS power FROM (SELECT workout_id, list(power ORDER BY idx) AS p FROM samples GROUP BY workout_id), (SELECT unnest(range(10)) AS i)"))
def srt11(spark, d):
    series = analog.samples(spark, d).groupBy("workout_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("idx", "power"))), lambda x: x["power"]).alias("p"))
    points = F.transform(F.sequence(F.lit(0), F.lit(9)), lambda i: F.struct(i.cast("long").alias("k"), F.get("p", F.floor(i * (F.size("p") - 1) / 9.0 + 0.5).cast("int")).alias("power")))
    return series.select("workout_id", F.inline(points))


@register("srt13_best_candidate", oracle("segments", "SELECT wid, duration, avg_power, start_offset FROM (SELECT *, row_number() OVER (PARTITION BY wid ORDER BY duration DESC, avg_power DESC, start_offset, sid) AS rn FROM segments) WHERE rn = 1"))
def srt13(spark, d):
    from wattspark.operators.sets import best_of

    return best_of(analog.segments(spark, d), ["wid"], [F.desc("duration"), F.desc("avg_power"), F.col("start_offset"), F.col("sid")]).select("wid", "duration", "avg_power", "start_offset")
