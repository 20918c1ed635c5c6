"""Nested results, calendars, tracks and chart samples."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from wattspark import analog
from wattspark.analog import oracle
from wattspark.functions import calendar, geo
from wattspark.operators import windows
from wattspark.registry import register


@register("agg08_feed_totals", oracle("workouts activities", "SELECT count(*) AS entries, round(sum(distance), 2) AS distance, sum(seconds) AS seconds FROM (SELECT total_distance AS distance, total_timer_time AS seconds FROM workouts WHERE uid = 3 AND year = 1998 UNION ALL SELECT NULL, duration_seconds FROM activities WHERE uid = 3 AND year(start_time) = 1998)"))
def agg08(spark, d):
    w = analog.workouts(spark, d).select("uid", "start_time", F.col("total_distance").alias("distance"), F.col("total_timer_time").alias("seconds"))
    a = analog.activities(spark, d).select("uid", "start_time", F.lit(None).cast("double").alias("distance"), F.col("duration_seconds").alias("seconds"))
    feed = w.unionByName(a).filter((F.col("uid") == 3) & (F.year("start_time") == 1998))
    return feed.agg(F.count(F.lit(1)).alias("entries"), F.round(F.sum("distance"), 2).alias("distance"), F.sum("seconds").alias("seconds"))


@register("agg07_page_count", oracle("workouts", "SELECT count(*) AS total, CAST(ceil(count(*) / 25.0) AS BIGINT) AS last_page FROM workouts WHERE workout_type = 'road'"))
def agg07(spark, d):
    return analog.workouts(spark, d).filter("workout_type = 'road'").agg(F.count(F.lit(1)).alias("total"), F.ceil(F.count(F.lit(1)) / 25).alias("last_page"))


@register("agg20_lifetime_counts", oracle("workouts activities", "SELECT w.uid, w.n AS workouts, coalesce(a.n, 0) AS activities FROM (SELECT uid, count(*) AS n FROM workouts GROUP BY uid) w LEFT JOIN (SELECT uid, count(*) AS n FROM activities GROUP BY uid) a ON a.uid = w.uid"))
def agg20(spark, d):
    w = analog.workouts(spark, d).groupBy("uid").agg(F.count(F.lit(1)).alias("workouts"))
    a = analog.activities(spark, d).groupBy("uid").agg(F.count(F.lit(1)).alias("n"))
    return w.join(a, "uid", "left").select("uid", "workouts", F.coalesce("n", F.lit(0)).alias("activities"))


@register("agg21_plan_document", oracle("workouts", "SELECT uid, year_week AS week, '[' || string_agg('{\"day\":' || wd || ',\"id\":' || id || '}', ',' ORDER BY wd, id) || ']' AS sessions FROM (SELECT *, isodow(start_time) AS wd FROM workouts WHERE year = 1997) GROUP BY ALL"))
def agg21(spark, d):
    day = F.weekday("start_time") + 1
    one = F.struct(day.alias("day"), "id")
    return analog.workouts(spark, d).filter("year = 1997").groupBy("uid", F.col("year_week").alias("week")).agg(F.to_json(F.array_sort(F.collect_list(one))).alias("sessions"))


@register("agg23_owner_groups", oracle("workouts shares", "SELECT id, CASE WHEN uid = 7 THEN coalesce('[' || (SELECT string_agg(group_id::VARCHAR, ',' ORDER BY group_id) FROM shares s WHERE s.workout_id = w.id) || ']', '[]') END AS groups FROM workouts w"))
def agg23(spark, d):
    g = analog.shares(spark, d).groupBy(F.col("workout_id").alias("id")).agg(F.array_sort(F.collect_set("group_id")).alias("g"))
    w = analog.workouts(spark, d).join(g, "id", "left")
    return w.select("id", F.when(F.col("uid") == 7, F.to_json(F.coalesce("g", F.array().cast("array<bigint>")))).alias("groups"))


@register("agg25_users_with_counts", oracle("users workouts", "SELECT u.id, count(w.id) AS workouts FROM users u LEFT JOIN workouts w ON w.uid = u.id GROUP BY u.id"))
def agg25(spark, d):
    n = analog.workouts(spark, d).groupBy(F.col("uid").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    return analog.users(spark, d).select("id").join(n, "id", "left").select("id", F.coalesce("n", F.lit(0)).alias("workouts"))


@register("flt12_recent_others", "SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-20' - INTERVAL 7 DAY AND ts < TIMESTAMP '2024-01-20' AND user_id <> 3")
def flt12(spark, d):
    now = F.lit("2024-01-20").cast("timestamp_ntz")
    return spark.read.parquet(f"{d}/events.parquet").filter((F.col("ts") >= now - F.expr("INTERVAL 7 DAYS")) & (F.col("ts") < now) & (F.col("user_id") != 3)).select("event_id")


@register("flt14_optional_exclusion", oracle("workouts", "SELECT id FROM workouts WHERE NOT (id IN (1, 2, 3)) AND uid = 1"))
def flt14(spark, d):
    excluded: list[int] | None = [1, 2, 3]
    w = analog.workouts(spark, d).filter("uid = 1")
    return (w if excluded is None else w.filter(~F.col("id").isin(*excluded))).select("id")


@register("flt21_user_search", oracle("users", "SELECT id, display_name FROM users WHERE (display_name ILIKE '%00012%' OR id::VARCHAR = '77') AND segment = 'MACHINERY'"))
def flt21(spark, d):
    u = analog.users(spark, d)
    return u.filter((F.col("display_name").ilike("%00012%") | (F.col("id").cast("string") == "77")) & (F.col("segment") == "MACHINERY")).select("id", "display_name")


@register("flt23_open_invites", "SELECT event_id FROM events WHERE (event_type = 'signup' OR (event_type IN ('click', 'view') AND ts >= TIMESTAMP '2024-01-23')) AND event_id NOT IN (SELECT event_id FROM events WHERE event_id % 10 = 0)")
def flt23(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    fresh = F.col("event_type").isin("click", "view") & (F.col("ts") >= F.lit("2024-01-23").cast("timestamp_ntz"))
    dismissed = e.filter("event_id % 10 = 0").select("event_id")
    return e.filter((F.col("event_type") == "signup") | fresh).join(dismissed, "event_id", "left_anti").select("event_id")


@register("fnd05_relative_range", oracle("workouts", "SELECT uid, greatest(min(start_time::DATE), (max(start_time::DATE) - INTERVAL 6 MONTH)::DATE) AS since, max(start_time::DATE) AS until FROM workouts GROUP BY uid"))
def fnd05(spark, d):
    day = F.to_date("start_time")
    return analog.workouts(spark, d).groupBy("uid").agg(F.greatest(F.min(day), F.add_months(F.max(day), -6)).alias("since"), F.max(day).alias("until"))


@register("fnd06_snapped_range", oracle("workouts", "SELECT uid, date_trunc('quarter', min(start_time))::DATE AS since, (date_trunc('quarter', max(start_time)) + INTERVAL 3 MONTH)::DATE AS until FROM workouts GROUP BY uid"))
def fnd06(spark, d):
    lo, hi = F.min("start_time").alias("lo"), F.max("start_time").alias("hi")
    snap = lambda c: F.date_trunc("quarter", c).cast("date")
    return analog.workouts(spark, d).groupBy("uid").agg(lo, hi).select("uid", snap("lo").alias("since"), calendar.period_end(snap("hi"), "quarter").alias("until"))


@register("fns07_file_names", oracle("workouts", "SELECT id, strftime(start_time + INTERVAL 1 HOUR, '%Y-%m-%d_%H-%M-%S') || '.fit' AS name FROM workouts WHERE month IN (1, 2, 12)"))
def fns07(spark, d):
    local = F.from_utc_timestamp(F.col("start_time").cast("timestamp"), "Europe/Berlin")
    return analog.workouts(spark, d).filter(F.col("month").isin(1, 2, 12)).select("id", F.concat(F.date_format(local, "yyyy-MM-dd_HH-mm-ss"), F.lit(".fit")).alias("name"))


@register("fngeo06_span", oracle("workouts", "SELECT uid, min(min_lat) AS min_lat, max(max_lat) AS max_lat, round((min(min_lng) + max(max_lng)) / 2, 4) AS mid_lng FROM workouts GROUP BY uid"))
def fngeo06(spark, d):
    return analog.workouts(spark, d).groupBy("uid").agg(F.min("min_lat").alias("min_lat"), F.max("max_lat").alias("max_lat"), F.round((F.min("min_lng") + F.max("max_lng")) / 2, 4).alias("mid_lng"))


_STEP = "2 * 6371000.0 * asin(least(1.0, sqrt(pow(sin(radians(lat - plat) / 2), 2) + cos(radians(plat)) * cos(radians(lat)) * pow(sin(radians(lng - plng) / 2), 2))))"
_TRACK = "track AS (SELECT workout_id, idx, 48 + idx / 1000.0::DOUBLE AS lat, 8 + (event_id % 10) / 1000.0::DOUBLE AS lng, power FROM samples)"


def _track(spark, d):
    return analog.samples(spark, d).select("workout_id", "idx", (48 + F.col("idx") / 1000.0).alias("lat"), (8 + F.col("event_id") % 10 / 1000.0).alias("lng"), "power")


@register("fngeo09_track_length", oracle("samples", f"SELECT workout_id, round(sum({_STEP}), 2) AS metres FROM (SELECT *, lag(lat) OVER w AS plat, lag(lng) OVER w AS plng FROM track WINDOW w AS (PARTITION BY workout_id ORDER BY idx)) GROUP BY workout_id", _TRACK))
def fngeo09(spark, d):
    w = Window.partitionBy("workout_id").orderBy("idx")
    step = geo.haversine(F.lag("lat").over(w), F.lag("lng").over(w), F.col("lat"), F.col("lng"))
    return _track(spark, d).withColumn("step", step).groupBy("workout_id").agg(F.round(F.sum("step"), 2).alias("metres"))


@register("fngeo13_elevation_totals", oracle("samples", "SELECT workout_id, sum(CASE WHEN c > 0 AND c <= 25 THEN c ELSE 0 END) AS up, sum(CASE WHEN c < 0 AND c >= -25 THEN -c ELSE 0 END) AS down FROM (SELECT workout_id, floor(power) - lag(floor(power)) OVER (PARTITION BY workout_id ORDER BY idx) AS c FROM samples) GROUP BY workout_id"))
def fngeo13(spark, d):
    h = F.floor("power")
    c = h - F.lag(h).over(Window.partitionBy("workout_id").orderBy("idx"))
    s = analog.samples(spark, d).select("workout_id", c.alias("c"))
    up, down = F.when((F.col("c") > 0) & (F.col("c") <= 25), F.col("c")).otherwise(0), F.when((F.col("c") < 0) & (F.col("c") >= -25), -F.col("c")).otherwise(0)
    return s.groupBy("workout_id").agg(F.sum(up).cast("double").alias("up"), F.sum(down).cast("double").alias("down"))


@register("fngeo15_islands", oracle("samples", "SELECT workout_id, min(idx) AS first, max(idx) AS last, min(lat) AS min_lat, max(lng) AS max_lng FROM (SELECT *, idx - row_number() OVER (PARTITION BY workout_id ORDER BY idx) AS g FROM track WHERE power > 20) GROUP BY workout_id, g", _TRACK))
def fngeo15(spark, d):
    t = _track(spark, d).filter("power > 20")
    g = F.col("idx") - F.row_number().over(Window.partitionBy("workout_id").orderBy("idx"))
    return t.withColumn("g", g).groupBy("workout_id", "g").agg(F.min("idx").alias("first"), F.max("idx").alias("last"), F.min("lat").alias("min_lat"), F.max("lng").alias("max_lng")).drop("g")


@register("fngeo18_filled_heights", oracle("samples", "SELECT event_id, round(coalesce(a + (b - a) * (idx - ia) / nullif(ib - ia, 0), a, b), 4) AS ele FROM (SELECT *, last_value(v IGNORE NULLS) OVER p AS a, last_value(i IGNORE NULLS) OVER p AS ia, first_value(v IGNORE NULLS) OVER f AS b, first_value(i IGNORE NULLS) OVER f AS ib FROM (SELECT *, CASE WHEN idx % 7 = 0 THEN power END AS v, CASE WHEN idx % 7 = 0 THEN idx END AS i FROM samples) WINDOW p AS (PARTITION BY workout_id ORDER BY idx ROWS UNBOUNDED PRECEDING), f AS (PARTITION BY workout_id ORDER BY idx ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))"))
def fngeo18(spark, d):
    w = Window.partitionBy("workout_id").orderBy("idx")
    before, after = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    known = F.when(F.col("idx") % 7 == 0, F.struct("idx", F.col("power").alias("v")))
    s = analog.samples(spark, d).withColumn("k", known)
    s = s.withColumn("a", F.last("k", ignorenulls=True).over(before)).withColumn("b", F.first("k", ignorenulls=True).over(after))
    share = (F.col("idx") - F.col("a.idx")) / F.nullif(F.col("b.idx") - F.col("a.idx"), F.lit(0))
    line = F.coalesce(F.col("a.v") + (F.col("b.v") - F.col("a.v")) * share, F.col("a.v"), F.col("b.v"))
    return s.select("event_id", F.round(line, 4).alias("ele"))


@register("jsn04_array_append", "SELECT event_id, '[' || event_id || ',' || user_id || ']' AS targets FROM events")
def jsn04(spark, d):
    return spark.read.parquet(f"{d}/events.parquet").select("event_id", F.to_json(F.concat(F.array("event_id"), F.array("user_id"))).alias("targets"))


@register("krn24_short_zero_runs", oracle("samples", "SELECT event_id, CASE WHEN z = 1 AND n <= 3 THEN NULL ELSE v END AS v FROM (SELECT *, count(*) OVER (PARTITION BY workout_id, z, g) AS n FROM (SELECT *, idx - row_number() OVER (PARTITION BY workout_id, z ORDER BY idx) AS g FROM (SELECT *, CASE WHEN power < 30 THEN 0 ELSE power END AS v, CASE WHEN power < 30 THEN 1 ELSE 0 END AS z FROM samples)))"))
def krn24(spark, d):
    v = F.when(F.col("power") < 30, 0.0).otherwise(F.col("power"))
    s = analog.samples(spark, d).withColumn("v", v).withColumn("z", F.col("v") == 0)
    g = F.col("idx") - F.row_number().over(Window.partitionBy("workout_id", "z").orderBy("idx"))
    n = F.count(F.lit(1)).over(Window.partitionBy("workout_id", "z", "g"))
    return s.withColumn("g", g).withColumn("n", n).select("event_id", F.when(~(F.col("z") & (F.col("n") <= 3)), F.col("v")).alias("v"))


@register("srt12_resolution", oracle("samples", "SELECT event_id, m AS power FROM (SELECT *, CAST(sum(CAST(power AS DECIMAL(18,6))) OVER w AS DOUBLE) / count(power) OVER w AS m FROM samples WINDOW w AS (PARTITION BY workout_id ORDER BY idx ROWS BETWEEN 7 PRECEDING AND 7 FOLLOWING)) WHERE idx % 15 = 0"))
def srt12(spark, d):
    return analog.samples(spark, d).withColumn("m", windows.centred_mean("power", 15)).filter("idx % 15 = 0").select("event_id", F.col("m").alias("power"))


@register("win15_range_average", oracle("samples", "SELECT workout_id, round(avg(power), 4) AS mean FROM samples WHERE idx >= 20 AND idx < 50 GROUP BY workout_id"))
def win15(spark, d):
    s = analog.samples(spark, d).groupBy("workout_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("idx", "power"))), lambda x: x["power"]).alias("p"))
    part = F.slice("p", 21, 30)
    return s.filter(F.size("p") > 20).select("workout_id", F.round(F.aggregate(part, F.lit(0.0), lambda a, x: a + x) / F.size(part), 4).alias("mean"))


@register("set06_anti_insert", oracle("shares workouts", "SELECT w.id, w.uid AS group_id FROM workouts w LEFT JOIN shares s ON s.workout_id = w.id AND s.group_id = w.uid WHERE s.workout_id IS NULL"))
def set06(spark, d):
    there = analog.shares(spark, d).select(F.col("workout_id").alias("id"), "group_id")
    return analog.workouts(spark, d).select("id", F.col("uid").alias("group_id")).join(there, ["id", "group_id"], "left_anti")


@register("src24_array_relation", "SELECT v AS id, CAST(o AS BIGINT) AS ordinal FROM (SELECT unnest([42, 7, 7, 19]) AS v, unnest([1, 2, 3, 4]) AS o)")
def src24(spark, d):
    return spark.range(1).select(F.posexplode(F.array(*map(F.lit, (42, 7, 7, 19)))).alias("o", "id")).select("id", (F.col("o") + 1).cast("long").alias("ordinal"))


@register("set08_exact_tracks", oracle("samples", "SELECT sha256(string_agg(CAST(floor(lat * 100000 + 0.5) AS BIGINT) || ',' || CAST(floor(lng * 100000 + 0.5) AS BIGINT), ';' ORDER BY idx)) AS digest, workout_id FROM track GROUP BY workout_id", _TRACK))
def set08(spark, d):
    fine = lambda c: F.floor(F.col(c) * 100000 + 0.5).cast("string")
    points = F.array_sort(F.collect_list(F.struct("idx", F.concat_ws(",", fine("lat"), fine("lng")).alias("p"))))
    return _track(spark, d).groupBy("workout_id").agg(F.sha2(F.array_join(F.transform(points, lambda x: x["p"]), ";"), 256).alias("digest"))


