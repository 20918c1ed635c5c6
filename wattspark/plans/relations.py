"""Owners, grants, feeds, bulk inserts, exact rounding and stored names."""

from __future__ import annotations

from pyspark.sql import functions as F

from wattspark import analog
from wattspark.analog import oracle
from wattspark.functions import numeric, text
from wattspark.operators import relations
from wattspark.registry import register


@register("joi02_segment_efforts", oracle("workouts segments", "SELECT s.sid, s.wid, w.uid, w.year_month, s.duration, s.start_offset FROM segments s JOIN workouts w ON w.id = s.wid WHERE w.workout_type <> 'motorsport'"))
def joi02(spark, d):
    return relations.segment_efforts(analog.segments(spark, d), analog.workouts(spark, d))


@register("joi03_owner", oracle("workouts users", "SELECT w.id, w.uid, u.display_name AS owner FROM workouts w JOIN users u ON u.id = w.uid"))
def joi03(spark, d):
    return relations.with_owner(analog.workouts(spark, d).select("id", "uid"), analog.users(spark, d)).select("id", "uid", "owner")


@register("joi09_not_shared", oracle("workouts shares group_members", "SELECT w.id, m.group_id FROM workouts w JOIN group_members m ON m.user_id = w.uid WHERE NOT EXISTS (SELECT 1 FROM shares s WHERE s.workout_id = w.id AND s.group_id = m.group_id)"))
def joi09(spark, d):
    return relations.not_shared(analog.workouts(spark, d), analog.shares(spark, d), analog.group_members(spark, d).withColumnRenamed("user_id", "uid"))


@register("joi23_load_with_activities", oracle("workouts activities", "SELECT w.uid, w.year, w.seconds, coalesce(a.n, 0) AS n FROM (SELECT uid, year, sum(total_timer_time) AS seconds FROM workouts GROUP BY ALL) w LEFT JOIN (SELECT uid, year(start_time) AS year, count(*) AS n FROM activities WHERE activity_type = 'cycling' GROUP BY ALL) a USING (uid, year)"))
def joi23(spark, d):
    load = analog.workouts(spark, d).groupBy("uid", "year").agg(F.sum("total_timer_time").alias("seconds"))
    n = analog.activities(spark, d).filter("activity_type = 'cycling'").groupBy("uid", F.year("start_time").alias("year")).agg(F.count(F.lit(1)).alias("n"))
    return relations.with_zeros(load, n, ["uid", "year"])


@register("joi29_granted_roles", oracle("users", "SELECT u.id, u.display_name, r.role, g.display_name AS granted_by FROM users u LEFT JOIN (SELECT id AS user_id, lower(segment) AS role, id % 7 + 1 AS grantor_id FROM users WHERE id % 3 = 0) r ON r.user_id = u.id LEFT JOIN users g ON g.id = r.grantor_id"))
def joi29(spark, d):
    u = analog.users(spark, d)
    roles = u.filter("id % 3 = 0").select(F.col("id").alias("user_id"), F.lower("segment").alias("role"), (F.col("id") % 7 + 1).alias("grantor_id"))
    return relations.granted_roles(u, roles)


@register("snk04_bulk_segments", oracle("segments", "SELECT wid, duration, start_offset FROM segments UNION ALL SELECT wid, duration, start_offset FROM segments WHERE wid % 2 = 0"))
def snk04(spark, d):
    s = analog.segments(spark, d).select("wid", "duration", "start_offset")
    columns = s.filter("wid % 2 = 0").groupBy("wid").agg(F.collect_list(F.struct("duration", "start_offset")).alias("all"))
    arrays = columns.select("wid", F.col("all.duration").alias("duration"), F.col("all.start_offset").alias("start_offset"))
    return s.unionByName(relations.rows_of_arrays(arrays, ["duration", "start_offset"]))


@register("snk05_parents_done", oracle("workouts segments", "SELECT id, CASE WHEN id IN (SELECT wid FROM segments WHERE duration = 960) THEN 'done' ELSE 'pending' END AS status FROM workouts"))
def snk05(spark, d):
    parents = analog.workouts(spark, d).select("id", F.lit("pending").alias("status"))
    return relations.with_children_done(parents, analog.segments(spark, d).filter("duration = 960"), "wid")


@register("snk11_effort_speeds", oracle("segments gps_segments", "SELECT s.sid, s.wid, s.duration, s.start_offset, CAST(round(CAST(CAST(g.distance AS DECIMAL(20,3)) * 36 / s.duration / 10 AS DECIMAL(24,6)), 1) AS DOUBLE) AS avg_speed FROM segments s JOIN gps_segments g ON g.id = s.sid"))
def snk11(spark, d):
    s = analog.segments(spark, d).select("sid", "wid", "duration", "start_offset")
    return relations.effort_speeds(s, analog.gps_segments(spark, d))


_FEED = "feed AS (SELECT uid, 'workout' AS entity_type, id AS entity_id, start_time FROM workouts UNION ALL SELECT uid, 'activity', id, start_time FROM activities)"


@register("srt03_feed_places", oracle("workouts activities", "SELECT uid, entity_type, entity_id, row_number() OVER (PARTITION BY uid ORDER BY date_trunc('day', start_time) DESC, entity_type, entity_id DESC) AS place FROM feed", _FEED))
def srt03(spark, d):
    one = lambda t, kind: t.select("uid", F.lit(kind).alias("entity_type"), F.col("id").alias("entity_id"), "start_time")
    feed = one(analog.workouts(spark, d), "workout").unionByName(one(analog.activities(spark, d), "activity"))
    return relations.ranked_within(feed, ["uid"], relations.feed_order(F.date_trunc("day", "start_time"))).drop("start_time")


@register("srt06_similarity_places", oracle("workouts", "SELECT id, row_number() OVER (PARTITION BY uid ORDER BY id % 3 = 0 DESC, CASE WHEN id % 4 <> 0 THEN id % 50 END DESC NULLS LAST, start_time DESC NULLS LAST, id DESC) AS place FROM workouts"))
def srt06(spark, d):
    k = F.col("id")
    w = analog.workouts(spark, d).select("id", "uid", "start_time", (k % 3 == 0).alias("is_direct"), F.when(k % 4 != 0, k % 50).alias("score"))
    return relations.ranked_within(w, ["uid"], relations.similarity_order()).select("id", "place")


@register("fnm02_decimal_round", oracle("workouts", "SELECT id, CAST(round(CAST(total_distance / 8 AS DECIMAL(24,6)), 1) AS DOUBLE) AS up, CAST(round(CAST(-total_distance / 8 AS DECIMAL(24,6)), 1) AS DOUBLE) AS down FROM workouts"))
def fnm02(spark, d):
    x = F.col("total_distance") / 8
    return analog.workouts(spark, d).select("id", numeric.decimal_round(x, 1).alias("up"), numeric.decimal_round(-x, 1).alias("down"))


@register("fnm03_fixed", oracle("workouts", "SELECT id, CAST(CAST(round(CAST(total_distance / 8 AS DECIMAL(24,6)), 2) AS DECIMAL(24,2)) AS VARCHAR) AS shown FROM workouts"))
def fnm03(spark, d):
    return analog.workouts(spark, d).select("id", numeric.fixed(F.col("total_distance") / 8, 2).alias("shown"))


@register("fnm06_median", oracle("workouts", "SELECT uid, workout_type, median(avg_power) AS power FROM workouts GROUP BY ALL"))
def fnm06(spark, d):
    return analog.workouts(spark, d).groupBy("uid", "workout_type").agg(F.median("avg_power").alias("power"))


@register("fns01_stored_names", oracle("gps_segments", "SELECT id, nullif(substr(lower(trim(name)), 1, 12), '') AS name FROM gps_segments"))
def fns01(spark, d):
    return analog.gps_segments(spark, d).select("id", text.stored_name(F.col("name"), 12).alias("name"))


@register("fns02_places_by_name", oracle("users", "SELECT id, row_number() OVER (PARTITION BY group_id ORDER BY lower(display_name), id) AS place FROM users"))
def fns02(spark, d):
    u = relations.ranked_within(analog.users(spark, d), ["group_id"], [F.lower("display_name").asc(), F.col("id").asc()])
    return u.select("id", "place")


@register("fns09_catalog", oracle("workouts", "SELECT id, CASE id % 6 WHEN 0 THEN 'generic' WHEN 1 THEN 'running' WHEN 2 THEN 'cycling' WHEN 5 THEN 'swimming' ELSE 'unknown' END AS sport FROM workouts"))
def fns09(spark, d):
    sports = {0: "generic", 1: "running", 2: "cycling", 5: "swimming"}
    return analog.workouts(spark, d).select("id", text.catalog_name((F.col("id") % 6).cast("int"), sports, "unknown").alias("sport"))


@register("jsn03_lists_or_empty", oracle("workouts shares", "SELECT w.id, coalesce('[' || string_agg(s.group_id::VARCHAR, ',' ORDER BY s.group_id) || ']', '[]') AS groups FROM workouts w LEFT JOIN shares s ON s.workout_id = w.id GROUP BY w.id"))
def jsn03(spark, d):
    return relations.json_list(analog.shares(spark, d), "workout_id", "group_id", analog.workouts(spark, d).select("id"), "groups")


@register("jsn08_map_lookup", oracle("workouts activities", "SELECT w.id, coalesce(a.n, 0) AS n FROM workouts w LEFT JOIN (SELECT uid, year(start_time) AS y, count(*) AS n FROM activities GROUP BY ALL) a ON a.uid = w.uid AND a.y = w.year"))
def jsn08(spark, d):
    maps = relations.summary_maps(analog.activities(spark, d).withColumn("y", F.year("start_time")), "uid", "y")
    return analog.workouts(spark, d).join(maps, "uid", "left").select("id", relations.looked_up(F.col("counts"), F.col("year")).alias("n"))


@register("src25_values", oracle("workouts", "SELECT v.kind, count(w.id) AS n FROM (VALUES ('road'), ('mountain'), ('indoor')) AS v(kind) LEFT JOIN workouts w ON w.workout_type = v.kind GROUP BY v.kind"))
def src25(spark, d):
    kinds = spark.sql("SELECT * FROM VALUES ('road'), ('mountain'), ('indoor') AS v(kind)")
    n = analog.workouts(spark, d).groupBy(F.col("workout_type").alias("kind")).agg(F.count(F.lit(1)).alias("n"))
    return relations.with_zeros(kinds, n, ["kind"])
