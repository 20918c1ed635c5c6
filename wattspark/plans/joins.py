"""Joins: semi, anti, spatial, band, as-of, interpolating."""

from __future__ import annotations

from pyspark.sql import functions as F

from wattspark import analog
from wattspark.analog import oracle
from wattspark.functions.numeric import zone
from wattspark.operators import aggregates, joins
from wattspark.registry import register


@register("joi01_efforts", oracle("workouts segments", "SELECT s.wid, s.duration, s.start_offset, w.uid FROM segments s JOIN workouts w ON w.id = s.wid WHERE w.workout_type <> 'motorsport'"))
def joi01(spark, d):
    return aggregates.efforts(analog.workouts(spark, d), analog.segments(spark, d)).select("wid", "duration", "start_offset", "uid")


@register("joi04_leaders", oracle("workouts users", "SELECT w.id, u.display_name FROM workouts w LEFT JOIN users u ON u.id = w.uid * 90"))
def joi04(spark, d):
    w, u = analog.workouts(spark, d), analog.users(spark, d)
    return w.join(u, w["uid"] * 90 == u["id"], "left").select(w["id"], "display_name")


@register("joi05_shared_semi", oracle("workouts shares", "SELECT id FROM workouts w WHERE EXISTS (SELECT 1 FROM shares s WHERE s.workout_id = w.id AND s.group_id IN (1, 2, 3))"))
def joi05(spark, d):
    s = analog.shares(spark, d).filter(F.col("group_id").isin(1, 2, 3)).select(F.col("workout_id").alias("id")).distinct()
    return analog.workouts(spark, d).join(s, "id", "left_semi").select("id")


@register("joi06_mine_or_shared", oracle("workouts shares", "SELECT id FROM workouts w WHERE uid = 4 OR EXISTS (SELECT 1 FROM shares s WHERE s.workout_id = w.id AND s.group_id = 9)"))
def joi06(spark, d):
    s = analog.shares(spark, d).filter("group_id = 9").select(F.col("workout_id").alias("id"))
    return joins.exists_or(analog.workouts(spark, d), F.col("uid") == 4, s, "id").select("id")


@register("joi07_common_group", oracle("shares group_members", "SELECT DISTINCT workout_id, user_id FROM shares JOIN group_members USING (group_id)"))
def joi07(spark, d):
    return joins.shared_group_pairs(analog.shares(spark, d), analog.group_members(spark, d), "workout_id", "user_id")


@register("joi08_not_matched", oracle("workouts segments", "SELECT id FROM workouts w WHERE NOT EXISTS (SELECT 1 FROM segments s WHERE s.wid = w.id AND s.duration = 900)"))
def joi08(spark, d):
    matched = analog.segments(spark, d).filter("duration = 900").select(F.col("wid").alias("id"))
    return analog.workouts(spark, d).join(matched, "id", "left_anti").select("id")


@register("joi10_undismissed", "SELECT event_id FROM events e LEFT JOIN (SELECT event_id AS gone FROM events WHERE event_type = 'error') x ON x.gone = e.event_id WHERE x.gone IS NULL")
def joi10(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    return e.join(e.filter("event_type = 'error'").select("event_id"), "event_id", "left_anti").select("event_id")


_OVERLAP = "a.min_lat <= b.max_lat AND b.min_lat <= a.max_lat AND a.min_lng <= b.max_lng AND b.min_lng <= a.max_lng"


@register("joi11_box_overlap", oracle("workouts gps_segments", f"SELECT a.id AS workout_id, b.id AS segment_id FROM workouts a JOIN gps_segments b ON a.uid = b.uid AND {_OVERLAP}"))
def joi11(spark, d):
    pairs = joins.box_join(analog.workouts(spark, d), analog.gps_segments(spark, d), 0.25, ["uid"])
    return pairs.select(F.col("a.id").alias("workout_id"), F.col("b.id").alias("segment_id"))


_METRES = "2 * 6371000.0 * asin(least(1.0, sqrt(pow(sin(radians(b.min_lat - a.min_lat) / 2), 2) + cos(radians(a.min_lat)) * cos(radians(b.min_lat)) * pow(sin(radians(b.min_lng - a.min_lng) / 2), 2))))"


@register("joi12_similar_routes", oracle("workouts", f"SELECT a.uid, a.id AS workout_id_a, b.id AS workout_id_b FROM workouts a JOIN workouts b ON a.uid = b.uid AND a.id < b.id AND {_OVERLAP} AND b.total_distance BETWEEN a.total_distance * 0.8 AND a.total_distance * 1.2 AND b.total_ascent BETWEEN a.total_ascent * 0.7 AND a.total_ascent * 1.3 AND {_METRES} <= 5000"))
def joi12(spark, d):
    return joins.similar_routes(analog.workouts(spark, d), 0.2, 0.3, 5000.0)


@register("joi13_one_row_source", oracle("workouts", "SELECT w.id FROM workouts w, (SELECT total_distance AS t FROM workouts WHERE id = 42) s WHERE w.total_distance BETWEEN s.t * 0.96 AND s.t * 1.04"))
def joi13(spark, d):
    w = analog.workouts(spark, d)
    source = w.filter("id = 42").select(F.col("total_distance").alias("t"))
    return w.join(F.broadcast(source), w["total_distance"].between(F.col("t") * 0.96, F.col("t") * 1.04)).select("id")  # a table of one row


_SNAP = "snap AS (SELECT uid, start_time, avg_power AS ftp FROM workouts WHERE id % 17 = 0)"


@register("joi16_asof_ftp", oracle("workouts", "SELECT w.id, s.ftp FROM workouts w ASOF LEFT JOIN snap s ON w.uid = s.uid AND w.start_time >= s.start_time", _SNAP))
def joi16(spark, d):
    w = analog.workouts(spark, d)
    snap = w.filter("id % 17 = 0").select("uid", F.col("start_time").alias("at"), F.col("avg_power").alias("ftp"))
    return joins.asof(w.select("id", "uid", "start_time"), snap, ["uid"], "start_time", "at", ["ftp"]).select("id", "ftp")


@register("joi17_asof_year", oracle("workouts", "SELECT uid, arg_max(avg_power, start_time) AS power FROM workouts WHERE year <= 1998 GROUP BY uid"))
def joi17(spark, d):
    return analog.workouts(spark, d).filter("year <= 1998").groupBy("uid").agg(F.max_by("avg_power", "start_time").alias("power"))


@register(
    "joi18_interpolated_ftp",
    oracle(
        "workouts",
        """SELECT w.id, round(CASE WHEN p.nxt IS NOT NULL AND w.start_time <= p.nxt_at THEN p.ftp + (p.nxt - p.ftp) * epoch(w.start_time - p.since) / epoch(p.nxt_at - p.since) ELSE l.ftp END, 4) AS ftp
           FROM workouts w ASOF LEFT JOIN p ON w.uid = p.uid AND w.start_time >= p.since LEFT JOIN (SELECT uid, arg_max(ftp, since) AS ftp FROM p GROUP BY uid) l ON l.uid = w.uid""",
        "p AS (SELECT *, lead(ftp) OVER (PARTITION BY uid ORDER BY since) AS nxt, lead(since) OVER (PARTITION BY uid ORDER BY since) AS nxt_at FROM (SELECT uid, make_date(year, CAST((year_quarter % 10 - 1) * 3 + 1 AS BIGINT), 1)::TIMESTAMP AS since, avg(avg_power) AS ftp FROM workouts WHERE id % 3 = 0 GROUP BY ALL))",
    ),
)
def joi18(spark, d):
    from wattspark.functions.calendar import period_start

    w = analog.workouts(spark, d)
    p = w.filter("id % 3 = 0").groupBy("uid", "year_quarter").agg(F.avg("avg_power").alias("v")).withColumn("at", period_start(F.col("year_quarter"), "quarter").cast("timestamp_ntz"))
    out = joins.interpolate(w.select("id", "uid", "start_time"), p, ["uid"], "start_time", "at", "v", "ftp")
    return out.select("id", F.round("ftp", 4).alias("ftp"))


@register("joi19_plan_weeks", oracle("workouts", "SELECT id, CAST(floor((epoch(start_time) - epoch(TIMESTAMP '1998-01-05')) / 604800) + 1 AS BIGINT) AS week FROM workouts WHERE start_time >= TIMESTAMP '1998-01-05' AND start_time < TIMESTAMP '1998-01-05' + INTERVAL 84 DAY"))
def joi19(spark, d):
    start = F.lit("1998-01-05").cast("date")
    week = F.floor(F.date_diff(F.to_date("start_time"), start) / 7) + 1
    return analog.workouts(spark, d).withColumn("week", week).filter(F.col("week").between(1, 12)).select("id", "week")


@register("joi20_nested_intervals", oracle("activities segments", "SELECT a.id, coalesce(string_agg(s.duration || '@' || s.start_offset, ';' ORDER BY s.start_offset, s.duration), '') AS profile FROM activities a LEFT JOIN segments s ON s.wid = a.id WHERE a.activity_type = 'cycling' GROUP BY a.id"))
def joi20(spark, d):
    a = analog.activities(spark, d).filter("activity_type = 'cycling'")
    s = analog.segments(spark, d).groupBy(F.col("wid").alias("id")).agg(F.array_sort(F.collect_list(F.struct("start_offset", "duration"))).alias("parts"))
    text = F.array_join(F.transform("parts", lambda x: F.concat_ws("@", x["duration"], x["start_offset"])), ";")
    return a.join(s, "id", "left").select("id", F.coalesce(text, F.lit("")).alias("profile"))


@register("joi22_period_document", oracle("workouts segments", "SELECT coalesce(a.uid, b.uid) AS uid, coalesce(a.p, b.p) AS period, a.p480, a.p900, b.n FROM (SELECT uid, year_quarter AS p, max(s.avg_power) FILTER (duration = 480) AS p480, max(s.avg_power) FILTER (duration = 900) AS p900 FROM segments s JOIN workouts w ON w.id = wid WHERE w.year < 1998 AND w.workout_type <> 'motorsport' GROUP BY ALL) a FULL JOIN (SELECT uid, year_quarter AS p, count(*) AS n FROM workouts WHERE year > 1996 GROUP BY ALL) b ON a.uid = b.uid AND a.p = b.p"))
def joi22(spark, d):
    e = aggregates.efforts(analog.workouts(spark, d), analog.segments(spark, d)).filter("year < 1998").withColumnRenamed("year_quarter", "period")
    a = e.groupBy("uid", "period").pivot("duration", [480, 900]).agg(F.max("avg_power"))
    b = analog.workouts(spark, d).filter("year > 1996").groupBy("uid", F.col("year_quarter").alias("period")).agg(F.count(F.lit(1)).alias("n"))
    return a.join(b, ["uid", "period"], "full").select("uid", "period", F.col("480").alias("p480"), F.col("900").alias("p900"), "n")


@register("joi24_rescan_targets", oracle("workouts gps_segments shares", f"SELECT DISTINCT b.id AS segment_id, a.uid FROM shares s JOIN workouts a ON a.id = s.workout_id JOIN gps_segments b ON b.id % 25 = s.group_id AND {_OVERLAP} WHERE a.uid <> b.uid"))
def joi24(spark, d):
    w = analog.workouts(spark, d).join(analog.shares(spark, d).withColumnRenamed("workout_id", "id"), "id")
    g = analog.gps_segments(spark, d).withColumn("group_id", F.col("id") % 25)
    return joins.box_join(w, g, 0.25, ["group_id"]).filter("a.uid <> b.uid").select(F.col("b.id").alias("segment_id"), F.col("a.uid").alias("uid")).distinct()


@register("joi26_left_chain", oracle("workouts shares activities", "SELECT w.id, s.group_id, a.estimated_tss FROM workouts w LEFT JOIN shares s ON s.workout_id = w.id LEFT JOIN activities a ON a.id = w.id"))
def joi26(spark, d):
    w = analog.workouts(spark, d).select("id")
    return w.join(analog.shares(spark, d).withColumnRenamed("workout_id", "id"), "id", "left").join(analog.activities(spark, d).select("id", "estimated_tss"), "id", "left").select("id", "group_id", "estimated_tss")


@register("joi28_update_from", oracle("segments gps_segments", "SELECT s.wid, s.sid, s.duration, CASE WHEN g.distance > 0 AND s.duration > 0 THEN floor(g.distance * 3.6 / s.duration * 10 + 0.5) / 10 END AS avg_speed FROM segments s LEFT JOIN gps_segments g ON g.id = s.sid"))
def joi28(spark, d):
    from wattspark.functions.numeric import segment_speed

    s = analog.segments(spark, d)
    g = analog.gps_segments(spark, d).select(F.col("id").alias("sid"), "distance")
    return s.join(g, "sid", "left").select("wid", "sid", "duration", segment_speed(F.col("distance"), F.col("duration")).alias("avg_speed"))


_ZONES = """bins AS (SELECT w.uid, w.start_time, e.bin, e.seconds FROM workouts w JOIN (SELECT user_id, least(200, greatest(0, floor((value - 1) / 5)))::INTEGER AS bin, count(*) AS seconds FROM events WHERE value > 0 GROUP BY ALL) e ON e.user_id = w.id % 150),
    snap AS (SELECT uid, start_time, avg_power AS ftp FROM workouts WHERE id % 50 = 7)"""


@register(
    "agg16_zone_distribution",
    oracle(
        "workouts",
        """SELECT uid, year(start_time) * 10 + quarter(start_time) AS period, """
        + ", ".join(f"CAST(coalesce(sum(seconds) FILTER (z = {i}), 0) AS BIGINT) AS z{i}" for i in range(1, 8))
        + """, CAST(coalesce(sum(seconds) FILTER (z IS NULL), 0) AS BIGINT) AS unclassified, CAST(sum(seconds) AS BIGINT) AS active FROM (SELECT *, CASE WHEN s <= 55 THEN 1 WHEN s <= 75 THEN 2 WHEN s <= 90 THEN 3 WHEN s <= 105 THEN 4 WHEN s <= 120 THEN 5 WHEN s <= 150 THEN 6 WHEN s > 150 THEN 7 END AS z FROM (
           SELECT b.uid, b.start_time, b.seconds, (b.bin * 5 + 3.0::DOUBLE) / f.ftp * 100 AS s FROM bins b ASOF LEFT JOIN snap f ON f.uid = b.uid AND b.start_time >= f.start_time)) GROUP BY ALL""",
        _ZONES,
    ),
)
def agg16(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet").select(F.col("user_id").alias("workout_id"), F.col("value").alias("power"))
    h = aggregates.histogram(e).select("workout_id", F.explode("bins").alias("bin", "seconds"))
    w = analog.workouts(spark, d)
    bins = w.select("uid", "start_time", (F.col("id") % 150).alias("workout_id")).join(h, "workout_id").select("uid", "start_time", "bin", "seconds")
    snap = w.filter("id % 50 = 7").select("uid", "start_time", F.col("avg_power").alias("ftp"))
    return aggregates.zone_distribution(bins, snap, "quarter")


@register("fnm17_zone", oracle("workouts", "SELECT id, CASE WHEN p <= 55 THEN 1 WHEN p <= 75 THEN 2 WHEN p <= 90 THEN 3 WHEN p <= 105 THEN 4 WHEN p <= 120 THEN 5 WHEN p <= 150 THEN 6 ELSE 7 END AS zone FROM (SELECT id, avg_power / 200.0 * 100 AS p FROM workouts)"))
def fnm17(spark, d):
    return analog.workouts(spark, d).select("id", zone(F.col("avg_power"), F.lit(200.0)).alias("zone"))


@register("joi21_ftp_merge", oracle("workouts segments", "SELECT w.id, coalesce(s.m, 0) AS best FROM workouts w LEFT JOIN (SELECT wid, max(avg_power) AS m FROM segments WHERE duration = 960 GROUP BY wid) s ON s.wid = w.id"))
def joi21(spark, d):
    best = analog.segments(spark, d).filter("duration = 960").groupBy(F.col("wid").alias("id")).agg(F.max("avg_power").alias("m"))
    return analog.workouts(spark, d).join(best, "id", "left").select("id", F.coalesce("m", F.lit(0.0)).alias("best"))
