"""Aggregations and rankings over workouts and efforts."""

from __future__ import annotations

from pyspark.sql import functions as F

from wattspark import analog
from wattspark.analog import oracle
from wattspark.functions.numeric import stress_score
from wattspark.operators import aggregates, windows
from wattspark.registry import register

_EFFORTS = """efforts AS (SELECT s.*, w.uid, w.start_time, w.year, w.year_quarter, w.year_month, w.year_week FROM segments s JOIN workouts w ON w.id = s.wid WHERE w.workout_type <> 'motorsport')"""
_FTP = _EFFORTS + """, ftp AS (SELECT uid, year_quarter AS period, quantile_cont(avg_power, 0.95) FILTER (duration = 480) AS cp8, quantile_cont(avg_power, 0.95) FILTER (duration = 900) AS cp15,
    least(count(*) FILTER (duration = 480), count(*) FILTER (duration = 900)) AS confidence FROM efforts WHERE duration IN (480, 900) GROUP BY ALL)"""
_FTP_VALUE = "(cp8 + (ln(1200) - ln(480)) / (ln(900) - ln(480)) * (cp15 - cp8)) * 0.95"


def _efforts(spark, d):
    return aggregates.efforts(analog.workouts(spark, d), analog.segments(spark, d))


@register("agg01_ftp_by_period", oracle("workouts segments", f"SELECT uid, period, round(cp8, 4) AS cp8, round(cp15, 4) AS cp15, round({_FTP_VALUE}, 4) AS ftp, confidence FROM ftp", _FTP))
def agg01(spark, d):
    out = aggregates.ftp_by_period(_efforts(spark, d))
    return out.select("uid", "period", *[F.round(c, 4).alias(c) for c in ("cp8", "cp15", "ftp")], "confidence")


@register("agg04_efforts_by_workout", oracle("workouts segments", "SELECT wid, max(s.avg_power) FILTER (duration = 360) AS power_360, max(s.avg_power) FILTER (duration = 480) AS power_480, max(s.avg_power) FILTER (duration = 900) AS power_900 FROM segments s JOIN workouts w ON w.id = wid GROUP BY wid"))
def agg04(spark, d):
    rows = aggregates.efforts(analog.workouts(spark, d), analog.segments(spark, d), motorsport=True)
    return aggregates.efforts_by_workout(rows, (360, 480, 900)).drop("uid", "start_time")


@register("agg05_best_efforts", oracle("workouts segments", "SELECT uid, year_month AS period, duration, avg_power, wid, start_offset FROM (SELECT *, row_number() OVER (PARTITION BY uid, year_month, duration ORDER BY avg_power DESC, start_time, wid, start_offset) AS rn FROM efforts) WHERE rn = 1", _EFFORTS))
def agg05(spark, d):
    return aggregates.best_efforts(_efforts(spark, d), "month", (60, 360, 480, 720, 900, 960))


@register("agg06_summary", oracle("workouts", "SELECT uid, count(*) AS workouts, round(sum(total_distance), 2) AS distance, sum(total_timer_time) AS seconds FROM workouts WHERE workout_type <> 'motorsport' GROUP BY uid"))
def agg06(spark, d):
    out = aggregates.summary(analog.workouts(spark, d).filter("workout_type <> 'motorsport'"), ["uid"])
    return out.withColumn("distance", F.round("distance", 2))


@register("agg09_feed_totals", oracle("workouts activities", "SELECT (SELECT count(*) FROM workouts WHERE uid = 3) + (SELECT count(*) FROM activities WHERE uid = 3) AS entries, (SELECT sum(total_timer_time) FROM workouts WHERE uid = 3) + (SELECT sum(duration_seconds) FROM activities WHERE uid = 3) AS seconds"))
def agg09(spark, d):
    # two tables of one row each
    w = analog.workouts(spark, d).filter("uid = 3").agg(F.count(F.lit(1)).alias("n"), F.sum("total_timer_time").alias("s"))
    a = analog.activities(spark, d).filter("uid = 3").agg(F.count(F.lit(1)).alias("n"), F.sum("duration_seconds").alias("s"))
    return w.unionByName(a).agg(F.sum("n").alias("entries"), F.sum("s").alias("seconds"))


@register("agg10_distinct_groups", oracle("shares", "SELECT workout_id, count(DISTINCT group_id) AS share_groups FROM shares GROUP BY workout_id"))
def agg10(spark, d):
    return analog.shares(spark, d).groupBy("workout_id").agg(F.count_distinct("group_id").alias("share_groups"))


@register("agg11_segment_lists", oracle("segments", "SELECT wid, string_agg(DISTINCT sid::VARCHAR, ',' ORDER BY sid::VARCHAR) AS sids FROM segments GROUP BY wid"))
def agg11(spark, d):
    return analog.segments(spark, d).groupBy("wid").agg(F.array_join(F.array_sort(F.collect_set(F.col("sid").cast("string"))), ",").alias("sids"))


@register("agg12_duplicates", oracle("workouts", "SELECT unnest(ids[2:]) AS duplicate, ids[1] AS canonical FROM (SELECT list(id ORDER BY id) AS ids FROM workouts GROUP BY uid, start_time::DATE HAVING count(*) > 1)"))
def agg12(spark, d):
    from wattspark.operators.sets import canonical

    return canonical(analog.workouts(spark, d).withColumn("day", F.to_date("start_time")), ["uid", "day"], "id")


_LOADS = """loads AS (SELECT uid, start_time, CASE WHEN avg_normalized_power > 0 THEN floor(total_timer_time * avg_normalized_power * (avg_normalized_power / 250.0) / (250.0 * 3600) * 100 + 0.5) ELSE 0 END AS tss FROM workouts),
    sums AS (SELECT uid, start_time::DATE AS day, sum(tss) AS tss FROM loads GROUP BY ALL),
    span AS (SELECT uid, min(day) AS first, max(day) AS last FROM sums GROUP BY uid),
    days AS (SELECT uid, unnest(generate_series(first, last, INTERVAL 1 DAY))::DATE AS day FROM span),
    daily AS (SELECT d.uid, d.day, coalesce(s.tss, 0) AS tss, row_number() OVER (PARTITION BY d.uid ORDER BY d.day) AS i FROM days d LEFT JOIN sums s ON s.uid = d.uid AND s.day = d.day)"""
_FITNESS = _LOADS + """, fit AS (SELECT uid, day, i, tss, floor(0 + (tss - 0) / 42.0 + 0.5) AS ctl, floor(0 + (tss - 0) / 7.0 + 0.5) AS atl FROM daily WHERE i = 1
    UNION ALL SELECT d.uid, d.day, d.i, d.tss, floor(f.ctl + (d.tss - f.ctl) / 42.0 + 0.5), floor(f.atl + (d.tss - f.atl) / 7.0 + 0.5) FROM fit f JOIN daily d ON d.uid = f.uid AND d.i = f.i + 1)"""


def _daily(spark, d):
    w = analog.workouts(spark, d)
    return aggregates.daily_load(w.select("uid", "start_time", stress_score(F.col("total_timer_time"), F.col("avg_normalized_power"), F.lit(250.0)).alias("tss")))


@register("agg13_daily_load", oracle("workouts", "SELECT uid, day, tss FROM daily", _LOADS))
def agg13(spark, d):
    return _daily(spark, d)


@register("win19_fitness", oracle("workouts", "SELECT uid, day, tss, ctl, atl, floor(ctl - atl + 0.5) AS tsb FROM fit", _FITNESS))
def win19(spark, d):
    return aggregates.fitness(_daily(spark, d))


@register("agg14_fitness_by_month", oracle("workouts", "SELECT uid, year(day) * 100 + month(day) AS period, sum(tss) AS tss, arg_min(ctl, day) AS ctl_start, arg_max(ctl, day) AS ctl_end, floor(avg(floor(ctl - atl + 0.5)) + 0.5) AS tsb, floor(avg(atl) + 0.5) AS atl FROM fit GROUP BY ALL", _FITNESS))
def agg14(spark, d):
    return aggregates.fitness_by_period(aggregates.fitness(_daily(spark, d)), "month")


@register("agg15_activity_by_period", oracle("workouts", "SELECT uid, year_week AS period, count(*) AS workouts, round(sum(total_distance), 2) AS distance, sum(total_timer_time) AS seconds FROM workouts GROUP BY ALL"))
def agg15(spark, d):
    return aggregates.summary(analog.workouts(spark, d).withColumnRenamed("year_week", "period"), ["uid", "period"]).withColumn("distance", F.round("distance", 2))


@register("agg18_merged_sessions", oracle("workouts", "SELECT uid, start_time::DATE AS day, sum(total_timer_time) AS total_timer_time, round(sum(total_distance), 2) AS total_distance, round(sum(avg_power * total_timer_time) / sum(total_timer_time), 4) AS avg_power, round(sum(avg_normalized_power * total_timer_time) / sum(total_timer_time) FILTER (avg_normalized_power IS NOT NULL), 4) AS np, min(min_lat) AS min_lat, max(max_lng) AS max_lng FROM workouts GROUP BY ALL"))
def agg18(spark, d):
    m = aggregates.merged_sessions(analog.workouts(spark, d).withColumn("day", F.to_date("start_time")), ["uid", "day"])
    return m.select("uid", "day", "total_timer_time", F.round("total_distance", 2).alias("total_distance"), F.round("avg_power", 4).alias("avg_power"), F.round("avg_normalized_power", 4).alias("np"), "min_lat", "max_lng")


@register("agg19_usage", "SELECT user_id, year(ts) * 100 + month(ts) AS month, round(coalesce(sum(value), 0), 4) AS used, count(*) AS n FROM events GROUP BY ALL")
def agg19(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    return e.groupBy("user_id", (F.year("ts") * 100 + F.month("ts")).cast("long").alias("month")).agg(F.round(F.coalesce(F.sum("value"), F.lit(0.0)), 4).alias("used"), F.count(F.lit(1)).alias("n"))


@register("agg22_members", oracle("users", "SELECT group_id, '[' || string_agg('{\"id\":' || id || ',\"name\":\"' || display_name || '\"}', ',' ORDER BY lower(display_name), id) || ']' AS members FROM users GROUP BY group_id"))
def agg22(spark, d):
    member = F.struct(F.lower("display_name").alias("sort"), "id", F.struct("id", F.col("display_name").alias("name")).alias("member"))
    return analog.users(spark, d).groupBy("group_id").agg(F.to_json(F.transform(F.array_sort(F.collect_list(member)), lambda x: x["member"])).alias("members"))


@register("agg24_status_counts", "SELECT user_id, count(*) FILTER (event_type = 'purchase') AS completed, count(*) FILTER (event_type = 'click') AS partly, count(*) FILTER (event_type = 'view') AS loosely, round((count(*) FILTER (event_type = 'purchase') + 0.75 * count(*) FILTER (event_type = 'click') + 0.35 * count(*) FILTER (event_type = 'view')) / count(*), 4) AS rate, round(avg(value) FILTER (event_type <> 'error'), 4) AS compliance FROM events GROUP BY user_id")
def agg24(spark, d):
    kind = F.col("event_type")
    done, partly, loosely = F.count_if(kind == "purchase"), F.count_if(kind == "click"), F.count_if(kind == "view")
    e = spark.read.parquet(f"{d}/events.parquet")
    return e.groupBy("user_id").agg(done.alias("completed"), partly.alias("partly"), loosely.alias("loosely"), F.round((done + 0.75 * partly + 0.35 * loosely) / F.count(F.lit(1)), 4).cast("double").alias("rate"), F.round(F.avg(F.when(kind != "error", F.col("value"))), 4).alias("compliance"))


@register("agg26_athlete_model", oracle("segments workouts", "SELECT uid, round(quantile_cont(avg_power, 0.95) FILTER (duration = 360), 4) AS p360, round(quantile_cont(avg_power, 0.95) FILTER (duration = 960), 4) AS p960, CAST(greatest(5, least(100, floor(count(DISTINCT wid) / 20.0 * 100 + 0.5))) AS DOUBLE) AS confidence FROM efforts GROUP BY uid", _EFFORTS))
def agg26(spark, d):
    p = lambda n: F.round(F.percentile(F.when(F.col("duration") == n, F.col("avg_power")), 0.95), 4)
    sure = F.greatest(F.lit(5.0), F.least(F.lit(100.0), F.floor(F.count_distinct("wid") / 20 * 100 + 0.5).cast("double")))
    return _efforts(spark, d).groupBy("uid").agg(p(360).alias("p360"), p(960).alias("p960"), sure.alias("confidence"))


@register("agg27_examples", oracle("workouts", "SELECT workout_type, id, n FROM (SELECT *, row_number() OVER (PARTITION BY workout_type ORDER BY total_distance DESC, id) AS rn, count(*) OVER (PARTITION BY workout_type) AS n FROM workouts) WHERE rn <= 12"))
def agg27(spark, d):
    w = analog.workouts(spark, d)
    top = windows.ranked(w, ["workout_type"], [F.desc("total_distance"), F.col("id")], "rn").filter("rn <= 12")
    return top.join(w.groupBy("workout_type").agg(F.count(F.lit(1)).alias("n")), "workout_type").select("workout_type", "id", "n")


@register("agg28_bounds", oracle("workouts", "SELECT uid, min(min_lat) AS min_lat, min(min_lng) AS min_lng, max(max_lat) AS max_lat, max(max_lng) AS max_lng FROM workouts GROUP BY uid"))
def agg28(spark, d):
    return analog.workouts(spark, d).groupBy("uid").agg(F.min("min_lat").alias("min_lat"), F.min("min_lng").alias("min_lng"), F.max("max_lat").alias("max_lat"), F.max("max_lng").alias("max_lng"))


@register("agg29_floor_quantile", "SELECT event_type, s[1 + CAST(least(len(s) - 1, floor(len(s) * 0.9)) AS INTEGER)] AS p90 FROM (SELECT event_type, list_sort(list(value)) AS s FROM events GROUP BY event_type)")
def agg29(spark, d):
    return spark.read.parquet(f"{d}/events.parquet").groupBy("event_type").agg(aggregates.quantile_at(F.collect_list("value"), 0.9).alias("p90"))


@register("agg30_recent_rows", oracle("workouts", "SELECT uid, sum(total_timer_time) FILTER (rn <= 7) / 3600 AS last_7, sum(total_timer_time) FILTER (rn <= 28) / 3600 AS last_28 FROM (SELECT *, row_number() OVER (PARTITION BY uid ORDER BY start_time DESC, id DESC) AS rn FROM workouts) GROUP BY uid"))
def agg30(spark, d):
    r = windows.ranked(analog.workouts(spark, d), ["uid"], [F.desc("start_time"), F.desc("id")], "rn")
    hours = lambda n: F.sum(F.when(F.col("rn") <= n, F.col("total_timer_time"))) / 3600
    return r.groupBy("uid").agg(hours(7).alias("last_7"), hours(28).alias("last_28"))


@register("agg31_axis_bounds", "SELECT user_id, ceil(max(value) * 1.05 / 25) * 25 AS top FROM events GROUP BY user_id")
def agg31(spark, d):
    return spark.read.parquet(f"{d}/events.parquet").groupBy("user_id").agg((F.ceil(F.max("value") * 1.05 / 25) * 25).cast("double").alias("top"))


@register("win01_effort_rank", oracle("workouts segments", "SELECT wid, duration, start_offset, row_number() OVER (PARTITION BY uid, year_quarter, duration ORDER BY avg_power DESC, start_time, wid, start_offset, sid) AS rank FROM efforts", _EFFORTS))
def win01(spark, d):
    order = [F.desc("avg_power"), F.col("start_time"), F.col("wid"), F.col("start_offset"), F.col("sid")]
    return windows.ranked(_efforts(spark, d), ["uid", "year_quarter", "duration"], order, "rank").select("wid", "duration", "start_offset", "rank")


@register("win02_leaderboard", oracle("workouts segments", "SELECT sid, wid, rn, user_rank FROM (SELECT *, row_number() OVER (PARTITION BY sid ORDER BY duration, start_time, wid, start_offset) AS rn, row_number() OVER (PARTITION BY sid, uid ORDER BY duration, start_time, wid, start_offset) AS user_rank FROM efforts) WHERE user_rank <= 3", _EFFORTS))
def win02(spark, d):
    return windows.leaderboard(_efforts(spark, d), 3).select("sid", "wid", "rn", "user_rank")


@register("win04_total_beside_page", oracle("users", "SELECT id, (SELECT count(*) FROM users WHERE segment = 'MACHINERY') AS total FROM users WHERE segment = 'MACHINERY' ORDER BY id LIMIT 20"))
def win04(spark, d):
    u = analog.users(spark, d).filter("segment = 'MACHINERY'")
    total = u.agg(F.count(F.lit(1)).alias("total"))
    return u.orderBy("id").limit(20).join(F.broadcast(total), F.lit(True)).select("id", "total")  # a table of one row


_WIDE = _EFFORTS.replace(" WHERE w.workout_type <> 'motorsport'", "") + """, wide AS (SELECT uid, wid, start_time, max(avg_power) FILTER (duration = 480) AS p8, max(avg_power) FILTER (duration = 900) AS p15 FROM efforts GROUP BY ALL),
    roll AS (SELECT uid, wid, start_time, quantile_cont(p8, 0.95) OVER w AS q8, quantile_cont(p15, 0.95) OVER w AS q15, count(p8) OVER w AS n8, count(p15) OVER w AS n15 FROM wide WINDOW w AS (PARTITION BY uid ORDER BY start_time RANGE BETWEEN INTERVAL 84 DAYS PRECEDING AND CURRENT ROW))"""


def _wide(spark, d):
    return aggregates.efforts_by_workout(aggregates.efforts(analog.workouts(spark, d), analog.segments(spark, d), motorsport=True), (480, 900))


@register("win05_rolling_quantiles", oracle("workouts segments", "SELECT wid, round(q8, 4) AS q_480, n8 AS n_480, round(q15, 4) AS q_900, n15 AS n_900 FROM roll", _WIDE))
def win05(spark, d):
    return windows.rolling_quantiles(_wide(spark, d), (480, 900)).select("wid", F.round("q_480", 4).alias("q_480"), "n_480", F.round("q_900", 4).alias("q_900"), "n_900")


@register("win06_earlier_quantile", oracle("workouts", "SELECT id, round(quantile_cont(avg_power, 0.95) OVER w, 4) AS earlier, count(avg_power) OVER w AS earlier_n FROM workouts WINDOW w AS (PARTITION BY uid ORDER BY start_time RANGE BETWEEN INTERVAL 365 DAYS PRECEDING AND INTERVAL 1 MICROSECOND PRECEDING)"))
def win06(spark, d):
    out = windows.earlier_quantile(analog.workouts(spark, d).select("id", "uid", "start_time", "avg_power"), "avg_power")
    return out.select("id", F.round("earlier", 4).alias("earlier"), "earlier_n")


@register("agg17_best_ftp_by_quarter", oracle("workouts segments", f"SELECT uid, period, wid, round(ftp, 4) AS ftp FROM (SELECT *, row_number() OVER (PARTITION BY uid, period ORDER BY ftp DESC, start_time, wid) AS rn FROM (SELECT uid, wid, start_time, year(start_time) * 10 + quarter(start_time) AS period, (q8 + (ln(1200) - ln(480)) / (ln(900) - ln(480)) * (q15 - q8)) * 0.95 AS ftp FROM roll) WHERE ftp > 0) WHERE rn = 1", _WIDE))
def agg17(spark, d):
    from wattspark.functions.calendar import period_key
    from wattspark.functions.numeric import two_point_ftp
    from wattspark.operators.sets import best_of

    snap = windows.rolling_quantiles(_wide(spark, d), (480, 900)).withColumn("ftp", two_point_ftp(F.col("q_480"), F.col("q_900"))).withColumn("period", period_key(F.col("start_time"), "quarter"))
    return best_of(snap.filter("ftp > 0"), ["uid", "period"], [F.desc("ftp"), F.col("start_time"), F.col("wid")]).select("uid", "period", "wid", F.round("ftp", 4).alias("ftp"))


@register("snk18_apportioned", "WITH t AS (SELECT user_id, event_type, sum(value) AS v FROM events GROUP BY ALL), x AS (SELECT *, v / sum(v) OVER (PARTITION BY user_id) * 255 AS e FROM t), f AS (SELECT *, floor(e) AS fl, 255 - sum(floor(e)) OVER (PARTITION BY user_id) AS rest FROM x) SELECT user_id, event_type, CAST(fl + CASE WHEN row_number() OVER (PARTITION BY user_id ORDER BY e - fl DESC, event_type) <= rest THEN 1 ELSE 0 END AS BIGINT) AS parts FROM f")
def snk18(spark, d):
    t = spark.read.parquet(f"{d}/events.parquet").groupBy("user_id", "event_type").agg(F.sum("value").alias("v"))
    return aggregates.largest_remainder(t, ["user_id"], "v", "event_type").select("user_id", "event_type", "parts")


