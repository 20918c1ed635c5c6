"""Smoothing, laps, ranges, projections, backups and sweeps."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from wattspark import analog
from wattspark.analog import oracle
from wattspark.operators import recordings
from wattspark.registry import register
from wattspark.sources import backup
from wattspark.streaming import upkeep

_AROUND = "SELECT *, lag(power, 2) OVER w AS a, lag(power) OVER w AS b, lead(power) OVER w AS c, lead(power, 2) OVER w AS e FROM samples WINDOW w AS (PARTITION BY workout_id ORDER BY idx)"


@register("win24_stabilised", oracle("samples", f"SELECT event_id, CASE WHEN least(a, b, power, c, e) > 0 AND a IS NOT NULL AND b IS NOT NULL AND c IS NOT NULL AND e IS NOT NULL AND greatest(a, b, power, c, e) - least(a, b, power, c, e) <= 120 AND abs(m - power) <= 30 THEN m ELSE power END AS power FROM (SELECT *, (a * 1 + b * 2 + power * 3 + c * 2 + e * 1) / 9 AS m FROM ({_AROUND}))"))
def win24(spark, d):
    s = analog.samples(spark, d).select("workout_id", "idx", "event_id", "power")
    return recordings.stabilised(s, "power", (1, 2, 3, 2, 1), 120.0, 30.0).select("event_id", "power")


_MOVING = "moving AS (SELECT workout_id, idx, event_id, 1.8::DOUBLE * (15 + event_id % 10) AS speed, idx * 0.01::DOUBLE + (event_id % 7) * 0.002::DOUBLE AS distance FROM samples)"


@register("win25_dequantised_speed", oracle("samples", """SELECT event_id, CASE WHEN p3 < p2 AND p2 < p1 AND p1 < distance AND distance < n1 AND n1 < n2 AND abs((n2 - p3) * 3600 / 5 - speed) <= 3.6::DOUBLE
    AND abs(speed - floor(speed / 1.8::DOUBLE + 0.5) * 1.8::DOUBLE) <= 0.05 THEN (n2 - p3) * 3600 / 5 ELSE speed END AS speed FROM (SELECT *, lag(distance, 3) OVER w AS p3, lag(distance, 2) OVER w AS p2, lag(distance) OVER w AS p1,
    lead(distance) OVER w AS n1, lead(distance, 2) OVER w AS n2 FROM moving WINDOW w AS (PARTITION BY workout_id ORDER BY idx))""", _MOVING))
def win25(spark, d):
    e = F.col("event_id")
    s = analog.samples(spark, d).select("workout_id", "idx", "event_id", (F.lit(1.8) * (15 + e % 10)).alias("speed"), (F.col("idx") * F.lit(0.01) + (e % 7) * F.lit(0.002)).alias("distance"))
    return recordings.dequantised_speed(s).select("event_id", "speed")


_LAPS = """laps AS (SELECT l_orderkey AS workout_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS lap_index, l_partkey % 9 AS lap_trigger,
    CASE WHEN l_partkey % 4 <> 0 THEN CAST(1000000 + l_orderkey + (l_linenumber - 1) * 300 AS DOUBLE) END AS start_time,
    CASE WHEN l_partkey % 3 <> 0 THEN CAST(1000060 + l_orderkey + (l_linenumber - 1) * 300 + l_partkey % 400 AS DOUBLE) END AS ended,
    coalesce(CASE WHEN l_suppkey % 5 <> 0 THEN CAST(l_partkey % 50 * 10 AS DOUBLE) END, CAST(l_partkey % 60 * 10 AS DOUBLE)) AS timer FROM lineitem),
    timed AS (SELECT l.*, 1200 + workout_id % 97 * 60 AS n, start_time - (1000000 + workout_id) AS f,
    CASE WHEN ended > start_time OR (start_time IS NULL AND ended IS NOT NULL) THEN ended ELSE start_time + timer END - (1000000 + workout_id) AS t,
    sum(timer) OVER (PARTITION BY workout_id ORDER BY lap_index) AS upto, sum(timer) OVER (PARTITION BY workout_id) AS total, count(*) OVER (PARTITION BY workout_id) AS laps FROM laps l JOIN orders ON o_orderkey = workout_id),
    direct AS (SELECT *, coalesce(f >= -1 AND t > f AND f <= n AND t <= n + 1, false) AS own FROM timed WHERE laps > 1),
    ranges AS (SELECT *, greatest(0, least(n - 1, floor(CASE WHEN own THEN f ELSE (upto - timer) * ((n - 1) / total) END + 0.5))) AS s,
    greatest(0, least(n - 1, floor(CASE WHEN own THEN t ELSE upto * ((n - 1) / total) END + 0.5))) AS e FROM direct WHERE own OR (total > 0 AND timer > 0))"""


@register("krn10_lap_segments", oracle("samples", 'SELECT workout_id, lap_index, CAST(CASE lap_trigger WHEN 0 THEN 3 ELSE 1 END AS INTEGER) AS type, CAST(s AS BIGINT) AS "start", CAST(e AS BIGINT) AS "end", CAST(e - s AS BIGINT) AS duration FROM ranges WHERE e > s AND NOT (lap_trigger = 7 AND s <= 1 AND e >= n - 2)', _LAPS))
def krn10(spark, d):
    li, part, order, number = spark.read.parquet(f"{d}/lineitem.parquet"), F.col("l_partkey"), F.col("l_orderkey"), F.col("l_linenumber")
    begun = (1000000 + order + (number - 1) * 300).cast("double")
    laps = li.select(
        order.alias("workout_id"),
        F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")).cast("long").alias("lap_index"),
        (part % 9).alias("lap_trigger"),
        F.when(part % 4 != 0, begun).alias("start_time"),
        F.when(part % 3 != 0, begun + 60 + part % 400).alias("timestamp"),
        F.when(F.col("l_suppkey") % 5 != 0, (part % 50 * 10).cast("double")).alias("total_timer_time"),
        (part % 60 * 10).cast("double").alias("total_elapsed_time"),
    )
    w = analog.workouts(spark, d).select(F.col("id").alias("workout_id"), F.col("total_timer_time").cast("long").alias("record_count"), (1000000 + F.col("id")).cast("double").alias("base_time"))
    return recordings.lap_segments(laps, w)


_RANGES = """held AS (SELECT workout_id, idx, power, 100 + event_id % 60 AS hr, floor(power) AS altitude FROM samples),
    ranges AS (SELECT DISTINCT workout_id, least(a, b) AS s, greatest(a, b) AS e FROM samples CROSS JOIN (VALUES (30, 10), (0, 1), (5, 40)) t(a, b))"""


@register("krn25_manual_segments", oracle("samples", """SELECT r.workout_id, CAST(r.s AS BIGINT) AS "start", CAST(r.e AS BIGINT) AS "end", CAST(r.e - r.s AS BIGINT) AS duration, floor(CAST(sum(CAST(h.power AS DECIMAL(18,6))) AS DOUBLE) / (r.e - r.s) + 0.5) AS avg_power,
    floor(CAST(sum(h.hr) AS DOUBLE) / (r.e - r.s) + 0.5) AS avg_hr, any_value(y.altitude) - any_value(x.altitude) AS altimeters FROM ranges r JOIN held h ON h.workout_id = r.workout_id AND h.idx >= r.s AND h.idx < r.e
    JOIN held x ON x.workout_id = r.workout_id AND x.idx = r.s JOIN held y ON y.workout_id = r.workout_id AND y.idx = r.e WHERE r.e - r.s >= 2 GROUP BY r.workout_id, r.s, r.e""", _RANGES))
def krn25(spark, d):
    s = analog.samples(spark, d).select("workout_id", "idx", "power", (100 + F.col("event_id") % 60).alias("hr"), F.floor("power").cast("double").alias("altitude"))
    marks = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in ((30, 10), (0, 1), (5, 40))])
    ranges = s.select("workout_id").distinct().select("workout_id", F.inline(marks))
    return recordings.manual_segments(ranges, s, ["power", "hr"], "altitude")


@register("krn27_pedal_metrics", oracle("samples", """SELECT workout_id, floor(CAST(sum(CAST(power AS DECIMAL(18,6))) AS DOUBLE) / count(power) + 0.5) AS avg_power, max(power) AS max_power,
    floor(CAST(sum(cadence) AS DOUBLE) / count(CASE WHEN cadence > 0 THEN 1 END) + 0.5) AS avg_cadence, CAST(max(cadence) AS DOUBLE) AS max_cadence FROM pedalled GROUP BY workout_id""", "pedalled AS (SELECT workout_id, power, event_id % 90 AS cadence FROM samples)"))
def krn27(spark, d):
    s = analog.samples(spark, d).withColumn("cadence", F.col("event_id") % 90)
    return recordings.pedal_metrics(s).select("workout_id", "avg_power", "max_power", "avg_cadence", "max_cadence")


_POINTS = "points AS (SELECT workout_id, idx, 47 + idx * 0.0005::DOUBLE + (event_id % 9) * 0.0001::DOUBLE AS lat, 8 + idx * 0.0004::DOUBLE AS lng FROM samples)"


@register("fngeo10_local_projection", oracle("samples", """SELECT workout_id, idx, round((lng - lng0) * cos(radians(middle)) * 111320, 3) AS x, round((lat - lat0) * 111320, 3) AS y FROM (SELECT *, first_value(lat) OVER o AS lat0, first_value(lng) OVER o AS lng0,
    CAST(sum(CAST(lat AS DECIMAL(18,9))) OVER w AS DOUBLE) / count(lat) OVER w AS middle, count(*) OVER w AS n FROM points WINDOW o AS (PARTITION BY workout_id ORDER BY idx), w AS (PARTITION BY workout_id)) WHERE n >= 2""", _POINTS))
def fngeo10(spark, d):
    i = F.col("idx")
    track = analog.samples(spark, d).select("workout_id", "idx", (47 + i * F.lit(0.0005) + (F.col("event_id") % 9) * F.lit(0.0001)).alias("lat"), (8 + i * F.lit(0.0004)).alias("lng"))
    return recordings.local_projection(track).select("workout_id", "idx", F.round("x", 3).alias("x"), F.round("y", 3).alias("y"))


@register("src21_scan_pages", oracle("workouts", "SELECT id, (row_number() OVER (ORDER BY id) - 1) // 1000 AS page FROM workouts"))
def src21(spark, d):
    return backup.paged(analog.workouts(spark, d).select("id"), 1000)


@register("snk17_backup_index", oracle("workouts", "SELECT chunk, min(id) AS first_id, max(id) AS last_id, count(*) AS n_rows FROM (SELECT id, (row_number() OVER (ORDER BY id) - 1) // 100 AS chunk FROM workouts) GROUP BY chunk"))
def snk17(spark, d):
    rows = analog.workouts(spark, d).select("id", "uid", "start_time", "total_distance", "workout_type")
    return backup.backup_chunks(rows).select("chunk", "first_id", "last_id", "n_rows")


@register("str03_micro_batches", oracle("workouts", "SELECT id, uid, year AS import_job_id, (row_number() OVER (PARTITION BY uid, year ORDER BY id) - 1) // 100 AS batch FROM workouts"))
def str03(spark, d):
    return upkeep.micro_batches(analog.workouts(spark, d).select("id", "uid", F.col("year").alias("import_job_id")))


_NOW = "1998-01-01 00:00:00"


@register("str09_doomed_jobs", f"SELECT o_orderkey AS id FROM orders WHERE o_orderstatus IN ('F', 'O') AND o_orderdate < TIMESTAMP '{_NOW}' - INTERVAL 168 HOUR ORDER BY o_orderdate, o_orderkey LIMIT 500")
def str09(spark, d):
    o = spark.read.parquet(f"{d}/orders.parquet")
    status = F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "O", "failed").otherwise("running")
    jobs = o.select(F.col("o_orderkey").alias("id"), status.alias("status"), F.col("o_orderdate").cast("timestamp_ntz").alias("updated_at"))
    return upkeep.doomed_jobs(jobs, F.lit(_NOW).cast("timestamp_ntz")).select("id")
