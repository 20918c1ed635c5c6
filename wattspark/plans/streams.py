"""Incremental operators, on tables at rest."""

from __future__ import annotations

from pyspark.sql import functions as F

from wattspark import analog
from wattspark.analog import oracle
from wattspark.registry import register
from wattspark.streaming import incremental


@register("str04_affected_windows", oracle("workouts", "SELECT uid, min(s) AS s, max(e) AS e FROM (SELECT *, sum(n) OVER (PARTITION BY uid ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS g FROM (SELECT *, CASE WHEN s > max(e) OVER (PARTITION BY uid ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 1 ELSE 0 END AS n FROM (SELECT uid, start_time AS s, start_time + INTERVAL 30 DAY AS e FROM workouts WHERE id % 40 = 0))) GROUP BY uid, g"))
def str04(spark, d):
    out = incremental.affected_windows(analog.workouts(spark, d).filter("id % 40 = 0"), ["uid"], "start_time", 30)
    return out.select("uid", F.col("start").alias("s"), F.col("end").alias("e"))


@register("str04_changed_rows", oracle("workouts", "SELECT id, avg_power + CASE WHEN id % 9 = 0 THEN 1 ELSE 0 END AS avg_power FROM workouts WHERE id % 9 = 0 OR id % 10 = 0"))
def str04_changed(spark, d):
    w = analog.workouts(spark, d).select("id", "avg_power")
    after = w.withColumn("avg_power", F.col("avg_power") + F.when(F.col("id") % 9 == 0, 1).otherwise(0))
    return incremental.changed(w.filter("id % 10 <> 0"), after, ["id"], ["avg_power"])


@register("str_tumbling_windows", "SELECT time_bucket(INTERVAL 6 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def str_tumbling(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    out = incremental.watermarked(e, "ts", "1 day", "6 hours", ["event_type"])
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@register("str_sessions", "SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 4 HOUR AS end, count(*) AS n FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS g FROM (SELECT *, CASE WHEN ts > lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 4 HOUR THEN 1 ELSE 0 END AS new FROM events)) GROUP BY user_id, g")
def str_sessions(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    out = incremental.sessions(e, "ts", "1 day", "4 hours", ["user_id"])
    return out.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "n")
