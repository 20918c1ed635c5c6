"""The domain's tables, derived from the supplied ones, in Spark and as SQL for the oracle.

Both definitions use the same whole-number arithmetic, so that both engines agree on every value.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wattspark.functions.calendar import with_period_keys


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def workouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    base = o.select(
        k.alias("id"),
        (F.col("o_custkey") % 20).alias("uid"),
        (F.col("o_orderdate").cast("timestamp_ntz") + F.make_dt_interval(secs=(k % 86400).cast("decimal(18,6)"))).alias("start_time"),
        (1200 + k % 97 * 60).cast("double").alias("total_timer_time"),
        F.col("o_totalprice").alias("total_distance"),
        (k * 37 % 2000).cast("double").alias("total_ascent"),
        F.when(k % 7 != 0, k % 900).cast("double").alias("total_calories"),
        F.when(k % 11 != 0, (k % 300)).cast("double").alias("total_work"),
        (100 + k % 200).cast("double").alias("avg_power"),
        F.when(k % 5 != 0, 105 + k % 200).cast("double").alias("avg_normalized_power"),
        F.when(F.col("o_orderstatus") == "F", "road").when(F.col("o_orderstatus") == "O", "mountain").otherwise("motorsport").alias("workout_type"),
        (k % 64).cast("int").alias("intensity_tags"),
        (40 + k % 500 / F.lit(100.0)).alias("min_lat"),
        (5 + k * 7 % 700 / F.lit(100.0)).alias("min_lng"),
        (40.05 + k % 500 / F.lit(100.0)).alias("max_lat"),
        (5.05 + k * 7 % 700 / F.lit(100.0)).alias("max_lng"),
    )
    return with_period_keys(base, "start_time")


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = _table(spark, sf_dir, "lineitem")
    n = F.col("l_linenumber")
    duration = F.when(n == 1, 360).when(n == 2, 480).when(n == 3, 720).when(n == 4, 900).when(n == 5, 960).otherwise(60)
    return li.select(F.col("l_orderkey").alias("wid"), duration.alias("duration"), (F.col("l_extendedprice") / 100.0).alias("avg_power"), (F.col("l_partkey") % 3600).alias("start_offset"), F.col("l_suppkey").alias("sid"))


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    e = _table(spark, sf_dir, "events")
    idx = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    return e.select(F.col("user_id").alias("workout_id"), idx.cast("long").alias("idx"), F.col("value").alias("power"), "ts", "event_id", "event_type", "props")


def gps_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    return _table(spark, sf_dir, "part").select(
        k.alias("id"),
        (k % 20).alias("uid"),
        (1000 + F.col("p_size") * 50).cast("double").alias("distance"),
        (40 + k * 3 % 500 / F.lit(100.0)).alias("min_lat"),
        (5 + k * 11 % 700 / F.lit(100.0)).alias("min_lng"),
        (40.02 + k * 3 % 500 / F.lit(100.0)).alias("max_lat"),
        (5.02 + k * 11 % 700 / F.lit(100.0)).alias("max_lng"),
        F.col("p_name").alias("name"),
    )


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("display_name"), F.col("c_mktsegment").alias("segment"), F.col("c_nationkey").alias("group_id"))


def group_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "customer").select(F.col("c_nationkey").cast("long").alias("group_id"), F.col("c_custkey").alias("user_id"))


def shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _table(spark, sf_dir, "orders")
    return o.filter("o_orderkey % 3 = 0").select(F.col("o_orderkey").alias("workout_id"), (F.col("o_custkey") % 25).alias("group_id"))


def activities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manual activities: every ninth order, with an estimated load."""
    o = _table(spark, sf_dir, "orders").filter("o_orderkey % 9 = 0")
    k = F.col("o_orderkey")
    return o.select(
        k.alias("id"),
        (F.col("o_custkey") % 20).alias("uid"),
        (F.col("o_orderdate").cast("timestamp_ntz") + F.make_dt_interval(secs=(k % 43200).cast("decimal(18,6)"))).alias("start_time"),
        (600 + k % 50 * 60).cast("double").alias("duration_seconds"),
        F.when(k % 2 == 0, "cycling").otherwise("strength").alias("activity_type"),
        F.when(k % 4 != 0, k % 150).cast("double").alias("estimated_tss"),
    )


_CTES = {
    "workouts": """workouts AS (SELECT *, year(start_time) AS year, month(start_time) AS month, week(start_time) AS week,
        year(start_time) * 10 + quarter(start_time) AS year_quarter, year(start_time) * 100 + month(start_time) AS year_month,
        isoyear(start_time) * 100 + week(start_time) AS year_week FROM (
        SELECT o_orderkey AS id, o_custkey % 20 AS uid, o_orderdate + to_seconds(o_orderkey % 86400) AS start_time,
        CAST(1200 + o_orderkey % 97 * 60 AS DOUBLE) AS total_timer_time, o_totalprice AS total_distance,
        CAST(o_orderkey * 37 % 2000 AS DOUBLE) AS total_ascent,
        CAST(CASE WHEN o_orderkey % 7 <> 0 THEN o_orderkey % 900 END AS DOUBLE) AS total_calories,
        CAST(CASE WHEN o_orderkey % 11 <> 0 THEN o_orderkey % 300 END AS DOUBLE) AS total_work,
        CAST(100 + o_orderkey % 200 AS DOUBLE) AS avg_power,
        CAST(CASE WHEN o_orderkey % 5 <> 0 THEN 105 + o_orderkey % 200 END AS DOUBLE) AS avg_normalized_power,
        CASE o_orderstatus WHEN 'F' THEN 'road' WHEN 'O' THEN 'mountain' ELSE 'motorsport' END AS workout_type,
        CAST(o_orderkey % 64 AS INTEGER) AS intensity_tags,
        40 + (o_orderkey % 500) / 100.0::DOUBLE AS min_lat, 5 + (o_orderkey * 7 % 700) / 100.0::DOUBLE AS min_lng,
        40.05::DOUBLE + (o_orderkey % 500) / 100.0::DOUBLE AS max_lat, 5.05::DOUBLE + (o_orderkey * 7 % 700) / 100.0::DOUBLE AS max_lng FROM orders))""",
    "segments": """segments AS (SELECT l_orderkey AS wid, CASE l_linenumber WHEN 1 THEN 360 WHEN 2 THEN 480 WHEN 3 THEN 720 WHEN 4 THEN 900 WHEN 5 THEN 960 ELSE 60 END AS duration,
        l_extendedprice / 100.0::DOUBLE AS avg_power, l_partkey % 3600 AS start_offset, l_suppkey AS sid FROM lineitem)""",
    "samples": """samples AS (SELECT user_id AS workout_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS idx, value AS power, ts, event_id, event_type, props FROM events)""",
    "gps_segments": """gps_segments AS (SELECT p_partkey AS id, p_partkey % 20 AS uid, CAST(1000 + p_size * 50 AS DOUBLE) AS distance,
        40 + (p_partkey * 3 % 500) / 100.0::DOUBLE AS min_lat, 5 + (p_partkey * 11 % 700) / 100.0::DOUBLE AS min_lng,
        40.02::DOUBLE + (p_partkey * 3 % 500) / 100.0::DOUBLE AS max_lat, 5.02::DOUBLE + (p_partkey * 11 % 700) / 100.0::DOUBLE AS max_lng, p_name AS name FROM part)""",
    "users": "users AS (SELECT c_custkey AS id, c_name AS display_name, c_mktsegment AS segment, c_nationkey AS group_id FROM customer)",
    "group_members": "group_members AS (SELECT CAST(c_nationkey AS BIGINT) AS group_id, c_custkey AS user_id FROM customer)",
    "shares": "shares AS (SELECT o_orderkey AS workout_id, o_custkey % 25 AS group_id FROM orders WHERE o_orderkey % 3 = 0)",
    "activities": """activities AS (SELECT o_orderkey AS id, o_custkey % 20 AS uid, o_orderdate + to_seconds(o_orderkey % 43200) AS start_time,
        CAST(600 + o_orderkey % 50 * 60 AS DOUBLE) AS duration_seconds, CASE WHEN o_orderkey % 2 = 0 THEN 'cycling' ELSE 'strength' END AS activity_type,
        CAST(CASE WHEN o_orderkey % 4 <> 0 THEN o_orderkey % 150 END AS DOUBLE) AS estimated_tss FROM orders WHERE o_orderkey % 9 = 0)""",
}


def oracle(names: str, sql: str, ctes: str = "") -> str:
    """SQL over the named derived tables; `ctes` are further ones, `sql` the final SELECT."""
    parts = [_CTES[n] for n in names.split()] + ([ctes] if ctes else [])
    return f"WITH RECURSIVE {', '.join(parts)} {sql}"
