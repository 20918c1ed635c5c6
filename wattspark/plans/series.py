"""Window operators over 1 Hz samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from wattspark import analog
from wattspark.analog import oracle
from wattspark.functions.numeric import BEST_EFFORT_DURATIONS
from wattspark.operators import aggregates, windows
from wattspark.registry import register


@register("win07_normalized_power", oracle("samples", "SELECT workout_id, floor(pow(avg(CASE WHEN n < 30 THEN pow(power, 4) WHEN idx >= 29 THEN pow(m, 4) END), 0.25) + 0.5) AS np FROM (SELECT *, avg(power) OVER (PARTITION BY workout_id ORDER BY idx ROWS 29 PRECEDING) AS m, count(*) OVER (PARTITION BY workout_id) AS n FROM samples) GROUP BY workout_id"))
def win07(spark, d):
    return windows.normalized_power(analog.samples(spark, d))


for _name, _column, _frame in (
    ("win08_trailing_mean", lambda: windows.trailing_mean("power", 7), "ROWS BETWEEN 6 PRECEDING AND CURRENT ROW"),
    ("win09_centred_mean", lambda: windows.centred_mean("power", 6), "ROWS BETWEEN 2 PRECEDING AND 3 FOLLOWING"),
    ("win11_symmetric_mean", lambda: windows.centred_mean("power", 31), "ROWS BETWEEN 15 PRECEDING AND 15 FOLLOWING"),
):
    register(_name, oracle("samples", f"SELECT event_id, CAST(sum(CAST(power AS DECIMAL(18,6))) OVER w AS DOUBLE) / count(power) OVER w AS smooth FROM samples WINDOW w AS (PARTITION BY workout_id ORDER BY idx {_frame})"))(
        lambda spark, d, column=_column: analog.samples(spark, d).select("event_id", column().alias("smooth"))
    )


@register("win10_balance", oracle("samples", "SELECT event_id, CASE WHEN avg(power) OVER w >= 50 THEN round(sum(b * power) OVER w / sum(power) OVER w, 4) END AS balance FROM (SELECT *, 40.0::DOUBLE + event_id % 20 AS b FROM samples) WINDOW w AS (PARTITION BY workout_id ORDER BY idx ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)"))
def win10(spark, d):
    s = analog.samples(spark, d).withColumn("b", (40 + F.col("event_id") % 20).cast("double"))
    return s.select("event_id", F.round(windows.weighted_balance("b", "power", 5), 4).alias("balance"))


def best_windows_sql(durations: tuple[int, ...]) -> str:
    """The oracle's SQL: one branch a duration, exact sums."""
    one = "SELECT workout_id, CAST({d} AS INTEGER) AS d, idx AS s, sum(CAST(power AS DECIMAL(18,6))) OVER w AS t, count(*) OVER w AS n FROM samples WINDOW w AS (PARTITION BY workout_id ORDER BY idx ROWS BETWEEN CURRENT ROW AND {last} FOLLOWING)"
    every = " UNION ALL ".join(one.format(d=d, last=d - 1) for d in durations)
    return f"SELECT workout_id, d AS duration, s AS start_offset, s + d - 1 AS end_offset, CAST(t AS DOUBLE) / d AS avg_power FROM (SELECT *, row_number() OVER (PARTITION BY workout_id, d ORDER BY t DESC, s) AS rn FROM ({every}) WHERE n = d) WHERE rn = 1"


@register("win12_best_windows", oracle("samples", best_windows_sql(BEST_EFFORT_DURATIONS)))
def win12(spark, d):
    return windows.best_windows(analog.samples(spark, d), BEST_EFFORT_DURATIONS)


@register("win14_prefix_sum", oracle("samples", "SELECT event_id, round(sum(power) OVER (PARTITION BY workout_id ORDER BY idx ROWS UNBOUNDED PRECEDING), 4) AS total FROM samples"))
def win14(spark, d):
    return analog.samples(spark, d).select("event_id", F.round(windows.prefix_sum("power"), 4).alias("total"))


@register("win16_change", oracle("samples", "SELECT event_id, round(power - coalesce(lag(power) OVER (PARTITION BY workout_id ORDER BY idx), 0), 4) AS change FROM samples"))
def win16(spark, d):
    return analog.samples(spark, d).select("event_id", F.round(windows.change("power"), 4).alias("change"))


@register("win17_filled", oracle("samples", "SELECT event_id, coalesce(last_value(v IGNORE NULLS) OVER (PARTITION BY workout_id ORDER BY idx ROWS UNBOUNDED PRECEDING), first_value(v IGNORE NULLS) OVER (PARTITION BY workout_id ORDER BY idx ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS value FROM (SELECT *, CASE WHEN event_id % 3 = 0 THEN power END AS v FROM samples)"))
def win17(spark, d):
    s = analog.samples(spark, d).withColumn("v", F.when(F.col("event_id") % 3 == 0, F.col("power")))
    return s.select("event_id", windows.filled("v").alias("value"))


@register("win18_running_max", oracle("samples", "SELECT event_id, max(power) OVER (PARTITION BY workout_id ORDER BY idx ROWS UNBOUNDED PRECEDING) AS top FROM samples"))
def win18(spark, d):
    return analog.samples(spark, d).select("event_id", windows.running_max("power").alias("top"))


@register("win21_positions", oracle("segments", "SELECT wid, duration, start_offset, row_number() OVER (PARTITION BY wid ORDER BY start_offset, duration, avg_power, sid) AS position FROM segments"))
def win21(spark, d):
    order = [F.col("start_offset"), F.col("duration"), F.col("avg_power"), F.col("sid")]
    return windows.ranked(analog.segments(spark, d), ["wid"], order, "position").select("wid", "duration", "start_offset", "position")


@register("win22_buckets", oracle("samples", "SELECT workout_id, idx // 15 AS bucket, floor(avg(power) + 0.5) AS power, count(*) AS samples FROM samples GROUP BY ALL"))
def win22(spark, d):
    return windows.bucket_means(analog.samples(spark, d))


@register(
    "win23_climb_runs",
    oracle(
        "samples",
        "SELECT workout_id, CAST(sum(l) AS BIGINT) AS blocks_up, max(l) AS longest_run, count(*) AS runs FROM (SELECT workout_id, island, count(*) AS l FROM (SELECT *, sum(1 - up) OVER (PARTITION BY workout_id ORDER BY block) AS island FROM (SELECT workout_id, idx // 10 AS block, CASE WHEN arg_max(power, idx) - arg_min(power, idx) > 0 THEN 1 ELSE 0 END AS up FROM samples GROUP BY ALL)) WHERE up = 1 GROUP BY ALL) GROUP BY workout_id",
    ),
)
def win23(spark, d):
    return windows.climb_runs(analog.samples(spark, d), "power", 10)


@register("snk21_histogram", oracle("samples", "SELECT workout_id, string_agg(bin || ':' || n, ',' ORDER BY bin) AS bins FROM (SELECT workout_id, least(200, greatest(0, floor((power - 1) / 5)))::INTEGER AS bin, count(*) AS n FROM samples WHERE power > 0 GROUP BY ALL) GROUP BY workout_id"))
def snk21(spark, d):
    h = aggregates.histogram(analog.samples(spark, d))
    return h.select("workout_id", F.array_join(F.transform(F.map_entries("bins"), lambda e: F.concat_ws(":", e["key"], e["value"])), ",").alias("bins"))


@register("agg32_record_range", oracle("samples", "SELECT workout_id, max(power) AS top, CAST(sum(CAST(power AS DECIMAL(18,6))) AS DOUBLE) / count(power) AS mean, CAST(sum(CASE WHEN c > 0 THEN c ELSE 0 END) AS DOUBLE) AS up, CAST(sum(CASE WHEN c < 0 THEN -c ELSE 0 END) AS DOUBLE) AS down FROM (SELECT *, CAST(power AS DECIMAL(18,6)) - lag(CAST(power AS DECIMAL(18,6))) OVER (PARTITION BY workout_id ORDER BY idx) AS c FROM samples) WHERE idx BETWEEN 10 AND 49 GROUP BY workout_id"))
def agg32(spark, d):
    from pyspark.sql import Window

    exact = F.col("power").cast("decimal(18,6)")
    c = exact - F.lag(exact).over(Window.partitionBy("workout_id").orderBy("idx"))
    s = analog.samples(spark, d).withColumn("c", c).filter(F.col("idx").between(10, 49))
    gain = lambda x: F.sum(F.when(x > 0, x).otherwise(F.lit(0).cast("decimal(19,6)"))).cast("double")
    return s.groupBy("workout_id").agg(F.max("power").alias("top"), (F.sum(exact).cast("double") / F.count("power")).alias("mean"), gain(F.col("c")).alias("up"), gain(-F.col("c")).alias("down"))


@register("fnm21_variation", oracle("samples", "SELECT workout_id, round(stddev_pop(power) / avg(power), 4) AS cov FROM samples GROUP BY workout_id"))
def fnm21(spark, d):
    return analog.samples(spark, d).groupBy("workout_id").agg(F.round(F.stddev_pop("power") / F.avg("power"), 4).alias("cov"))
