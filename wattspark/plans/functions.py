"""Scalar functions over the derived tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from wattspark import analog
from wattspark.analog import oracle
from wattspark.functions import calendar, geo, numeric
from wattspark.registry import register

_TAGS = ("recovery", "endurance", "tempo", "threshold", "vo2max", "anaerobic")


def _scalar(name: str, sql: str, columns: Callable[[], dict[str, Column]]):
    """A query of one expression or more for each workout."""
    register(name, oracle("workouts", f"SELECT id, {sql} FROM workouts"))(lambda spark, d: analog.workouts(spark, d).select("id", *[c.alias(n) for n, c in columns().items()]))


_scalar("fnm01_half_up", "floor((avg_power - 200) / 4 + 0.5) AS r", lambda: dict(r=numeric.half_up((F.col("avg_power") - 200) / 4)))
_scalar("fnm04_clamp", "greatest(120.0, least(250.0, avg_power))::DOUBLE AS c", lambda: dict(c=numeric.clamp(F.col("avg_power"), 120.0, 250.0)))
_scalar("fnm10_two_point", "round((avg_power + (ln(1200) - ln(480)) / (ln(900) - ln(480)) * (avg_power * 0.9 - avg_power)) * 0.95, 4) AS ftp", lambda: dict(ftp=F.round(numeric.two_point_ftp(F.col("avg_power"), F.col("avg_power") * 0.9), 4)))
_scalar("fnm11_fallback", "round(CASE WHEN avg_normalized_power > 0 THEN avg_normalized_power * 0.9 ELSE avg_power * 0.82 END, 4) AS ftp", lambda: dict(ftp=F.round(numeric.fallback_ftp(F.when(F.col("avg_normalized_power").isNull(), F.col("avg_power")), F.col("avg_normalized_power"), F.lit(None).cast("double")), 4)))
_scalar("fnm13_stress", "CASE WHEN avg_normalized_power > 0 THEN round(avg_normalized_power / 250.0, 4) END AS intensity, coalesce(CASE WHEN avg_normalized_power > 0 THEN floor(total_timer_time * avg_normalized_power * (avg_normalized_power / 250.0) / (250.0 * 3600) * 100 + 0.5) END, 0) AS tss", lambda: dict(intensity=F.round(numeric.intensity_factor(F.col("avg_normalized_power"), F.lit(250.0)), 4), tss=numeric.stress_score(F.col("total_timer_time"), F.col("avg_normalized_power"), F.lit(250.0))))
_scalar("fnm14_calories", "CASE WHEN total_calories > 0 THEN total_calories ELSE floor(avg_power * total_timer_time / 1000 + 0.5) END AS kcal", lambda: dict(kcal=numeric.calories(F.col("total_calories"), F.col("avg_power"), F.col("total_timer_time"))))
_scalar("fnm15_power_load", "coalesce(floor(total_timer_time / 3600 * (avg_normalized_power / 200) * (avg_normalized_power / 200) * 100 + 0.5), 0) AS load", lambda: dict(load=numeric.power_load(F.col("total_timer_time"), F.col("avg_normalized_power"))))
_scalar("fnm16_speed", "floor(total_distance * 3.6 / total_timer_time * 10 + 0.5) / 10 AS kmh", lambda: dict(kmh=numeric.segment_speed(F.col("total_distance"), F.col("total_timer_time"))))
_scalar("fnm19_lerp", "round(coalesce(avg_power + (avg_normalized_power - avg_power) * 0.25, avg_power), 4) AS v", lambda: dict(v=F.round(numeric.lerp(F.col("avg_power"), F.col("avg_normalized_power"), F.lit(0.25)), 4)))
_scalar("fnm20_tags", "array_to_string(list_filter([" + ", ".join(f"CASE WHEN intensity_tags & {1 << i} <> 0 THEN '{t}' END" for i, t in enumerate(_TAGS)) + "], lambda x: x IS NOT NULL), ',') AS tags", lambda: dict(tags=F.array_join(numeric.tags_of(F.col("intensity_tags"), _TAGS), ",")))
_scalar("fnd01_period_keys", "year, month, week, year_quarter, year_month, year_week", lambda: dict(year=F.col("year"), month=F.col("month"), week=F.col("week"), year_quarter=F.col("year_quarter"), year_month=F.col("year_month"), year_week=F.col("year_week")))
_scalar("fnd03_period_starts", "make_date(year, 1, 1) AS y, date_trunc('month', start_time)::DATE AS m, date_trunc('quarter', start_time)::DATE AS q, date_trunc('week', start_time)::DATE AS w", lambda: dict(y=calendar.period_start(F.col("year"), "year"), m=calendar.period_start(F.col("year_month"), "month"), q=calendar.period_start(F.col("year_quarter"), "quarter"), w=calendar.period_start(F.col("year_week"), "week")))
_scalar("fnd04_period_ends", "(date_trunc('month', start_time) + INTERVAL 1 MONTH)::DATE AS m, (date_trunc('week', start_time) + INTERVAL 7 DAY)::DATE AS w", lambda: dict(m=calendar.period_end(calendar.period_start(F.col("year_month"), "month"), "month"), w=calendar.period_end(calendar.period_start(F.col("year_week"), "week"), "week")))
_scalar("fnd08_plan_week", "(date_trunc('week', start_time) + INTERVAL 21 DAY)::DATE AS monday", lambda: dict(monday=calendar.week_of_plan(F.col("start_time"), F.lit(4))))
_scalar("fnd09_fit_epoch", "to_timestamp(id * 1000 + 631065600)::TIMESTAMP AS t", lambda: dict(t=calendar.from_fit_seconds(F.col("id") * 1000).cast("timestamp_ntz")))
_scalar("fnd10_add_months", "(start_time::DATE + INTERVAL 3 MONTH)::DATE AS renewed", lambda: dict(renewed=F.add_months(F.to_date(F.col("start_time")), 3)))
_scalar("fngeo01_haversine", "round(2 * 6371000.0 * asin(least(1.0, sqrt(pow(sin(radians(max_lat - min_lat) / 2), 2) + cos(radians(min_lat)) * cos(radians(max_lat)) * pow(sin(radians(max_lng - min_lng) / 2), 2)))), 3) AS metres", lambda: dict(metres=F.round(geo.diagonal(F.col("min_lat"), F.col("min_lng"), F.col("max_lat"), F.col("max_lng")), 3)))
_scalar("fngeo20_bearing", "round(fmod(degrees(atan2(sin(radians(max_lng - 8)) * cos(radians(max_lat)), cos(radians(42)) * sin(radians(max_lat)) - sin(radians(42)) * cos(radians(max_lat)) * cos(radians(max_lng - 8)))) + 360, 360), 3) AS b", lambda: dict(b=F.round(geo.bearing(F.lit(42.0), F.lit(8.0), F.col("max_lat"), F.col("max_lng")), 3)))
_scalar("fns03_nullif", "coalesce(nullif(CASE WHEN id % 3 = 0 THEN '' ELSE workout_type END, ''), 'none') AS kind", lambda: dict(kind=F.coalesce(F.nullif(F.when(F.col("id") % 3 == 0, "").otherwise(F.col("workout_type")), F.lit("")), F.lit("none"))))
_scalar("fns06_sha256", "sha256(id::VARCHAR || workout_type) AS digest", lambda: dict(digest=F.sha2(F.concat(F.col("id").cast("string"), F.col("workout_type")), 256)))


@register("jsn01_json_fields", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, json_type(props) = 'OBJECT' AS is_object, json_extract(props, '$.z') IS NOT NULL AS has_z FROM events")
def jsn01(spark, d):
    v = F.parse_json("props")
    e = spark.read.parquet(f"{d}/events.parquet")
    return e.select("event_id", F.variant_get(v, "$.k", "bigint").alias("k"), F.schema_of_variant(v).startswith("OBJECT").alias("is_object"), F.try_variant_get(v, "$.z", "string").isNotNull().alias("has_z"))


@register("jsn02_json_objects", "SELECT event_id, '{\"user\":' || user_id || ',\"type\":\"' || event_type || '\"}' AS doc FROM events")
def jsn02(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    return e.select("event_id", F.to_json(F.struct(F.col("user_id").alias("user"), F.col("event_type").alias("type"))).alias("doc"))


@register("jsn05_lenient_arrays", "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 2 ELSE 0 END AS n FROM events")
def jsn05(spark, d):
    text = F.when(F.col("event_id") % 2 == 0, F.lit('["a", "b"]')).otherwise(F.lit("[oops"))
    parsed = F.coalesce(F.from_json(text, "array<string>"), F.array().cast("array<string>"))
    return spark.read.parquet(f"{d}/events.parquet").select("event_id", F.size(parsed).alias("n"))
