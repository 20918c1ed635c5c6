"""Stalls and corrupt ends of recordings."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from wattspark import analog
from wattspark.analog import oracle
from wattspark.operators import stalls
from wattspark.registry import register


def ridden_samples(spark, d):
    """Samples with distance in half metres, gaps in it, and cadence."""
    even, event = F.col("workout_id") % 2 == 0, F.col("event_id")
    ridden = F.sum((event % 3) * F.when(even, 8).otherwise(20)).over(Window.partitionBy("workout_id").orderBy("idx"))
    power = (F.col("power") * F.when(even, 4).otherwise(1)).alias("power")
    return analog.samples(spark, d).select("workout_id", "idx", power, (event % 80).alias("cadence"), F.when(event % 17 != 0, ridden).alias("distance"))


_STALLED = """ridden AS (SELECT workout_id, idx, power * CASE WHEN workout_id % 2 = 0 THEN 4 ELSE 1 END AS power, event_id % 80 AS cadence,
    CASE WHEN event_id % 17 <> 0 THEN sum((event_id % 3) * CASE WHEN workout_id % 2 = 0 THEN 8 ELSE 20 END) OVER (PARTITION BY workout_id ORDER BY idx) END AS distance FROM samples),
    stepped AS (SELECT *, CAST(distance - lag(distance) OVER (PARTITION BY workout_id ORDER BY idx) AS BIGINT) AS step FROM ridden),
    marked AS (SELECT *, coalesce(step = 0 AND (power >= 50 OR cadence >= 30), false) AS stalled FROM stepped),
    totals AS (SELECT workout_id, count(*) AS n, count(step) AS known, count(*) FILTER (step > 0) AS moving, CAST(coalesce(sum(step) FILTER (step > 0), 0) AS DOUBLE) AS way,
    CAST(coalesce(sum(step * step) FILTER (step > 0), 0) AS DOUBLE) AS squares, count(*) FILTER (stalled) AS stalls FROM marked GROUP BY workout_id),
    longest AS (SELECT workout_id, max(n) AS n FROM (SELECT workout_id, count(*) AS n FROM (SELECT workout_id, idx - row_number() OVER (PARTITION BY workout_id ORDER BY idx) AS run FROM marked WHERE stalled) GROUP BY workout_id, run) GROUP BY workout_id),
    common AS (SELECT workout_id, sum(n) AS n FROM (SELECT workout_id, count(*) AS n, row_number() OVER (PARTITION BY workout_id ORDER BY count(*) DESC) AS place FROM marked WHERE step > 0 GROUP BY workout_id, step) WHERE place <= 2 GROUP BY workout_id),
    blocks AS (SELECT workout_id, (idx - 1) // 60 AS block, CAST(sum(greatest(step, 0)) AS DOUBLE) * 0.5::DOUBLE / count(*) * 3.6::DOUBLE AS kmh, CAST(sum(CAST(power AS DECIMAL(18,6))) AS DOUBLE) / count(power) AS p, avg(cadence) AS c FROM marked WHERE idx >= 1 GROUP BY ALL HAVING count(*) >= 30),
    hills AS (SELECT workout_id, block, CASE WHEN kmh <= 18 AND p >= 180 AND c >= 40 THEN 'climb' WHEN kmh >= 30 AND p <= 120 THEN 'descent' END AS kind FROM blocks),
    runs AS (SELECT workout_id, kind, count(*) AS n, min(block) AS f, max(block) AS l FROM (SELECT *, block - row_number() OVER (PARTITION BY workout_id, kind ORDER BY block) AS run FROM hills WHERE kind IS NOT NULL) GROUP BY workout_id, kind, run),
    minutes AS (SELECT workout_id, sum(n) FILTER (kind = 'climb') AS up, max(n) FILTER (kind = 'climb') AS most_up, sum(n) FILTER (kind = 'descent') AS down, max(n) FILTER (kind = 'descent') AS most_down, min(f) FILTER (kind = 'climb') < max(l) FILTER (kind = 'descent') AS before FROM runs GROUP BY workout_id)"""


@register("krn17_stall_metrics", oracle("samples", """SELECT t.workout_id, moving / greatest(1, known) AS distance_active_ratio, CAST(coalesce(c.n, 0) AS DOUBLE) / greatest(1, moving) AS step_dominance_ratio,
    CASE WHEN way > 0 THEN sqrt(greatest(0, squares / greatest(1, moving) - (way / greatest(1, moving)) * (way / greatest(1, moving)))) / (way / greatest(1, moving)) ELSE 'Infinity'::DOUBLE END AS speed_variation,
    stalls / greatest(1, t.n - 1) AS stall_active_ratio, way / greatest(1, moving) * 0.5::DOUBLE * 3.6::DOUBLE AS moving_speed_kmh, CAST(coalesce(l.n, 0) AS BIGINT) AS longest_stall_seconds, CAST(coalesce(up, 0) AS BIGINT) AS road_climb_minutes,
    CAST(coalesce(most_up, 0) AS BIGINT) AS longest_road_climb_minutes, CAST(coalesce(down, 0) AS BIGINT) AS road_descent_minutes, CAST(coalesce(most_down, 0) AS BIGINT) AS longest_road_descent_minutes, coalesce(before, false) AS climb_before_descent
    FROM totals t LEFT JOIN longest l USING (workout_id) LEFT JOIN common c USING (workout_id) LEFT JOIN minutes USING (workout_id)""", _STALLED))
def krn17(spark, d):
    return stalls.stall_metrics(ridden_samples(spark, d))


@register("krn08_tail_trimmed", oracle("samples", "SELECT workout_id, idx FROM (SELECT *, count(*) OVER (PARTITION BY workout_id) AS n FROM samples) WHERE idx < n - 20 OR workout_id % 2 = 1"))
def krn08(spark, d):
    n = F.count(F.lit(1)).over(Window.partitionBy("workout_id"))
    s = analog.samples(spark, d).select("workout_id", "idx", n.alias("n"))
    late, last = F.col("idx") >= F.col("n") - 20, F.col("idx") >= F.col("n") - 5

    def column(steady: int, corrupt: int, name: str):
        return F.when(last, 0).when(late & (F.col("workout_id") % 2 == 0), corrupt).otherwise(steady).cast("double").alias(name)

    held = s.select("workout_id", "idx", column(200, 950, "power"), column(90, 150, "cadence"), column(140, 0, "heart_rate"), column(30, 0, "speed"))
    return stalls.tail_trimmed(held).select("workout_id", "idx")
