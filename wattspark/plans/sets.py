"""Unions, closure, interval merging and deduplication."""

from __future__ import annotations

from pyspark.sql import functions as F

from wattspark import analog
from wattspark.analog import oracle
from wattspark.operators import sets
from wattspark.registry import register

#: Undirected edges a < b: workouts of one user within ten ids whose distances are close.
_EDGES = "edges AS (SELECT a.id AS a, b.id AS b FROM workouts a JOIN workouts b ON b.uid = a.uid AND b.id > a.id AND b.id <= a.id + 400 AND abs(a.total_distance - b.total_distance) < 4000)"


def _edges(spark, d):
    w = analog.workouts(spark, d).select("id", "uid", "total_distance")
    band = F.floor(F.col("id") / 400)
    l = w.select(F.col("id").alias("a"), "uid", F.col("total_distance").alias("da"), F.explode(F.array(band, band + 1)).alias("band"))
    r = w.select(F.col("id").alias("b"), "uid", F.col("total_distance").alias("db"), band.alias("band"))
    return l.join(r, ["uid", "band"]).filter("b > a AND b <= a + 400 AND abs(da - db) < 4000").select("a", "b")


@register("set01_feed", oracle("workouts activities", "SELECT 'workout' AS entity_type, id, total_timer_time AS seconds FROM workouts WHERE year = 1997 UNION ALL SELECT 'activity', id, duration_seconds FROM activities WHERE year(start_time) = 1997"))
def set01(spark, d):
    w = analog.workouts(spark, d).select(F.lit("workout").alias("entity_type"), "id", "start_time", F.col("total_timer_time").alias("seconds"))
    a = analog.activities(spark, d).select(F.lit("activity").alias("entity_type"), "id", "start_time", F.col("duration_seconds").alias("seconds"))
    return w.unionByName(a).filter(F.year("start_time") == 1997).drop("start_time")  # the filter goes into both branches


@register("set02_load_union", oracle("workouts activities", "SELECT uid, count(*) AS n, sum(s) AS seconds FROM (SELECT uid, total_timer_time AS s FROM workouts WHERE workout_type <> 'motorsport' UNION ALL SELECT uid, duration_seconds FROM activities WHERE activity_type = 'cycling') GROUP BY uid"))
def set02(spark, d):
    w = analog.workouts(spark, d).filter("workout_type <> 'motorsport'").select("uid", F.col("total_timer_time").alias("s"))
    a = analog.activities(spark, d).filter("activity_type = 'cycling'").select("uid", F.col("duration_seconds").alias("s"))
    return w.unionByName(a).groupBy("uid").agg(F.count(F.lit(1)).alias("n"), F.sum("s").alias("seconds"))


@register("set03_closure", oracle("workouts", "SELECT id FROM (WITH RECURSIVE c AS (SELECT CAST(21 AS BIGINT) AS id UNION SELECT CASE WHEN e.a = c.id THEN e.b ELSE e.a END FROM c JOIN edges e ON e.a = c.id OR e.b = c.id) SELECT id FROM c)", _EDGES))
def set03(spark, d):
    return sets.closure(_edges(spark, d), "a", "b", spark.range(21, 22))


@register("set05_first_ids", "SELECT DISTINCT user_id FROM events")
def set05(spark, d):
    return spark.read.parquet(f"{d}/events.parquet").select("user_id").dropDuplicates()


@register("set10_merged_windows", oracle("workouts", "SELECT uid, min(s) AS s, max(e) AS e FROM (SELECT *, sum(n) OVER (PARTITION BY uid ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS g FROM (SELECT *, CASE WHEN s > max(e) OVER (PARTITION BY uid ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 1 ELSE 0 END AS n FROM (SELECT uid, start_time AS s, start_time + INTERVAL 3 DAY AS e FROM workouts))) GROUP BY uid, g"))
def set10(spark, d):
    w = analog.workouts(spark, d).select("uid", F.col("start_time").alias("s"), (F.col("start_time") + F.expr("INTERVAL 3 DAYS")).alias("e"))
    return sets.merged_intervals(w, ["uid"], "s", "e")


@register("prj05_other_end", oracle("workouts", "SELECT CASE WHEN a = 21 THEN b ELSE a END AS other FROM edges WHERE a = 21 OR b = 21", _EDGES))
def prj05(spark, d):
    e = _edges(spark, d).filter("a = 21 OR b = 21")
    return e.select(F.when(F.col("a") == 21, F.col("b")).otherwise(F.col("a")).alias("other"))


@register("joi25_component_members", oracle("workouts", "SELECT w.id, w.total_distance, d.other IS NOT NULL AS is_direct FROM (WITH RECURSIVE c AS (SELECT CAST(21 AS BIGINT) AS id UNION SELECT CASE WHEN e.a = c.id THEN e.b ELSE e.a END FROM c JOIN edges e ON e.a = c.id OR e.b = c.id) SELECT id FROM c) m JOIN workouts w USING (id) LEFT JOIN (SELECT CASE WHEN a = 21 THEN b ELSE a END AS other FROM edges WHERE a = 21 OR b = 21) d ON d.other = w.id", _EDGES))
def joi25(spark, d):
    e = _edges(spark, d)
    members = sets.closure(e, "a", "b", spark.range(21, 22))
    direct = sets.symmetric(e, "a", "b").filter("src = 21").select(F.col("dst").alias("id"), F.lit(True).alias("hit")).distinct()
    w = analog.workouts(spark, d).select("id", "total_distance")
    return w.join(members, "id").join(direct, "id", "left").select("id", "total_distance", F.col("hit").isNotNull().alias("is_direct"))


@register("set03_components", oracle("workouts", "SELECT id, min(other) AS component FROM (WITH RECURSIVE s AS (SELECT a AS x, b AS y FROM edges UNION SELECT b, a FROM edges), c(id, other) AS (SELECT x, x FROM s UNION SELECT c.id, s.y FROM c JOIN s ON s.x = c.other) SELECT * FROM c) GROUP BY id", _EDGES.replace("< 4000", "< 1000")))
def set03_components(spark, d):
    w = analog.workouts(spark, d).select("id", "total_distance")
    dist = lambda n: w.select(F.col("id").alias(n), F.col("total_distance").alias(f"d{n}"))
    e = _edges(spark, d).join(dist("a"), "a").join(dist("b"), "b").filter("abs(da - db) < 1000").select("a", "b")
    return sets.labels(e, "a", "b")
