"""Upserts, replacements and deletes over the derived tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from wattspark import analog
from wattspark.analog import oracle
from wattspark.operators import writes
from wattspark.registry import register


def _old(spark, d):
    return analog.workouts(spark, d).filter("id % 4 <> 0").select("id", "uid", "avg_power")


def _new(spark, d):
    return analog.workouts(spark, d).filter("id % 6 = 0").select("id", "uid", (F.col("avg_power") + 1000).alias("avg_power"))


_BOTH = "old AS (SELECT id, uid, avg_power FROM workouts WHERE id % 4 <> 0), new AS (SELECT id, uid, avg_power + 1000 AS avg_power FROM workouts WHERE id % 6 = 0)"


@register("snk01_insert_new", oracle("workouts", "SELECT * FROM old UNION ALL SELECT * FROM new WHERE id NOT IN (SELECT id FROM old)", _BOTH))
def snk01(spark, d):
    return writes.insert_new(_old(spark, d), _new(spark, d), ["id"], [F.col("avg_power")])


@register("snk02_overwrite", oracle("workouts", "SELECT * FROM old WHERE id NOT IN (SELECT id FROM new) UNION ALL SELECT * FROM new", _BOTH))
def snk02(spark, d):
    return writes.overwrite(_old(spark, d), _new(spark, d), ["id"])


@register("snk03_existing_starts", oracle("workouts", "SELECT w.uid || ':' || strftime(w.start_time, '%Y-%m-%dT%H:%M:%S') AS key, w.id FROM workouts w JOIN new n ON n.id = w.id", _BOTH))
def snk03(spark, d):
    key = F.concat_ws(":", "uid", F.date_format("start_time", "yyyy-MM-dd'T'HH:mm:ss"))
    return analog.workouts(spark, d).join(_new(spark, d).select("id"), "id", "left_semi").select(key.alias("key"), "id")


@register("snk06_update_from", oracle("workouts", "SELECT o.id, o.uid, coalesce(n.avg_power, o.avg_power) AS avg_power FROM old o LEFT JOIN new n USING (id)", _BOTH))
def snk06(spark, d):
    return writes.updated(_old(spark, d), _new(spark, d), ["id"], ["avg_power"])


@register("snk07_row_states", oracle("workouts", "SELECT * FROM old WHERE id % 6 <> 0 AND id % 5 <> 0 UNION ALL SELECT id, uid, avg_power + 1000 FROM old WHERE id % 6 = 0 UNION ALL SELECT * FROM new WHERE id % 12 = 0", _BOTH))
def snk07(spark, d):
    old, new = _old(spark, d), _new(spark, d)
    state = F.when(F.col("id") % 12 == 0, "CRE").otherwise("UPD")
    gone = old.filter("id % 6 <> 0 AND id % 5 = 0").withColumn("rowstate", F.lit("DEL"))
    return writes.routed(old, new.withColumn("rowstate", state).unionByName(gone), ["id"])


@register("snk08_upsert", oracle("workouts", "SELECT * FROM old WHERE id NOT IN (SELECT id FROM new) UNION ALL SELECT * FROM new", _BOTH))
def snk08(spark, d):
    return writes.upsert(_old(spark, d), _new(spark, d), ["id"])


@register("snk09_partial_upsert", oracle("workouts", "SELECT * FROM old WHERE id NOT IN (SELECT id FROM new WHERE uid < 10) UNION ALL SELECT * FROM new", _BOTH))
def snk09(spark, d):
    return writes.upsert(_old(spark, d), _new(spark, d), ["id"], F.col("uid") < 10)


@register("snk10_replaced_sets", oracle("segments", "SELECT wid, duration, start_offset FROM segments WHERE wid % 5 <> 0 UNION ALL SELECT wid, duration, start_offset + 10000 FROM segments WHERE wid % 5 = 0 AND duration > 400"))
def snk10(spark, d):
    s = analog.segments(spark, d).select("wid", "duration", "start_offset")
    again = s.filter("duration > 400").withColumn("start_offset", F.col("start_offset") + 10000)
    return writes.replaced_sets(s, again, s.filter("wid % 5 = 0"), "wid")


@register("snk12_exploded_stream", "SELECT event_id, user_id, row_number() OVER w - 1 AS pos, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 4) AS running FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
def snk12(spark, d):
    from pyspark.sql import Window

    e = spark.read.parquet(f"{d}/events.parquet")
    rows = e.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("ts", "event_id", "value"))).alias("v")).select("user_id", F.posexplode("v").alias("pos", "x"))
    w = Window.partitionBy("user_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    return rows.select("x.event_id", "user_id", F.col("pos").cast("long").alias("pos"), F.round(F.sum("x.value").over(w), 4).alias("running"))


@register("snk23_membership", oracle("shares", "SELECT DISTINCT workout_id % 100 AS item, group_id FROM shares"))
def snk23(spark, d):
    return analog.shares(spark, d).select((F.col("workout_id") % 100).alias("item"), "group_id").dropDuplicates(["item", "group_id"])


@register("snk24_account_gone", oracle("workouts segments", "SELECT s.wid, count(*) AS n FROM segments s WHERE s.wid NOT IN (SELECT id FROM workouts WHERE uid = 5) GROUP BY s.wid"))
def snk24(spark, d):
    gone = analog.workouts(spark, d).filter("uid = 5").select(F.col("id").alias("wid"))
    return analog.segments(spark, d).join(gone, "wid", "left_anti").groupBy("wid").agg(F.count(F.lit(1)).alias("n"))


@register("set07_orphans", oracle("workouts segments", "SELECT wid, sid, duration FROM segments WHERE wid IN (SELECT id FROM workouts WHERE id % 3 = 0) AND sid IN (SELECT p_partkey FROM part WHERE p_size > 10)"))
def set07(spark, d):
    parents = {"wid": (analog.workouts(spark, d).filter("id % 3 = 0"), "id"), "sid": (spark.read.parquet(f"{d}/part.parquet").filter("p_size > 10"), "p_partkey")}
    return writes.without_orphans(analog.segments(spark, d), parents).select("wid", "sid", "duration")


@register("set09_import_plan", oracle("workouts", "SELECT n.id, CASE WHEN o.id IS NULL THEN 'new' WHEN o.avg_power = n.p THEN 'duplicate' ELSE 'conflict' END AS status FROM (SELECT id, CASE WHEN id % 5 = 0 THEN avg_power ELSE avg_power + 1 END AS p FROM workouts WHERE id % 6 = 0) n LEFT JOIN old o USING (id)", _BOTH))
def set09(spark, d):
    w = analog.workouts(spark, d).filter("id % 6 = 0")
    incoming = w.select("id", "uid", F.when(F.col("id") % 5 == 0, F.col("avg_power")).otherwise(F.col("avg_power") + 1).alias("avg_power"))
    return writes.import_plan(_old(spark, d), incoming, ["id"], ["uid", "avg_power"]).select("id", "status")


@register("joi27_delete_join", oracle("workouts shares", "SELECT id FROM workouts w WHERE NOT (uid % 2 = 0 AND EXISTS (SELECT 1 FROM shares s WHERE s.workout_id = w.id) AND NOT EXISTS (SELECT 1 FROM shares s WHERE s.workout_id = w.id AND s.group_id > 20))"))
def joi27(spark, d):
    s = analog.shares(spark, d).select(F.col("workout_id").alias("id"), "group_id")
    w = analog.workouts(spark, d)
    doomed = w.filter("uid % 2 = 0").join(s, "id", "left_semi").join(s.filter("group_id > 20"), "id", "left_anti").select("id")
    return w.join(doomed, "id", "left_anti").select("id")
