"""Joins and rankings by which the services read and write: owners, grants, feeds, bulk inserts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def segment_efforts(efforts: DataFrame, workouts: DataFrame) -> DataFrame:
    """Efforts on segments with the owner and month of their workouts, motor sport left out (as are workouts without a type)."""
    rides = workouts.filter("workout_type <> 'motorsport'").select(F.col("id").alias("wid"), "uid", "year_month")
    return efforts.join(rides, "wid").select("sid", "wid", "uid", "year_month", "duration", "start_offset")


def with_owner(rows: DataFrame, users: DataFrame) -> DataFrame:
    """Rows with their owner's display name; rows without an owner go."""
    return rows.join(users.select(F.col("id").alias("uid"), F.col("display_name").alias("owner")), "uid")


def not_shared(workouts: DataFrame, shares: DataFrame, groups: DataFrame) -> DataFrame:
    """(id, group_id): workouts with each group of `groups` (uid, group_id) of their owner that they are not shared to yet."""
    wanted = workouts.select("id", "uid").join(groups, "uid").select("id", "group_id")
    return wanted.join(shares.select(F.col("workout_id").alias("id"), "group_id"), ["id", "group_id"], "left_anti")


def with_zeros(rows: DataFrame, more: DataFrame, keys: list[str]) -> DataFrame:
    """Rows with the columns of `more`, 0 where it has no row for them."""
    columns = [c for c in more.columns if c not in keys]
    return rows.join(more, keys, "left").fillna(0, columns)


def granted_roles(users: DataFrame, roles: DataFrame) -> DataFrame:
    """Every user with each role and who granted it: (id, display_name, role, granted_by); null without one."""
    grantor = users.select(F.col("id").alias("grantor_id"), F.col("display_name").alias("granted_by"))
    held = roles.join(grantor, "grantor_id", "left").select(F.col("user_id").alias("id"), "role", "granted_by")
    return users.select("id", "display_name").join(held, "id", "left")


def rows_of_arrays(arrays: DataFrame, columns: list[str]) -> DataFrame:
    """A row for each place of the columns' parallel arrays; shorter arrays give nulls."""
    rest = [c for c in arrays.columns if c not in columns]
    return arrays.select(*rest, F.inline(F.arrays_zip(*columns)))


def with_children_done(parents: DataFrame, children: DataFrame, key: str, status: str = "done") -> DataFrame:
    """Parents as they are once `children` are written: those with children get the status."""
    there = children.select(F.col(key).alias("id"), F.lit(status).alias("new_status")).distinct()
    return parents.join(there, "id", "left").withColumn("status", F.coalesce("new_status", "status")).drop("new_status")


def effort_speeds(efforts: DataFrame, segments: DataFrame) -> DataFrame:
    """Efforts with avg_speed in km/h from their segment's length, to one place; null without time."""
    length = segments.select(F.col("id").alias("sid"), F.col("distance").alias("metres"))
    speed = F.round((F.col("metres").cast("decimal(20,3)") * 36 / F.nullif(F.col("duration"), F.lit(0)) / 10).cast("decimal(24,6)"), 1)
    return efforts.join(length, "sid").withColumn("avg_speed", speed.cast("double")).drop("metres")


def feed_order(time: Column) -> list[Column]:
    """The feed's order: latest first, then by kind and, of one kind, the greater id."""
    return [time.desc_nulls_last(), F.col("entity_type").asc(), F.col("entity_id").desc()]


def similarity_order() -> list[Column]:
    """Direct matches first, then by score, start and id, all descending with nulls last."""
    return [F.col("is_direct").desc(), F.col("score").desc_nulls_last(), F.col("start_time").desc_nulls_last(), F.col("id").desc()]


def ranked_within(rows: DataFrame, by: list[str], order: list[Column], name: str = "place") -> DataFrame:
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))


def json_list(rows: DataFrame, key: str, value: str, parents: DataFrame, name: str) -> DataFrame:
    """Parents with the ordered list of their values as JSON, [] where they have none."""
    lists = rows.groupBy(F.col(key).alias("id")).agg(F.array_sort(F.collect_list(value)).alias("held"))
    return parents.join(lists, "id", "left").withColumn(name, F.to_json(F.coalesce("held", F.array().cast(lists.schema["held"].dataType)))).drop("held")


def summary_maps(rows: DataFrame, by: str, period: str) -> DataFrame:
    """(by, counts): for each owner a map from period to the number of rows."""
    each = rows.groupBy(by, period).agg(F.count(F.lit(1)).alias("n"))
    return each.groupBy(by).agg(F.map_from_entries(F.collect_list(F.struct(period, "n"))).alias("counts"))


def looked_up(counts: Column, period: Column) -> Column:
    """A map's value, 0 where it has none."""
    return F.coalesce(F.try_element_at(counts, period), F.lit(0).cast("long"))
