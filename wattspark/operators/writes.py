"""Upserts, replacements and deletes, as the table that results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def insert_new(existing: DataFrame, incoming: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Existing rows and those incoming whose key is free, of equals the first in `order`: the first writer wins."""
    first = incoming.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_rank = 1").drop("_rank")
    return existing.unionByName(first.join(existing, keys, "left_anti"))


def overwrite(existing: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """All incoming rows in place of existing ones with their key."""
    return existing.join(incoming.select(*keys).distinct(), keys, "left_anti").unionByName(incoming)


def latest(rows: DataFrame, keys: list[str], by: list[str] | None = None) -> DataFrame:
    """One row a key: the greatest by the columns `by`, or by all others in their order."""
    by = by or [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rows.columns), F.struct(*by, *keys)).alias("_row")).select("_row.*")


def upsert(existing: DataFrame, incoming: DataFrame, keys: list[str], when: Column | None = None, by: list[str] | None = None) -> DataFrame:
    """The latest row of each key, incoming over existing, of incoming ones with one key the greatest by the columns `by`;
    with `when`, only those incoming rows that meet it replace, and all others are added."""
    blocking = latest(incoming if when is None else incoming.filter(when), keys, by)
    return overwrite(existing, blocking, keys) if when is None else existing.join(blocking.select(*keys).distinct(), keys, "left_anti").unionByName(blocking).unionByName(incoming.filter(~when))


def updated(existing: DataFrame, changes: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Existing rows with the non-null values of `changes` in `columns`."""
    new = changes.select(*keys, *[F.col(c).alias(f"_new_{c}") for c in columns])
    joined = existing.join(new, keys, "left")
    return joined.select(*[F.coalesce(f"_new_{c}", c).alias(c) if c in columns else F.col(c) for c in existing.columns])


def routed(existing: DataFrame, changes: DataFrame, keys: list[str], state: str = "rowstate") -> DataFrame:
    """Rows after changes marked CRE, UPD or DEL."""
    gone = changes.filter(F.col(state).isin("UPD", "DEL")).select(*keys).distinct()
    kept = existing.join(gone, keys, "left_anti")
    updates = changes.filter(F.col(state) == "UPD").join(existing.select(*keys), keys, "left_semi").drop(state)
    return kept.unionByName(changes.filter(F.col(state) == "CRE").drop(state)).unionByName(updates)


def replaced_sets(existing: DataFrame, incoming: DataFrame, parents: DataFrame, key: str) -> DataFrame:
    """The whole set of children of each parent in `parents` gives way to the incoming one, which may be empty."""
    return existing.join(parents.select(key).distinct(), key, "left_anti").unionByName(incoming.join(parents.select(key).distinct(), key, "left_semi"))


def without_orphans(children: DataFrame, parents: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """Children all of whose references (`column`: table and its key) are there."""
    for column, (table, key) in parents.items():
        children = children.join(table.select(F.col(key).alias(column)).distinct(), column, "left_semi")
    return children


def import_plan(existing: DataFrame, incoming: DataFrame, keys: list[str], content: list[str]) -> DataFrame:
    """Incoming rows marked new, duplicate (the same content is there) or conflict."""
    form = lambda: F.to_json(F.struct(*sorted(content)), {"ignoreNullFields": "false"})
    there = existing.select(*keys, form().alias("_there")).dropDuplicates(keys)
    return incoming.withColumn("_form", form()).join(there, keys, "left").withColumn("status", F.when(F.col("_there").isNull(), "new").when(F.col("_there") == F.col("_form"), "duplicate").otherwise("conflict")).drop("_form", "_there")
