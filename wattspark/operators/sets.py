"""Interval merging, graph closure and deduplication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def merged_intervals(df: DataFrame, by: list[str], start: str, end: str) -> DataFrame:
    """Closed intervals that touch or overlap, as one."""
    w = Window.partitionBy(*by).orderBy(start, end)
    reach = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    islands = df.withColumn("_new", F.coalesce((F.col(start) > reach).cast("int"), F.lit(1))).withColumn("_island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return islands.groupBy(*by, "_island").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("_island")


def symmetric(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(src, dst) in both directions."""
    return edges.select(F.col(a).alias("src"), F.col(b).alias("dst")).union(edges.select(F.col(b).alias("src"), F.col(a).alias("dst")))


def closure(edges: DataFrame, a: str, b: str, start: DataFrame, most_steps: int = 50) -> DataFrame:
    """(id) of all nodes that `start` (id) reaches along undirected edges, itself included.

    A frontier join per step, with the lineage cut by checkpoints, until a step finds nothing new.
    """
    spark = edges.sparkSession
    _checkpoints(spark)
    links = symmetric(edges, a, b).distinct().checkpoint()
    seen = start.select("id").distinct().checkpoint()
    frontier = seen
    for _ in range(most_steps):
        frontier = frontier.join(links, frontier["id"] == links["src"]).select(F.col("dst").alias("id")).distinct().join(seen, "id", "left_anti").checkpoint()
        if frontier.isEmpty():
            return seen
        seen = seen.union(frontier).checkpoint()
    raise RuntimeError(f"not closed after {most_steps} steps")


def labels(edges: DataFrame, a: str, b: str, most_steps: int = 60) -> DataFrame:
    """(id, component) for every node with an edge: the least id reachable. Labels spread to neighbours and
    jump to their label's label each step, so steps grow with the logarithm of a component's width."""
    _checkpoints(edges.sparkSession)
    links = symmetric(edges, a, b).distinct().checkpoint()
    known = links.groupBy(F.col("src").alias("id")).agg(F.least(F.first("src"), F.min("dst")).alias("component")).checkpoint()
    for _ in range(most_steps):
        near = links.join(known, links["dst"] == known["id"]).groupBy(F.col("src").alias("id")).agg(F.min("component").alias("near"))
        spread = known.join(near, "id").select("id", F.least("component", "near").alias("component"))
        up = spread.select(F.col("id").alias("component"), F.col("component").alias("up"))
        following = spread.join(up, "component", "left").select("id", F.least("component", F.coalesce("up", "component")).alias("component")).checkpoint()
        changed = following.join(known.withColumnRenamed("component", "was"), "id").filter("component <> was").limit(1).count()
        known = following
        if not changed:
            return known
    raise RuntimeError(f"labels still move after {most_steps} steps")


def _checkpoints(spark) -> None:
    """A checkpoint folder where the session names none, as in tests on one machine."""
    if spark.conf.get("spark.checkpoint.dir", None) is None and spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        import tempfile

        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="wattspark-"))


def canonical(df: DataFrame, by: list[str], key: str) -> DataFrame:
    """(duplicate, canonical) for groups with several keys: all but the least, with the least."""
    groups = df.groupBy(*by).agg(F.array_sort(F.collect_list(key)).alias("ids")).filter(F.size("ids") > 1)
    return groups.select(F.explode(F.slice("ids", 2, F.size("ids"))).alias("duplicate"), F.get("ids", F.lit(0)).alias("canonical"))


def best_of(df: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    """One row of each group, the first in `order`."""
    return df.withColumn("_rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter("_rank = 1").drop("_rank")
