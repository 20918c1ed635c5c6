"""Connected components of an edge table, by rounds of star contraction over written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattspark.llm.common import forget, written

MOST_ROUNDS = 60


def components(edges: DataFrame, tag: str = "components") -> DataFrame:
    """(node, component) for every node of `edges` (long columns a, b): the smallest node reachable.

    Alternates large and small stars: each node hands its larger neighbours, then its smaller ones, to the
    smallest node it knows, until the edges form stars. The sums of hash aggregations meet per node, never
    per component, and a node's neighbours are joined to their minimum, not gathered. Rounds grow with
    the logarithm of the longest path. Self-links and repeated links are allowed; no edges give no rows.
    """
    current = written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a IS NOT NULL AND b IS NOT NULL").distinct(), tag)
    nodes, before = current, None
    for _ in range(MOST_ROUNDS):
        # large star: for every node u, its neighbours v > u go to the least node around u
        links = current.filter("a <> b")
        both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # written, so that the join below is one of two plain exchanges, which adaptive execution splits at hubs
        least = written(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), tag)
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        # small star: for every node u, its neighbours v <= u and u itself go to the least of them
        lowest = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(lowest, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.a", "e.b").filter("a <> b").distinct()
        following = written(small, tag)
        forget(least)
        if current is not nodes:
            forget(current)
        current = following
        # stars are reached when the edges stay as they are
        state = current.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.bit_xor(F.xxhash64("b", "a"))).first()
        if state == before:
            break
        before = state
    else:
        raise RuntimeError(f"no stars after {MOST_ROUNDS} rounds")
    members = current.select(F.col("a").alias("node"), F.col("b").alias("component"))
    every = nodes.select(F.col("a").alias("node")).union(nodes.select("b")).distinct()
    return every.join(members, "node", "left").select("node", F.coalesce("component", "node").alias("component"))
