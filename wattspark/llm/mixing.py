"""Mixing sources to target weights by subset-sum budget fitting.

Per source: whole copies of all documents as far as the target reaches, then a part of the documents
whose lengths add up to the rest. The part is fitted on the source's table of exact lengths and counts:
an even share of each length first, then a bounded knapsack (a bit set of reachable sums) over the
budget that remains. Which documents of a length are taken follows a seeded hash.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wattspark.llm.common import WORD, columns_of, fresh, written

WEIGHTS = (5, 2, 1)
MOST_REPEATS = 3
SEED = 20240
#: Slices of the seeded hash; only the slice in which the last document of a length falls is ranked.
SLICES = 1024
#: Bits of the reachable sums: the knapsack's budget is at most this many words.
KNAPSACK_WORDS = 1 << 17
#: Lengths that the knapsack may draw on (the shortest of those left), which bounds its memory.
KNAPSACK_LENGTHS = 256


def size_in_words(text: Column) -> Column:
    """Runs of characters outside [\\x20\\x09-\\x0D]; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def water_fill(sizes: list[tuple[str | None, int]], weights: tuple[float, ...] = WEIGHTS, most: int = MOST_REPEATS, share: float = 1.0) -> dict[str | None, float]:
    """Targets by source: weights dealt in the order of code points, null last, that share `share` of all
    sizes; a target stops at `most` times its source's size and the excess is shared anew by weight."""
    order = sorted(sizes, key=lambda x: (x[0] is None, (x[0] or "").encode("utf-32-be")))
    weight = {s: float(weights[i % len(weights)]) for i, (s, _) in enumerate(order)}
    cap = {s: float(most * n) for s, n in order}
    target, left, free = {}, share * sum(n for _, n in order), [s for s, _ in order]
    while free:
        unit = left / sum(weight[s] for s in free)
        full = [s for s in free if unit * weight[s] > cap[s]]
        if not full:
            target.update({s: unit * weight[s] for s in free})
            break
        for s in full:
            target[s] = cap[s]
            left -= cap[s]
        free = [s for s in free if s not in full]
    return target


def fit(lengths: dict[int, int], budget: int) -> dict[int, int]:
    """Documents to take of each length (`lengths`: length -> count) whose words come as near to `budget`
    as the method can, from below or exact. Lengths of 0 are never needed."""
    left = {n: c for n, c in lengths.items() if n > 0}
    total = sum(n * c for n, c in left.items())
    if budget <= 0 or not total:
        return {}
    if budget >= total:
        return left
    # an even share of every length, rounded up or down by a fixed draw, but for what the knapsack will fill
    pool = sorted(left)[:KNAPSACK_LENGTHS]
    spare = min(KNAPSACK_WORDS, sum(n * left[n] for n in pool)) // 2
    mixed = sorted(left, key=lambda n: (n * 2654435761 % (1 << 32), n))
    take, rest = dict.fromkeys(left, 0), budget
    for n in mixed:
        share = int(left[n] * budget / total + (n * 2654435761 % (1 << 32)) / (1 << 32))
        take[n] = max(0, min(left[n], share, (rest - spare) // n))
        rest -= take[n] * n
    for n in mixed:
        more = max(0, min(left[n] - take[n], (rest - spare) // n))
        take[n] += more
        rest -= more * n
    room = min(rest, KNAPSACK_WORDS)
    items = []  # (length, how many): counts split in powers of two
    for n in sorted(n for n in left if left[n] > take[n] and n <= room)[:KNAPSACK_LENGTHS]:
        some, step = min(left[n] - take[n], room // n), 1
        while some > 0:
            items.append((n, min(step, some)))
            some -= step
            step *= 2
    full = (1 << (room + 1)) - 1
    reach = [1]
    for n, k in items:
        reach.append((reach[-1] | reach[-1] << n * k) & full)
    at = reach[-1].bit_length() - 1  # the largest sum within the budget
    for (n, k), before in zip(reversed(items), reversed(reach[:-1])):
        if not before >> at & 1:
            take[n] += k
            at -= n * k
    return take


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = WEIGHTS, most: int = MOST_REPEATS, share: float = 1.0, seed: int = SEED) -> DataFrame:
    """One row per row of `docs`: id, source, size, source_size, target, copies, taken.

    Null texts have size 0 and are never taken (copies 0, or the whole copies of their source). Null
    sources form one source, the last. Sources without words have target 0. Repeated rows are rows of
    their own; rows that share id, source and size are told apart by their rank. Ties in the seeded
    hash are broken by id. Reruns over the same rows take the same documents.
    """
    rows = written(
        docs.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), size_in_words(F.col(text_col)).alias("size")).withColumn("draw", F.xxhash64(F.lit(seed), "id", "size")).withColumn("slice", F.pmod("draw", F.lit(SLICES)).cast("int")),
        "mix-sizes",
    )
    # the number of rows here is that of distinct lengths in a source, not of documents
    by_length = written(rows.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")), "mix-lengths")
    sizes = by_length.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("words"))
    spark = docs.sparkSession
    known = [(r["source"], int(r["words"])) for r in sizes.collect()]  # one row a source
    target = water_fill(known, weights, most, share)
    plan = [(s, n, float(target.get(s, 0.0))) for s, n in known]
    per_source = spark.createDataFrame(plan, "source string, source_size long, target double") if plan else spark.createDataFrame([], "source string, source_size long, target double")

    def fitted(pdf: pd.DataFrame) -> pd.DataFrame:
        words, goal = int(pdf["source_size"].iloc[0]), float(pdf["target"].iloc[0])
        whole = min(most, int(goal // words)) if words else 0
        part = fit(dict(zip(pdf["size"].astype(int), pdf["n"].astype(int))), round(goal) - whole * words) if whole < most else {}
        return pd.DataFrame({"source": pdf["source"], "size": pdf["size"], "source_size": words, "target": goal, "whole": whole, "part": [part.get(int(n), 0) for n in pdf["size"]]})

    goals = F.broadcast(per_source)  # a row a source, from the driver
    lengths = by_length.join(goals, by_length["source"].eqNullSafe(goals["source"])).select(by_length["source"], "size", "n", "source_size", "target")
    chosen = lengths.groupBy("source").applyInPandas(fitted, "source string, size long, source_size long, target double, whole int, part long")
    # how many of each slice: those before the last one whole, the last one by rank
    w = Window.partitionBy("source", "size").orderBy("slice")
    slices = rows.groupBy("source", "size", "slice").agg(F.count(F.lit(1)).alias("m")).withColumn("before", F.sum("m").over(w) - F.col("m"))
    chosen = written(chosen, "mix-plan")
    on = slices["source"].eqNullSafe(chosen["source"]) & (slices["size"] == chosen["size"])
    dealt = slices.join(chosen, on).select(slices["source"], slices["size"], "slice", "m", "source_size", "target", "whole", F.greatest(F.lit(0), F.least(F.col("m"), F.col("part") - F.col("before"))).alias("some"))
    dealt = written(dealt.withColumn("split", (F.col("some") > 0) & (F.col("some") < F.col("m"))), "mix-slices")
    on = rows["source"].eqNullSafe(dealt["source"]) & (rows["size"] == dealt["size"]) & (rows["slice"] == dealt["slice"])
    each = rows.join(dealt, on).select("id", rows["source"], rows["size"], rows["slice"], "draw", "source_size", "target", "whole", "some", "split")
    rank = F.row_number().over(Window.partitionBy("source", "size", "slice").orderBy("draw", "id"))
    whole_slices = each.filter(~F.col("split")).withColumn("extra", (F.col("some") > 0).cast("int"))
    split_slices = each.filter("split").withColumn("extra", (rank <= F.col("some")).cast("int"))
    out = whole_slices.unionByName(split_slices)
    copies = F.col("whole") + F.col("extra")
    return out.select(F.col("id").alias(id_col), F.col("source").alias(source_col), "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The documents of the mix with all their columns, a row for each copy that it takes.

    Rows that share id, source and size share what the mix takes of them: whole rounds over all of them,
    then one more of each in the order of a hash. Null ids match null ids; an empty table gives an empty
    one; columns may have any names.
    """
    k_id, k_source, k_size, k_copies, k_rows, k_times, k_last, k_one = fresh(docs, "mix_id", "mix_source", "mix_size", "mix_copies", "mix_rows", "mix_times", "mix_last", "mix_one")
    taken = mix(docs, id_col, text_col, source_col, **options).groupBy(F.col(id_col).alias(k_id), F.col(source_col).alias(k_source), F.col("size").alias(k_size))
    taken = written(taken.agg(F.sum("copies").cast("int").alias(k_copies), F.count(F.lit(1)).alias(k_rows)).filter(F.col(k_copies) > 0), "mix-taken")
    size, source = size_in_words(F.col(f"`{text_col}`")), F.col(f"`{source_col}`").cast("string")
    joined = docs.join(taken, F.col(f"`{id_col}`").eqNullSafe(F.col(k_id)) & source.eqNullSafe(F.col(k_source)) & (size == F.col(k_size)))

    def repeated(rows: DataFrame) -> DataFrame:
        return rows.withColumn(k_one, F.explode(F.sequence(F.lit(1), F.col(k_copies)))).select(*columns_of(docs))

    out = repeated(joined.filter(F.col(k_rows) == 1))
    if taken.filter(F.col(k_rows) > 1).isEmpty():
        return out
    # equal rows are folded first, so that many copies of a row are one row of the window
    apart = joined.filter(F.col(k_rows) > 1).groupBy(*columns_of(docs), k_id, k_source, k_size, k_copies, k_rows).agg(F.count(F.lit(1)).alias(k_times))
    order = Window.partitionBy(k_id, k_source, k_size).orderBy(F.xxhash64(*columns_of(docs)))
    apart = apart.withColumn(k_last, F.sum(k_times).over(order))
    rounds, rest = F.floor(F.col(k_copies) / F.col(k_rows)), F.col(k_copies) % F.col(k_rows)
    more = F.greatest(F.lit(0), F.least(rest, F.col(k_last)) - (F.col(k_last) - F.col(k_times)))
    return out.unionByName(repeated(apart.withColumn(k_copies, (rounds * F.col(k_times) + more).cast("int")).filter(F.col(k_copies) > 0)))
