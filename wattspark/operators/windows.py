"""Window operators over efforts and 1 Hz samples."""

from __future__ import annotations

from bisect import bisect_left, insort
from math import ceil, floor

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from wattspark.functions.numeric import half_up


SLICE_DAYS = 364


def rolling_quantiles(rows: DataFrame, durations: tuple[int, ...], days: int = 84, quantile: float = 0.95) -> DataFrame:
    """For each workout (a row with power_<d> columns), quantile and number of its user's best powers of the last
    `days`, itself and others at the same moment included.

    A user's history is dealt in slices of SLICE_DAYS, each with the `days` before it, so that a long one is many tasks;
    within a slice one pass keeps the window's values sorted.
    """
    powers = [f"power_{d}" for d in durations]
    day = F.unix_date(F.col("start_time").cast("date"))
    own = F.floor(day / SLICE_DAYS)
    reaches = F.floor((day + days) / SLICE_DAYS)  # the last slice that looks back to this day
    placed = rows.select("uid", "wid", "start_time", *powers, own.alias("own"), F.explode(F.sequence(own, reaches)).alias("slice"))
    placed = placed.select("uid", "slice", (F.col("own") == F.col("slice")).alias("here"), "wid", "start_time", F.unix_micros(F.col("start_time").cast("timestamp")).alias("at"), *powers)
    span = days * 86_400_000_000

    def pass_over(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["at", "wid"], kind="stable").reset_index(drop=True)
        at, here = pdf["at"].to_numpy(), pdf["here"].to_numpy()
        out = pdf.loc[here, ["uid", "wid", "start_time"]].copy()
        upto = np.searchsorted(at, at, side="right")
        begin = np.searchsorted(at, at - span, side="left")
        for d in durations:
            value = pdf[f"power_{d}"].to_numpy(float)
            held, low, high, q, n = [], 0, 0, [], []
            for i in np.nonzero(here)[0]:
                for k in range(high, upto[i]):
                    if value[k] > 0:
                        insort(held, value[k])
                high = max(high, upto[i])
                for k in range(low, begin[i]):
                    if value[k] > 0:
                        del held[bisect_left(held, value[k])]
                low = max(low, begin[i])
                n.append(len(held))
                if held:
                    place = (len(held) - 1) * quantile
                    a, b = floor(place), ceil(place)
                    q.append(held[a] if a == b else (b - place) * held[a] + (place - a) * held[b])
                else:
                    q.append(None)
            out[f"q_{d}"], out[f"n_{d}"] = pd.Series(q, index=out.index, dtype="float64"), pd.Series(n, index=out.index, dtype="int64")
        return out

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    schema = ", ".join([f"uid {kinds['uid']}", f"wid {kinds['wid']}", f"start_time {kinds['start_time']}", *[f"q_{d} double, n_{d} long" for d in durations]])
    names = ["uid", "wid", "start_time", *[x for d in durations for x in (f"q_{d}", f"n_{d}")]]
    return placed.groupBy("uid", "slice").applyInPandas(lambda pdf: pass_over(pdf)[names], schema)


def nth_of_ranges(values: np.ndarray, begin: np.ndarray, end: np.ndarray, nth: np.ndarray) -> np.ndarray:
    """The nth smallest, from 0, of each values[begin:end], by halving the ranks of the values bit by bit for all ranges at once."""
    every, rank = np.unique(values, return_inverse=True)
    found, begin, end, nth = np.zeros(len(begin), np.int64), begin.copy(), end.copy(), nth.copy()
    for bit in range(max(1, len(every) - 1).bit_length() - 1, -1, -1):
        upper = (rank >> bit & 1).astype(bool)
        lower = np.concatenate(([0], np.cumsum(~upper)))
        b, e = lower[begin], lower[end]
        up = nth >= e - b
        found[up] += 1 << bit
        nth = np.where(up, nth - (e - b), nth)
        begin, end = np.where(up, lower[-1] + begin - b, b), np.where(up, lower[-1] + end - e, e)
        rank = np.concatenate([rank[~upper], rank[upper]])
    return every[found]


def earlier_quantile(rows: DataFrame, column: str, days: int = 365, quantile: float = 0.95) -> DataFrame:
    """The rows with the quantile and number of their user's earlier values of the last `days`, the row itself left out.

    Histories are dealt in slices as in `rolling_quantiles`. Rows without a time are each other's earlier ones, as in SQL.
    """
    day = F.unix_date(F.col("start_time").cast("date"))
    own = F.floor(day / SLICE_DAYS)
    slices = F.explode_outer(F.sequence(own, F.floor((day + days) / SLICE_DAYS))).alias("_slice")
    placed = rows.select("*", own.alias("_own"), F.unix_micros(F.col("start_time").cast("timestamp")).alias("_at"), F.col(column).cast("double").alias("_value"), slices)
    span = days * 86_400_000_000
    names = rows.columns

    def pass_over(table: pa.Table) -> pa.Table:
        if table.column("_slice").null_count:
            begin, end = np.zeros(len(table), np.int64), np.full(len(table), len(table))
            here = np.arange(len(table))
        else:
            table = table.take(pa.array(np.argsort(table.column("_at").to_numpy(), kind="stable")))
            at = table.column("_at").to_numpy()
            here = np.nonzero(table.column("_own").to_numpy() == table.column("_slice").to_numpy())[0]
            begin, end = np.searchsorted(at, at[here] - span, side="left"), np.searchsorted(at, at[here], side="left")
        value = table.column("_value")
        known = np.concatenate(([0], np.cumsum(value.is_valid().to_numpy())))
        begin, end = known[begin], known[end]
        n = end - begin
        some = np.nonzero(n)[0]
        place = (n[some] - 1) * quantile
        low, high = np.floor(place).astype(np.int64), np.ceil(place).astype(np.int64)
        held, q = value.drop_null().to_numpy(), np.zeros(len(n))
        if len(some):
            a, b = (nth_of_ranges(held, begin[some], end[some], k) for k in (low, high))
            q[some] = np.where(low == high, a, (high - place) * a + (place - low) * b)
        out = table.select(names).take(pa.array(here))
        return out.append_column("earlier", pa.array(q, mask=n == 0)).append_column("earlier_n", pa.array(n))

    schema = StructType([*rows.schema.fields, StructField("earlier", DoubleType()), StructField("earlier_n", LongType())])
    return placed.groupBy("uid", "_slice").applyInArrow(pass_over, schema)


def ranked(rows: DataFrame, by: list[str], order: list[Column], name: str) -> DataFrame:
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))


def leaderboard(efforts: DataFrame, per_user: int | None = None) -> DataFrame:
    """Efforts on a segment ranked by time; with `per_user` only a user's best so many."""
    ties = [F.col("duration"), F.col("start_time"), F.col("wid"), F.col("start_offset")]
    out = ranked(ranked(efforts, ["sid"], ties, "rn"), ["sid", "uid"], ties, "user_rank")
    return out if per_user is None else out.filter(F.col("user_rank") <= per_user)


def normalized_power(samples: DataFrame, by: str = "workout_id") -> DataFrame:
    """The fourth root of the mean fourth power of trailing 30 s means; of shorter series that of the samples. Missing power is 0."""
    power = F.coalesce(F.col("power"), F.lit(0.0))
    w = Window.partitionBy(by).orderBy("idx").rowsBetween(-29, 0)
    smooth = samples.select(by, "idx", power.alias("p"), F.avg(power).over(w).alias("mean"), F.count(F.lit(1)).over(Window.partitionBy(by)).alias("n"))
    fourth = F.when(F.col("n") < 30, F.pow("p", F.lit(4.0))).when(F.col("idx") >= 29, F.pow("mean", F.lit(4.0)))
    return smooth.groupBy(by).agg(half_up(F.pow(F.avg(fourth), F.lit(0.25))).alias("np"))


def exact_mean(column: str, window) -> Column:
    """The mean over a window with an exact sum (six decimals), which no order of adding changes."""
    return F.sum(F.col(column).cast("decimal(18,6)")).over(window).cast("double") / F.count(column).over(window)


def trailing_mean(column: str, size: int, by: str = "workout_id") -> Column:
    """Over the last `size` samples, fewer at the beginning."""
    return exact_mean(column, Window.partitionBy(by).orderBy("idx").rowsBetween(-(size - 1), 0))


def centred_mean(column: str, size: int, by: str = "workout_id") -> Column:
    """Around the sample; an even size looks one further ahead than back."""
    back = (size - 1) // 2
    return exact_mean(column, Window.partitionBy(by).orderBy("idx").rowsBetween(-back, size - 1 - back))


def weighted_balance(balance: str, power: str, size: int, least: float = 50.0, by: str = "workout_id") -> Column:
    """The mean of `balance` weighted by power around the sample; null where mean power is under `least`."""
    back = (size - 1) // 2
    w = Window.partitionBy(by).orderBy("idx").rowsBetween(-back, size - 1 - back)
    return F.when(F.avg(power).over(w) >= least, F.sum(F.col(balance) * F.col(power)).over(w) / F.sum(power).over(w))


def running_max(column: str, by: str = "workout_id") -> Column:
    return F.max(column).over(Window.partitionBy(by).orderBy("idx").rowsBetween(Window.unboundedPreceding, 0))


def prefix_sum(column: str, by: str = "workout_id") -> Column:
    return F.sum(column).over(Window.partitionBy(by).orderBy("idx").rowsBetween(Window.unboundedPreceding, 0))


def change(column: str, by: str = "workout_id") -> Column:
    """From the sample before; the first is its own value."""
    w = Window.partitionBy(by).orderBy("idx")
    return F.col(column) - F.coalesce(F.lag(column).over(w), F.lit(0))


def filled(column: str, by: str = "workout_id", back: bool = True) -> Column:
    """The last known value; with `back`, leading gaps get the first known one."""
    w = Window.partitionBy(by).orderBy("idx")
    forward = F.last(column, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    if not back:
        return forward
    return F.coalesce(forward, F.first(column, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing)))


def best_windows(samples: DataFrame, durations: tuple[int, ...], by: str = "workout_id") -> DataFrame:
    """For each series and duration the window of most power, the first of equals: start, end and mean.

    Sums of windows are differences of one running sum, so all durations share one sort of each series.
    """
    w = Window.partitionBy(by).orderBy("idx")
    # exact sums of millionths, so that ties are ties
    power = F.coalesce(F.col("power"), F.lit(0.0)).cast("decimal(18,6)")
    run = samples.select(by, "idx", F.sum(power).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("run"))
    ends = run.select(by, "idx", "run", *[F.lag("run", d).over(w).alias(f"before_{d}") for d in durations])
    sums = F.array(*[F.struct(F.lit(d).alias("duration"), F.when(F.col("idx") >= d - 1, F.col("run") - F.coalesce(F.col(f"before_{d}"), F.lit(0).cast("decimal(28,6)"))).alias("total")) for d in durations])
    each = ends.select(by, "idx", F.inline(sums)).filter("total IS NOT NULL")
    best = each.groupBy(by, "duration").agg(F.min_by(F.struct("idx", "total"), F.struct(-F.col("total"), F.col("idx"))).alias("best"))
    return best.select(by, "duration", (F.col("best.idx") - F.col("duration") + 1).alias("start_offset"), F.col("best.idx").alias("end_offset"), (F.col("best.total").cast("double") / F.col("duration")).alias("avg_power"))


def bucket_means(samples: DataFrame, size: int = 15, by: str = "workout_id") -> DataFrame:
    """Rounded means of so many samples each, the last bucket as short as it is."""
    return samples.groupBy(by, F.floor(F.col("idx") / size).alias("bucket")).agg(half_up(F.avg(F.coalesce("power", F.lit(0.0)))).alias("power"), F.count(F.lit(1)).alias("samples"))


def climb_runs(samples: DataFrame, column: str, size: int = 60, least: float = 0.0, by: str = "workout_id") -> DataFrame:
    """Blocks of `size` samples, their gain of `column`, and for each series the number and the longest run of blocks with a gain over `least`."""
    blocks = samples.groupBy(by, F.floor(F.col("idx") / size).alias("block")).agg((F.max_by(column, "idx") - F.min_by(column, "idx")).alias("gain"))
    w = Window.partitionBy(by).orderBy("block")
    up = (F.col("gain") > least).cast("int")
    runs = blocks.withColumn("up", up).withColumn("island", F.sum(1 - F.col("up")).over(w)).filter("up = 1").groupBy(by, "island").agg(F.count(F.lit(1)).alias("length"))
    return runs.groupBy(by).agg(F.sum("length").alias("blocks_up"), F.max("length").alias("longest_run"), F.count(F.lit(1)).alias("runs"))
