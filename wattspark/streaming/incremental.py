"""Incremental recomputation with Structured Streaming.

Late data may arrive for any past day, so a watermark must not drop it. What a new workout touches is its
own row and a span after it; each micro-batch recomputes the touched spans from the stored table and
replaces what changed. Batches are keyed by their id in a ledger, so a repeated batch changes nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from wattspark.operators.sets import merged_intervals


def affected_windows(arrivals: DataFrame, by: list[str], time: str, days: int = 365) -> DataFrame:
    """(by, start, end): spans in which rows may change after arrivals, merged where they touch."""
    spans = arrivals.select(*by, F.col(time).alias("start"), (F.col(time) + F.expr(f"INTERVAL {days} DAYS")).alias("end"))
    return merged_intervals(spans, by, "start", "end")


def with_history(rows: DataFrame, windows: DataFrame, by: list[str], time: str, days: int = 365) -> DataFrame:
    """The rows needed to recompute the windows: theirs and those of `days` before; `touched` marks theirs."""
    w = windows.select(*by, "start", "end")
    joined = rows.withColumn("_row", F.monotonically_increasing_id()).join(w, by).filter((F.col(time) >= F.col("start") - F.expr(f"INTERVAL {days} DAYS")) & (F.col(time) <= F.col("end")))
    marked = joined.withColumn("touched", F.col(time) >= F.col("start")).drop("start", "end")
    # a row that several windows need comes once; equal rows stay apart
    return marked.groupBy("_row", *rows.columns).agg(F.max("touched").alias("touched")).drop("_row")


def changed(before: DataFrame, after: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Rows of `after` that are new or differ from `before` in `columns`."""
    old = before.select(*keys, F.struct(*columns).alias("_old"))
    return after.join(old, keys, "left").filter(~F.struct(*columns).eqNullSafe(F.col("_old"))).drop("_old")


def run_batches(stream: DataFrame, checkpoint: str, ledger: str, step: Callable[[DataFrame, int], None]) -> StreamingQuery:
    """Runs `step` once for each micro-batch of what is there now. A batch already in the ledger is skipped,
    so a restart after a failure between the step and the commit does not repeat it."""
    spark = stream.sparkSession

    def batch(df: DataFrame, number: int) -> None:
        done = _read_ledger(spark, ledger).filter(F.col("batch") == number)
        if not done.isEmpty():
            return
        step(df, number)
        spark.createDataFrame([(number,)], "batch long").write.mode("append").parquet(ledger)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _read_ledger(spark: SparkSession, path: str) -> DataFrame:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target):
        return spark.createDataFrame([], "batch long")
    return spark.read.schema("batch long").parquet(path)


def watermarked(events: DataFrame, time: str, late: str, window: str, by: list[str], slide: str | None = None) -> DataFrame:
    """An extension: counts and sums of `value` by event-time window, late rows dropped after `late`."""
    w = F.window(time, window, slide) if slide else F.window(time, window)
    return events.withWatermark(time, late).groupBy(w.alias("w"), *by).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *by, "n", "total")


def sessions(events: DataFrame, time: str, late: str, gap: str, by: list[str]) -> DataFrame:
    """An extension: counts by session, which ends after `gap` without an event."""
    return events.withWatermark(time, late).groupBy(F.session_window(time, gap).alias("w"), *by).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *by, "n")
