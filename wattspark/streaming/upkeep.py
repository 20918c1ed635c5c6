"""Batches, sweeps and progress figures around the import jobs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

FINISHED = ("completed", "failed")
JOB_HOURS = 168
SWEEP_ROWS = 500


def micro_batches(rows: DataFrame, by: tuple[str, ...] = ("uid", "import_job_id"), size: int = 100, key: str = "id") -> DataFrame:
    """Rows with the number of their batch: `size` rows a batch in the order of `key`, no batch over two users or jobs."""
    place = F.row_number().over(Window.partitionBy(*by).orderBy(key)) - 1
    return rows.withColumn("batch", F.floor(place / size))


def doomed_jobs(jobs: DataFrame, now: Column, hours: int = JOB_HOURS, limit: int = SWEEP_ROWS) -> DataFrame:
    """The `limit` oldest finished jobs untouched for `hours`, of equals the smallest id: what one sweep deletes."""
    old = jobs.filter(F.col("status").isin(*FINISHED) & (F.col("updated_at") < now - F.make_dt_interval(hours=F.lit(hours))))
    return old.orderBy("updated_at", "id").limit(limit)


def due_accounts(users: DataFrame, now: Column, limit: int = SWEEP_ROWS) -> DataFrame:
    """The `limit` accounts longest due for deletion."""
    due = users.filter((F.col("account_status") == "pending_deletion") & (F.col("deletion_scheduled_for") <= now))
    return due.orderBy("deletion_scheduled_for", "id").limit(limit)


def swept(rows: DataFrame, doomed: DataFrame, key: str = "id") -> DataFrame:
    """What a sweep leaves."""
    return rows.join(doomed.select(key), key, "left_anti")


def observed(rows: DataFrame, phase: str, **measures: Column) -> tuple[DataFrame, Observation]:
    """Rows whose number and `measures` are counted while an action runs, without a pass of its own; `.get` has them after it."""
    seen = Observation(phase)
    return rows.observe(seen, F.count(F.lit(1)).alias("rows"), *[m.alias(n) for n, m in measures.items()]), seen
