"""Quantiles of earlier rows against SQL windows, and how their work is dealt."""

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from wattspark.operators import windows

FRAME = "(PARTITION BY uid ORDER BY start_time RANGE BETWEEN INTERVAL '365 00:00:00' DAY TO SECOND PRECEDING AND INTERVAL '0 00:00:00.000001' DAY TO SECOND PRECEDING)"


def rows(spark):
    r = random.Random(3)
    found = []
    for i in range(600):
        at = datetime(2019, 1, 1) + timedelta(days=r.randrange(1500), seconds=r.choice([0, 0, 1, 86399]))
        found.append((i, r.choice([1, 2, None]), at if i % 17 else None, r.choice([None, float(r.randrange(9)), r.random()])))
    return spark.createDataFrame(found, "id long, uid long, start_time timestamp_ntz, avg_power double")


def values(df):
    return {x.id: (x.uid, x.start_time, x.avg_power, None if x.earlier is None else round(x.earlier, 9), x.earlier_n) for x in df.collect()}


def test_earlier_quantiles_are_those_of_a_window(spark):
    t = rows(spark)
    want = t.withColumn("earlier", F.expr(f"percentile(avg_power, 0.95) OVER {FRAME}")).withColumn("earlier_n", F.expr(f"count(avg_power) OVER {FRAME}"))
    got = windows.earlier_quantile(t, "avg_power")
    assert got.columns == want.columns
    assert values(got) == values(want)


def test_a_users_history_is_more_than_one_task(spark):
    plan = windows.earlier_quantile(rows(spark), "avg_power")._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "_slice" in plan
