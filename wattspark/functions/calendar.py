"""Period keys, all in UTC. Week keys use the ISO year, the others the calendar year."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PERIODS = {"year": "year", "month": "year_month", "week": "year_week", "quarter": "year_quarter"}


def iso_year(t: Column) -> Column:
    return F.year(F.date_add(F.date_trunc("week", t).cast("date"), 3))


def period_key(t: Column, period: str) -> Column:
    """YYYY, YYYYMM, ISO YYYYWW, YYYYQ, or the day itself for `date`."""
    if period == "date":
        return F.to_date(t)
    if period == "year":
        return F.year(t)
    if period == "month":
        return F.year(t) * 100 + F.month(t)
    if period == "week":
        return iso_year(t) * 100 + F.weekofyear(t)
    if period == "quarter":
        return F.year(t) * 10 + F.quarter(t)
    raise ValueError(f"unknown period {period}")


def with_period_keys(df: DataFrame, column: str) -> DataFrame:
    t = F.col(column)
    return df.withColumns(
        {
            "year": F.year(t),
            "month": F.month(t),
            "week": F.weekofyear(t),
            "year_quarter": period_key(t, "quarter"),
            "year_month": period_key(t, "month"),
            "year_week": period_key(t, "week"),
        }
    )


def period_start(key: Column, period: str) -> Column:
    """The first day of a period key."""
    if period == "year":
        return F.make_date(key, F.lit(1), F.lit(1))
    if period == "month":
        return F.make_date((key / 100).cast("int"), key % 100, F.lit(1))
    if period == "quarter":
        return F.make_date((key / 10).cast("int"), (key % 10 - 1) * 3 + 1, F.lit(1))
    if period == "week":
        fourth = F.make_date((key / 100).cast("int"), F.lit(1), F.lit(4))  # always in week 1
        return F.date_add(F.date_trunc("week", fourth).cast("date"), (key % 100 - 1) * 7)
    raise ValueError(f"unknown period {period}")


def period_end(start: Column, period: str) -> Column:
    """The day after a period that begins on `start`."""
    months = {"month": 1, "quarter": 3, "year": 12}
    return F.date_add(start, 7) if period == "week" else F.add_months(start, months[period])


def week_of_plan(anchor: Column, number: Column) -> Column:
    """The Monday of week `number` (from 1) of a plan whose first week holds `anchor`."""
    return F.date_add(F.date_trunc("week", anchor).cast("date"), (number - 1) * 7)


#: Seconds between the Unix epoch and that of FIT files.
FIT_EPOCH = 631065600


def from_fit_seconds(x: Column) -> Column:
    return F.timestamp_seconds(x + FIT_EPOCH)
