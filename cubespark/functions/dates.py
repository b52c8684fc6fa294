"""Dates, hours and seasonal days."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def split_day_hour(df: DataFrame, ts: str = "ts") -> DataFrame:
    """Timestamp -> date, hour."""
    return df.withColumn("date", F.to_date(ts)).withColumn("hour", F.hour(ts)).drop(ts)


def stack_time(df: DataFrame, date: str = "date", hour: str = "hour", ts: str = "ts") -> DataFrame:
    """Date, hour -> timestamp; both columns must exist."""
    if missing := [c for c in (date, hour) if c not in df.columns]:
        raise ValueError(f"no such columns: {missing}")
    at = F.col(date).cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.col(hour))
    return df.withColumn(ts, at).drop(date, hour)


def msc_to_date(doy: Column, year: int = 2000) -> Column:
    """A seasonal day (1..366) as a date of a leap year."""
    return F.date_add(F.lit(f"{year}-01-01").cast("date"), doy - 1)


def context_to_date(time: Column, offset: Column) -> Column:
    """The date of a context offset (0 is the target day itself)."""
    return F.date_add(time, offset)


def inclusive_days(a: Column, b: Column) -> Column:
    return F.datediff(b, a) + 1


def leap_years(first: Column, last: Column) -> Column:
    """How many years from first to last divide by four."""
    return (F.floor(last / 4) - F.floor((first - 1) / 4)).cast("int")


def time_slice(df: DataFrame, start: str | None = None, end: str | None = None, date: str = "date") -> DataFrame:
    """both ends included; a year stands for all its days; None leaves an end open."""
    full = lambda x, tail: f"{x}{tail}" if len(x) == 4 else x
    if start is not None:
        df = df.filter(F.col(date) >= F.lit(full(start, "-01-01")).cast("date"))
    if end is not None:
        df = df.filter(F.col(date) <= F.lit(full(end, "-12-31")).cast("date"))
    return df
