"""Dates: Korean bucket days, ISO weeks, business days, spines."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

KST_HOURS = 9


def kst(ts: Column) -> Column:
    """The wall clock in Korea of a UTC instant without a zone; there is no daylight saving."""
    return ts + F.expr(f"INTERVAL {KST_HOURS} HOURS")


def starts(date: str, later: int = 0) -> Column:
    """The UTC instant at which a day, or one so many days later, begins in Korea."""
    at = dt.datetime.fromisoformat(date) + dt.timedelta(days=later, hours=-KST_HOURS)
    return F.lit(f"{at:%Y-%m-%d %H:%M:%S}").cast("timestamp_ntz")


def days_before(date: str, n: int) -> str:
    return (dt.date.fromisoformat(date) - dt.timedelta(n)).isoformat()


def day(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd")


def hour(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH")


def week(date: Column) -> Column:
    """Monday of the week of a date string, as a date string."""
    return F.date_format(F.date_trunc("WEEK", F.to_date(date)), "yyyy-MM-dd")


def add_days(date: Column, n: Column | int) -> Column:
    return F.date_format(F.date_add(F.to_date(date), n), "yyyy-MM-dd")


def valid_date(date: Column) -> Column:
    """Whether a string is a calendar day in its one canonical form."""
    return F.coalesce(F.date_format(F.try_to_timestamp(date, F.lit("yyyy-MM-dd")), "yyyy-MM-dd") == date, F.lit(False))


def spine(spark: SparkSession, first: str, last: str) -> DataFrame:
    """``date`` for every day from first to last."""
    return spark.sql(f"SELECT date_format(d, 'yyyy-MM-dd') AS date FROM (SELECT explode(sequence(DATE'{first}', DATE'{last}')) AS d)")


def rest_day(date: Column, holidays: Column | None = None) -> Column:
    """Saturday, Sunday, or one of an array of holidays."""
    weekend = F.dayofweek(F.to_date(date)).isin(1, 7)
    return weekend if holidays is None else weekend | F.array_contains(holidays, date)


def add_business_days(date: Column, n: int, holidays: Column | None = None) -> Column:
    """The n-th day after a date that is no rest day."""
    ahead = F.transform(F.sequence(F.lit(1), F.lit(7 * (n // 5 + 2) + 30)), lambda i: F.date_format(F.date_add(F.to_date(date), i), "yyyy-MM-dd"))
    return F.element_at(F.filter(ahead, lambda d: ~rest_day(d, holidays)), n)
