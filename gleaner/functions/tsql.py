"""T-SQL date functions as column expressions.

T-SQL's DATEDIFF counts the unit boundaries crossed between two dates, Spark's
`timestampdiff` counts whole elapsed units; only the former is given here.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def eomonth(day: Column, months: int = 0) -> Column:
    return F.last_day(F.add_months(day, months) if months else day)


# Seconds of the units below a day.
SECONDS = {"hour": 3600, "minute": 60, "second": 1}


def dateadd(unit: str, number: int, day: Column) -> Column:
    if unit in SECONDS:
        return F.timestamp_add(unit, F.lit(number), day)
    if unit == "day":
        return F.date_add(day, number)
    if unit == "week":
        return F.date_add(day, 7 * number)
    months = {"month": 1, "quarter": 3, "year": 12}[unit]
    return F.add_months(day, months * number)


def datediff(unit: str, start: Column, end: Column) -> Column:
    if unit == "day":
        return F.datediff(end, start)
    if unit == "week":
        # Weeks begin on Sunday; 1899-12-31 was one.
        weeks = [F.floor(F.datediff(day, F.to_date(F.lit("1899-12-31"))) / 7) for day in (start, end)]
        return weeks[1] - weeks[0]
    if unit in SECONDS:
        began = [F.floor(F.unix_timestamp(at.cast("timestamp")) / SECONDS[unit]) for at in (start, end)]
        return began[1] - began[0]
    years = F.year(end) - F.year(start)
    if unit == "year":
        return years
    part = {"quarter": F.quarter, "month": F.month}[unit]
    return years * {"quarter": 4, "month": 12}[unit] + part(end) - part(start)


def datefromparts(year: Column, month: Column, day: Column) -> Column:
    return F.make_date(year, month, day)


def isnull(value: Column, default: Column) -> Column:
    return F.coalesce(value, default)
