"""Exchange-session dimension: holiday rules, session ordinals and a dense day lookup.

The tables hold one row per calendar day of an explicit range (about 365 per year). They are built once as
local relations from the holiday rules, so broadcasting them is safe at any data volume.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from datetime import date, timedelta
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_DAY = timedelta(days=1)


def _nth_weekday(year: int, month: int, weekday: int, n: int) -> date:
    first = date(year, month, 1)
    return first + timedelta(days=(weekday - first.weekday()) % 7 + 7 * (n - 1))


def _good_friday(year: int) -> date:
    a, (b, c) = year % 19, divmod(year, 100)
    h = (19 * a + b - b // 4 - (b - (b + 8) // 25 + 1) // 3 + 15) % 30
    l = (32 + 2 * (b % 4) + 2 * (c // 4) - h - c % 4) % 7
    n = h + l - 7 * ((a + 11 * h + 22 * l) // 451) + 114
    return date(year, n // 31, n % 31 + 1) - 2 * _DAY


def _nearest(d: date) -> date:
    return d - _DAY if d.weekday() == 5 else d + _DAY if d.weekday() == 6 else d


def closures(year: int) -> set[date]:
    """full-day closures. New Year on a Saturday is not observed; Juneteenth starts in 2022."""
    new_year, last_may = date(year, 1, 1), date(year, 5, 31)
    out = {new_year + _DAY if new_year.weekday() == 6 else new_year,
           _nth_weekday(year, 1, 0, 3), _nth_weekday(year, 2, 0, 3), _good_friday(year),
           last_may - timedelta(days=last_may.weekday()), _nearest(date(year, 7, 4)),
           _nth_weekday(year, 9, 0, 1), _nth_weekday(year, 11, 3, 4), _nearest(date(year, 12, 25))}
    if year >= 2022:
        out.add(_nearest(date(year, 6, 19)))
    if year == 2025:
        out.add(date(2025, 1, 9))
    return out


@lru_cache(maxsize=16)
def _session_list(start: str, end: str) -> tuple[date, ...]:
    first, last = date.fromisoformat(start), date.fromisoformat(end)
    closed = set().union(*[closures(y) for y in range(first.year - 1, last.year + 2)])
    days = (first + timedelta(days=i) for i in range((last - first).days + 1))
    return tuple(d for d in days if d.weekday() < 5 and d not in closed)


def sessions(spark: SparkSession, start: str, end: str) -> DataFrame:
    """(session DATE, ord INT), ordinals from 0."""
    s = _session_list(start, end)
    return spark.createDataFrame(pa.table({"session": pa.array(s, pa.date32()), "ord": pa.array(range(len(s)), pa.int32())}))


def day_table(spark: SparkSession, start: str, end: str) -> DataFrame:
    """Dense day -> session lookup for J1-J4.

    Columns: day, prev_strict, prev_incl, next_incl, next_strict (dates), ord_incl (ordinal of the last
    session on or before the day).
    """
    return spark.createDataFrame(_day_arrow(start, end))


@lru_cache(maxsize=16)
def _day_arrow(start: str, end: str) -> pa.Table:
    s = _session_list(start, end)
    first, last = date.fromisoformat(start), date.fromisoformat(end)
    days = [first + timedelta(days=i) for i in range((last - first).days + 1)]
    at = lambda i: s[i] if 0 <= i < len(s) else None
    left, right = [bisect_left(s, d) for d in days], [bisect_right(s, d) for d in days]
    dates = lambda idx: pa.array([at(i) for i in idx], pa.date32())
    return pa.table({
        "day": pa.array(days, pa.date32()),
        "prev_strict": dates(i - 1 for i in left), "prev_incl": dates(i - 1 for i in right),
        "next_incl": dates(left), "next_strict": dates(right),
        "ord_incl": pa.array([i - 1 if i else None for i in right], pa.int32())})


def align(df: DataFrame, day_col: str, days: DataFrame, out: dict[str, str]) -> DataFrame:
    """Attach session columns of the day lookup by equi-join; `out` maps lookup column -> new name."""
    look = days.select(F.col("day").alias("_day"), *[F.col(c).alias(n) for c, n in out.items()])
    return df.join(F.broadcast(look), F.col(day_col) == F.col("_day"), "left").drop("_day")


def sessions_between(ord_a: str, ord_b: str):
    """Sessions strictly after a, up to and including b, from last-on-or-before ordinals."""
    return F.col(ord_b) - F.col(ord_a)
