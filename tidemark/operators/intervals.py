"""Interval predicates as equi-joins and prefix scans."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from .asof import prefix_max


def overlaps_any(left: DataFrame, right: DataFrame, keys: Sequence[str], l_start: str, l_end: str,
                 r_start: str, r_end: str, bucket, out: str = "overlaps") -> DataFrame:
    """Flag left intervals that overlap at least one right interval (closed ends).

    An overlap exists exactly when the greatest right end among right starts <= l_end reaches l_start.
    """
    got = prefix_max(left, right, keys, l_end, r_start, F.col(r_end), "_me", bucket)
    return got.withColumn(out, F.coalesce(F.col("_me") >= F.col(l_start), F.lit(False))).drop("_me")


def overlap_join(left: DataFrame, right: DataFrame, keys: Sequence[str], l_start: str, l_end: str,
                 r_start: str, r_end: str, width: int) -> DataFrame:
    """All overlapping half-open integer intervals of the same keys.

    Each side is exploded over the fixed-width buckets it touches; the pair is kept in the one bucket
    that contains the later start, so no pair appears twice.
    """
    def spread(df, s, e, name):
        return df.withColumn(name, F.explode(F.sequence(F.floor(F.col(s) / width),
                                                        F.floor((F.greatest(F.col(e) - 1, F.col(s))) / width))))
    l, r = spread(left, l_start, l_end, "_b"), spread(right, r_start, r_end, "_b")
    j = l.join(r, [*keys, "_b"])
    return j.where((F.col(l_start) < F.col(r_end)) & (F.col(r_start) < F.col(l_end))
                   & (F.col("_b") == F.floor(F.greatest(F.col(l_start), F.col(r_start)) / width))).drop("_b")


def within_session(events: DataFrame, sessions: DataFrame, at: str, open_: str, close: str,
                   cols: Sequence[str]) -> DataFrame:
    """Attach the session whose [open, close] contains the instant; NULL when outside every session.

    Sessions are exploded over the UTC dates they touch (a session dimension has one row per exchange
    day, so the exploded side stays calendar-bounded and is broadcast).
    """
    s = sessions.select(F.explode(F.sequence(F.to_date(open_), F.to_date(close))).alias("_d"),
                        F.col(open_).alias("_o"), F.col(close).alias("_c"), *cols)
    cond = ((F.to_date(F.col(at)) == F.col("_d")) & (F.col(at) >= F.col("_o")) & (F.col(at) <= F.col("_c")))
    return events.join(F.broadcast(s), cond, "left").drop("_d", "_o", "_c")


def chronology_violations(sessions: DataFrame, open_: str, close: str) -> DataFrame:
    """Sessions that are inverted or that start before the previous one has closed."""
    w = W.partitionBy(F.lit(0)).orderBy(open_, close)
    return sessions.withColumn("_n", F.lead(open_).over(w)).where(
        (F.col(open_) >= F.col(close)) | (F.col("_n") <= F.col(close))).drop("_n")


def span_checks(spans: DataFrame, keys: Sequence[str], start: str, end: str) -> DataFrame:
    """Per span, overlap with the previous span and size of the gap before it.

    The window covers one document's spans, which come from one input row.
    """
    w = W.partitionBy(*keys).orderBy(start, end)
    prev = F.lag(end).over(w)
    return spans.withColumn("overlap", F.coalesce(prev > F.col(start), F.lit(False))).withColumn(
        "gap", F.greatest(F.col(start) - F.coalesce(prev, F.lit(0)), F.lit(0)))


def contained(inner_start: Column, inner_end: Column, outer_start: Column, outer_end: Column) -> Column:
    """J34/P14 containment predicate."""
    return (outer_start <= inner_start) & (inner_end <= outer_end)
