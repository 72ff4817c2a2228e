"""Reported facts with two clocks: the period they describe and the time they became known (V6).

A fact is (keys, period start, period end, unit, value, known_at). A later fact of the same keys, period and unit restates the earlier one; of
several known at once the greatest value counts, so results do not depend on row order. Facts of other units or exact periods never meet.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

PERIOD = ("period_start", "period_end", "unit")


def versions(facts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per value a fact ever had: value, known_from (included), known_to (excluded, null while it holds).

    A restatement to the same value is no new version. Versions of one fact are few; rows known at the same time are merged before the window.
    """
    own = [*keys, *PERIOD]
    once = facts.where("value IS NOT NULL AND known_at IS NOT NULL").groupBy(*own, "known_at").agg(F.max("value").alias("value"))
    w = W.partitionBy(*own).orderBy("known_at")
    changed = once.withColumn("_last", F.lag("value").over(w)).where("_last IS NULL OR _last <> value").drop("_last")
    return changed.select(*own, "value", F.col("known_at").alias("known_from"), F.lead("known_at").over(w).alias("known_to"))


def views(facts: DataFrame, keys: Sequence[str], as_of: Column) -> DataFrame:
    """As known on `as_of`, beside the latest: known_value, known_at, latest_value, latest_at, and the number of times it was reported.

    One partial aggregation, no window; a fact that nobody knew on `as_of` has null there.
    """
    f = facts.where("value IS NOT NULL AND known_at IS NOT NULL")
    when = F.struct("known_at", "value")
    g = f.groupBy(*keys, *PERIOD).agg(F.max(F.when(F.col("known_at") <= as_of, when)).alias("k"), F.max(when).alias("l"), F.count("*").alias("reports"))
    return g.select(*keys, *PERIOD, F.col("k.value").alias("known_value"), F.col("k.known_at").alias("known_at"), F.col("l.value").alias("latest_value"), F.col("l.known_at").alias("latest_at"), "reports",
                    F.coalesce(F.col("k.value") != F.col("l.value"), F.lit(False)).alias("restated_since"))


def quarters(facts: DataFrame, keys: Sequence[str], value: str = "value") -> DataFrame:
    """Single quarters from year-to-date durations: each less the one before it that starts on the same day.

    (keys, unit, period_start, period_end, value, status): 'reported' for the first duration of a year, 'derived' for a difference over about one
    quarter, 'derived_long' where a duration in between is missing and the difference covers more.
    """
    w = W.partitionBy(*keys, "unit", "period_start").orderBy("period_end")
    d = facts.select(*keys, *PERIOD, F.col(value).alias("_v")).where("_v IS NOT NULL")
    d = d.withColumn("_pe", F.lag("period_end").over(w)).withColumn("_pv", F.lag("_v").over(w))
    start = F.coalesce(F.date_add("_pe", 1), F.col("period_start"))
    days = F.datediff("period_end", start) + 1
    status = F.when(F.col("_pe").isNull(), F.when(days <= 100, "reported").otherwise("year_to_date")).when(days <= 100, "derived").otherwise("derived_long")
    return d.select(*keys, "unit", start.alias("period_start"), "period_end", (F.col("_v") - F.coalesce("_pv", F.lit(0))).alias("value"), status.alias("status"))


def segment_bridge(facts: DataFrame, keys: Sequence[str], segment: str, total: str, tolerance: float) -> DataFrame:
    """Segments with their corporate items and eliminations against the consolidated amount (`segment` = `total`) of the same period and unit.

    (keys, period, segments, segment_sum, consolidated, residual, status): reconciled, unresolved, or not_disclosed where one side is missing.
    """
    whole = F.col(segment) == total
    g = facts.groupBy(*keys, *PERIOD).agg(F.count_if(~whole).alias("segments"), F.sum(F.when(~whole, F.col("value"))).alias("segment_sum"), F.max(F.when(whole, F.col("value"))).alias("consolidated"))
    r = g.withColumn("residual", F.col("consolidated") - F.col("segment_sum"))
    return r.withColumn("status", F.when(F.col("residual").isNull(), "not_disclosed").when(F.abs("residual") <= tolerance, "reconciled").otherwise("unresolved"))
