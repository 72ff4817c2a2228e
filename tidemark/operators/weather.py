"""Weather features, regional weights, lagged indices and rule positions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Production shares of the four sampling regions.
REGION_WEIGHTS = {"Iowa": 0.30, "Illinois": 0.30, "Minnesota": 0.20, "Indiana": 0.20}
HEAT_C, COLD_C, DRY_MM = 35.0, 15.0, 30.0
MISSING = -999.0


def clean(d: DataFrame, cols: Sequence[str]) -> DataFrame:
    """-999 marks a missing reading."""
    return d.withColumns({c: F.when(F.col(c) != MISSING, F.col(c)) for c in cols})


def stress(d: DataFrame) -> DataFrame:
    """M7: flags and one-sided z parts; needs temp_max, temp_min, rain_7d and the three z columns."""
    return d.withColumns({
        "heat_stress": (F.col("temp_max") > HEAT_C).cast("int"), "cold_stress": (F.col("temp_min") < COLD_C).cast("int"),
        "dry_stress": (F.col("rain_7d") < DRY_MM).cast("int"), "heat_stress_z": F.greatest("temp_max_z", F.lit(0.0)),
        "cold_stress_z": F.abs(F.least("temp_min_z", F.lit(0.0))), "dry_stress_z": F.abs(F.least("precipitation_z", F.lit(0.0)))})


def region_weighted(d: DataFrame, weights: DataFrame, keys: Sequence[str], region: str, values: Sequence[str], renormalize: bool) -> DataFrame:
    """Weighted regional sums; missing regions either count as zero or their weight is redistributed."""
    j = d.join(F.broadcast(weights), region)
    def one(v):
        total = F.sum(F.col("weight") * F.col(v))
        return F.try_divide(total, F.sum(F.when(F.col(v).isNotNull(), F.col("weight")))) if renormalize else F.coalesce(total, F.lit(0.0))
    return j.groupBy(*keys).agg(*[one(v).alias(f"{v}_agg") for v in values])


def extras(d: DataFrame) -> DataFrame:
    """M9: cloud fraction and humid mild day flag."""
    return d.withColumns({"cloud": 1 - F.try_divide(F.col("solar_radiation"), F.col("clear_sky_solar")),
                          "disease": ((F.col("relative_humidity") > 85) & F.col("temp_avg").between(18, 30)).cast("double")})


def lagged_index(days: DataFrame, index: DataFrame, day: str, month: str, value: str, lag_months: int = 2) -> DataFrame:
    """Index value usable from `lag_months` after its centre month; monthly, so an equi-join on the month."""
    ready = index.select(F.trunc(F.add_months(month, lag_months), "month").alias("_m"), F.col(value))
    return days.withColumn("_m", F.trunc(day, "month")).join(F.broadcast(ready), "_m", "left").drop("_m")


def rule_position(d: DataFrame, signal: Column, in_season: Column, blocked: Column, minimum: float, size: float, cap: float) -> DataFrame:
    """M8: fixed-size position in the signal's direction when strong, in season and not filtered."""
    raw = F.when(F.coalesce(in_season & ~blocked & (F.abs(signal) >= minimum), F.lit(False)), F.signum(signal) * size).otherwise(F.lit(0.0))
    return d.withColumn("target", F.least(F.greatest(raw, F.lit(-cap)), F.lit(cap)))
