"""As-of joins without theta joins.

Two shapes cover every case:

* ``asof_daily``   bars already reduced to one row per (key, day); a key's window then holds at most one
                   row per calendar day per side, whatever the raw volume of the key.
* ``prefix_max``   arbitrary event times. Rows are windowed inside (key, time bucket) and each bucket
                   receives the running maximum of all earlier buckets, so a key holding a large share
                   of the data is spread over its buckets instead of one task.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F


def asof_daily(probes: DataFrame, bars: DataFrame, key: str, probe_day: str, bar_day: str,
               cols: Sequence[str]) -> DataFrame:
    """Latest bar on or before each distinct (key, probe_day).

    Returns key, probe_day, mark_day and `cols` of that bar (NULL when the key never traded before).
    """
    payload = F.struct(F.col(bar_day).alias("d"), *[F.col(c) for c in cols])
    b = bars.select(F.col(key).alias("k"), F.col(bar_day).alias("t"), F.lit(0).alias("probe"), payload.alias("p"))
    p = (probes.select(F.col(key).alias("k"), F.col(probe_day).alias("t")).distinct()
         .select("k", "t", F.lit(1).alias("probe"), F.lit(None).cast(b.schema["p"].dataType).alias("p")))
    w = W.partitionBy("k").orderBy("t", "probe").rowsBetween(W.unboundedPreceding, 0)
    return (b.unionByName(p).withColumn("m", F.last("p", True).over(w)).where("probe = 1")
            .select(F.col("k").alias(key), F.col("t").alias(probe_day), F.col("m.d").alias("mark_day"),
                    *[F.col(f"m.{c}").alias(c) for c in cols]))


def stale_mark(value: str, mark_ord: str, day_ord: str, limit: int = 3) -> Column:
    """Keep the value only when its bar is at most `limit` sessions old."""
    return F.when(F.col(day_ord) - F.col(mark_ord) <= limit, F.col(value))


def epoch_bucket(seconds: int) -> Callable[[Column], Column]:
    return lambda t: F.floor(F.unix_micros(t.cast("timestamp")) / F.lit(seconds * 1_000_000))


def prefix_max(left: DataFrame, right: DataFrame, keys: Sequence[str], left_time: str, right_time: str,
               value: Column, out: str, bucket: Callable[[Column], Column], strict: bool = False) -> DataFrame:
    """For each left row, the maximum of `value` over right rows of the same keys that are not later.

    With ``value = struct(time, payload…)`` this is a backward as-of join. `strict` excludes equal times.
    """
    right = right.select(*keys, F.col(right_time).alias("_t"), value.alias("_v"))
    vtype = right.schema["_v"].dataType
    lrow = F.struct(*[F.col(c) for c in left.columns])
    r_first, l_side = (0, 1) if not strict else (1, 0)
    l = left.select(*keys, F.col(left_time).alias("_t"), F.lit(l_side).alias("_side"), lrow.alias("_l"),
                    F.lit(None).cast(vtype).alias("_v"))
    r = right.select(*keys, "_t", F.lit(r_first).alias("_side"),
                     F.lit(None).cast(l.schema["_l"].dataType).alias("_l"), "_v")
    both = l.unionByName(r).withColumn("_b", bucket(F.col("_t")))
    inside = W.partitionBy(*keys, "_b").orderBy("_t", "_side").rowsBetween(W.unboundedPreceding, 0)
    scanned = both.withColumn("_in", F.max("_v").over(inside)).where(F.col("_l").isNotNull())
    per_bucket = both.groupBy(*keys, "_b").agg(F.max("_v").alias("_bv"))
    earlier = W.partitionBy(*keys).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    carry = per_bucket.select(*keys, "_b", F.max("_bv").over(earlier).alias("_carry"))
    joined = scanned.join(carry, [*keys, "_b"], "left")
    return joined.select("_l.*", F.greatest("_in", "_carry").alias(out))


def running_total(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, out: str,
                  bucket: Column) -> DataFrame:
    """Inclusive running sum over `order` per key, computed bucket by bucket with a carried prefix.

    `bucket` must be monotone in the leading order column.
    """
    b = df.withColumn("_b", bucket)
    per_bucket = b.groupBy(*keys, "_b").agg(F.sum(value).alias("_s"))
    earlier = W.partitionBy(*keys).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    carry = per_bucket.select(*keys, "_b", F.coalesce(F.sum("_s").over(earlier), F.lit(0)).alias("_c"))
    inside = W.partitionBy(*keys, "_b").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    return (b.withColumn("_r", F.sum(value).over(inside)).join(carry, [*keys, "_b"])
            .withColumn(out, F.col("_r") + F.col("_c")).drop("_b", "_r", "_c"))
