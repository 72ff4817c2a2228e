"""Exact quantiles of large groups.

Spark's exact ``percentile`` keeps every distinct value of a group in one aggregation buffer. Here an
approximate sketch (mergeable, bounded) brackets the wanted order statistics, rows below the bracket are
only counted, and the exact value is read from the value counts inside the bracket. `df` is read twice, so
callers pass a scan or a staged table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window as W
from pyspark.sql import functions as F

from .skew import key_lookup

_ACCURACY = 10_000
_SLACK = 4.0 / _ACCURACY


def exact_quantiles(df: DataFrame, keys: Sequence[str], value: str, probs: dict[str, float]) -> DataFrame:
    """Linear-interpolated quantiles per key; `probs` maps output column -> probability."""
    v = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("_v"))
    edges = []
    for p in probs.values():
        edges += [max(p - _SLACK, 0.0), min(p + _SLACK, 1.0)]
    sketch = v.groupBy(*keys).agg(F.count("_v").alias("_n"), F.min("_v").alias("_mn"), F.max("_v").alias("_mx"),
                                  F.percentile_approx("_v", F.array(*map(F.lit, edges)), _ACCURACY).alias("_e"))
    small = F.col("_n") <= _ACCURACY   # the slack is under one rank there; such a group is read whole
    brackets = F.inline(F.array(*[
        F.struct(F.lit(name).alias("_q"), F.lit(p).alias("_p"),
                 (F.col("_mn") if p <= _SLACK else F.when(small, F.col("_mn")).otherwise(F.col("_e")[2 * i])).alias("_lo"),
                 (F.col("_mx") if p >= 1 - _SLACK else F.when(small, F.col("_mx")).otherwise(F.col("_e")[2 * i + 1])).alias("_hi"))
        for i, (name, p) in enumerate(probs.items())]))
    group = [*keys, "_q"]
    # Values under the bracket collapse into one NULL entry per map task; NULL sorts first in the window.
    counts = (key_lookup(v, sketch, keys).select(*keys, "_v", "_n", brackets).where("_v <= _hi")
              .groupBy(*group, "_p", "_n", F.when(F.col("_v") >= F.col("_lo"), F.col("_v")).alias("_v"))
              .agg(F.count("*").alias("_cnt")))
    w = W.partitionBy(*group).orderBy(F.col("_v").asc_nulls_first()).rowsBetween(W.unboundedPreceding, 0)
    pos = F.col("_p") * (F.col("_n") - 1)
    ranked = counts.withColumn("_last", F.sum("_cnt").over(w) - 1).withColumn("_first", F.col("_last") - F.col("_cnt") + 1)
    pick = lambda at: F.max(F.when(at.between(F.col("_first"), F.col("_last")), F.col("_v")))
    got = ranked.groupBy(*group).agg(pick(F.floor(pos)).alias("_a"), pick(F.ceil(pos)).alias("_z"),
                                     F.max(pos - F.floor(pos)).alias("_w"))
    out = got.withColumn("_x", F.col("_a") + F.col("_w") * (F.col("_z") - F.col("_a")))
    return out.groupBy(*keys).agg(*[F.max(F.when(F.col("_q") == name, F.col("_x"))).alias(name) for name in probs])
