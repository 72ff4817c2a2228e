"""Tests on series and forecasts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from ..functions import stats
from ..staging import stage
from .quantiles import exact_quantiles
from .skew import key_lookup


def moments(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """n, per-period Sharpe, skewness and raw kurtosis (population moments)."""
    v = F.col(value)
    g = df.groupBy(*keys).agg(F.count(v).alias("n"), F.avg(v).alias("m1"), F.avg(v * v).alias("m2"), F.avg(v * v * v).alias("m3"),
                              F.avg(v * v * v * v).alias("m4"))
    m, var = F.col("m1"), F.col("m2") - F.col("m1") * F.col("m1")
    third = F.col("m3") - 3 * m * F.col("m2") + 2 * m * m * m
    fourth = F.col("m4") - 4 * m * F.col("m3") + 6 * m * m * F.col("m2") - 3 * m * m * m * m
    return g.select(*keys, "n", (m / F.sqrt(var * F.col("n") / (F.col("n") - 1))).alias("sr"),
                    (third / F.pow(var, F.lit(1.5))).alias("skew"), (fourth / (var * var)).alias("kurt"))


def psr_dsr(mom: DataFrame, trials: int = 47) -> DataFrame:
    """R8, R9."""
    star = stats.expected_max_sharpe(F.col("n"), trials)
    m = mom.withColumn("sr_star", star)
    p = lambda b: stats.psr(F.col("sr"), F.col("n"), F.col("skew"), F.col("kurt"), b)
    return m.withColumn("psr", p(F.lit(0.0))).withColumn("dsr", p(F.col("sr_star")))


def binomial_p(counts: DataFrame, keys: Sequence[str], k: str, n: str) -> DataFrame:
    """Two-sided exact binomial p against one half, in the row.

    Against one half the outcomes no likelier than k are both tails from the nearer one, m = min(k, n - k): twice the lower tail, or 1 in the
    middle. The tail is the probability of m, by log-gamma, times a sum of falling ratios that ends after some 45 standard deviations.
    """
    m, size = F.least(F.col(k), F.col(n) - F.col(k)), F.col(n)
    log_pmf = stats.log_gamma(size + 1) - stats.log_gamma(m + 1) - stats.log_gamma(size - m + 1) - size * F.log(F.lit(2.0))
    steps = F.least(m, F.ceil(F.sqrt(size) * 45) + 1).cast("int")
    start = F.struct(F.lit(1.0).alias("t"), F.lit(1.0).alias("s"))

    def fall(acc, i):
        t = acc["t"] * (m - i + 1) / (size - m + i)
        return F.struct(t.alias("t"), (acc["s"] + t).alias("s"))
    ratios = F.when(steps < 1, F.lit(1.0)).otherwise(F.aggregate(F.sequence(F.lit(1), F.greatest(steps, F.lit(1))), start, fall, lambda x: x["s"]))
    p = F.when(2 * m == size, F.lit(1.0)).otherwise(F.least(2 * F.exp(log_pmf) * ratios, F.lit(1.0)))
    return counts.select(*keys, k, n, p.alias("p_value"))


def ranks(d: DataFrame, keys: Sequence[str], value: str, name: str, pieces: int = 64) -> DataFrame:
    """Average ranks of the values of each key: (keys, value, name), a row per distinct value.

    Values are counted first. Rows are dealt to ranges of the value (edges from a mergeable sketch of all keys together), counted and ranked
    inside (key, range), and each range starts at the sum of the ranges before it, so a key with most of the rows is spread over all ranges.
    """
    cnt = d.groupBy(*keys, value).agg(F.count("*").alias("_n"))
    edges = d.agg(F.percentile_approx(value, F.array(*[F.lit(i / pieces) for i in range(1, pieces)]), 1000).alias("e")).select(F.array_distinct("e").alias("e"))
    cnt = cnt.withColumn("_e", edges.scalar()).withColumn("_piece", F.size(F.filter("_e", lambda e: e < F.col(value)))).drop("_e")
    cnt = stage(cnt, "ranks")   # read twice
    sums = cnt.groupBy(*keys, "_piece").agg(F.sum("_n").alias("_s"))   # `pieces` rows a key at most
    before = sums.withColumn("_before", F.sum("_s").over(W.partitionBy(*keys).orderBy("_piece")) - F.col("_s")).drop("_s")
    w = W.partitionBy(*keys, "_piece").orderBy(value).rowsBetween(W.unboundedPreceding, -1)
    inside = cnt.withColumn("_in", F.coalesce(F.sum("_n").over(w), F.lit(0)))
    return inside.join(before, [*keys, "_piece"]).select(*keys, value, (F.col("_before") + F.col("_in") + (F.col("_n") + 1) / 2).alias(name))


def spearman(df: DataFrame, keys: Sequence[str], a: str, b: str) -> DataFrame:
    """Rank correlation with average ranks.

    Ranks come from value counts in ranges of the value, so ties are reduced and no window holds a whole key.
    """
    d = df.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    r = d.join(ranks(d, keys, a, "_ra"), [*keys, a]).join(ranks(d, keys, b, "_rb"), [*keys, b])
    hit = F.avg((F.signum(a) == F.signum(b)).cast("int"))
    return r.groupBy(*keys).agg(F.count("*").alias("n"), F.corr("_ra", "_rb").alias("spearman"), hit.alias("hit_rate"))


def quantile_buckets(df: DataFrame, keys: Sequence[str], by: str, bins: int = 10) -> DataFrame:
    """Bucket number (1..bins) from exact quantile edges, right-closed like the usual qcut."""
    probs = {f"_q{i}": i / bins for i in range(1, bins)}
    edges = exact_quantiles(df, keys, by, probs)
    j = key_lookup(df, edges, keys)
    return j.withColumn("bucket", 1 + sum((F.col(by) > F.col(c)).cast("int") for c in probs)).drop(*probs)


def reconcile(saved: DataFrame, computed: DataFrame, keys: Sequence[str], value: str, tolerance: float) -> DataFrame:
    """Saved against recomputed values; one side missing never matches."""
    a = saved.select(*keys, F.col(value).alias("saved"))
    b = computed.select(*keys, F.col(value).alias("recomputed"))
    j = a.join(b, list(keys), "full_outer")
    return j.withColumn("matches", F.coalesce(F.abs(F.col("saved") - F.col("recomputed")) <= tolerance, F.lit(False)))


def centred_p(reps: DataFrame, keys: Sequence[str], stat: str, observed: DataFrame) -> DataFrame:
    """Share of recentred replicates that reach the observed value."""
    j = reps.where(F.col(stat).isNotNull()).join(observed, list(keys))
    return j.groupBy(*keys).agg(F.avg((F.col(stat) >= F.col("observed")).cast("int")).alias("p_value"))
