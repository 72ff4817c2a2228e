"""Boards over study results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import resample as rs
from .quantiles import exact_quantiles


def medians(df: DataFrame, keys: list[str], cols: list[str]) -> DataFrame:
    """Exact medians of several columns per key."""
    n = df.groupBy(*keys).agg(F.count("*").alias("n"))
    long = df.unpivot(keys, cols, "_name", "_x")
    q = exact_quantiles(long, [*keys, "_name"], "_x", {"_m": 0.5})
    return n.join(q.groupBy(*keys).pivot("_name", cols).agg(F.first("_m")), keys, "left")


def example_entity(summary: DataFrame) -> DataFrame:
    """Most priced events, ties by median volume then name."""
    m = medians(summary, ["ticker"], ["atm_volume"]).withColumnRenamed("atm_volume", "volume")
    return m.orderBy(F.desc("n"), F.desc("volume"), "ticker").limit(1)


def off_zero(lo: str = "ci_lo", hi: str = "ci_hi") -> Column:
    """An interval that leaves out zero; false where there is none."""
    return F.coalesce((F.col(lo) > 0) | (F.col(hi) < 0), F.lit(False))


def wide_board(board: DataFrame, horizons: list[str]) -> DataFrame:
    """Mean per horizon as text, starred when its bootstrap interval leaves out zero. `board` comes from `study.scoreboard`."""
    cell = F.concat(F.format_string("%.6f", "mean"), F.when(off_zero(), "*").otherwise(""))
    w = board.withColumn("cell", cell).groupBy("strategy").pivot("horizon", horizons).agg(F.first("cell"))
    return w.toDF("strategy", *[f"h_{h}" for h in horizons])


def difference(a: DataFrame, b: DataFrame, keys: list[str], values: list[str], row_id: Column, minimum: int = 5) -> DataFrame:
    """A3: mean of group a minus mean of group b with its bootstrap interval, on keys both have; values need `minimum` rows on each side.

    Both groups are wide (a column per strategy) and read twice.
    """
    own = [*keys, "strategy"]
    means = lambda df, x: (df.unpivot([F.col(k) for k in keys], values, "strategy", "pnl").groupBy(*own)
                           .agg(F.count("pnl").alias(f"n_{x}"), F.avg("pnl").alias(f"mean_{x}")).where(F.col(f"n_{x}") > 0))
    enough = (F.col("n_a") >= minimum) & (F.col("n_b") >= minimum)
    ci = rs.difference_intervals(a, b, keys, row_id, values).withColumnRenamed("name", "strategy")
    j = means(a, "a").join(means(b, "b"), own).join(ci, own, "left")
    return j.select(*own, "n_a", "n_b", *[F.when(enough, F.col(c)).alias(c) for c in ("mean_a", "mean_b")],
                    F.when(enough, F.col("mean_a") - F.col("mean_b")).alias("difference"), *[F.when(enough, F.col(c)).alias(c) for c in ("ci_lo", "ci_hi")])


def rank(diff: DataFrame, horizons: tuple = ("21", "42", "exp")) -> DataFrame:
    """A4: strategies by mean edge, with the number of horizons whose interval leaves out zero."""
    d = diff.where(F.col("horizon").isin(*horizons) & (F.col("strategy") != "stock"))
    return d.groupBy("strategy").agg(F.avg("difference").alias("edge"), F.count_if(off_zero()).alias("horizons_ci_excludes_0"), F.max("n_a").alias("n_events")).orderBy(F.desc("edge"))


def decay(results: DataFrame, row_id: Column) -> DataFrame:
    """A5: realized over implied per horizon, with the interval of its mean. `results` is read three times."""
    r = results.where("ratio IS NOT NULL")
    above = r.groupBy("horizon").agg(F.avg((F.col("ratio") > 1).cast("int")).alias("share_above_1"))
    ci = rs.bootstrap_ci(r, ["horizon"], row_id, "ratio").withColumnRenamed("mean", "mean_ratio")
    return ci.join(above, "horizon").join(exact_quantiles(r, ["horizon"], "ratio", {"median_ratio": 0.5}), "horizon")


def headline(results: DataFrame) -> DataFrame:
    """A39."""
    r = results.select(F.lit(1).alias("_all"), "implied_move", F.abs("realized").alias("realized"))
    share = r.groupBy("_all").agg(F.avg((F.col("realized") > F.col("implied_move")).cast("int")).alias("share_realized_above"))
    m = medians(r, ["_all"], ["implied_move", "realized"]).toDF("_all", "n", "median_implied", "median_realized")
    return share.join(m, "_all").drop("_all", "n")


def net_summary(long: DataFrame, plans: DataFrame) -> DataFrame:
    """Per strategy gross and net means; a row without a usable plan has no net value."""
    k = ["ticker", "event_date", "bucket", "strategy"]
    j = long.join(plans.select(*k, "round_trip_cost_per_contract"), k, "left")
    j = j.withColumn("net", F.col("pnl") - F.col("round_trip_cost_per_contract") / 100 / F.col("s_entry"))
    s = j.groupBy("strategy").agg(F.count("net").alias("n"), F.avg("pnl").alias("mean_gross"), F.avg("net").alias("mean_net"),
                                  F.avg((F.col("net") > 0).cast("int")).alias("share_net_positive"))
    return s.join(exact_quantiles(j, ["strategy"], "net", {"median_net": 0.5}), "strategy", "left")


def in_out(long: DataFrame, split: str) -> DataFrame:
    """Means before and from the split date with sign agreement."""
    early = F.col("event_date") < F.lit(split).cast("date")
    g = long.groupBy("strategy", "horizon").agg(F.avg(F.when(early, F.col("pnl"))).alias("in_mean"),
                                                F.avg(F.when(~early, F.col("pnl"))).alias("out_mean"))
    return g.withColumn("same_sign", F.signum("in_mean") == F.signum("out_mean"))


def pass_rules(row: DataFrame, rules: dict[str, str]) -> DataFrame:
    """Named boolean rules over an aggregate row, one output row per rule."""
    return row.select(F.inline(F.array(*[F.struct(F.lit(n).alias("rule"), F.expr(e).alias("passed")) for n, e in rules.items()])))
