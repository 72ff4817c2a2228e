"""Daily-series operators.

A series holds one row per trading day, so every keyed window below is bounded by the calendar.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from ..constants import SESSIONS_PER_YEAR


def ratio(a: Column | str, b: Column | str) -> Column:
    """a / b by IEEE rules: over zero the quotient is infinite, or NaN for zero over zero; null only where a part is."""
    x, y = (F.col(c).cast("double") if isinstance(c, str) else c.cast("double") for c in (a, b))
    return F.when((y == 0) & x.isNotNull(), x * float("inf")).otherwise(F.try_divide(x, y))


def log_growth(ret: str) -> Column:
    """ln(1 + r): a loss of everything is minus infinity, a larger one has no logarithm (NaN), so that what it compounds to is not read as a return."""
    r = F.col(ret)
    return F.when(r < -1, F.lit(float("nan"))).when(r == -1, F.lit(float("-inf"))).otherwise(F.log1p(r))


def by(keys: Sequence[str], order: str):
    return W.partitionBy(*keys).orderBy(order)


def positions(d: DataFrame, keys: Sequence[str], day: str) -> DataFrame:
    """Previous position, price return, turnover and season flag from pos and close."""
    w = by(keys, day)
    prev = F.lag("pos").over(w)
    return (d.withColumn("pos_prev", F.coalesce(prev, F.lit(0.0)))
            .withColumn("px_ret", F.coalesce(F.try_divide(F.col("close"), F.lag("close").over(w)) - 1, F.lit(0.0)))
            .withColumn("traded", F.coalesce(F.abs(F.col("pos") - prev), F.abs(F.col("pos"))))
            .withColumn("in_season", F.month(day).isin(7, 8)))


def prepare(d: DataFrame, keys: Sequence[str], day: str) -> DataFrame:
    """W2 over a saved backtest: positions plus net P&L from daily_pnl and costs."""
    return positions(d, keys, day).withColumn("net_pnl", F.col("daily_pnl") - F.col("costs"))


def drawdown(d: DataFrame, keys: Sequence[str], day: str, value: str, base: Column | None = None) -> DataFrame:
    """Running peak and drawdown; `base` joins the peak when given."""
    peak = F.max(value).over(by(keys, day).rowsBetween(W.unboundedPreceding, 0))
    peak = F.greatest(peak, base) if base is not None else peak
    return d.withColumn("peak", peak).withColumn("drawdown", F.col(value) / F.col("peak") - 1)


def compound(d: DataFrame, keys: Sequence[str], day: str, ret: str) -> DataFrame:
    """Running product of 1 + r."""
    return d.withColumn("equity", F.exp(F.sum(log_growth(ret)).over(by(keys, day).rowsBetween(W.unboundedPreceding, 0))))


def episodes(d: DataFrame, keys: Sequence[str], day: str, pos: str, pnl: str) -> DataFrame:
    """Runs of one position sign as (keys, entry, exit, side, days_held, net_pnl)."""
    w = by(keys, day)
    s = d.withColumn("_sg", F.signum(pos))
    s = s.withColumn("_new", (F.coalesce(F.lag("_sg").over(w), F.lit(0.0)) != F.col("_sg")).cast("int"))
    s = s.withColumn("_run", F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    g = s.where("_sg <> 0").groupBy(*keys, "_run", "_sg").agg(F.min(day).alias("entry"), F.max(day).alias("exit"),
                                                              F.count("*").alias("days_held"), F.sum(pnl).alias("net_pnl"))
    return g.select(*keys, "entry", "exit", F.when(F.col("_sg") > 0, "long").otherwise("short").alias("side"), "days_held", "net_pnl")


def period_views(d: DataFrame, day: str, split: str) -> DataFrame:
    """Every row in "full" and in one of "in_sample" / "holdout"."""
    part = F.when(F.col(day) < F.lit(split).cast("date"), "in_sample").otherwise("holdout")
    return d.withColumn("period", F.explode(F.array(F.lit("full"), part)))


def performance(d: DataFrame, keys: Sequence[str], day: str, base: float, split: str) -> DataFrame:
    """Performance block per period; the holdout starts from the last in-sample value.

    Needs value, net_ret, net_pnl, costs, traded, pos.
    """
    v = period_views(d, day, split)
    pk = [*keys, "period"]
    start = d.where(F.col(day) < F.lit(split).cast("date")).groupBy(*keys).agg(F.max_by("value", day).alias("_hold"))
    v = v.join(start, list(keys), "left").withColumn(
        "_base", F.when(F.col("period") == "holdout", F.coalesce("_hold", F.lit(base))).otherwise(F.lit(base)))
    w = by(pk, day)
    v = v.withColumn("_before", F.coalesce(F.lag("value").over(w), F.col("_base")))
    v = drawdown(v, pk, day, "value", F.col("_base"))
    r = F.col("net_ret")
    g = v.groupBy(*pk).agg(
        F.count("*").alias("trading_days"), F.max_by("value", day).alias("_last"), F.first("_base").alias("_b"), F.avg(r).alias("_m"),
        F.stddev_samp(r).alias("_sd"), F.sqrt(F.avg(F.least(r, F.lit(0.0)) * F.least(r, F.lit(0.0)))).alias("_down"), F.min("drawdown").alias("max_drawdown"),
        F.sum("net_pnl").alias("net_pnl"), F.sum("traded").alias("_traded"), F.sum("costs").alias("costs"),
        F.sum(F.col("traded") * F.col("_before")).alias("_traded_usd"), F.count_if((F.col("traded") > 0) & (F.col("costs") == 0)).alias("uncharged_changes"),
        F.avg((F.col("pos") != 0).cast("int")).alias("time_in_market"))
    ep = episodes(v, pk, day, "pos", "net_pnl").groupBy(*pk).agg(
        F.count("*").alias("episodes"), F.avg((F.col("net_pnl") > 0).cast("int")).alias("win_rate"), F.avg("net_pnl").alias("avg_episode_pnl"),
        F.try_divide(F.sum(F.greatest("net_pnl", F.lit(0.0))), -F.sum(F.least("net_pnl", F.lit(0.0)))).alias("profit_factor"))
    j = g.join(ep, pk, "left")
    ann, years = F.sqrt(F.lit(float(SESSIONS_PER_YEAR))), F.col("trading_days") / SESSIONS_PER_YEAR
    growth = ratio("_last", "_b")
    cagr = F.pow(growth, 1 / years) - 1
    return j.select(*pk, "trading_days", (growth - 1).alias("total_return"), cagr.alias("cagr"), (F.col("_sd") * ann).alias("volatility"),
                    (ratio("_m", "_sd") * ann).alias("sharpe"), (ratio("_m", "_down") * ann).alias("sortino"),
                    "max_drawdown", ratio(cagr, F.abs("max_drawdown")).alias("calmar"), "episodes", "win_rate", "avg_episode_pnl", "profit_factor", "net_pnl",
                    (F.col("_traded") / years).alias("turnover"), "costs", (ratio("costs", "_traded_usd") * 1e4).alias("cost_bps"),
                    "uncharged_changes", (ratio(F.col("costs") / F.col("episodes"), F.col("_b")) * 1e4).alias("cost_per_episode_bps"), "time_in_market")


def monthly_returns(d: DataFrame, keys: Sequence[str], day: str, ret: str) -> DataFrame:
    """Compounded months, one row per year."""
    m = d.groupBy(*keys, F.year(day).alias("year"), F.month(day).alias("m")).agg((F.exp(F.sum(log_growth(ret))) - 1).alias("r"))
    return m.groupBy(*keys, "year").pivot("m", list(range(1, 13))).agg(F.first("r")).toDF(*keys, "year", *[f"m{i:02d}" for i in range(1, 13)])


def cost_audit(d: DataFrame, keys: Sequence[str], day: str, bps: float) -> DataFrame:
    """Charged rate, uncharged changes, missing cost and the first-order corrected Sharpe."""
    prev = F.lag("value").over(by(keys, day))
    v = d.withColumn("_pv", prev).withColumn("_ch", (F.col("traded") > 0) & (F.col("costs") > 0)).withColumn("_un", (F.col("traded") > 0) & (F.col("costs") == 0))
    v = v.withColumn("_bps", F.when(F.col("_ch"), F.try_divide(F.col("costs"), F.col("_pv") * F.col("traded")) * 1e4))
    miss = F.when(F.col("_un"), F.col("traded") * F.col("_pv") * bps / 1e4)
    unbooked = F.when(F.col("_un"), F.col("pos_prev") * F.col("px_ret") * F.col("_pv"))
    fixed = F.col("net_ret") + F.coalesce((unbooked - miss) / F.col("_pv"), F.lit(0.0))
    sh = lambda c: F.avg(c) / F.stddev_samp(c) * F.sqrt(F.lit(float(SESSIONS_PER_YEAR)))
    return v.groupBy(*keys).agg(F.count_if("_ch").alias("charged"), F.count_if("_un").alias("uncharged"), F.median("_bps").alias("bps_median"),
                                F.min("_bps").alias("bps_min"), F.max("_bps").alias("bps_max"), F.sum(miss).alias("missing_cost"),
                                F.sum(unbooked).alias("unbooked_pnl"), sh(F.col("net_ret")).alias("sharpe"), sh(fixed).alias("corrected_sharpe"))


def concentration(d: DataFrame, keys: Sequence[str], pnl: str, top: int = 10) -> DataFrame:
    """Share of gross gains earned on the best days."""
    rn = F.row_number().over(W.partitionBy(*keys).orderBy(F.desc(pnl)))
    v = d.withColumn("_rn", rn)
    gains = F.sum(F.greatest(pnl, F.lit(0.0)))
    return v.groupBy(*keys).agg(F.count_if(F.col(pnl) != 0).alias("active_days"),
                                F.try_divide(F.sum(F.when(F.col("_rn") <= top, F.greatest(pnl, F.lit(0.0)))), gains).alias("top_share"))


def side_breakdown(d: DataFrame, keys: Sequence[str]) -> DataFrame:
    """P&L and turnover by the side held over the day."""
    side = F.when(F.col("pos_prev") > 0, "long").when(F.col("pos_prev") < 0, "short").otherwise("flat")
    return d.groupBy(*keys, side.alias("side")).agg(F.count("*").alias("days"), F.sum("daily_pnl").alias("pnl"), F.sum("traded").alias("turnover"))


def cost_stack(d: DataFrame, keys: Sequence[str], contract_units: float, tick: float, commission: float, base_bps: float, half_spread_bps: float) -> DataFrame:
    """Cost components in basis points from the average price (cents per unit)."""
    g = d.groupBy(*keys).agg(F.avg("close").alias("price"))
    notional = F.lit(contract_units) * F.col("price") / 100
    com, half = F.lit(commission) / notional * 1e4, F.lit(tick / 2) / F.col("price") * 1e4
    rows = [("commission", com), ("half_spread", half), ("observable", com + half), ("engine_base", F.lit(base_bps)), ("engine_all_in", F.lit(base_bps + half_spread_bps))]
    return g.select(*keys, F.inline(F.array(*[F.struct(F.lit(n).alias("component"), c.cast("double").alias("bps")) for n, c in rows])))


def rolling(d: DataFrame, keys: Sequence[str], day: str, value: str, widths: Sequence[int] = (7, 14, 30), agg=F.avg, tag: str = "") -> DataFrame:
    """Trailing windows of whole rows."""
    w = by(keys, day)
    return d.select("*", *[agg(value).over(w.rowsBetween(-(n - 1), 0)).alias(f"{value}_{n}d{tag}") for n in widths])


def forward_return(d: DataFrame, keys: Sequence[str], day: str, value: str, ahead: int = 10) -> DataFrame:
    """W17."""
    return d.withColumn("fwd_return", F.lead(value, ahead).over(by(keys, day)) / F.col(value) - 1)


def seasonal_z(d: DataFrame, keys: Sequence[str], day: str, value: str) -> DataFrame:
    """Z-score against earlier years of the same month-day; full-sample moments when there is no history."""
    md = F.date_format(day, "MM-dd")
    past = W.partitionBy(*keys, md).orderBy(day).rowsBetween(W.unboundedPreceding, -1)
    full = d.groupBy(*keys).agg(F.avg(value).alias("_fm"), F.stddev_samp(value).alias("_fs"))
    v = d.withColumn("_m", F.avg(value).over(past)).withColumn("_s", F.stddev_samp(value).over(past)).join(full, list(keys))
    z = (F.col(value) - F.coalesce("_m", "_fm")) / (F.coalesce("_s", "_fs") + 1e-6)
    return v.withColumn("z", z).drop("_m", "_s", "_fm", "_fs")


def signal_z(d: DataFrame, keys: Sequence[str], day: str, forecast: str, vol: str, window: int = 60, warmup: int = 5, clip: float = 3.0) -> DataFrame:
    """Z-score of the forecast against its last 60 values, clipped; scaled by volatility while warming up."""
    w = by(keys, day).rowsBetween(-(window - 1), 0)
    f = F.col(forecast)
    z = F.try_divide(f - F.avg(f).over(w), F.stddev_samp(f).over(w))
    early = F.try_divide(f, F.col(vol) * F.sqrt(F.lit(float(SESSIONS_PER_YEAR))))
    return d.withColumn("signal", F.when(F.count(f).over(w) < warmup, early).otherwise(F.least(F.greatest(z, F.lit(-clip)), F.lit(clip))))


def vol_percentile(d: DataFrame, keys: Sequence[str], day: str, ret: str, q: float = 0.8, minimum: int = 60) -> DataFrame:
    """20-day realised volatility and whether it is above the q-quantile of the prior year's values."""
    w = by(keys, day)
    v = d.withColumn("vol20", F.when(F.count(ret).over(w.rowsBetween(-19, 0)) == 20, F.stddev_samp(ret).over(w.rowsBetween(-19, 0))))
    past = w.rowsBetween(-SESSIONS_PER_YEAR, -1)
    v = v.withColumn("_n", F.count("vol20").over(past)).withColumn("vol_limit", F.percentile("vol20", F.lit(q)).over(past))
    v = v.withColumn("vol_limit", F.when(F.col("_n") >= minimum, F.col("vol_limit")))
    return v.withColumn("high_vol", F.coalesce(F.col("vol20") > F.col("vol_limit"), F.lit(False))).drop("_n")


def trend_filter(d: DataFrame, keys: Sequence[str], day: str, price: str, n: int) -> DataFrame:
    """Moving average and the side it allows."""
    v = d.withColumn("sma", F.avg(price).over(by(keys, day).rowsBetween(-(n - 1), 0)))
    return v.withColumn("allowed", F.signum(F.col(price) - F.col("sma")))


def next_fill(d: DataFrame, keys: Sequence[str], day: str, target: str, bps: float) -> DataFrame:
    """yesterday's target is today's position; turnover is charged."""
    w = by(keys, day)
    v = d.withColumn("filled", F.coalesce(F.lag(target).over(w), F.lit(0.0)))
    change = F.abs(F.col("filled") - F.coalesce(F.lag("filled").over(w), F.lit(0.0)))
    return v.withColumn("turnover_cost", change * bps / 1e4)


def surprise(d: DataFrame, keys: Sequence[str], year: str, value: str, span: int = 5) -> DataFrame:
    """Value minus the mean of the `span` previous periods."""
    return d.withColumn("surprise", F.col(value) - F.avg(value).over(by(keys, year).rowsBetween(-span, -1)))


def lagged_change(d: DataFrame, keys: Sequence[str], day: str, value: str, n: int, name: str, ratio: bool = True) -> DataFrame:
    """Change against the value n rows earlier."""
    p = F.lag(value, n).over(by(keys, day))
    return d.withColumn(name, F.try_divide(F.col(value), p) - 1 if ratio else F.col(value) - p)


def walk_forward_choice(scores: DataFrame, keys: Sequence[str], config: str, year: str, score: str) -> DataFrame:
    """Per year the configuration with the best mean score over strictly earlier years."""
    past = W.partitionBy(*keys, config).orderBy(year).rowsBetween(W.unboundedPreceding, -1)
    v = scores.withColumn("past_mean", F.avg(score).over(past)).where("past_mean IS NOT NULL")
    return v.groupBy(*keys, year).agg(F.max_by(F.struct(config, "past_mean", score), F.struct(F.col("past_mean"), F.col(config))).alias("b")).select(*keys, year, "b.*")


def moment_sharpe(c: Column) -> Column:
    return F.avg(c) / F.stddev_samp(c) * F.sqrt(F.lit(float(SESSIONS_PER_YEAR)))
