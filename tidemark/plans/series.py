"""Daily-series queries. Role: the daily order total of one priority is a price series and drives a rule position."""

from __future__ import annotations

from pyspark.sql import functions as F, Window as W

from ..operators import inference as inf, series as se
from ..staging import stage
from .registry import query, table
from .study import rounded

K, SPLIT, BASE = ["series"], "2000-06-01", 10_000_000.0

BT_CTE = f"""
totals AS (SELECT o_orderpriority AS series, o_orderdate::DATE AS day, sum(round(o_totalprice * 100)::BIGINT)::BIGINT AS cents FROM orders GROUP BY ALL),
p0 AS (SELECT series, day, 50000 + cents / 100000.0::DOUBLE AS close, cents - coalesce(lag(cents) OVER w, cents) AS chg FROM totals WINDOW w AS (PARTITION BY series ORDER BY day)),
p1 AS (SELECT *, CASE WHEN abs(chg) < 15000000 THEN 0.0::DOUBLE ELSE 0.5::DOUBLE * sign(chg) END AS pos FROM p0),
p2 AS (SELECT *, coalesce(lag(pos) OVER w, 0) AS pos_prev, coalesce(close / lag(close) OVER w - 1, 0) AS px_ret, coalesce(abs(pos - lag(pos) OVER w), abs(pos)) AS traded,
  month(day) IN (7, 8) AS in_season FROM p1 WINDOW w AS (PARTITION BY series ORDER BY day)),
p3 AS (SELECT *, 1000000.0::DOUBLE * pos_prev * px_ret AS daily_pnl, CASE WHEN month(day) = 9 THEN 0.0::DOUBLE ELSE traded * 1000000.0::DOUBLE * 0.0011::DOUBLE END AS costs FROM p2),
p4 AS (SELECT *, daily_pnl - costs AS net_pnl FROM p3),
p5 AS (SELECT *, {BASE}::DOUBLE + sum(net_pnl) OVER (PARTITION BY series ORDER BY day) AS value FROM p4),
bt AS (SELECT *, net_pnl / (value - net_pnl) AS net_ret FROM p5)
"""
BT = f"WITH {BT_CTE}"


def totals(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return o.groupBy(F.col("o_orderpriority").alias("series"), F.to_date("o_orderdate").alias("day")).agg(
        F.sum(F.round(F.col("o_totalprice") * 100).cast("bigint")).alias("cents"))


def backtest(spark, sf_dir):
    w = se.by(K, "day")
    chg = F.col("cents") - F.coalesce(F.lag("cents").over(w), F.col("cents"))
    d = totals(spark, sf_dir).withColumn("close", 50000 + F.col("cents") / 100000).withColumn("chg", chg)
    d = d.withColumn("pos", F.when(F.abs("chg") < 15000000, F.lit(0.0)).otherwise(F.signum("chg") * 0.5))
    d = se.positions(d, K, "day").withColumn("daily_pnl", F.lit(1e6) * F.col("pos_prev") * F.col("px_ret"))
    d = d.withColumn("costs", F.when(F.month("day") == 9, F.lit(0.0)).otherwise(F.col("traded") * 1e6 * 0.0011))
    d = d.withColumn("net_pnl", F.col("daily_pnl") - F.col("costs"))
    d = d.withColumn("value", BASE + F.sum("net_pnl").over(w.rowsBetween(W.unboundedPreceding, 0)))
    return stage(d.withColumn("net_ret", F.col("net_pnl") / (F.col("value") - F.col("net_pnl"))).drop("cents", "chg"), "backtest")


@query("daily_returns", f"""{BT} SELECT series, day, pos, pos_prev, round(px_ret, 9) AS px_ret, traded, in_season, round(net_pnl, 4) AS net_pnl FROM bt""")
def daily_returns(spark, sf_dir):
    """W2."""
    d = backtest(spark, sf_dir)
    return d.select("series", "day", "pos", "pos_prev", F.round("px_ret", 9).alias("px_ret"), "traded", "in_season", F.round("net_pnl", 4).alias("net_pnl"))


@query("drawdown", f"""{BT} SELECT series, day, round(max(value) OVER w, 4) AS peak, round(value / max(value) OVER w - 1, 8) AS drawdown,
  round(exp(sum(ln(1 + net_ret)) OVER w), 8) AS equity FROM bt WINDOW w AS (PARTITION BY series ORDER BY day)""")
def drawdown(spark, sf_dir):
    """W3."""
    d = se.compound(se.drawdown(backtest(spark, sf_dir), K, "day", "value"), K, "day", "net_ret")
    return d.select("series", "day", F.round("peak", 4).alias("peak"), F.round("drawdown", 8).alias("drawdown"), F.round("equity", 8).alias("equity"))


EPISODES = """
e0 AS (SELECT *, sign(pos) AS sg, (coalesce(lag(sign(pos)) OVER (PARTITION BY {k} ORDER BY day), 0) <> sign(pos))::INT AS new FROM {src}),
e1 AS (SELECT *, sum(new) OVER (PARTITION BY {k} ORDER BY day) AS run FROM e0),
ep AS (SELECT {k}, min(day) AS entry, max(day) AS exit, CASE WHEN sg > 0 THEN 'long' ELSE 'short' END AS side, count(*) AS days_held, sum(net_pnl) AS net_pnl FROM e1 WHERE sg <> 0 GROUP BY {k}, run, sg)
"""


@query("episodes", f"""{BT}, {EPISODES.format(k='series', src='bt')} SELECT series, entry, exit, side, days_held, round(net_pnl, 4) AS net_pnl FROM ep""")
def episodes(spark, sf_dir):
    """W4."""
    return rounded(se.episodes(backtest(spark, sf_dir), K, "day", "pos", "net_pnl"), ["net_pnl"], 4)


@query("last_episodes", f"""{BT}, {EPISODES.format(k='series', src='bt')} SELECT series, entry, exit, side FROM ep ORDER BY exit DESC, series LIMIT 5""")
def last_episodes(spark, sf_dir):
    """T5."""
    e = se.episodes(backtest(spark, sf_dir), K, "day", "pos", "net_pnl")
    return e.select("series", "entry", "exit", "side").orderBy(F.desc("exit"), "series").limit(5)


PERF = f"""{BT},
pv AS (SELECT * FROM (SELECT *, 'full' AS period FROM bt UNION ALL SELECT *, CASE WHEN day < DATE '{SPLIT}' THEN 'in_sample' ELSE 'holdout' END FROM bt)
  JOIN (SELECT series, arg_max(value, day) AS hold FROM bt WHERE day < DATE '{SPLIT}' GROUP BY 1) USING (series)),
pb AS (SELECT *, CASE WHEN period = 'holdout' THEN hold ELSE {BASE} END AS base FROM pv),
pd AS (SELECT *, coalesce(lag(value) OVER w, base) AS before, value / greatest(max(value) OVER w, base) - 1 AS dd FROM pb WINDOW w AS (PARTITION BY series, period ORDER BY day)),
{EPISODES.format(k='series, period', src='pd')},
ea AS (SELECT series, period, count(*) AS episodes, count(*) FILTER (net_pnl > 0) AS wins, avg((net_pnl > 0)::INT) AS win_rate, avg(net_pnl) AS avg_pnl, sum(greatest(net_pnl, 0)) / nullif(-sum(least(net_pnl, 0)), 0) AS pf FROM ep GROUP BY ALL),
pa AS (SELECT series, period, count(*) AS trading_days, arg_max(value, day) AS last, any_value(base) AS b, avg(net_ret) AS m, stddev_samp(net_ret) AS sd, sqrt(avg(least(net_ret, 0) * least(net_ret, 0))) AS down,
  min(dd) AS max_drawdown, sum(net_pnl) AS net_pnl, sum(traded) AS tr, sum(costs) AS costs, sum(traded * before) AS tusd, count(*) FILTER (traded > 0 AND costs = 0) AS uncharged_changes, avg((pos <> 0)::INT) AS time_in_market FROM pd GROUP BY ALL),
perf AS (SELECT series, period, trading_days, last / b - 1 AS total_return, pow(last / b, 1 / (trading_days / 252.0::DOUBLE)) - 1 AS cagr, sd * sqrt(252) AS volatility, m / sd * sqrt(252) AS sharpe, m / down * sqrt(252) AS sortino,
  max_drawdown, (pow(last / b, 1 / (trading_days / 252.0::DOUBLE)) - 1) / abs(max_drawdown) AS calmar, episodes, win_rate, avg_pnl AS avg_episode_pnl, pf AS profit_factor, net_pnl, tr / (trading_days / 252.0::DOUBLE) AS turnover, costs,
  costs / tusd * 1e4 AS cost_bps, uncharged_changes, costs / episodes / b * 1e4 AS cost_per_episode_bps, time_in_market FROM pa JOIN ea USING (series, period))"""
PERF_COLS = ["total_return", "cagr", "volatility", "sharpe", "sortino", "max_drawdown", "calmar", "win_rate", "avg_episode_pnl", "profit_factor", "net_pnl", "turnover", "costs", "cost_bps",
             "cost_per_episode_bps", "time_in_market"]


def _perf(spark, sf_dir):
    return se.performance(backtest(spark, sf_dir), K, "day", BASE, SPLIT)


@query("performance", f"""{PERF} SELECT series, period, trading_days, episodes, uncharged_changes, {", ".join(f"round({c}, 6) AS {c}" for c in PERF_COLS)} FROM perf""")
def performance(spark, sf_dir):
    """A21, A22."""
    return rounded(_perf(spark, sf_dir), PERF_COLS)


@query("pass_rules", f"""{PERF} SELECT series, unnest(['positive_sharpe', 'drawdown_below_5pct', 'more_wins_than_losses']) AS rule,
  unnest([sharpe > 0, max_drawdown > -0.05, win_rate > 0.5]) AS passed FROM perf WHERE period = 'holdout'""")
def pass_rules(spark, sf_dir):
    """P36."""
    hold = _perf(spark, sf_dir).where("period = 'holdout'")
    rules = {"positive_sharpe": "sharpe > 0", "drawdown_below_5pct": "max_drawdown > -0.05", "more_wins_than_losses": "win_rate > 0.5"}
    return hold.select("series", F.inline(F.array(*[F.struct(F.lit(n).alias("rule"), F.expr(e).alias("passed")) for n, e in rules.items()])))


@query("monthly_pivot", f"""{BT}, m AS (SELECT series, year(day)::INT AS year, month(day) AS m, exp(sum(ln(1 + net_ret))) - 1 AS r FROM bt GROUP BY ALL)
SELECT series, year, {", ".join(f"round(max(r) FILTER (m = {i}), 8) AS m{i:02d}" for i in range(1, 13))} FROM m GROUP BY ALL""")
def monthly_pivot(spark, sf_dir):
    """A23."""
    return rounded(se.monthly_returns(backtest(spark, sf_dir), K, "day", "net_ret"), [f"m{i:02d}" for i in range(1, 13)], 8)


@query("cost_audit", f"""{BT}, a AS (SELECT *, lag(value) OVER (PARTITION BY series ORDER BY day) AS pv FROM bt),
b AS (SELECT *, CASE WHEN traded > 0 AND costs > 0 THEN costs / (pv * traded) * 1e4 END AS bps, CASE WHEN traded > 0 AND costs = 0 THEN traded * pv * 11.0::DOUBLE / 1e4 END AS miss,
  CASE WHEN traded > 0 AND costs = 0 THEN pos_prev * px_ret * pv END AS unb FROM a),
c AS (SELECT *, net_ret + coalesce((unb - miss) / pv, 0) AS fixed FROM b)
SELECT series, count(*) FILTER (traded > 0 AND costs > 0) AS charged, count(*) FILTER (traded > 0 AND costs = 0) AS uncharged, round(median(bps), 6) AS bps_median, round(min(bps), 6) AS bps_min, round(max(bps), 6) AS bps_max,
  round(sum(miss), 4) AS missing_cost, round(sum(unb), 4) AS unbooked_pnl, round(avg(net_ret) / stddev_samp(net_ret) * sqrt(252), 6) AS sharpe, round(avg(fixed) / stddev_samp(fixed) * sqrt(252), 6) AS corrected_sharpe FROM c GROUP BY 1""")
def cost_audit(spark, sf_dir):
    """A24."""
    d = se.cost_audit(backtest(spark, sf_dir), K, "day", 11.0)
    return rounded(rounded(d, ["bps_median", "bps_min", "bps_max", "sharpe", "corrected_sharpe"]), ["missing_cost", "unbooked_pnl"], 4)


@query("cost_sweep", f"""{BT}, s AS (SELECT bps, series, day, traded, daily_pnl - traded * 1e6 * (bps + 1) / 1e4 AS net, pos FROM bt, (VALUES (0), (10), (25), (50)) t(bps)),
v AS (SELECT *, {BASE}::DOUBLE + sum(net) OVER (PARTITION BY series, bps ORDER BY day) AS value FROM s), r AS (SELECT *, net / (value - net) AS ret FROM v)
SELECT series, bps, round(avg(ret) / stddev_samp(ret) * sqrt(252), 6) AS sharpe, round(arg_max(value, day) / {BASE} - 1, 6) AS total_return, round(sum(traded * 1e6 * (bps + 1) / 1e4), 4) AS costs FROM r GROUP BY ALL""")
def cost_sweep(spark, sf_dir):
    """The series re-costed at several rates (base plus a one-point half spread)."""
    d = backtest(spark, sf_dir).withColumn("bps", F.explode(F.array(*[F.lit(b) for b in (0, 10, 25, 50)])))
    d = d.withColumn("cost", F.col("traded") * 1e6 * (F.col("bps") + 1) / 1e4).withColumn("net", F.col("daily_pnl") - F.col("cost"))
    w = se.by(["series", "bps"], "day").rowsBetween(W.unboundedPreceding, 0)
    d = d.withColumn("value", BASE + F.sum("net").over(w)).withColumn("ret", F.col("net") / (F.col("value") - F.col("net")))
    return d.groupBy("series", "bps").agg(F.round(se.moment_sharpe(F.col("ret")), 6).alias("sharpe"), F.round(F.max_by("value", "day") / BASE - 1, 6).alias("total_return"), F.round(F.sum("cost"), 4).alias("costs"))


@query("grid_pivot", f"""{BT}, g AS (SELECT series, year(day) AS y, avg(net_ret) / stddev_samp(net_ret) * sqrt(252) AS s FROM bt GROUP BY ALL)
SELECT series, string_agg(y || '=' || coalesce(round(s * 1000000)::BIGINT::VARCHAR, '-'), ',' ORDER BY y) AS by_year, count(*) FILTER (s > 0) AS positive, round(min(s), 6) AS lowest, round(max(s), 6) AS highest FROM g GROUP BY 1""")
def grid_pivot(spark, sf_dir):
    """One row per series; the years are those of the data, each with its Sharpe ratio in millionths."""
    g = backtest(spark, sf_dir).groupBy("series", F.year("day").alias("y")).agg(se.moment_sharpe(F.col("net_ret")).alias("s"))
    cell = F.concat(F.col("y").cast("string"), F.lit("="), F.coalesce(F.round(F.col("s") * 1000000).cast("bigint").cast("string"), F.lit("-")))
    return g.groupBy("series").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("y", cell.alias("c")))), lambda x: x["c"]), ",").alias("by_year"), F.count_if(F.col("s") > 0).alias("positive"),
                                   F.round(F.min("s"), 6).alias("lowest"), F.round(F.max("s"), 6).alias("highest"))


@query("pnl_concentration", f"""{BT}, r AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY net_pnl DESC) AS rn FROM bt)
SELECT series, count(*) FILTER (net_pnl <> 0) AS active_days, round(sum(greatest(net_pnl, 0)) FILTER (rn <= 10) / sum(greatest(net_pnl, 0)), 6) AS top_share FROM r GROUP BY 1""")
def pnl_concentration(spark, sf_dir):
    """A34."""
    return rounded(se.concentration(backtest(spark, sf_dir), K, "net_pnl"), ["top_share"])


@query("side_breakdown", f"""{BT} SELECT series, CASE WHEN pos_prev > 0 THEN 'long' WHEN pos_prev < 0 THEN 'short' ELSE 'flat' END AS side, count(*) AS days, round(sum(daily_pnl), 4) AS pnl, round(sum(traded), 4) AS turnover FROM bt GROUP BY ALL""")
def side_breakdown(spark, sf_dir):
    """A35."""
    return rounded(se.side_breakdown(backtest(spark, sf_dir), K), ["pnl", "turnover"], 4)


@query("cost_stack", f"""{BT}, p AS (SELECT series, avg(close) AS price FROM bt GROUP BY 1), c AS (SELECT series, 2.0::DOUBLE / (5000.0::DOUBLE * price / 100) * 1e4 AS com, 0.125::DOUBLE / price * 1e4 AS half FROM p)
SELECT series, unnest(['commission', 'half_spread', 'observable', 'engine_base', 'engine_all_in']) AS component, unnest([round(com, 8), round(half, 8), round(com + half, 8), 10.0::DOUBLE, 11.0::DOUBLE]) AS bps FROM c""")
def cost_stack(spark, sf_dir):
    """P38."""
    return rounded(se.cost_stack(backtest(spark, sf_dir), K, 5000.0, 0.25, 2.0, 10.0, 1.0), ["bps"], 8)


@query("rolling_features", f"""{BT} SELECT series, day, {", ".join(f"round(avg(close) OVER (PARTITION BY series ORDER BY day ROWS {n - 1} PRECEDING), 6) AS close_{n}d, round(sum(traded) OVER (PARTITION BY series ORDER BY day ROWS {n - 1} PRECEDING), 6) AS traded_{n}d_sum" for n in (7, 14, 30))} FROM bt""")
def rolling_features(spark, sf_dir):
    """W16."""
    d = se.rolling(se.rolling(backtest(spark, sf_dir), K, "day", "close"), K, "day", "traded", agg=F.sum, tag="_sum")
    cols = [f"close_{n}d" for n in (7, 14, 30)] + [f"traded_{n}d_sum" for n in (7, 14, 30)]
    return rounded(d.select("series", "day", *cols), cols)


@query("fwd_return", f"""{BT} SELECT series, day, round(lead(close, 10) OVER (PARTITION BY series ORDER BY day) / close - 1, 8) AS fwd_return FROM bt""")
def fwd_return(spark, sf_dir):
    """W17."""
    return rounded(se.forward_return(backtest(spark, sf_dir), K, "day", "close").select("series", "day", "fwd_return"), ["fwd_return"], 8)


@query("seasonal_z", f"""{BT}, f AS (SELECT series, avg(close) AS fm, stddev_samp(close) AS fs FROM bt GROUP BY 1)
SELECT series, day, round((close - coalesce(avg(close) OVER w, fm)) / (coalesce(stddev_samp(close) OVER w, fs) + 1e-6), 5) AS z FROM bt JOIN f USING (series)
WINDOW w AS (PARTITION BY series, strftime(day, '%m-%d') ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""")
def seasonal_z(spark, sf_dir):
    """W15."""
    return rounded(se.seasonal_z(backtest(spark, sf_dir), K, "day", "close").select("series", "day", "z"), ["z"], 5)


@query("vol_percentile", f"""{BT}, a AS (SELECT series, day, px_ret, CASE WHEN count(px_ret) OVER w = 20 THEN stddev_samp(px_ret) OVER w END AS vol20 FROM bt WINDOW w AS (PARTITION BY series ORDER BY day ROWS 19 PRECEDING)),
b AS (SELECT *, CASE WHEN count(vol20) OVER p >= 60 THEN quantile_cont(vol20, 0.8) OVER p END AS vol_limit FROM a WINDOW p AS (PARTITION BY series ORDER BY day ROWS BETWEEN 252 PRECEDING AND 1 PRECEDING))
SELECT series, day, round(vol20, 9) AS vol20, round(vol_limit, 9) AS vol_limit, coalesce(vol20 > vol_limit, false) AS high_vol FROM b""")
def vol_percentile(spark, sf_dir):
    """W19."""
    d = se.vol_percentile(backtest(spark, sf_dir), K, "day", "px_ret")
    return rounded(d.select("series", "day", "vol20", "vol_limit", "high_vol"), ["vol20", "vol_limit"], 9)


@query("signal_position", f"""{BT}, a AS (SELECT *, count(px_ret) OVER w AS n, avg(px_ret) OVER w AS m, stddev_samp(px_ret) OVER w AS s, avg(close) OVER (PARTITION BY series ORDER BY day ROWS 49 PRECEDING) AS sma FROM bt WINDOW w AS (PARTITION BY series ORDER BY day ROWS 59 PRECEDING)),
b AS (SELECT *, CASE WHEN n < 5 THEN px_ret / (0.01::DOUBLE * sqrt(252)) ELSE least(greatest(CASE WHEN s <> 0 THEN (px_ret - m) / s END, -3.0), 3.0) END AS signal FROM a),
c AS (SELECT *, CASE WHEN in_season AND abs(signal) >= 0.5 THEN sign(signal) * 0.5 ELSE 0 END AS target FROM b),
d AS (SELECT *, coalesce(lag(target) OVER (PARTITION BY series ORDER BY day), 0) AS filled FROM c)
SELECT series, day, round(signal, 6) AS signal, sign(close - sma)::DOUBLE AS allowed, target::DOUBLE AS target, filled::DOUBLE AS filled, round(abs(filled - coalesce(lag(filled) OVER (PARTITION BY series ORDER BY day), 0)) * 11.0 / 1e4, 9) AS turnover_cost FROM d""")
def signal_position(spark, sf_dir):
    """Clipped z-score, trend side, season-gated target, next-session fill and its cost."""
    d = backtest(spark, sf_dir).withColumn("vol", F.lit(0.01))
    d = se.trend_filter(se.signal_z(d, K, "day", "px_ret", "vol"), K, "day", "close", 50)
    from ..operators.weather import rule_position
    d = rule_position(d, F.col("signal"), F.col("in_season"), F.lit(False), minimum=0.5, size=0.5, cap=1.0)
    d = se.next_fill(d, K, "day", "target", 11.0)
    return rounded(rounded(d.select("series", "day", "signal", "allowed", "target", "filled", "turnover_cost"), ["signal"]), ["turnover_cost"], 9)


@query("yield_surprise", """WITH y AS (SELECT o_orderpriority AS series, year(o_orderdate)::INT AS year, sum(round(o_totalprice * 100)::BIGINT)::BIGINT / 1e9 AS value FROM orders GROUP BY ALL)
SELECT series, year, round(value - avg(value) OVER w, 6) AS surprise, round(value / lag(value) OVER (PARTITION BY series ORDER BY year) - 1, 6) AS yearly_change FROM y
WINDOW w AS (PARTITION BY series ORDER BY year ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING)""")
def yield_surprise(spark, sf_dir):
    """W23."""
    y = totals(spark, sf_dir).groupBy("series", F.year("day").alias("year")).agg((F.sum("cents") / 1e9).alias("value"))
    y = se.lagged_change(se.surprise(y, K, "year", "value"), K, "year", "value", 1, "yearly_change")
    return rounded(y.select("series", "year", "surprise", "yearly_change"), ["surprise", "yearly_change"])


@query("walk_forward_choice", f"""{BT}, s AS (SELECT series AS config, year(day)::INT AS year, avg(net_ret) / stddev_samp(net_ret) * sqrt(252) AS score FROM bt GROUP BY ALL),
p AS (SELECT *, avg(score) OVER (PARTITION BY config ORDER BY year ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS past_mean FROM s)
SELECT year, arg_max(config, (past_mean, config)) AS config, round(max(past_mean), 6) AS past_mean, round(arg_max(score, (past_mean, config)), 6) AS score FROM p WHERE past_mean IS NOT NULL GROUP BY 1""")
def walk_forward_choice(spark, sf_dir):
    """W24."""
    s = backtest(spark, sf_dir).groupBy(F.col("series").alias("config"), F.year("day").alias("year")).agg(se.moment_sharpe(F.col("net_ret")).alias("score"))
    return rounded(se.walk_forward_choice(s, [], "config", "year", "score"), ["past_mean", "score"])


@query("price_ratio", f"""{BT}, r AS (SELECT a.day, a.close / b.close AS ratio FROM bt a JOIN bt b USING (day) WHERE a.series = '1-URGENT' AND b.series = '2-HIGH')
SELECT day, round(ratio, 8) AS ratio, {", ".join(f"round(avg(ratio) OVER (ORDER BY day ROWS {n - 1} PRECEDING), 8) AS ratio_{n}d" for n in (7, 14, 30))} FROM r""")
def price_ratio(spark, sf_dir):
    """J45, W16."""
    d = backtest(spark, sf_dir)
    a, b = d.where("series = '1-URGENT'"), d.where("series = '2-HIGH'")
    r = a.select("day", F.col("close").alias("a")).join(b.select("day", F.col("close").alias("b")), "day").select(F.lit("ratio").alias("k"), "day", (F.col("a") / F.col("b")).alias("ratio"))
    cols = ["ratio", "ratio_7d", "ratio_14d", "ratio_30d"]
    return rounded(se.rolling(r, ["k"], "day", "ratio").drop("k"), cols, 8)


@query("wilson_binomial", f"""{PERF}, lf AS (SELECT i, coalesce(sum(ln(i)) FILTER (i > 0) OVER (ORDER BY i), 0) AS lf FROM range(0, 20000) t(i)),
k AS (SELECT series, period, episodes AS n, wins AS k FROM ea), pm AS (SELECT series, period, k.n, k.k, a.i, exp(c.lf - a.lf - b.lf - k.n * ln(2)) AS pmf FROM k JOIN lf a ON a.i <= k.n JOIN lf b ON b.i = k.n - a.i JOIN lf c ON c.i = k.n),
pp AS (SELECT p.series, p.period, p.k, p.n, least(sum(p.pmf) FILTER (p.pmf <= q.pmf * (1 + 1e-7::DOUBLE)), 1.0) AS p FROM pm p JOIN pm q ON (p.series, p.period) = (q.series, q.period) AND q.i = q.k GROUP BY ALL)
SELECT series, period, k, n, round(p, 6) AS p_value, round(((k / n + 1.96::DOUBLE * 1.96 / (2 * n)) - 1.96 * sqrt(k / n * (1 - k / n) / n + 1.96::DOUBLE * 1.96 / (4 * n * n))) / (1 + 1.96::DOUBLE * 1.96 / n), 6) AS low,
  round(((k / n + 1.96::DOUBLE * 1.96 / (2 * n)) + 1.96 * sqrt(k / n * (1 - k / n) / n + 1.96::DOUBLE * 1.96 / (4 * n * n))) / (1 + 1.96::DOUBLE * 1.96 / n), 6) AS high,
  round(least(p * count(*) OVER (PARTITION BY period), 1.0), 6) AS p_corrected FROM pp""")
def wilson_binomial(spark, sf_dir):
    """Win-rate interval, exact p and its family-wise correction."""
    from ..functions import stats
    v = se.period_views(backtest(spark, sf_dir), "day", SPLIT)
    e = se.episodes(v, ["series", "period"], "day", "pos", "net_pnl").groupBy("series", "period").agg(
        F.count_if(F.col("net_pnl") > 0).cast("bigint").alias("k"), F.count("*").alias("n"))
    b = inf.binomial_p(stage(e, "counts"), ["series", "period"], "k", "n")
    lo, hi = stats.wilson(F.col("k"), F.col("n"))
    fam = stats.bonferroni(F.col("p_value"), F.count("*").over(W.partitionBy("period")))
    return rounded(b.select("series", "period", "k", "n", "p_value", lo.alias("low"), hi.alias("high"), fam.alias("p_corrected")), ["p_value", "low", "high", "p_corrected"])


MOM = """mom AS (SELECT series, count(*) AS n, avg(net_ret) AS m, avg(net_ret * net_ret) AS m2, avg(net_ret * net_ret * net_ret) AS m3, avg(net_ret * net_ret * net_ret * net_ret) AS m4 FROM bt GROUP BY 1),
mo AS (SELECT series, n, m / sqrt((m2 - m * m) * n / (n - 1)) AS sr, (m3 - 3 * m * m2 + 2 * m * m * m) / pow(m2 - m * m, 1.5) AS skew, (m4 - 4 * m * m3 + 6 * m * m * m2 - 3 * m * m * m * m) / ((m2 - m * m) * (m2 - m * m)) AS kurt FROM mom)"""


def _psr_sql():
    from ..functions.stats import norm_cdf_sql
    # Normal quantiles of 1 - 1/47 and 1 - 1/(47 e)
    z1, z2 = 2.028069144933906, 2.4168737829547298
    return f"""{BT}, {MOM}, st AS (SELECT *, sqrt(1.0::DOUBLE / n) * ((1 - 0.5772156649015329::DOUBLE) * {z1}::DOUBLE + 0.5772156649015329::DOUBLE * {z2}::DOUBLE) AS sr_star FROM mo),
z AS (SELECT *, sr * sqrt(n - 1) / sqrt(1 - skew * sr + (kurt - 1) / 4 * sr * sr) AS z0, (sr - sr_star) * sqrt(n - 1) / sqrt(1 - skew * sr + (kurt - 1) / 4 * sr * sr) AS z1 FROM st)
SELECT series, n, round(sr, 8) AS sr, round(skew, 5) AS skew, round(kurt, 5) AS kurt, round(sr_star, 8) AS sr_star, round({norm_cdf_sql('z0')}, 7) AS psr, round({norm_cdf_sql('z1')}, 7) AS dsr FROM z"""


@query("psr_dsr", _psr_sql())
def psr_dsr(spark, sf_dir):
    """R8, R9."""
    d = inf.psr_dsr(inf.moments(backtest(spark, sf_dir), K, "net_ret"))
    return rounded(rounded(rounded(d.select("series", "n", "sr", "skew", "kurt", "sr_star", "psr", "dsr"), ["sr", "sr_star"], 8), ["skew", "kurt"], 5), ["psr", "dsr"], 7)


@query("spearman", f"""{BT}, f AS (SELECT series, pos AS a, lead(close, 10) OVER (PARTITION BY series ORDER BY day) / close - 1 AS b FROM bt), g AS (SELECT * FROM f WHERE a IS NOT NULL AND b IS NOT NULL),
r AS (SELECT series, a, b, rank() OVER (PARTITION BY series ORDER BY a) + (count(*) OVER (PARTITION BY series, a) - 1) / 2.0 AS ra, rank() OVER (PARTITION BY series ORDER BY b) + (count(*) OVER (PARTITION BY series, b) - 1) / 2.0 AS rb FROM g)
SELECT series, count(*) AS n, round(corr(ra, rb), 6) AS spearman, round(avg((sign(a) = sign(b))::INT), 6) AS hit_rate FROM r GROUP BY 1""")
def spearman(spark, sf_dir):
    """R12, W17."""
    d = se.forward_return(backtest(spark, sf_dir), K, "day", "close").select("series", "pos", "fwd_return")
    return rounded(inf.spearman(d, K, "pos", "fwd_return"), ["spearman", "hit_rate"])


@query("decile_means", """WITH q AS (SELECT l_returnflag AS k, l_quantity * l_extendedprice AS x, l_discount AS y FROM lineitem),
e AS (SELECT k, quantile_cont(x, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS e FROM q GROUP BY 1)
SELECT k, (1 + len(list_filter(e, lambda v: x > v)))::INT AS bucket, count(*) AS n, round(avg(y), 7) AS mean FROM q JOIN e USING (k) GROUP BY ALL""")
def decile_means(spark, sf_dir):
    """R14 over every line item."""
    li = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("k"), (F.col("l_quantity") * F.col("l_extendedprice")).alias("x"), F.col("l_discount").alias("y"))
    return inf.quantile_buckets(li, ["k"], "x").groupBy("k", "bucket").agg(F.count("*").alias("n"), F.round(F.avg("y"), 7).alias("mean"))


@query("reconcile_metrics", f"""{PERF}, saved AS (SELECT series, period, round(sharpe, 3) AS v FROM perf WHERE period <> 'full')
SELECT series, period, round(s.v, 3) AS saved, round(p.sharpe, 6) AS recomputed, coalesce(abs(s.v - p.sharpe) <= 0.0004, false) AS matches FROM perf p LEFT JOIN saved s USING (series, period)""")
def reconcile_metrics(spark, sf_dir):
    """Metrics saved at three digits against recomputed ones; unsaved metrics do not match."""
    p = stage(_perf(spark, sf_dir).select("series", "period", "sharpe"), "perf")
    saved = p.where("period <> 'full'").withColumn("sharpe", F.round("sharpe", 3))
    return rounded(inf.reconcile(saved, p, ["series", "period"], "sharpe", 0.0004), ["recomputed"])
