"""Resampling queries. Draws are hashed, so the reference SQL reproduces them exactly."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import inference as inf, resample as rs, series as se
from ..staging import stage
from .registry import query, table
from .resampled_sql import means_cte
from .series import BT, backtest
from .study import rounded

U = "('0x' || substr(md5({t}), 1, 8))::BIGINT / 4294967296.0"


def hashed(*parts: str) -> str:
    return U.format(t=" || '|' || ".join(parts))


@query("boot_ci", f"""WITH {means_cte('e', 'events', 'event_type', 'event_id::VARCHAR', 'value', 0)}
SELECT event_type, (SELECT count(*) FROM events v WHERE v.event_type = r.event_type) AS n, round((SELECT avg(value) FROM events v WHERE v.event_type = r.event_type), 6) AS mean,
  round(quantile_cont(mean, 0.025), 6) AS ci_lo, round(quantile_cont(mean, 0.975), 6) AS ci_hi FROM er r GROUP BY event_type""")
def boot_ci(spark, sf_dir):
    """2000 replicates of the mean value per event type."""
    return rounded(rs.bootstrap_ci(table(spark, sf_dir, "events"), ["event_type"], "event_id", "value"), ["mean", "ci_lo", "ci_hi"])


@query("boot_diff", f"""WITH ea AS (SELECT event_type AS k, event_id, value FROM events WHERE value > 50), eb AS (SELECT event_type AS k, event_id, value FROM events WHERE value <= 50),
{means_cte('p', 'ea', 'k', 'event_id::VARCHAR', 'value', 1)}, {means_cte('q', 'eb', 'k', 'event_id::VARCHAR', 'value', 2)},
d AS (SELECT k, pr.mean - qr.mean AS d FROM pr JOIN qr USING (k, rep))
SELECT k, round(quantile_cont(d, 0.025), 6) AS ci_lo, round(quantile_cont(d, 0.975), 6) AS ci_hi FROM d GROUP BY 1""")
def boot_diff(spark, sf_dir):
    """R2: difference between two groups, both resampled."""
    e = table(spark, sf_dir, "events").withColumnRenamed("event_type", "k")
    return rounded(rs.bootstrap_difference(e.where("value > 50"), e.where("value <= 50"), ["k"], "event_id", "value"), ["ci_lo", "ci_hi"])


EVERY = f"{BT}, one AS (SELECT series, day, net_ret, px_ret * in_season::INT AS bench, pos_prev, px_ret, row_number() OVER (PARTITION BY series ORDER BY day) AS ord FROM bt)"


def block_cte(x, cols, seed, src="one"):
    sums = ", ".join(f"sum({c}) OVER w AS s_{c}, sum({c} * {c}) OVER w AS q_{c}" for c in cols)
    zero = ", ".join(f"0.0 AS s_{c}, 0.0 AS q_{c}" for c in cols)
    tot = ", ".join(f"sum(b.s_{c} - a.s_{c}) AS s_{c}, sum(b.q_{c} - a.q_{c}) AS q_{c}" for c in cols)
    sh = ", ".join(f"CASE WHEN (q_{c} - s_{c} * s_{c} / n) / (n - 1) > 1e-30 THEN s_{c} / n / sqrt((q_{c} - s_{c} * s_{c} / n) / (n - 1)) * sqrt(252) END AS {c}" for c in cols)
    return f"""
{x}p AS (SELECT series, ord, {sums} FROM {src} WINDOW w AS (PARTITION BY series ORDER BY ord) UNION ALL SELECT DISTINCT series, 0, {zero} FROM {src}),
{x}g AS (SELECT series, rep, slot, n, floor({hashed(f"'{seed}'", "rep", "slot")} * (n - 20))::INT AS a FROM (SELECT series, max(ord) AS n FROM {x}p GROUP BY 1), range(5000) r(rep), range(5000) s(slot) WHERE slot < ceil(n / 21.0)),
{x}t AS (SELECT {x}g.series, rep, n, {tot} FROM {x}g JOIN {x}p a ON a.series = {x}g.series AND a.ord = {x}g.a JOIN {x}p b ON b.series = {x}g.series AND b.ord = {x}g.a + least(21, n - slot * 21) GROUP BY ALL),
{x}h AS (SELECT series, rep, {sh} FROM {x}t)"""


def _series(spark, sf_dir):
    return backtest(spark, sf_dir).withColumn("bench", F.col("px_ret") * F.col("in_season").cast("int"))


@query("block_boot", f"""{EVERY}, {block_cte('k', ['net_ret', 'bench'], 0)}
SELECT series, round(quantile_cont(net_ret, 0.025), 5) AS sharpe_lo, round(quantile_cont(net_ret, 0.975), 5) AS sharpe_hi,
  round(quantile_cont(net_ret - bench, 0.025), 5) AS diff_lo, round(quantile_cont(net_ret - bench, 0.975), 5) AS diff_hi, round(avg((net_ret - bench <= 0)::INT), 6) AS diff_p FROM kh GROUP BY 1""")
def block_boot(spark, sf_dir):
    """Block bootstrap of every series' Sharpe ratio and of its paired difference to a seasonal benchmark."""
    r = stage(rs.block_sharpes(_series(spark, sf_dir), ["series"], "day", ["net_ret", "bench"]).withColumn("d", F.col("net_ret") - F.col("bench")), "reps")
    a = rs.interval(r, ["series"], "net_ret").toDF("series", "sharpe_lo", "sharpe_hi")
    b = rs.interval(r, ["series"], "d").toDF("series", "diff_lo", "diff_hi")
    p = r.groupBy("series").agg(F.round(F.avg((F.col("d") <= 0).cast("int")), 6).alias("diff_p"))
    return rounded(a.join(b, "series").join(p, "series"), ["sharpe_lo", "sharpe_hi", "diff_lo", "diff_hi"], 5)


@query("centred_p", f"""{EVERY}, cen AS (SELECT series, ord, net_ret - avg(net_ret) OVER (PARTITION BY series) AS c FROM one), {block_cte('k', ['c'], 1, 'cen')},
ob AS (SELECT series, avg(net_ret) / stddev_samp(net_ret) * sqrt(252) AS o FROM one GROUP BY 1) SELECT series, round(avg((c >= o)::INT), 6) AS p_value FROM kh JOIN ob USING (series) WHERE c IS NOT NULL GROUP BY 1""")
def centred_p(spark, sf_dir):
    """R5, every series."""
    d = _series(spark, sf_dir)
    obs = d.groupBy("series").agg(se.moment_sharpe(F.col("net_ret")).alias("observed"), F.avg("net_ret").alias("_m"))
    c = d.join(obs, "series").withColumn("c", F.col("net_ret") - F.col("_m"))
    reps = rs.block_sharpes(c, ["series"], "day", ["c"], seed=1)
    return rounded(inf.centred_p(reps, ["series"], "c", obs), ["p_value"])


@query("perm_test", f"""{EVERY}, o AS (SELECT series, ord - 1 AS ord, pos_prev AS p, px_ret AS r FROM one), n AS (SELECT series, count(*) AS n FROM o GROUP BY 1),
ob AS (SELECT series, sum(p * r) / n / sqrt((sum(p * r * p * r) - sum(p * r) * sum(p * r) / n) / (n - 1)) * sqrt(252) AS o FROM o JOIN n USING (series) GROUP BY series, n),
dr AS (SELECT series, 1 + floor({hashed("'0'", "'shift'", "id")} * (n - 1))::INT AS shift, count(*) AS w FROM range(5000) t(id), n GROUP BY ALL),
mv AS MATERIALIZED (SELECT series, shift, w, p, (ord + shift) % n AS target FROM dr JOIN n USING (series) JOIN o USING (series)),
g AS (SELECT mv.series, shift, w, sum(mv.p * b.r) AS s, sum(mv.p * b.r * mv.p * b.r) AS q FROM mv JOIN o b ON b.series = mv.series AND b.ord = target GROUP BY ALL),
h AS (SELECT series, w, CASE WHEN (q - s * s / n) / (n - 1) > 1e-30 THEN s / n / sqrt((q - s * s / n) / (n - 1)) * sqrt(252) END AS sh FROM g JOIN n USING (series))
SELECT series, round(any_value(o), 6) AS observed, round(sum(CASE WHEN sh >= o THEN w ELSE 0 END) / sum(w), 6) AS p_value FROM h JOIN ob USING (series) WHERE sh IS NOT NULL GROUP BY 1""")
def perm_test(spark, sf_dir):
    """R6, every series."""
    return rounded(rs.shift_permutation(_series(spark, sf_dir), ["series"], "day", "pos_prev", "px_ret"), ["observed", "p_value"])


COMP = """o AS (SELECT (o_orderdate::DATE - DATE '1970-01-01') // 5 AS block, o_custkey || ':' || strftime(o_orderdate, '%Y-%m') AS g, o_totalprice / 1000 - 150 AS diff FROM orders),
p AS (SELECT DISTINCT g, block FROM o), e AS (SELECT DISTINCT block AS a, min(block) OVER (PARTITION BY g) AS b FROM p),
e2 AS (SELECT a, b FROM e UNION SELECT b, a FROM e), lab AS (
  WITH RECURSIVE reach(a, b) AS (SELECT DISTINCT a, a FROM e2 UNION SELECT r.a, e2.b FROM reach r JOIN e2 ON e2.a = r.b) SELECT a AS block, min(b) AS component FROM reach GROUP BY 1)"""


@query("block_components", f"WITH {COMP} SELECT block, component FROM lab")
def block_components(spark, sf_dir):
    """Five-day blocks tied by a customer's orders of one month."""
    return rs.block_components(_blocks(spark, sf_dir), "block", "g")


def _blocks(spark, sf_dir):
    from ..functions.scalars import day_block
    o = table(spark, sf_dir, "orders")
    return o.select(day_block(F.col("o_orderdate"), 5).alias("block"), F.concat(F.col("o_custkey").cast("string"), F.lit(":"), F.date_format("o_orderdate", "yyyy-MM")).alias("g"),
                    (F.col("o_totalprice") / 1000 - 150).alias("diff"))


@query("block_interval", f"""WITH {COMP}, c AS (SELECT component, count(*) AS n_u, sum(diff) AS s_u FROM o JOIN lab USING (block) GROUP BY 1),
u AS (SELECT row_number() OVER (ORDER BY component) - 1 AS idx, n_u, s_u, count(*) OVER () AS m FROM c),
w AS (SELECT rep, floor({hashed("'0'", "rep", "slot")} * m)::INT AS idx, m, count(*) AS w FROM (SELECT max(m) AS m FROM u), range(500) r(rep), range(10000) s(slot) WHERE slot < m GROUP BY ALL),
r AS (SELECT rep, sum(w * s_u) / sum(w * n_u) AS est FROM w JOIN u USING (idx) GROUP BY 1), k AS (SELECT est, row_number() OVER (ORDER BY est) - 1 AS rn FROM r)
SELECT (SELECT max(m) FROM u) AS calendar_blocks, round(max(est) FILTER (rn = 12), 6) AS ci_lo, round(max(est) FILTER (rn = 486), 6) AS ci_hi FROM k""")
def block_interval(spark, sf_dir):
    """R7."""
    return rounded(rs.paired_block_interval(_blocks(spark, sf_dir), "block", "g", "diff"), ["ci_lo", "ci_hi"])
