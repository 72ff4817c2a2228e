"""The option event study bound to the provided tables.

Roles: line items are option trades (region of the supplier = underlying, line status = call/put, quantity band =
strike, quarter ends = expiries, unit price = premium); orders of one priority are filings of the customer's region.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import constants as C
from ..functions import calendar as cal
from ..operators import boards, chains, events as ev, study as st
from ..staging import stage
from .calendar_events import CAL_CTE, days
from .registry import query, table
from .resampled_sql import ci_cte, means_cte

AS_OF = "2001-12-31"
TAG, PLACEBO_TAG = "1-URGENT", "5-LOW"


def regions(spark, sf_dir, key: str, nation: str, name: str):
    # nation and region are fixed 25- and 5-row dimensions
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey"), F.concat(F.lit("R"), F.col("n_regionkey").cast("string")).alias("ticker"))
    return table(spark, sf_dir, name).join(F.broadcast(n), F.col(nation) == F.col("n_nationkey")).select(key, "ticker")


def trades(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    quarter = F.trunc(F.to_date("l_shipdate"), "quarter")
    li = li.select("l_suppkey", F.round(F.col("l_extendedprice") * 100).cast("bigint").alias("cents"), "l_quantity", F.to_date("l_shipdate").alias("d"),
                   F.when(F.col("l_linestatus") == "O", "call").otherwise("put").alias("contract_type"),
                   (F.ceil(F.col("l_quantity") / 10) * 10).cast("double").alias("strike"),
                   F.last_day(F.add_months(quarter, 2 + 3 * (F.col("l_linenumber") % 3))).alias("expiration_date"))
    li = li.join(regions(spark, sf_dir, "s_suppkey", "s_nationkey", "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    return cal.align(li, "d", days(spark), {"prev_incl": "session", "ord_incl": "ord"})


def bars(spark, sf_dir):
    keys = ["ticker", "contract_type", "strike", "expiration_date", "session", "ord"]
    b = trades(spark, sf_dir).groupBy(*keys).agg(
        (F.sum("cents") / F.sum("l_quantity") / 10000).alias("close"), F.sum("l_quantity").alias("volume"))
    return stage(b.withColumn("contract_ticker", F.concat_ws("|", "ticker", "contract_type", F.col("strike").cast("int").cast("string"),
                                                             F.col("expiration_date").cast("string"))), "bars")


def contracts(b):
    return b.groupBy("ticker", "contract_type", "strike", "expiration_date", "contract_ticker").agg(
        F.min("session").alias("listed_from")).withColumn("shares_per_contract", F.lit(100))


def study_events(spark, sf_dir, tag):
    o = table(spark, sf_dir, "orders").where(F.col("o_orderpriority") == tag).select(
        "o_orderkey", "o_custkey", F.to_date("o_orderdate").alias("filing_date"))
    o = o.join(regions(spark, sf_dir, "c_custkey", "c_nationkey", "customer"), F.col("o_custkey") == F.col("c_custkey"))
    rows = o.select(F.col("ticker").alias("cik"), "filing_date", "ticker", F.lpad(F.col("o_orderkey").cast("string"), 12, "0").alias("accession_number"),
                    F.lit(None).cast("string").alias("filing_url"), F.lit(None).cast("string").alias("supporting_text"))
    return stage(ev.collapse(rows, rows.select("ticker"), days(spark)).withColumnRenamed("filing_date", "event_date"), "events")


def priced(spark, sf_dir, tag=TAG, buckets=C.BUCKETS, otm=C.OTM_GRID, b=None):
    b = bars(spark, sf_dir) if b is None else b
    p, dropped = st.price(study_events(spark, sf_dir, tag), contracts(b), b, buckets, otm)
    return stage(p, "priced"), dropped, b


def results(spark, sf_dir, tag=TAG, horizons=(0, *C.HORIZONS, "exp")):
    """Every parameter combination."""
    p, _, b = priced(spark, sf_dir, tag)
    return stage(st.evaluate(p, b, AS_OF, horizons=horizons), "results")


def sliced(spark, sf_dir, tag=TAG, entry=C.ENTRY, bucket=C.BASELINE_BUCKET, otm=C.OTM, horizons=(*C.HORIZONS, "exp"), b=None):
    """One parameter combination, taken before anything is priced or expanded."""
    p, _, b = priced(spark, sf_dir, tag, {bucket: C.BUCKETS[bucket]}, (otm,), b)
    return stage(st.evaluate(p, b, AS_OF, (otm,), (entry,), horizons), "results")


BARS_CTE = """
sup AS (SELECT s_suppkey, 'R' || n_regionkey AS ticker FROM supplier JOIN nation ON s_nationkey = n_nationkey),
bars AS (SELECT *, ticker || '|' || contract_type || '|' || strike::INT || '|' || expiration_date AS contract_ticker FROM (
  SELECT ticker, CASE l_linestatus WHEN 'O' THEN 'call' ELSE 'put' END AS contract_type, ceil(l_quantity / 10) * 10 AS strike,
    last_day((date_trunc('quarter', l_shipdate) + to_months((2 + 3 * (l_linenumber % 3))::INT))::DATE) AS expiration_date,
    c.prev_incl AS session, sum(round(l_extendedprice * 100)::BIGINT)::BIGINT / sum(l_quantity) / 10000 AS close, sum(l_quantity) AS volume
  FROM lineitem JOIN sup ON l_suppkey = s_suppkey JOIN cal_day c ON c.day = l_shipdate::DATE GROUP BY ALL)),
contracts AS (SELECT ticker, contract_type, strike, expiration_date, contract_ticker, min(session) AS listed_from FROM bars GROUP BY ALL),
buckets(bucket, lo, hi, target) AS (VALUES ('1m', 21, 45, 30), ('2m', 46, 80, 60), ('3-6m', 90, 180, 120))
"""


def price_cte(tag, x=""):
    """Reference SQL up to priced legs; `x` prefixes the table names so two groups can share a statement."""
    return f"""
{x}ev AS (SELECT 'R' || n_regionkey AS ticker, o_orderdate::DATE AS event_date, prev_strict AS t_pre, next_strict AS t_0
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN cal_day ON day = o_orderdate::DATE
  WHERE o_orderpriority = '{tag}' GROUP BY ALL),
{x}asks AS (SELECT DISTINCT ticker, t_pre FROM {x}ev),
{x}listed AS (SELECT a.ticker, t_pre, contract_type, strike, expiration_date, contract_ticker, date_diff('day', t_pre, expiration_date) AS dte
  FROM {x}asks a JOIN contracts c ON a.ticker = c.ticker AND expiration_date BETWEEN t_pre + 2 AND t_pre + 180 AND listed_from <= t_pre),
{x}pairs AS (SELECT ticker, t_pre, expiration_date, dte, strike, max(contract_ticker) FILTER (contract_type = 'call') AS call,
  max(contract_ticker) FILTER (contract_type = 'put') AS put FROM {x}listed GROUP BY ALL HAVING call IS NOT NULL AND put IS NOT NULL),
{x}near AS (SELECT p.* FROM {x}pairs p JOIN (SELECT ticker, t_pre, min(dte) AS dte FROM {x}listed WHERE dte >= 3 GROUP BY ALL) n
  USING (ticker, t_pre, dte) QUALIFY count(*) OVER (PARTITION BY ticker, t_pre) >= 3),
{x}nl AS (UNPIVOT (SELECT ticker, t_pre, dte, strike, call, put FROM {x}near) ON call, put INTO NAME kind VALUE ct),
{x}nm AS (SELECT l.*, b.close FROM {x}nl l ASOF JOIN bars b ON l.ct = b.contract_ticker AND l.t_pre >= b.session WHERE l.t_pre - b.session <= 7),
{x}nw AS (SELECT ticker, t_pre, dte, strike, max(close) FILTER (kind = 'call') AS c, max(close) FILTER (kind = 'put') AS p
  FROM {x}nm GROUP BY ALL HAVING c IS NOT NULL AND p IS NOT NULL),
{x}spots AS (SELECT ticker, t_pre, arg_min(strike * exp(-0.04::DOUBLE * (dte::DOUBLE / 365)) + c - p, (round(abs(c - p), 9), strike)) AS spot FROM {x}nw GROUP BY ALL),
{x}expiry AS (SELECT ticker, t_pre, bucket, arg_min(expiration_date, (abs(dte - target), expiration_date)) AS expiration_date
  FROM (SELECT ticker, t_pre, expiration_date, dte FROM {x}pairs GROUP BY ALL HAVING count(*) >= 3) JOIN buckets ON dte BETWEEN lo AND hi GROUP BY ALL),
{x}per_strike AS (SELECT ticker, t_pre, bucket, expiration_date, spot, strike, bool_or(contract_type = 'call') AS c, bool_or(contract_type = 'put') AS p
  FROM {x}listed JOIN {x}expiry USING (ticker, t_pre, expiration_date) JOIN {x}spots USING (ticker, t_pre) GROUP BY ALL),
{x}strikes AS (SELECT ticker, t_pre, bucket, expiration_date, spot,
  arg_min(strike, (round(abs(strike - spot), 9), strike)) FILTER (c AND p AND strike >= spot * 0.75::DOUBLE AND strike <= spot * 1.25::DOUBLE) AS k,
  {", ".join(f"coalesce(min(strike) FILTER (c AND strike >= spot * {u}::DOUBLE), max(strike) FILTER (c)) AS u{n}, coalesce(max(strike) FILTER (p AND strike <= spot * {d}::DOUBLE), min(strike) FILTER (p)) AS l{n}" for n, u, d in ((3, 1.03, 0.97), (5, 1.05, 0.95), (10, 1.1, 0.9)))}
  FROM {x}per_strike GROUP BY ALL),
{x}legs AS (SELECT s.ticker, t_pre, bucket, s.expiration_date, spot, q.leg_code, q.contract_type, q.strike, contract_ticker FROM (
  SELECT ticker, t_pre, bucket, expiration_date, spot, unnest([
    {{'leg_code': 'C_K', 'contract_type': 'call', 'strike': k}}, {{'leg_code': 'P_K', 'contract_type': 'put', 'strike': k}},
    {", ".join(f"{{'leg_code': 'C_U{p}', 'contract_type': 'call', 'strike': u{n}}}, {{'leg_code': 'P_L{p}', 'contract_type': 'put', 'strike': l{n}}}" for n, p in ((3, "0.03"), (5, "0.05"), (10, "0.1")))}]) AS q
  FROM {x}strikes WHERE k IS NOT NULL) s JOIN contracts c ON c.ticker = s.ticker AND c.contract_type = q.contract_type AND c.strike = q.strike AND c.expiration_date = s.expiration_date),
{x}atm AS (SELECT ticker, t_pre, bucket, count(*) AS n FROM (
  SELECT l.* FROM {x}legs l ASOF JOIN bars b ON l.contract_ticker = b.contract_ticker AND l.t_pre >= b.session
    JOIN cal_day d ON d.day = l.t_pre JOIN cal_day m ON m.day = b.session
  WHERE leg_code IN ('C_K', 'P_K') AND d.ord_incl - m.ord_incl <= 3) GROUP BY ALL HAVING n = 2),
{x}priced AS (SELECT e.event_date, e.t_0, l.* FROM {x}ev e JOIN {x}legs l USING (ticker, t_pre) JOIN {x}atm USING (ticker, t_pre, bucket))
"""


def mark_cte(src, out):
    return f"""
{out}_pairs AS (SELECT DISTINCT contract_ticker, day FROM {src}),
{out} AS (SELECT p.contract_ticker, p.day, b.close AS mark FROM {out}_pairs p ASOF JOIN bars b ON p.contract_ticker = b.contract_ticker AND p.day >= b.session
  JOIN cal_day d ON d.day = p.day JOIN cal_day m ON m.day = b.session WHERE d.ord_incl - m.ord_incl <= 3)
"""


def result_cte(tag, x=""):
    k = "ticker, event_date, t_pre, t_0, bucket, expiration_date, spot"
    s_of = "k * exp(-0.04::DOUBLE * (greatest(date_diff('day', day, expiration_date), 0)::DOUBLE / 365)) + c_k - p_k"
    legs = ", ".join(f"max(mark) FILTER (leg_code = '{c}') AS {n}" for c, n in (
        ("C_K", "c_k"), ("P_K", "p_k"), ("C_U0.03", "cu3"), ("P_L0.03", "pl3"), ("C_U0.05", "cu5"), ("P_L0.05", "pl5"), ("C_U0.1", "cu10"), ("P_L0.1", "pl10")))
    return price_cte(tag, x) + f""",
{x}base AS (SELECT DISTINCT {k}, c.prev_incl AS expiry_session, z.ord_incl AS o0 FROM {x}priced JOIN cal_day c ON c.day = expiration_date JOIN cal_day z ON z.day = t_0),
{x}exits AS (SELECT * FROM (
  SELECT {k}, expiry_session, h::VARCHAR AS horizon, h AS horizon_ord, session AS exit_date FROM {x}base, (VALUES (0),(1),(2),(3),(5),(10),(21),(42),(63)) t(h)
    JOIN cal_sessions s ON s.ord = o0 + h WHERE h = 0 OR session <= expiry_session
  UNION ALL SELECT {k}, expiry_session, 'exp', 9999, expiry_session FROM {x}base) WHERE exit_date <= DATE '{AS_OF}'),
{x}entries AS (SELECT {k}, 'pre' AS entry, t_pre AS day FROM {x}base UNION ALL SELECT {k}, 'post', t_0 FROM {x}base),
{x}needed AS (SELECT {k}, day FROM {x}entries UNION SELECT {k}, exit_date FROM {x}exits),
{x}leg_days AS (SELECT n.*, p.leg_code, p.strike, p.contract_ticker FROM {x}needed n JOIN {x}priced p USING ({k})),
{mark_cte(x + 'leg_days', x + 'marks')},
{x}wide0 AS (SELECT {k}, day, max(strike) FILTER (leg_code = 'C_K') AS k, {legs} FROM {x}leg_days LEFT JOIN {x}marks USING (contract_ticker, day) GROUP BY ALL),
{x}wide AS (SELECT *, {s_of} AS s FROM {x}wide0),
{x}res0 AS (SELECT e.ticker, e.event_date, e.t_0, e.bucket, e.expiration_date, e.entry, e.day AS entry_date, x.horizon, x.horizon_ord, x.exit_date,
  ox.ord_incl - oe.ord_incl AS sessions_held, os.ord_incl - oe.ord_incl AS dte_sessions, we.s AS s_entry, wx.s AS s_exit, wx.s / we.s - 1 AS realized,
  (we.c_k + we.p_k) / we.s AS implied_move,
  wx.c_k - we.c_k AS d_ck, [{", ".join(f"{{'otm': {p}::DOUBLE, 'cu': wx.cu{n} - we.cu{n}, 'pl': wx.pl{n} - we.pl{n}}}" for n, p in ((3, "0.03"), (5, "0.05"), (10, "0.1")))}] AS o
  FROM {x}entries e JOIN {x}wide we ON (e.ticker, e.event_date, e.bucket, e.day) = (we.ticker, we.event_date, we.bucket, we.day) AND we.s IS NOT NULL
  JOIN {x}exits x ON (e.ticker, e.event_date, e.bucket) = (x.ticker, x.event_date, x.bucket)
  JOIN {x}wide wx ON (x.ticker, x.event_date, x.bucket, x.exit_date) = (wx.ticker, wx.event_date, wx.bucket, wx.day)
  JOIN cal_day oe ON oe.day = e.day JOIN cal_day ox ON ox.day = x.exit_date JOIN cal_day os ON os.day = x.expiry_session),
{x}results AS (SELECT * EXCLUDE (d_ck, o, q), q.otm AS otm, (s_exit - s_entry) / s_entry AS stock, d_ck / s_entry AS long_call,
  ((s_exit - s_entry) - q.cu) / s_entry AS covered_call, ((s_exit - s_entry) + q.pl) / s_entry AS protective_put,
  ((s_exit - s_entry) + q.pl - q.cu) / s_entry AS collar, -q.pl / s_entry AS cash_secured_put FROM (
  SELECT *, CASE WHEN dte_sessions <> 0 THEN implied_move * sqrt(sessions_held::DOUBLE / dte_sessions) END AS implied_scaled,
    CASE WHEN dte_sessions <> 0 AND implied_move * sqrt(sessions_held::DOUBLE / dte_sessions) <> 0
      THEN abs(realized) / (implied_move * sqrt(sessions_held::DOUBLE / dte_sessions)) END AS ratio, unnest(o) AS q FROM {x}res0)),
{x}long AS (UNPIVOT {x}results ON stock, long_call, covered_call, protective_put, collar, cash_secured_put INTO NAME strategy VALUE pnl)
"""


RESULTS = f"WITH {CAL_CTE}, {BARS_CTE}, {result_cte(TAG)}"
PRICED = f"WITH {CAL_CTE}, {BARS_CTE}, {price_cte(TAG)}"
TWO_GROUPS = f"WITH {CAL_CTE}, {BARS_CTE}, {result_cte(TAG)}, {result_cte(PLACEBO_TAG, 'b_')}"
BASE = "bucket = '3-6m' AND entry = 'post' AND otm = 0.05::DOUBLE"
STATS = """count(pnl) AS n, round(avg(pnl), 6) AS mean, round(median(pnl), 6) AS median, round(avg((pnl > 0)::INT), 6) AS hit_rate"""


def rounded(df, cols, d=6):
    return df.select(*[F.round(c, d).alias(c) if c in cols else F.col(c) for c in df.columns])


@query("option_bars", f"WITH {CAL_CTE}, {BARS_CTE} SELECT contract_ticker, session, close, volume FROM bars")
def option_bars(spark, sf_dir):
    return bars(spark, sf_dir).select("contract_ticker", "session", "close", "volume")


@query("pair_strikes", f"{PRICED} SELECT ticker, t_pre, expiration_date, strike, call, put FROM pairs")
def pair_strikes(spark, sf_dir):
    """J8, S3."""
    e, b = study_events(spark, sf_dir, TAG), bars(spark, sf_dir)
    return chains.pair_strikes(chains.chain(e, contracts(b))).drop("dte")


@query("parity_spot", f"{PRICED} SELECT ticker, t_pre, round(spot, 6) AS spot FROM spots")
def parity_spot(spark, sf_dir):
    """J6, J12, P27."""
    e, b = study_events(spark, sf_dir, TAG), bars(spark, sf_dir)
    return rounded(chains.locate_spot(chains.ladders(chains.chain(e, contracts(b))), b), ["spot"])


@query("nearest_expiry", f"{PRICED} SELECT * FROM expiry")
def nearest_expiry(spark, sf_dir):
    """J9, J10."""
    e, b = study_events(spark, sf_dir, TAG), bars(spark, sf_dir)
    picks = chains.by_bucket(chains.ladders(chains.chain(e, contracts(b))))
    return picks.where("pick IS NOT NULL").select("ticker", "t_pre", "bucket", "pick.expiration_date")


@query("strike_pick", f"{PRICED} SELECT ticker, t_pre, bucket, leg_code, strike, contract_ticker FROM legs")
def strike_pick(spark, sf_dir):
    """J11."""
    e, b = study_events(spark, sf_dir, TAG), bars(spark, sf_dir)
    rows = stage(chains.ladders(chains.chain(e, contracts(b))), "asks")
    picks = chains.by_bucket(rows.join(chains.locate_spot(rows, b), chains.ASK)).withColumn("legs", chains.selected_legs())
    return picks.select("ticker", "t_pre", "bucket", F.inline("legs")).drop("contract_type")


@query("contract_pair", f"""{PRICED}, q AS (SELECT * FROM listed JOIN spots USING (ticker, t_pre) WHERE dte BETWEEN 90 AND 180),
shared AS (SELECT ticker, t_pre, expiration_date, dte FROM q GROUP BY ALL HAVING bool_or(contract_type = 'call') AND bool_or(contract_type = 'put')),
best AS (SELECT ticker, t_pre, arg_min(expiration_date, (abs(dte - 120), expiration_date)) AS expiration_date FROM shared GROUP BY ALL)
SELECT ticker, t_pre, expiration_date,
 arg_min(contract_ticker, (round(abs(strike - spot * 1.05::DOUBLE), 9), strike, contract_ticker)) FILTER (contract_type = 'call') AS call_contract,
 arg_min(contract_ticker, (round(abs(strike - spot * 0.95::DOUBLE), 9), strike, contract_ticker)) FILTER (contract_type = 'put') AS put_contract
FROM q JOIN best USING (ticker, t_pre, expiration_date) GROUP BY ALL""")
def contract_pair(spark, sf_dir):
    """T2, T8."""
    e, b = study_events(spark, sf_dir, TAG), bars(spark, sf_dir)
    listed = chains.chain(e, contracts(b))
    q = listed.join(chains.locate_spot(chains.ladders(listed), b), chains.ASK)
    return chains.contract_pair(q, chains.ASK, "spot", "t_pre")


@query("leg_export", f"""{PRICED} SELECT 'CIK:' || lpad(ticker, 10, '0') || ':' || ticker AS event_id, bucket, leg_code, contract_ticker, ticker AS underlying_ticker,
  contract_type, strike, expiration_date, t_pre AS selection_date, round(spot, 6) AS spot_pre, 100 AS shares_per_contract, NULL::VARCHAR AS reason FROM priced""")
def leg_export(spark, sf_dir):
    """K2, F17."""
    p, _, _ = priced(spark, sf_dir)
    e = study_events(spark, sf_dir, TAG).withColumn("event_id", F.concat_ws(":", F.lit("CIK"), F.lpad("cik", 10, "0"), "ticker"))
    return rounded(st.leg_export(e, p), ["spot_pre"])


@query("bar_export", f"WITH {CAL_CTE}, {BARS_CTE} SELECT contract_ticker, session, close, volume FROM bars")
def bar_export(spark, sf_dir):
    """Bars listed once although every bar arrives from two branches; no conflicts remain."""
    b = bars(spark, sf_dir).select("contract_ticker", "session", "close", "volume")
    clean, _ = st.bar_export(b.unionByName(b), ["contract_ticker", "session"], ["close", "volume"])
    return clean


@query("drop_reasons", f"""{PRICED},
early AS (SELECT CASE WHEN NOT EXISTS (SELECT 1 FROM listed l WHERE l.ticker = e.ticker AND l.t_pre = e.t_pre) THEN 'no_chain'
  ELSE 'no_spot' END AS reason FROM ev e LEFT JOIN spots s USING (ticker, t_pre) WHERE spot IS NULL),
late AS (SELECT b.bucket || ': ' || CASE WHEN x.expiration_date IS NULL THEN 'no_expiry' WHEN k IS NULL THEN 'no_strikes'
  ELSE 'no_trade' END AS reason
  FROM ev JOIN spots USING (ticker, t_pre) CROSS JOIN buckets b LEFT JOIN expiry x ON (x.ticker, x.t_pre, x.bucket) = (ev.ticker, ev.t_pre, b.bucket)
  LEFT JOIN strikes s ON (s.ticker, s.t_pre, s.bucket) = (ev.ticker, ev.t_pre, b.bucket)
  LEFT JOIN atm a ON (a.ticker, a.t_pre, a.bucket) = (ev.ticker, ev.t_pre, b.bucket) WHERE a.n IS NULL)
SELECT reason, count(*) AS n FROM (SELECT * FROM early UNION ALL SELECT * FROM late) GROUP BY 1""")
def drop_reasons(spark, sf_dir):
    """A7."""
    return priced(spark, sf_dir)[1].groupBy("reason").agg(F.count("*").alias("n"))


SUMMARY_SQL = f"""{PRICED}, sm_days AS (SELECT *, t_pre AS day FROM priced WHERE leg_code IN ('C_K', 'P_K')),
{mark_cte('sm_days', 'sm')},
summary0 AS (SELECT ticker, event_date, t_pre, t_0, bucket, expiration_date, spot, max(strike) AS k, max(mark) FILTER (leg_code = 'C_K') AS c,
  max(mark) FILTER (leg_code = 'P_K') AS p, sum(coalesce(volume, 0)) AS atm_volume
  FROM sm_days LEFT JOIN sm USING (contract_ticker, day) LEFT JOIN (SELECT contract_ticker, session AS day, volume FROM bars) USING (contract_ticker, day) GROUP BY ALL),
summary AS (SELECT ticker, event_date, t_pre, t_0, bucket, expiration_date, date_diff('day', t_pre, expiration_date) AS dte, spot AS spot_pre, k AS K, k / spot - 1 AS moneyness,
  c AS call_px, p AS put_px, (c + p) / spot AS implied_move,
  (k * exp(-0.04::DOUBLE * (date_diff('day', t_pre, expiration_date)::DOUBLE / 365)) + c - p) / spot - 1 AS spot_gap, atm_volume FROM summary0)"""


@query("priced_summary", f"""{SUMMARY_SQL} SELECT ticker, event_date, t_pre, t_0, bucket, expiration_date, dte::INT AS dte, round(spot_pre, 6) AS spot_pre, K,
  round(moneyness, 6) AS moneyness, call_px, put_px, round(implied_move, 6) AS implied_move, round(spot_gap, 6) AS spot_gap, atm_volume FROM summary""")
def priced_summary(spark, sf_dir):
    """P29."""
    p, _, b = priced(spark, sf_dir)
    return rounded(st.summarize(p, b), ["spot_pre", "moneyness", "implied_move", "spot_gap"])


@query("bucket_medians", f"""{SUMMARY_SQL} SELECT bucket, count(*) AS n, round(median(moneyness), 6) AS moneyness, round(median(implied_move), 6) AS implied_move,
  round(median(atm_volume), 6) AS atm_volume FROM summary GROUP BY 1""")
def bucket_medians(spark, sf_dir):
    """A6."""
    p, _, b = priced(spark, sf_dir)
    return rounded(boards.medians(stage(st.summarize(p, b), "summary"), ["bucket"], ["moneyness", "implied_move", "atm_volume"]),
                   ["moneyness", "implied_move", "atm_volume"])


@query("example_entity", f"""{SUMMARY_SQL} SELECT ticker, count(*) AS n, median(atm_volume) AS volume FROM summary GROUP BY 1 ORDER BY n DESC, volume DESC, ticker LIMIT 1""")
def example_entity(spark, sf_dir):
    """T3."""
    p, _, b = priced(spark, sf_dir)
    return boards.example_entity(stage(st.summarize(p, b), "summary"))


RESULT_COLS = ["s_entry", "s_exit", "realized", "implied_move", "implied_scaled", "ratio", *C.STRATEGIES]


@query("strategy_pnl", f"""{RESULTS} SELECT ticker, event_date, t_0, bucket, expiration_date, entry, entry_date, horizon, horizon_ord, exit_date, sessions_held, dte_sessions,
  {", ".join(f"round({c}, 6) AS {c}" for c in RESULT_COLS)}, otm FROM results""")
def strategy_pnl(spark, sf_dir):
    """J13, J14, P26-P28 over every event, bucket, entry, horizon and OTM distance."""
    return rounded(results(spark, sf_dir), RESULT_COLS)


EVENT_ID = "ticker || '|' || event_date::VARCHAR"
BOARD_SQL = f"""{RESULTS}, slice AS (SELECT * FROM long WHERE {BASE} AND horizon <> '0'), {ci_cte('s', 'slice', 'strategy, horizon', EVENT_ID, 'pnl')},
board AS (SELECT strategy, horizon, count(pnl) AS n, avg(pnl) AS mean, median(pnl) AS median, avg((pnl > 0)::INT) AS hit_rate FROM slice GROUP BY ALL)"""
BOARD_COLS = ["mean", "median", "hit_rate", "ci_lo", "ci_hi"]


@query("scoreboard", f"""{BOARD_SQL} SELECT strategy, horizon, n, {", ".join(f"round({c}, 6) AS {c}" for c in BOARD_COLS)} FROM board JOIN sci USING (strategy, horizon)""")
def scoreboard(spark, sf_dir):
    """A2: the baseline slice with bootstrap intervals, horizon 0 excluded."""
    return rounded(st.scoreboard(sliced(spark, sf_dir), ["horizon"]), BOARD_COLS)


@query("board_wide", f"""{BOARD_SQL}
SELECT strategy, {", ".join(f"max(format('{{:.6f}}', mean) || CASE WHEN coalesce(ci_lo > 0 OR ci_hi < 0, false) THEN '*' ELSE '' END) FILTER (horizon = '{h}') AS h_{h}" for h in ("1", "5", "21", "exp"))}
FROM board JOIN sci USING (strategy, horizon) GROUP BY 1""")
def board_wide(spark, sf_dir):
    """Wide board with a star where the bootstrap interval leaves out zero."""
    r = sliced(spark, sf_dir, horizons=(1, 5, 21, "exp"))
    return boards.wide_board(st.scoreboard(r, ["horizon"]), ["1", "5", "21", "exp"])


DIFF_SQL = f"""{TWO_GROUPS},
abase AS (SELECT * FROM long WHERE {BASE} AND horizon <> '0'), bbase AS (SELECT * FROM b_long WHERE {BASE} AND horizon <> '0'),
{means_cte('p', 'abase', 'strategy, horizon', EVENT_ID, 'pnl', 1)}, {means_cte('q', 'bbase', 'strategy, horizon', EVENT_ID, 'pnl', 2)},
dci AS (SELECT strategy, horizon, quantile_cont(pr.mean - qr.mean, 0.025) AS ci_lo, quantile_cont(pr.mean - qr.mean, 0.975) AS ci_hi FROM pr JOIN qr USING (strategy, horizon, rep) GROUP BY ALL),
a AS (SELECT strategy, horizon, count(pnl) AS n_a, avg(pnl) AS mean_a FROM abase GROUP BY ALL),
b AS (SELECT strategy, horizon, count(pnl) AS n_b, avg(pnl) AS mean_b, FROM bbase GROUP BY ALL),
d AS (SELECT strategy, horizon, n_a, n_b, {", ".join(f"CASE WHEN n_a >= 5 AND n_b >= 5 THEN {e} END AS {c}" for c, e in (("mean_a", "mean_a"), ("mean_b", "mean_b"), ("difference", "mean_a - mean_b"), ("ci_lo", "ci_lo"), ("ci_hi", "ci_hi")))}
  FROM a JOIN b USING (strategy, horizon) LEFT JOIN dci USING (strategy, horizon))"""
DIFF_COLS = ["mean_a", "mean_b", "difference", "ci_lo", "ci_hi"]


def _difference(spark, sf_dir, horizons=(*C.HORIZONS, "exp")):
    b = bars(spark, sf_dir)
    return boards.difference(*[sliced(spark, sf_dir, t, horizons=horizons, b=b) for t in (TAG, PLACEBO_TAG)], ["horizon"], list(C.STRATEGIES), st.event_id())


@query("difference_board", f"""{DIFF_SQL} SELECT strategy, horizon, n_a, n_b, {", ".join(f"round({c}, 6) AS {c}" for c in DIFF_COLS)} FROM d""")
def difference_board(spark, sf_dir):
    """Means of two event groups on the horizons both have, with the interval of their difference."""
    return rounded(_difference(spark, sf_dir), DIFF_COLS)


@query("rank_board", f"""{DIFF_SQL} SELECT strategy, round(avg(difference), 6) AS edge, count(*) FILTER (ci_lo > 0 OR ci_hi < 0) AS horizons_ci_excludes_0, max(n_a) AS n_events FROM d
WHERE horizon IN ('21', '42', 'exp') AND strategy <> 'stock' GROUP BY 1""")
def rank_board(spark, sf_dir):
    """A4."""
    return rounded(boards.rank(_difference(spark, sf_dir, (21, 42, "exp"))), ["edge"])


DECAY_COLS = ["mean_ratio", "median_ratio", "share_above_1", "ci_lo", "ci_hi"]


@query("decay_table", f"""{RESULTS}, slice AS (SELECT * FROM results WHERE {BASE} AND horizon <> '0'), {ci_cte('s', 'slice', 'horizon', EVENT_ID, 'ratio')},
t AS (SELECT horizon, count(ratio) AS n, avg(ratio) AS mean_ratio, median(ratio) AS median_ratio, avg((ratio > 1)::INT) AS share_above_1 FROM slice WHERE ratio IS NOT NULL GROUP BY 1)
SELECT horizon, n, {", ".join(f"round({c}, 6) AS {c}" for c in DECAY_COLS)} FROM t JOIN sci USING (horizon)""")
def decay_table(spark, sf_dir):
    """A5."""
    return rounded(boards.decay(sliced(spark, sf_dir), st.event_id()), DECAY_COLS)


@query("implied_headline", f"""{RESULTS} SELECT round(median(implied_move), 6) AS median_implied, round(median(abs(realized)), 6) AS median_realized,
  round(avg((abs(realized) > implied_move)::INT), 6) AS share_realized_above FROM results WHERE {BASE} AND horizon = 'exp' AND realized IS NOT NULL""")
def implied_headline(spark, sf_dir):
    """A39."""
    r = sliced(spark, sf_dir, horizons=("exp",)).where("realized IS NOT NULL")
    return rounded(boards.headline(r), ["median_implied", "median_realized", "share_realized_above"])


@query("sensitivity_grid", f"""{RESULTS}, slice AS (SELECT * FROM long WHERE horizon = '21'), {ci_cte('s', 'slice', 'bucket, entry, otm, strategy', EVENT_ID, 'pnl')},
g AS (SELECT bucket, entry, otm, strategy, count(pnl) AS n, avg(pnl) AS mean, median(pnl) AS median, avg((pnl > 0)::INT) AS hit_rate FROM slice GROUP BY ALL)
SELECT bucket, entry, otm, strategy, n, {", ".join(f"round({c}, 6) AS {c}" for c in BOARD_COLS)}, coalesce(ci_lo > 0 OR ci_hi < 0, false) AS starred FROM g JOIN sci USING (bucket, entry, otm, strategy)""")
def sensitivity_grid(spark, sf_dir):
    """Every parameter combination in one aggregation, with intervals and a star where they leave out zero."""
    g = st.scoreboard(results(spark, sf_dir, horizons=(21,)), ["bucket", "entry", "otm"])
    return rounded(g.withColumn("starred", boards.off_zero()), BOARD_COLS)


@query("sensitivity_pivot", f"""{RESULTS}, g AS (SELECT bucket, entry, otm, strategy, round(avg(pnl), 6) AS mean FROM long WHERE horizon = '21' GROUP BY ALL)
SELECT bucket, entry, strategy, max(mean) FILTER (otm = 0.03::DOUBLE) AS otm_3, max(mean) FILTER (otm = 0.05::DOUBLE) AS otm_5, max(mean) FILTER (otm = 0.1::DOUBLE) AS otm_10 FROM g GROUP BY ALL""")
def sensitivity_pivot(spark, sf_dir):
    """A10."""
    r = st.long_strategies(results(spark, sf_dir, horizons=(21,)), ["bucket", "entry", "otm"])
    g = r.groupBy("bucket", "entry", "strategy").pivot("otm", [0.03, 0.05, 0.1]).agg(F.round(F.avg("pnl"), 6))
    return g.toDF("bucket", "entry", "strategy", "otm_3", "otm_5", "otm_10")


PATH_SQL = f"""{PRICED},
use AS (SELECT * FROM priced WHERE leg_code IN ('C_K', 'P_K', 'C_U0.05', 'P_L0.05')),
pb AS (SELECT DISTINCT ticker, event_date, t_pre, t_0, bucket, expiration_date, spot, o.ord_incl AS o0, x.ord_incl AS o1 FROM use JOIN cal_day o ON o.day = t_0
  JOIN cal_day x ON x.day = least(expiration_date, DATE '{AS_OF}') WHERE x.ord_incl >= o.ord_incl),
steps AS (SELECT pb.*, s.session AS day, s.ord - o0 AS step FROM pb JOIN cal_sessions s ON s.ord BETWEEN o0 AND o1),
pd AS MATERIALIZED (SELECT s.*, leg_code, contract_ticker, strike FROM steps s JOIN use USING (ticker, event_date, bucket)),
{mark_cte('pd', 'pm')},
pw AS (SELECT ticker, event_date, bucket, expiration_date, t_0, day, step, max(strike) FILTER (leg_code = 'C_K') AS k, max(mark) FILTER (leg_code = 'C_K') AS c, max(mark) FILTER (leg_code = 'P_K') AS p,
  max(mark) FILTER (leg_code = 'C_U0.05') AS cu, max(mark) FILTER (leg_code = 'P_L0.05') AS pl FROM pd LEFT JOIN pm USING (contract_ticker, day) GROUP BY ALL),
ps AS (SELECT *, k * exp(-0.04::DOUBLE * (greatest(date_diff('day', day, expiration_date), 0)::DOUBLE / 365)) + c - p AS s FROM pw)
SELECT ticker, event_date, bucket, step::INT AS sessions_held, round(((s - first_value(s) OVER w) + (pl - first_value(pl) OVER w) - (cu - first_value(cu) OVER w)) / first_value(s) OVER w, 6) AS pnl
FROM ps WINDOW w AS (PARTITION BY ticker, event_date, bucket ORDER BY step)"""


@query("pnl_path", PATH_SQL)
def pnl_path(spark, sf_dir):
    """Collar path from entry to expiry."""
    p, _, b = priced(spark, sf_dir)
    return rounded(st.pnl_path(p, b, "collar", "post", C.OTM, AS_OF), ["pnl"])


CAP_SQL = f"""{PRICED},
cu AS (SELECT *, t_0 AS day FROM priced WHERE leg_code IN ('C_K', 'P_K', 'C_U0.05', 'P_L0.05')),
{mark_cte('cu', 'cm')},
cl AS (SELECT cu.*, mark, coalesce(volume, 0) AS volume FROM cu LEFT JOIN cm USING (contract_ticker, day) LEFT JOIN (SELECT contract_ticker, session AS day, volume FROM bars) USING (contract_ticker, day)),
cw AS (SELECT ticker, event_date, bucket, expiration_date, day, max(strike) FILTER (leg_code = 'C_K') AS k, max(strike) FILTER (leg_code = 'P_L0.05') AS l,
  max(mark) FILTER (leg_code = 'C_K') AS c, max(mark) FILTER (leg_code = 'P_K') AS p, max(mark) FILTER (leg_code = 'C_U0.05') AS u, max(mark) FILTER (leg_code = 'P_L0.05') AS pl,
  [{", ".join(f"{{'strategy': '{s}', 'premium': sum(mark) FILTER (leg_code IN ({q})), 'vol': min(volume) FILTER (leg_code IN ({q})), 'gaps': count(*) FILTER (leg_code IN ({q}) AND mark IS NULL)}}" for s, q in ((s, ", ".join("'" + x.replace("C_U", "C_U0.05").replace("P_L", "P_L0.05") + "'" for x in legs)) for s, legs in C.STRATEGY_LEGS.items()))}] AS a
  FROM cl GROUP BY ALL),
cs AS (SELECT * EXCLUDE (a), unnest(a) AS q, k * exp(-0.04::DOUBLE * (greatest(date_diff('day', day, expiration_date), 0)::DOUBLE / 365)) + c - p AS s FROM cw),
cq AS (SELECT ticker, event_date, day AS entry_date, bucket, q.strategy AS strategy, s, q.gaps AS gaps, q.vol AS vol, 100 * q.premium * 0.05::DOUBLE * 2 AS cost,
  CASE q.strategy WHEN 'long_call' THEN 100 * c WHEN 'cash_secured_put' THEN 100 * l WHEN 'protective_put' THEN 100 * (s + pl) WHEN 'collar' THEN 100 * (s + pl) ELSE 100 * s END AS cap0,
  CASE q.strategy WHEN 'long_call' THEN 100 * c WHEN 'cash_secured_put' THEN 100 * CASE WHEN l - pl > 0 THEN l - pl ELSE 0 END
    ELSE 100 * greatest(s - CASE WHEN q.strategy IN ('protective_put', 'collar') THEN l ELSE 0 END + CASE WHEN q.strategy IN ('protective_put', 'collar') THEN pl ELSE 0 END
      - CASE WHEN q.strategy IN ('covered_call', 'collar') THEN u ELSE 0 END, 0) END AS loss0 FROM cs),
cr AS (SELECT *, cap0 + cost AS cap, loss0 + cost AS loss, CASE WHEN s IS NULL OR s <= 0 THEN 'bad_spot' WHEN gaps > 0 THEN 'bad_marks'
  WHEN cap0 + cost <= 0 OR loss0 + cost <= 0 THEN 'no_capital_at_risk' ELSE '' END AS reason FROM cq),
capacity AS (SELECT ticker, event_date, entry_date, bucket, strategy, CASE WHEN reason = '' THEN cap END AS capital_per_contract, CASE WHEN reason = '' THEN loss END AS max_loss_per_contract,
  CASE WHEN reason = '' THEN loss0 END AS gross_max_loss_per_contract, CASE WHEN reason = '' THEN cost END AS round_trip_cost_per_contract,
  CASE WHEN reason = '' THEN floor(100000.0 / cap)::BIGINT END AS capital_contracts, CASE WHEN reason = '' THEN floor(100000.0::DOUBLE * 0.01::DOUBLE / loss)::BIGINT END AS risk_contracts,
  CASE WHEN reason = '' THEN floor(vol * 0.05::DOUBLE)::BIGINT END AS volume_contracts, CASE WHEN reason = '' THEN vol END AS least_leg_volume, reason FROM cr)"""


MONEY = ["capital_per_contract", "max_loss_per_contract", "gross_max_loss_per_contract", "round_trip_cost_per_contract"]


@query("capacity_plan", f"""{CAP_SQL} SELECT * EXCLUDE ({", ".join(MONEY)}), {", ".join(f"floor({c} * 100000 + 0.5) / 100000 AS {c}" for c in MONEY)}, least(capital_contracts, risk_contracts, volume_contracts) AS capacity_contracts FROM capacity""")
def capacity_plan(spark, sf_dir):
    """P30-P33, J7."""
    p, _, b = priced(spark, sf_dir)
    c = st.capacity(p, b, "post")
    return c.withColumns({m: F.floor(F.col(m) * 100000 + 0.5) / 100000 for m in MONEY})   # rounded the same way by any engine


NET_SQL = CAP_SQL.replace(PRICED, RESULTS)


@query("net_cost_summary", f"""{NET_SQL}, j AS (SELECT l.strategy, l.pnl, l.pnl - c.round_trip_cost_per_contract / 100 / l.s_entry AS net FROM long l
  LEFT JOIN capacity c ON (c.ticker, c.event_date, c.bucket, c.strategy) = (l.ticker, l.event_date, l.bucket, l.strategy) WHERE l.bucket = '3-6m' AND l.entry = 'post' AND l.otm = 0.05::DOUBLE AND l.horizon = '21')
SELECT strategy, count(net) AS n, round(avg(pnl), 6) AS mean_gross, round(avg(net), 6) AS mean_net, round(median(net), 6) AS median_net, round(avg((net > 0)::INT), 6) AS share_net_positive FROM j GROUP BY 1""")
def net_cost_summary(spark, sf_dir):
    """Results joined to their trade plans, net of round-trip costs."""
    b = bars(spark, sf_dir)
    p, _, _ = priced(spark, sf_dir, b=b)
    r = st.long_strategies(sliced(spark, sf_dir, horizons=(21,), b=b), ["ticker", "event_date", "bucket", "s_entry"])
    return rounded(boards.net_summary(r, stage(st.capacity(p, b, "post"), "plans")), ["mean_gross", "mean_net", "median_net", "share_net_positive"])


@query("in_out_sample", f"""{RESULTS}, s AS (SELECT strategy, horizon, avg(pnl) FILTER (event_date < DATE '1999-01-01') AS in_mean, avg(pnl) FILTER (event_date >= DATE '1999-01-01') AS out_mean
  FROM long WHERE {BASE} AND horizon <> '0' GROUP BY ALL) SELECT strategy, horizon, round(in_mean, 6) AS in_mean, round(out_mean, 6) AS out_mean, sign(in_mean) = sign(out_mean) AS same_sign FROM s""")
def in_out_sample(spark, sf_dir):
    """Two study windows side by side."""
    r = st.long_strategies(sliced(spark, sf_dir), ["horizon", "event_date"])
    return rounded(boards.in_out(r, "1999-01-01"), ["in_mean", "out_mean"])
