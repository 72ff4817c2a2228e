"""Quote, session and account queries. Roles: events are quotes of an instrument (user); other events are orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import gates
from ..operators import accounts as ac, intervals as iv
from ..staging import stage
from .registry import query, table
from .study import rounded

QUOTES_CTE = """q AS (SELECT event_id AS quote_id, user_id AS instrument_id, ts AS at_ts, ts + to_microseconds((value * 100000000)::BIGINT) AS available_at, value AS bid, value * 1.01::DOUBLE AS ask, (value * 2)::INT % 40 AS bid_size, (value * 3)::INT % 50 AS ask_size FROM events WHERE event_type <> 'error'),
o AS (SELECT event_id AS order_id, user_id AS instrument_id, ts AS order_at, CASE WHEN value > 40 THEN 'buy' ELSE 'sell' END AS side, 1 + value::INT % 20 AS quantity FROM events WHERE event_type = 'error')"""


def quotes(spark, sf_dir):
    e = table(spark, sf_dir, "events").where("event_type <> 'error'")
    at = F.col("ts").cast("timestamp")
    v = F.col("value")
    return e.select(F.col("event_id").alias("quote_id"), F.col("user_id").alias("instrument_id"), at.alias("at"), F.timestamp_micros(F.unix_micros(at) + F.rint(v * 100_000_000).cast("bigint")).alias("available_at"), v.alias("bid"),
                    (v * 1.01).alias("ask"), (F.rint(v * 2).cast("int") % 40).alias("bid_size"), (F.rint(v * 3).cast("int") % 50).alias("ask_size"), F.lit("update").alias("evidence_kind"),
                    F.lit("USD").alias("currency"), F.lit(True).alias("raw_price"))


def orders(spark, sf_dir):
    e = table(spark, sf_dir, "events").where("event_type = 'error'")
    return e.select(F.col("event_id").alias("order_id"), F.col("user_id").alias("instrument_id"), F.col("ts").cast("timestamp").alias("order_at"), F.when(F.col("value") > 40, "buy").otherwise("sell").alias("side"),
                    (1 + F.rint("value").cast("int") % 20).alias("quantity"))


@query("quote_asof", f"""WITH {QUOTES_CTE}, c AS (SELECT order_id, arg_max(quote_id, (at_ts, available_at, quote_id)) AS quote_id FROM o JOIN q USING (instrument_id) WHERE at_ts <= order_at AND available_at <= order_at AND order_at - at_ts <= INTERVAL 6 HOUR AND bid_size > 0 AND ask_size > 0 AND bid > 0 GROUP BY 1)
SELECT order_id, c.quote_id, CASE WHEN c.quote_id IS NULL THEN 'entry_quote_missing' END AS reason FROM o LEFT JOIN c USING (order_id)""")
def quote_asof(spark, sf_dir):
    """J21."""
    return ac.entry_quote(orders(spark, sf_dir), quotes(spark, sf_dir), "instrument_id", "order_at", 6 * 3600.0).select("order_id", "quote_id", "reason")


@query("fill_price", f"""WITH {QUOTES_CTE}, c AS (SELECT order_id, arg_max(quote_id, (at_ts, available_at, quote_id)) AS quote_id, arg_max(CASE WHEN side = 'buy' THEN ask ELSE bid END, (at_ts, available_at, quote_id)) AS price FROM o JOIN q USING (instrument_id)
  WHERE at_ts <= order_at AND available_at <= order_at AND available_at >= at_ts AND order_at - at_ts <= INTERVAL 6 HOUR AND CASE WHEN side = 'buy' THEN ask_size ELSE bid_size END >= quantity GROUP BY 1)
SELECT order_id, c.quote_id, round(c.price, 8) AS price FROM o LEFT JOIN c USING (order_id)""")
def fill_price(spark, sf_dir):
    """Newest quote large enough for the order."""
    f = ac.fill_price(orders(spark, sf_dir), quotes(spark, sf_dir), "instrument_id", "order_id", "order_at", "side", "quantity", 6 * 3600.0)
    return rounded(f.select("order_id", "quote_id", "price"), ["price"], 8)


@query("quote_gate", f"""WITH {QUOTES_CTE} SELECT quote_id, CASE WHEN ask_size > 0 AND ask_size >= 5 AND available_at <= at_ts + INTERVAL 1 MINUTE THEN round(ask, 8) END AS buy_price, CASE WHEN bid_size > 0 AND bid_size >= 5 AND available_at <= at_ts + INTERVAL 1 MINUTE THEN round(bid, 8) END AS sell_price FROM q""")
def quote_gate(spark, sf_dir):
    """P20, F16: executable side prices one minute after the quote."""
    q = quotes(spark, sf_dir)
    cut = F.timestamp_micros(F.unix_micros("at") + 60_000_000)
    return q.select("quote_id", F.round(gates.executable(F.lit("buy"), F.lit(5), cut, 60.0), 8).alias("buy_price"), F.round(gates.executable(F.lit("sell"), F.lit(5), cut, 60.0), 8).alias("sell_price"))


def sessions(spark, sf_dir):
    d = table(spark, sf_dir, "events").select(F.to_date("ts").alias("d")).distinct()
    at = lambda h: F.timestamp_seconds(F.unix_date("d") * 86400 + h * 3600)
    return stage(d.select(F.date_format("d", "yyyyMMdd").alias("session_id"), at(9).alias("open_at"), at(16).alias("close_at")), "sessions")


SESS = "s AS (SELECT DISTINCT strftime(ts, '%Y%m%d') AS session_id, ts::DATE + INTERVAL 9 HOUR AS open_at, ts::DATE + INTERVAL 16 HOUR AS close_at FROM events)"


@query("session_range", f"WITH {SESS} SELECT event_id, session_id FROM events LEFT JOIN s ON ts BETWEEN open_at AND close_at")
def session_range(spark, sf_dir):
    """J22."""
    e = table(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("at"))
    return iv.within_session(e, sessions(spark, sf_dir), "at", "open_at", "close_at", ["session_id"]).select("event_id", "session_id")


@query("session_chronology", f"WITH {SESS}, l AS (SELECT *, lead(open_at) OVER (ORDER BY open_at) AS n FROM (SELECT session_id, open_at, CASE WHEN session_id LIKE '%5' THEN close_at + INTERVAL 1 DAY ELSE close_at END AS close_at FROM s)) SELECT session_id FROM l WHERE open_at >= close_at OR n <= close_at")
def session_chronology(spark, sf_dir):
    """W12."""
    s = sessions(spark, sf_dir)
    s = s.withColumn("close_at", F.when(F.col("session_id").endswith("5"), F.col("close_at") + F.expr("INTERVAL 1 DAY")).otherwise(F.col("close_at")))
    return iv.chronology_violations(s, "open_at", "close_at").select("session_id")


@query("next_session", f"""WITH {SESS}, n AS (SELECT event_id, min(open_at) AS open_at FROM events LEFT JOIN s ON open_at > ts + INTERVAL 300 SECOND GROUP BY 1)
SELECT event_id, session_id, CASE WHEN n.open_at IS NULL THEN 'next_session_missing' END AS reason FROM n LEFT JOIN s ON s.open_at = n.open_at""")
def next_session(spark, sf_dir):
    """J23."""
    e = table(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("at"))
    return ac.next_session(e, sessions(spark, sf_dir), "at", 300, 60, 300).select("event_id", "session_id", "reason")


@query("quote_consumption", """WITH a AS (SELECT l_partkey AS quote, l_returnflag AS side, l_orderkey, l_linenumber, l_quantity, sum(l_quantity) OVER (PARTITION BY l_partkey, l_returnflag ORDER BY l_orderkey, l_linenumber, l_shipdate, l_suppkey, l_quantity, l_extendedprice ROWS UNBOUNDED PRECEDING) AS used FROM lineitem)
SELECT quote, side, l_orderkey, l_linenumber, used, CASE WHEN used > 150 THEN 'quote_size_exhausted' END AS reason FROM a""")
def quote_consumption(spark, sf_dir):
    """Line items as orders against a part's size, first come first served."""
    o = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("quote"), F.col("l_returnflag").alias("side"), "l_orderkey", "l_linenumber", "l_shipdate", "l_suppkey", "l_extendedprice", "l_quantity", F.lit(150.0).alias("size"))
    c = ac.consume(o, "quote", "side", ["l_orderkey", "l_linenumber", "l_shipdate", "l_suppkey", "l_quantity", "l_extendedprice"], "l_quantity", "size", F.floor(F.col("l_orderkey") / 10_000))
    return c.select("quote", "side", "l_orderkey", "l_linenumber", "used", "reason")


@query("round_trip_cash", """SELECT l_orderkey, l_linenumber, CASE WHEN l_linestatus = 'O' THEN 1 ELSE -1 END * l_quantity * 100.0::DOUBLE * (l_tax - l_discount) - 1.5 AS cash_gain FROM lineitem""")
def round_trip_cash(spark, sf_dir):
    """P34."""
    side = F.when(F.col("l_linestatus") == "O", "long").otherwise("short")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", ac.round_trip(F.col("l_discount"), F.col("l_tax"), F.col("l_quantity"), F.lit(100.0), side, F.lit(1.5)).alias("cash_gain"))


@query("settlement_flows", """WITH m AS (SELECT l_suppkey AS leg, l_shipdate::DATE AS day, max(l_extendedprice) AS mark FROM lineitem GROUP BY ALL), f AS (SELECT *, mark - lag(mark) OVER w AS d, lead(day) OVER w IS NULL AS last FROM m WINDOW w AS (PARTITION BY leg ORDER BY day))
SELECT leg, day, round(-2.0::DOUBLE * 10 * d - CASE WHEN last THEN 3.0 ELSE 0 END, 4) AS flow FROM f WHERE d IS NOT NULL""")
def settlement_flows(spark, sf_dir):
    """W10."""
    m = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("leg"), F.to_date("l_shipdate").alias("day")).agg(F.max("l_extendedprice").alias("mark"))
    m = m.withColumns({"side": F.lit("short"), "quantity": F.lit(2.0), "multiplier": F.lit(10.0), "costs": F.lit(3.0)})
    return rounded(ac.settlement_flows(m, ["leg"], "day", "mark").select("leg", "day", "flow"), ["flow"], 4)


@query("reconcile_trades", """WITH x AS (SELECT o_orderkey AS id, o_orderdate AS t FROM orders WHERE o_orderpriority <> '1-URGENT'), t AS (SELECT o_orderkey AS id, o_totalprice AS g FROM orders WHERE o_orderpriority <> '2-HIGH'),
r AS (SELECT o_orderkey AS id, CASE WHEN o_orderstatus = 'P' THEN o_orderdate + INTERVAL 1 DAY ELSE o_orderdate END AS t FROM orders WHERE o_orderpriority <> '5-LOW')
SELECT o_orderkey AS decision_id, t.g AS cash_gain, CASE WHEN x.id IS NULL OR t.id IS NULL THEN 'trade_exit_reconciliation' WHEN r.id IS NULL THEN 'order_trade_reconciliation' WHEN r.t <> x.t THEN 'order_exit_reconciliation' END AS reason
FROM orders o LEFT JOIN x ON x.id = o_orderkey LEFT JOIN t ON t.id = o_orderkey LEFT JOIN r ON r.id = o_orderkey""")
def reconcile_trades(spark, sf_dir):
    """J24."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("decision_id"), F.col("o_orderdate").cast("timestamp").alias("at"), F.col("o_totalprice").alias("cash_gain"), "o_orderpriority", "o_orderstatus")
    planned = F.when(F.col("o_orderstatus") == "P", F.col("at") + F.expr("INTERVAL 1 DAY")).otherwise(F.col("at"))
    return ac.reconcile_trades(o.where("o_orderpriority <> '1-URGENT'"), o.where("o_orderpriority <> '2-HIGH'"), o.where("o_orderpriority <> '5-LOW'").withColumn("exit_at", planned))


NAV_CTE = """d AS (SELECT o_orderpriority AS account, o_orderdate::DATE AS day, sum(round(o_totalprice * 100)::BIGINT)::BIGINT / 100.0 AS gain FROM orders GROUP BY ALL), p AS (SELECT *, row_number() OVER (PARTITION BY account ORDER BY day) AS period, sum(gain) OVER (PARTITION BY account ORDER BY day) AS total FROM d),
m AS (SELECT *, 1000000.0::DOUBLE + total + CASE WHEN period % 97 = 0 THEN 1 ELSE 0 END AS nav0, 1000000.0::DOUBLE + total AS eq FROM p WHERE period % 61 <> 0),
j AS (SELECT p.account, p.period, p.day, m.nav0, m.eq, p.gain, m.period IS NULL AS missing FROM p LEFT JOIN m USING (account, period)),
r AS (SELECT *, CASE WHEN missing THEN 'missing_mark' WHEN abs(nav0 - eq) > 0.001 THEN 'mark_ledger_mismatch' END AS r1 FROM j), n AS (SELECT *, CASE WHEN r1 IS NULL THEN nav0 END AS nav FROM r), k AS (SELECT *, CASE WHEN period = 1 THEN 1000000.0 ELSE lag(nav) OVER (PARTITION BY account ORDER BY period) END AS prev FROM n)"""


def nav_inputs(spark, sf_dir):
    from pyspark.sql import Window as W
    o = table(spark, sf_dir, "orders")
    d = o.groupBy(F.col("o_orderpriority").alias("account"), F.to_date("o_orderdate").alias("day")).agg((F.sum(F.round(F.col("o_totalprice") * 100).cast("bigint")) / 100).alias("gain"))
    w = W.partitionBy("account").orderBy("day")   # one row per account and day
    p = stage(d.withColumn("period", F.row_number().over(w)).withColumn("total", F.sum("gain").over(w.rowsBetween(W.unboundedPreceding, 0))), "periods")
    sid = F.date_format("day", "yyyyMMdd")
    s = p.select("account", "period", sid.alias("session_id"), F.col("day").alias("close_at"))
    m = p.where("period % 61 <> 0").select("account", "period", sid.alias("mark_session"), F.col("day").alias("mark_at"), (1e6 + F.col("total") + F.when(F.col("period") % 97 == 0, 1).otherwise(0)).alias("nav"))
    g = p.select("account", "period", "gain", (1e6 + F.col("total")).alias("final_equity"), F.lit(True).alias("is_flat"))
    return s, m, g


@query("nav_panel", f"""WITH {NAV_CTE} SELECT account, period::INT AS period, strftime(day, '%Y%m%d') AS session_id, round(nav, 2) AS nav, round(CASE WHEN nav IS NOT NULL AND prev IS NOT NULL THEN nav / prev - 1 END, 9) AS net_return,
  CASE WHEN nav IS NULL THEN r1 WHEN prev IS NULL THEN 'prior_nav_missing' END AS reason FROM k""")
def nav_panel(spark, sf_dir):
    """J25, W11."""
    return rounded(rounded(ac.nav_panel(*nav_inputs(spark, sf_dir), ["account"], 1e6, off=0.001), ["nav"], 2), ["net_return"], 9)


@query("account_sharpe", f"""WITH {NAV_CTE}, x AS (SELECT account, CASE WHEN nav IS NOT NULL AND prev IS NOT NULL THEN nav / prev - 1 END AS r FROM k)
SELECT account, count(r) AS periods, round(avg(r) * sqrt(252) / stddev_samp(r), 6) AS sharpe, round(avg((r > 0)::INT), 6) AS win_rate FROM x GROUP BY 1""")
def account_sharpe(spark, sf_dir):
    """A29."""
    return rounded(ac.account_sharpe(ac.nav_panel(*nav_inputs(spark, sf_dir), ["account"], 1e6, off=0.001), ["account"], 60), ["sharpe", "win_rate"])


@query("gate_reasons", """WITH c AS (SELECT c_custkey, CASE WHEN c_nationkey = 4 THEN 'dup' ELSE c_custkey::VARCHAR END AS id, c_nationkey, c_acctbal, c_mktsegment FROM customer), n AS (SELECT id, count(*) AS n FROM c GROUP BY 1)
SELECT c_custkey, list_filter([CASE WHEN n > 1 THEN 'duplicate_candidate_id' END, CASE WHEN c_nationkey = 7 THEN 'security_id' END, CASE WHEN c_nationkey = 9 THEN 'source_sha256' END, CASE WHEN c_mktsegment = 'HOUSEHOLD' THEN 'event_form' END, CASE WHEN c_mktsegment = 'MACHINERY' THEN 'event_item' END,
  CASE WHEN abs(c_acctbal / 5000) > 1 THEN 'signal' END, CASE WHEN c_nationkey = 11 THEN 'source_quality' END, CASE WHEN c_nationkey < 2 THEN 'before_study' END, CASE WHEN c_nationkey > 22 THEN 'protected_period' END, CASE WHEN c_acctbal < 0 THEN 'cost_evidence' END, CASE WHEN c_nationkey = 13 THEN 'borrow_or_collateral' END], lambda x: x IS NOT NULL) AS reasons
FROM c JOIN n USING (id)""")
def gate_reasons(spark, sf_dir):
    """Every reason of every candidate."""
    return assessed(spark, sf_dir).select("c_custkey", "reasons")


PROTOCOL = dict(event_form="8-K", event_item="2.02", signal_document_role="earnings_release", signal_recipe_id="r1", date_from="2024-01-01", protected_from="2025-01-01", horizon_id="intraday")


def assessed(spark, sf_dir):
    c, nk = table(spark, sf_dir, "customer"), F.col("c_nationkey")
    ok = F.lit("qualified")
    ts = lambda s: F.lit(s).cast("timestamp")
    public = F.when(nk < 2, ts("2023-05-01 10:00:00")).when(nk > 22, ts("2025-05-01 10:00:00")).otherwise(ts("2024-05-01 10:00:00"))
    fee = F.when(F.col("c_acctbal") < 0, -1.0).otherwise(1.0)
    cand = c.select(
        "c_custkey", F.when(nk == 4, "dup").otherwise(F.col("c_custkey").cast("string")).alias("candidate_id"), F.col("c_custkey").cast("string").alias("cik"), F.col("c_custkey").cast("string").alias("accession"),
        F.when(nk == 7, "").otherwise("S").alias("security_id"), F.when(nk == 9, "zz").otherwise(F.sha2("c_name", 256)).alias("source_sha256"), F.when(F.col("c_mktsegment") == "HOUSEHOLD", "10-K").otherwise("8-K").alias("form"),
        F.when(F.col("c_mktsegment") == "MACHINERY", F.array(F.lit("9.01"))).otherwise(F.array(F.lit("2.02"), F.lit("9.01"))).alias("items"), F.lit("earnings_release").alias("signal_document_role"), F.lit("r1").alias("signal_recipe_id"),
        (F.col("c_acctbal") / 5000).alias("signal"), F.when(nk == 11, "unknown").otherwise(ok).alias("source_quality"), ok.alias("public_clock_quality"), ok.alias("model_vintage_quality"), ok.alias("identity_quality"), public.alias("public_by_utc"),
        F.struct(F.lit(True).alias("qualified"), F.lit("verified_none").alias("status"), F.lit("intraday").alias("horizon_id"), F.lit(None).cast("string").alias("security_id"), public.alias("available_at_utc"), public.alias("start_at_utc"), public.alias("end_at_utc")).alias("corporate_actions"),
        F.struct(F.lit(True).alias("qualified"), F.lit("USD").alias("currency"), fee.alias("entry_fee"), fee.alias("exit_fee"), F.lit(0.0).alias("entry_slippage"), F.lit(0.0).alias("exit_slippage"), public.alias("available_at_utc"), public.alias("valid_through_utc")).alias("costs"),
        F.struct((nk != 13).alias("qualified"), F.lit(5.0).alias("quantity"), F.lit(0.1).alias("total_fee"), public.alias("available_at_utc"), public.alias("valid_through_utc")).alias("borrow"), F.lit(10.0).alias("margin"), public.alias("margin_available_at_utc"))
    return ac.candidate_reasons(cand, PROTOCOL)


@query("reason_counts", """WITH c AS (SELECT c_nationkey AS k FROM customer) SELECT CASE WHEN k = 3 THEN 'excluded' ELSE 'eligible' END AS reason, count(*) AS n FROM c GROUP BY 1 UNION ALL SELECT 'nation', count(*) FILTER (k = 3) FROM c UNION ALL SELECT 'received', count(*) FROM c""")
def reason_counts(spark, sf_dir):
    """A43."""
    c = table(spark, sf_dir, "customer").select(gates.reasons(nation=F.col("c_nationkey") == 3).alias("reasons"))
    return ac.reason_counts(c)


@query("protected_payload", f"""WITH {QUOTES_CTE} SELECT instrument_id, bool_or(year(at_ts) >= 2024 AND month(available_at) >= 2) AS protected FROM q GROUP BY 1""")
def protected_payload(spark, sf_dir):
    """Instruments whose quotes reach past the cutoff (clocks shifted so that February is the protected year)."""
    q = quotes(spark, sf_dir)
    shifted = q.select("instrument_id", F.col("at"), F.when(F.month("available_at") >= 2, F.add_months("available_at", 12)).otherwise(F.to_date("available_at")).alias("available_at"))
    return ac.protected_payload(shifted, ["instrument_id"])


@query("availability_clock", """WITH e AS (SELECT event_id, ts, value, CASE WHEN event_type IN ('click', 'view') THEN 'observed' WHEN event_type = 'signup' THEN 'other' ELSE 'historical_replay' END AS mode FROM events),
r AS (SELECT *, CASE mode WHEN 'observed' THEN CASE WHEN value > 90 THEN 'observed_clock_missing' WHEN value < 10 THEN 'observed_order_invalid' END WHEN 'historical_replay' THEN CASE WHEN value > 100 THEN 'latency_assumption_missing' WHEN value > 60 THEN 'replay_precedes_latency' END ELSE 'mode' END AS reason FROM e)
SELECT event_id, reason, CASE WHEN reason IS NULL THEN epoch_us(ts) + CASE mode WHEN 'observed' THEN 20000000 ELSE 60000000 END END AS available_us FROM r""")
def availability_clock(spark, sf_dir):
    """P17."""
    v, t = F.col("value"), F.col("ts").cast("timestamp")
    plus = lambda s: F.timestamp_micros(F.unix_micros(t) + s * 1_000_000)
    e = table(spark, sf_dir, "events").select(
        "event_id", F.when(F.col("event_type").isin("click", "view"), "observed").when(F.col("event_type") == "signup", "other").otherwise("historical_replay").alias("mode"), t.alias("public_at"),
        F.when(v <= 90, F.when(v < 10, plus(30)).otherwise(plus(10))).alias("received_at"), plus(20).alias("processed_at"), F.when(v <= 100, F.when(v > 60, 90).otherwise(60)).alias("latency_seconds"), plus(60).alias("assumed_at"))
    clock, reason = gates.available_at()
    return e.select("event_id", reason.alias("reason"), F.unix_micros(clock).alias("available_us"))


@query("trade_gates", """WITH t AS (SELECT l_orderkey, l_linenumber, CASE l_returnflag WHEN 'A' THEN 'equity' WHEN 'R' THEN 'futures' ELSE 'option' END AS asset, CASE WHEN l_linestatus = 'O' THEN 'long' ELSE 'short' END AS side, CASE WHEN l_linenumber = 3 THEN l_quantity + 0.5 ELSE l_quantity END AS qty, l_discount AS m FROM lineitem)
SELECT l_orderkey, l_linenumber, list_filter([CASE WHEN l_linenumber = 5 THEN 'invalid_trade_interval' END, CASE WHEN asset <> 'equity' AND l_linenumber = 3 THEN 'whole_contract_quantity_required' END, CASE WHEN asset = 'equity' AND l_linenumber = 3 THEN 'unregistered_fractional_equity_policy' END,
  CASE WHEN side = 'short' AND asset <> 'futures' AND (asset <> 'equity' OR qty > 40) THEN 'unknown_borrow' END, CASE WHEN (asset = 'futures' OR (asset = 'equity' AND side = 'short')) AND m <= 0 THEN 'dated_margin_collateral_required' END], lambda x: x IS NOT NULL) AS reasons FROM t""")
def trade_gates(spark, sf_dir):
    """P22."""
    li, t0 = table(spark, sf_dir, "lineitem"), F.col("l_shipdate").cast("timestamp")
    rows = li.select("l_orderkey", "l_linenumber", t0.alias("decision_at"), t0.alias("entry_at"), F.when(F.col("l_linenumber") == 5, t0).otherwise(t0 + F.expr("INTERVAL 1 DAY")).alias("exit_at"),
                     F.when(F.col("l_returnflag") == "A", "equity").when(F.col("l_returnflag") == "R", "futures").otherwise("option").alias("asset_class"), F.when(F.col("l_linestatus") == "O", "long").otherwise("short").alias("side"),
                     (F.col("l_quantity") + F.when(F.col("l_linenumber") == 3, 0.5).otherwise(0.0)).alias("quantity"), F.lit(1.0).alias("multiplier"), F.col("l_discount").alias("margin"), t0.alias("margin_at"),
                     F.struct(F.lit(True).alias("qualified"), t0.alias("available_at"), (t0 + F.expr("INTERVAL 9 DAY")).alias("valid_through"), F.lit(40.0).alias("quantity")).alias("borrow"))
    return rows.select("l_orderkey", "l_linenumber", gates.trade_reasons().alias("reasons"))


@query("decision_rules", """SELECT o_orderkey, list_filter([CASE WHEN o_orderstatus = 'P' THEN 'empty_identity' END, CASE WHEN o_orderpriority = '5-LOW' THEN 'invalid_scope_or_mode' END, CASE WHEN o_orderpriority = '1-URGENT' AND o_custkey % 2 = 0 THEN 'issuer_identity' END,
  CASE WHEN o_orderpriority = '2-HIGH' AND o_custkey % 2 = 1 THEN 'market_identity' END, CASE WHEN o_orderpriority = '3-MEDIUM' AND o_custkey % 3 = 0 THEN 'portfolio_identity' END, CASE WHEN o_totalprice > 400000 THEN 'cutoff_after_decision' END, CASE WHEN o_totalprice < 20000 THEN 'outcome_before_decision' END], lambda x: x IS NOT NULL) AS reasons
FROM (SELECT * REPLACE (CASE WHEN o_orderpriority NOT IN ('1-URGENT', '2-HIGH', '3-MEDIUM') THEN '5-LOW' ELSE o_orderpriority END AS o_orderpriority) FROM orders)""")
def decision_rules(spark, sf_dir):
    """P16."""
    o, c = table(spark, sf_dir, "orders"), F.col
    odd, t = c("o_custkey") % 2 == 1, c("o_orderdate").cast("timestamp")
    nul = F.lit(None).cast("string")
    rows = o.select("o_orderkey", F.when(c("o_orderstatus") == "P", "").otherwise("d").alias("decision_id"), F.lit("s").alias("session_id"), F.lit("h").alias("horizon_id"),
                    F.when(c("o_orderpriority") == "1-URGENT", "issuer").when(c("o_orderpriority") == "2-HIGH", "market").when(c("o_orderpriority") == "3-MEDIUM", "portfolio").otherwise("galaxy").alias("scope_type"), F.lit("observed").alias("mode"),
                    F.lit(False).alias("document_only"), F.when(c("o_orderpriority") == "2-HIGH", F.when(odd, "1")).otherwise("1").alias("cik"), F.when((c("o_orderpriority") != "1-URGENT") | odd, "S").alias("security_id"), nul.alias("identity_quality"),
                    nul.alias("asset_class"), F.lit("I").alias("instrument_id"), F.when(c("o_custkey") % 3 != 0, "P").alias("portfolio_id"), t.alias("decision_at"),
                    F.when(c("o_totalprice") > 400000, t + F.expr("INTERVAL 1 DAY")).otherwise(t).alias("information_cutoff"), F.when(c("o_totalprice") < 20000, t).otherwise(t + F.expr("INTERVAL 1 DAY")).alias("outcome_end"))
    return rows.select("o_orderkey", gates.decision_reasons().alias("reasons"))
