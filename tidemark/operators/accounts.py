"""Quotes, trades and account panels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from ..constants import SESSIONS_PER_YEAR
from ..functions import gates
from ..functions.scalars import finite
from ..staging import stage
from .asof import epoch_bucket, prefix_max, running_total


#: Children of a node of the size tree, and its levels at most: whole sizes below _FAN ** _LEVELS are leaves of their own.
_FAN, _LEVELS = 8, 7


def entry_quote(orders: DataFrame, quotes: DataFrame, key: str, at: str, max_age: float, bucket_seconds: int = 3600) -> DataFrame:
    """Latest usable quote known at the clock, not older than `max_age` seconds.

    A quote counts from the moment it is both stamped and available; among those the greatest (event, available,
    id) wins, so the lookup is a running maximum over visible times.
    """
    usable = quotes.where(F.col("raw_price") & (F.col("currency") == "USD") & (F.col("evidence_kind") == "update") & finite(F.col("bid")) & finite(F.col("ask"))
                          & (F.col("bid") > 0) & (F.col("bid") <= F.col("ask")) & (F.col("bid_size") > 0) & (F.col("ask_size") > 0))
    v = usable.withColumn("_seen", F.greatest("at", "available_at"))
    best = F.struct(F.col("at").alias("quote_at"), F.col("available_at").alias("quote_available"), "quote_id", "bid", "ask", "bid_size", "ask_size")
    got = prefix_max(orders, v, [key], at, "_seen", best, "_q", epoch_bucket(bucket_seconds))
    fresh = F.col("_q").isNotNull() & ((F.unix_micros(at) - F.unix_micros("_q.quote_at")) / 1e6 <= max_age)
    got = got.withColumn("_q", F.when(fresh, F.col("_q")))
    return got.select(*orders.columns, "_q.*").withColumn("reason", F.when(F.col("quote_id").isNull(), "entry_quote_missing"))


def fill_price(orders: DataFrame, quotes: DataFrame, key: str, oid: str, at: str, side: str, quantity: str, max_age: float) -> DataFrame:
    """Most recent quote that can serve the whole order on its side.

    Nearly all orders are served by the latest visible quote. For the others the question is the latest quote of at least a size. Whole sizes are
    leaves of a tree of _FAN children a node: a quote stands in its node of every level, and the sizes from an order's quantity on are at
    most _FAN - 1 whole nodes a level. Each is a plain as-of lookup (running maxima per key, side and node), so no order meets all quotes of a
    hot key. Only a quantity that is no whole number, or beyond the tree, also looks at the one leaf that its bound cuts.
    """
    q = quotes.where((F.col("available_at") >= F.col("at")) & (F.col("bid") <= F.col("ask")) & (F.col("evidence_kind") == "update"))
    q = stage(q.withColumn("_seen", F.greatest("at", "available_at")).withColumn("_size", F.greatest("bid_size", "ask_size")).where("_size > 0"), "quotes")
    fields = [F.col("at").alias("quote_at"), F.col("available_at").alias("quote_available"), "quote_id", "bid", "ask", "bid_size", "ask_size"]
    best = F.struct(*fields)
    age = lambda c: (F.unix_micros(F.col(at)) - F.unix_micros(c)) / 1e6
    buy = F.col(side) == "buy"
    ok = lambda p: F.when(buy, F.col(f"{p}ask_size")).otherwise(F.col(f"{p}bid_size")) >= F.col(quantity)
    price = lambda p: F.when(buy, F.col(f"{p}ask")).otherwise(F.col(f"{p}bid"))
    first = stage(prefix_max(orders, q, [key], at, "_seen", best, "_q", epoch_bucket(3600)), "latest")
    known = F.col("_q").isNotNull() & (age(F.col("_q.quote_at")) <= max_age)
    served = first.where(known & ok("_q.")).select(*orders.columns, price("_q.").alias("price"), F.col("_q.quote_id").alias("quote_id"))
    small = stage(first.where(known & ~ok("_q.")).select(*orders.columns), "small_orders")
    none = first.where(~F.coalesce(known, F.lit(False))).select(*orders.columns, F.lit(None).cast("double").alias("price"), F.lit(None).cast(quotes.schema["quote_id"].dataType).alias("quote_id"))
    # quotes in the tree, by the side that takes them; it is as deep as the largest of these orders asks (one number comes to the driver)
    need = F.greatest(F.ceil(F.col(quantity)), F.lit(0)).cast("bigint")
    largest, depth = small.agg(F.max(need)).first()[0] or 0, 1
    while depth < _LEVELS and _FAN ** depth - 1 < largest:
        depth += 1
    bits, top = _FAN.bit_length() - 1, _FAN ** depth - 1
    leaf = lambda c: F.least(F.floor(c), F.lit(top)).cast("bigint")
    sides = F.explode(F.array(*[F.struct(F.lit(b).alias("_buy"), leaf(F.col(c)).alias("_leaf")) for b, c in ((True, "ask_size"), (False, "bid_size"))])).alias("_s")
    placed = q.join(small.select(key).distinct(), key, "left_semi").select("*", sides).select("*", "_s.*").where("_leaf >= 0")
    levels = [F.struct(F.lit(l).alias("_level"), F.shiftright("_leaf", bits * l).alias("_node")) for l in range(depth)]
    in_tree = placed.select(key, "_buy", "_seen", best.alias("_best"), F.inline(F.array(*levels)))

    def later(l):
        own = F.shiftright("_need", bits * l)
        start, end = own + (0 if l == 0 else 1), own + (_FAN - 1) - own % _FAN
        return F.when(start <= end, F.transform(F.sequence(start, end), lambda n: F.struct(F.lit(l).alias("_level"), n.alias("_node")))).otherwise(F.array().cast("array<struct<_level:int,_node:bigint>>"))

    asked = small.select(F.col(oid), F.col(key), F.col(at), buy.alias("_buy"), need.alias("_need")).where(F.col("_need") <= top)
    asked = asked.select(oid, key, at, "_buy", F.inline(F.flatten(F.array(*[later(l) for l in range(depth)]))))
    met = prefix_max(asked, in_tree, [key, "_buy", "_level", "_node"], at, "_seen", F.col("_best"), "_q", epoch_bucket(3600)).where("_q IS NOT NULL").select(oid, "_q")
    # the leaf that a broken quantity cuts
    cut = small.where((F.col(quantity) != F.floor(F.col(quantity))) | (need > top)).select("*", buy.alias("_buy"), leaf(F.col(quantity)).alias("_leaf"))
    width = int(max(max_age, 1))
    b = lambda c: F.floor(F.unix_micros(c) / (width * 1_000_000))
    s = cut.withColumn("_b", F.explode(F.array(b(F.col(at)) - 1, b(F.col(at)))))
    c = s.join(placed.select(key, "_buy", "_leaf", b(F.col("at")).alias("_b"), best.alias("_q"), "_seen"), [key, "_buy", "_leaf", "_b"])
    edge = c.where((F.col("_seen") <= F.col(at)) & ok("_q.")).select(oid, "_q")
    pick = met.unionByName(edge).groupBy(oid).agg(F.max("_q").alias("_q"))
    back = small.join(pick, oid, "left").withColumn("_q", F.when(age(F.col("_q.quote_at")).between(0, max_age), F.col("_q")))
    return served.unionByName(back.select(*orders.columns, price("_q.").alias("price"), F.col("_q.quote_id").alias("quote_id"))).unionByName(none)


def next_session(public: DataFrame, sessions: DataFrame, at: str, latency: int, entry_delay: int, exit_before: int) -> DataFrame:
    """First session opening after public time plus latency, with entry and exit clocks and a reason.

    Sessions become a dense per-day lookup (that day's sessions and the next later one), which is calendar-bounded
    and broadcast; the rows themselves are neither sorted nor shuffled.
    """
    one = F.struct("open_at", "close_at", "session_id")
    per_day = sessions.groupBy(F.to_date("open_at").alias("_d")).agg(F.array_sort(F.collect_list(one)).alias("_today"))
    span = per_day.agg(F.min("_d").alias("a"), F.max("_d").alias("z"))
    days = span.select(F.explode(F.sequence("a", "z")).alias("_d")).join(per_day, "_d", "left")
    later = W.partitionBy(F.lit(0)).orderBy("_d").rowsBetween(1, W.unboundedFollowing)
    days = days.select("_d", "_today", F.first(F.col("_today")[0], True).over(later).alias("_later"))
    p = public.withColumn("_ready", F.col(at) + F.make_dt_interval(secs=F.lit(latency)))
    p = p.withColumn("_d", F.greatest(F.to_date("_ready"), span.select("a").scalar()))
    j = p.join(F.broadcast(days), "_d", "left")
    got = j.withColumn("_s", F.coalesce(F.get(F.filter("_today", lambda x: x["open_at"] > F.col("_ready")), F.lit(0)), F.col("_later")))
    got = got.select(*public.columns, "_s.open_at", "_s.close_at", "_s.session_id")
    got = got.withColumn("entry_at", F.col("open_at") + F.make_dt_interval(secs=F.lit(entry_delay))).withColumn("exit_at", F.col("close_at") - F.make_dt_interval(secs=F.lit(exit_before)))
    return got.withColumn("reason", F.when(F.col("open_at").isNull(), "next_session_missing").when(F.col("entry_at") >= F.col("exit_at"), "session_too_short"))


def candidate_reasons(c: DataFrame, protocol: dict) -> DataFrame:
    """Every exclusion reason per candidate; all copies of a duplicate id or (cik, accession) are refused.

    Duplicates are found by partial aggregation and joined back, so a hot key is never windowed.
    """
    f = F.col
    ids = c.groupBy("candidate_id").agg(F.count("*").alias("_n1")).where("_n1 > 1")
    keys = c.groupBy("cik", "accession").agg(F.count("*").alias("_n2")).where("_n2 > 1")
    d = c.join(ids, "candidate_id", "left").join(keys, ["cik", "accession"], "left")
    rules = dict(candidate_id=gates.absent(f("candidate_id")), duplicate_candidate_id=f("_n1").isNotNull(), cik=gates.absent(f("cik")), accession=gates.absent(f("accession")),
                 security_id=gates.absent(f("security_id")), source_sha256=~f("source_sha256").rlike("^[0-9a-fA-F]{64}$"), event_form=f("form") != protocol["event_form"],
                 event_item=~F.array_contains("items", protocol["event_item"]), signal_document_role=f("signal_document_role") != protocol["signal_document_role"],
                 signal_recipe_id=f("signal_recipe_id") != protocol["signal_recipe_id"], signal=~(finite(f("signal")) & f("signal").between(-1, 1)))
    rules.update({k: f(k) != "qualified" for k in ("source_quality", "public_clock_quality", "model_vintage_quality", "identity_quality")})
    day = F.to_date("public_by_utc")
    rules.update(public_clock=f("public_by_utc").isNull(), before_study=F.coalesce(day < F.lit(protocol["date_from"]).cast("date"), F.lit(False)),
                 protected_period=F.coalesce(day >= F.lit(protocol["protected_from"]).cast("date"), F.lit(False)),
                 corporate_actions=~gates.corporate_actions_ok(f("corporate_actions"), protocol["horizon_id"], f("security_id")), cost_evidence=~gates.costs_ok(f("costs")),
                 borrow_or_collateral=~gates.borrow_ok(f("borrow"), f("margin"), f("margin_available_at_utc")), duplicate_event_security=f("_n2").isNotNull())
    return d.withColumn("reasons", gates.reasons(**rules)).withColumn("eligible", F.size("reasons") == 0).drop("_n1", "_n2")


def reason_counts(assessed: DataFrame) -> DataFrame:
    """Eligible, excluded and received totals with one row per reason."""
    e = assessed.select(F.explode(F.when(F.size("reasons") == 0, F.array(F.lit("eligible"))).otherwise(F.concat(F.array(F.lit("excluded")), "reasons"))).alias("reason"))
    return e.groupBy("reason").agg(F.count("*").alias("n")).unionByName(assessed.agg(F.lit("received").alias("reason"), F.count("*").alias("n")))


def protected_payload(quotes: DataFrame, keys: Sequence[str], cutoff_year: int = 2025) -> DataFrame:
    """A set is refused when any of its clocks lies in or after the cutoff year."""
    late = (F.year("at") >= cutoff_year) | (F.year("available_at") >= cutoff_year)
    return quotes.groupBy(*keys).agg(F.bool_or(F.coalesce(late, F.lit(True))).alias("protected"))


def round_trip(entry: Column, exit_: Column, quantity: Column, multiplier: Column, side: Column, costs: Column) -> Column:
    """P34."""
    ok = finite(entry) & finite(exit_) & (quantity > 0) & (multiplier > 0) & (costs >= 0) & side.isin("long", "short")
    return F.when(ok, F.when(side == "long", 1).otherwise(-1) * quantity * multiplier * (exit_ - entry) - costs)


def settlement_flows(marks: DataFrame, leg: Sequence[str], at: str, mark: str) -> DataFrame:
    """Cash flow per settlement; costs are charged once, on the leg's last mark.

    A leg has one mark per settlement session, so its window is calendar-bounded. Needs side, quantity, multiplier, costs.
    """
    w = W.partitionBy(*leg).orderBy(at)
    sign = F.when(F.col("side") == "long", 1).otherwise(-1)
    flow = sign * F.col("quantity") * F.col("multiplier") * (F.col(mark) - F.lag(mark).over(w))
    m = marks.withColumn("flow", flow).withColumn("_last", F.lead(at).over(w).isNull())
    return m.withColumn("flow", F.col("flow") - F.when(F.col("_last"), F.col("costs")).otherwise(0.0)).where("flow IS NOT NULL").drop("_last")


def consume(orders: DataFrame, quote: str, side: str, order: Sequence[str], quantity: str, size: str, bucket: Column) -> DataFrame:
    """First-come use of a quote's size; orders past the size are refused.

    The running sum is carried over buckets, so a quote hit by very many orders is not one task's work.
    """
    r = running_total(orders, [quote, side], order, quantity, "used", bucket)
    return r.withColumn("reason", F.when(F.col("used") > F.col(size), "quote_size_exhausted"))


def reconcile_trades(exits: DataFrame, trades: DataFrame, orders: DataFrame) -> DataFrame:
    """Exits, trades and reserved orders matched on decision_id; every mismatch is a named reason."""
    x = exits.groupBy("decision_id").agg(F.count("*").alias("n_exit"), F.max("at").alias("exit_at"))
    t = trades.groupBy("decision_id").agg(F.count("*").alias("n_trade"), F.sum("cash_gain").alias("cash_gain"), F.bool_and(finite(F.col("cash_gain"))).alias("_fin"))
    o = orders.groupBy("decision_id").agg(F.count("*").alias("n_order"), F.max("exit_at").alias("order_exit"))
    j = x.join(t, "decision_id", "full_outer").join(o, "decision_id", "full_outer")
    reason = (F.when(F.col("n_exit") > 1, "invalid_or_duplicate_exit").when((F.col("n_trade") > 1) | ~F.col("_fin"), "invalid_trade_gain_evidence")
              .when(F.col("n_exit").isNull() | F.col("n_trade").isNull(), "trade_exit_reconciliation").when(F.col("n_order").isNull() | (F.col("n_order") > 1), "order_trade_reconciliation")
              .when(F.col("order_exit") != F.col("exit_at"), "order_exit_reconciliation"))
    return j.select("decision_id", "cash_gain", reason.alias("reason"))


def nav_panel(sessions: DataFrame, marks: DataFrame, daily: DataFrame, account: Sequence[str], initial: float, off: float | None = None) -> DataFrame:
    """NAV, return and reason per account and session.

    sessions: account keys, period, session_id, close_at. marks: account keys, period, mark_session, mark_at, nav. daily: account keys,
    period, gain, final_equity, is_flat (last ledger row of the session). Windows cover one account's sessions.
    A mark is the ledger's within `off` units, however large both are; without it within a share of 1e-10.
    """
    k = [*account, "period"]
    j = sessions.join(marks, k, "left").join(daily, k, "left")
    near = lambda a, b: F.abs(a - b) <= F.greatest(1e-10 * F.greatest(F.abs(a), F.abs(b)), F.lit(1e-6))
    marked = near(F.col("nav"), F.col("final_equity")) if off is None else F.abs(F.col("nav") - F.col("final_equity")) <= off
    w = W.partitionBy(*account).orderBy("period")
    open_position = F.coalesce(~F.col("is_flat"), F.lit(False))
    j = j.withColumn("_locked", F.coalesce(F.max(open_position.cast("int")).over(w.rowsBetween(W.unboundedPreceding, -1)) == 1, F.lit(False)))
    reason = (F.when(open_position, "unresolved_position_or_ledger").when(F.col("_locked"), "prior_unresolved_position").when(F.col("mark_session").isNull(), "missing_mark")
              .when(F.col("mark_session") != F.col("session_id"), "mark_session_mismatch").when(~F.col("mark_at").eqNullSafe(F.col("close_at")), "mark_timestamp_mismatch")
              .when(F.col("nav").isNull(), "missing_nav").when(~finite(F.col("nav")) | (F.col("nav") <= 0), "nonpositive_nav")
              .when(F.col("final_equity").isNotNull() & ~marked, "mark_ledger_mismatch"))
    j = j.withColumn("reason", reason).withColumn("nav", F.when(F.col("reason").isNull(), F.col("nav")))
    prev = F.when(F.row_number().over(w) == 1, F.lit(initial)).otherwise(F.lag("nav").over(w))
    j = j.withColumn("_prev", prev)
    delta, gain = F.col("nav") - F.col("_prev"), F.coalesce("gain", F.lit(0.0))
    quiet = F.col("final_equity").isNull() & ~near(F.col("nav"), F.col("_prev"))
    r2 = (F.when(F.col("nav").isNull(), F.col("reason")).when(F.col("_prev").isNull(), "prior_nav_missing").when(quiet, "unreconciled_no_trade_nav")
          .when(~near(delta, gain), "trade_gain_nav_mismatch"))
    j = j.withColumn("reason", r2)
    ret = F.when(F.col("reason").isNull(), F.col("nav") / F.col("_prev") - 1)
    keep_nav = F.col("reason").isNull() | (F.col("reason") == "prior_nav_missing")
    return j.select(*k, "session_id", F.when(keep_nav, F.col("nav")).alias("nav"), ret.alias("net_return"), "reason")


def account_sharpe(panel: DataFrame, account: Sequence[str], minimum: int) -> DataFrame:
    """Annualised Sharpe; NULL below the minimum periods or without variation."""
    g = panel.groupBy(*account).agg(F.count("net_return").alias("periods"), F.avg("net_return").alias("m"), F.stddev_samp("net_return").alias("s"), F.avg((F.col("net_return") > 0).cast("int")).alias("win_rate"))
    ok = (F.col("periods") >= minimum) & (F.col("s") > 0)
    return g.select(*account, "periods", F.when(ok, F.col("m") * F.sqrt(F.lit(float(SESSIONS_PER_YEAR))) / F.col("s")).alias("sharpe"), "win_rate")
