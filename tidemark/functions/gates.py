"""Row gates: reason arrays and clock columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import scalars as fn


def reasons(**rules: Column) -> Column:
    """P11 shape: every failing rule's name. An unknown (NULL) rule counts as failing."""
    return F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(True)), F.lit(name)) for name, c in rules.items()]))


def absent(c: Column) -> Column:
    return F.coalesce(F.trim(c) == "", F.lit(True))


def identity_ok(cik: Column, accession: Column) -> Column:
    """P8."""
    return F.coalesce(cik.rlike(r"^\d{1,10}$") & ~cik.rlike("^0+$") & accession.rlike(r"^\d{10}-\d{2}-\d{6}$"), F.lit(False))


def url_reasons(url: Column, host_ok: Column) -> Column:
    """Scheme, host, user, query, fragment and dot-segment rules of a canonical address."""
    part = lambda name: F.try_parse_url(url, F.lit(name))
    path = F.coalesce(part("PATH"), F.lit(""))
    return F.array_compact(F.array(
        F.when(~part("PROTOCOL").eqNullSafe("https"), "scheme"), F.when(~F.coalesce(host_ok, F.lit(False)), "host"), F.when(part("USERINFO").isNotNull(), "userinfo"),
        F.when(part("QUERY").isNotNull(), "query"), F.when(part("REF").isNotNull(), "fragment"), F.when(path.rlike(r"(^|/)\.\.?(/|$)") | path.contains("\\"), "dot_segment")))


def archive_path_ok(path: Column, cik: Column, accession: Column) -> Column:
    """The path names the filer and either the submission text or a file below its accession."""
    base = F.concat(F.lit("/Archives/edgar/data/"), cik.cast("bigint").cast("string"), F.lit("/"))
    rest = F.when(F.startswith(path, base), F.substr(path, F.length(base) + 1))
    inner = F.concat(F.regexp_replace(accession, "-", ""), F.lit("/"))
    name = F.when(F.startswith(rest, inner), F.substr(rest, F.length(inner) + 1))
    return F.coalesce((rest == F.concat(accession, F.lit(".txt"))) | name.rlike("^[A-Za-z0-9_.-]+$"), F.lit(False))


def manifest_row_reasons(source_id: str) -> Column:
    """Rules of one registered document row."""
    d, p, u, h = (F.col(c) for c in ("document_id", "source_path", "source_url", "source_sha256"))
    prefix = f"../../../data/raw/team_sources/{source_id}/"
    bad_url = F.coalesce(~(F.try_parse_url(u, F.lit("PROTOCOL")).isin("http", "https") & F.try_parse_url(u, F.lit("HOST")).isNotNull() & F.try_parse_url(u, F.lit("USERINFO")).isNull()
                           & F.try_parse_url(u, F.lit("REF")).isNull() & ~u.rlike(r"[\s\\]")), F.lit(True))
    return F.array_compact(F.array(
        F.when(F.coalesce(~d.rlike(f"^{source_id}:\\S(.*\\S)?$"), F.lit(True)), "document_id"), F.when(~fn.relative_path_ok(p, prefix), "source_path"), F.when(bad_url, "source_url"),
        F.when(h.isNotNull() & ~h.rlike("^[0-9a-f]{64}$"), "source_sha256"), F.when(F.coalesce(F.concat_ws(" ", d, p, u, h).contains("REPLACE_"), F.lit(False)), "placeholder")))


def covers(start: Column, end: Column, entry: Column, exit_: Column) -> Column:
    """P14."""
    return F.coalesce((start <= entry) & (end >= exit_), F.lit(False))


def available(at: Column, entry: Column) -> Column:
    return F.coalesce(at <= entry, F.lit(False))


def costs_ok(c: Column, decision: Column | None = None, exit_: Column | None = None) -> Column:
    """Qualified USD costs, finite and not negative; with clocks also known in time and valid long enough."""
    ok = c["qualified"].eqNullSafe(True) & c["currency"].eqNullSafe("USD") & c["available_at_utc"].isNotNull() & c["valid_through_utc"].isNotNull()
    for k in ("entry_fee", "exit_fee", "entry_slippage", "exit_slippage"):
        ok = ok & fn.finite(c[k]) & F.coalesce(c[k] >= 0, F.lit(False))
    if decision is not None:
        ok = ok & available(c["available_at_utc"], decision) & F.coalesce(c["valid_through_utc"] >= exit_, F.lit(False))
    return ok


def corporate_actions_ok(a: Column, horizon: str, security: Column) -> Column:
    """P13."""
    return F.coalesce(a["qualified"].eqNullSafe(True) & a["status"].eqNullSafe("verified_none") & a["horizon_id"].eqNullSafe(horizon)
                      & (a["security_id"].isNull() | (a["security_id"] == security)) & a["available_at_utc"].isNotNull() & (a["start_at_utc"] <= a["end_at_utc"]), F.lit(False))


def borrow_ok(b: Column, margin: Column, margin_at: Column) -> Column:
    """P13."""
    return F.coalesce(b["qualified"].eqNullSafe(True) & fn.finite(b["quantity"]) & (b["quantity"] > 0) & fn.finite(b["total_fee"]) & (b["total_fee"] >= 0)
                      & fn.finite(margin) & (margin > 0) & margin_at.isNotNull(), F.lit(False))


def decision_reasons() -> Column:
    """Decision-record rules by scope."""
    c = F.col
    issuer, market = c("scope_type").eqNullSafe("issuer"), c("scope_type").eqNullSafe("market")
    doc = F.coalesce(c("document_only"), F.lit(False))
    return reasons(
        empty_identity=absent(c("decision_id")) | absent(c("session_id")) | absent(c("horizon_id")),
        invalid_scope_or_mode=~(F.coalesce(c("scope_type").isin("issuer", "market", "portfolio"), F.lit(False)) & F.coalesce(c("mode").isin("observed", "historical_replay"), F.lit(False))),
        document_only_tradable=doc & (~issuer | absent(c("cik")) | ~c("identity_quality").eqNullSafe("cik_verified") | c("security_id").isNotNull()),
        issuer_identity=~doc & issuer & (absent(c("cik")) | absent(c("security_id"))),
        futures_scope=F.coalesce(c("asset_class").isin("future", "futures"), F.lit(False)) & ~market,
        market_identity=market & (c("cik").isNotNull() | absent(c("instrument_id"))),
        portfolio_identity=c("scope_type").eqNullSafe("portfolio") & absent(c("portfolio_id")),
        cutoff_after_decision=c("information_cutoff") > c("decision_at"),
        outcome_before_decision=F.coalesce(c("outcome_end") <= c("decision_at"), F.lit(False)))


def available_at() -> tuple[Column, Column]:
    """(availability clock, reason). Observed clocks are evidence, replay clocks are stated assumptions."""
    c = F.col
    seen = c("public_at").isNotNull() & c("received_at").isNotNull() & c("processed_at").isNotNull()
    ordered = (c("public_at") <= c("received_at")) & (c("received_at") <= c("processed_at"))
    floor = c("public_at") + F.make_dt_interval(secs=F.coalesce(c("latency_seconds"), F.lit(0)))
    reason = (F.when(c("mode") == "observed", F.when(~seen, "observed_clock_missing").when(~ordered, "observed_order_invalid"))
              .when(c("mode") == "historical_replay", F.when(~F.coalesce(fn.finite(c("latency_seconds")) & (c("latency_seconds") >= 0), F.lit(False)), "latency_assumption_missing")
                    .when(c("assumed_at").isNull() | (c("assumed_at") < floor), "replay_precedes_latency")).otherwise("mode"))
    clock = F.when(c("mode") == "observed", c("processed_at")).otherwise(c("assumed_at"))
    return F.when(reason.isNull(), clock), reason


def executable(side: Column, quantity: Column, cutoff: Column, max_age: float, allow_sampled: bool = False) -> Column:
    """P20: side price of a quote row, or NULL when any gate fails. Needs at, available_at, bid, ask, bid_size, ask_size, evidence_kind."""
    c = F.col
    kind = (c("evidence_kind") == "update") | ((c("evidence_kind") == "interval_sample") & F.lit(allow_sampled))
    age = (F.unix_micros(cutoff) - F.unix_micros(c("at"))) / 1e6
    numbers = fn.finite(c("bid")) & fn.finite(c("ask")) & fn.finite(c("bid_size")) & fn.finite(c("ask_size"))
    buy = side == "buy"
    size, price = F.when(buy, c("ask_size")).otherwise(c("bid_size")), F.when(buy, c("ask")).otherwise(c("bid"))
    ok = kind & (c("available_at") <= cutoff) & (c("available_at") >= c("at")) & age.between(0, max_age) & numbers & (c("bid") <= c("ask")) & (size > 0) & (size >= quantity)
    return F.when(ok, price)


def trade_reasons(allow_fractional: bool = False) -> Column:
    """Trade-intent rules; needs decision_at, entry_at, exit_at, asset_class, side, quantity, multiplier, margin, margin_at, borrow."""
    c = F.col
    whole = c("quantity") == F.floor("quantity")
    short_eq = (c("side") == "short") & (c("asset_class") == "equity")
    needs_margin = (c("asset_class") == "futures") | short_eq
    borrowed = (c("borrow")["qualified"].eqNullSafe(True) & (c("borrow")["available_at"] <= c("decision_at")) & (c("borrow")["valid_through"] >= c("exit_at")) & (c("borrow")["quantity"] >= c("quantity")))
    return reasons(
        invalid_trade_interval=~((c("decision_at") <= c("entry_at")) & (c("entry_at") < c("exit_at"))),
        unsupported_asset_or_side=~(c("asset_class").isin("equity", "option", "futures") & c("side").isin("long", "short")),
        invalid_exposure_units=(c("quantity") <= 0) | (c("multiplier") <= 0) | ((c("asset_class") == "equity") & (c("multiplier") != 1)),
        whole_contract_quantity_required=c("asset_class").isin("futures", "option") & ~whole,
        unregistered_fractional_equity_policy=(c("asset_class") == "equity") & ~whole & F.lit(not allow_fractional),
        unknown_borrow=(c("side") == "short") & (c("asset_class") != "futures") & ~F.coalesce(short_eq & borrowed, F.lit(False)),
        dated_margin_collateral_required=F.coalesce(c("margin") < 0, F.lit(False)) | (needs_margin & ~F.coalesce(c("margin") > 0, F.lit(False))),
        future_or_unknown_margin_terms=needs_margin & ~F.coalesce(c("margin_at") <= c("decision_at"), F.lit(False)))


def flat(row_positions: Column, collateral: Column, restricted: Column, equity: Column) -> Column:
    """No positions, no collateral, no restricted proceeds, positive finite equity."""
    return F.coalesce((row_positions == 0) & (collateral == 0) & (restricted == 0) & fn.finite(equity) & (equity > 0), F.lit(False))
