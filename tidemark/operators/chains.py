"""Option-chain selection.

Chains are keyed by an "ask": one distinct (ticker, t_pre). Several events on one ask share the selection, so a
ticker that carries a large share of the events is priced once per session. An ask's listed contracts are
shuffled once; the per-strike, per-expiry and per-ask reductions reuse that partitioning, and the small strike
ladders (bounded by what an exchange lists per expiry) stay in arrays.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import BUCKETS, MAX_STALE_SESSIONS, OTM_GRID, RISK_FREE, SPOT_LOOKBACK_DAYS, STRIKE_WINDOW
from .asof import asof_daily

ASK = ["ticker", "t_pre"]


def leg_suffix(pct: float) -> str:
    return f"{pct:g}"


def _month(c) -> Column:
    return F.year(c) * 12 + F.month(c)


def chain(asks: DataFrame, contracts: DataFrame, dte_lo: int = 2, dte_hi: int = 180) -> DataFrame:
    """Contracts listed by t_pre that expire dte_lo..dte_hi days later.

    The expiry range becomes an equi-join on (ticker, expiry month): an ask touches at most seven months.
    """
    a = asks.select(*ASK).distinct().withColumn("_m", F.explode(F.sequence(
        _month(F.date_add("t_pre", dte_lo)), _month(F.date_add("t_pre", dte_hi)))))
    c = contracts.where("shares_per_contract = 100").withColumn("_m", _month("expiration_date"))
    j = a.join(c, ["ticker", "_m"]).withColumn("dte", F.datediff("expiration_date", "t_pre"))
    return j.where(F.col("dte").between(dte_lo, dte_hi) & (F.col("listed_from") <= F.col("t_pre"))).drop("_m")


def strike_rows(listed: DataFrame) -> DataFrame:
    """Per ask, expiry and strike: the call and the put contract (NULL when one side is not listed)."""
    pick = lambda kind: F.min(F.when(F.col("contract_type") == kind, F.col("contract_ticker"))).alias(kind)
    return listed.repartition(*ASK).groupBy(*ASK, "expiration_date", "dte", "strike").agg(pick("call"), pick("put"))


def pair_strikes(listed: DataFrame) -> DataFrame:
    """Strikes with both a call and a put."""
    return strike_rows(listed).where("call IS NOT NULL AND put IS NOT NULL")


def parity(strike: Column, years: Column, call: Column, put: Column, rate: float = RISK_FREE) -> Column:
    """Stock price implied by a call/put pair."""
    return strike * F.exp(-F.lit(rate) * years) + call - put


def ladders(listed: DataFrame, buckets: dict = BUCKETS) -> DataFrame:
    """One row per ask: the near expiry (dte >= 3) and, per bucket, the chosen expiry, each with its ladder.

    J10: a bucket takes the expiry nearest its target among those with at least three pairs, ties earlier.
    """
    both = F.col("call").isNotNull() & F.col("put").isNotNull()
    per_expiry = strike_rows(listed).groupBy(*ASK, "expiration_date", "dte").agg(
        F.count_if(both).alias("pairs"), F.collect_list(F.struct("strike", "call", "put")).alias("ladder"))
    row = F.struct("expiration_date", "dte", "pairs", "ladder")
    aggs = [F.min_by(row, F.when(F.col("dte") >= 3, F.col("dte"))).alias("near")]
    for name, (lo, hi, target) in buckets.items():
        rank = F.when(F.col("dte").between(lo, hi) & (F.col("pairs") >= 3),
                      F.struct(F.abs(F.col("dte") - target), F.col("expiration_date")))
        aggs.append(F.min_by(row, rank).alias(f"bucket {name}"))
    return per_expiry.groupBy(*ASK).agg(*aggs)


def locate_spot(rows: DataFrame, bars: DataFrame) -> DataFrame:
    """Parity spot at the near expiry (at least three pairs) where |C - P| is smallest.

    Prices are the last closes within seven calendar days (J6).
    """
    near = rows.where("near.pairs >= 3").select(*ASK, F.col("near.dte").alias("dte"), F.inline("near.ladder"))
    legs = near.where("call IS NOT NULL AND put IS NOT NULL").select(*ASK, "dte", "strike", F.inline(F.array(
        F.struct(F.lit("c").alias("kind"), F.col("call").alias("contract_ticker")),
        F.struct(F.lit("p").alias("kind"), F.col("put").alias("contract_ticker")))))
    marks = asof_daily(legs, bars, "contract_ticker", "t_pre", "session", ["close"])
    marks = marks.where(F.datediff("t_pre", "mark_day") <= SPOT_LOOKBACK_DAYS)
    wide = legs.join(marks, ["contract_ticker", "t_pre"]).groupBy(*ASK, "dte", "strike").agg(
        F.max(F.when(F.col("kind") == "c", F.col("close"))).alias("c"),
        F.max(F.when(F.col("kind") == "p", F.col("close"))).alias("p")).where("c IS NOT NULL AND p IS NOT NULL")
    spot = parity(F.col("strike"), F.col("dte") / 365, F.col("c"), F.col("p"))
    return wide.groupBy(*ASK).agg(F.min_by(spot, F.struct(F.round(F.abs(F.col("c") - F.col("p")), 9), F.col("strike"))).alias("spot"))


def by_bucket(rows: DataFrame, buckets: dict = BUCKETS) -> DataFrame:
    """Rows of ladders() per bucket; `pick` is NULL when no expiry qualifies."""
    arr = F.array(*[F.struct(F.lit(b).alias("bucket"), F.col(f"`bucket {b}`").alias("pick")) for b in buckets])
    keep = [c for c in rows.columns if not c.startswith("bucket ") and c != "near"]
    return rows.select(*keep, F.inline(arr))


def selected_legs(otm: tuple = OTM_GRID) -> Column:
    """Leg array for columns `pick` and `spot`; NULL when no paired strike lies inside the window.

    ATM is the paired strike nearest spot within ±25 %. Calls take the first strike at or above
    spot·(1+pct), puts the last at or below spot·(1−pct), else the farthest listed one.
    """
    s, ladder = F.col("spot"), F.col("pick.ladder")
    inside = F.filter(ladder, lambda x: x["call"].isNotNull() & x["put"].isNotNull()
                      & (x["strike"] >= s * (1 - STRIKE_WINDOW)) & (x["strike"] <= s * (1 + STRIKE_WINDOW)))
    atm = F.array_min(F.transform(inside, lambda x: F.struct(F.round(F.abs(x["strike"] - s), 9), x["strike"].alias("k"), x["call"].alias("c"), x["put"].alias("p"))))
    calls = F.transform(F.filter(ladder, lambda x: x["call"].isNotNull()), lambda x: F.struct(x["strike"].alias("k"), x["call"].alias("id")))
    puts = F.transform(F.filter(ladder, lambda x: x["put"].isNotNull()), lambda x: F.struct(x["strike"].alias("k"), x["put"].alias("id")))
    leg = lambda code, kind, k, i: F.struct(F.lit(code).alias("leg_code"), F.lit(kind).alias("contract_type"), k.alias("strike"), i.alias("contract_ticker"))
    out = [leg("C_K", "call", atm["k"], atm["c"]), leg("P_K", "put", atm["k"], atm["p"])]
    for pct in otm:
        up = F.coalesce(F.array_min(F.filter(calls, lambda x: x["k"] >= s * (1 + pct))), F.array_max(calls))
        dn = F.coalesce(F.array_max(F.filter(puts, lambda x: x["k"] <= s * (1 - pct))), F.array_min(puts))
        out += [leg(f"C_U{leg_suffix(pct)}", "call", up["k"], up["id"]), leg(f"P_L{leg_suffix(pct)}", "put", dn["k"], dn["id"])]
    return F.when(atm.isNotNull(), F.array(*out))


def marks(leg_days: DataFrame, bars: DataFrame) -> DataFrame:
    """(contract_ticker, ord, mark): last close at most three sessions old, per distinct pair."""
    m = asof_daily(leg_days, bars, "contract_ticker", "ord", "ord", ["close"])
    return m.where(F.col("ord") - F.col("mark_day") <= MAX_STALE_SESSIONS).select(
        "contract_ticker", "ord", F.col("close").alias("mark"))


def contract_pair(quotes: DataFrame, keys: list[str], spot: str, decision_day: str) -> DataFrame:
    """Shared expiry nearest 120 days, then call nearest 1.05 and put nearest 0.95 of spot.

    Ties follow (distance, strike, contract). `quotes` is already filtered by the quote gates.
    """
    q = quotes.withColumn("dte", F.datediff("expiration_date", decision_day)).where(F.col("dte").between(90, 180))
    def nearest(kind, ratio):
        dist = F.round(F.abs(F.col("strike") - F.col(spot) * ratio), 9)
        return F.min_by("contract_ticker", F.when(F.col("contract_type") == kind,
                                                  F.struct(dist, F.col("strike"), F.col("contract_ticker"))))
    per = q.groupBy(*keys, "expiration_date", "dte").agg(
        nearest("call", 1.05).alias("call_contract"), nearest("put", 0.95).alias("put_contract"))
    ok = per.where("call_contract IS NOT NULL AND put_contract IS NOT NULL")
    best = F.min_by(F.struct("expiration_date", "call_contract", "put_contract"),
                    F.struct(F.abs(F.col("dte") - 120), F.col("expiration_date")))
    return ok.groupBy(*keys).agg(best.alias("b")).select(*keys, "b.*")
