from datetime import date

import pytest
from pyspark.sql import functions as F

from tidemark.functions import calendar as cal
from tidemark.operators import boards, chains, events as ev, study as st


def test_strategy_pnl_hand_numbers(spark):
    p = st.strategy_pnl(*[F.lit(float(x)) for x in (5, 3, -2, 3, 100)])
    row = spark.range(1).select(*[c.alias(n) for n, c in p.items()]).first().asDict()
    want = {"stock": .05, "long_call": .03, "covered_call": .07, "protective_put": .08, "collar": .10, "cash_secured_put": -.03}
    assert all(row[k] == pytest.approx(v) for k, v in want.items())


def test_risk_budget(spark):
    f = lambda loss: spark.range(1).select(st.contracts_in_budget(F.lit(10000.0), F.lit(.01), F.lit(loss)).alias("n")).first().n
    assert (f(35.0), f(101.0), f(0.0)) == (2, 0, None)


def _ord(d):
    return cal._session_list(*st.CALENDAR_RANGE).index(d)


def fixture(spark, volume=200.0):
    s = [x for x in cal._session_list("2024-01-02", "2024-04-19")]
    entry, exit_ = date(2024, 1, 5), date(2024, 4, 19)
    strikes = {("call", 100.0): "CK", ("put", 100.0): "PK", ("call", 105.0): "CU", ("put", 105.0): "PU", ("call", 95.0): "CL", ("put", 95.0): "PL"}
    expiry = {date(2024, 1, 19): "n", date(2024, 4, 19): "x"}
    px = {"CK": (6.0, 10.0), "PK": (5.0, 0.0), "CU": (3.0, 5.0), "PU": (9.0, 0.0), "CL": (9.0, 15.0), "PL": (3.0, 0.0)}
    con, bars = [], []
    for (kind, k), name in strikes.items():
        for e, tag in expiry.items():
            tk = tag + name
            con.append(("T", kind, k, e, tk, date(2023, 12, 1), 100))
            for d in s:
                if d <= e:
                    bars.append((tk, d, _ord(d), px[name][1] if d == exit_ else px[name][0], volume))
    c = spark.createDataFrame(con, "ticker string, contract_type string, strike double, expiration_date date, contract_ticker string, listed_from date, shares_per_contract int")
    b = spark.createDataFrame(bars, "contract_ticker string, session date, ord int, close double, volume double")
    e = spark.createDataFrame([("T", date(2024, 1, 8), entry, date(2024, 1, 9))], "ticker string, event_date date, t_pre date, t_0 date")
    return e, c, b


def test_end_to_end_event(spark):
    e, c, b = fixture(spark)
    priced, dropped = st.price(e, c, b, otm=(0.05,))
    p = priced.collect()
    assert [(r.bucket, r.expiration_date) for r in p] == [("3-6m", date(2024, 4, 19))]
    assert {x.leg_code: x.strike for x in p[0].legs} == {"C_K": 100.0, "P_K": 100.0, "C_U0.05": 105.0, "P_L0.05": 95.0}
    assert sorted(r.reason for r in dropped.collect()) == ["1m: no_expiry", "2m: no_expiry"]
    res = {(r.entry, r.horizon): r for r in st.evaluate(priced, b, "2025-01-01", otm=(0.05,)).collect()}
    import math
    s0 = 100 * math.exp(-0.04 * 105 / 365) + 1
    r = res[("pre", "exp")]
    assert r.s_exit == pytest.approx(110.0) and r.long_call == pytest.approx(4 / s0) and r.stock == pytest.approx((110 - s0) / s0)
    assert {h for (en, h) in res if en == "post"} == {"0", "1", "2", "3", "5", "10", "21", "42", "63", "exp"}
    # rows after as_of do not exist and earlier ones do not change
    early = {(r.entry, r.horizon): r.stock for r in st.evaluate(priced, b, "2024-02-01", otm=(0.05,)).collect()}
    assert ("post", "63") not in early and early[("post", "1")] == res[("post", "1")].stock
    cap = {r.strategy: r for r in st.capacity(priced, b, "post", capital=10000.0, risk_fraction=.10, participation=.05, haircut=.05).collect()}
    lc = cap["long_call"]
    assert (lc.capital_per_contract, lc.round_trip_cost_per_contract, lc.risk_contracts, lc.volume_contracts) == (pytest.approx(660), pytest.approx(60), 1, 10) and lc.reason == ""
    board = st.scoreboard(st.evaluate(priced, b, "2025-01-01", otm=(0.05,)), ["horizon"]).collect()
    assert len(board) == 60 and all(r.ci_lo is None and r.n < 5 for r in board)
    # a slice is priced and evaluated alone, with the same values
    alone = st.evaluate(priced, b, "2025-01-01", otm=(0.05,), entries=("post",), horizons=(5, "exp")).collect()
    assert {(r.entry, r.horizon): r.stock for r in alone} == {k: res[k].stock for k in (("post", "5"), ("post", "exp"))}


def test_thin_chain_keeps_a_reason(spark):
    e, c, b = fixture(spark)
    priced, dropped = st.price(e, c.where("contract_type = 'call'"), b, otm=(0.05,))
    assert priced.count() == 0 and [r.reason for r in dropped.collect()] == ["no_spot"]
    priced, dropped = st.price(e, c.where("ticker = 'none'"), b, otm=(0.05,))
    assert [r.reason for r in dropped.collect()] == ["no_chain"]


def test_contract_pair_tie_rule(spark):
    q = [("e", "call", k, date(2024, 5, 1), f"c{k}") for k in (104.0, 106.0)] + [("e", "put", k, date(2024, 5, 1), f"p{k}") for k in (94.0, 96.0)]
    df = spark.createDataFrame([(*r, 100.0, date(2024, 1, 2)) for r in q], "k string, contract_type string, strike double, expiration_date date, contract_ticker string, spot double, d date")
    r = chains.contract_pair(df, ["k"], "spot", "d").first()
    assert (r.call_contract, r.put_contract) == ("c104.0", "p94.0")


def test_event_collapse(spark):
    rows = [("320193", date(2024, 1, 6), "a2", None, "t2", ["brk/b "]), ("320193", date(2024, 1, 6), "a1", "u", None, ["BRK.B", ""]), ("9", date(2024, 1, 9), "z", "u", "t", ["NOPE"])]
    raw = spark.createDataFrame(rows, "cik string, filing_date date, accession_number string, filing_url string, supporting_text string, tickers array<string>")
    out = ev.collapse(ev.explode_tickers(raw), spark.createDataFrame([("BRK.B",)], "ticker string"), cal.day_table(spark, "2023-12-01", "2024-02-01")).collect()
    assert len(out) == 1 and (out[0].ticker, out[0].accession_number, out[0].filing_url, out[0].supporting_text) == ("BRK.B", "a1", "u", "t2")
    assert (out[0].t_pre, out[0].t_0, out[0].days_since_prev_event) == (date(2024, 1, 5), date(2024, 1, 8), None)


def test_exports_refuse_ambiguity_and_conflicts(spark):
    e, c, b = fixture(spark)
    p, _ = st.price(e, c, b, otm=(0.05,))
    twice = e.withColumn("event_id", F.lit("a")).unionByName(e.withColumn("event_id", F.lit("b")))
    assert {r.reason for r in st.leg_export(twice, p).collect()} == {"ambiguous matching event"}
    assert {r.reason for r in st.leg_export(e.withColumn("event_id", F.lit("a")), p).collect()} == {None}
    raw = spark.createDataFrame([("c", 1, 5.0), ("c", 1, 5.0), ("d", 1, 5.0), ("d", 1, 6.0)], "k string, s int, v double")
    clean, bad = st.bar_export(raw, ["k", "s"], ["v"])
    assert [r.k for r in clean.collect()] == ["c"] and [r.k for r in bad.collect()] == ["d"]


def test_pass_rules(spark):
    df = spark.createDataFrame([(0.5, -0.2)], "sharpe double, dd double")
    assert {r.rule: r.passed for r in boards.pass_rules(df, {"a": "sharpe > 0", "b": "dd > -0.1"}).collect()} == {"a": True, "b": False}
