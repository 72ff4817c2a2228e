import random
from datetime import date, datetime, timedelta

import numpy as np
from pyspark.sql import functions as F

from tidemark.functions import calendar as cal
from tidemark.operators import asof, intervals as iv
from tidemark.operators.quantiles import exact_quantiles


def test_holidays_and_sessions(spark):
    assert date(2024, 3, 29) in cal.closures(2024) and date(2022, 6, 20) in cal.closures(2022)
    assert date(2021, 12, 24) in cal.closures(2021) and date(2022, 1, 1) in cal.closures(2022)
    assert date(2021, 6, 18) not in cal.closures(2021) and date(2025, 1, 9) in cal.closures(2025)
    assert len(cal._session_list("2024-01-01", "2024-12-31")) == 252
    d = {r.day: r for r in cal.day_table(spark, "2023-12-01", "2024-02-01").collect()}
    assert d[date(2024, 1, 6)].next_strict == date(2024, 1, 8) and d[date(2024, 1, 8)].prev_strict == date(2024, 1, 5)
    assert d[date(2024, 1, 8)].next_strict == date(2024, 1, 9)


def test_stale_limit(spark):
    bars = spark.createDataFrame([("c", date(2024, 1, 2), 5.0)], "k string, session date, close double")
    probes = spark.createDataFrame([("c", date(2024, 1, 5)), ("c", date(2024, 1, 8)), ("c", date(2024, 1, 1)), ("x", date(2024, 1, 5))], "k string, day date")
    m = asof.asof_daily(probes, bars, "k", "day", "session", ["close"])
    days = cal.day_table(spark, "2023-12-01", "2024-02-01")
    m = cal.align(cal.align(m, "day", days, {"ord_incl": "d"}), "mark_day", days, {"ord_incl": "m"}).select("k", "day", asof.stale_mark("close", "m", "d").alias("v"))
    got = {(r.k, r.day): r.v for r in m.collect()}
    assert got[("c", date(2024, 1, 5))] == 5.0 and got[("c", date(2024, 1, 8))] is None and got[("c", date(2024, 1, 1))] is None and got[("x", date(2024, 1, 5))] is None


def _times(rng, n):
    base = datetime(2024, 1, 1)
    return [base + timedelta(seconds=rng.randrange(0, 200_000)) for _ in range(n)]


def test_prefix_max_matches_brute_force_with_hot_key(spark):
    rng = random.Random(3)
    key = lambda: "hot" if rng.random() < 0.6 else rng.choice("abc")
    left = [(i, key(), t) for i, t in enumerate(_times(rng, 200))]
    right = [(key(), t, i) for i, t in enumerate(_times(rng, 300))]
    l, r = spark.createDataFrame(left, "id int, k string, t timestamp"), spark.createDataFrame(right, "k string, rt timestamp, v int")
    for strict in (False, True):
        got = asof.prefix_max(l, r, ["k"], "t", "rt", F.struct("rt", "v"), "m", asof.epoch_bucket(3600), strict=strict)
        got = {x.id: (x.m.rt, x.m.v) if x.m else None for x in got.collect()}
        for i, k, t in left:
            c = [(rt, v) for rk, rt, v in right if rk == k and (rt < t if strict else rt <= t)]
            assert got[i] == (max(c) if c else None)


def test_running_total_and_partition_count_do_not_matter(spark):
    rows = [("a", i, (i * 7) % 5 + 1) for i in range(300)]
    df = spark.createDataFrame(rows, "k string, i int, v int")
    one = asof.running_total(df, ["k"], ["i"], "v", "s", F.floor(F.col("i") / 10)).orderBy("i").collect()
    two = asof.running_total(df.repartition(7).orderBy(F.desc("i")), ["k"], ["i"], "v", "s", F.floor(F.col("i") / 97)).orderBy("i").collect()
    assert [r.s for r in one] == [r.s for r in two] == list(np.cumsum([r[2] for r in rows]))


def test_overlap_helpers(spark):
    rng = random.Random(5)
    mk = lambda n: [(i, s, s + rng.randrange(1, 40)) for i, s in ((i, rng.randrange(0, 500)) for i in range(n))]
    a, b = mk(60), mk(60)
    da = spark.createDataFrame([("d", *x) for x in a], "k string, id int, s int, e int")
    db = spark.createDataFrame([("d", *x) for x in b], "k string, jd int, rs int, re int")
    got = {(r.id, r.jd) for r in iv.overlap_join(da, db, ["k"], "s", "e", "rs", "re", 16).collect()}
    assert got == {(x[0], y[0]) for x in a for y in b if x[1] < y[2] and y[1] < x[2]}
    ts = lambda c: F.timestamp_seconds(F.col(c) * 600)
    f = iv.overlaps_any(da.select("k", "id", ts("s").alias("s"), ts("e").alias("e")), db.select("k", ts("rs").alias("rs"), ts("re").alias("re")), ["k"], "s", "e", "rs", "re", asof.epoch_bucket(3600))
    assert {r.id: r.overlaps for r in f.collect()} == {x[0]: any(x[1] <= y[2] and x[2] >= y[1] for y in b) for x in a}


def test_exact_quantiles(spark):
    rng = np.random.default_rng(0)
    groups = {"one": rng.normal(size=25001), "ties": np.repeat([1.0, 2.0, 9.0], 700), "few": np.array([3.0, 1.0])}
    df = spark.createDataFrame([(k, float(v)) for k, vs in groups.items() for v in vs], "k string, v double")
    for r in exact_quantiles(df, ["k"], "v", {"q1": 0.1, "m": 0.5, "q9": 0.975}).collect():
        np.testing.assert_allclose([r.q1, r.m, r.q9], np.quantile(groups[r.k], [0.1, 0.5, 0.975]), rtol=1e-12)


def test_placebo_draws_are_whole(spark):
    """Dense, sparse and blocked tickers: every draw is a row, sessions keep the gap and come from all admissible ones."""
    import datetime as dt
    from collections import Counter

    from tidemark.functions import calendar as cal
    from tidemark.operators import events as ev
    day = lambda s: dt.date.fromisoformat(s)
    dense = [("dense", f"d{i}", day("2000-01-10") + dt.timedelta(20 * i)) for i in range(40)]  # nothing is 15 days from all of them, but the ends
    sparse = [("sparse", f"s{i}", d) for i, d in enumerate([day("2000-03-01"), day("2000-03-01"), day("2001-02-15")])]
    pool = cal.sessions(spark, "1999-01-01", "2003-12-31").where("session BETWEEN '2000-01-03' AND '2001-12-31'").select("session")
    events = spark.createDataFrame(dense + sparse, "ticker string, event_id string, filing_date date")
    got = ev.placebo(events, pool, n=300, gap_days=15, seed=3).collect()
    assert sorted(r.draw for r in got) == list(range(300))
    free = {t: [s.session for s in pool.collect() if all(abs((s.session - d).days) > 15 for k, _, d in dense + sparse if k == t)] for t in ("dense", "sparse")}
    assert all(r.filing_date in free[r.ticker] and r.reason is None for r in got if free[r.ticker])
    assert all(r.filing_date is None and r.reason == "no_admissible_session" for r in got if not free[r.ticker])
    share = Counter(r.ticker for r in got)["dense"] / 300
    assert 0.8 < share < 1 and len({r.filing_date for r in got if r.ticker == "sparse"}) > 3
    blocked = ev.placebo(events.where("ticker = 'dense'"), pool.where("session BETWEEN '2000-03-01' AND '2001-06-01'"), n=50, gap_days=30, seed=1).collect()
    assert len(blocked) == 50 and {r.reason for r in blocked} == {"no_admissible_session"}
    assert ev.placebo(events.limit(0), pool, n=5, gap_days=1, seed=1).count() == 0
