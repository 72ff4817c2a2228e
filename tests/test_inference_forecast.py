import math
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import stats
from tidemark.operators import forecast as fc, inference as inf, resample as rs


def test_published_statistics(spark):
    rows = [("full", 0.347119753 / math.sqrt(252), 5794, 5.760750, 140.572217), ("holdout", 1.809122835 / math.sqrt(252), 336, 3.423230, 28.752112)]
    d = inf.psr_dsr(spark.createDataFrame(rows, "k string, sr double, n int, skew double, kurt double"))
    got = {r.k: r for r in d.collect()}
    assert got["full"].psr == pytest.approx(0.961086978, abs=1e-6) and got["holdout"].psr == pytest.approx(0.993669052, abs=1e-6)
    assert got["full"].sr_star == pytest.approx(0.02959199583, abs=1e-9) and got["full"].dsr == pytest.approx(0.266632389, abs=1e-5)
    assert got["holdout"].dsr == pytest.approx(0.422645932, abs=1e-5)


def test_wilson_and_binomial(spark):
    df = spark.createDataFrame([("a", 32, 67), ("b", 9, 10)], "s string, k bigint, n bigint")
    lo, hi = stats.wilson(F.col("k"), F.col("n"))
    w = {r.s: r for r in df.select("s", lo.alias("lo"), hi.alias("hi")).collect()}
    assert (w["a"].lo, w["a"].hi) == (pytest.approx(0.362502, abs=1e-6), pytest.approx(0.595150, abs=1e-6))
    p = {r.s: r.p_value for r in inf.binomial_p(df, ["s"], "k", "n").collect()}
    assert p["a"] == pytest.approx(0.807195, abs=1e-6) and p["b"] == pytest.approx(0.021484, abs=1e-6)


def test_bootstrap_interval_is_close_to_normal_theory(spark):
    rng = np.random.default_rng(1)
    small, big = rng.normal(5, 2, 60), rng.normal(1, 3, 4000)
    df = spark.createDataFrame([("s", i, float(v)) for i, v in enumerate(small)] + [("b", i, float(v)) for i, v in enumerate(big)] + [("t", 0, 1.0)], "k string, i int, v double")
    got = {r.k: r for r in rs.bootstrap_ci(df, ["k"], "i", "v").collect()}
    for k, x in (("s", small), ("b", big)):
        half = 1.96 * x.std(ddof=1) / math.sqrt(len(x))
        assert got[k].ci_lo == pytest.approx(x.mean() - half, abs=0.35 * half) and got[k].ci_hi == pytest.approx(x.mean() + half, abs=0.35 * half)
    assert got["t"].ci_lo is None


def test_components(spark):
    rows = [(1, "g1"), (2, "g1"), (2, "g2"), (9, "g2"), (5, "g3"), (7, None)]
    c = {r.b: r.component for r in rs.block_components(spark.createDataFrame(rows, "b int, g string"), "b", "g").collect()}
    assert c == {1: 1, 2: 1, 9: 1, 5: 5, 7: 7}
    chain = spark.createDataFrame([(i, i + 1) for i in range(40)], "a int, b int")
    assert {r.label for r in rs.components(chain, "a", "b").collect()} == {0}


def test_ridge_matches_closed_form(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(80, 2))
    x[::7, 1] = np.nan
    y = 1 + 2 * x[:, 0] + rng.normal(size=80) * .1
    df = spark.createDataFrame([("f", float(a), None if np.isnan(b) else float(b), float(t)) for (a, b), t in zip(x, y)], "fold_id string, a double, b double, target double")
    prep = fc.preparation(df, ["a", "b"])
    xs = fc.scaled(df, prep, ["a", "b"])
    m = fc.ridge(fc.gram(xs, 4, "target"), 4, 1.0).first()
    med = np.nanmedian(x, axis=0)
    v = np.c_[np.where(np.isnan(x), med, x), np.isnan(x).astype(float)]
    sd = v.std(0)
    z = (v - v.mean(0)) / np.where(sd == 0, 1, sd)
    want = np.linalg.solve(z.T @ z + np.eye(4), z.T @ (y - y.mean()))
    np.testing.assert_allclose(m.coef, want, rtol=1e-9, atol=1e-12)
    s = fc.metrics(fc.predict(xs, fc.ridge(fc.gram(xs, 4, "target"), 4, 1.0)), ["fold_id"], "target").first()
    assert s.mse == pytest.approx(np.mean((y.mean() + z @ want - y) ** 2)) and s.mse < s.baseline_mse


def test_panel_first_reasons(spark):
    t = datetime(2024, 1, 2)
    lab = lambda i, **k: dict(dict(decision_id=i, instrument_id=i, decision_at=t, outcome_end=t + timedelta(1), target_available_at=t + timedelta(2), quality="qualified", partition="dev", target_name="t", horizon_id="h",
                                   target_units="u", economic_event_group=None, target=1.0), **k)
    rows = [lab("ok"), lab("late", decision_at=datetime(2030, 1, 1)), lab("bad", quality="x"), lab("unit", target_units=""), lab("nof"), lab("int", outcome_end=t), lab("prot", partition="test"), lab("nan", target=float("nan"))]
    schema = ("decision_id string, instrument_id string, decision_at timestamp, outcome_end timestamp, target_available_at timestamp, quality string, partition string, target_name string, horizon_id string, "
              "target_units string, economic_event_group string, target double")
    labels = spark.createDataFrame([tuple(r[c.split()[0]] for c in schema.split(", ")) for r in rows] + [tuple(lab("dup")[c.split()[0]] for c in schema.split(", "))] * 2, schema)
    feats = spark.createDataFrame([(i, i, t, t, {"a": 1.0}) for i in ("ok", "bad", "unit", "int", "prot", "nan", "dup", "late")], "decision_id string, instrument_id string, decision_at timestamp, available_at timestamp, features map<string,double>")
    got = {r.decision_id: r.reason for r in fc.panel(feats, labels, ["a"], "2025-01-01", "t", "h", units="u").collect()}
    assert got == {"ok": None, "late": "outside_development_window", "bad": "unqualified_target", "unit": "target_unit_contract_missing", "nof": "missing_features", "int": "invalid_outcome_interval",
                   "prot": "protected_holdout_row", "nan": "finite_number_required", "dup": "duplicate_instrument_decision"}


def test_one_resampling_rule_at_every_size(spark):
    """256 and 257 rows: weights of mean 1 and variance 1 for each row, intervals of nearly the same width."""
    from tidemark.operators import resample as rs
    rows = [(k, f"{k}-{i}", float(i % 16)) for k, n in (("a", 256), ("b", 257), ("c", 4)) for i in range(n)]
    got = {r.k: r for r in rs.bootstrap_ci(spark.createDataFrame(rows, "k string, id string, v double"), ["k"], "id", "v").collect()}
    assert got["c"].ci_lo is None
    width = {k: got[k].ci_hi - got[k].ci_lo for k in "ab"}
    expected = 2 * 1.96 * (sum((i - 7.5) ** 2 for i in range(16)) / 16) ** 0.5 / 16
    assert all(abs(w / expected - 1) < 0.12 for w in width.values())


def test_replicate_sums_add_up_over_keys_and_partitions(spark):
    """Vectors joined over tasks equal the weights drawn one by one; nulls count for nothing; null keys are a group."""
    import hashlib
    rows = [(k, f"e{i}", float(i), None if i % 3 else float(-i)) for i in range(60) for k in ("a", None)]
    df = spark.createDataFrame(rows, "k string, id string, v double, w double").repartition(5)
    got = {(r.k, r.name, r.rep): (r.w, r.wx) for r in rs.replicate_sums(df, ["k"], "id", ["v", "w"], 12, 3).collect()}
    assert len(got) == 2 * 2 * 12
    number = lambda text: int(hashlib.md5(text.encode()).hexdigest()[:8], 16) % rs.PRIME
    for rep in range(12):
        a, b, c = (number(f"3|{rep}|{x}") for x in "abc")
        weight = {}
        for i in range(60):
            x = (a * number(f"3|e{i}") + b) % rs.PRIME
            u = (x * ((x + c) % rs.PRIME) % rs.PRIME) >> 15
            weight[i] = sum(u >= p for p in rs.POISSON)
        assert got["a", "v", rep] == got[None, "v", rep] == (sum(weight.values()), sum(weight[i] * i for i in weight))
        assert got["a", "w", rep] == (sum(weight[i] for i in weight if i % 3 == 0), -sum(weight[i] * i for i in weight if i % 3 == 0))


def test_drawn_weights_have_mean_and_variance_one_and_do_not_repeat():
    abc = rs._coefficients(400, 9)
    w = rs._weights(np.array([int(x) for x in np.random.default_rng(2).integers(0, rs.PRIME, 500)]), abc)
    assert abs(w.mean() - 1) < 0.02 and abs(w.var() - 1) < 0.04
    assert np.abs(np.corrcoef(w.T)[np.triu_indices(400, 1)]).mean() < 0.05


def test_boards_carry_intervals(spark):
    from tidemark.operators import boards
    rng = np.random.default_rng(4)
    wide = lambda shift: spark.createDataFrame([(f"e{i}", "21", float(rng.normal(shift, 1)), 0.5) for i in range(80)] + [("x", "42", 1.0, 2.0)], "id string, horizon string, call double, stock double")
    d = {(r.strategy, r.horizon): r for r in boards.difference(wide(3), wide(0), ["horizon"], ["call", "stock"], F.col("id")).collect()}
    assert d["call", "21"].ci_lo > 2 and d["call", "21"].ci_hi < 4 and d["call", "42"].ci_lo is None and d["call", "42"].difference is None
    assert (d["stock", "21"].ci_lo, d["stock", "21"].ci_hi) == (0, 0)
    top = boards.rank(spark.createDataFrame([("call", "21", 3.0, 2.0, 4.0, 80), ("call", "42", 1.0, -1.0, 2.0, 80), ("call", "exp", 1.0, None, None, 3)],
                                            "strategy string, horizon string, difference double, ci_lo double, ci_hi double, n_a long")).collect()
    assert [(r.strategy, r.horizons_ci_excludes_0) for r in top] == [("call", 1)]


def test_binomial_p_in_the_row_at_any_size(spark):
    from math import comb
    cases = [(k, n) for n in (1, 2, 3, 7, 12, 31) for k in range(n + 1)] + [(480, 1000), (500, 1000), (0, 1000), (49_700, 100_000)]
    got = {(r.k, r.n): r.p_value for r in inf.binomial_p(spark.createDataFrame(cases, "k long, n long"), [], "k", "n").collect()}
    for k, n in cases:
        if n > 5000:
            continue
        pk = comb(n, k)
        want = min(1.0, sum(c for c in (comb(n, i) for i in range(n + 1)) if c <= pk * (1 + 1e-7)) / 2 ** n)
        assert got[k, n] == pytest.approx(want, rel=1e-9)
    assert got[49_700, 100_000] == pytest.approx(0.058, abs=0.002)


def test_ranks_with_half_of_the_rows_in_one_key(spark):
    rng = np.random.default_rng(7)
    rows = [("hot" if i % 2 else f"k{i % 6}", float(rng.integers(0, 40)) if i % 3 else float(rng.normal()), float(rng.normal())) for i in range(900)]
    df = spark.createDataFrame(rows, "k string, a double, b double")
    import pandas as pd
    want = pd.DataFrame(rows, columns=["k", "a", "b"])
    ranked = {(r.k, r.a): r.r for r in inf.ranks(df, ["k"], "a", "r", pieces=7).collect()}
    for (k, a), r in zip(want[["k", "a"]].itertuples(index=False), want.groupby("k")["a"].rank()):
        assert ranked[k, a] == r
    got = {r.k: r.spearman for r in inf.spearman(df, ["k"], "a", "b").collect()}
    for k, g in want.groupby("k"):
        assert got[k] == pytest.approx(np.corrcoef(g["a"].rank(), g["b"].rank())[0, 1])
