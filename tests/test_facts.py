"""Facts with two clocks against hand-written answers."""

from datetime import date as d

from pyspark.sql import functions as F

from tidemark.operators import facts as fa

SCHEMA = "issuer string, period_start date, period_end date, unit string, value double, known_at date"
Q1, Q2, Q3, FY, Y = d(2023, 3, 31), d(2023, 6, 30), d(2023, 9, 30), d(2023, 12, 31), d(2023, 1, 1)


def test_restatements_and_what_was_known(spark):
    rows = [("a", Y, Q1, "USD", 10.0, d(2023, 4, 20)), ("a", Y, Q1, "USD", 10.0, d(2023, 7, 1)), ("a", Y, Q1, "USD", 9.0, d(2024, 2, 1)), ("a", Y, Q1, "USD", 8.0, d(2024, 2, 1)),
            ("a", Y, Q1, "EUR", 7.0, d(2024, 3, 1)), ("b", Y, Q1, "USD", None, d(2023, 4, 20)), ("b", Y, Q1, "USD", 1.0, None)]
    f = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = {(r.issuer, r.unit): r for r in fa.views(f, ["issuer"], F.lit(d(2023, 12, 31))).collect()}
    usd, eur = got["a", "USD"], got["a", "EUR"]
    assert (usd.known_value, usd.known_at, usd.latest_value, usd.latest_at, usd.reports, usd.restated_since) == (10.0, d(2023, 7, 1), 9.0, d(2024, 2, 1), 4, True)
    assert (eur.known_value, eur.latest_value, eur.restated_since) == (None, 7.0, False) and len(got) == 2
    v = sorted((r.unit, r.known_from, r.known_to, r.value) for r in fa.versions(f, ["issuer"]).collect())
    assert v == [("EUR", d(2024, 3, 1), None, 7.0), ("USD", d(2023, 4, 20), d(2024, 2, 1), 10.0), ("USD", d(2024, 2, 1), None, 9.0)]


def test_quarters_from_year_to_date(spark):
    rows = [("a", Y, e, "USD", v, d(2024, 1, 1)) for e, v in ((Q1, 10.0), (Q2, 25.0), (Q3, 24.0), (FY, 60.0))] + [("b", Y, Q1, "USD", 1.0, Q1), ("b", Y, FY, "USD", 5.0, FY), ("c", Y, FY, "USD", 3.0, FY)]
    got = {(r.issuer, r.period_end): (r.period_start, r.value, r.status) for r in fa.quarters(spark.createDataFrame(rows, SCHEMA), ["issuer"]).collect()}
    assert got["a", Q1] == (Y, 10.0, "reported") and got["a", Q3] == (d(2023, 7, 1), -1.0, "derived") and got["a", FY] == (d(2023, 10, 1), 36.0, "derived")
    assert got["b", FY] == (d(2023, 4, 1), 4.0, "derived_long") and got["c", FY] == (Y, 3.0, "year_to_date")


def test_segments_against_the_whole(spark):
    rows = [("a", "x", 3.0), ("a", "eliminations", -1.0), ("a", "all", 2.4), ("b", "x", 1.0), ("b", "all", 9.0), ("c", "all", 1.0), ("d", "x", 1.0)]
    f = spark.createDataFrame([(i, s, v, Y, FY, "USD") for i, s, v in rows], "issuer string, segment string, value double, period_start date, period_end date, unit string")
    got = {r.issuer: (r.segments, r.status) for r in fa.segment_bridge(f, ["issuer"], "segment", "all", 0.5).collect()}
    assert got == {"a": (2, "reconciled"), "b": (1, "unresolved"), "c": (0, "not_disclosed"), "d": (1, "not_disclosed")}
