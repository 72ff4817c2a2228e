import numpy as np
import time
import hashlib
import json
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from tidemark.functions import gates, scalars as fn
from tidemark.operators import accounts as ac, audit as au, catalog as ct
from tidemark.sources import readers as rd, sinks
from tidemark.streaming import pipelines as sp


def test_pages_and_jsonl(spark, tmp_path):
    (tmp_path / "p1.json").write_text(json.dumps({"results": [{"cik": "1", "filing_date": "2024-01-02", "tickers": ["A"], "tertiary_category": "x"}]}, indent=1))
    (tmp_path / "p2.json").write_text(json.dumps({"results": []}))
    assert [r.cik for r in rd.pages(spark, str(tmp_path / "p*.json"), rd.DISCLOSURE).collect()] == ["1"]
    m = tmp_path / "m.jsonl"
    m.write_text('{"document_id":"a","source_path":"x"}\n\n{bad\n{"document_id":"a","source_path":""}\n')
    rows, errors = rd.jsonl(spark, str(m), rd.MANIFEST_ROW)
    assert rows.count() == 2 and [e.line for e in errors.collect()] == ["{bad"]
    assert {r.reason for r in rd.manifest(spark, str(m))[1].collect()} == {"id_and_path_required", "malformed_line", "duplicate_document_id"}
    (tmp_path / "e.jsonl").write_text("\n")
    assert [r.reason for r in rd.manifest(spark, str(tmp_path / "e.jsonl"))[1].collect()] == ["empty_manifest"]


def test_strict_csv_json_and_files(spark, tmp_path):
    (tmp_path / "ok.csv").write_text("cik,accession_number,ticker,event_date,t_pre,t_0\n0001,a,T,2024-01-08,2024-01-05,2024-01-09\n")
    assert rd.csv_table(spark, str(tmp_path / "ok.csv"), rd.EVENTS).first().cik == "0001"
    (tmp_path / "bad.csv").write_text("contract_ticker,session,close,volume\nx,2024-01-08,abc,1\n")
    with pytest.raises(Exception):
        rd.csv_table(spark, str(tmp_path / "bad.csv"), rd.OPTION_BARS).collect()
    (tmp_path / "nan.json").write_text('{"a": NaN}')
    with pytest.raises(Exception):
        rd.strict_json(spark, str(tmp_path / "nan.json"), "a double").collect()
    f = rd.hashed_files(spark, str(tmp_path / "ok.csv")).first()
    assert f.sha256 == hashlib.sha256((tmp_path / "ok.csv").read_bytes()).hexdigest()
    assert "content" not in rd.file_inventory(spark, str(tmp_path)).columns
    d = tmp_path / "d.csv"
    d.write_text("Word,Negative,Positive\nloss,2009,0\ngain,0,1\n")
    assert {(r.word, r.category) for r in rd.dictionary(spark, str(d), ["Negative", "Positive"]).collect()} == {("LOSS", "negative"), ("GAIN", "positive")}
    h = spark.createDataFrame([("<ACCEPTANCE-DATETIME>20240105161502\n",), ("none",)], "value string")
    assert [r.accepted_at for r in rd.acceptance_time(h).collect()] == [datetime(2024, 1, 5, 16, 15, 2), None]


def test_chain_needs_standard_multiplier(spark):
    s = spark.createDataFrame([("a", date(2024, 4, 1), 100), ("b", date(2024, 4, 1), None), ("c", date(2024, 4, 1), 10), ("d", date(2025, 4, 1), 100)], "ticker string, expiration_date date, shares_per_contract int")
    assert [r.ticker for r in rd.option_chain(s.withColumn("as_of", F.lit("2024-01-02").cast("date")), "as_of", 2, 180).collect()] == ["a"]


def test_run_folder_refuses_overwrite_and_upsert(spark, tmp_path):
    t = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    m = sinks.write_run({"t": t}, str(tmp_path / "run"))
    assert m.first().rows == 2
    with pytest.raises(Exception):
        sinks.write_run({"t": t}, str(tmp_path / "run"))
    swapped = au.content_hash(t.orderBy(F.desc("k")).repartition(3), "t").first().sha256
    assert swapped == m.first().sha256 != au.content_hash(t.where("k = 1"), "t").first().sha256
    merged = sinks.upsert(t.withColumn("at", F.lit(1)), spark.createDataFrame([(2, "c", 2), (3, "d", 2)], "k int, v string, at int"), ["k"], "at")
    assert {(r.k, r.v) for r in merged.collect()} == {(1, "a"), (2, "c"), (3, "d")}
    runs = t.withColumn("run_id", F.lit("r1"))
    sinks.replace_runs(runs, str(tmp_path / "w"))
    sinks.replace_runs(t.withColumn("run_id", F.lit("r2")), str(tmp_path / "w"))
    sinks.replace_runs(runs.where("k = 1"), str(tmp_path / "w"))
    assert {(r.run_id, r.k) for r in spark.read.parquet(str(tmp_path / "w")).collect()} == {("r1", 1), ("r2", 1), ("r2", 2)}


def test_canonical_digest_is_compact_sorted_json(spark):
    row = {"b": 1, "a": 'x"y', "c": None}
    want = hashlib.sha256(json.dumps(row, sort_keys=True, separators=(",", ":")).encode()).hexdigest()
    df = spark.createDataFrame([(1, 'x"y', None)], "b int, a string, c string")
    assert df.select(fn.canonical_digest({k: F.col(k) for k in row}).alias("h")).first().h == want


def test_export_audit_and_url_rules(spark):
    e = spark.createDataFrame([("t1", 1, "a" * 64), ("bad name", 1, "a" * 64), ("t2", 1, "b" * 64), ("t3", 1, "c" * 64)], "table_name string, expected_rows int, expected_sha256 string")
    o = spark.createDataFrame([("t1", "A" * 64, "x"), ("t2", "f" * 64, "x"), ("t3", "f" * 64, "version https://git-lfs.github.com/spec/v1")], "table_name string, observed_sha256 string, head string")
    assert {r.table_name: r.status for r in au.export_audit(e, o).collect()} == {"t1": "verified", "bad name": "invalid_manifest", "t2": "hash_mismatch", "t3": "lfs_pointer"}
    ok = gates.archive_path_ok(F.col("p"), F.lit("0000000077"), F.lit("0000000077-24-000001"))
    p = ["/Archives/edgar/data/77/0000000077-24-000001.txt", "/Archives/edgar/data/77/000000007724000001/a.htm", "/Archives/edgar/data/78/0000000077-24-000001.txt", "/Archives/edgar/data/77/000000007724000001/a/b.htm"]
    assert [r.x for r in spark.createDataFrame([(x,) for x in p], "p string").select(ok.alias("x")).collect()] == [True, True, False, False]
    i = spark.createDataFrame([("77", "0000000077-24-000001"), ("0", "0000000077-24-000001"), ("7x", "b")], "c string, a string")
    assert [r.x for r in i.select(gates.identity_ok(F.col("c"), F.col("a")).alias("x")).collect()] == [True, False, False]


def test_nav_panel_reasons(spark):
    s = spark.createDataFrame([("a", i, f"s{i}", date(2024, 1, i)) for i in range(1, 6)], "account string, period int, session_id string, close_at date")
    m = spark.createDataFrame([("a", 1, "s1", date(2024, 1, 1), 100.0), ("a", 2, "s2", date(2024, 1, 2), 110.0), ("a", 3, "s3", date(2024, 1, 3), 120.0), ("a", 4, "zz", date(2024, 1, 4), 120.0)],
                              "account string, period int, mark_session string, mark_at date, nav double")
    g = spark.createDataFrame([("a", 2, 10.0, 110.0, True)], "account string, period int, gain double, final_equity double, is_flat boolean")
    r = {x.period: x for x in ac.nav_panel(s, m, g, ["account"], 100.0).collect()}
    assert r[1].net_return == 0 and r[2].net_return == pytest.approx(.1) and r[3].reason == "unreconciled_no_trade_nav" and r[4].reason == "mark_session_mismatch" and r[5].reason == "missing_mark"


def test_quote_size_is_first_come(spark):
    o = spark.createDataFrame([("q", "buy", i, 40.0, 100.0) for i in range(5)], "q string, side string, i int, n double, size double")
    r = {x.i: x.reason for x in ac.consume(o, "q", "side", ["i"], "n", "size", F.col("i")).collect()}
    assert [r[i] for i in range(5)] == [None, None] + ["quote_size_exhausted"] * 3


def test_names_and_industries(spark):
    d = spark.createDataFrame([("The Foo Software, Inc.", "7372"), ("Group", None)], "n string, sic string")
    r = d.select(fn.company_name(F.col("n")).alias("a"), fn.search_name(F.col("n")).alias("b"), ct.division(F.col("sic")).alias("d")).collect()
    assert (r[0].a, r[0].b, r[0].d) == ("foo software", "Foo Software", "Services") and (r[1].b, r[1].d) == ("Group", ct.UNKNOWN)


def test_stream_restart_does_not_double_count(spark, tmp_path):
    src, out, ck = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "ck")
    mk = lambda ids, d: spark.createDataFrame([(f"a{i}", datetime(2024, 1, d, 3), "c", "8-K") for i in ids], "accession string, at timestamp, company string, form string")
    mk(range(3), 1).write.mode("append").parquet(src)
    run = lambda: sp.incremental_counts(sp.file_stream(spark, src, "*.parquet", mk([], 1).schema), "accession", ["company", "form"], out, ck).awaitTermination()
    run()
    mk([2, 3], 2).write.mode("append").parquet(src)   # a2 arrives again
    run()
    run()
    assert sp.counted(spark, out, ["company", "form"]).first().n == 4


def test_stream_counts_filings_out_of_order(spark, tmp_path):
    src, out, ck = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "ck")
    mk = lambda ids, y: spark.createDataFrame([(f"a{i}", datetime(y, 1, 2, 3), "c", "8-K") for i in ids], "accession string, at timestamp, company string, form string")
    for ids, year in ((range(4), 2024), (range(4, 9), 2003), ([0, 9, 10, 11], 2015)):   # years late, and a repeat with another clock
        mk(ids, year).write.mode("append").parquet(src)
        sp.incremental_counts(sp.file_stream(spark, src, "*.parquet", mk([], 2024).schema), "accession", ["company", "form"], out, ck).awaitTermination()
    assert sp.counted(spark, out, ["company", "form"]).first().n == 12


def test_late_quotes_and_orders_meet_whatever_batch_they_come_in(spark, tmp_path):
    """Three batches out of order, months apart, give the pairs of one batch join; what cannot match is kept with its reason."""
    from datetime import datetime, timedelta

    from tidemark.streaming import pipelines as sp
    rng = np.random.default_rng(3)
    t0 = datetime(2024, 1, 1)
    rows = []
    for i in range(240):
        at = t0 + timedelta(minutes=int(rng.integers(0, 60 * 24 * 100)))
        side = "order" if i % 3 == 0 else "quote"
        rows.append((side, f"{side}{i}", "hot" if i % 2 else f"k{i % 5}", at, at + timedelta(minutes=int(rng.integers(0, 200)))))
    odd = [("quote", "q-null", None, t0, t0), ("quote", "q-clock", "hot", None, t0), ("order", None, "hot", t0, t0), ("note", "n", "hot", t0, t0), ("quote", "q-early", "hot", t0, t0 - timedelta(1)), rows[0], rows[100]]
    schema = "side string, id string, k string, at timestamp, seen_at timestamp"
    order = rng.permutation(len(rows))
    for b in range(3):
        part = [rows[i] for i in order[b::3]] + (odd if b == 2 else [])
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        time.sleep(1.1)  # files are taken in order of their time
    age = 3 * 86400
    out = f"{tmp_path}/out"
    stream = sp.file_stream(spark, f"{tmp_path}/in", "*.parquet", spark.read.parquet(f"{tmp_path}/in").schema, 1)
    sp.quotes_for_orders(stream, age, out, f"{tmp_path}/check").awaitTermination()
    got = [(r.order_id, r.quote_id) for r in spark.read.parquet(f"{out}/matches").collect()]
    want = sorted((o[1], q[1]) for o in rows if o[0] == "order" for q in rows if q[0] == "quote" and o[2] == q[2] and 0 <= (o[3] - q[3]).total_seconds() <= age and q[4] <= o[3])
    assert sorted(got) == want and len(want) > 20
    rejected = sorted((r.reason, r.id) for r in spark.read.parquet(f"{out}/rejected").collect() if r.id)
    assert rejected == sorted([("no_key", "q-null"), ("no_clock", "q-clock"), ("unknown_side", "n"), ("seen_before_event", "q-early"), ("duplicate", rows[0][1]), ("duplicate", rows[100][1])])
    assert spark.read.parquet(f"{out}/rejected").where("id IS NULL").count() == 1
    assert spark.read.parquet(f"{out}/matches").select("batch").distinct().count() == 3


def test_latest_quote_of_a_size_with_a_hot_instrument(spark):
    """Against all pairs, with most rows in one key, broken quantities, sizes beyond the tree and quotes too old."""
    from datetime import datetime, timedelta

    from tidemark.operators import accounts as ac
    rng = np.random.default_rng(5)
    t0 = datetime(2024, 1, 1)
    at = lambda hours: t0 + timedelta(seconds=int(rng.integers(0, hours * 3600)))
    size = lambda: float(rng.choice([0, 1, 2.5, 3, 7, 8, 9, 64, 65.5, 3e6, 5e6]))
    quotes = []
    for i in range(220):
        a, bid = at(60), float(rng.integers(10, 20))
        quotes.append((f"q{i:03d}", "hot" if i % 3 else "cold", a, a + timedelta(seconds=int(rng.integers(0, 900))), bid, bid + 1, size(), size(), "update"))
    orders = [(i, "hot" if i % 2 else "cold", at(70), "buy" if i % 3 else "sell", float(rng.choice([0.5, 1, 2, 2.2, 7.5, 8, 64, 65, 2.5e6, 4e6]))) for i in range(160)]
    qd = spark.createDataFrame(quotes, "quote_id string, k string, at timestamp, available_at timestamp, bid double, ask double, bid_size double, ask_size double, evidence_kind string")
    od = spark.createDataFrame(orders, "oid int, k string, t timestamp, side string, n double")
    got = {r.oid: (r.quote_id, r.price) for r in ac.fill_price(od, qd, "k", "oid", "t", "side", "n", 6 * 3600.0).collect()}
    assert len(got) == len(orders)
    served = 0
    for oid, k, t, side, n in orders:
        each = [(a, v, i, ask if side == "buy" else bid) for i, q, a, v, bid, ask, bs, az, _ in quotes
                if q == k and a <= t and v <= t and (t - a).total_seconds() <= 6 * 3600 and (az if side == "buy" else bs) >= n]
        best = max(each, default=None)
        assert got[oid] == ((best[2], best[3]) if best else (None, None)), oid
        served += best is not None
    assert 40 < served < 160


def test_row_encoding_tells_types_nulls_and_borders_apart(spark):
    """Nested types, nulls, signed zeros and texts that look like other encodings never meet; column order does not matter."""
    from decimal import Decimal

    from tidemark.operators import audit as au
    schema = "a string, b array<string>, c map<string,int>, d struct<x:double,y:string>, e decimal(10,2), f binary, g float, h boolean"
    base = ("x", ["p", None], {"k": 1, "j": None}, (0.0, "t"), Decimal("1.50"), b"\x00", 1.5, True)
    other = [("x", ["p"], *base[2:]), ("x", ["pN"], *base[2:]), (None, *base[1:]), ("N", *base[1:]), ("x", None, *base[2:]), ("x", [], *base[2:]),
             (*base[:2], {"k": None, "j": 1}, *base[3:]), (*base[:3], (None, "t"), *base[4:]), (*base[:3], (float("nan"), "t"), *base[4:]), (*base[:7], None), (*base[:5], b"00", 1.5, True)]
    df = spark.createDataFrame([base, *other], schema)
    assert len({r[0] for r in df.select(au.row_digest(df)).collect()}) == len(other) + 1
    same = spark.createDataFrame([base, (*base[:2], {"j": None, "k": 1}, (-0.0, "t"), *base[4:])], schema)
    assert len({r[0] for r in same.select(au.row_digest(same)).collect()}) == 1
    turned = df.select(*reversed(df.columns))
    assert au.content_hash(df, "t").collect() == au.content_hash(turned.repartition(3), "t").collect()
    assert au.content_hash(df, "t").collect() != au.content_hash(df.unionByName(df), "t").collect()
