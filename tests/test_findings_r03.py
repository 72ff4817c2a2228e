"""Cases of the third round's findings, each on a few rows."""

import math

from pyspark.sql import functions as F

import __spark_entry__ as entry


def near(a, b):
    return (math.isnan(a) and math.isnan(b)) if isinstance(b, float) and math.isnan(b) else a == b


def test_file_stream_reads_a_folder_of_part_files(spark, tmp_path):
    """a table is one file or a folder of part files."""
    from tidemark.streaming import pipelines as sp
    rows = spark.range(6).repartition(3)
    rows.write.parquet(f"{tmp_path}/in/t.parquet")
    one = [p for p in (tmp_path / "in" / "t.parquet").iterdir() if p.suffix == ".parquet"][0]
    (tmp_path / "file").mkdir()
    (tmp_path / "file" / "t.parquet").write_bytes(one.read_bytes())
    for place, n in (("in", 6), ("file", spark.read.parquet(f"{tmp_path}/file/t.parquet").count())):
        stream = sp.file_stream(spark, f"{tmp_path}/{place}", "t.parquet", rows.schema)
        stream.writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/c-{place}").trigger(availableNow=True).start(f"{tmp_path}/out-{place}").awaitTermination()
        assert spark.read.parquet(f"{tmp_path}/out-{place}").count() == n


def test_a_loss_beyond_everything_is_not_compounded_away(spark):
    """ln(1 + r) below r = -1 is NaN and stays so; at -1 everything is lost."""
    from tidemark.operators import series as se
    d = spark.createDataFrame([("a", 1, 0.5), ("a", 2, -1.5), ("a", 3, 0.5), ("b", 1, 0.5), ("b", 2, -1.0)], "k STRING, n INT, r DOUBLE").withColumn("day", F.date_add(F.lit("2020-01-01").cast("date"), "n"))
    e = {(x.k, x.n): x.equity for x in se.compound(d, ["k"], "day", "r").collect()}
    assert abs(e["a", 1] - 1.5) < 1e-12 and math.isnan(e["a", 2]) and math.isnan(e["a", 3]) and e["b", 2] == 0.0
    m = {x.k: x.m01 for x in se.monthly_returns(d, ["k"], "day", "r").collect()}
    assert math.isnan(m["a"]) and m["b"] == -1.0


def test_half_sizes_round_to_even(spark, tmp_path):
    """A size of 40.5 is 40, so 0 after the remainder: no such quote serves anything; 2.5 asks for 2."""
    ts = F.timestamp_seconds(F.col("s"))
    rows = spark.createDataFrame([(1, 1000, 1, "view", 0.2, 0), (2, 90_000_000, 1, "view", 20.25, 0), (3, 90_003_000, 1, "error", 2.5, 0)], "event_id LONG, s LONG, user_id LONG, event_type STRING, value DOUBLE, x INT")
    rows.select("event_id", ts.alias("ts"), "user_id", "event_type", "value", F.lit("{}").alias("props")).write.parquet(f"{tmp_path}/events.parquet")
    assert [tuple(r) for r in entry.queries()["quote_asof"](spark, str(tmp_path)).collect()] == [(3, None, "entry_quote_missing")]
    from tidemark.plans import accounts as pa
    assert pa.orders(spark, str(tmp_path)).first()["quantity"] == 3 and pa.quotes(spark, str(tmp_path)).where("quote_id = 2").first()["bid_size"] == 0


def test_mark_off_by_one_shows_at_any_size(spark):
    """a mark one unit off a ledger of 1e11 is a mismatch, though a share of 1e-11 only."""
    from tidemark.operators import accounts as ac
    big = 1e11
    s = spark.createDataFrame([("a", p, f"d{p}", p) for p in (1, 2, 3)], "account STRING, period INT, session_id STRING, close_at INT")
    m = spark.createDataFrame([("a", p, f"d{p}", p, big + p * 1e6 + (1.0 if p == 2 else 0.0)) for p in (1, 2, 3)], "account STRING, period INT, mark_session STRING, mark_at INT, nav DOUBLE")
    g = spark.createDataFrame([("a", p, 1e6, big + p * 1e6, True) for p in (1, 2, 3)], "account STRING, period INT, gain DOUBLE, final_equity DOUBLE, is_flat BOOLEAN")
    r = {x.period: x.reason for x in ac.nav_panel(s, m, g, ["account"], big, off=0.001).collect()}
    assert r == {1: None, 2: "mark_ledger_mismatch", 3: "prior_nav_missing"}


def test_ratios_over_zero_are_infinite(spark):
    """a period without a drawdown has an infinite Calmar ratio; 0 / 0 is NaN; null only where a part is."""
    from tidemark.operators import series as se
    d = spark.createDataFrame([(0.5, 0.0), (-0.5, 0.0), (0.0, 0.0), (None, 0.0), (1.0, None), (1.0, 4.0)], "a DOUBLE, b DOUBLE")
    got = [r.x for r in d.select(se.ratio("a", "b").alias("x")).collect()]
    assert all(near(x, y) for x, y in zip(got, [math.inf, -math.inf, math.nan, None, None, 0.25]))


def test_many_landed_documents_share_a_file(spark):
    """JSON documents land as arrays, so files do not grow with the rows; one key may hold several."""
    from pathlib import Path
    from tidemark.plans import landed
    from tidemark.sources import readers as rd
    d = spark.range(12).union(spark.range(1)).select("id", F.to_json(F.struct(F.col("id").cast("string").alias("cik"), F.lit(" n ").alias("name"))).alias("value"))
    at = landed._arrays(d, "test", "id", 5)
    assert len([*Path(at).rglob("*.txt")]) == 3
    assert sorted(r.cik for r in rd.issuer_metadata(spark, at).collect()) == sorted(f"{k:010d}" for k in [*range(12), 0])


def test_few_keys_are_joined_without_sorting_their_rows(spark):
    """quantile edges reach the rows by broadcast, in many keys by hot and cold parts; the rows of a key are in no sort."""
    from tidemark.operators import inference as inf, skew
    d = spark.range(2000).select((F.col("id") % 3).alias("k"), (F.col("id") * 7 % 1000).cast("double").alias("x"))
    out = inf.quantile_buckets(d, ["k"], "x")
    assert "SortMergeJoin" not in out._jdf.queryExecution().executedPlan().toString()
    want = sorted(map(tuple, out.groupBy("k", "bucket").count().collect()))
    assert sum(r[2] for r in want) == 2000 and len(want) == 30
    small, skew.SMALL = skew.SMALL, 0
    try:
        assert sorted(map(tuple, inf.quantile_buckets(d, ["k"], "x").groupBy("k", "bucket").count().collect())) == want
    finally:
        skew.SMALL = small


def test_digits_of_doubles_are_those_of_c(spark):
    """ties go to even and numbers beside a tie to their own side, as printf does it."""
    import random
    from tidemark.operators import audit as au
    r = random.Random(1)
    some = [r.uniform(-1, 1) * 10 ** r.randint(-9, 15) for _ in range(2000)] + [round(r.uniform(0, 1e5), 2) for _ in range(500)]
    ties = [k / 4096 for k in range(1, 4096, 7)] + [k / 8192 + 3 for k in range(0, 8192, 11)] + [(10 ** 8 + k + 0.5) * 10.0 for k in range(200)] + [float(f"{10 ** 8 + k}5e{e}") for k in range(0, 4000, 37) for e in (-20, -15, -12, -9, -3, 2)]
    ties += [float(f"{10 ** 12 + k * 7}5e{e}") for k in range(500) for e in (-18, -13, -10, -3, 1)]
    values = [*some, *ties, *[-t for t in ties[:100]], 0.0, 1.0, 9.9999999999999e3, 999999999.5, 99999999.95, 1e-30, 1e300]
    d = spark.createDataFrame([(v,) for v in values], "v DOUBLE")
    for digits in (8, 12):
        got = d.select("v", au.scientific(F.col("v"), digits).alias("t")).collect()
        assert [(x.v, x.t) for x in got if x.t != f"%.{digits}e" % x.v] == []


def test_edit_distances_of_many_texts_at_once():
    """a text against a block of others, bit-parallel; the plain table is the truth."""
    from tidemark.operators import wording as wd

    def plain(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (x != y)))
            row = new
        return row[-1]

    texts = ["", "a", "abcdefg", "abcdefgh", "abcdefghi", "ééé ☃ abc", "ab" * 40, "x" * 63, "x" * 64, "x" * 65, "kitten sitting in the kitchen"]
    sizes, to = wd._distances(texts)
    assert sizes.tolist() == [len(t) for t in texts]
    for p in ["", "b", "hgfedcba", "☃é", "ba" * 41, "x" * 64, "sitting kitten", "z" * 100]:
        assert to(p).tolist() == [plain(t, p) for t in texts]


def test_best_prior_without_text_and_with_repeated_lines(spark):
    """null texts are like nothing; of repeated prior lines the first counts, also over blocks."""
    from tidemark.operators import wording as wd
    schema = "k INT, item STRING, pos INT, text STRING"
    cur = [(1, None, 0, "aab"), (1, None, 1, None), (1, None, 2, "aab"), (1, None, 3, "zzz"), (2, "x", 0, "aab")]
    pri = [(1, None, 0, None), (1, None, 1, "aac"), (1, None, 2, "aad"), (1, None, 3, "aac"), (2, "y", 0, "aab")]
    for block in (1, 2, 64):
        got = {(r.k, r.pos): (r.novelty, r.prior_pos) for r in wd.best_prior(spark.createDataFrame(cur, schema), spark.createDataFrame(pri, schema), ["k"], block).collect()}
        assert got == {(1, 0): ("changed", 1), (1, 1): ("new_statement", None), (1, 2): ("changed", 1), (1, 3): ("new_statement", None), (2, 0): ("new_statement", None)}
