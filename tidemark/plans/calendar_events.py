"""Calendar alignment, event collapse and placebo queries over orders (filings) and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import calendar as cal
from ..functions import scalars as fn
from ..operators import events as ev
from .registry import query, table

START, END = "1994-01-01", "2026-12-31"

# Reference SQL for the session calendar: cal_sessions(session, ord) and cal_day(day, …).
CAL_CTE = f"""
yrs AS (SELECT unnest(range(1993, 2028))::INT AS y),
eas1 AS (SELECT y, y % 19 AS a, y // 100 AS b, y % 100 AS c FROM yrs),
eas2 AS (SELECT *, (19*a + b - b//4 - (b - (b+8)//25 + 1)//3 + 15) % 30 AS h FROM eas1),
eas3 AS (SELECT *, (32 + 2*(b%4) + 2*(c//4) - h - (c%4)) % 7 AS l FROM eas2),
eas4 AS (SELECT *, (a + 11*h + 22*l)//451 AS m FROM eas3),
easter AS (SELECT make_date(y, (h+l-7*m+114)//31, (h+l-7*m+114)%31 + 1) AS d FROM eas4),
fixed_days AS (
  SELECT make_date(y,1,1) AS d, 0 AS sat_back FROM yrs UNION ALL
  SELECT make_date(y,6,19), 1 FROM yrs WHERE y >= 2022 UNION ALL
  SELECT make_date(y,7,4), 1 FROM yrs UNION ALL SELECT make_date(y,12,25), 1 FROM yrs),
months AS (SELECT make_date(y, m, 1) AS f, iso, nth FROM yrs, (VALUES (1,1,3),(2,1,3),(9,1,1),(11,4,4)) r(m, iso, nth)),
closures AS (
  SELECT CASE WHEN isodow(d)=7 THEN d+1 WHEN isodow(d)=6 AND sat_back=1 THEN d-1 ELSE d END AS d FROM fixed_days
  UNION SELECT f + ((iso - isodow(f) + 7) % 7)::INT + 7*(nth-1) FROM months
  UNION SELECT make_date(y,5,31) - (isodow(make_date(y,5,31)) - 1)::INT FROM yrs
  UNION SELECT d - 2 FROM easter UNION SELECT DATE '2025-01-09'),
all_days AS (SELECT unnest(range(DATE '{START}', DATE '{END}' + 1, INTERVAL 1 DAY))::DATE AS day),
cal_sessions AS (SELECT day AS session, (row_number() OVER (ORDER BY day) - 1)::INT AS ord
                 FROM all_days WHERE isodow(day) < 6 AND day NOT IN (SELECT d FROM closures)),
cal_j AS (SELECT day, session, ord FROM all_days LEFT JOIN cal_sessions ON session = day),
cal_day AS (SELECT day,
  max(session) OVER (ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev_strict,
  max(session) OVER (ORDER BY day ROWS UNBOUNDED PRECEDING) AS prev_incl,
  min(session) OVER (ORDER BY day ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS next_incl,
  min(session) OVER (ORDER BY day ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS next_strict,
  max(ord) OVER (ORDER BY day ROWS UNBOUNDED PRECEDING) AS ord_incl FROM cal_j)
"""


def days(spark):
    return cal.day_table(spark, START, END)


def filings(spark, sf_dir):
    """Orders as filings: filer = customer, date = order date, ticker from the customer key."""
    o = table(spark, sf_dir, "orders")
    raw_ticker = F.concat(F.lit(" c"), (F.col("o_custkey") / 2).cast("bigint").cast("string"), F.lit("/a "))
    return o.select(
        fn.zero_pad(F.col("o_custkey")).alias("cik"), F.to_date("o_orderdate").alias("filing_date"),
        fn.ticker(raw_ticker).alias("ticker"), fn.zero_pad(F.col("o_orderkey"), 12).alias("accession_number"),
        F.when(F.col("o_orderstatus") == "F", F.col("o_orderpriority")).alias("filing_url"),
        F.col("o_orderstatus").alias("supporting_text"))


def universe(spark, sf_dir):
    c = table(spark, sf_dir, "customer").where(F.col("c_mktsegment").isin("BUILDING", "MACHINERY"))
    raw_ticker = F.concat(F.lit("C"), (F.col("c_custkey") / 2).cast("bigint").cast("string"), F.lit(".A"))
    return c.select(raw_ticker.alias("ticker"))


FILINGS_CTE = """
filings AS (SELECT lpad(o_custkey::VARCHAR, 10, '0') AS cik, o_orderdate::DATE AS filing_date,
  'C' || (o_custkey // 2) || '.A' AS ticker, lpad(o_orderkey::VARCHAR, 12, '0') AS accession_number,
  CASE WHEN o_orderstatus = 'F' THEN o_orderpriority END AS filing_url, o_orderstatus AS supporting_text FROM orders),
universe AS (SELECT DISTINCT 'C' || (c_custkey // 2) || '.A' AS ticker FROM customer
             WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')),
collapsed AS (SELECT cik, filing_date, first(ticker ORDER BY accession_number) AS ticker,
  first(accession_number ORDER BY accession_number) AS accession_number,
  first(filing_url ORDER BY accession_number) FILTER (filing_url IS NOT NULL) AS filing_url,
  first(supporting_text ORDER BY accession_number) AS supporting_text
  FROM filings WHERE ticker IN (SELECT ticker FROM universe) GROUP BY cik, filing_date),
ev AS (SELECT c.*, next_strict AS t_0, prev_strict AS t_pre,
  date_diff('day', lag(filing_date) OVER (PARTITION BY ticker ORDER BY filing_date, cik), filing_date) AS days_since_prev_event
  FROM collapsed c JOIN cal_day ON day = filing_date)
"""


def study_events(spark, sf_dir):
    return ev.collapse(filings(spark, sf_dir), universe(spark, sf_dir), days(spark))


@query("session_align", f"""WITH {CAL_CTE}
SELECT o_orderkey, a.prev_strict, a.prev_incl, a.next_incl, a.next_strict,
       (b.ord_incl - a.ord_incl)::INT AS sessions_next_10d
FROM orders JOIN cal_day a ON a.day = o_orderdate::DATE JOIN cal_day b ON b.day = o_orderdate::DATE + 10""")
def session_align(spark, sf_dir):
    d = days(spark)
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("d"))
    o = cal.align(o, "d", d, {c: c for c in ("prev_strict", "prev_incl", "next_incl", "next_strict", "ord_incl")})
    o = cal.align(o.withColumn("d10", F.date_add("d", 10)), "d10", d, {"ord_incl": "ord_10"})
    return o.select("o_orderkey", "prev_strict", "prev_incl", "next_incl", "next_strict",
                    cal.sessions_between("ord_incl", "ord_10").alias("sessions_next_10d"))


@query("event_collapse", f"WITH {CAL_CTE}, {FILINGS_CTE} SELECT * FROM ev")
def event_collapse(spark, sf_dir):
    return study_events(spark, sf_dir)


@query("events_by_year", f"""WITH {CAL_CTE}, {FILINGS_CTE}
SELECT year(filing_date)::INT AS year, count(*) AS events, count(DISTINCT ticker) AS tickers FROM ev GROUP BY 1""")
def events_by_year(spark, sf_dir):
    """A8."""
    return study_events(spark, sf_dir).groupBy(F.year("filing_date").alias("year")).agg(
        F.count("*").alias("events"), F.countDistinct("ticker").alias("tickers"))


@query("placebo_sample", f"""WITH {CAL_CTE}, {FILINGS_CTE},
evid AS (SELECT *, cik || ':' || filing_date AS event_id FROM ev),
keyed AS (SELECT *, ('0x' || substr(md5('7|pick|' || event_id), 1, 8))::BIGINT / 4294967296.0 AS h FROM evid),
draws AS (SELECT draw, ('0x' || substr(md5('7|event|' || draw), 1, 8))::BIGINT / 4294967296.0 AS u, ('0x' || substr(md5('7|session|' || draw), 1, 8))::BIGINT / 4294967296.0 AS v FROM range(120) r(draw)),
picked AS (SELECT draw, v, coalesce(k.event_id, f.event_id) AS event_id, coalesce(k.ticker, f.ticker) AS ticker FROM draws d
  ASOF LEFT JOIN keyed k ON d.u <= k.h CROSS JOIN (SELECT event_id, ticker FROM keyed ORDER BY h, event_id LIMIT 1) f),
free AS (SELECT t.ticker, s.session, row_number() OVER (PARTITION BY t.ticker ORDER BY s.session) - 1 AS i, count(*) OVER (PARTITION BY t.ticker) AS n
  FROM (SELECT DISTINCT ticker FROM picked) t, cal_sessions s WHERE s.session BETWEEN DATE '1995-01-01' AND DATE '2001-08-01'
  AND NOT EXISTS (SELECT 1 FROM evid e WHERE e.ticker = t.ticker AND abs(date_diff('day', e.filing_date, s.session)) <= 30))
SELECT draw, p.ticker, event_id, f.session AS filing_date, CASE WHEN f.session IS NULL THEN 'no_admissible_session' END AS reason
FROM picked p LEFT JOIN free f ON f.ticker = p.ticker AND f.i = floor(p.v * f.n)""")
def placebo_sample(spark, sf_dir):
    e = study_events(spark, sf_dir).withColumn("event_id", F.concat_ws(":", "cik", F.col("filing_date").cast("string")))
    pool = cal.sessions(spark, START, END).where(F.col("session").between("1995-01-01", "2001-08-01"))
    return ev.placebo(e, pool.select("session"), n=120, gap_days=30, seed=7)


@query("bars_epoch_session", """SELECT user_id, (ts AT TIME ZONE 'UTC' AT TIME ZONE 'America/New_York')::DATE AS session,
  arg_max(value, (ts, event_id)) AS close, sum(coalesce(json_extract(props, '$.k')::BIGINT, 0))::BIGINT AS volume
FROM events GROUP BY 1, 2""")
def bars_epoch_session(spark, sf_dir):
    """Epoch milliseconds to the exchange date, JSON member as volume, missing volume is zero."""
    from ..sources.readers import bars_from_epoch
    e = table(spark, sf_dir, "events").select(
        "user_id", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), F.col("value").alias("c"),
        F.get_json_object("props", "$.k").cast("bigint").alias("v"))
    bars = bars_from_epoch(e.withColumn("t", F.floor(F.col("us") / 1000)), ["user_id", "event_id", "us"])
    return bars.groupBy("user_id", "session").agg(F.max_by("close", F.struct("us", "event_id")).alias("close"),
                                                  F.sum("volume").cast("bigint").alias("volume"))


@query("season_mask", """SELECT month(o_orderdate)::INT AS month, month(o_orderdate) IN (7, 8) AS in_season,
  count(*) AS filings FROM orders GROUP BY 1, 2""")
def season_mask(spark, sf_dir):
    """P25."""
    return (table(spark, sf_dir, "orders").groupBy(F.month("o_orderdate").alias("month"))
            .agg(F.count("*").alias("filings")).withColumn("in_season", F.col("month").isin(7, 8)))


@query("accepted_after_close", """SELECT user_id, avg((hour(ts) >= 16)::INT) AS share_after_16, count(*) AS n
FROM events GROUP BY 1""")
def accepted_after_close(spark, sf_dir):
    """A33."""
    return table(spark, sf_dir, "events").groupBy("user_id").agg(
        F.avg((F.hour(F.col("ts").cast("timestamp")) >= 16).cast("int")).alias("share_after_16"), F.count("*").alias("n"))


@query("first_events", f"""WITH {CAL_CTE}, {FILINGS_CTE}
SELECT cik, filing_date, accession_number FROM ev ORDER BY filing_date, cik LIMIT 50""")
def first_events(spark, sf_dir):
    """The first N events by date (top-N without a global sort)."""
    return (study_events(spark, sf_dir).select("cik", "filing_date", "accession_number")
            .orderBy("filing_date", "cik").limit(50))


@query("hash_sample", """SELECT o_orderkey FROM orders
ORDER BY ('0x' || substr(md5('1|' || o_orderkey), 1, 8))::BIGINT, o_orderkey LIMIT 25""")
def hash_sample(spark, sf_dir):
    """T5: reproducible sample, ordered by a seeded hash."""
    o = table(spark, sf_dir, "orders").select("o_orderkey")
    return o.orderBy(ev.hash_unit(F.lit(1), F.col("o_orderkey")), "o_orderkey").limit(25)
