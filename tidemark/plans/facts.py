"""Facts with two clocks. Roles: line items as reported facts of suppliers, known some weeks after they are shipped; orders as segments of customers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import facts as fa
from .registry import query, table

AS_OF = "1997-06-30"
RAW = """f AS (SELECT l_suppkey AS issuer, l_returnflag AS metric, date_trunc('quarter', l_shipdate)::DATE AS period_start, (date_trunc('quarter', l_shipdate) + INTERVAL 3 MONTH)::DATE - 1 AS period_end,
  CASE WHEN l_tax > 0.07 THEN 'shares' ELSE 'USD' END AS unit, CASE WHEN l_linenumber < 7 THEN l_quantity END AS value, l_shipdate::DATE + (l_linenumber * 30)::INT AS known_at FROM lineitem)"""


def raw(spark, sf_dir):
    q = F.trunc(F.to_date("l_shipdate"), "quarter")
    return table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("issuer"), F.col("l_returnflag").alias("metric"), q.alias("period_start"), F.date_sub(F.add_months(q, 3), 1).alias("period_end"),
                                                   F.when(F.col("l_tax") > 0.07, "shares").otherwise("USD").alias("unit"), F.when(F.col("l_linenumber") < 7, F.col("l_quantity")).alias("value"),
                                                   F.date_add(F.to_date("l_shipdate"), F.col("l_linenumber") * 30).alias("known_at"))


OWN = "issuer, metric, period_start, period_end, unit"


@query("fact_views", f"""WITH {RAW} SELECT {OWN}, arg_max(value, (known_at, value)) FILTER (known_at <= DATE '{AS_OF}') AS known_value, max(known_at) FILTER (known_at <= DATE '{AS_OF}') AS known_at,
  arg_max(value, (known_at, value)) AS latest_value, max(known_at) AS latest_at, count(*) AS reports,
  coalesce(arg_max(value, (known_at, value)) FILTER (known_at <= DATE '{AS_OF}') <> arg_max(value, (known_at, value)), false) AS restated_since FROM f WHERE value IS NOT NULL GROUP BY {OWN}""")
def fact_views(spark, sf_dir):
    """V6: every fact as known on a date and as it stands now."""
    return fa.views(raw(spark, sf_dir), ["issuer", "metric"], F.lit(AS_OF).cast("date"))


@query("fact_versions", f"""WITH {RAW}, o AS (SELECT {OWN}, known_at, max(value) AS value FROM f WHERE value IS NOT NULL GROUP BY ALL),
c AS (SELECT * FROM o QUALIFY coalesce(lag(value) OVER (PARTITION BY {OWN} ORDER BY known_at) <> value, true))
SELECT {OWN}, value, known_at AS known_from, lead(known_at) OVER (PARTITION BY {OWN} ORDER BY known_at) AS known_to FROM c""")
def fact_versions(spark, sf_dir):
    """V6: the values of every fact with the time each was the known one."""
    return fa.versions(raw(spark, sf_dir), ["issuer", "metric"])


YTD = """y AS (SELECT o_custkey AS issuer, 'USD' AS unit, date_trunc('year', o_orderdate)::DATE AS period_start, (date_trunc('quarter', o_orderdate) + INTERVAL 3 MONTH)::DATE - 1 AS period_end, count(*) AS n FROM orders GROUP BY ALL),
t AS (SELECT issuer, unit, period_start, period_end, (sum(n) OVER (PARTITION BY issuer, period_start ORDER BY period_end))::BIGINT AS value FROM y)"""


@query("derived_quarters", f"""WITH {YTD}, l AS (SELECT *, lag(period_end) OVER w AS pe, lag(value) OVER w AS pv FROM t WINDOW w AS (PARTITION BY issuer, period_start ORDER BY period_end))
SELECT issuer, unit, coalesce(pe + 1, period_start) AS period_start, period_end, value - coalesce(pv, 0) AS value,
  CASE WHEN pe IS NULL THEN CASE WHEN period_end - period_start + 1 <= 100 THEN 'reported' ELSE 'year_to_date' END WHEN period_end - pe <= 100 THEN 'derived' ELSE 'derived_long' END AS status FROM l""")
def derived_quarters(spark, sf_dir):
    """V6: quarters of every issuer from its year-to-date counts; quarters without orders leave gaps."""
    d = F.to_date("o_orderdate")
    q = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("issuer"), F.trunc(d, "year").alias("period_start"), F.date_sub(F.add_months(F.trunc(d, "quarter"), 3), 1).alias("period_end")).agg(F.count("*").alias("n"))
    w = fa.W.partitionBy("issuer", "period_start").orderBy("period_end")
    return fa.quarters(q.select("issuer", F.lit("USD").alias("unit"), "period_start", "period_end", F.sum("n").over(w).alias("value")), ["issuer"])


@query("segment_bridge", """WITH s AS (SELECT o_custkey AS issuer, date_trunc('year', o_orderdate)::DATE AS period_start, o_orderpriority AS seg, count(*) AS n FROM orders GROUP BY ALL),
a AS (SELECT issuer, period_start, seg, n FROM s WHERE issuer % 9 <> 4 UNION ALL SELECT issuer, period_start, 'all', sum(n) + max(CASE WHEN issuer % 5 = 2 THEN 1 ELSE 0 END) FROM s WHERE issuer % 7 <> 3 GROUP BY issuer, period_start),
g AS (SELECT issuer, period_start, count(*) FILTER (seg <> 'all') AS segments, (sum(n) FILTER (seg <> 'all'))::BIGINT AS segment_sum, (max(n) FILTER (seg = 'all'))::BIGINT AS consolidated FROM a GROUP BY ALL)
SELECT issuer, period_start, (period_start + INTERVAL 1 YEAR)::DATE - 1 AS period_end, 'orders' AS unit, segments, segment_sum, consolidated, consolidated - segment_sum AS residual,
  CASE WHEN consolidated - segment_sum IS NULL THEN 'not_disclosed' WHEN abs(consolidated - segment_sum) <= 0 THEN 'reconciled' ELSE 'unresolved' END AS status FROM g""")
def segment_bridge(spark, sf_dir):
    """V6: order counts by priority against the customer's yearly count; some totals and some segments are missing, some totals are off by one."""
    y = F.trunc(F.to_date("o_orderdate"), "year")
    s = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("issuer"), y.alias("period_start"), F.col("o_orderpriority").alias("segment")).agg(F.count("*").alias("value"))
    total = s.where("issuer % 7 <> 3").groupBy("issuer", "period_start").agg(F.sum("value").alias("value")).withColumn("value", F.col("value") + F.when(F.col("issuer") % 5 == 2, 1).otherwise(0))
    rows = s.where("issuer % 9 <> 4").unionByName(total.withColumn("segment", F.lit("all")))
    rows = rows.withColumns({"period_end": F.date_sub(F.add_months("period_start", 12), 1), "unit": F.lit("orders")})
    return fa.segment_bridge(rows, ["issuer"], "segment", "all", 0)
