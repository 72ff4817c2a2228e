"""As-of mark queries. Role: line items are trades of a part; every (part, order date) pair asks for a mark."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import calendar as cal
from ..operators import asof
from ..staging import stage
from .calendar_events import CAL_CTE, days
from .registry import query, table


def part_bars(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select("l_partkey", F.to_date("l_shipdate").alias("session"), F.round(F.col("l_extendedprice") * 100).cast("bigint").alias("cents"), "l_quantity")
    return li.groupBy("l_partkey", "session").agg((F.sum("cents") / F.sum("l_quantity")).alias("close"), F.sum("l_quantity").alias("volume"))


@query("asof_mark", f"""WITH {CAL_CTE}, b AS (SELECT l_partkey, l_shipdate::DATE AS session, sum(round(l_extendedprice * 100)::BIGINT)::BIGINT / sum(l_quantity) AS close, sum(l_quantity) AS volume FROM lineitem GROUP BY ALL),
p AS (SELECT DISTINCT l_partkey, o_orderdate::DATE AS day FROM lineitem JOIN orders ON l_orderkey = o_orderkey), a AS (SELECT p.l_partkey, p.day, b.session, b.close FROM p ASOF LEFT JOIN b ON p.l_partkey = b.l_partkey AND p.day >= b.session),
v AS (SELECT a.*, coalesce(b.volume, 0) AS volume FROM a LEFT JOIN b ON b.l_partkey = a.l_partkey AND b.session = a.day)
SELECT l_partkey, v.day, v.session AS mark_day, CASE WHEN d.ord_incl - m.ord_incl <= 3 THEN close END AS mark, CASE WHEN v.day - v.session <= 7 THEN close END AS lookback_close, volume
FROM v JOIN cal_day d ON d.day = v.day LEFT JOIN cal_day m ON m.day = v.session""")
def asof_mark(spark, sf_dir):
    """Mark at most three sessions old, close within seven calendar days, exact-day volume."""
    b = stage(part_bars(spark, sf_dir), "bars")
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("day"))
    p = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey").join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    a = asof.asof_daily(p, b, "l_partkey", "day", "session", ["close"])
    a = a.join(b.select("l_partkey", F.col("session").alias("day"), "volume"), ["l_partkey", "day"], "left")
    d = days(spark)
    a = cal.align(cal.align(a, "day", d, {"ord_incl": "_d"}), "mark_day", d, {"ord_incl": "_m"})
    return a.select("l_partkey", "day", "mark_day", asof.stale_mark("close", "_m", "_d").alias("mark"), F.when(F.datediff("day", "mark_day") <= 7, F.col("close")).alias("lookback_close"),
                    F.coalesce("volume", F.lit(0.0)).alias("volume"))
