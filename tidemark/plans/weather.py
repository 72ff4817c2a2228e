"""Weather-signal queries. Role: supplier regions are sampling regions, daily line-item statistics are readings."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import forecast as fc, series as se, weather as we
from ..staging import stage
from .registry import query, table
from .series import backtest
from .study import regions, rounded

READ_CTE = """
rg AS (SELECT s_suppkey, 'R' || n_regionkey AS region, (n_regionkey + 1) / 15.0::DOUBLE AS weight FROM supplier JOIN nation ON s_nationkey = n_nationkey),
rd AS (SELECT region, weight, l_shipdate::DATE AS day, max(l_quantity) AS temp_max, min(l_quantity) AS temp_min, sum(round(l_discount * 100)::BIGINT)::DOUBLE AS precipitation,
  sum(round(l_tax * 100)::BIGINT)::DOUBLE AS solar_radiation, count(*) * 8.0::DOUBLE AS clear_sky_solar, avg(l_quantity) AS temp_avg, 60 + sum(round(l_tax * 100)::BIGINT)::DOUBLE AS relative_humidity
  FROM lineitem JOIN rg ON l_suppkey = s_suppkey GROUP BY ALL),
zf AS (SELECT region, avg(temp_max) AS m1, stddev_samp(temp_max) AS s1, avg(temp_min) AS m2, stddev_samp(temp_min) AS s2, avg(precipitation) AS m3, stddev_samp(precipitation) AS s3 FROM rd GROUP BY 1),
z AS (SELECT rd.*, sum(precipitation) OVER (PARTITION BY region ORDER BY day ROWS 6 PRECEDING) AS rain_7d,
  (temp_max - coalesce(avg(temp_max) OVER w, m1)) / (coalesce(stddev_samp(temp_max) OVER w, s1) + 1e-6) AS z1, (temp_min - coalesce(avg(temp_min) OVER w, m2)) / (coalesce(stddev_samp(temp_min) OVER w, s2) + 1e-6) AS z2,
  (precipitation - coalesce(avg(precipitation) OVER w, m3)) / (coalesce(stddev_samp(precipitation) OVER w, s3) + 1e-6) AS z3
  FROM rd JOIN zf USING (region) WINDOW w AS (PARTITION BY region, strftime(day, '%m-%d') ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
st AS (SELECT *, (temp_max > 35)::INT AS heat, (temp_min < 15)::INT AS cold, (rain_7d < 30)::INT AS dry, greatest(z1, 0) AS heat_z, abs(least(z2, 0)) AS cold_z, abs(least(z3, 0)) AS dry_z,
  1 - solar_radiation / clear_sky_solar AS cloud, (relative_humidity > 85 AND temp_avg BETWEEN 18 AND 30)::INT::DOUBLE AS disease FROM z)
"""


def readings(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").join(regions(spark, sf_dir, "s_suppkey", "s_nationkey", "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    pts = lambda c: F.sum(F.round(F.col(c) * 100).cast("bigint")).cast("double")
    return stage(li.groupBy(F.col("ticker").alias("region"), F.to_date("l_shipdate").alias("day")).agg(
        F.max("l_quantity").alias("temp_max"), F.min("l_quantity").alias("temp_min"), pts("l_discount").alias("precipitation"), pts("l_tax").alias("solar_radiation"),
        (F.count("*") * 8.0).alias("clear_sky_solar"), F.avg("l_quantity").alias("temp_avg"), (60 + pts("l_tax")).alias("relative_humidity")), "readings")


def stressed(spark, sf_dir):
    d = readings(spark, sf_dir)
    for c in ("temp_max", "temp_min", "precipitation"):
        d = se.seasonal_z(d, ["region"], "day", c).withColumnRenamed("z", f"{c}_z")
    d = d.withColumn("rain_7d", F.sum("precipitation").over(se.by(["region"], "day").rowsBetween(-6, 0)))
    return we.extras(we.stress(d))


def region_weights(spark):
    return spark.createDataFrame([(f"R{i}", (i + 1) / 15.0) for i in range(5)], "region STRING, weight DOUBLE")


@query("stress_flags", f"WITH {READ_CTE} SELECT region, day, heat AS heat_stress, cold AS cold_stress, dry AS dry_stress, round(heat_z, 5) AS heat_stress_z, round(cold_z, 5) AS cold_stress_z, round(dry_z, 5) AS dry_stress_z, round(cloud, 8) AS cloud, disease FROM st")
def stress_flags(spark, sf_dir):
    """W15, M7, M9."""
    d = stressed(spark, sf_dir).select("region", "day", "heat_stress", "cold_stress", "dry_stress", "heat_stress_z", "cold_stress_z", "dry_stress_z", "cloud", "disease")
    return rounded(rounded(d, ["heat_stress_z", "cold_stress_z", "dry_stress_z"], 5), ["cloud"], 8)


@query("region_weights", f"""WITH {READ_CTE} SELECT day, round(coalesce(sum(weight * heat), 0), 8) AS heat_stress_agg, round(coalesce(sum(weight * dry_z), 0), 5) AS dry_stress_z_agg,
  round(sum(weight * cloud) / sum(weight), 8) AS cloud_agg, round(sum(weight * disease) / sum(weight), 8) AS disease_agg FROM st GROUP BY 1""")
def region_weights_query(spark, sf_dir):
    """Stress columns with missing regions as zero, extras with renormalized weights."""
    d = stage(stressed(spark, sf_dir), "stress")
    w = region_weights(spark)
    a = we.region_weighted(d, w, ["day"], "region", ["heat_stress", "dry_stress_z"], renormalize=False)
    b = we.region_weighted(d, w, ["day"], "region", ["cloud", "disease"], renormalize=True)
    return rounded(rounded(a.join(b, "day"), ["heat_stress_agg", "cloud_agg", "disease_agg"], 8), ["dry_stress_z_agg"], 5)


@query("climate_lag", """WITH ix AS (SELECT date_trunc('month', o_orderdate)::DATE AS month, sum(round(o_totalprice * 100)::BIGINT)::BIGINT / count(*) AS value FROM orders GROUP BY 1),
d AS (SELECT DISTINCT l_shipdate::DATE AS day FROM lineitem)
SELECT day, round(value, 4) AS value FROM d LEFT JOIN ix ON date_trunc('month', day) = month + INTERVAL 2 MONTH""")
def climate_lag(spark, sf_dir):
    """A monthly index becomes usable two months after its centre month."""
    o = table(spark, sf_dir, "orders")
    ix = o.groupBy(F.to_date(F.date_trunc("month", "o_orderdate")).alias("month")).agg((F.sum(F.round(F.col("o_totalprice") * 100).cast("bigint")) / F.count("*")).alias("value"))
    d = table(spark, sf_dir, "lineitem").select(F.to_date("l_shipdate").alias("day")).distinct()
    return rounded(we.lagged_index(d, ix, "day", "month", "value"), ["value"], 4)


FEATS = ["l_quantity", "l_discount", "l_tax", "l_linenumber", "l_partkey", "l_suppkey"]


@query("feature_topk", f"""WITH c AS (SELECT unnest([{", ".join(f"'{f}'" for f in FEATS)}]) AS feature, unnest([{", ".join(f"corr({f}, l_extendedprice)" for f in FEATS)}]) AS r FROM lineitem)
SELECT feature, round(r, 6) AS r FROM c ORDER BY abs(r) DESC LIMIT 4""")
def feature_topk(spark, sf_dir):
    """Features ranked by absolute correlation in one pass."""
    return rounded(fc.top_features(table(spark, sf_dir, "lineitem"), FEATS, "l_extendedprice", 4), ["r"])


@query("monthly_refit")
def monthly_refit(spark, sf_dir):
    """M6: monthly scaler + PCA + ridge and direction classifier on a trailing window, with the veto."""
    d = se.forward_return(backtest(spark, sf_dir), ["series"], "day", "close")
    d = se.rolling(se.rolling(d, ["series"], "day", "px_ret"), ["series"], "day", "traded", agg=F.sum, tag="_sum")
    feats = [f"px_ret_{n}d" for n in (7, 14, 30)] + [f"traded_{n}d_sum" for n in (7, 14, 30)]
    return fc.monthly_refit(d, ["series"], "day", feats, "fwd_return", years=3, minimum=252)
