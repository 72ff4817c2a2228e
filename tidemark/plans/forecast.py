"""Forecast-evaluation queries. Roles: orders are decisions of an instrument (customer), line-item statistics are features."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import forecast as fc
from ..staging import stage
from .registry import query, table
from .study import rounded

FOLDS = [("f1", "1997-06-30", "1998-06-30"), ("f2", "1998-06-30", "1999-06-30")]
COLS = ["qty", "disc"]

PANEL_CTE = """li AS (SELECT l_orderkey, sum(l_quantity) AS qty, sum(round(l_discount * 100)::BIGINT)::BIGINT / count(*) AS disc FROM lineitem GROUP BY 1),
lb AS (SELECT o_orderkey AS decision_id, o_custkey AS instrument_id, o_orderdate AS decision_at, o_orderdate + INTERVAL 5 DAY AS outcome_end, o_orderdate + CASE WHEN o_orderpriority = '3-MEDIUM' THEN INTERVAL 40 DAY ELSE INTERVAL 6 DAY END AS available,
  CASE WHEN o_orderstatus = 'P' AND o_orderpriority = '5-LOW' THEN 'draft' ELSE 'qualified' END AS quality, o_totalprice / 100000 AS target, o_custkey || ':' || strftime(o_orderdate, '%Y-%m') AS grp, o_totalprice FROM orders),
fr AS (SELECT l.*, f.qty, CASE WHEN f.disc <= 7 THEN f.disc END AS disc, f.l_orderkey AS fk FROM lb l LEFT JOIN li f ON f.l_orderkey = l.decision_id),
cp AS (SELECT instrument_id, decision_at, count(*) AS n FROM lb GROUP BY ALL),
pn AS (SELECT fr.*, CASE WHEN decision_at > TIMESTAMP '1999-06-30' THEN 'outside_development_window' WHEN cp.n > 1 THEN 'duplicate_instrument_decision' WHEN quality <> 'qualified' THEN 'unqualified_target'
  WHEN fk IS NULL THEN 'missing_features' WHEN o_totalprice > 450000 THEN 'future_feature' END AS reason FROM fr JOIN cp USING (instrument_id, decision_at)),
ok AS (SELECT * FROM pn WHERE reason IS NULL),
fd(fold_id, train_end, validation_end) AS (VALUES ('f1', TIMESTAMP '1997-06-30', TIMESTAMP '1998-06-30'), ('f2', TIMESTAMP '1998-06-30', TIMESTAMP '1999-06-30')),
fx AS (SELECT fold_id, train_end, validation_end, ok.*, CASE WHEN decision_at <= train_end THEN 'train' ELSE 'validation' END AS role FROM ok JOIN fd ON decision_at <= validation_end),
cr AS (SELECT fold_id, grp FROM fx GROUP BY ALL HAVING bool_or(role = 'train') AND bool_or(role = 'validation')),
vd AS (SELECT DISTINCT fold_id, decision_at AS s, outcome_end AS e FROM fx WHERE role = 'validation'),
pg AS (SELECT fx.*, CASE WHEN c.grp IS NOT NULL THEN 'economic_group_crosses_boundary' WHEN role = 'train' AND EXISTS (SELECT 1 FROM vd WHERE vd.fold_id = fx.fold_id AND fx.decision_at <= vd.e AND fx.outcome_end >= vd.s) THEN 'overlapping_outcome_interval'
  WHEN role = 'train' AND available > train_end THEN 'target_not_mature_at_train_cutoff' WHEN role = 'validation' AND available > validation_end THEN 'target_not_mature_at_validation_cutoff' END AS purge_reason FROM fx LEFT JOIN cr c ON c.fold_id = fx.fold_id AND c.grp = fx.grp)"""
PANEL = f"WITH {PANEL_CTE}"


def panel(spark, sf_dir):
    o, t = table(spark, sf_dir, "orders"), F.col("o_orderdate").cast("timestamp")
    li = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sum("l_quantity").alias("qty"), (F.sum(F.round(F.col("l_discount") * 100).cast("bigint")) / F.count("*")).alias("disc"))
    days = lambda n: t + F.expr(f"INTERVAL {n} DAY")
    labels = o.select(
        F.col("o_orderkey").cast("string").alias("decision_id"), F.col("o_custkey").cast("string").alias("instrument_id"), t.alias("decision_at"), days(5).alias("outcome_end"),
        F.when(F.col("o_orderpriority") == "3-MEDIUM", days(40)).otherwise(days(6)).alias("target_available_at"), F.when((F.col("o_orderstatus") == "P") & (F.col("o_orderpriority") == "5-LOW"), "draft").otherwise("qualified").alias("quality"),
        F.lit("development").alias("partition"), F.lit("t").alias("target_name"), F.lit("h").alias("horizon_id"), F.lit("usd").alias("target_units"), F.concat(F.col("o_custkey").cast("string"), F.lit(":"), F.date_format(t, "yyyy-MM")).alias("economic_event_group"),
        (F.col("o_totalprice") / 100000).alias("target"))
    feats = o.join(li, F.col("o_orderkey") == F.col("l_orderkey")).select(
        F.col("o_orderkey").cast("string").alias("decision_id"), F.col("o_custkey").cast("string").alias("instrument_id"), t.alias("decision_at"),
        F.when(F.col("o_totalprice") > 450000, days(1)).otherwise(t).alias("available_at"), F.create_map(F.lit("qty"), F.col("qty"), F.lit("disc"), F.when(F.col("disc") <= 7, F.col("disc"))).alias("features"))
    return fc.panel(feats, labels, COLS, "1999-06-30", "t", "h", units="usd")


def assigned(spark, sf_dir):
    ok = panel(spark, sf_dir).where("reason IS NULL").select("decision_id", "instrument_id", "decision_at", "outcome_end", "target_available_at", "economic_event_group", "target", *[F.col("features")[c].alias(c) for c in COLS])
    folds = spark.createDataFrame(FOLDS, "fold_id STRING, train_end STRING, validation_end STRING").select("fold_id", F.col("train_end").cast("timestamp").alias("train_end"), F.col("validation_end").cast("timestamp").alias("validation_end"))
    return stage(fc.fold_rows(stage(ok, "panel"), folds, "economic_event_group", "decision_at", "outcome_end", "target_available_at"), "folds")


@query("label_gate", f"{PANEL} SELECT decision_id, reason FROM pn")
def label_gate(spark, sf_dir):
    """J18, P15."""
    return panel(spark, sf_dir).select(F.col("decision_id").cast("bigint").alias("decision_id"), "reason")


@query("purge_folds", f"{PANEL} SELECT fold_id, decision_id, role, purge_reason FROM pg")
def purge_folds(spark, sf_dir):
    """M5, J19, J20."""
    return assigned(spark, sf_dir).select("fold_id", F.col("decision_id").cast("bigint").alias("decision_id"), "role", "purge_reason")


@query("fold_counts", f"""{PANEL} SELECT fold_id, count(*) FILTER (role = 'train' AND purge_reason IS NULL) AS train_rows, count(DISTINCT grp) FILTER (role = 'train' AND purge_reason IS NULL) AS train_groups, count(*) FILTER (role = 'validation' AND purge_reason IS NULL) AS validation_rows,
  count(DISTINCT grp) FILTER (role = 'validation' AND purge_reason IS NULL) AS validation_groups, count(*) FILTER (purge_reason IS NOT NULL) AS purged_rows, true AS sufficient FROM pg GROUP BY 1""")
def fold_counts(spark, sf_dir):
    """A28."""
    return fc.fold_counts(assigned(spark, sf_dir), "economic_event_group")


PREP_CTE = """tr AS (SELECT * FROM pg WHERE role = 'train' AND purge_reason IS NULL), md AS (SELECT fold_id, median(qty) AS mq, median(disc) AS md FROM tr GROUP BY 1), im AS (SELECT fold_id, target, coalesce(qty, mq) AS a, coalesce(disc, md) AS b, (qty IS NULL)::INT::DOUBLE AS c, (disc IS NULL)::INT::DOUBLE AS d FROM tr JOIN md USING (fold_id)),
pp AS (SELECT fold_id, avg(target) AS y0, avg(a) AS ma, avg(b) AS mb, avg(c) AS mc, avg(d) AS m_d, CASE WHEN stddev_pop(a) = 0 THEN 1 ELSE stddev_pop(a) END AS sa, CASE WHEN stddev_pop(b) = 0 THEN 1 ELSE stddev_pop(b) END AS sb, CASE WHEN stddev_pop(c) = 0 THEN 1 ELSE stddev_pop(c) END AS sc, CASE WHEN stddev_pop(d) = 0 THEN 1 ELSE stddev_pop(d) END AS sd FROM im GROUP BY 1)"""


@query("train_prep", f"""{PANEL}, {PREP_CTE} SELECT fold_id, round(mq, 6) AS med_qty, round(md, 6) AS med_disc, round(ma, 6) AS mean_qty, round(mb, 6) AS mean_disc, round(sa, 6) AS sd_qty, round(sb, 6) AS sd_disc, round(m_d, 6) AS mean_miss_disc FROM pp JOIN md USING (fold_id)""")
def train_prep(spark, sf_dir):
    """M1."""
    p = fc.preparation(stage(assigned(spark, sf_dir).where("role = 'train' AND purge_reason IS NULL"), "train"), COLS)
    cols = ["med_qty", "med_disc", "mean_qty", "mean_disc", "sd_qty", "sd_disc", "mean_miss_disc"]
    return rounded(p.select("fold_id", *cols), cols)


def fitted(spark, sf_dir):
    a = assigned(spark, sf_dir).where("purge_reason IS NULL")
    train = stage(a.where("role = 'train'"), "train")
    prep = stage(fc.preparation(train, COLS), "preparation")
    return a, prep, stage(fc.scaled(train, prep, COLS), "scaled")


@query("ridge_gram", f"""{PANEL}, {PREP_CTE}, z AS (SELECT fold_id, target - y0 AS y, y0, (a - ma) / sa AS x0, (b - mb) / sb AS x1, (c - mc) / sc AS x2, (d - m_d) / sd AS x3 FROM im JOIN pp USING (fold_id))
SELECT fold_id, round(any_value(y0), 6) AS intercept, count(*) AS n, {", ".join(f"round(sum(x{i} * x{k}), 4) AS g_{i}_{k}" for i in range(4) for k in range(i, 4))}, {", ".join(f"round(sum(x{i} * y), 4) AS b_{i}" for i in range(4))} FROM z GROUP BY 1""")
def ridge_gram(spark, sf_dir):
    """M2: Gram sums."""
    g = fc.gram(fitted(spark, sf_dir)[2], 4, "target")
    sums = [c for c in g.columns if c[:2] in ("g_", "b_")]
    return rounded(rounded(g, ["intercept"]), sums, 4)


@query("fold_metrics")
def fold_metrics(spark, sf_dir):
    """Ridge and training-mean scores on untouched validation rows."""
    a, prep, x = fitted(spark, sf_dir)
    model = stage(fc.ridge(fc.gram(x, 4, "target"), 4, 1.0), "model")
    scored = fc.predict(fc.scaled(a.where("role = 'validation'"), prep, COLS), model)
    return rounded(fc.metrics(scored, ["fold_id"], "target"), ["mse", "mae", "baseline_mse", "loss_difference"])
