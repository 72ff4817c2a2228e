"""Forecast evaluation."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import finite
from .intervals import overlaps_any
from .asof import epoch_bucket
from .quantiles import exact_quantiles

MAX_FEATURES = 64


def first_reason(*rules: tuple[Column, str]) -> Column:
    """P15 shape: the first failing rule, NULL when all pass."""
    return F.coalesce(*[F.when(F.coalesce(c, F.lit(True)), F.lit(name)) for c, name in rules])


def panel(features: DataFrame, labels: DataFrame, required: Sequence[str], development_end: str, target: str, horizon: str,
          units: str | None = None, holdout_start: str | None = None) -> DataFrame:
    """Labels with their features and the first exclusion reason (NULL = eligible).

    labels: decision_id, instrument_id, decision_at, outcome_end, target_available_at, quality, partition, target_name, horizon_id,
    target_units, economic_event_group, target. features: decision_id, instrument_id, f_decision_at, f_available_at, features map.
    """
    f = features.select("decision_id", "instrument_id", F.col("decision_at").alias("_fd"), F.col("available_at").alias("_fa"), F.col("features").alias("_f"))
    j = labels.join(f, ["decision_id", "instrument_id"], "left")
    # Copies of one (instrument, decision) are all refused; the count is a partial aggregate, not a window over a hot key.
    copies = labels.groupBy("instrument_id", "decision_at").agg(F.count("*").alias("_copies")).where("_copies > 1")
    j = j.join(copies, ["instrument_id", "decision_at"], "left")
    blank = lambda c: F.coalesce(F.trim(c) == "", F.lit(True))
    protected = F.coalesce(F.col("partition").isin("final_test", "test", "protected_holdout"), F.lit(False))
    if holdout_start:
        protected = protected | (F.col("decision_at") >= F.lit(holdout_start).cast("timestamp"))
    schema_gap = reduce(lambda a, b: a | b, [~F.map_contains_key("_f", F.lit(c)) for c in required])
    not_finite = reduce(lambda a, b: a | b, [F.col("_f")[c].isNotNull() & ~finite(F.col("_f")[c]) for c in required])
    rules = [(blank(F.col("decision_id")) | blank(F.col("instrument_id")), "missing_decision_or_instrument_id"),
             (F.col("decision_at").isNull(), "precise_aware_timestamp_required"), (protected, "protected_holdout_row"),
             (F.col("decision_at") > F.lit(development_end).cast("timestamp"), "outside_development_window"),
             (F.col("_copies").isNotNull(), "duplicate_instrument_decision"),
             (~((F.col("decision_at") < F.col("outcome_end")) & (F.col("outcome_end") <= F.col("target_available_at"))), "invalid_outcome_interval"),
             (~F.col("quality").eqNullSafe("qualified"), "unqualified_target"),
             (F.coalesce(F.col("target_name") != target, F.lit(False)) | F.coalesce(F.col("horizon_id") != horizon, F.lit(False)), "target_or_horizon_mismatch")]
    if units is not None:
        rules += [(blank(F.col("target_units")), "target_unit_contract_missing"), (F.col("target_units") != units, "target_units_mismatch")]
    rules += [(F.col("_f").isNull(), "missing_features"), (F.col("_fd") != F.col("decision_at"), "decision_clock_mismatch"),
              (F.col("_fa") > F.col("decision_at"), "future_feature"), (schema_gap, "missing_ablation_feature_schema"),
              (not_finite | ~finite(F.col("target")), "finite_number_required")]
    group = F.coalesce("economic_event_group", F.concat(F.lit("control:"), "decision_id"))
    return (j.withColumn("reason", first_reason(*rules)).withColumn("economic_event_group", group)
            .withColumnRenamed("_f", "features").drop("_fd", "_fa", "_copies"))


def fold_rows(rows: DataFrame, folds: DataFrame, group: str, start: str, end: str, available: str) -> DataFrame:
    """Every (fold, row) with its role and purge reason.

    Fold boundaries are a small registered dimension. Group flags are partial aggregates; overlap with the
    validation intervals is a running maximum, not an interval join.
    """
    f = F.broadcast(folds)
    j = rows.join(f, F.col(start) <= F.col("validation_end"))
    j = j.withColumn("role", F.when(F.col(start) <= F.col("train_end"), "train").otherwise("validation"))
    crossing = (j.groupBy("fold_id", group).agg(F.bool_or(F.col("role") == "train").alias("t"), F.bool_or(F.col("role") == "validation").alias("v"))
                .where("t AND v").select("fold_id", group, F.lit(True).alias("_cross")))
    j = j.join(crossing, ["fold_id", group], "left")
    val = j.where("role = 'validation'").select("fold_id", F.col(start).alias("_vs"), F.col(end).alias("_ve"))
    train = overlaps_any(j.where("role = 'train'"), val, ["fold_id"], start, end, "_vs", "_ve", epoch_bucket(3600), "_over")
    j = train.unionByName(j.where("role = 'validation'").withColumn("_over", F.lit(False)))
    late = F.when(F.col("role") == "train", F.when(F.col(available) > F.col("train_end"), "target_not_mature_at_train_cutoff")).otherwise(
        F.when(F.col(available) > F.col("validation_end"), "target_not_mature_at_validation_cutoff"))
    reason = F.coalesce(F.when(F.col("_cross"), "economic_group_crosses_boundary"), F.when(F.col("_over"), "overlapping_outcome_interval"), late)
    return j.withColumn("purge_reason", reason).drop("_cross", "_over")


def fold_counts(assigned: DataFrame, group: str, min_train: int = 30, min_validation: int = 10) -> DataFrame:
    """A28."""
    keep = F.col("purge_reason").isNull()
    c = lambda role: keep & (F.col("role") == role)
    g = assigned.groupBy("fold_id").agg(F.count_if(c("train")).alias("train_rows"), F.countDistinct(F.when(c("train"), F.col(group))).alias("train_groups"),
                                        F.count_if(c("validation")).alias("validation_rows"), F.countDistinct(F.when(c("validation"), F.col(group))).alias("validation_groups"),
                                        F.count_if(~keep).alias("purged_rows"))
    return g.withColumn("sufficient", (F.col("train_rows") >= min_train) & (F.col("validation_rows") >= min_validation))


def repeated_validation(assigned: DataFrame, ids: Sequence[str]) -> DataFrame:
    """M5: rows scored in more than one fold."""
    return (assigned.where("role = 'validation' AND purge_reason IS NULL").groupBy(*ids).agg(F.count("*").alias("folds")).where("folds > 1"))


def preparation(train: DataFrame, columns: Sequence[str]) -> DataFrame:
    """M1: one row per fold with median, mean and population scale of every imputed column and missing flag."""
    if len(columns) > MAX_FEATURES:
        raise ValueError(f"at most {MAX_FEATURES} features")
    long = train.select("fold_id", *columns).unpivot("fold_id", list(columns), "_c", "_x")
    med = exact_quantiles(long, ["fold_id", "_c"], "_x", {"_m": 0.5})
    med = med.groupBy("fold_id").agg(*[F.max(F.when(F.col("_c") == c, F.col("_m"))).alias(f"med_{c}") for c in columns])
    t = train.join(F.broadcast(med), "fold_id")
    aggs = []
    for c in columns:
        for name, x in ((c, F.coalesce(F.col(c), F.col(f"med_{c}"))), (f"miss_{c}", F.col(c).isNull().cast("double"))):
            sd = F.stddev_pop(x)
            aggs += [F.avg(x).alias(f"mean_{name}"), F.when(sd == 0, 1.0).otherwise(sd).alias(f"sd_{name}")]
    return med.join(t.groupBy("fold_id").agg(*aggs), "fold_id")


def scaled(rows: DataFrame, prep: DataFrame, columns: Sequence[str]) -> DataFrame:
    """M1: array column `x` of scaled values then scaled missing flags; preparation has one row per fold."""
    j = rows.join(F.broadcast(prep), "fold_id")
    v = [(F.coalesce(F.col(c), F.col(f"med_{c}")) - F.col(f"mean_{c}")) / F.col(f"sd_{c}") for c in columns]
    v += [(F.col(c).isNull().cast("double") - F.col(f"mean_miss_{c}")) / F.col(f"sd_miss_{c}") for c in columns]
    return j.withColumn("x", F.array(*v)).drop(*[c for c in prep.columns if c != "fold_id"])


def gram(x_rows: DataFrame, width: int, target: str) -> DataFrame:
    """M2: per fold n, intercept, upper Gram sums and X'y as one partial aggregation."""
    means = x_rows.groupBy("fold_id").agg(F.avg(target).alias("intercept"))
    j = x_rows.join(F.broadcast(means), "fold_id")
    x = lambda i: F.col("x")[i]
    aggs = [F.sum(x(i) * x(k)).alias(f"g_{i}_{k}") for i in range(width) for k in range(i, width)]
    aggs += [F.sum(x(i) * (F.col(target) - F.col("intercept"))).alias(f"b_{i}") for i in range(width)]
    return j.groupBy("fold_id", "intercept").agg(F.count("*").alias("n"), *aggs)


def ridge(g: DataFrame, width: int, alpha: float) -> DataFrame:
    """M2: (fold_id, intercept, coef). The solve sees one width×width matrix per fold."""
    pairs = [(i, k) for i in range(width) for k in range(i, width)]
    flat, rhs = F.array(*[F.col(f"g_{i}_{k}") for i, k in pairs]), F.array(*[F.col(f"b_{i}") for i in range(width)])

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def solve(a: pd.Series, b: pd.Series) -> pd.Series:
        out = []
        for ga, gb in zip(a, b):
            m = np.zeros((width, width))
            for (i, k), v in zip(pairs, ga):
                m[i, k] = m[k, i] = v
            out.append(np.linalg.solve(m + alpha * np.eye(width), np.asarray(gb, dtype=float)))
        return pd.Series(out)

    return g.select("fold_id", "intercept", solve(flat, rhs).alias("coef"))


def predict(x_rows: DataFrame, model: DataFrame) -> DataFrame:
    """M3, M4: ridge prediction and the training-mean baseline."""
    j = x_rows.join(F.broadcast(model), "fold_id")
    dot = F.aggregate(F.zip_with("x", "coef", lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
    return j.withColumn("prediction", F.col("intercept") + dot).withColumn("baseline", F.col("intercept"))


def metrics(scored: DataFrame, keys: Sequence[str], target: str) -> DataFrame:
    """A27."""
    e, b = F.col("prediction") - F.col(target), F.col("baseline") - F.col(target)
    return scored.groupBy(*keys).agg(F.count("*").alias("n"), F.avg(e * e).alias("mse"), F.avg(F.abs(e)).alias("mae"), F.avg(b * b).alias("baseline_mse"),
                                     F.avg(e * e - b * b).alias("loss_difference"))


def top_features(df: DataFrame, features: Sequence[str], target: str, k: int) -> DataFrame:
    """T6."""
    wide = df.agg(*[F.corr(c, target).alias(c) for c in features])
    return wide.unpivot([], list(features), "feature", "r").orderBy(F.desc(F.abs("r")), "feature").limit(k)


def monthly_refit(d: DataFrame, keys: Sequence[str], day: str, features: Sequence[str], target: str, years: int, minimum: int,
                  alpha: float = 1.0, explained: float = 0.95, veto: float = 0.65) -> DataFrame:
    """M6: per key and calendar month, fit on the trailing labelled sessions before the month and score the month.

    A task sees one (key, month): at most `years`·252 training rows plus one month, whatever the table size.
    """
    width, feats = years * 252, list(features)
    w = W.partitionBy(*keys).orderBy(day)
    d = d.select(*keys, day, *[F.coalesce(c, F.lit(0.0)).alias(c) for c in feats], target).withColumn("_o", F.row_number().over(w))
    months = d.groupBy(*keys, F.trunc(day, "month").alias("month")).agg(F.min("_o").alias("_first"), F.max("_o").alias("_last"))
    cells = months.withColumn("_o", F.explode(F.sequence(F.greatest(F.col("_first") - width, F.lit(1)), F.col("_last"))))
    rows = cells.join(d, [*keys, "_o"]).withColumn("_train", F.col("_o") < F.col("_first"))
    # Labels that look past the refit date are not known yet: keep only those matured ten rows before.
    rows = rows.withColumn("_y", F.when(F.col("_train") & (F.col("_o") + 10 < F.col("_first")), F.col(target)))
    schema = T.StructType([d.schema[k] for k in keys] + [T.StructField("month", T.DateType()), d.schema[day], T.StructField("forecast", T.DoubleType()),
                          T.StructField("up_probability", T.DoubleType()), T.StructField("signal", T.DoubleType())])

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        tr, te = pdf[pdf["_y"].notna()], pdf[~pdf["_train"]].sort_values(day)
        out = te[[*keys, "month", day]].copy()
        out["forecast"] = out["up_probability"] = out["signal"] = np.nan
        if len(tr) < minimum or te.empty:
            return out
        x, y = tr[feats].to_numpy(float), tr["_y"].to_numpy(float)
        mu, sd = x.mean(0), x.std(0)
        sd[sd == 0] = 1.0
        z = (x - mu) / sd
        val, vec = np.linalg.eigh(z.T @ z)
        order = np.argsort(val)[::-1]
        share = np.cumsum(val[order]) / val.sum()
        basis = vec[:, order[:int(np.searchsorted(share, explained) + 1)]]
        p, q = z @ basis, ((te[feats].to_numpy(float) - mu) / sd) @ basis
        beta = np.linalg.solve(p.T @ p + alpha * np.eye(p.shape[1]), p.T @ (y - y.mean()))
        f = y.mean() + q @ beta
        up = np.full(len(te), np.nan)
        label = (y > 0).astype(float)
        if 0 < label.mean() < 1:
            a, b = np.c_[np.ones(len(p)), p], np.zeros(p.shape[1] + 1)
            pen = np.eye(len(b))
            pen[0, 0] = 0.0
            for _ in range(50):
                mu1 = 1 / (1 + np.exp(-a @ b))
                step = np.linalg.solve(a.T @ (a * (mu1 * (1 - mu1))[:, None]) + pen, a.T @ (label - mu1) - pen @ b)
                b = b + step
                if np.abs(step).max() < 1e-9:
                    break
            up = 1 / (1 + np.exp(-np.c_[np.ones(len(q)), q] @ b))
        call = np.where(up > 0.5, 1.0, -1.0)
        vetoed = (np.sign(f) != call) & (np.maximum(up, 1 - up) > veto)
        out["forecast"], out["up_probability"], out["signal"] = f, up, np.where(vetoed, 0.0, f)
        return out

    return rows.groupBy(*keys, "month").applyInPandas(fit, schema)
