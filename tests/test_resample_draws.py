"""Replicate weights are drawn once for each row id, and by the same rule."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tidemark.operators import resample as rs


def test_rows_of_one_id_share_a_draw(spark, monkeypatch):
    df = spark.range(3 * 700).select((F.col("id") % 3).alias("k"), F.floor(F.col("id") / 3).alias("e"), (F.col("id") * 0.5).alias("v"))
    tasks, kind = [], type(df)
    whole = kind.mapInArrow
    monkeypatch.setattr(kind, "mapInArrow", lambda self, f, *a, **b: (tasks.append(f), whole(self, f, *a, **b))[1])
    rs.replicate_sums(df, ["k"], "e", ["v"], 50, 1)
    drawn, plain = [], rs._weights
    monkeypatch.setattr(rs, "_weights", lambda h, abc: (drawn.append(len(h)), plain(h, abc))[1])
    r = np.random.default_rng(1)
    order = r.permutation(2100)
    k, h, v = np.arange(2100)[order] % 3, r.integers(0, rs.PRIME, 700)[np.arange(2100)[order] // 3], r.normal(size=2100)
    v[::50] = np.nan
    out = pa.Table.from_batches(list(tasks[0]([pa.record_batch([pa.array(k), pa.array(h), pa.array(v)], ["k", "_h", "v"])])))
    assert sum(drawn) == len(set(h.tolist()))
    w = plain(h, rs._coefficients(50, 1)) * ~np.isnan(v)[:, None]
    for row in out.to_pylist():
        mine = k == row["k0"]
        np.testing.assert_allclose(row["w"], w[mine].sum(axis=0))
        np.testing.assert_allclose(row["wx"], (w * np.nan_to_num(v)[:, None])[mine].sum(axis=0), atol=1e-9)
    assert out.num_rows == 3


def test_remainders():
    v = np.append(np.random.default_rng(2).integers(0, 1 << 62, 10_000), [0, rs.PRIME - 1, rs.PRIME, 2 * rs.PRIME, rs.PRIME ** 2, (rs.PRIME - 1) ** 2 + rs.PRIME - 1, (1 << 62) - 1])
    assert (rs._mod(v.copy()) == v % rs.PRIME).all()
