"""Resampling with hashed draws.

Means of rows (R1, R2) are resampled by one rule at every size: each row has a Poisson(1) weight per replicate, drawn by integer arithmetic
from a digest of seed and row and numbers of the replicate, and a replicate is two weighted sums. A task keeps the sums of all replicates as one
vector per key, so nothing is copied per replicate before the rows are combined. Blocks (R3-R7) draw their slots by (seed, replicate, slot),
never from the data.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from ..constants import SESSIONS_PER_YEAR
from ..staging import stage
from .events import hash_unit

# Cumulative Poisson(1) probabilities in 1/65536.
POISSON = (24109, 48219, 60274, 64292, 65296, 65497, 65531)
#: Draws are taken modulo this prime, so that any engine's 64-bit integers can repeat them.
PRIME = (1 << 31) - 1
#: Rows whose weights are drawn at a time, keys whose sums a task holds, pieces in which a key's sums are joined.
_ROWS, _HELD, _PIECES = 256, 500, 16


def weights(sizes: DataFrame, replicates: int, seed: int) -> DataFrame:
    """(m, rep, idx, w): how often unit idx is drawn in each replicate, per distinct unit count m."""
    grid = (sizes.select("m").distinct().withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1)))).repartition("m", "rep")
            .withColumn("slot", F.explode(F.sequence(F.lit(0), (F.col("m") - 1).cast("int")))))
    drawn = grid.withColumn("idx", F.floor(hash_unit(F.lit(seed), F.col("rep"), F.col("slot")) * F.col("m")).cast("int"))
    return drawn.groupBy("m", "rep", "idx").agg(F.count("*").alias("w"))


#: Weight of each 16-bit draw.
_WEIGHT = np.searchsorted(np.array(POISSON), np.arange(1 << 16), "right").astype(np.float64)


def _coefficients(replicates: int, seed: int) -> np.ndarray:
    """Three numbers below PRIME for each replicate, from digests of seed, replicate and their place."""
    digest = lambda rep, k: int(hashlib.md5(f"{seed}|{rep}|{k}".encode()).hexdigest()[:8], 16) % PRIME
    return np.array([[digest(rep, k) for rep in range(replicates)] for k in "abc"], np.int64)


def _mod(v: np.ndarray) -> np.ndarray:
    """v % PRIME for 0 <= v < 2^62, in place: 2^31 leaves 1, so the upper bits are added to the lower ones."""
    for _ in range(2):
        upper = v >> 31
        v &= PRIME
        v += upper
    v[v == PRIME] = 0
    return v


def _weights(h: np.ndarray, abc: np.ndarray) -> np.ndarray:
    """Poisson(1) weight of each row (its number h) in each replicate."""
    x = _mod(abc[0] * h[:, None] + abc[1])
    u = _mod(x * _mod(x + abc[2])) >> 15
    return _WEIGHT[u]


def _parts(batch: pa.RecordBatch, keys: int):
    """(key values, row numbers) of each combination of the first `keys` columns."""
    codes = np.zeros(batch.num_rows, np.int64)
    for k in range(keys):
        own = batch.column(k).dictionary_encode("encode")
        _, codes = np.unique(codes * (len(own.dictionary) + 1) + own.indices.to_numpy(zero_copy_only=False), return_inverse=True)
    order = np.argsort(codes, kind="stable")
    for rows in np.split(order, np.flatnonzero(np.diff(codes[order])) + 1):
        if len(rows):
            yield tuple(batch.column(k)[int(rows[0])] for k in range(keys)), rows


def _summed(held: dict, names: Sequence[str], types: list) -> pa.RecordBatch:
    flat = [(key, name, sums[:, j]) for key, sums in held.items() for j, name in enumerate(names)]
    keys = [pa.array([k[i].as_py() for k, _, _ in flat], t) for i, t in enumerate(types)]
    size = 0 if not flat else flat[0][2].shape[1]
    lists = [pa.ListArray.from_arrays(pa.array(np.arange(len(flat) + 1, dtype=np.int32) * size), pa.array(np.concatenate([x[k] for _, _, x in flat]) if flat else np.zeros(0))) for k in (0, 1)]
    return pa.record_batch([*keys, pa.array([n for _, n, _ in flat], pa.string()), *lists], names=[f"k{i}" for i in range(len(keys))] + ["name", "w", "wx"])


def replicate_sums(df: DataFrame, keys: Sequence[str], row_id: str | Column, values: Sequence[str], replicates: int, seed: int) -> DataFrame:
    """(keys, name, rep, w, wx): for each value column the weights drawn and the weighted sum, in each replicate.

    A row's weights follow from a digest of seed and row id, so all value columns share them; rows are never copied per replicate. A task adds
    its rows to one pair of vectors per key and value; those are added up in pieces of a key, then replicate by replicate.
    """
    row = row_id if isinstance(row_id, Column) else F.col(row_id).cast("string")
    h = F.pmod(F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), row)), 1, 8), 16, 10).cast("bigint"), F.lit(PRIME))
    d = df.select(*keys, h.alias("_h"), *[F.col(v).cast("double").alias(v) for v in values])
    kinds = ", ".join(f"k{i} {d.schema[k].dataType.simpleString()}" for i, k in enumerate(keys))
    schema = (kinds + ", " if kinds else "") + "name string, w array<double>, wx array<double>"
    n, names = len(keys), list(values)
    abc = _coefficients(replicates, seed)

    def draw(batches):
        held, types = {}, None
        for batch in batches:
            types = [batch.column(i).type for i in range(n)]
            number = batch.column(n).to_numpy()
            x = np.stack([batch.column(n + 1 + j).to_numpy(zero_copy_only=False).astype(np.float64) for j in range(len(names))], axis=1)
            there = ~np.isnan(x)
            both = np.concatenate([there, np.where(there, x, 0.0)], axis=1)
            # rows of one id share their weights, whatever their keys: they are drawn once
            ids, of = np.unique(number, return_inverse=True)
            split = [(key, rows[np.argsort(of[rows], kind="stable")]) for key, rows in _parts(batch, n)]
            for first in range(0, len(ids), _ROWS):
                drawn = _weights(ids[first:first + _ROWS], abc)
                for key, rows in split:
                    a, b = np.searchsorted(of[rows], (first, first + _ROWS))
                    for at in range(a, b, _ROWS):
                        some = rows[at:min(at + _ROWS, b)]
                        sums = held.setdefault(key, np.zeros((2, len(names), replicates)))
                        sums += (both[some].T @ drawn[of[some] - first]).reshape(2, len(names), replicates)
                    if len(held) * len(names) >= _HELD:
                        yield _summed(held, names, types)
                        held = {}
        if held:
            yield _summed(held, names, types)

    def join(batches):
        held, types = {}, None
        for batch in batches:
            types = [batch.column(i).type for i in range(n)]
            w, wx = (batch.column(n + 1 + k).flatten().to_numpy().reshape(batch.num_rows, -1) for k in (0, 1))
            for key, rows in _parts(batch, n + 1):
                sums = held.setdefault(key, np.zeros((2, 1, replicates)))
                sums += np.stack([w[rows].sum(axis=0), wx[rows].sum(axis=0)])[:, None]
                if len(held) >= _HELD:
                    yield named(held, types)
                    held = {}
        if held:
            yield named(held, types)

    def named(held, types):
        out = _summed({k[:-1] + (k[-1],): v for k, v in held.items()}, ["-"], [*types, pa.string()])
        return pa.record_batch([*out.columns[:n + 1], *out.columns[n + 2:]], names=[f"k{i}" for i in range(n)] + ["name", "w", "wx"])

    # thousands of draws a row cost far more than moving its few numbers, so a small or uneven scan is spread first; by id, in the order of ids, so
    # that a batch holds all rows of one (a few: one for each key)
    spread = d.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), "_h").sortWithinPartitions("_h")
    drawn = spread.mapInArrow(draw, schema)
    groups = [f"k{i}" for i in range(n)] + ["name"]
    joined = drawn.withColumn("_p", F.pmod(F.spark_partition_id(), F.lit(_PIECES))).repartition(*groups, "_p").drop("_p").mapInArrow(join, schema)
    each = joined.select(*groups, F.posexplode(F.arrays_zip("w", "wx")).alias("rep", "s"))
    out = each.groupBy(*groups, "rep").agg(F.sum("s.w").alias("w"), F.sum("s.wx").alias("wx"))
    return out.select(*[F.col(f"k{i}").alias(k) for i, k in enumerate(keys)], "name", "rep", "w", "wx")


def replicate_means(df: DataFrame, keys: Sequence[str], row_id: str | Column, values: Sequence[str], replicates: int, seed: int) -> DataFrame:
    """(keys, name, rep, mean): the mean of each value column in each replicate; NULL if it drew no row."""
    sums = replicate_sums(df, keys, row_id, values, replicates, seed)
    return sums.select(*keys, "name", "rep", (F.col("wx") / F.nullif(F.col("w"), F.lit(0.0))).alias("mean"))


def interval(reps: DataFrame, keys: Sequence[str], value: str, lo: float = 0.025, hi: float = 0.975) -> DataFrame:
    """Percentile interval over the replicates (their number is the fixed draw count)."""
    q = F.percentile(value, F.array(F.lit(lo), F.lit(hi)))
    return reps.groupBy(*keys).agg(q.alias("_q")).select(*keys, F.col("_q")[0].alias("ci_lo"), F.col("_q")[1].alias("ci_hi"))


def mean_intervals(df: DataFrame, keys: Sequence[str], row_id: str | Column, values: Sequence[str], replicates: int = 2000, seed: int = 0,
                   minimum: int = 5) -> DataFrame:
    """R1 for several value columns: (keys, name, n, mean, ci_lo, ci_hi); the 95 % interval of the mean is NULL below `minimum` values."""
    base = df.unpivot([F.col(k) for k in keys], list(values), "name", "_v").groupBy(*keys, "name").agg(F.count("_v").alias("n"), F.avg("_v").alias("mean"))
    ci = interval(replicate_means(df, keys, row_id, values, replicates, seed), [*keys, "name"], "mean")
    ok = F.col("n") >= minimum
    return base.join(ci, [*keys, "name"], "left").select(*keys, "name", "n", "mean", F.when(ok, F.col("ci_lo")).alias("ci_lo"), F.when(ok, F.col("ci_hi")).alias("ci_hi"))


def bootstrap_ci(df: DataFrame, keys: Sequence[str], row_id: str | Column, value: str, replicates: int = 2000, seed: int = 0,
                 minimum: int = 5) -> DataFrame:
    """95 % interval of the mean; NULL below `minimum` values."""
    return mean_intervals(df, keys, row_id, [value], replicates, seed, minimum).drop("name")


def difference_intervals(a: DataFrame, b: DataFrame, keys: Sequence[str], row_id: str | Column, values: Sequence[str],
                         replicates: int = 2000, seed: int = 1) -> DataFrame:
    """R2 for several value columns: interval of mean(a) - mean(b), the two sides resampled independently."""
    ra = replicate_means(a, keys, row_id, values, replicates, seed).withColumnRenamed("mean", "ma")
    rb = replicate_means(b, keys, row_id, values, replicates, seed + 1).withColumnRenamed("mean", "mb")
    d = ra.join(rb, [*keys, "name", "rep"]).withColumn("d", F.col("ma") - F.col("mb"))
    return interval(d, [*keys, "name"], "d")


def bootstrap_difference(a: DataFrame, b: DataFrame, keys: Sequence[str], row_id: str | Column, value: str,
                         replicates: int = 2000, seed: int = 1) -> DataFrame:
    """R2: interval of mean(a) - mean(b), the two sides resampled independently."""
    return difference_intervals(a, b, keys, row_id, [value], replicates, seed).drop("name")


def prefix_sums(series: DataFrame, keys: Sequence[str], order: str, cols: Sequence[str]) -> DataFrame:
    """Per series: ord 0..n with running sums and running squares before ord. A series has one row per day."""
    w = W.partitionBy(*keys).orderBy(order)
    run = w.rowsBetween(W.unboundedPreceding, 0)
    body = series.select(*keys, F.row_number().over(w).alias("ord"), *[F.sum(c).over(run).alias(f"s_{c}") for c in cols],
                         *[F.sum(F.col(c) * F.col(c)).over(run).alias(f"q_{c}") for c in cols])
    zero = series.select(*keys).distinct().select(*keys, F.lit(0).alias("ord"), *[F.lit(0.0).alias(f"{p}_{c}") for p in "sq" for c in cols])
    return body.unionByName(zero)


def block_sharpes(series: DataFrame, keys: Sequence[str], order: str, cols: Sequence[str], block: int = 21,
                  draws: int = 5000, seed: int = 0) -> DataFrame:
    """Annualised Sharpe per replicate for every column, all columns sharing the drawn blocks.

    A block's sums are the difference of two prefix sums, so a replicate touches n/block rows, not n.
    """
    pre = stage(prefix_sums(series, keys, order, cols), "prefix")
    n = pre.groupBy(*keys).agg(F.max("ord").alias("n"))
    grid = (n.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(draws - 1)))).repartition(*keys, "rep")
            .withColumn("slot", F.explode(F.sequence(F.lit(0), (F.ceil(F.col("n") / block) - 1).cast("int")))))
    start = F.floor(hash_unit(F.lit(seed), F.col("rep"), F.col("slot")) * (F.col("n") - block + 1)).cast("int")
    grid = grid.withColumn("a", start).withColumn("b", (F.col("a") + F.least(F.lit(block), F.col("n") - F.col("slot") * block)).cast("int"))
    pick = lambda at, p: pre.select(*keys, F.col("ord").alias(at), *[F.col(f"{x}_{c}").alias(f"{p}{x}_{c}") for x in "sq" for c in cols])
    j = grid.join(pick("a", "a"), [*keys, "a"]).join(pick("b", "b"), [*keys, "b"])
    g = j.groupBy(*keys, "rep", "n").agg(*[F.sum(F.col(f"b{x}_{c}") - F.col(f"a{x}_{c}")).alias(f"{x}_{c}") for x in "sq" for c in cols])
    return g.select(*keys, "rep", *[sharpe(F.col(f"s_{c}"), F.col(f"q_{c}"), F.col("n")).alias(c) for c in cols])


def sharpe(total: Column, squares: Column, n: Column) -> Column:
    """Annualised Sharpe from sums; NULL without variation."""
    var = (squares - total * total / n) / (n - 1)
    return F.when(var > 1e-30, total / n / F.sqrt(var) * F.sqrt(F.lit(float(SESSIONS_PER_YEAR))))


def shift_permutation(series: DataFrame, keys: Sequence[str], order: str, pos: str, ret: str, perms: int = 5000,
                      seed: int = 0) -> DataFrame:
    """P-value of the gross Sharpe under circular shifts of the positions.

    Each distinct drawn shift is evaluated once (a shift is an equi-join on the shifted ordinal) and weighted by
    how often it was drawn. Both factors are bounded by the number of days of a series.
    """
    w = W.partitionBy(*keys).orderBy(order)
    o = stage(series.select(*keys, (F.row_number().over(w) - 1).alias("ord"), F.col(pos).alias("p"), F.col(ret).alias("r")), "shift")
    n = o.groupBy(*keys).agg(F.count("*").alias("n"), sharpe(F.sum(F.col("p") * F.col("r")), F.sum((F.col("p") * F.col("r")) ** 2), F.count("*")).alias("observed"))
    drawn = (n.withColumn("id", F.explode(F.sequence(F.lit(0), F.lit(perms - 1))))
             .withColumn("shift", (1 + F.floor(hash_unit(F.lit(seed), F.lit("shift"), F.col("id")) * (F.col("n") - 1))).cast("int"))
             .groupBy(*keys, "n", "observed", "shift").agg(F.count("*").alias("w")))
    moved = drawn.join(o.select(*keys, "ord", "p"), list(keys)).withColumn("at", (F.col("ord") + F.col("shift")) % F.col("n"))
    g = moved.join(o.select(*keys, F.col("ord").alias("at"), "r"), [*keys, "at"]).withColumn("g", F.col("p") * F.col("r"))
    null = g.groupBy(*keys, "shift", "w", "n", "observed").agg(sharpe(F.sum("g"), F.sum(F.col("g") * F.col("g")), F.first("n")).alias("s"))
    hit = F.sum(F.when(F.col("s") >= F.col("observed"), F.col("w")).when(F.col("s").isNotNull(), 0))
    return null.groupBy(*keys, "observed").agg((hit / F.sum(F.when(F.col("s").isNotNull(), F.col("w")))).alias("p_value"))


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """Connected components by min-label propagation; each round is a staged table, stops when labels settle."""
    both = stage(edges.select(F.col(a).alias("u"), F.col(b).alias("v")).unionByName(edges.select(F.col(b).alias("u"), F.col(a).alias("v"))).distinct(), "edges")
    labels = stage(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("label")), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("u", "v").withColumnRenamed("label", "nl"), "v").groupBy("u").agg(F.min("nl").alias("nl"))
        # pointer jump: adopt the label of the current label as well
        jump = labels.select(F.col("u").alias("label"), F.col("label").alias("jl"))
        nxt = labels.join(near, "u", "left").join(jump, "label", "left").select(
            "u", F.least("label", "nl", "jl").alias("label"), F.col("label").alias("old"))
        nxt = stage(nxt, "labels")
        labels = nxt.select("u", "label")
        if nxt.where("label <> old").isEmpty():
            return labels


def block_components(rows: DataFrame, block: str, group: str) -> DataFrame:
    """Calendar blocks tied together by any shared event group; (block, component)."""
    pairs = rows.where(F.col(group).isNotNull()).select(F.col(group).alias("g"), F.col(block).alias("b")).distinct()
    root = pairs.groupBy("g").agg(F.min("b").alias("root"))
    edges = pairs.join(root, "g").select("b", "root").distinct()
    lone = rows.where(F.col(group).isNull()).select(F.col(block).alias("b"), F.col(block).alias("root")).distinct()
    return components(edges.unionByName(lone), "b", "root").select(F.col("u").alias(block), F.col("label").alias("component"))


def paired_block_interval(rows: DataFrame, block: str, group: str, diff: str, replicates: int = 500, seed: int = 0) -> DataFrame:
    """Interval of the mean paired difference, resampling whole components; order statistics, not interpolated."""
    sums = rows.groupBy(block).agg(F.count("*").alias("n_u"), F.sum(diff).alias("s_u"))
    comp = sums.join(block_components(rows, block, group), block).groupBy("component").agg(F.sum("n_u").alias("n_u"), F.sum("s_u").alias("s_u"))
    w1 = W.partitionBy(F.lit(0)).orderBy("component")   # calendar blocks only
    u = stage(comp.select((F.row_number().over(w1) - 1).alias("idx"), "n_u", "s_u", F.count("*").over(W.partitionBy(F.lit(0))).alias("m")), "components")
    reps = (weights(u, replicates, seed).join(u, ["m", "idx"]).groupBy("rep", "m")
            .agg((F.sum(F.col("w") * F.col("s_u")) / F.sum(F.col("w") * F.col("n_u"))).alias("est")))
    ranked = reps.withColumn("rn", F.row_number().over(W.partitionBy(F.lit(0)).orderBy("est")) - 1)   # `replicates` rows
    at = lambda q: F.max(F.when(F.col("rn") == int(q * (replicates - 1)), F.col("est")))
    return ranked.agg(F.max("m").alias("calendar_blocks"), at(0.025).alias("ci_lo"), at(0.975).alias("ci_hi"))
