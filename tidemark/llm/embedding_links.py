"""Embedding near-dedup: int8 tile products with rigorous error bounds, exact cosines only for pairs possibly above the threshold.

Equal vectors are one node. Nodes are dealt to blocks; each pair of blocks is one tile. In a tile every unit vector u is s * q + e with q int8
and e the remainder, so that |u.v - s_u s_v (q_u.q_v)| <= |s_u q_u| |e_v| + |e_u| |s_v q_v| + |e_u| |e_v|. Integer products of whole tiles
that lie more than that bound under the threshold are settled; all others are recomputed in double precision. A tile returns link counts and
a spanning forest, never its pairs, so a large group of near copies costs no more output than its members.

Defined cases: vectors that are null, zero, or hold null or non-finite components, and rows without vec_id, link with nothing; vectors of
different length link with nothing; rows that repeat a vec_id are one vector for components, each counts as a link of the others; an empty
table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import query, staged_small, table
from tidemark.llm.components import components
from tidemark.staging import stage

THRESHOLD = 0.95
#: Nodes of a block. A task holds one tile: two blocks and a strip of products, some 30 MB at 64 components.
BLOCK = 2048
STRIP = 512


def quantise(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Rows in double precision -> unit rows, int8 codes, scales, and norms of what the codes leave (rounded up)."""
    unit = vectors / np.sqrt((vectors * vectors).sum(axis=1))[:, None]
    scale = np.abs(unit).max(axis=1) / 127
    codes = np.rint(unit / scale[:, None]).astype(np.int8)
    left = unit - codes * scale[:, None]
    return unit, codes, scale, np.sqrt((left * left).sum(axis=1)) * (1 + 1e-9) + 1e-12


def links_of_tile(a: np.ndarray, b: np.ndarray, threshold: float, same: bool):
    """Yields (i, js): row i of `a` and all rows of `b` with cosine >= threshold (of the later rows only if `same`). a, b: double precision."""
    ua, qa, sa, ea = quantise(a)
    ub, qb, sb, eb = quantise(b)
    # exact integers: up to 1040 components of 127 * 127 stay below 2^24
    kind = np.float32 if a.shape[1] <= 1040 else np.float64
    right, na, nb = qb.T.astype(kind), 1 + ea, 1 + eb
    for at in range(0, len(a), STRIP):
        rows = slice(at, min(at + STRIP, len(a)))
        upper = (qa[rows].astype(kind) @ right).astype(np.float64)
        upper *= sa[rows, None]
        upper *= sb
        upper += na[rows, None] * eb + ea[rows, None] * (nb + eb) + 1e-9
        possible = upper >= threshold
        if same:
            possible &= np.arange(len(b)) > np.arange(at, rows.stop)[:, None]
        for k in np.flatnonzero(possible.any(axis=1)):
            js = np.flatnonzero(possible[k])
            js = js[ub[js] @ ua[at + k] >= threshold]
            if len(js):
                yield at + k, js


def _tile(ids_a, m_a, vec_a, ids_b, m_b, vec_b, same, threshold):
    """Link counts (node, n) and forest edges (a, b) of one tile."""
    ids = ids_a if same else np.concatenate([ids_a, ids_b])
    count, label, base = np.zeros(len(ids), np.int64), np.arange(len(ids)), 0 if same else len(ids_a)
    for i, js in links_of_tile(vec_a, vec_b, threshold, same):
        count[i] += m_b[js].sum()
        count[js + base] += m_a[i]
        roots = np.unique(np.append(label[js + base], label[i]))
        if len(roots) > 1:
            label[np.isin(label, roots)] = roots[0]
    n, e = np.flatnonzero(count), np.flatnonzero(label != np.arange(len(ids)))
    return ids[n], count[n], ids[e], ids[label[e]]


def _unpack(ids: bytes, copies: bytes, values: bytes, dims: int):
    return np.frombuffer(ids, np.int64), np.frombuffer(copies, np.int64), np.frombuffer(values, np.float32 if len(values) == 4 * dims * (len(ids) // 8) else np.float64).reshape(-1, dims).astype(np.float64)


def near(vectors: DataFrame, threshold: float = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """(vec_id, embedding) -> one row per row: vec_id, n_links, component_id, kept."""
    v = F.col("embedding").cast("array<double>")
    ok = F.col("vec_id").isNotNull() & F.coalesce(F.size(v) > 0, F.lit(False)) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0)
    ok = F.coalesce(ok, F.lit(False))
    rows = vectors.select("vec_id", F.when(ok, v).alias("v"))
    rows = rows.withColumns({"h1": F.when(F.col("v").isNotNull(), F.xxhash64("v")), "h2": F.when(F.col("v").isNotNull(), F.xxhash64(F.lit(1), "v"))})
    # one node per distinct vector; min_by keeps any of the equal vectors
    nodes = stage(rows.where("v is not null").groupBy("h1", "h2").agg(F.min("vec_id").alias("node"), F.count(F.lit(1)).alias("copies"), F.first("v").alias("v")).withColumn("dims", F.size("v")), "links-nodes")
    blocks = nodes.groupBy("dims").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks"))
    dealt = nodes.join(blocks, "dims").withColumn("block", F.pmod(F.xxhash64("node", F.lit(7)), F.col("blocks")).cast("int"))

    def pack(batch: pa.Table) -> pa.Table:
        order = np.argsort(batch["node"].to_numpy(), kind="stable")
        flat = np.ascontiguousarray(batch["v"].combine_chunks().flatten().to_numpy().reshape(len(order), -1)[order])
        as_float = flat.astype(np.float32)
        values = as_float.tobytes() if (as_float == flat).all() else flat.tobytes()
        return pa.table({"dims": pa.array([flat.shape[1]], pa.int32()), "blocks": batch["blocks"][:1].combine_chunks(), "block": batch["block"][:1].combine_chunks(), "ids": [batch["node"].to_numpy()[order].tobytes()],
                         "copies": [batch["copies"].to_numpy()[order].tobytes()], "vals": [values]})

    packed = stage(dealt.select("dims", "blocks", "block", "node", "copies", "v").groupBy("dims", "block").applyInArrow(pack, "dims int, blocks int, block int, ids binary, copies binary, vals binary"), "links-blocks")
    # each unordered pair of blocks once; block i meets the half of the circle behind it, so every block is right side equally often
    step = F.explode(F.sequence(F.lit(0), (F.col("blocks") / 2).cast("int")))
    pairs = packed.select("dims", "blocks", "block", step.alias("step")).where("2 * step < blocks or block < (block + step) % blocks").withColumn("other", F.expr("(block + step) % blocks"))
    left = packed.select("dims", "block", F.col("ids").alias("l_ids"), F.col("copies").alias("l_copies"), F.col("vals").alias("l_vals"))
    right = packed.select("dims", F.col("block").alias("other"), F.col("ids").alias("r_ids"), F.col("copies").alias("r_copies"), F.col("vals").alias("r_vals"))
    tiles = pairs.select("dims", "block", "other").join(left.hint("merge"), ["dims", "block"]).join(right.hint("merge"), ["dims", "other"])

    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                d = r["dims"]
                a, b = _unpack(r["l_ids"], r["l_copies"], r["l_vals"], d), _unpack(r["r_ids"], r["r_copies"], r["r_vals"], d)
                n, c, x, y = _tile(a[0], a[1], a[2], b[0], b[1], b[2], r["block"] == r["other"], threshold)
                yield pa.record_batch({"node": pa.array(np.concatenate([n, x])), "links": pa.array(np.concatenate([c, np.zeros(len(x), np.int64)])), "to": pa.array(np.concatenate([np.full(len(n), -1), y]).astype(np.int64), mask=np.concatenate([np.ones(len(n), bool), np.zeros(len(x), bool)]))})

    found = stage(tiles.mapInArrow(run, "node long, links long, to long"), "links-found")
    joined = components(found.where("to is not null").select(F.col("node").alias("a"), F.col("to").alias("b")), "links")
    counted = found.where("to is null").groupBy("node").agg(F.sum("links").alias("links"))
    linked, _ = staged_small(counted.join(joined, "node", "left"), "links-counted")
    copies, _ = staged_small(nodes.where("copies > 1").select(F.col("h1").alias("g1"), F.col("h2").alias("g2"), F.col("node").alias("first"), "copies"), "links-copies")
    own = rows.select("vec_id", "h1", "h2").join(copies, (F.col("h1") == F.col("g1")) & (F.col("h2") == F.col("g2")), "left").select("vec_id", F.coalesce("first", F.when(F.col("h1").isNotNull(), F.col("vec_id"))).alias("own"), F.coalesce(F.col("copies") - 1, F.lit(0)).alias("others"))
    done = own.join(linked, own["own"] == linked["node"], "left")
    return done.select("vec_id", (F.coalesce("links", F.lit(0)) + F.col("others")).cast("long").alias("n_links"), F.coalesce("component", "own", "vec_id").alias("component_id")).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


@query("op2_embedding_links")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
