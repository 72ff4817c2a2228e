"""Joins against per-key results when a few keys hold most of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..staging import stage

SHARE = 1000
#: Per-key results of at most this many rows are broadcast whole.
SMALL = 100_000


def key_lookup(rows: DataFrame, per_key: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Inner join of `rows` to a one-row-per-key table: broadcast after counting it, or by `hot_lookup` if it is large.

    Left to the planner, a few keys fill few shuffle partitions, a broadcast is refused for that, and one task sorts all rows of a key.
    """
    kept = stage(per_key, "per-key")
    if kept.count() <= SMALL:
        return rows.join(F.broadcast(kept), list(keys))
    sized = stage(kept.join(rows.groupBy(*keys).agg(F.count("*").alias("_rows")), list(keys)), "per-key-sized")
    return hot_lookup(rows, sized, keys, "_rows", "inner").drop("_rows")


def hot_lookup(rows: DataFrame, per_key: DataFrame, keys: Sequence[str], count: str, how: str = "left") -> DataFrame:
    """Join `rows` to a staged one-row-per-key table that carries the key's row count.

    Keys above 1/SHARE of all rows number fewer than SHARE, so broadcasting them is bounded whatever the data;
    their rows never meet in one shuffle partition. The remaining keys use an ordinary shuffled join.
    """
    total = per_key.agg(F.sum(count)).first()[0] or 0
    is_hot = F.col(count) * SHARE > F.lit(total)
    hot = per_key.where(is_hot)
    head = rows.join(F.broadcast(hot), list(keys))
    tail = rows.join(F.broadcast(hot.select(*keys)), list(keys), "left_anti").join(per_key.where(~is_hot), list(keys), how)
    return head.unionByName(tail)
