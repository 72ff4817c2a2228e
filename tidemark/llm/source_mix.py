"""Mixing sources to target weights by systematic sampling.

Within a source the expected copies of its documents are prefix-summed, one random offset is added, and a document is emitted once per
integer boundary that its step crosses. Every document of a source expects the same number of copies (target / source size, 2 at most), so
its prefix sum is its rank times that rate. Ranks follow (size, doc_id): neighbours have nearly equal sizes, so the words taken from a source
miss its target by about one document.

Ranks need no window over a source: one range shuffle by (source, size, doc_id), rows numbered inside the sorted partitions, and a prefix sum
over one count per (source, partition).

Defined cases: a null text has size 0; a null source is a source of its own that comes last; a source of size 0 has target 0; rows that repeat
a doc_id are separate documents; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import WORD, query, staged_small, table, whole
from tidemark.staging import stage

#: Production parameters: weights by place of the source, repeated; words to take as a share of all; copies of a document at most.
WEIGHTS = (5, 2, 1)
SHARE = 1.5
CEILING = 2
SEED = "mix-1"


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, ceiling: int = CEILING) -> DataFrame:
    """(source, source_size) -> with target. The table has one row per source.

    Sources stop at ceiling * size and their excess is shared out again by weight: a source is full if, with every source of a smaller size
    per weight full, its share of the rest is no less than its ceiling. The full ones are a prefix of that order, the others split what is left.
    """
    place = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.pmod(F.row_number().over(place) - 1, F.lit(len(weights))) + 1).cast("int"))
    ratio = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    before, every = ratio.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    df = sources.withColumn("weight", weight)
    df = df.select("source", "source_size", "weight", F.coalesce(F.sum("source_size").over(before), F.lit(0)).alias("full_size"), F.coalesce(F.sum("weight").over(before), F.lit(0)).alias("full_weight"),
                   F.sum("source_size").over(every).alias("all_size"), F.sum("weight").over(every).alias("all_weight"))
    # money of the rest, share of it per weight if all before are full
    rest, rest_weight = share * F.col("all_size") - ceiling * F.col("full_size"), F.col("all_weight") - F.col("full_weight")
    df = df.withColumn("full", rest * F.col("weight") >= ceiling * F.col("source_size") * rest_weight)
    open_size = F.sum(F.when(F.col("full"), F.col("source_size"))).over(every)
    open_weight = F.sum(F.when(~F.col("full"), F.col("weight"))).over(every)
    target = F.when(F.col("full"), (ceiling * F.col("source_size")).cast("double")).otherwise((share * F.col("all_size") - ceiling * F.coalesce(open_size, F.lit(0))) * F.col("weight") / open_weight)
    return df.select("source", "source_size", target.cast("double").alias("target"))


def offset(source) -> F.Column:
    """One number in [0, 1) per source from a digest of the seed and the source."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{SEED}|"), F.coalesce(source, F.lit("|null")))), 1, 8), 16, 10).cast("long") / F.lit(4294967296.0)


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, ceiling: int = CEILING) -> DataFrame:
    """One row per row of `docs`: doc_id, source, size, source_size, target, copies."""
    # the range shuffle fixes the partitions; they and the row numbers inside them are written before anything reads them
    sized = docs.select("doc_id", "source", F.regexp_count(whole("text"), F.lit(WORD)).cast("long").alias("size"))
    order = [F.col("source").asc_nulls_last(), F.col("size").asc(), F.col("doc_id").asc_nulls_last()]
    rows = stage(sized.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("row", F.monotonically_increasing_id()), "mix-rows").withColumn("part", F.shiftright("row", 33))
    pieces = rows.groupBy("source", "part").agg(F.count(F.lit(1)).alias("n"), F.min("row").alias("first"), F.sum("size").alias("words"))
    parts = stage(pieces.withColumn("skipped", F.coalesce(F.sum("n").over(Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))), "mix-parts")
    plan = targets(parts.groupBy("source").agg(F.sum("words").alias("source_size")), weights, share, ceiling).withColumn("offset", offset(F.col("source")))
    joined = parts.alias("p").join(plan.alias("t"), F.col("p.source").eqNullSafe(F.col("t.source")))
    # a row for each source and partition that holds it
    known, _ = staged_small(joined.select(F.col("p.source").alias("of_source"), F.col("p.part").alias("of_part"), (F.col("skipped") - F.col("first")).alias("shift"), "source_size", "target", "offset",
                                          F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0)).alias("rate")), "mix-plan")
    rank = F.col("row") + F.col("shift")
    copies = F.floor((rank + 1) * F.col("rate") + F.col("offset")) - F.floor(rank * F.col("rate") + F.col("offset"))
    return (rows.join(known, F.col("source").eqNullSafe(F.col("of_source")) & (F.col("part") == F.col("of_part")))
            .select("doc_id", "source", "size", "source_size", "target", copies.cast("long").alias("copies")))


def stage_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixed documents: each of them as often as its copies say."""
    taken, _ = staged_small(mix(docs).select(F.col("doc_id").alias("__id"), F.col("source").alias("__source"), F.col("size").alias("__size"), F.col("copies").alias("__copies"))
                            .groupBy("__id", "__source", "__size").agg(F.sum("__copies").alias("__sum"), F.count(F.lit(1)).alias("__rows")), "mix-copies")
    # rows that repeat id, source and size share their copies: the first ones get one more where they don't come out even
    wide = docs.withColumn("__words", F.regexp_count(whole("text"), F.lit(WORD)).cast("long"))
    joined = wide.join(taken, wide["doc_id"].eqNullSafe(F.col("__id")) & wide["source"].eqNullSafe(F.col("__source")) & (F.col("__words") == F.col("__size")))
    single = joined.where("__rows = 1").withColumn("__n", F.col("__sum"))
    nth = F.row_number().over(Window.partitionBy("__id", "__source", "__size").orderBy("text"))
    several = joined.where("__rows > 1").withColumn("__n", F.floor(F.col("__sum") / F.col("__rows")) + F.when(nth <= F.col("__sum") % F.col("__rows"), 1).otherwise(0))
    return single.unionByName(several).where("__n > 0").withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__n").cast("int")))).select(*[F.col(f"`{c}`") for c in docs.columns])


SQL = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, CASE (row_number() OVER (ORDER BY encode(source) ASC NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight FROM s),
f AS (SELECT *, coalesce(sum(source_size) OVER r, 0)::BIGINT AS full_size, coalesce(sum(weight) OVER r, 0)::BIGINT AS full_weight,
             (sum(source_size) OVER ())::BIGINT AS all_size, (sum(weight) OVER ())::BIGINT AS all_weight
      FROM w WINDOW r AS (ORDER BY source_size::DOUBLE / weight, encode(source) ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
g AS (SELECT *, (1.5::DOUBLE * all_size - 2 * full_size) * weight >= 2 * source_size * (all_weight - full_weight) AS is_full FROM f),
t AS (SELECT source, source_size, CASE WHEN is_full THEN (2 * source_size)::DOUBLE
             ELSE (1.5::DOUBLE * all_size - 2 * coalesce((sum(source_size) FILTER (is_full) OVER ())::BIGINT, 0)) * weight / ((sum(weight) FILTER (NOT is_full) OVER ())::BIGINT) END AS target,
             ('0x' || substr(md5('mix-1|' || coalesce(source, '|null')), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u FROM g),
r AS (SELECT d.doc_id, d.size, t.source_size, t.target, t.u, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0 END AS rate,
             row_number() OVER (PARTITION BY d.source ORDER BY d.size, d.doc_id ASC NULLS LAST) - 1 AS k
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size::BIGINT AS size, source_size, target, ((floor((k + 1) * rate + u) - floor(k * rate + u)) * size)::BIGINT AS taken FROM r
"""


@query("op3_source_mix", SQL)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source")).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))
