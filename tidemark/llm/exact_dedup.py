"""Exact dedup by progressive refinement, in DataFrame functions only.

Documents are first grouped by the length of their normalised text, the groups of two and more by a hash of its prefix, and only the
members of groups that survive both by the SHA-256 of the whole normalised text. Normalising replaces each run of white space by one space.

Defined cases: a null text equals the empty text; a null doc_id comes after every other id; rows that repeat both doc_id and text are one
document and get the same decision; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import SPACE, keep_rows, query, staged_small, table, whole
from tidemark.staging import stage

#: Characters of the prefix that the second step hashes.
PREFIX = 256


def refine(docs: DataFrame, digest_all: bool = False) -> DataFrame:
    """One row per row of `docs`: doc_id, keep_id, group_size, kept, digest.

    `digest` is the SHA-256 of the normalised text; without `digest_all` it is computed only for documents that share length and prefix
    with another (else null). No step moves a text between machines as long as the surviving keys can be broadcast.
    """
    text = docs.select(F.col("doc_id").alias("doc_id"), F.regexp_replace(whole("text"), SPACE, " ").alias("body"))
    keyed = text.select("doc_id", "body", F.length("body").alias("len"), F.xxhash64(F.substring("body", 1, PREFIX)).alias("head"))
    groups = keyed.groupBy("len", "head").agg(F.count(F.lit(1)).alias("n"))
    shared_length = groups.groupBy("len").agg(F.sum("n").alias("of_length")).where("of_length > 1")
    survivors, _ = staged_small(groups.where("n > 1").join(shared_length, "len", "left_semi").select("len", "head", F.lit(True).alias("again")), "dedup-survivors")
    full = F.sha2(F.col("body").cast("binary"), 256)
    if digest_all:
        keyed = keyed.select("doc_id", "len", "head", full.alias("digest"))
        rows = keyed.join(survivors, ["len", "head"], "left").select("doc_id", "digest", F.coalesce("again", F.lit(False)).alias("again"))
    else:
        rows = keyed.join(survivors, ["len", "head"], "left").select("doc_id", F.when(F.col("again"), full).alias("digest"), F.coalesce("again", F.lit(False)).alias("again"))
    rows = stage(rows, "dedup-rows")
    copies, _ = staged_small(rows.where("again").groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first")).where("n > 1"), "dedup-copies")
    return (rows.join(copies, "digest", "left")
            .select("doc_id", F.when(F.col("n").isNull(), F.col("doc_id")).otherwise(F.col("first")).alias("keep_id"), F.coalesce("n", F.lit(1)).cast("long").alias("group_size"), "digest")
            .withColumn("kept", F.col("doc_id").eqNullSafe(F.col("keep_id"))))


def stage_exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without their exact copies; of each group the row with the smallest doc_id stays, and of rows that repeat doc_id and text one.

    Decisions are by doc_id where all rows of an id fare alike; rows of the other ids are told apart by the digest of their text.
    """
    found = stage(refine(docs), "dedup-result")
    once = keep_rows(docs, found.where("kept").select("doc_id").distinct(), "dedup-kept")
    per_id = found.groupBy("doc_id").agg(F.bool_or("kept").alias("some"), F.bool_and("kept").alias("all"), F.count_if(F.col("kept") & (F.col("group_size") > 1)).alias("n"))
    odd = per_id.where("some AND (NOT all OR n > 1)").select("doc_id")
    if odd.isEmpty():
        return once
    ids, _ = staged_small(odd.toDF("__again"), "dedup-again")
    plain = once.join(ids, once["doc_id"].eqNullSafe(F.col("__again")), "left_anti")
    body = F.sha2(F.regexp_replace(whole("text"), SPACE, " ").cast("binary"), 256)
    apart = once.join(ids, once["doc_id"].eqNullSafe(F.col("__again")), "left_semi").withColumn("__body", body)
    gone = found.where("NOT kept").select(F.col("doc_id").alias("__id"), F.col("digest").alias("__digest")).distinct()
    gone, _ = staged_small(gone.join(ids, F.col("__id").eqNullSafe(F.col("__again")), "left_semi"), "dedup-gone")
    apart = apart.join(gone, apart["doc_id"].eqNullSafe(F.col("__id")) & (F.col("__body") == F.col("__digest")), "left_anti")
    return plain.unionByName(apart.dropDuplicates(["doc_id", "__body"]).drop("__body"))


SQL = r"""
WITH t AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS h FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY h) AS keep_id, count(*) OVER (PARTITION BY h) AS group_size,
       doc_id IS NOT DISTINCT FROM min(doc_id) OVER (PARTITION BY h) AS kept, h AS text_sha256
FROM t
"""


@query("op10_exact_dedup", SQL)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return refine(table(spark, sf_dir, "documents").select("doc_id", "text"), digest_all=True).withColumnRenamed("digest", "text_sha256").select("doc_id", "keep_id", "group_size", "kept", "text_sha256")
