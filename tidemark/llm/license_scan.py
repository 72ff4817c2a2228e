"""Licence scan by ordered signature rules, in DataFrame functions only.

One pass over the table counts words and gates each text by a keyword test; only gated texts are taken apart into words. A gated text meets
the rules whose keyword it has. Every match is an interval of words. Overlaps are resolved in two steps: a match inside another one goes (of
equal intervals the one of higher priority stays), then of overlapping neighbours the one of lower priority goes.

Defined cases: a null text is empty: no words, no labels, score 0; a null doc_id stays null; rows that repeat a doc_id are scanned one by one;
an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import query, table, whole
from tidemark.llm.license_rules import GATE, rules
from tidemark.staging import stage

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_IN = r"0-9A-Za-z\x{80}-\x{10FFFF}"


def _blanks(c):
    return F.length(c) - F.length(F.replace(c, F.lit(" "), F.lit("")))


def prepare(docs: DataFrame) -> DataFrame:
    """(row, doc_id, n_words, body): body is ' word word ... ' of gated texts, null for the others. Written once, so that `row` is fixed."""
    text = docs.select("doc_id", whole("text").alias("t"))
    body = F.concat(F.lit(" "), F.trim(F.regexp_replace(F.translate("t", UPPER, LOWER), f"[^{_IN}]+", " ")), F.lit(" "))
    return stage(text.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.regexp_count("t", F.lit(f"[{_IN}]+")).cast("long").alias("n_words"), F.when(F.col("t").rlike(GATE), body).alias("body")), "license-words")


def matches(words: DataFrame) -> DataFrame:
    """All matches of all rules in `prepare`'s rows: row, rule, label, priority, confidence, is_base, first, after (word interval)."""
    spark = words.sparkSession
    table_ = F.broadcast(spark.createDataFrame(rules(), "rule int, keyword string, pattern string, label string, priority int, confidence double, is_base boolean"))  # a constant table
    keywords = sorted({r[1] for r in rules()})
    gated = words.where("body is not null").select("row", "body", F.explode(F.filter(F.array(*[F.lit(k) for k in keywords]), lambda k: F.contains(F.col("body"), k))).alias("keyword"))
    hits = gated.join(table_, "keyword").where(F.expr("regexp_like(body, pattern)"))
    parts = hits.select("row", "rule", "label", "priority", "confidence", "is_base", F.split("body", F.col("pattern"), -1).alias("between"), F.expr("regexp_extract_all(body, pattern, 0)").alias("found"))
    each = parts.select("row", "rule", "label", "priority", "confidence", "is_base", F.posexplode(F.arrays_zip(F.slice("between", F.lit(1), F.size("found")).alias("gap"), F.col("found").alias("hit"))).alias("pos", "m"))
    each = each.select("row", "rule", "label", "priority", "confidence", "is_base", "pos", _blanks(F.col("m.gap")).alias("gap"), _blanks(F.col("m.hit")).alias("len"))
    run = Window.partitionBy("row", "rule").orderBy("pos")
    return each.withColumn("after", F.sum(F.col("gap") + F.col("len")).over(run)).withColumn("first", F.col("after") - F.col("len")).drop("gap", "len", "pos")


def resolve(found: DataFrame) -> DataFrame:
    """Without matches inside others, and without the weaker of overlapping neighbours."""
    inside = Window.partitionBy("row").orderBy(F.col("first"), F.col("after").desc(), F.col("priority").desc(), F.col("rule")).rowsBetween(Window.unboundedPreceding, -1)
    outer = found.withColumn("reach", F.max("after").over(inside)).where("reach is null or reach < after")
    line = Window.partitionBy("row").orderBy("first")
    near = outer.select("*", F.lag("after").over(line).alias("left_end"), F.lag("priority").over(line).alias("left_priority"), F.lead("first").over(line).alias("right_start"), F.lead("priority").over(line).alias("right_priority"))
    beaten = ((F.col("left_end") > F.col("first")) & (F.col("left_priority") > F.col("priority"))) | ((F.col("right_start") < F.col("after")) & (F.col("right_priority") > F.col("priority")))
    return near.where(~F.coalesce(beaten, F.lit(False)))


def scan(docs: DataFrame) -> DataFrame:
    """One row per row of `docs`: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    words = prepare(docs)
    found = stage(matches(words), "license-matches")
    base = found.where("is_base").groupBy("row").agg(F.count(F.lit(1)).alias("n_base"), F.min("first").alias("first_word"), F.max("first").alias("last_word"), F.collect_set("label").alias("base_set"))
    kept = resolve(found.where("not is_base")).groupBy("row").agg(F.collect_set("label").alias("own_set"), F.max("confidence").alias("own_score"))
    none = F.array().cast("array<string>")
    result = words.select("row", "doc_id", "n_words").join(base, "row", "left").join(kept, "row", "left")
    base_set, own_set = F.coalesce("base_set", none), F.coalesce("own_set", none)
    return result.select(
        "doc_id", "n_words", F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"), F.col("first_word").cast("long").alias("first_word"), F.col("last_word").cast("long").alias("last_word"),
        F.array_join(F.array_sort(base_set), ",").alias("base_labels"), F.array_join(F.array_sort(F.array_union(base_set, own_set)), ",").alias("labels"),
        F.greatest(F.coalesce("own_score", F.lit(0.0)), F.when(F.col("n_base") > 0, 0.9).otherwise(0.0)).alias("score"))


@query("op9_license_scan")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
