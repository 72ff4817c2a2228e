"""Structured Streaming forms of the incremental behaviours."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.text import html_text
from ..sources import sinks


def file_stream(spark: SparkSession, folder: str, pattern: str, schema, max_files: int | None = None) -> DataFrame:
    """Files of `folder` whose path matches `pattern`; a match that is itself a folder of part files gives its files."""
    r = spark.readStream.schema(schema)
    return (r.option("maxFilesPerTrigger", max_files) if max_files else r).parquet(f"{folder}/{{{pattern}}}")   # braces: a plain name, too, is looked up as a pattern


def written(spark: SparkSession, path: str) -> DataFrame | None:
    """What was written to `path` before; None only if there is no such folder, any other error stays one."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def incremental_counts(filings: DataFrame, accession: str, keys: Sequence[str], out: str, checkpoint: str) -> StreamingQuery:
    """Counts that neither a restart nor a late arrival falsifies.

    Every micro-batch keeps the accessions that no earlier batch has, however old they are, and writes them and its increments to folders of
    its own: a replayed batch replaces itself, the checkpoint is the resume point. State is a table, so nothing leaves it by age.
    """
    def increment(df: DataFrame, batch: int) -> None:
        new, seen = df.dropDuplicates([accession]), written(df.sparkSession, f"{out}/seen")
        if seen is not None:
            new = new.join(seen.where(F.col("batch") < batch).select(accession), accession, "left_anti")
        new.select(accession, *keys).write.mode("overwrite").parquet(f"{out}/seen/batch={batch}")
        fresh = df.sparkSession.read.schema(new.select(accession, *keys).schema).parquet(f"{out}/seen/batch={batch}")
        fresh.groupBy(*keys).agg(F.count("*").alias("n")).write.mode("overwrite").parquet(f"{out}/counts/batch={batch}")

    return filings.writeStream.foreachBatch(increment).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def counted(spark: SparkSession, out: str, keys: Sequence[str]) -> DataFrame:
    return spark.read.parquet(f"{out}/counts").groupBy(*keys).agg(F.sum("n").alias("n"))


def document_batches(pages: DataFrame, doc: str, html: str, out: str, checkpoint: str) -> StreamingQuery:
    """Restartable extraction; documents already completed with the same content are skipped."""
    spark = pages.sparkSession

    def run(df: DataFrame, batch: int) -> None:
        todo, done = df.withColumn("source_sha256", F.sha2(html, 256)), written(spark, out)
        if done is not None:
            done = done.where("status = 'completed'").select(F.col("document_id").alias(doc), "source_sha256")
            todo = todo.join(done, [doc, "source_sha256"], "left_anti")
        sinks.write_transcripts(html_text(todo, doc, html, ["source_sha256"]), out)

    return pages.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def quotes_for_orders(rows: DataFrame, age: int, out: str, checkpoint: str, day_seconds: int = 86400) -> StreamingQuery:
    """Quotes stamped at most `age` seconds before an order and visible by then, however late either side arrives.

    `rows` carries both sides: side ('order' or 'quote'), id, k (key), at (its own clock), seen_at (when a quote became visible). Every micro-batch is
    stored by side and day, then its orders meet all stored quotes and its quotes the orders of earlier batches. Both joins are equi-joins on
    key and age-wide time bucket, over the stored days that the batch touches. Nothing leaves by age. Rows that can match nothing go to
    `rejected` with a reason: no_id, no_key, no_clock, unknown_side, seen_before_event, duplicate (of an id in this or an earlier batch).
    A replayed batch replaces what it wrote.
    """
    kept = ["id", "k", "at", "seen_at"]
    bucket = lambda c: F.floor(F.unix_micros(c) / (age * 1_000_000))
    day = F.floor(F.unix_micros("at") / (day_seconds * 1_000_000))

    def stored(df: DataFrame, side: str, before: int, days: DataFrame, reach: tuple[int, int]) -> DataFrame | None:
        """Rows of `side` from batches before `before`, in days within `reach` of `days`."""
        found = written(df.sparkSession, f"{out}/{side}")
        if found is None:
            return None
        near = days.select(F.explode(F.sequence(F.col("day") + reach[0], F.col("day") + reach[1])).alias("day")).distinct()
        return found.where(F.col("batch") < before).join(F.broadcast(near), "day", "left_semi")

    def run(df: DataFrame, batch: int) -> None:
        spark = df.sparkSession
        clock = F.col("at").isNull() | ((F.col("side") == "quote") & F.col("seen_at").isNull())
        reason = (F.when(~F.coalesce(F.col("side").isin("order", "quote"), F.lit(False)), "unknown_side").when(F.col("id").isNull(), "no_id").when(F.col("k").isNull(), "no_key")
                  .when(clock, "no_clock").when((F.col("side") == "quote") & (F.col("seen_at") < F.col("at")), "seen_before_event"))
        marked = df.select("side", *kept).withColumn("reason", reason)
        sound = marked.where("reason IS NULL").drop("reason")
        new = sound.groupBy("side", "id").agg(F.min(F.struct("at", "k", "seen_at")).alias("r"), F.count("*").alias("n"))
        fresh, again = new.select("side", "id", "r.*", "n"), []
        for side in ("order", "quote"):
            known = written(spark, f"{out}/{side}")
            mine = fresh.where(F.col("side") == side)
            if known is not None:
                seen = known.where(F.col("batch") < batch).select("id")
                again.append(mine.join(seen, "id", "left_semi").withColumn("n", F.col("n") + 1))
                mine = mine.join(seen, "id", "left_anti")
            again.append(mine)
            mine.select(*kept, day.alias("day"), F.lit(batch).alias("batch")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch", "day").parquet(f"{out}/{side}")
        twice = again[0]
        for part in again[1:]:
            twice = twice.unionByName(part)
        twice = twice.where("n > 1").select("side", *kept, F.lit("duplicate").alias("reason"), F.explode(F.sequence(F.lit(2), F.col("n").cast("int")))).drop("col")
        marked.where("reason IS NOT NULL").unionByName(twice).withColumn("batch", F.lit(batch)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(f"{out}/rejected")
        wide = -(-age // day_seconds)
        now = {side: spark.read.parquet(f"{out}/{side}").where(F.col("batch") == batch) for side in ("order", "quote")}
        pairs = []
        for side, other, before, reach in (("order", "quote", batch + 1, (-wide, 0)), ("quote", "order", batch, (0, wide))):
            far = stored(df, other, before, now[side].select("day").distinct(), reach)
            pairs.append((now["order"], far) if side == "order" else (far, now["quote"]))
        found = None
        for o, q in pairs:
            o = o.select(F.col("id").alias("order_id"), "k", F.col("at").alias("order_at"), F.explode(F.array(bucket("at") - 1, bucket("at"))).alias("b"))
            q = q.select(F.col("id").alias("quote_id"), "k", F.col("at").alias("quote_at"), "seen_at", bucket("at").alias("b"))
            gap = F.unix_micros("order_at") - F.unix_micros("quote_at")
            m = o.join(q, ["k", "b"]).where(gap.between(0, age * 1_000_000) & (F.col("seen_at") <= F.col("order_at"))).select("order_id", "quote_id", "order_at", "quote_at")
            found = m if found is None else found.unionByName(m)
        found.withColumn("batch", F.lit(batch)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(f"{out}/matches")

    return rows.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
