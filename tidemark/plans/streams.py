"""Streaming queries over the provided files; each runs to the end of the input and returns what it wrote."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..staging import folder
from ..streaming import pipelines as sp
from .registry import query, table


def _place(spark, name):
    return f"{folder(spark)}/tidemark/{name}-{uuid.uuid4().hex}"


def _events(spark, sf_dir):
    schema = table(spark, sf_dir, "events").schema
    return sp.file_stream(spark, sf_dir, "events.parquet", schema).withColumn("at", F.col("ts").cast("timestamp"))


@query("stream_counts", """SELECT user_id AS company, ts::DATE AS filing_date, event_type AS form, count(*) AS n FROM events GROUP BY ALL""")
def stream_counts(spark, sf_dir):
    """X1, X2."""
    keys = ["company", "filing_date", "form"]
    e = _events(spark, sf_dir).select("event_id", "at", F.col("user_id").alias("company"), F.to_date("at").alias("filing_date"), F.col("event_type").alias("form"))
    out = _place(spark, "counts")
    sp.incremental_counts(e, "event_id", keys, out, _place(spark, "checkpoint")).awaitTermination()
    return sp.counted(spark, out, keys)


@query("stream_documents", """SELECT page_id AS document_id, CASE WHEN html IS NULL THEN 'failed' ELSE 'completed' END AS status, CASE WHEN html IS NOT NULL THEN sha256(html) END AS source_sha256 FROM pages""")
def stream_documents(spark, sf_dir):
    """A second run over the same pages adds nothing."""
    p = sp.file_stream(spark, sf_dir, "pages.parquet", table(spark, sf_dir, "pages").schema)
    out = _place(spark, "transcripts")
    for _ in range(2):
        sp.document_batches(p, "page_id", "html", out, _place(spark, "checkpoint")).awaitTermination()
    return spark.read.parquet(out).select("document_id", "status", "source_sha256")


@query("stream_quotes", """WITH q AS (SELECT event_id AS quote_id, user_id AS k, ts AS quote_at FROM events WHERE event_type <> 'error'), o AS (SELECT event_id AS order_id, user_id AS k, ts AS order_at FROM events WHERE event_type = 'error')
SELECT order_id, arg_max(quote_id, (quote_at, quote_id)) AS quote_id FROM o JOIN q USING (k) WHERE quote_at BETWEEN order_at - INTERVAL 6 HOUR AND order_at GROUP BY 1""")
def stream_quotes(spark, sf_dir):
    """Latest visible quote per order from stored sides."""
    order = F.col("event_type") == "error"
    rows = _events(spark, sf_dir).where("event_type IS NOT NULL").select(F.when(order, "order").otherwise("quote").alias("side"), F.col("event_id").alias("id"), F.col("user_id").alias("k"), "at", F.col("at").alias("seen_at"))
    out = _place(spark, "quotes")
    sp.quotes_for_orders(rows, 6 * 3600, out, _place(spark, "checkpoint")).awaitTermination()
    return spark.read.parquet(f"{out}/matches").groupBy("order_id").agg(F.max_by("quote_id", F.struct("quote_at", "quote_id")).alias("quote_id"))
