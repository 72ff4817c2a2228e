"""Shared helpers: query tables, stages, size-checked broadcasts, text classes."""

from __future__ import annotations

import ctypes
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.staging import stage

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

#: Words are runs of anything but these bytes.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"
#: A side of at most this many narrow rows (a few numbers or one digest) may be broadcast: about 100 MB at most.
BROADCAST_ROWS = 1_000_000


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole(text: str | Column) -> Column:
    """A null text is the empty text."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def staged_small(df: DataFrame, name: str, rows: int = BROADCAST_ROWS) -> tuple[DataFrame, int]:
    """Write `df`; mark it for broadcast only if it has at most `rows` rows, else leave the join to shuffles. Returns it with its row count."""
    kept = stage(df, name)
    n = kept.count()
    return (F.broadcast(kept) if n <= rows else kept), n


def keep_rows(docs: DataFrame, ids: DataFrame, name: str) -> DataFrame:
    """Rows of `docs` whose doc_id is among `ids` (one column, any name); null ids compare as equal. All columns of `docs` stay as they are."""
    ids, _ = staged_small(ids.toDF("__kept"), name)
    return docs.join(ids, docs["doc_id"].eqNullSafe(F.col("__kept")), "left_semi")


def release() -> None:
    """Memory that a worker would keep while it is idle goes back to the system."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # not glibc
        pass


@contextmanager
def arrow_rows(spark: SparkSession, rows: int):
    """What is planned inside sends Python Arrow batches of so many rows at most: a batch of whole texts lies in the JVM and in the worker."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def sliced(batches, limit: int, column: int = 1, rows: int = 4096):
    """Batches of few documents: those of about `limit` bytes of text in `column`, a longer text by itself. Frees what the task held when it ends."""
    try:
        for batch in batches:
            ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy().astype(np.int64))
            i = 0
            while i < batch.num_rows:
                j = min(i + rows, max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + limit, "right"))))
                yield batch.take(pa.array(np.arange(i, j)))  # a copy: splitting at white space reads slices of an array wrongly
                i = j
    finally:
        release()
