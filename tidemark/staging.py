"""Materialized stage boundaries.

A stage that several branches read is written once as Parquet below the cluster's checkpoint folder
(``spark.checkpoint.dir``). That cuts the lineage, survives lost executors and keeps column pruning and
statistics for the readers. A session that names no folder gets a temporary one only if driver and executors
are one process (master ``local``); on a cluster it is an error, since executors would not see each other's files.
"""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_KEY = "spark.checkpoint.dir"
_fallback: dict[str, str] = {}


def folder(spark: SparkSession) -> str:
    named = spark.conf.get(_KEY, None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError(f"set {_KEY} to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _fallback:
        _fallback[app] = tempfile.mkdtemp(prefix="tidemark-stage-")
    return _fallback[app]


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write `df` once and read it back."""
    path = f"{folder(df.sparkSession)}/tidemark/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
