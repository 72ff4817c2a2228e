"""Writers (K1, K4-K7): declared layouts, no overwrite by accident, one manifest per run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import audit


def write_run(tables: dict[str, DataFrame], root: str) -> DataFrame:
    """K1, K6, V1: one folder per table; refuses an existing target. The manifest is taken from what was written."""
    spark = next(iter(tables.values())).sparkSession
    for name, df in tables.items():
        df.write.mode("errorifexists").parquet(f"{root}/{name}")
    saved = {n: spark.read.schema(df.schema).parquet(f"{root}/{n}") for n, df in tables.items()}
    out = audit.manifest(saved)
    out.write.mode("errorifexists").json(f"{root}/manifest")
    return spark.read.schema(out.schema).json(f"{root}/manifest")


def replace_runs(df: DataFrame, path: str, run: str = "run_id") -> None:
    """K4: rows of the runs present in `df` replace those runs, other runs stay (dynamic partition overwrite)."""
    df.write.partitionBy(run).option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(path)


def upsert(current: DataFrame, changes: DataFrame, keys: list[str], order: str) -> DataFrame:
    """K4: latest row per key after merging changes; partial aggregation keeps one candidate per task."""
    u = current.unionByName(changes)
    rest = [c for c in u.columns if c not in keys]
    return u.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(order)).alias("r")).select(*keys, "r.*")


def write_nested(companies: DataFrame, path: str) -> None:
    """K5: one JSON object per company, written in parallel."""
    companies.write.mode("errorifexists").json(path)


def write_transcripts(results: DataFrame, root: str) -> None:
    """K7: completed and failed rows of a batch, partitioned by status; each batch appends."""
    results.write.mode("append").partitionBy("status").parquet(root)


def read_transcripts(spark: SparkSession, root: str, status: str) -> DataFrame:
    return spark.read.parquet(root).where(F.col("status") == status)
