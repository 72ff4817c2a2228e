"""The corpus pipeline: five stages over `documents`, each written as Parquet and read again as the next one's input.

Language ID drops documents without a recognised language; exact dedup and the Jaccard join keep one document of each group; mixing repeats or
leaves out documents so that sources come near their target weights; packing cuts what is left into token sequences and returns their pieces.

Defined cases: texts that are null, empty or without letters go in the first stage; rows that repeat a doc_id are told apart by their text in exact
dedup and are one document in the Jaccard join; a null doc_id is kept there; a null source is a source of its own; further columns, also ones named
like those of the operators, stay as they are up to packing; an empty table gives an empty result; very long texts are handled whole.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm.exact_dedup import stage_exact_dedup
from tidemark.llm.jaccard_join import stage_jaccard
from tidemark.llm.language_id import stage_language
from tidemark.llm.packing import stage_pack
from tidemark.llm.source_mix import stage_mix
from tidemark.staging import folder

STAGES = [
    ("language_id", stage_language),
    ("exact_dedup", stage_exact_dedup),
    ("jaccard_join", stage_jaccard),
    ("source_mix", stage_mix),
    ("packing", stage_pack),
]

#: The network of the first stage and the tokenizer of the last have no SQL; tests/llm/test_pipeline_stages.py holds each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    base = f"{folder(spark)}/tidemark/pipeline-{uuid.uuid4().hex}"
    for k, (name, step) in enumerate(STAGES):
        step(spark, docs, sf_dir).write.parquet(f"{base}/{k}-{name}")
        docs = spark.read.parquet(f"{base}/{k}-{name}")
    return docs
