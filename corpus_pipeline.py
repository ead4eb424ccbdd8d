"""The corpus pipeline: toxic documents go, one of each group of near copies stays, repeated passages are cut, documents
that hold benchmark passages go, and what is left is packed into windows. Each stage works on all that the one before kept.

How nulls, empty and very long texts, ties, repeated rows, empty tables and further columns are handled: see
veilspark.llm.stages. Each stage's table is written to the shared folder and goes when the next one is written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from veilspark.llm._common import dropped, saved
from veilspark.llm.stages import STAGES as STAGES

#: A trained classifier and a tokenizer are part of it, which SQL can't express; tests/llm holds each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for name, stage in STAGES:
        docs = saved(stage(spark, docs, sf_dir), name)
        if before is not None:
            dropped(before)
        before = docs
    return docs
