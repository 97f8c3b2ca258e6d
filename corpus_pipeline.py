"""The corpus pipeline: stages over ``documents``, each one of the training-data operators."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sparkmatch.llm import _common as C
from sparkmatch.llm import stages

STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = stages.STAGES

#: No stage can be expressed in SQL; the tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to ``documents``; each result is written as Parquet to the shared folder and read again.

    A stage's table is deleted once the next one's is written; only the last stays.
    """
    docs, before = C.table(spark, sf_dir, "documents"), None
    base = f"{C.scratch_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for i, (name, stage) in enumerate(STAGES):
        out = f"{base}/{i}-{name}"
        stage(spark, docs, sf_dir).write.parquet(out)
        docs = spark.read.parquet(out)
        if before:
            C.remove(spark, before)
        before = out
    return docs
