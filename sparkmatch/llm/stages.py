"""Stages of the corpus pipeline: each takes what its predecessor kept and applies one operator to all of it.

All but the last return the columns of their input.  A stage's scores and counts have names of their own while it
runs, so that no column of the documents is replaced.  A null text counts as an empty one, which is judged by its score
like any other, duplicates nothing and holds no item.  Rows with a null doc_id are judged by their texts, repeated
rows alike; an empty table stays empty.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _common as C
from . import bpe, decontam, near_dup, quality, toxicity

BYTE_BPE = "byte_bpe_50k.tiktoken"


def _columns(docs: DataFrame) -> list:
    return [F.col(f"`{c}`") for c in docs.columns]


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    model = quality.train(docs, C.table(spark, sf_dir, "labels", "doc_id", "quality"))
    return quality.score(docs, model, prefix="__quality_").where("__quality_predicted = 1").select(*_columns(docs))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier marks go."""
    machine = toxicity.train(docs, C.table(spark, sf_dir, "labels", "doc_id", "toxic"))
    return toxicity.score(docs, machine, prefix="__toxic_").where("__toxic_predicted = 0").select(*_columns(docs))


def drop_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates stays, one of the least doc_id; so of repeated rows one stays."""
    return near_dup.keep_one(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    flagged = decontam.flag(docs, C.table(spark, sf_dir, "benchmark", "item_id", "text"), out="__n_items")
    return flagged.where("__n_items = 0").select(*_columns(docs))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds n_tokens, the number of byte-level BPE tokens, ids_sha256, a digest of the ids, and decoded_sha256, one of the
    bytes that they decode to.  Columns of the documents with one of these names are replaced.
    """
    return bpe.digest(docs, public_tokenizers.path(BYTE_BPE), public_tokenizers.PATTERN)


STAGES = [("quality", keep_good), ("toxicity", drop_toxic), ("near_duplicates", drop_duplicates), ("decontamination", drop_leaks), ("byte_bpe", encode)]
