"""A training-data pipeline over ``documents``: five stages, each on all that its predecessor kept.

Every stage takes (spark, docs, sf_dir); all but the last return the columns of
``documents``.  ``run`` writes each stage's rows below the shared folder and rereads them,
so a lost executor costs at most the current stage and no lineage grows.

Null texts and texts without letters go at the first stage; rows without an id are judged
like others.  An empty table stays empty.  Repeated rows are copies: one stays; rows that
share an id and differ in text are judged each by itself.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from motionweave.llm import bpe, decontaminate, langid, quality_rules, simhash
from motionweave.llm.common import materialise, table


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a recognised language."""
    return langid.keep(docs, langid.train(docs))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the likelihood ratio."""
    return quality_rules.keep(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return simhash.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap no benchmark item."""
    return decontaminate.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and decoded bytes."""
    return bpe.round_trip(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language),
    ("quality_rules", quality),
    ("simhash_dedup", near_dedup),
    ("decontamination", decontamination),
    ("byte_bpe", tokenise),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


#: The language model, the hashed ratios and the tokenizer are beyond SQL.
ORACLE_SQL = None
