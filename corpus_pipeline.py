"""The corpus pipeline: quality rules, line dedup, near-duplicate dedup, repeated passages, packing.

STAGES lists (name, function); a function takes (spark, docs, sf_dir) and returns a
frame that is written as Parquet and read again as the next one's docs. All but
the last return the columns of documents, with n_chars of the text as it then is.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdigris.llm.common import Scope, table, written
from verdigris.llm.line_dedup import dedup_lines
from verdigris.llm.near_dedup import near_classes
from verdigris.llm.packing import pack_documents
from verdigris.llm.quality import filter_quality
from verdigris.llm.suffix_dedup import dedup_substrings


_scope = Scope()


def _stage(f):
    """A stage whose intermediate tables go as soon as the next stage begins: its own result is written by then."""

    @functools.wraps(f)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        with _scope.begin():
            return f(spark, docs, sf_dir)

    return run_stage


def _documents(rows: DataFrame) -> DataFrame:
    return rows.select("doc_id", "text", "lang", "source", F.char_length("text").cast("bigint").alias("n_chars"))


@_stage
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go."""
    return _documents(filter_quality(docs, table(spark, sf_dir, "labels")))


@_stage
def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines found in ten documents or more go from all of them."""
    return _documents(dedup_lines(docs))


@_stage
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates stays, the one of the least id."""
    return _documents(near_classes(docs).where("_kept"))


@_stage
def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each passage of over 50 words, and then of 400 bytes or more, that repeats, the first copy stays."""
    with Scope() as tables:
        rest = _documents(dedup_substrings(docs, min_words=51))
        with _scope:
            rest = written(rest, "pipeline-long-passages")
    tables.begin()
    return _documents(dedup_substrings(rest))


@_stage
def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every token of every document, in sequences of 4,096."""
    return pack_documents(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("near dedup", near_dedup),
    ("suffix dedup", suffix_dedup),
    ("packing", packing),
]

#: Quality cutoffs, weighted samples, suffix order and packing are beyond SQL; see tests/llm.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return docs
