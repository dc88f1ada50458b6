"""Evaluation: recall, pollution, funnels, score summaries, confusion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def recall_at(results: DataFrame, gold: DataFrame, k: int) -> DataFrame:
    """Share of queries with a gold id among their first k results."""
    hits = results.where(F.col("rank") <= k).join(gold, ["query_id", "doc_id"], "left_semi").select("query_id").distinct().withColumn("_hit", F.lit(1))
    asked = gold.select("query_id").distinct()
    return asked.join(hits, "query_id", "left").agg(F.count(F.lit(1)).alias("queries"), F.sum(F.coalesce("_hit", F.lit(0))).alias("hits"), F.round(F.avg(F.coalesce("_hit", F.lit(0)).cast("double")), 6).alias("recall"))


def recall_of_labels(results: DataFrame, labels: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """recall_at where a query's gold ids are all those of its label: labels (doc_id, label), asked (query_id, label).

    Only results meet the labels; the pairs of equal labels, which grow with the square of the input, aren't formed.
    """
    known = asked.where(F.col("label").isNotNull())
    right = results.where(F.col("rank") <= k).join(labels, "doc_id").join(known, ["query_id", "label"], "left_semi").select("query_id").distinct().withColumn("_hit", F.lit(1))
    held = known.join(labels.select("label").distinct(), "label", "left_semi").select("query_id").distinct()
    return held.join(right, "query_id", "left").agg(F.count(F.lit(1)).alias("queries"), F.sum(F.coalesce("_hit", F.lit(0))).alias("hits"), F.round(F.avg(F.coalesce("_hit", F.lit(0)).cast("double")), 6).alias("recall"))


def pollution(results: DataFrame, in_scope: Column) -> DataFrame:
    return results.groupBy("query_id").agg(F.sum(F.when(in_scope, 0).otherwise(1)).cast("bigint").alias("polluted"), F.count(F.lit(1)).alias("shown"))


def score_summary(rows: DataFrame, score: str, by: list[str]) -> DataFrame:
    return rows.groupBy(*by).agg(F.min(score).alias("low"), F.median(score).alias("middle"), F.max(score).alias("high"))


def funnel(rows: DataFrame, stages: list[tuple[str, Column]], by: list[str]) -> DataFrame:
    """Each row falls into the first stage it fails, or passed."""
    bucket = F.lit("passed")
    for name, ok in reversed(stages):
        bucket = F.when(~ok, name).otherwise(bucket)
    return rows.withColumn("bucket", bucket).groupBy(*by, "bucket").agg(F.count(F.lit(1)).alias("n"))
