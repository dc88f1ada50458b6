"""Evidence checks: citations, sentence support, binding to sources, numbers that follow from facts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import token_set
from ..shipping import ship

MIN_OVERLAP, MIN_COVERAGE = 2, 0.16
DENSE_THRESHOLD = 0.35
NUMBERS = r"(\d+(?:\.\d+)?)"


def renumber_citations(marks: DataFrame, by: list[str], marker: str, seq: str) -> DataFrame:
    """Markers numbered from 1 by first appearance, without gaps; unused ones don't appear."""
    first = marks.groupBy(*by, marker).agg(F.min(seq).alias("_s"))
    return first.select(*by, marker, F.row_number().over(Window.partitionBy(*by).orderBy("_s", marker)).alias("number"))


def sentence_support(sentences: DataFrame, evidence: DataFrame, key: str, sentence: str, text: str) -> DataFrame:
    """overlap, coverage, and grounded: two shared tokens at least, a share of 0.16, and every number in the evidence."""
    met = sentences.join(evidence.select(key, F.col(text).alias("_e")), key, "left")
    a, b = token_set(F.col(sentence)), token_set(F.coalesce("_e", F.lit("")))
    shared = F.size(F.array_intersect(a, b))
    numbers = F.array_distinct(F.regexp_extract_all(F.col(sentence), F.lit(NUMBERS), F.lit(1)))
    found = F.regexp_extract_all(F.coalesce("_e", F.lit("")), F.lit(NUMBERS), F.lit(1))
    coverage = F.when(F.size(a) > 0, shared / F.size(a)).otherwise(0.0)
    grounded = (shared >= MIN_OVERLAP) & (coverage >= MIN_COVERAGE) & (F.size(F.array_except(numbers, found)) == 0)
    return met.select(*sentences.columns, shared.cast("bigint").alias("overlap"), F.round(coverage, 6).alias("coverage"), grounded.alias("grounded"))


def binding_violation(quote: Column, text: Column, place: Column, expected: Column) -> Column:
    """The first rule that a citation breaks, or null: its chunk is known, its place fits, its quote stands in the text, it holds no URL."""
    return (
        F.when(text.isNull(), "unknown_chunk")
        .when(place != expected, "position")
        .when(F.instr(text, quote) == 0, "quote")
        .when(quote.rlike(r"https?://"), "url")
    )


def _reachable(counts: list[tuple[int, int]]) -> np.ndarray:
    """Ascending sums of subsets of the values, given as (value, times): bit s of a number for each sum s over the least."""
    least, bits = sum(x * n for x, n in counts if x < 0), 1
    for x, n in counts:
        times = 1
        while n:
            step = min(times, n)
            bits |= bits << abs(x) * step
            n, times = n - step, times * 2
    held = np.frombuffer(bits.to_bytes(bits.bit_length() // 8 + 1, "little"), np.uint8)
    return np.flatnonzero(np.unpackbits(held, bitorder="little")) + least


def subset_sums(values: DataFrame, by: list[str], value: str, unit: int = 2) -> DataFrame:
    """All sums of subsets of the values, as one array of units (value * unit, to the nearest) for each group.

    The default unit is halves; the reference's closure is over tenths. Nulls don't
    count. The state is one bit for each unit of the group's own total.
    """
    ship(values.sparkSession)
    each = values.groupBy(*by, F.bround(F.col(value) * unit).cast("bigint").alias("_x")).agg(F.count(F.lit(1)).alias("_n"))
    counts = each.groupBy(*by).agg(F.collect_list(F.when(F.col("_x").isNotNull(), F.struct("_x", "_n"))).alias("_v"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, v in enumerate(batch.column("_v").to_pylist()):
                sums = pa.array([_reachable([(x["_x"], x["_n"]) for x in v])], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(i, 1) for c in by), sums], [*by, "sums"])

    shape = type(counts.schema)([counts.schema[c] for c in by]).add("sums", T.ArrayType(T.LongType()))
    return counts.mapInArrow(run, shape)


def evidence_gate(ranked: DataFrame, by: str, score: str, covered: Column) -> DataFrame:
    """Enough evidence: the best dense score reaches the threshold and every required entity is covered."""
    return ranked.groupBy(by).agg(F.max(score).alias("best"), F.max(covered.cast("int")).alias("_c")).select(by, "best", ((F.col("best") >= DENSE_THRESHOLD) & (F.col("_c") == 1)).alias("sufficient"))
