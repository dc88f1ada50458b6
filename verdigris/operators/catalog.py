"""Catalog facts: forward fill, roll-ups, modes, overlays, repairs, coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import REQUIRED


def fill_down(rows: DataFrame, by: list[str], seq: str, outer: Column, inner: Column, out: tuple[str, str] = ("major", "module")) -> DataFrame:
    """Carries the last outer and inner heading down; a change of the outer one clears the inner one."""
    start = Window.partitionBy(*by).orderBy(seq).rowsBetween(Window.unboundedPreceding, 0)
    a = rows.withColumn("_o", outer).withColumn("_i", inner)
    a = a.withColumn(out[0], F.last("_o", ignorenulls=True).over(start))
    a = a.withColumn("_g", F.sum(F.when(F.col("_o").isNotNull() & ~F.col("_o").eqNullSafe(F.lag(out[0]).over(Window.partitionBy(*by).orderBy(seq))), 1).otherwise(0)).over(start))
    inside = Window.partitionBy(*by, "_g").orderBy(seq).rowsBetween(Window.unboundedPreceding, 0)
    return a.withColumn(out[1], F.last("_i", ignorenulls=True).over(inside)).drop("_o", "_i", "_g")


def module_rollup(courses: DataFrame, by: list[str]) -> DataFrame:
    """Credits (half-even to 2 places), courses, and the minimum that follows where every course is required."""
    total = F.bround(F.sum(F.coalesce("credits", F.lit(0.0))), 2)
    must = F.min(F.coalesce(F.col("course_nature").contains(REQUIRED), F.lit(False)))
    return courses.groupBy(*by).agg(total.alias("catalog_credits"), F.count(F.lit(1)).alias("course_count"), F.when(must, total).alias("required_credits"))


def mode_of(rows: DataFrame, by: list[str], value: str, seq: str, out: str) -> DataFrame:
    """The most frequent value, ties by first appearance. Counts are partial before they are ranked."""
    counted = rows.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("_n"), F.min(seq).alias("_s"))
    best = counted.groupBy(*by).agg(F.max_by(value, F.struct("_n", (-F.col("_s")).alias("s"))).alias(out))
    return best


def weighted_mode(rows: DataFrame, by: list[str], value: str, weight: Column, out: str) -> DataFrame:
    """The value of greatest total weight, then most rows, then longest, then greatest."""
    counted = rows.groupBy(*by, value).agg(F.sum(weight).alias("_w"), F.count(F.lit(1)).alias("_n"))
    key = F.struct("_w", "_n", F.char_length(value).alias("l"), F.col(value).alias("v"))
    return counted.groupBy(*by).agg(F.max(key).alias("_m")).select(*by, F.col("_m.v").alias(out), F.col("_m._w").alias("weight"))


def overlay(base: DataFrame, verified: DataFrame, keys: list[str], field: str) -> DataFrame:
    """The verified value where there is one; changed tells whether it differs."""
    over = verified.select(*keys, F.col(field).alias("_v"), F.lit(True).alias("_hit"))
    out = base.join(over, keys, "left")
    new = F.when(F.col("_hit"), F.col("_v")).otherwise(F.col(field))
    return out.select(*[c for c in base.columns if c != field], F.col(field).alias("before"), new.alias(field), (~F.col(field).eqNullSafe(new)).alias("changed"))


def impossible_minima(modules: DataFrame) -> DataFrame:
    """impossible: the minimum is above what the module lists; unknown: there is none; ok otherwise."""
    return modules.withColumn("finding", F.when(F.col("required_credits").isNull(), "unknown").when(F.col("required_credits") > F.col("catalog_credits"), "impossible").otherwise("ok"))


def missing_places(observed: DataFrame, totals: DataFrame, by: list[str], place: str, total: str) -> DataFrame:
    """Places from 1 to the total that no row has."""
    wanted = totals.select(*by, F.explode(F.sequence(F.lit(1), F.col(total).cast("int"))).alias(place)) if total else totals
    return wanted.join(observed.select(*by, place).distinct(), [*by, place], "left_anti")


def duplicate_keys(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def repair_single(rows: DataFrame, extracted: DataFrame, keys: list[str], field: str) -> DataFrame:
    """A null field takes the one distinct extracted value; several are ambiguous and change nothing."""
    found = extracted.where(F.col(field).isNotNull()).groupBy(*keys).agg(F.collect_set(field).alias("_v"))
    out = rows.join(found, keys, "left")
    fixed = F.when(F.col(field).isNull() & (F.size("_v") == 1), F.element_at("_v", 1)).otherwise(F.col(field))
    state = F.when(F.col(field).isNotNull(), "kept").when(F.size("_v") == 1, "repaired").when(F.size("_v") > 1, "ambiguous").otherwise("missing")
    return out.select(*[c for c in rows.columns if c != field], fixed.alias(field), state.alias("state"))


def compare_sets(rows: DataFrame, label: str, value: str, a: str, b: str) -> DataFrame:
    """For each value of either label: common, only_a or only_b."""
    sides = rows.where(F.col(label).isin(a, b)).groupBy(value).agg(F.max((F.col(label) == a).cast("int")).alias("_a"), F.max((F.col(label) == b).cast("int")).alias("_b"))
    return sides.select(value, F.when((F.col("_a") == 1) & (F.col("_b") == 1), "common").when(F.col("_a") == 1, "only_a").otherwise("only_b").alias("side"))


def shortest_evidence(claims: DataFrame, quotes: DataFrame, keys: list[str], text: str, seq: str) -> DataFrame:
    """For each claim the shortest quote with its keys, the first on ties."""
    best = quotes.groupBy(*keys).agg(F.min(F.struct(F.char_length(text).alias("n"), F.col(seq).alias("s"))).alias("_m"))
    return claims.join(best, keys, "left").select(*claims.columns, F.col("_m.s").alias("evidence"), F.col("_m.n").alias("evidence_chars"))


def clear_minima(modules: DataFrame, unsafe: Column) -> DataFrame:
    """A minimum that can't be trusted becomes unknown."""
    return modules.withColumn("cleared", unsafe).withColumn("required_credits", F.when(~F.col("cleared"), F.col("required_credits")))
