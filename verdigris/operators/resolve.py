"""Entity resolution: aliases, program names, completed courses."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import compact_strict, clean_course_name

#: Alias tables beyond this are not broadcast.
BROADCAST_ALIASES = 50_000


def _small(frame: DataFrame, limit: int = BROADCAST_ALIASES) -> DataFrame:
    """The frame with a broadcast hint where a count proves it small."""
    return F.broadcast(frame) if frame.limit(limit + 1).count() <= limit else frame


def longest_alias(texts: DataFrame, aliases: DataFrame, id_col: str, text: str, plans: DataFrame | None = None) -> DataFrame:
    """(id_col, alias, canonical): for each text the longest alias in it whose canonical name has a plan.

    texts join distinct values of their text first, so repeated texts are matched once.
    """
    known = aliases.select("alias", "canonical")
    if plans is not None:
        known = known.join(plans.select("canonical").distinct(), "canonical", "left_semi")
    values = texts.select(F.col(text).alias("_v")).distinct()
    met = values.join(_small(known), F.instr(compact_strict(F.col("_v")), compact_strict(F.col("alias"))) > 0)
    best = met.groupBy("_v").agg(F.max(F.struct(F.char_length("alias").alias("n"), "alias", "canonical")).alias("m"))
    return texts.join(best, texts[text] == best["_v"]).select(id_col, "m.alias", "m.canonical")


def program_status(wanted: DataFrame, programs: DataFrame) -> DataFrame:
    """(want_id, status, canonical): exact compact name, else the one program that contains it or lies in it, else ambiguous or uncovered.

    A null or blank wish is missing. programs is a list of names, bounded like aliases.
    """
    w = wanted.withColumn("_w", compact_strict(F.col("wanted")))
    p = _small(programs.select("program").distinct().withColumn("_p", compact_strict(F.col("program"))))
    met = w.where("_w <> ''").join(p, (F.instr(F.col("_p"), F.col("_w")) > 0) | (F.instr(F.col("_w"), F.col("_p")) > 0))
    found = met.groupBy("want_id").agg(
        F.min(F.when(F.col("_p") == F.col("_w"), F.col("program"))).alias("exact"),
        F.count(F.lit(1)).alias("n"),
        F.min("program").alias("one"),
    )
    out = w.join(found, "want_id", "left")
    status = F.when(F.col("_w") == "", "missing").when(F.col("exact").isNotNull(), "exact").when(F.col("n") == 1, "contained").when(F.col("n") > 1, "ambiguous").otherwise("uncovered")
    return out.select("want_id", status.alias("status"), F.coalesce("exact", F.when(F.col("n") == 1, F.col("one"))).alias("canonical"))


def match_completed(completed: DataFrame, courses: DataFrame) -> DataFrame:
    """(done_id, course_code, course_name, tier): for each input every course of its best tier.

    Tier 1: the code or the compact name is equal; tier 2: one name contains the
    other. An input without either has one row with null course and tier.
    """
    c = courses.select("course_code", "course_name").distinct().withColumn("_n", compact_strict(clean_course_name(F.col("course_name")))).withColumn("_c", compact_strict(F.col("course_code")))
    d = completed.withColumn("_d", compact_strict(F.col("done")))
    tier = F.when((F.col("_d") == F.col("_c")) | (F.col("_d") == F.col("_n")), 1).otherwise(2)
    hit = (F.col("_d") == F.col("_c")) | (F.instr(F.col("_n"), F.col("_d")) > 0) | (F.instr(F.col("_d"), F.col("_n")) > 0)
    met = c.join(_small(d.where("_d <> ''")), hit).withColumn("tier", tier)
    best = met.withColumn("_b", F.min("tier").over(Window.partitionBy("done_id"))).where("tier = _b").select("done_id", "course_code", "course_name", "tier")
    rest = completed.join(best.select("done_id").distinct(), "done_id", "left_anti")
    return best.unionByName(rest.select("done_id", F.lit(None).cast(courses.schema["course_code"].dataType).alias("course_code"), F.lit(None).cast("string").alias("course_name"), F.lit(None).cast("int").alias("tier")))


def match_lowest_code(completed: DataFrame, courses: DataFrame) -> DataFrame:
    """(done_id, course_code): the audit's own matcher, one tier and the lowest code."""
    c = courses.select("course_code", "course_name").distinct().withColumn("_n", compact_strict(F.col("course_name"))).withColumn("_c", compact_strict(F.col("course_code")))
    d = _small(completed.withColumn("_d", compact_strict(F.col("done"))).where("_d <> ''"))
    met = c.join(d, (F.col("_d") == F.col("_c")) | (F.instr(F.col("_n"), F.col("_d")) > 0) | (F.instr(F.col("_d"), F.col("_n")) > 0))
    return met.groupBy("done_id").agg(F.min("course_code").alias("course_code"))


def intervals_of(ranges: DataFrame, by: list[str], low: str = "low", high: str = "high") -> DataFrame:
    """Intervals that begin after the greatest end before them (label, start, end), by end order."""
    window = Window.partitionBy(*by).orderBy(high, low, "label").rowsBetween(Window.unboundedPreceding, -1)
    return ranges.withColumn("start", F.coalesce(F.max(high).over(window) + 1, F.col(low))).withColumnRenamed(high, "end")


def label_by_interval(rows: DataFrame, intervals: DataFrame, by: list[str], place: str) -> DataFrame:
    """The label of the one interval that holds the place; rows in none or in several have none. Repeated rows stay."""
    met = rows.select(*by, place).distinct().join(intervals.select(*by, "start", "end", "label"), by).where(F.col(place).between(F.col("start"), F.col("end")))
    one = met.groupBy(*by, place).agg(F.count(F.lit(1)).alias("_n"), F.min("label").alias("label")).where("_n = 1").drop("_n")
    return rows.join(one, [*by, place]).select(*rows.columns, "label")
