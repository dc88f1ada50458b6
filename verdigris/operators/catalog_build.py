"""The catalog of plans, modules and courses out of the rows of scanned tables.

Rows come as a stream in each file's order. A page's heading sets the programme and
clears the module; a row's heading sets the module; a row with a rule, a total or a
course belongs to both as they then stand. Rows before the first of either belong nowhere.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .catalog import fill_down
from .headings import clean, direction_major
from .store import REQUIRED
from .table_rows import constraint_rules, course_of_row, total_credits

# What a row of a module's heading and of its least credits says.
MODULE_HEADING = r"^(?:[一二三四五六七八九十]+、|[（(][一二三四五六七八九十]+[）)]|方向[一二三四五六七八九十]+[：:]).*(?:模块|板块|课程|实践环节|课)"
LEAST_CREDITS = r"(?:不低于|至少(?:修读|修满|选修)?|必须修满|需要修满|修读不低于|选修不低于)\s*(\d+(?:\.\d+)?)\s*(?:个)?学分"
CATALOG_VERSION = "1.0"


def classified(rows: DataFrame, cells: str = "cells") -> DataFrame:
    """rows with kind (heading, rule, total or course, the first that holds; null for none), course, heading, least, total and line."""
    cleaned = F.transform(F.col(cells), lambda c: clean(F.coalesce(c, F.lit(""))))
    first = F.coalesce(F.get(F.filter(cleaned, lambda c: c != ""), F.lit(0)), F.lit(""))
    line = F.array_join(cleaned, " | ")
    least = F.regexp_extract(line, LEAST_CREDITS, 1).try_cast("double")
    a = rows.withColumns({"course": course_of_row(F.col(cells)), "heading": first, "line": line, "least": least, "total": total_credits(F.col(cells))})
    kind = F.when(F.col("course").isNotNull(), "course").when(F.col("heading").rlike(MODULE_HEADING), "heading").when(F.col("least").isNotNull(), "rule").when(F.col("total").isNotNull(), "total")
    return a.withColumn("kind", kind)


def scoped_rows(rows: DataFrame, labels: DataFrame, file: str = "file") -> DataFrame:
    """Classified rows with the programme and module that hold for them; rows without either are dropped.

    rows: file, page, seq (from 1 within the page), cells and any facts of the file;
    labels: (file, page, label) of the pages with a heading. The direction that a
    module's heading names goes before the page's programme. A file's rows are one window.
    """
    turns = labels.where(F.col("label").isNotNull()).select(file, "page", F.lit(0).alias("seq"), F.col("label").alias("_label"))
    stream = classified(rows).unionByName(turns, allowMissingColumns=True).withColumn("_at", F.struct("page", "seq"))
    module = F.when(F.col("kind") == "heading", F.col("heading"))
    filled = fill_down(stream, [file], "_at", F.col("_label"), module).where(F.col("seq") > 0)
    named = filled.withColumn("major", F.coalesce(direction_major(F.col("module")), "major"))
    return named.where(F.col("kind").isNotNull() & F.col("major").isNotNull() & F.col("module").isNotNull()).drop("_label", "_at")


def courses_of(scoped: DataFrame) -> DataFrame:
    """(college, cohort, major, module, code, name, ..., source_title, file, page): each code once in a module, as it is first listed."""
    first = scoped.where("kind = 'course'").groupBy("cohort", "major", "module", F.col("course.code").alias("_code"))
    kept = first.agg(F.min_by(F.struct("college", "course", "source_title", "file", "page"), F.struct("file", "page", "seq")).alias("_m"))
    return kept.select("_m.college", "cohort", "major", "module", "_m.course.*", "_m.source_title", "_m.file", "_m.page")


def modules_of(scoped: DataFrame, courses: DataFrame) -> DataFrame:
    """One row for each module: what its last rule and total say, its courses' credits (half-even to 2 places), and its constraints.

    A module without a rule whose courses are all required has the listed total as
    its least credits, or else its courses' sum.
    """
    last = lambda kind, value: F.max_by(F.when(F.col("kind") == kind, value), F.when(F.col("kind") == kind, F.struct("file", "page", "seq")))
    key = ["cohort", "major", "module"]
    said = scoped.groupBy(*key).agg(
        last("rule", F.col("least")).alias("said"), F.coalesce(last("rule", F.col("line")), F.lit("")).alias("rule_text"), last("total", F.col("total")).alias("listed_credits"), F.min_by("source_title", F.struct("file", "page", "seq")).alias("source_title")
    )
    sums = courses.groupBy(*key).agg(F.bround(F.sum("credits"), 2).alias("sum"), F.count(F.lit(1)).alias("n"), F.min(F.col("nature").contains(REQUIRED)).alias("must"))
    met = said.join(sums, key, "left").withColumn("catalog_credits", F.coalesce("sum", F.lit(0.0)))
    least = F.coalesce("said", F.when(F.col("must"), F.coalesce(F.nullif(F.col("listed_credits"), F.lit(0.0)), "catalog_credits")))
    met = met.select(*key, "source_title", least.alias("required_credits"), "listed_credits", "rule_text", "catalog_credits", F.coalesce("n", F.lit(0)).cast("bigint").alias("course_count"))
    place = F.concat_ws("\u0001", "cohort", "module")  # a module's rules name its own courses alone
    rules = constraint_rules(
        met.select(F.concat_ws("\u0001", *key).alias("module_id"), place.alias("cohort"), "major", "rule_text"), courses.select(place.alias("cohort"), "major", "code", "name")
    )
    rules = rules.groupBy("module_id").agg(F.array_sort(F.collect_list(F.struct(F.col("kind").alias("type"), F.col("codes").alias("course_codes")))).alias("constraints"))
    none = F.array().cast("array<struct<type:string,course_codes:array<string>>>")
    return met.withColumn("module_id", F.concat_ws("\u0001", *key)).join(rules, "module_id", "left").select(*met.columns, F.coalesce("constraints", none).alias("constraints"))


def plans_of(courses: DataFrame, modules: DataFrame) -> DataFrame:
    """One row for each plan (cohort, major, college): source_title, course_count, and its modules by name. A plan's modules are one row's array, as the document nests them."""
    heads = courses.groupBy("cohort", "major", "college").agg(F.min_by("source_title", F.struct("module", "code")).alias("source_title"))
    counts = courses.groupBy("cohort", "major").agg(F.count(F.lit(1)).alias("course_count"))
    nested = modules.groupBy("cohort", "major").agg(
        F.array_sort(F.collect_list(F.struct(F.col("module").alias("name"), "required_credits", "listed_credits", "rule_text", "source_title", "catalog_credits", "course_count", "constraints"))).alias("modules")
    )
    return heads.join(counts, ["cohort", "major"]).join(nested, ["cohort", "major"]).select("college", "cohort", "major", "source_title", "course_count", "modules")


def build_catalog(rows: DataFrame, labels: DataFrame, keep: Callable[[DataFrame], DataFrame] = lambda df: df) -> tuple[DataFrame, DataFrame]:
    """(plans, courses) of rows (file, college, cohort, source_title, page, seq, cells) and page labels (file, page, label).

    keep is given the tables that several others are made of, such as to write them first.
    """
    scoped = keep(scoped_rows(rows, labels).drop("cells", "heading"))
    courses = keep(courses_of(scoped))
    return plans_of(courses, modules_of(scoped, courses)), courses


def as_json(plans: DataFrame) -> Column:
    """A plan as one JSON document; null fields are written."""
    return F.to_json(F.struct(*plans.columns), {"ignoreNullFields": "false"})
