"""Scanned tables: course facts of a row, rules named in text, normalised text."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.terms import UNMARKED
from ..functions.text import bound, clean_course_name, compact_listed

# How a row shows its code, nature, semester and department, and which names are headings; what a rule says.
CODE = r"[A-Z]{3}\d{3}[A-Z]?"
NATURE = r"必修|限选|选修"
SEMESTER = r"^(?:[1-8](?:[-—–~,，][1-8])*|S[1-3])$"
NUMBER = r"^\d+(?:\.\d+)?$"
NAME_HEADING = "课程名称"
DEPARTMENT, DEPARTMENT_HEADING = "学院", "开课学院"
MOST_CREDITS = 30
ALL_OF = r"必须选修"
ANY_OF = r"至少选修(?:其中)?一门"
COURSE_WORD = "课程"
SENTENCE_END = r"[。；;]"
TITLE = r"《([^》]+)》"


def course_of_row(cells: Column) -> Column:
    """A struct of the row's course, or null: a code cell, the name right of it, numbers up to the nature cell, the last semester cell.

    Columns alone. The first number is the credits and must lie in (0, 30].
    """
    clean = F.transform(cells, lambda c: F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " ")))

    def first(row: Column, test: Callable[[Column], Column]) -> Column:
        return F.array_position(F.transform(row, lambda c: F.coalesce(test(c), F.lit(False))), True).cast("int")

    # only a row with both cells is looked at further
    return bound(
        clean,
        lambda row: bound(
            F.struct(first(row, lambda c: F.upper(c).rlike(CODE)).alias("code"), first(row, lambda c: c.rlike(NATURE)).alias("nature")),
            lambda at: F.when((at["code"] > 0) & (at["nature"] > 0), _course(row, at["code"], at["nature"])),
        ),
    )


def _course(row: Column, code_at: Column, nature_at: Column) -> Column:
    """The course of a row of clean cells whose code and nature stand at these places; null if its name or credits are none."""
    compact = lambda c: F.replace(c, F.lit(" "), F.lit(""))
    between = F.when(nature_at > code_at + 2, F.slice(row, code_at + 2, nature_at - code_at - 2)).otherwise(F.array().cast("array<string>"))
    numbers = F.filter(F.transform(F.transform(between, compact), lambda c: F.when(c.rlike(NUMBER), c.try_cast("double"))), lambda x: x.isNotNull())
    marks = F.filter(F.transform(row, lambda c: F.upper(compact(c))), lambda c: c.rlike(SEMESTER))
    departments = F.filter(row, lambda c: c.contains(DEPARTMENT) & ~c.contains(DEPARTMENT_HEADING))
    fields = ("credits", "weekly_hours", "total_hours", "teaching_hours", "practice_hours")
    found = F.struct(clean_course_name(F.get(row, code_at)).alias("name"), numbers.alias("numbers"))

    def course(x: Column) -> Column:
        good = (x["name"] != "") & ~x["name"].contains(NAME_HEADING) & F.get(x["numbers"], F.lit(0)).between(1e-9, MOST_CREDITS)
        kept = F.struct(
            F.regexp_extract(F.upper(F.get(row, code_at - 1)), f"({CODE})", 1).alias("code"),
            x["name"].alias("name"),
            *[F.get(x["numbers"], F.lit(i)).alias(f) for i, f in enumerate(fields)],
            F.get(row, nature_at - 1).alias("nature"),
            bound(marks, lambda m: F.when(F.size(m) > 0, F.element_at(m, -1)).otherwise(UNMARKED)).alias("semester"),
            F.coalesce(F.get(departments, F.lit(0)), F.lit("")).alias("department"),
        )
        return F.when(good, kept)

    return bound(found, course)


def total_credits(cells: Column, mark: str = "合计") -> Column:
    """The first number of a row that a cell marks as a total."""
    numbers = F.filter(F.transform(cells, lambda c: F.when(F.trim(c).rlike(NUMBER), F.trim(c).try_cast("double"))), lambda x: x.isNotNull())
    return F.when(F.exists(cells, lambda c: F.coalesce(c.contains(mark), F.lit(False))), F.get(numbers, F.lit(0)))


def constraint_rules(modules: DataFrame, courses: DataFrame) -> DataFrame:
    """(module_id, kind, codes) of rules that name courses in the major's own sentence. modules: module_id, cohort, major, rule_text; courses: cohort, major, code, name."""
    own = F.regexp_replace("major", "专业$", "")
    parts = modules.select("module_id", "cohort", "major", F.posexplode(F.split("rule_text", SENTENCE_END)).alias("at", "part")).where((own != "") & (F.instr(F.col("part"), own) > 0))
    first = parts.groupBy("module_id", "cohort", "major").agg(F.min_by("part", "at").alias("part"))
    kind = F.when(F.col("part").rlike(ALL_OF), "all_of").when(F.col("part").rlike(ANY_OF), "any_of")
    short = lambda c: compact_listed(F.replace(c, F.lit(COURSE_WORD), F.lit("")))
    named = first.withColumn("kind", kind).where(F.col("kind").isNotNull()).withColumn("title", F.explode(F.regexp_extract_all("part", F.lit(TITLE), F.lit(1)))).withColumn("_t", short(F.col("title")))
    met = named.join(courses.select("cohort", "major", "code", short(F.col("name")).alias("_n")), ["cohort", "major"]).where((F.instr("_n", F.col("_t")) > 0) | (F.instr(F.col("_t"), F.col("_n")) > 0))
    return met.groupBy("module_id", "kind").agg(F.array_sort(F.collect_set("code")).alias("codes"))


def composed(rows: DataFrame, text: str) -> DataFrame:
    """rows with the text in Unicode's NFKC, which Spark has no function for: one call in Arrow batches. Null stays null."""
    from ..shipping import ship

    ship(rows.sparkSession)
    at = rows.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.set_column(at, text, pa.array([x and unicodedata.normalize("NFKC", x) for x in batch.column(at).to_pylist()], pa.string()))

    return rows.mapInArrow(run, rows.schema)


#: Fixed values, in order: what a scanned text's normal form replaces, and by what.
NORMAL_FORM = (
    ("⻚", "页"),
    ("\\x00", ""),
    ("\\r\\n|[\\r\\x0B\\f\\x1C-\\x1E\\x85\\u2028\\u2029]", "\n"),
    ("(?<=[㐀-鿿])[ \\t　]+(?=[㐀-鿿])", ""),
    ("[ \\t　]+", " "),
    ("(?md)^[\\s&&[^\\n]]+|[\\s&&[^\\n]]+$", ""),
    ("\\n{3,}", "\n\n"),
    ("^\\s+|\\s+$", ""),
)


def normalised(rows: DataFrame, text: str) -> DataFrame:
    """rows with the text composed, then each replacement of NORMAL_FORM in turn."""
    column = F.col(text)
    for pattern, by in NORMAL_FORM:
        column = F.regexp_replace(column, pattern, by)
    return composed(rows, text).withColumn(text, column)
