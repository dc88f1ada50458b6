"""The semester domain: cells such as 3, 1-2, S2, or none."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import text_of

# Labels of summer terms and of a missing cell; how cells spell summer terms, ranges and single semesters.
SUMMER_LABEL = "暑期学期"
UNMARKED = "未标注"
SUMMER = r"^S([1-3])$"
DASHES = r"(?<=\d)\s*[—–~～至]\s*(?=\d)"
RANGE = r"[1-8]\s*-\s*[1-8]"
SINGLE = r"(?<!\d)([1-8])(?!\d)"


def _cell(value: Column) -> Column:
    return F.upper(F.trim(text_of(value)))


def semester_values(value: Column) -> Column:
    """Distinct semesters 1 to 8 of the cell, ascending, ranges filled; none for summer terms."""
    cell = F.regexp_replace(_cell(value), DASHES, "-")
    ranges = F.regexp_extract_all(cell, F.lit(f"({RANGE})"), F.lit(1))

    def filled(r: Column) -> Column:
        ends = F.transform(F.split(F.regexp_replace(r, r"\s", ""), "-"), lambda x: x.cast("int"))
        return F.sequence(F.array_min(ends), F.array_max(ends))

    single = F.transform(F.regexp_extract_all(F.regexp_replace(cell, RANGE, " "), F.lit(SINGLE), F.lit(1)), lambda x: x.cast("int"))
    every = F.array_sort(F.array_distinct(F.concat(F.flatten(F.transform(ranges, filled)), single)))
    return F.when(cell.rlike(SUMMER), F.array().cast("array<int>")).otherwise(every)


def semester_positions(value: Column) -> Column:
    """Places in time; summer term n follows semester 2n."""
    cell = _cell(value)
    summer = F.array(F.regexp_extract(cell, SUMMER, 1).try_cast("double") * 2 + 0.5)
    return F.when(cell.rlike(SUMMER), summer).otherwise(F.transform(semester_values(value), lambda x: x.cast("double")))


def semester_display(value: Column) -> Column:
    cell = _cell(value)
    return F.when(cell.rlike(SUMMER), F.concat(F.lit(SUMMER_LABEL), F.substring(cell, 2, 1))).when(cell == "", UNMARKED).otherwise(cell)


def semester_sort_key(value: Column) -> Column:
    """The audit's order: the leading digit, summer term n as 2n, else 99."""
    cell = _cell(value)
    return (
        F.when(cell.rlike(r"^S[1-3]"), F.substring(cell, 2, 1).try_cast("int") * 2)
        .when(cell.rlike(r"^\d"), F.substring(cell, 1, 1).try_cast("int"))
        .otherwise(99)
    )


def leading_semester(value: Column) -> Column:
    """The listing order: the first character as a number, 0 if it is none, null for null."""
    return F.when(value.isNotNull(), F.coalesce(F.substring(value, 1, 1).try_cast("int"), F.lit(0)))
