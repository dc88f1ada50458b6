"""Rendered answers: tables, numbers, citations, clauses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def number_text(value: Column) -> Column:
    """Six significant digits at most, without trailing zeros."""
    text = F.format_string("%.6f", value.cast("double"))
    return F.when(value.isNull(), "").otherwise(F.regexp_replace(F.regexp_replace(text, r"(\.\d*?)0+$", "$1"), r"\.$", ""))


def markdown_row(cells: list[Column]) -> Column:
    escaped = [F.replace(F.replace(F.coalesce(c.cast("string"), F.lit("")), F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" ")) for c in cells]
    return F.concat(F.lit("| "), F.concat_ws(" | ", *escaped), F.lit(" |"))


def markdown_table(rows: DataFrame, by: list[str], cells: dict[str, Column], order: list[str], most: int = 200) -> DataFrame:
    """One table for each group of at most most rows, in order; a longer group says how many more there are."""
    head = "| " + " | ".join(cells) + " |\n|" + "---|" * len(cells)
    window = Window.partitionBy(*by).orderBy(*order)
    lines = rows.select(*by, F.row_number().over(window).alias("_n"), F.count(F.lit(1)).over(Window.partitionBy(*by)).alias("_all"), markdown_row(list(cells.values())).alias("_line")).where(F.col("_n") <= most)
    listed = lines.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("_n", "_line"))).alias("_l"), F.max("_all").alias("_all"))
    body = F.array_join(F.transform("_l", lambda x: x["_line"]), "\n")
    more = F.when(F.col("_all") > most, F.format_string("\n(%d more)", F.col("_all") - most)).otherwise("")
    return listed.select(*by, F.concat(F.lit(head + "\n"), body, more).alias("table"))


def citation_format(answer: Column) -> Column:
    """Full-width and spaced markers in one form: [E1]."""
    return F.regexp_replace(F.regexp_replace(answer, r"[【\[［]\s*[Ee]\s*(\d+)\s*[】\]］]", "[E$1]"), r"(\[E\d+\])(?:\s*\1)+", "$1")


def source_appendix(citations: DataFrame, by: list[str]) -> DataFrame:
    """The cited sources of each answer as numbered lines."""
    line = F.format_string("[%d] %s %s", "number", "doc_title", "page_url")
    return citations.groupBy(*by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("number", line.alias("line")))), lambda x: x["line"]), "\n").alias("appendix"))


def best_clause(clauses: DataFrame, by: list[str], score: str, text: str) -> DataFrame:
    """The clause of greatest score, the shortest of equals."""
    return clauses.groupBy(*by).agg(F.max_by(text, F.struct(F.col(score), -F.char_length(text), text)).alias("clause"))
