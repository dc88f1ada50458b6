"""Facts that a programme's own header overrides, and what follows from them: minima, the audit, and the citations that are left."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .audit import module_audit

# What a header says, in which order it lists the modules' credits, and how much each sign of the right header counts.
MODULES = ("（一）通识教育基础课", "（二）大学科基础课", "（三）专业必修课", "（四）专业方向课", "（五）通识教育核心课", "自由选修课", "（六）实践环节课")
LEAST_TOTAL = r"毕业最低学分(?:要求)?(?:为|[:：]|.{0,20}?)(\d{2,3}(?:\.\d+)?)\s*学分"
OWN_TOTAL = r"(?:专业)?\s*(\d{2,3}(?:\.\d+)?)\s*学分"
CREDITS_LIST = r"学分\s+((?:\d+(?:\.\d+)?\s+){7}\d+(?:\.\d+)?)"
NUMBER = r"(\d+(?:\.\d+)?)"
OWN, GENERAL, IN_ARTICLE, IN_TEXT = 20, 10, 3, 1


def program_headers(chunks: DataFrame, by: list[str]) -> DataFrame:
    """(by, chunk_id, total, module_credits) of the best header of each plan; plans without one have no row.

    chunks: by, stem (the programme's name without its last word), chunk_id, article,
    text, is_table, seq. A number that stands beside the name counts more than the
    first of the page; equal headers go by prose before tables, then by seq.
    module_credits is empty unless the header lists all modules.
    """
    own = F.expr(f"regexp_extract(text, concat('\\\\Q', stem, '\\\\E', '{OWN_TOTAL.replace(chr(92), chr(92) * 2)}'), 1)")
    in_article, in_text = F.contains(F.col("article"), F.col("stem")), F.contains(F.col("text"), F.col("stem"))
    general = F.when(in_article, F.regexp_extract("text", LEAST_TOTAL, 1)).otherwise("")
    a = chunks.withColumns({"_own": own, "_general": general}).withColumn("total", F.when(F.col("_own") != "", F.col("_own")).otherwise(F.col("_general")).try_cast("double"))
    score = F.when(F.col("_own") != "", OWN).otherwise(GENERAL) + F.when(in_article, IN_ARTICLE).otherwise(0) + F.when(in_text, IN_TEXT).otherwise(0)
    numbers = F.transform(F.regexp_extract_all(F.regexp_extract("text", CREDITS_LIST, 1), F.lit(NUMBER), F.lit(1)), lambda x: x.cast("double"))
    credits = F.when(F.size(numbers) >= len(MODULES), F.slice(numbers, 1, len(MODULES))).otherwise(F.array().cast("array<double>"))
    best = a.where("total IS NOT NULL").groupBy(*by).agg(F.min_by(F.struct("chunk_id", "total", credits.alias("module_credits")), F.struct((-score).alias("s"), "is_table", "seq")).alias("_m"))
    return best.select(*by, "_m.*")


def overridden(requirements: DataFrame, headers: DataFrame, by: list[str]) -> DataFrame:
    """requirements (by, module, required_credits, evidence), replaced by the header's modules in the plans whose header lists them."""
    listed = headers.where(F.size("module_credits") > 0)
    fresh = listed.select(*by, F.posexplode("module_credits").alias("at", "required_credits"), F.col("chunk_id").alias("evidence"))
    fresh = fresh.select(*by, F.get(F.array(*map(F.lit, MODULES)), F.col("at")).alias("module"), "required_credits", "evidence")
    return requirements.join(listed.select(*by), by, "left_anti").select(*by, "module", "required_credits", "evidence").unionByName(fresh)


def minimum_facts(facts: DataFrame, headers: DataFrame, by: list[str], field: str = "graduation_min_credits") -> DataFrame:
    """facts (by, field, value, evidence) with the header's total for the field, in the plans with a header."""
    kept = facts.join(headers.select(*by, F.lit(field).alias("field")), [*by, "field"], "left_anti")
    return kept.select(*by, "field", "value", "evidence").unionByName(headers.select(*by, F.lit(field).alias("field"), F.col("total").alias("value"), F.col("chunk_id").alias("evidence")))


def compacted(citations: DataFrame, headers: DataFrame, used: DataFrame, by: list[str]) -> DataFrame:
    """(by, evidence, number): the citations that used (by, evidence) still names, numbered from 1 in their order; a header that wasn't cited comes last.

    citations: by, evidence, seq. Both the old and the overriding evidence are numbered once, together.
    """
    late = F.lit(None).cast(citations.schema["seq"].dataType)
    listed = citations.select(*by, "evidence", "seq").unionByName(headers.select(*by, F.col("chunk_id").alias("evidence"), late.alias("seq")))
    first = listed.groupBy(*by, "evidence").agg(F.min("seq").alias("seq"))
    kept = first.join(used.select(*by, "evidence").distinct(), [*by, "evidence"], "left_semi")
    place = Window.partitionBy(*by).orderBy(F.col("seq").asc_nulls_last(), "evidence")
    return kept.select(*by, "evidence", F.row_number().over(place).alias("number"))


def recomputed(requirements: DataFrame, courses: DataFrame, completed: DataFrame, by: list[str]) -> DataFrame:
    """The audit over requirements as they now are."""
    return module_audit(requirements.select(*by, "module", "required_credits"), courses, completed, by=by)
