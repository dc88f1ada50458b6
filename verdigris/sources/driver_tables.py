"""Domain frames over the driver's tables: sources, chunks, offerings, turns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each documents.source; its other facts follow from its number by fixed rules."""
    n = F.coalesce(F.regexp_extract("source", r"(\d+)$", 1).try_cast("int"), F.lit(0))
    base = load(spark, sf_dir, "documents").select("source").distinct().withColumn("n", n)
    return base.select(
        "source",
        "n",
        (F.col("n") % 7 != 3).alias("trusted"),
        (F.col("n") % 11 != 5).alias("enabled"),
        F.when(F.col("n") % 4 == 1, "历史").otherwise("现行").alias("status"),
        F.when(F.col("n") % 5 == 0, "校级").otherwise("院级").alias("level"),
        F.when(F.col("n") % 5 == 0, "全校").otherwise(F.col("source")).alias("college"),
        F.when(F.col("n") % 3 == 0, "不限").when(F.col("n") % 3 == 1, "2023").otherwise("2024").alias("cohort"),
        (2018 + F.col("n") % 6).cast("bigint").alias("year"),
        F.when(F.col("n") % 4 == 0, "curriculum").when(F.col("n") % 4 == 1, "promotion").otherwise("school_policy").alias("topic"),
    )


#: The same in SQL, as the head of an oracle.
SOURCES_SQL = """
WITH base AS (
  SELECT DISTINCT source, coalesce(TRY_CAST(regexp_extract(source, '(\\d+)$', 1) AS INTEGER), 0) AS n FROM documents
), sources AS (
  SELECT source, n, n % 7 <> 3 AS trusted, n % 11 <> 5 AS enabled,
         CASE WHEN n % 4 = 1 THEN '历史' ELSE '现行' END AS status,
         CASE WHEN n % 5 = 0 THEN '校级' ELSE '院级' END AS level,
         CASE WHEN n % 5 = 0 THEN '全校' ELSE source END AS college,
         CASE n % 3 WHEN 0 THEN '不限' WHEN 1 THEN '2023' ELSE '2024' END AS cohort,
         (2018 + n % 6)::BIGINT AS year,
         CASE n % 4 WHEN 0 THEN 'curriculum' WHEN 1 THEN 'promotion' ELSE 'school_policy' END AS topic
  FROM base
)"""


def semester_cell() -> F.Column:
    size = F.col("p_size") % 12
    return F.when(size < 8, (size + 1).cast("string")).when(size == 8, "1-2").when(size == 9, "S1").when(size == 10, "3—6")


SEMESTER_SQL = "CASE WHEN p_size % 12 < 8 THEN (p_size % 12 + 1)::VARCHAR WHEN p_size % 12 = 8 THEN '1-2' WHEN p_size % 12 = 9 THEN 'S1' WHEN p_size % 12 = 10 THEN '3—6' END"
#: Distinct semesters and last place in time of a cell, for oracles.
FIRST_SQL = "CASE WHEN p_size % 12 < 8 THEN p_size % 12 + 1 WHEN p_size % 12 = 8 THEN 1 WHEN p_size % 12 = 9 THEN 2.5 WHEN p_size % 12 = 10 THEN 3 END"
LAST_SQL = "CASE WHEN p_size % 12 < 8 THEN p_size % 12 + 1 WHEN p_size % 12 = 8 THEN 2 WHEN p_size % 12 = 9 THEN 2.5 WHEN p_size % 12 = 10 THEN 6 END"


def courses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """part as courses: code, name, module, semester cell."""
    return load(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("course_code"),
        F.col("p_name").alias("course_name"),
        F.col("p_type").alias("module"),
        F.col("p_brand").alias("major"),
        semester_cell().alias("semester"),
        F.col("p_size").cast("double").alias("credits"),
        "p_size",
    )


def offerings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem with part: an offering of a course."""
    part = courses(spark, sf_dir).drop("credits", "major")
    line = load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("course_code"), "l_suppkey", F.col("l_quantity").alias("credits"), "l_returnflag")
    nature = F.when(F.col("l_returnflag") == "R", "必修").when(F.col("l_returnflag") == "A", "选修").otherwise("自由选修")
    return line.join(part, "course_code").withColumn("course_nature", nature)


OFFERINGS_SQL = f"""
WITH offerings AS (
  SELECT l_orderkey, l_linenumber, l_partkey AS course_code, l_suppkey, l_quantity AS credits, p_name AS course_name, p_type AS module, p_size,
         {SEMESTER_SQL} AS semester,
         CASE l_returnflag WHEN 'R' THEN '必修' WHEN 'A' THEN '选修' ELSE '自由选修' END AS course_nature,
         {FIRST_SQL} AS first_place, {LAST_SQL} AS last_place
  FROM lineitem JOIN part ON l_partkey = p_partkey
)"""


def values(spark: SparkSession, schema: str, rows: list[tuple]) -> DataFrame:
    """A small literal frame, without a Python worker."""
    names = [c.split()[0] for c in schema.split(",")]
    kinds = [c.split()[1] for c in schema.split(",")]
    structs = F.array(*[F.struct(*[F.lit(v).cast(k).alias(n) for v, k, n in zip(r, kinds, names, strict=True)]) for r in rows])
    return spark.range(1).select(F.inline(structs))
