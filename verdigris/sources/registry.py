"""Source registry, chunk and catalog files: strict reads, with what breaks the rules as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import in_domain, text_of
from ..operators.ingest import chunk_errors
from ..operators.store import ALL_COHORTS, COLLEGE, CURRENT, HISTORIC, SCHOOL

# The registry's header, in order, the chunk's fields, and the file kinds that ingest reads.
REGISTRY_FIELDS = ("file", "doc_title", "level", "college", "cohort", "year", "status", "page_url", "file_url", "collected_at")
REGISTRY = T.StructType([T.StructField(c, T.StringType()) for c in REGISTRY_FIELDS])
CHUNK = T.StructType(
    [T.StructField(c, T.StringType()) for c in ("chunk_id", "text", "doc_title", "level", "college", "cohort")]
    + [T.StructField("year", T.IntegerType()), T.StructField("status", T.StringType()), T.StructField("article", T.StringType())]
    + [T.StructField("page_url", T.StringType()), T.StructField("file_url", T.StringType()), T.StructField("is_table", T.BooleanType())]
)
SIGNATURE = ("doc_title", "level", "college", "cohort", "year", "status", "file_url")
KINDS = ("pdf", "docx", "txt", "md")
PRIORITY_EXTRACT, PRIORITY_BOOK, PRIORITY_COLLEGE, PRIORITY_OTHER = 120, 80, 100, 90


class BadRows(ValueError):
    """Rows that break a contract; at most 20 are named."""


def read_registry(spark: SparkSession, path: str) -> DataFrame:
    """The CSV registry with typed year and date. The header is checked against the schema by Spark (enforceSchema off)."""
    rows = spark.read.schema(REGISTRY).option("header", True).option("enforceSchema", False).option("mode", "FAILFAST").option("encoding", "UTF-8").csv(path)
    return rows.withColumn("year", F.col("year").try_cast("int")).withColumn("collected_at", F.try_to_date("collected_at", "yyyy-MM-dd"))


def registry_errors(domain: str) -> Column:
    """The fields of a registry row that break its rules."""
    suffix = F.lower(F.regexp_extract("file", r"\.([A-Za-z0-9]+)$", 1))
    return F.array_compact(
        F.array(
            F.when((text_of(F.col("file")) == "") | F.col("file").rlike(r"^/|^[A-Za-z]:|\\|(^|/)\.\.(/|$)") | ~suffix.isin(*KINDS), F.lit("file")),
            F.when(F.trim(text_of(F.col("doc_title"))) == "", F.lit("doc_title")),
            F.when(~F.coalesce(F.col("level").isin(SCHOOL, COLLEGE), F.lit(False)), F.lit("level")),
            F.when(~F.coalesce(F.col("cohort").rlike(r"^\d{4}$") | (F.col("cohort") == ALL_COHORTS), F.lit(False)), F.lit("cohort")),
            F.when(~F.coalesce(F.col("year").between(1900, 2100), F.lit(False)), F.lit("year")),
            F.when(~F.coalesce(F.col("status").isin(CURRENT, HISTORIC), F.lit(False)), F.lit("status")),
            F.when(~in_domain(F.col("page_url"), domain), F.lit("page_url")),
            F.when(~in_domain(F.col("file_url"), domain), F.lit("file_url")),
            F.when(F.col("collected_at").isNull(), F.lit("collected_at")),
        )
    )


def check_registry(rows: DataFrame, domain: str) -> DataFrame:
    """rows again, or BadRows for broken or repeated files."""
    bad = rows.withColumn("errors", registry_errors(domain)).where(F.size("errors") > 0).select("file", "errors")
    twice = rows.groupBy("file").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("file", F.array(F.lit("repeated")).alias("errors"))
    found = bad.unionByName(twice).limit(20).collect()
    if found:
        raise BadRows(f"registry: {[(r.file, r.errors) for r in found]}")
    return rows


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines of chunks. Malformed lines, broken rows and repeated ids are an error; so is a file without rows."""
    schema = T.StructType([*CHUNK.fields, T.StructField("_corrupt", T.StringType())])
    lines = spark.read.text(path).where(F.trim("value") != "")
    rows = lines.select(F.from_json("value", schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}).alias("r")).select("r.*")
    problems = rows.select(F.coalesce("chunk_id", F.lit("?")).alias("chunk_id"), F.when(F.col("_corrupt").isNotNull(), F.array(F.lit("malformed"))).otherwise(chunk_errors()).alias("errors")).where(F.size("errors") > 0)
    twice = rows.groupBy("chunk_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("chunk_id", F.array(F.lit("repeated")).alias("errors"))
    found = problems.unionByName(twice).limit(20).collect()
    if found:
        raise BadRows(f"chunks: {[(r.chunk_id, r.errors) for r in found]}")
    if rows.isEmpty():
        raise BadRows("chunks: no rows")
    return rows.drop("_corrupt")


def read_catalog(spark: SparkSession, path: str, schema: T.StructType) -> dict[str, DataFrame]:
    """The nested catalog JSON as flat frames of plans, modules and courses."""
    book = spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)
    plans = book.select(F.inline("plans"))
    modules = plans.select("college", "cohort", "major", F.inline("modules"))
    return {"plans": plans.drop("modules"), "modules": modules, "courses": book.select(F.inline("courses"))}


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """Plain files, each as one paragraph element."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.lit("paragraph").alias("kind"), F.col("value").alias("text"), F.lit(None).cast("int").alias("page"))


def by_kind(files: DataFrame, path_col: str = "path") -> DataFrame:
    """Each file with its reader's name, or rejected."""
    suffix = F.lower(F.regexp_extract(path_col, r"\.([A-Za-z0-9]+)$", 1))
    return files.withColumn("reader", F.when(suffix.isin("txt", "md"), "text").when(suffix.isin("pdf", "docx"), suffix).otherwise("rejected"))


def file_hashes(spark: SparkSession, folder: str) -> DataFrame:
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    return files.select("path", "length", F.sha2("content", 256).alias("sha256"))


def ocr_pages(sidecar: DataFrame, files: DataFrame) -> DataFrame:
    """(file, page, text) with a missing flag for pages of files that the sidecar lacks. sidecar: file, pages array<struct<page,text>>."""
    have = sidecar.select("file", F.inline("pages"))
    wanted = files.select("file", F.explode(F.sequence(F.lit(1), F.col("page_count"))).alias("page"))
    return wanted.join(have, ["file", "page"], "left").withColumn("missing", F.col("text").isNull())


def source_priority(title: Column, level: Column, extracts: list[str], book_mark: str = "完整总册") -> Column:
    return F.when(title.isin(extracts) if extracts else F.lit(False), PRIORITY_EXTRACT).when(title.contains(book_mark), PRIORITY_BOOK).when(level == COLLEGE, PRIORITY_COLLEGE).otherwise(PRIORITY_OTHER)


def sources_of_chunks(chunks: DataFrame, domain: str) -> DataFrame:
    """One row for each signature: the first chunk's, trusted by its domain. The page URL is no part of the signature."""
    window = Window.partitionBy(*SIGNATURE).orderBy("chunk_id")
    first = chunks.withColumn("_n", F.row_number().over(window)).where("_n = 1")
    key = F.sha2(F.concat_ws("\u001f", *[F.col(c).cast("string") for c in SIGNATURE]), 256)
    return first.select(F.concat(F.lit("src_"), F.substring(key, 1, 24)).alias("source_id"), *SIGNATURE, "page_url", in_domain(F.col("file_url"), domain).alias("trusted"), F.lit(True).alias("enabled"))


def unregistered(chunks: DataFrame, registry: DataFrame) -> DataFrame:
    """Chunks whose signature no registered source has."""
    return chunks.join(registry.select(*SIGNATURE).distinct(), list(SIGNATURE), "left_anti")
