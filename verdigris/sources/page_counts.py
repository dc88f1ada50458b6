"""How many pages the files of a folder have, where that can be read off them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A page's own object, not the tree of pages.
PAGE_OBJECT = r"/Type\s*/Page(?![A-Za-z])"


def pages_in(content: Column) -> Column:
    """Pages of a PDF's bytes; null where it is no PDF, or its pages stand in compressed objects."""
    text = F.decode(content, "iso-8859-1")
    n = F.regexp_count(text, F.lit(PAGE_OBJECT)).cast("bigint")
    return F.when(text.startswith("%PDF-") & (n > 0), n)


def page_counts(spark: SparkSession, folder: str, pattern: str = "*.pdf") -> DataFrame:
    """(path, bytes, pages, error) of every file, a file a row, in subfolders too; error is null where pages isn't. Spark's scan passes over files without a byte."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder)
    found = files.select("path", F.col("length").alias("bytes"), pages_in(F.col("content")).alias("pages"))
    return found.withColumn("error", F.when(F.col("pages").isNull(), "unreadable"))
