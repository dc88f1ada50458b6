"""Sinks: tables with a manifest that is written last, resumable parts, flags, rebinding."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST = "manifest"


def fingerprint(df: DataFrame) -> str:
    """A hash of the rows, whatever their order; partial sums, no sort."""
    row = df.select(F.xxhash64(*df.columns).cast("decimal(38,0)").alias("h")).agg(F.count(F.lit(1)).alias("n"), F.sum("h").alias("s")).first()
    return f"{row['n']}-{row['s'] or 0}"


def publish(df: DataFrame, path: str, version: str, partition_by: list[str] | None = None) -> dict:
    """Rows first, then a one-row manifest: readers that require it never see half a table."""
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(f"{path}/rows")
    spark = df.sparkSession
    found = {"version": version, "fingerprint": fingerprint(spark.read.parquet(f"{path}/rows").select(*df.columns))}
    spark.range(1).select(*[F.lit(v).alias(k) for k, v in found.items()]).coalesce(1).write.mode("overwrite").parquet(f"{path}/{MANIFEST}")
    return found


def read_published(spark: SparkSession, path: str, version: str) -> DataFrame:
    head = spark.read.parquet(f"{path}/{MANIFEST}").first()
    if head["version"] != version:
        raise ValueError(f"{path} has version {head['version']}, not {version}")
    return spark.read.parquet(f"{path}/rows")


def publish_if_changed(df: DataFrame, path: str, version: str) -> bool:
    """False, and nothing written, if the manifest already names these rows."""
    try:
        head = df.sparkSession.read.parquet(f"{path}/{MANIFEST}").first()
        if head["version"] == version and head["fingerprint"] == fingerprint(df):
            return False
    except Exception as missing:  # noqa: BLE001  Spark's own error for a path that isn't there
        if "PATH_NOT_FOUND" not in str(missing):
            raise
    publish(df, path, version)
    return True


def write_parts(df: DataFrame, path: str, key: str) -> None:
    """Replaces only the partitions of the keys that df holds."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).parquet(path)


def pending(sources: DataFrame, done: DataFrame, key: str, signature: str) -> DataFrame:
    """Sources whose key and signature aren't among the parts that are done."""
    return sources.join(done.select(key, signature).distinct(), [key, signature], "left_anti")


def set_flags(sources: DataFrame, source_id: str, *, trusted: bool | None = None, enabled: bool | None = None) -> DataFrame:
    """sources with one row's flags changed; KeyError if there is no such row."""
    if sources.where(F.col("source_id") == source_id).isEmpty():
        raise KeyError(source_id)
    hit = F.col("source_id") == source_id
    changes = {k: F.when(hit, F.lit(v)).otherwise(F.col(k)) for k, v in (("trusted", trusted), ("enabled", enabled)) if v is not None}
    return sources.withColumns(changes) if changes else sources


def same_rows(a: DataFrame, b: DataFrame) -> bool:
    """Equal as bags of rows, row numbers included."""
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def write_json_lines(df: DataFrame, path: str) -> DataFrame:
    """JSON lines by Spark's commit protocol; the report has a row for each source."""
    df.write.mode("overwrite").json(path)
    return df.groupBy("doc_title").agg(F.count(F.lit(1)).alias("chunks"), F.sum(F.char_length("text")).alias("chars"))
