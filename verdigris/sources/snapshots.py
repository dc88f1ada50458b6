"""Snapshots of several tables behind one pointer.

A snapshot's rows go to a folder of their own, then its manifest, then the pointer,
a new numbered file that is renamed into place. Readers follow the highest pointer,
so they see the snapshot before or the one after, never rows with another's
manifest. A job that dies before the rename leaves the old snapshot as it was.
"""

from __future__ import annotations

import json
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .sinks import fingerprint


def shared_folder(spark: SparkSession, label: str) -> str:
    """A folder of this name under spark.checkpoint.dir. A session on one machine that names none gets a temporary one."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="verdigris-"))
        shared = spark.sparkContext.getCheckpointDir()
    return f"{shared}/verdigris/{label}"


def new_folder(spark: SparkSession, label: str) -> str:
    """A new such folder, which stays."""
    return shared_folder(spark, f"{label}-{uuid.uuid4().hex}")


def _fs(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def _pointers(spark: SparkSession, path: str) -> list[int]:
    fs, where = _fs(spark, f"{path}/pointers")
    names = [s.getPath().getName() for s in fs.listStatus(where)] if fs.exists(where) else []
    return sorted(int(n) for n in names if n.isdigit())


def _put(spark: SparkSession, path: str, text: str) -> None:
    fs, where = _fs(spark, path)
    out = fs.create(where, False)
    out.write(bytearray(text.encode()))
    out.close()


def _get(spark: SparkSession, path: str) -> str:
    """A small file, as one row."""
    return spark.read.text(path, wholetext=True).first()[0]


def ordered_digest(df: DataFrame, ordinal: str) -> str:
    """A digest of the rows and their places; ordinal holds each row's place. Partial sums, no sort."""
    columns = [c for c in df.columns if c != ordinal]
    flags = [F.isnull(F.col(c)) for c in columns]
    row = df.select(F.xxhash64(ordinal, *columns, *flags).cast("decimal(38,0)").alias("a"), F.xxhash64(F.lit(7), ordinal, *columns, *flags).alias("b"))
    found = row.agg(F.count(F.lit(1)).alias("n"), F.sum("a").alias("a"), F.bit_xor("b").alias("b")).first()
    return f"{found['n']}-{found['a'] or 0}-{found['b'] or 0}"


def stage(frames: dict[str, DataFrame], path: str, version: str, *, ordinal: dict[str, str] | None = None, partition_by: dict[str, list[str]] | None = None, facts: dict | Callable[[dict[str, DataFrame]], dict] | None = None) -> str:
    """Writes rows and manifest of a new snapshot, without making it the current one; returns its id. A function of facts is given the tables as they have been written."""
    spark = next(iter(frames.values())).sparkSession
    name = uuid.uuid4().hex
    manifest: dict = {"version": version, "tables": {}}
    written: dict[str, DataFrame] = {}
    for table, df in frames.items():
        writer = df.write.mode("error")
        if (partition_by or {}).get(table):
            writer = writer.partitionBy(*partition_by[table])
        writer.parquet(f"{path}/snapshots/{name}/{table}")
        held = written[table] = spark.read.schema(df.schema).parquet(f"{path}/snapshots/{name}/{table}")
        manifest["tables"][table] = {"fingerprint": fingerprint(held), "ordered": ordered_digest(held, ordinal[table]) if (ordinal or {}).get(table) else None}
    manifest["facts"] = facts(written) if callable(facts) else facts or {}
    _put(spark, f"{path}/snapshots/{name}/manifest.json", json.dumps(manifest, ensure_ascii=False, sort_keys=True))
    return name


def point(spark: SparkSession, path: str, name: str) -> int:
    """Makes a staged snapshot the current one. Of two writers at once one renames first; the other takes the next number."""
    fs, temporary = _fs(spark, f"{path}/pointers/{uuid.uuid4().hex}.tmp")
    _put(spark, temporary.toString(), name)
    while True:
        number = max(_pointers(spark, path), default=0) + 1
        _, target = _fs(spark, f"{path}/pointers/{number}")
        if not fs.exists(target) and fs.rename(temporary, target):
            return number


def publish(frames: dict[str, DataFrame], path: str, version: str, **kinds) -> int:
    return point(next(iter(frames.values())).sparkSession, path, stage(frames, path, version, **kinds))


def current(spark: SparkSession, path: str) -> tuple[str, dict]:
    """(id, manifest) of the current snapshot; FileNotFoundError if there is none."""
    numbers = _pointers(spark, path)
    if not numbers:
        raise FileNotFoundError(path)
    name = _get(spark, f"{path}/pointers/{numbers[-1]}").strip()
    return name, json.loads(_get(spark, f"{path}/snapshots/{name}/manifest.json"))


def read(spark: SparkSession, path: str, table: str, version: str) -> DataFrame:
    """A table of the current snapshot; ValueError if it is of another version."""
    name, manifest = current(spark, path)
    if manifest["version"] != version:
        raise ValueError(f"{path} has version {manifest['version']}, not {version}")
    return spark.read.parquet(f"{path}/snapshots/{manifest.get('rows_of', name)}/{table}")


def rebind(df: DataFrame, path: str, table: str, ordinal: str, version: str) -> int:
    """Points a new version at the current rows of table if df holds the same rows at the same places; ValueError otherwise, and nothing changes."""
    spark = df.sparkSession
    name, manifest = current(spark, path)
    if manifest["tables"][table]["ordered"] != ordered_digest(df, ordinal):
        raise ValueError(f"rows or order of {table} differ from those of {path}")
    fresh = uuid.uuid4().hex
    # a binding names another snapshot's rows: tables are read from there, the manifest from here
    _put(spark, f"{path}/snapshots/{fresh}/manifest.json", json.dumps({**manifest, "version": version, "rows_of": manifest.get("rows_of", name)}, ensure_ascii=False, sort_keys=True))
    return point(spark, path, fresh)


def write_catalog(plans: DataFrame, courses: DataFrame, path: str, *, generated_at: str, source_sha256: str, version: str) -> int:
    """The catalog as a snapshot: plans nested, courses flat, and its counts in the manifest."""

    def facts(tables: dict[str, DataFrame]) -> dict:
        # counts of the files, so that no plan is built twice
        return {"generated_at": generated_at, "source_sha256": source_sha256, "plan_count": tables["plans"].count(), "course_count": tables["courses"].count()}

    return publish({"plans": plans, "courses": courses}, path, version, facts=facts)
