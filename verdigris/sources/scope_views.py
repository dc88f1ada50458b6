"""Tables that follow from a scope of rows, made once for each scope and state of its files and shared by all who ask for them."""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .snapshots import _fs


def snapshot_id(*frames: DataFrame) -> str:
    """A digest of the names, sizes and times of the files that the frames read."""
    facts = []
    for path in sorted({p for f in frames for p in f.inputFiles()}):
        spark = frames[0].sparkSession
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(spark.sparkContext._jvm.java.net.URI(path))
        status = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(where)
        facts.append((path, status.getLen(), status.getModificationTime()))
    return hashlib.sha256(json.dumps(facts).encode()).hexdigest()


class ScopeViews:
    """Views under one shared folder: written beside, then renamed to their key, so that a view is whole or absent."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def key(self, scope: dict, snapshot: str) -> str:
        return hashlib.sha256(json.dumps([scope, snapshot], sort_keys=True, ensure_ascii=False).encode()).hexdigest()[:32]

    def view(self, scope: dict, snapshot: str, make: Callable[[], dict[str, DataFrame]]) -> dict[str, DataFrame]:
        """The tables that make() gives, by name; another scope or snapshot has tables of its own."""
        fs, target = _fs(self.spark, f"{self.folder}/{self.key(scope, snapshot)}")
        if not fs.exists(target):
            beside = f"{self.folder}/.{uuid.uuid4().hex}"
            for name, table in make().items():
                table.write.parquet(f"{beside}/{name}")
            if not fs.rename(_fs(self.spark, beside)[1], target) and not fs.exists(target):
                raise OSError(f"{beside} could not be renamed to {target.toString()}")
        names = [s.getPath().getName() for s in fs.listStatus(target) if s.isDirectory() and not s.getPath().getName().startswith(".")]
        return {n: self.spark.read.parquet(f"{target.toString()}/{n}") for n in names}
