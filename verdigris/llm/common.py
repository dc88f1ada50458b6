"""Shared helpers: table access, the shared folder, and intermediate tables."""

from __future__ import annotations

import atexit
import ctypes
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space of every contract: space and tab to carriage return.
SPACE = " \t\n\u000b\f\r"
SPACE_CLASS = r"[\x20\x09-\x0D]"
WORD_CLASS = r"[^\x20\x09-\x0D]+"

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole(column: Column) -> Column:
    """The whole text; null counts as empty."""
    return F.coalesce(column.cast("string"), F.lit(""))


def ascii_lower(column: Column) -> Column:
    """Lower-cases A-Z alone. Pure ASCII values take the fast path."""
    return F.when(F.octet_length(column) == F.char_length(column), F.lower(column)).otherwise(F.translate(column, UPPER, UPPER.lower()))


def boxed(df: DataFrame, *without: str) -> Column:
    """The frame's other columns as one struct, row, so that none clashes with a column made here."""
    spare = "_"
    while spare in df.columns:
        spare += "_"
    return F.struct(*[F.col(f"`{c}`") for c in df.columns if c not in without], F.lit(0).alias(spare)).alias("row")


def unboxed(names: list[str], row: str = "row") -> list[Column]:
    return [F.col(row)[c].alias(c) for c in names]


def text_digest(text_col: str = "text") -> Column:
    return F.unhex(F.md5(whole(F.col(text_col))))


def order_of(docs: DataFrame, id_col: str) -> Column:
    """The id as a number where it is a whole number, else as a string; null comes first."""
    if dict(docs.dtypes)[id_col] in ("tinyint", "smallint", "int", "bigint"):
        return F.coalesce(F.col(id_col).cast("bigint"), F.lit(-(2**63)).cast("bigint"))
    return F.coalesce(F.col(id_col).cast("string"), F.lit(""))


def numbered(docs: DataFrame, id_col: str, text_col: str, label: str) -> DataFrame:
    """(row, t, id_order, id_null, id, number): every row without its text, written once, so that its number never changes."""
    rows = docs.select(boxed(docs, text_col), text_digest(text_col).alias("t"), order_of(docs, id_col).alias("id_order"), F.col(id_col).isNull().alias("id_null"), F.col(id_col).alias("id"))
    return written(rows.withColumn("number", F.monotonically_increasing_id()), label)


def distinct_texts(docs: DataFrame, text_col: str) -> DataFrame:
    """(t, text): each text once, one from every task before the shuffle; null counts as empty."""
    return docs.select(text_digest(text_col).alias("t"), whole(F.col(text_col)).alias("text")).groupBy("t").agg(F.first("text").alias("text"))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. One is set only where the session names none and all run on one machine."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    found = spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="verdigris-"))
        found = spark.sparkContext.getCheckpointDir()
    return found


_written: dict[str, SparkSession] = {}
_scopes: list[list[str]] = []


def _delete(path: str) -> None:
    spark = _written.pop(path)
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def _drop_written() -> None:
    for path in [*_written]:
        try:
            _delete(path)
        except Exception:  # noqa: BLE001  the session may be gone; its folder goes with it
            return


atexit.register(_drop_written)


class Scope:
    """Intermediate tables that one step writes. begin() deletes those of the step before, whose result has been written by then."""

    def __init__(self) -> None:
        self.paths: list[str] = []

    def begin(self) -> Scope:
        for path in self.paths:
            if path in _written:
                _delete(path)
        self.paths = []
        return self

    def __enter__(self) -> Scope:
        _scopes.append(self.paths)
        return self

    def __exit__(self, *_) -> None:
        _scopes.pop()


def new_path(spark: SparkSession, label: str) -> str:
    path = f"{shared_dir(spark)}/verdigris/{label}-{uuid.uuid4().hex}"
    _written[path] = spark
    if _scopes:
        _scopes[-1].append(path)
    return path


def kept_path(spark: SparkSession, label: str) -> str:
    """A new folder that stays: results that are files."""
    return f"{shared_dir(spark)}/verdigris/{label}-{uuid.uuid4().hex}"


def exists(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def written(df: DataFrame, label: str, partition_by: list[str] | None = None) -> DataFrame:
    """Cuts lineage: the rows as a Parquet table in the shared folder, so that lost executors cost no recomputation."""
    spark = df.sparkSession
    path = new_path(spark, label)
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def pieces_by_bytes(batch: pa.RecordBatch, column: int | str, most: int) -> Iterator[pa.RecordBatch]:
    """The batch in slices of one row or more whose strings in column hold at most so many bytes; longer ones stand alone."""
    sizes = pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0).to_pylist()
    low = total = 0
    for i, n in enumerate(sizes):
        if i > low and total + n > most:
            yield batch.slice(low, i - low)
            low, total = i, 0
        total += n
    if low < batch.num_rows:
        yield batch.slice(low)


def released() -> None:
    """Gives a Python worker's free memory back to the system; idle workers live on beside the next stage's."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        return


_SPACES = np.zeros(256, bool)
_SPACES[[0x20, 9, 10, 11, 12, 13]] = True
_BYTE_VALUE = np.random.default_rng(7).integers(1, 1 << 63, 256, dtype=np.uint64)
_LETTER_VALUE = np.where(_SPACES, np.uint64(0), _BYTE_VALUE)
#: Powers of the base of a word's polynomial; letters so far apart share one.
_POWERS = np.multiply.accumulate(np.full(1 << 12, 0x5851F42D4C957F2D, np.uint64))


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _words(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of every word (run without white space), in text order, and where it starts."""
    letter = ~_SPACES[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[:-1] = letter
    edge[1:] ^= letter
    edges = np.flatnonzero(edge)
    first, ends = edges[::2], edges[1::2]
    if not len(first):
        return np.zeros(0, np.uint64), first
    low = int(first[0])
    data = data[low:]
    inner = np.arange(len(data)) - np.repeat(first - low, np.diff(np.append(first, len(data) + low)))
    values = _LETTER_VALUE[data]  # of white space 0
    values *= _POWERS[inner & (len(_POWERS) - 1)]
    return mixed(np.add.reduceat(values, first - low) + (ends - first).astype(np.uint64)), first


def word_hashes(text: bytes) -> np.ndarray:
    """A 64-bit hash of every word (run without white space), in text order."""
    return _words(np.frombuffer(text, np.uint8))[0]


def word_hashes_of(texts: list[bytes]) -> list[np.ndarray]:
    """word_hashes() of each text, in one pass over all."""
    hashes, first = _words(np.frombuffer(b" ".join(texts), np.uint8))
    ends = np.cumsum([len(t) + 1 for t in texts])
    return np.split(hashes, np.searchsorted(first, ends[:-1]))


def sums_by_key(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, ascending, and the sum of each one's values."""
    if not len(keys):
        return keys, values
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    starts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return keys[starts], np.add.reduceat(values[order], starts)
