"""Token counts through a cache of digests.

A text's content digest and the digest of the tokenizer (library, its version, the
vocabulary file) name a count. Known names are joined; only the distinct texts
without one are encoded, and their counts are appended. Entries are facts that hold
on their own, so a batch that was appended in part, or twice, does no harm.
"""

from __future__ import annotations

import hashlib
import importlib.metadata
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import ship
from .common import boxed, exists, kept_path, pieces_by_bytes, released, table, unboxed, whole
from .tokens import encoder_of

LIMIT = 1024
#: Text that is encoded before its counts leave a Python worker.
SLICE_BYTES = 4 << 20

_ENTRY = "digest binary, n_bytes bigint, n_tokens bigint"


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def tokenizer_version(vocabulary: str) -> str:
    """SHA-256 of the library's name and version and of the vocabulary file."""
    library = "sentencepiece" if vocabulary.endswith(".model") else "tokenizers"
    digest = hashlib.sha256(f"{library} {importlib.metadata.version(library)}\n".encode())
    with open(vocabulary, "rb") as f:
        while block := f.read(1 << 20):
            digest.update(block)
    return digest.hexdigest()


class CountCache:
    """Counts as Parquet in a folder that driver and executors share, one subfolder for each tokenizer version."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def _at(self, version: str) -> str:
        return f"{self.folder}/tokenizer={version}"

    def stored(self, version: str) -> DataFrame:
        """(digest, n_bytes, n_tokens): one row for each content; entries that were appended twice are one."""
        where = self._at(version)
        if not exists(self.spark, where):
            return self.spark.createDataFrame([], _ENTRY)
        entries = self.spark.read.schema(_ENTRY).parquet(where)
        return entries.groupBy("digest").agg(F.max("n_bytes").alias("n_bytes"), F.max("n_tokens").alias("n_tokens"))

    def append(self, entries: DataFrame, version: str) -> None:
        entries.write.mode("append").parquet(self._at(version))


def _encoded(misses: DataFrame, vocabulary: str) -> DataFrame:
    """(digest, n_bytes, n_tokens) of (digest, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(vocabulary)
        for batch in (x for y in batches for x in pieces_by_bytes(y, "text", SLICE_BYTES)):
            texts = batch.column("text")
            counts = [encoder.count_of(t) for t in texts.to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("digest"), pa.compute.binary_length(texts).cast(pa.int64()), pa.array(counts, pa.int64())], ["digest", "n_bytes", "n_tokens"])
        encoder.forget()
        released()

    return misses.select("digest", "text").mapInArrow(run, _ENTRY)


def missing(docs: DataFrame, stored: DataFrame, text_col: str = "text", *, normalise: Callable[[Column], Column] = whole) -> DataFrame:
    """(digest, text) of every distinct content that stored lacks. Copies meet within a task before the shuffle."""
    text = normalise(F.col(text_col))
    distinct = docs.select(F.unhex(F.sha2(text, 256)).alias("digest"), text.alias("text")).groupBy("digest").agg(F.first("text").alias("text"))
    return distinct.join(stored.select("digest"), "digest", "left_anti")


def count_tokens(docs: DataFrame, cache: CountCache, text_col: str = "text", *, vocabulary: str | None = None, normalise: Callable[[Column], Column] = whole) -> DataFrame:
    """Every row with _n_bytes (UTF-8) and _n_tokens of its whole text.

    normalise must not change a count: by default null becomes the empty text,
    which has none. Equal texts share an entry, repeated rows stay, a frame without
    rows gives none and appends nothing. All other columns pass through, whatever
    their names; _n_bytes and _n_tokens are replaced. A text over one batch's size
    is encoded alone.
    """
    ship(docs.sparkSession)
    vocabulary = vocabulary or default_vocabulary()
    version = tokenizer_version(vocabulary)
    cache.append(_encoded(missing(docs, cache.stored(version), text_col, normalise=normalise), vocabulary), version)
    rows = docs.select(boxed(docs), F.unhex(F.sha2(normalise(F.col(text_col)), 256)).alias("digest"))
    names = [c for c in docs.columns if c not in ("_n_bytes", "_n_tokens")]
    return rows.join(cache.stored(version), "digest").select(*unboxed(names), F.col("n_bytes").alias("_n_bytes"), F.col("n_tokens").alias("_n_tokens"))


def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's tokens: doc_id, n_bytes, n_tokens, over_limit.

    A null or empty text has none; repeated rows and ids stay; an empty table gives
    none. The cache is a new folder under spark.checkpoint.dir at every call.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    cache = CountCache(spark, kept_path(spark, "token-counts"))
    # the text is needed for its digest alone; the rows that meet the counts are narrow
    known = count_tokens(docs, cache)
    return known.select("doc_id", F.col("_n_bytes").alias("n_bytes"), F.col("_n_tokens").alias("n_tokens"), (F.col("_n_tokens") > LIMIT).alias("over_limit"))
