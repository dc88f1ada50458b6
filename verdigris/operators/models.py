"""Models that others bring, under a checked contract: encoders, rerankers, recognisers. Each runs in Arrow batches.

A model is made once for each Python worker. What it returns must have one result
for each input, in order, of the declared shape and finite; the first row that
breaks this ends the job with its id.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator, Sequence
from typing import Protocol, runtime_checkable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ..shipping import ship

BATCH = 64
#: How much of a lexical score is coverage, and how much the exact share.
COVERAGE_SHARE, EXACT_SHARE = 0.65, 0.35
_LATIN, _CJK = re.compile(r"[a-z]+\d*|\d+(?:\.\d+)?%?"), re.compile(r"[一-鿿]+")
_EXACT = re.compile(r"[A-Za-z]{2,}[- ]?\d{2,4}|第[一二三四五六七八九十百零〇\d]+条|\d+(?:\.\d+)?")


@runtime_checkable
class Encoder(Protocol):
    dimension: int

    def encode(self, texts: Sequence[str]) -> Sequence[Sequence[float]]:
        """A vector of dimension values for each text, in order."""


@runtime_checkable
class Reranker(Protocol):
    def scores(self, question: str, texts: Sequence[str]) -> Sequence[float]:
        """A score for each text, in order."""


@runtime_checkable
class Recogniser(Protocol):
    def recognise(self, image: bytes) -> str:
        """The text that a page's image shows."""


class BrokenContract(ValueError):
    """A model's result that its contract rules out."""


def _words(text: str) -> list[str]:
    low = text.lower()
    runs = _CJK.findall(low)
    return _LATIN.findall(low) + [r[i : i + 2] if len(r) > 1 else r for r in runs for i in range(max(1, len(r) - 1))]


class HashingEncoder:
    """Token counts by blake2b, unit length; a text without tokens is the zero vector. The same on every machine."""

    def __init__(self, dimension: int = 128):
        self.dimension = dimension

    def encode(self, texts: Sequence[str]) -> list[list[float]]:
        out = []
        for text in texts:
            v = [0.0] * self.dimension
            low = text.lower()
            runs = _CJK.findall(low)
            for f in _LATIN.findall(low) + [r[i : i + n] for r in runs for n in (1, 2) for i in range(len(r) - n + 1)]:
                v[int.from_bytes(hashlib.blake2b(f.encode(), digest_size=8).digest(), "little") % self.dimension] += 1
            norm = math.sqrt(sum(x * x for x in v)) or 1.0
            out.append([x / norm for x in v])
        return out


class LexicalReranker:
    """The share of the question's distinct tokens that a text has, and the share of its codes, articles and numbers that stand there as they are."""

    def scores(self, question: str, texts: Sequence[str]) -> list[float]:
        asked, exact = set(_words(question)), set(_EXACT.findall(question))
        out = []
        for text in texts:
            coverage = len(asked & set(_words(text))) / len(asked) if asked else 0.0
            share = sum(x in text for x in exact) / len(exact) if exact else 0.0
            out.append(COVERAGE_SHARE * coverage + EXACT_SHARE * share)
        return out


def _vectors(found: object, ids: list, dimension: int) -> np.ndarray:
    found = list(found)  # type: ignore[call-overload]
    if len(found) != len(ids):
        raise BrokenContract(f"{len(found)} vectors for {len(ids)} texts from {ids[0]!r} on")
    for own, v in zip(ids, found, strict=True):
        values = np.asarray(v, np.float64)
        if values.shape != (dimension,):
            raise BrokenContract(f"the vector of {own!r} has shape {values.shape}, not ({dimension},)")
        if not np.isfinite(values).all():
            raise BrokenContract(f"the vector of {own!r} isn't finite")
    return np.asarray(found, np.float64).reshape(len(ids), dimension)


def encoded(rows: DataFrame, id_col: str, text: str, encoder: Encoder, out: str = "embedding", *, unit: bool = True) -> DataFrame:
    """rows with the encoder's vectors, of unit length where unit; zero vectors stay. Null texts count as empty."""
    if not isinstance(encoder, Encoder) or encoder.dimension < 1:
        raise TypeError("an encoder has a dimension of 1 or more, and encode()")
    ship(rows.sparkSession)
    names = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for low in range(0, whole.num_rows, BATCH):
                batch = whole.slice(low, BATCH)
                texts = [t or "" for t in batch.column(text).to_pylist()]
                values = _vectors(encoder.encode(texts), batch.column(id_col).to_pylist(), encoder.dimension)
                if unit:
                    norms = np.linalg.norm(values, axis=1, keepdims=True)
                    values = values / np.where(norms == 0, 1.0, norms)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(values.tolist(), pa.list_(pa.float64()))], [*names, out])

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields]).add(out, T.ArrayType(T.DoubleType())))


def reranked(pairs: DataFrame, id_col: str, question: str, text: str, reranker: Reranker, out: str = "rerank") -> DataFrame:
    """pairs with the reranker's score. A question's neighbouring texts are scored together."""
    if not isinstance(reranker, Reranker):
        raise TypeError("a reranker has scores()")
    ship(pairs.sparkSession)
    names = pairs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            asked, texts, ids = batch.column(question).to_pylist(), batch.column(text).to_pylist(), batch.column(id_col).to_pylist()
            scores: list[float] = []
            while len(scores) < len(ids):
                low = len(scores)
                high = next((i for i in range(low + 1, min(low + BATCH, len(ids))) if asked[i] != asked[low]), min(low + BATCH, len(ids)))
                found = np.asarray(list(reranker.scores(asked[low] or "", [t or "" for t in texts[low:high]])), np.float64)
                if found.shape != (high - low,):
                    raise BrokenContract(f"{found.shape} scores for {high - low} texts from {ids[low]!r} on")
                if not np.isfinite(found).all():
                    raise BrokenContract(f"the score of {ids[low + int(np.flatnonzero(~np.isfinite(found))[0])]!r} isn't finite")
                scores += found.tolist()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], [*names, out])

    return pairs.mapInArrow(run, T.StructType([*pairs.schema.fields]).add(out, "double"))
