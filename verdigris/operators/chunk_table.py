"""Chunks of a text as a table function: one pass carries headings, splits bodies and packs tables' rows."""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shipping import ship
from .ingest import ARTICLE, CHAPTER, split_body, split_table

SCHEMA = "part int, chapter string, article string, kind string, body string"
_CHAPTER, _ARTICLE = re.compile(CHAPTER), re.compile(ARTICLE)


def parts_of(text: str | None, limit: int) -> Iterator[tuple[int, str | None, str | None, str, str]]:
    """(part, chapter, article, kind, body). Runs of lines under one heading make a body, lines that begin with | a table; a new chapter clears the article."""
    chapter = article = None
    marked = []
    for line in (text or "").split("\n"):
        if _CHAPTER.match(line):
            chapter, article = line.strip(), None
        elif _ARTICLE.match(line):
            article = line.strip()
        elif line.strip():
            marked.append((chapter, article, "table" if line.lstrip().startswith("|") else "body", line))
    part = 0
    for (chapter, article, kind), lines in itertools.groupby(marked, key=lambda x: x[:3]):
        whole = "\n".join(x[3] for x in lines)
        for body in (split_table if kind == "table" else split_body)(whole, limit):
            yield part, chapter, article, kind, body
            part += 1


class ChunkParts:
    """The table function; its rows leave in Arrow batches."""

    def eval(self, text: str, limit: int):
        yield from parts_of(text, limit)


chunk_parts = F.udtf(ChunkParts, returnType=SCHEMA, useArrow=True)


def chunks_of(docs: DataFrame, text: Column, limit: int, keep: list[str]) -> DataFrame:
    """keep and the parts of every row's text, by a lateral join. A text without content has none; repeated rows have theirs each."""
    ship(docs.sparkSession)
    held = docs.select(*keep, text.alias("_text"))
    return held.lateralJoin(chunk_parts(F.col("_text").outer(), F.lit(limit))).select(*keep, *[c.split()[0] for c in SCHEMA.split(", ")])
