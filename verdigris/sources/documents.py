"""DOCX bodies as elements in document order, from binary files; PDFs need an extractor and come as elements already."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
STRUCTURAL = re.compile(r"^\s*(?:第[一二三四五六七八九十百零〇\d]+[章节条编篇]|[一二三四五六七八九十]+、|[（(][一二三四五六七八九十\d]+[）)]|\d+[.、])")


def table_markdown(rows: list[list[str | None]]) -> str:
    """Cells padded to the widest row, pipes escaped, a rule under the first row."""
    width = max((len(r) for r in rows), default=0)
    if not width:
        return ""
    lines = ["| " + " | ".join((c or "").replace("|", "\\|").replace("\n", " ").strip() for c in [*r, *[""] * (width - len(r))]) + " |" for r in rows]
    return "\n".join([lines[0], "| " + " | ".join(["---"] * width) + " |", *lines[1:]])


def join_wrapped(text: str) -> str:
    """Lines joined to the one before unless they open a new unit or the one before ended a sentence."""
    out: list[str] = []
    for line in filter(None, map(str.strip, text.splitlines())):
        if out and not STRUCTURAL.match(line) and not re.search(r"[。！？；.!?;：:]$", out[-1]):
            out[-1] += line
        else:
            out.append(line)
    return "\n".join(out)


def docx_elements(content: bytes) -> list[tuple[str, str]]:
    """(kind, text) in document order: headings, paragraphs and tables."""
    body = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(content)).read("word/document.xml")).find(f"{_W}body")
    out = []
    for node in body if body is not None else []:
        text_of = lambda n: "".join(t.text or "" for t in n.iter(f"{_W}t"))
        if node.tag == f"{_W}p":
            style = node.find(f"{_W}pPr/{_W}pStyle")
            text = text_of(node).strip()
            if text:
                out.append(("heading" if style is not None and "heading" in style.get(f"{_W}val", "").lower() else "paragraph", text))
        elif node.tag == f"{_W}tbl":
            rows = [[text_of(c).strip() for c in r.findall(f"{_W}tc")] for r in node.findall(f"{_W}tr")]
            if any(any(r) for r in rows):
                out.append(("table", table_markdown(rows)))
    return out


def read_docx(spark: SparkSession, folder: str) -> DataFrame:
    """(file, place, kind, text); a broken file gives one row of kind error."""
    from ..shipping import ship

    ship(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    found = docx_elements(content)
                except (zipfile.BadZipFile, KeyError, ElementTree.ParseError) as e:
                    found = [("error", type(e).__name__)]
                rows += [(path, i, k, t) for i, (k, t) in enumerate(found)]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.int32(), pa.string(), pa.string()))], ["file", "place", "kind", "text"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.docx").option("recursiveFileLookup", True).load(folder)
    return files.select("path", "content").mapInArrow(run, "file string, place int, kind string, text string")
