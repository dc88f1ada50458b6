import hashlib
from itertools import groupby

import pytest
from pyspark.errors import PythonException
from pyspark.sql import functions as F

from verdigris.operators import chunk_table as T
from verdigris.operators import ingest
from verdigris.operators import models as M
from verdigris.operators.retrieval import hashed_features
from verdigris.plans import queries_policy as Q
from verdigris.sources import page_counts as P

from compare import SMALL


def test_chunk_table_equals_the_parts_own_operators(spark):
    """Headings by windows, then bodies and tables split one by one."""
    docs = {r.doc_id: r for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    want = []
    for i, r in docs.items():
        lines = (r.text or "").split("\n")
        table = "\n".join(["| n | line |", "|---|---|", *(f"| {k} | {x.replace('|', '/')} |" for k, x in enumerate(lines))])
        bodies = [ingest.split_body("\n".join(g), 400) for blank, g in groupby([x for x in lines if x.strip()], key=lambda x: x.lstrip().startswith("|")) if not blank]
        parts = [("body", b) for x in bodies for b in x] + [("table", b) for b in ingest.split_table(table, 400)]
        want += [(i, n, f"第1章 {r.lang or ''}".strip(), None if kind == "body" else "第2条 表", kind, len(b), hashlib.md5(b.encode()).hexdigest()) for n, (kind, b) in enumerate(parts)]
    got = [tuple(r) for r in Q.chunk_table(spark, SMALL).collect()]
    assert sorted(got) == sorted(want) and {x[4] for x in got} == {"body", "table"}


def test_headings_in_the_table_function_and_in_windows(spark):
    text = "前言\n第一章 总则\n甲\n第一条 目的\n乙\n\n第二章 附则\n丙\n| a |\n| b |\n丁"
    df = spark.createDataFrame([(1, text), (2, None), (3, "\n \n")], "id int, text string")
    got = sorted((r.id, r.part, r.chapter, r.article, r.kind, r.body) for r in T.chunks_of(df, F.col("text"), 80, ["id"]).collect())
    assert got == [
        (1, 0, None, None, "body", "前言"),
        (1, 1, "第一章 总则", None, "body", "甲"),
        (1, 2, "第一章 总则", "第一条 目的", "body", "乙"),
        (1, 3, "第二章 附则", None, "body", "丙"),
        (1, 4, "第二章 附则", None, "table", "原表：\n| a |\n| b |"),
        (1, 5, "第二章 附则", None, "body", "丁"),
    ]


def broken(kind):
    class Broken:
        dimension = 2

        def encode(self, texts):
            good = [[1.0, 2.0] for _ in texts]
            return {"few": good[:-1], "shape": [*good[:-1], [1.0]], "nan": [*good[:-1], [1.0, float("nan")]]}[kind]

        def scores(self, question, texts):
            good = [0.5] * len(texts)
            return {"few": good[:-1], "shape": [[x] for x in good], "nan": [*good[:-1], float("inf")]}[kind]

    return Broken()


def frame(spark):
    return spark.createDataFrame([(i, "q", f"word {i}" if i != 3 else None) for i in range(5)], "id int, question string, text string").coalesce(1)


@pytest.mark.parametrize("kind", ["few", "shape", "nan"])
def test_broken_models_name_the_row(spark, kind):
    for run in (lambda: M.encoded(frame(spark), "id", "text", broken(kind)), lambda: M.reranked(frame(spark), "id", "question", "text", broken(kind))):
        with pytest.raises(PythonException, match="BrokenContract.*(4|0)"):
            run().collect()


def test_contracts_are_checked_before_the_job(spark):
    with pytest.raises(TypeError):
        M.encoded(frame(spark), "id", "text", object())
    with pytest.raises(TypeError):
        M.reranked(frame(spark), "id", "question", "text", M.HashingEncoder())
    assert isinstance(M.HashingEncoder(), M.Encoder) and isinstance(M.LexicalReranker(), M.Reranker)


def test_hashing_encoder_in_the_slot(spark):
    rows = spark.createDataFrame([(1, "abc abc 12 中文字"), (2, ""), (3, None)], "id int, text string")
    got = {r.id: r.embedding for r in M.encoded(rows, "id", "text", M.HashingEncoder(16)).collect()}
    want = {r.id: r.embedding for r in hashed_features(rows, "text", 16).collect()}
    assert all(abs(a - b) < 1e-12 for i in got for a, b in zip(got[i], want[i], strict=True)) and got[2] == got[3] == [0.0] * 16
    again = M.HashingEncoder(64)
    texts = {r.item_id: r.text for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()}
    for r in Q.hashed_vectors(spark, SMALL).collect():
        assert all(abs(a - b) < 1e-8 for a, b in zip(r.embedding, again.encode([texts[r.item_id]])[0], strict=True))


def test_neighbouring_questions_are_scored_apart(spark):
    rows = spark.createDataFrame([(1, "ab12", "ab12 x"), (2, "ab12", "zz"), (3, "x 第3条", "x 第3条"), (4, None, "x")], "id int, q string, t string").coalesce(1)
    got = {r.id: round(r.rerank, 6) for r in M.reranked(rows, "id", "q", "t", M.LexicalReranker()).collect()}
    assert got == {1: 1.0, 2: 0.0, 3: 1.0, 4: 0.0}


def test_page_counts(spark, tmp_path):
    (tmp_path / "deep").mkdir()
    pages = b"".join(b"%d 0 obj << /Type /Page /Parent 1 0 R >> endobj\n" % i for i in range(3))
    (tmp_path / "a.pdf").write_bytes(b"%PDF-1.4\n1 0 obj << /Type /Pages /Count 3 >> endobj\n" + pages)
    (tmp_path / "deep" / "b.pdf").write_bytes(b"no pdf /Type /Page ")
    (tmp_path / "c.pdf").write_bytes(b"")
    (tmp_path / "d.pdf").write_bytes(b"%PDF-1.5\n\xff\xfe compressed")
    (tmp_path / "e.txt").write_bytes(b"%PDF-1.4 /Type /Page ")
    got = {r.path.rsplit("/", 1)[1]: (r.pages, r.error) for r in P.page_counts(spark, str(tmp_path)).collect()}
    assert got == {"a.pdf": (3, None), "b.pdf": (None, "unreadable"), "d.pdf": (None, "unreadable")}
