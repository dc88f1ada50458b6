from pyspark.sql import functions as F

import corpus_pipeline as P
from verdigris.llm.common import table

from compare import SMALL


def test_stages(spark, tmp_path):
    docs = table(spark, SMALL, "documents")
    start = docs.count()
    for i, (name, stage) in enumerate(P.STAGES):
        path = str(tmp_path / str(i))
        stage(spark, docs, SMALL).write.parquet(path)
        before, docs = docs, spark.read.parquet(path)
        if i < len(P.STAGES) - 1:
            assert docs.columns == table(spark, SMALL, "documents").columns, name
            assert docs.join(before.select("doc_id"), "doc_id", "left_anti").count() == 0
            assert docs.where(F.col("n_chars") != F.char_length("text")).count() == 0
    assert 0 < before.count() < start
    assert docs.select("doc_id").distinct().count() == before.select("doc_id").distinct().count()
    assert docs.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 4096").count() == 0


def test_names():
    assert [n for n, _ in P.STAGES] == ["quality rules", "line dedup", "near dedup", "suffix dedup", "packing"]
    assert P.ORACLE_SQL is None


def test_passages_of_over_50_words(spark):
    """Repeats of 51 to 65 words go however few bytes they have, as do shorter ones of 400 bytes; 50 short words stay."""
    words = lambda tag, n: [f"{tag}{i}" for i in range(n)]
    long = ["l" * 40 + str(i) for i in range(11)]
    passages = {n: words(f"p{n}x", n) for n in (50, 51, 55, 60, 65)} | {0: long}
    rows, want = [], {}
    for n, passage in passages.items():
        for copy in range(2):
            own = [[f"{copy}{w}{copy}" for w in words(f"{side}{n}x", 60)] for side in "oe"]
            want[len(rows)] = "".join([*own[0], *(passage if copy == 0 or n == 50 else []), *own[1]])
            rows.append((len(rows), " ".join([*own[0], *passage, *own[1]]), "en", "s", 0))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert {r.doc_id: "".join(r.text.split()) for r in P.suffix_dedup(spark, docs, SMALL).collect()} == want


def test_odd_rows_pass_every_stage(spark, tmp_path):
    """Null columns, repeated rows, empty texts, a column more, and no rows at all."""
    prose = " ".join(f"word{i} and {i * 7 % 90}th of them" for i in range(60))
    rows = [(1, prose, "en", "s", 3, "x"), (1, prose, "en", "s", 3, "x"), (None, prose + " end", None, None, None, None), (2, None, "en", "s", 0, "x"), (3, "", None, "s", 0, "x"), (4, "few words", "en", "s", 9, "x")]
    rows.append((5, " ".join(f"other{i} unique{i}x own{i}y" for i in range(40)), None, None, None, None))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, row string")
    shape = ["doc_id", "text", "lang", "source", "n_chars"]
    left = []
    for start in (docs, docs.limit(0)):
        for i, (name, stage) in enumerate(P.STAGES):
            path = str(tmp_path / f"{len(left)}-{i}")
            stage(spark, start, SMALL).write.parquet(path)
            start = spark.read.parquet(path)
            assert name == "packing" or start.columns == shape
        left.append(sorted({r.doc_id for r in start.collect()}, key=lambda i: (i is None, i)))
    assert left == [[1, 5], []]  # short and empty texts fail the base rules; of the near copies the least id stays
