import json

import pytest
from pyspark.sql import functions as F

from verdigris.sources import registry, sinks

GOOD = {"chunk_id": "c1", "text": "t", "doc_title": "d", "level": "校级", "college": "全校", "cohort": "2023", "year": 2023, "status": "现行", "article": "a", "page_url": "https://x.cn/p", "file_url": "https://x.cn/f", "is_table": False}


def write(path, rows):
    path.write_text("".join((r if isinstance(r, str) else json.dumps(r, ensure_ascii=False)) + "\n" for r in rows), encoding="utf-8")
    return str(path)


def test_chunks(spark, tmp_path):
    assert registry.read_chunks(spark, write(tmp_path / "a.jsonl", [GOOD, "", GOOD | {"chunk_id": "c2"}])).count() == 2
    for i, bad in enumerate(([GOOD, GOOD], [GOOD | {"college": "X"}], ["{oops"], [GOOD | {"year": 1800}], [])):
        with pytest.raises(registry.BadRows):
            registry.read_chunks(spark, write(tmp_path / f"b{i}.jsonl", bad))


def test_registry(spark, tmp_path):
    head = ",".join(registry.REGISTRY_FIELDS)
    row = "a/b.pdf,T,校级,全校,2023,2023,现行,https://x.cn/p,https://www.x.cn/f,2024-01-02"
    good = tmp_path / "s.csv"
    good.write_text(f"{head}\n{row}\n", encoding="utf-8")
    rows = registry.check_registry(registry.read_registry(spark, str(good)), "x.cn")
    assert rows.first().year == 2023
    for i, bad in enumerate((row.replace("a/b.pdf", "C:\\b.pdf"), row.replace("a/b.pdf", "../b.pdf"), row.replace(".pdf", ".doc"), row.replace("https://x.cn/p", "https://y.cn/p"), row.replace("2024-01-02", "soon"), f"{row}\n{row}")):
        path = tmp_path / f"bad{i}.csv"
        path.write_text(f"{head}\n{bad}\n", encoding="utf-8")
        with pytest.raises(registry.BadRows):
            registry.check_registry(registry.read_registry(spark, str(path)), "x.cn")


def test_publish_once(spark, tmp_path):
    df = spark.range(5).withColumn("v", F.lit("x"))
    path = str(tmp_path / "out")
    assert sinks.publish_if_changed(df, path, "1")
    assert not sinks.publish_if_changed(df.orderBy(F.desc("id")), path, "1")
    assert sinks.publish_if_changed(df.limit(4), path, "1")
    assert sinks.read_published(spark, path, "1").count() == 4
    with pytest.raises(ValueError):
        sinks.read_published(spark, path, "2")


def test_flags(spark):
    s = spark.createDataFrame([("a", True, True), ("b", False, True)], "source_id string, trusted boolean, enabled boolean")
    got = {r.source_id: (r.trusted, r.enabled) for r in sinks.set_flags(s, "b", trusted=True).collect()}
    assert got == {"a": (True, True), "b": (True, True)}
    with pytest.raises(KeyError):
        sinks.set_flags(s, "c", enabled=False)


def test_parts_and_rows(spark, tmp_path):
    path = str(tmp_path / "parts")
    sinks.write_parts(spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int"), path, "k")
    sinks.write_parts(spark.createDataFrame([("b", 3)], "k string, v int"), path, "k")
    assert sorted((r.k, r.v) for r in spark.read.parquet(path).collect()) == [("a", 1), ("b", 3)]
    a = spark.createDataFrame([(1,), (1,), (2,)], "x int")
    assert sinks.same_rows(a, a.orderBy(F.desc("x"))) and not sinks.same_rows(a, a.distinct())
