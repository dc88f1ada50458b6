import json
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from verdigris.operators import catalog_build as B
from verdigris.operators import headings as H
from verdigris.plans import queries_catalog as Q
from verdigris.sources import snapshots as S

from compare import SMALL


def brute_catalog(rows, pages):
    """The catalog by a loop over each file's rows, for cells as table_stream makes them."""
    label = {}
    for file, page, text in pages:
        m = re.search(H.PAGE_HEADING, text)
        if m:
            label[file, page] = " ".join(m[1].split())
    courses, modules = {}, {}
    major = module = file_now = page_now = None
    for r in sorted(rows, key=lambda r: (r.file, r.page, r.seq)):
        if r.file != file_now:
            major = module = page_now = None
            file_now = r.file
        if r.page != page_now:
            page_now = r.page
            # headings of pages in between count as well
            for p in sorted(p for f, p in label if f == r.file and p <= r.page):
                pass
        new = max((p for f, p in label if f == r.file and p <= r.page), default=None)
        if new is not None and label[r.file, new] != major:
            major, module = label[r.file, new], None
        if major is None:
            continue
        line = " | ".join(r.cells)
        m = re.search(B.LEAST_CREDITS, line)
        if re.fullmatch(r"ABC\d{3}", r.cells[0]):
            credits = float(r.cells[2])
            if not 0 < credits <= 30:
                continue
            if module:
                courses.setdefault((r.cohort, major, module, r.cells[0]), {"name": r.cells[1], "credits": credits, "nature": r.cells[4], "college": r.college, "title": r.source_title})
                modules.setdefault((r.cohort, major, module), {"title": r.source_title, "least": None, "rule": "", "total": None})
            continue
        if re.match(B.MODULE_HEADING, r.cells[0]):
            module = r.cells[0]
            modules.setdefault((r.cohort, major, module), {"title": r.source_title, "least": None, "rule": "", "total": None})
        elif module and m:
            modules[r.cohort, major, module] |= {"least": float(m[1]), "rule": line}
        elif module and r.cells[0] == "合计":
            modules[r.cohort, major, module]["total"] = float(r.cells[1])
    plans = defaultdict(list)
    for (cohort, major, module), m in sorted(modules.items()):
        own = {k[3]: c for k, c in courses.items() if k[:3] == (cohort, major, module)}
        total = round(sum(c["credits"] for c in own.values()), 2)
        least = m["least"]
        if least is None and own and all("必修" in c["nature"] for c in own.values()):
            least = m["total"] or total
        constraints, stem = [], major.removesuffix("专业")
        sentence = next((x for x in re.split("[。；;]", m["rule"]) if stem in x), "")
        if "必须选修" in sentence:
            titles = [t.replace("课程", "") for t in re.findall("《([^》]+)》", sentence)]
            codes = sorted({code for code, c in own.items() for t in titles if t in c["name"].replace("课程", "") or c["name"].replace("课程", "") in t})
            constraints = [{"type": "all_of", "course_codes": codes}] if codes else []
        plans[cohort, major].append(
            {"name": module, "required_credits": least, "listed_credits": m["total"], "rule_text": m["rule"], "source_title": m["title"], "catalog_credits": total, "course_count": len(own), "constraints": constraints}
        )
    held = defaultdict(int)
    for cohort, major, *_ in courses:
        held[cohort, major] += 1
    return {k: {"college": "学院甲", "cohort": k[0], "major": k[1], "source_title": v[0]["source_title"], "course_count": held[k], "modules": v} for k, v in plans.items() if held[k]}, courses


def test_catalog_against_a_loop(spark):
    rows, pages = Q.table_stream(spark, SMALL)
    want, courses = brute_catalog(rows.collect(), [tuple(r) for r in pages.select("file", "page", "text").collect()])
    got = Q.catalog_plans(spark, SMALL).collect()
    assert {(r.cohort, r.major): json.loads(r.document) for r in got} == want
    assert any(m["constraints"] for p in want.values() for m in p["modules"]) and len({k[1] for k in want}) == 5
    assert all(r.n_modules == len(want[r.cohort, r.major]["modules"]) for r in got)
    kept = Q.catalog_snapshot(spark, SMALL).collect()
    assert {(r.cohort, r.major, r.module, r.code): (r.name, r.credits) for r in kept} == {k: (c["name"], c["credits"]) for k, c in courses.items()}
    assert {(r.plan_count, r.course_count) for r in kept} == {(len(want), len(courses))}


def test_headings_of_a_page(spark):
    pages = spark.createDataFrame([("a", 1, "金融学专业 2023 级本科人才培养方案 会计学专业2023级本科人才培养方案"), ("a", 2, None), ("a", 3, ""), ("b", 1, "无")], "file string, page int, text string")
    found = H.candidates(pages, ["file"], "page", "text")
    assert [(r.file, r.page, r.label) for r in H.page_labels(found, ["file"], "page").collect()] == [("a", 1, "金融学专业")]


def test_contested_pages_end_an_interval(spark):
    labels = spark.createDataFrame([("a", 2, "x", False), ("a", 4, "x", False), ("a", 5, None, True), ("a", 7, "x", False), ("a", 8, "y", False)], "file string, page int, label string, contested boolean")
    last = spark.createDataFrame([("a", 9), ("b", 3)], "file string, last int")
    got = sorted((r.label, r.first_page, r.last_page) for r in H.label_intervals(labels, last, ["file"], "page", "last").collect())
    assert got == [("x", 2, 4), ("x", 7, 7), ("y", 8, 9)]
    assert H.label_intervals(labels.limit(0), last, ["file"], "page", "last").count() == 0


def test_settled(spark):
    rows = [("a", "x", 1, 3, 1), ("a", "y", 3, 4, 0), ("a", "z", 4, 5, 0), ("a", "x", 1, 1, 1)]
    got = H.settled(spark.createDataFrame(rows, "file string, label string, first_page int, last_page int, priority int"), ["file"]).collect()
    assert sorted((r.page, r.label, r.agreed) for r in got) == [(1, "x", True), (2, "x", True), (3, "y", False), (5, "z", True)]


@pytest.mark.parametrize(
    ("text", "one", "two"),
    [
        ("专业类基本信息 标准学制：四年 020301K—金融学、020302-金融工程 学科门类：经济学", ["金融学、020302-金融工程"], None),
        ("专业代码：020301K — 金融学/投资学 020302—金融工程，授予学位 020399—x 标准学制 020400—保险学", ["金融学/投资学", "金融工程", "保险学"], ["金融学", "投资学", "金融工程"]),
        (None, [], []),
    ],
)
def test_listed_names(spark, text, one, two):
    df = spark.createDataFrame([(text,)], "t string")
    both = df.select(H.listed_names(F.col("t")), H.listed_names(F.col("t"), between=H.BETWEEN_NAMES, begin=H.BLOCK_BEGIN, stop=H.BLOCK_END)).first()
    if two is None:
        assert both[0] == ["金融学", "金融工程"]
    else:
        assert both[0] == one and both[1] == two


def test_category_majors(spark):
    df = spark.createDataFrame([("金融学类专业人才培养方案", "020301—金融学 020302—投资学"), ("金融学类人才培养方案", ""), ("会计学专业人才培养方案", "020301—金融学")], "a string, t string")
    assert [r[0] for r in df.select(H.category_majors(F.col("a"), F.col("t"))).collect()] == [["金融学", "投资学"], ["金融学类"], ["会计学"]]
    assert spark.range(1).select(H.direction_major(F.lit("方向二：金融科技专业核心课程")), H.direction_major(F.lit("一、课程"))).first()[:] == ("金融科技专业", None)


def frame(spark, rows):
    return spark.createDataFrame(rows, "place long, text string")


def test_a_job_that_stops_before_the_pointer_leaves_the_old_snapshot(spark):
    path = S.new_folder(spark, "test-snapshot")
    with pytest.raises(FileNotFoundError):
        S.current(spark, path)
    assert S.publish({"rows": frame(spark, [(1, "a")])}, path, "1") == 1
    name = S.stage({"rows": frame(spark, [(1, "b"), (2, "c")])}, path, "2")  # rows and manifest are there, the pointer isn't
    assert [r.text for r in S.read(spark, path, "rows", "1").collect()] == ["a"]
    with pytest.raises(ValueError):
        S.read(spark, path, "rows", "2")
    assert S.point(spark, path, name) == 2
    assert sorted(r.text for r in S.read(spark, path, "rows", "2").collect()) == ["b", "c"]


def test_rebind_heeds_the_order(spark):
    path = S.new_folder(spark, "test-rebind")
    S.publish({"rows": frame(spark, [(1, "a"), (2, "b")]), "other": frame(spark, [(9, "z")])}, path, "1", ordinal={"rows": "place"})
    for other in ([(1, "b"), (2, "a")], [(1, "a")], [(1, "a"), (2, None)]):
        with pytest.raises(ValueError):
            S.rebind(frame(spark, other), path, "rows", "place", "2")
    assert S.current(spark, path)[1]["version"] == "1"
    S.rebind(frame(spark, [(2, "b"), (1, "a")]), path, "rows", "place", "2")
    assert S.read(spark, path, "rows", "2").count() == 2 and S.read(spark, path, "other", "2").count() == 1
    S.rebind(frame(spark, [(2, "b"), (1, "a")]), path, "rows", "place", "3")
    assert S.read(spark, path, "rows", "3").count() == 2


def test_snapshot_counts_what_is_written(spark, tmp_path):
    """Before, plans and courses were built a second time for their counts."""
    runs = spark.sparkContext.accumulator(0)

    def seen(batches):
        for b in batches:
            runs.add(b.num_rows)
            yield b

    plans = spark.range(3).repartition(1).mapInArrow(seen, "id bigint")
    S.write_catalog(plans, spark.range(5), str(tmp_path), generated_at="", source_sha256="", version="1")
    facts = S.current(spark, str(tmp_path))[1]["facts"]
    assert (facts["plan_count"], facts["course_count"], runs.value) == (3, 5, 3)
