from pyspark.sql import functions as F

from verdigris.operators import narrowing as N
from verdigris.sources.driver_tables import values


def test_topics_by_text_or_code(spark):
    rows = values(spark, "q string, s string, c string", [("有哪些体育课程", "游泳", "ped101"), ("有哪些体育课程", "游泳", None), ("思政课", "毛泽东思想", None), (None, "x", None)])
    assert [r[0] for r in rows.select(N.topic_filter(F.col("q"), F.col("s"), F.col("c"))).collect()] == [True, False, True, True]


def test_modules_of_other_majors_come_last(spark):
    modules = values(spark, "module string", [("跨专业选修",), ("专业选修课",)])
    none = values(spark, "place int, alias string, preferred string", [(1, "创新", "实践")])
    wishes = values(spark, "wish_id int, wish string", [(1, "选修"), (2, "跨专业选修"), (3, "创新"), (4, None)])
    found = {r["wish_id"]: r["module"] for r in N.module_for(wishes, modules, none).collect()}
    assert found == {1: "专业选修课", 2: "跨专业选修", 3: None, 4: None}


def test_entities(spark):
    rows = values(spark, "q string", [("MAT 101和mat-101是什么",), ("专业选修课 Python API",), (None,)])
    assert [r[0] for r in rows.select(N.required_entities(F.col("q"))).collect()] == [["MAT101"], ["Python", "专业选修课"], []]


def test_passages_and_links(spark):
    rows = values(spark, "p string, u string", [(" a：\n b。", "https://x.cn"), ("a", "ftp://x.cn"), (None, None), ("注：" + "字" * 13 + "！", "http:///x")])
    got = rows.select(N.cited(F.col("p"), F.lit(2), "-"), N.link_error(F.col("u"))).collect()
    assert [tuple(r) for r in got] == [("a： b[2]。", None), ("a[2]。", "url"), ("-", "empty"), ("注：" + "字" * 13 + "[2]！", "url")]


def test_steps_that_find_nothing_change_nothing(spark):
    rows = values(spark, "q int, x int", [(1, 1), (1, 2), (2, 1), (2, None)])
    out = N.narrow_in_turn(rows, ["q"], [(F.lit(True), F.col("x") == 2), (F.col("q") == 2, F.col("x") == 9)])
    assert sorted(map(tuple, out.collect()), key=repr) == [(1, 2), (2, 1), (2, None)]
