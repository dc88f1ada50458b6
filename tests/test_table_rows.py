from pyspark.sql import functions as F

from verdigris.operators import table_rows as T


def test_course_rows(spark):
    rows = [
        ["1", "mat101", "高等 数学", "4", "4", "64", "必修", "数学学院", "1-2"],
        ["MAT101", "课程名称", "4", "必修"],
        ["MAT101", "数学", "40", "必修"],
        ["MAT101", "数学", "2.5", None, "选修课"],
        ["no code", "数学", "4", "必修"],
        ["ENG200", "英语", "必修"],
        [],
    ]
    got = [r.c for r in spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, cells array<string>").select("i", T.course_of_row(F.col("cells")).alias("c")).orderBy("i").collect()]
    assert (got[0].code, got[0].name, got[0].credits, got[0].total_hours, got[0].practice_hours, got[0].nature, got[0].semester, got[0].department) == ("MAT101", "高等数学", 4.0, 64.0, None, "必修", "1-2", "数学学院")
    assert got[3].credits == 2.5 and got[3].semester == "未标注" and got[3].department == ""
    assert got[1] is got[2] is got[4] is got[5] is got[6] is None


def test_totals(spark):
    df = spark.createDataFrame([(["合计", "12.5"],), (["x", "3"],), ([None, "合计"],)], "cells array<string>")
    assert [r[0] for r in df.select(T.total_credits(F.col("cells"))).collect()] == [12.5, None, None]


def test_rules(spark):
    modules = spark.createDataFrame([(1, "2023", "金融学专业", "会计必须选修《A》。金融学必须选修《高等数学》和《英语课程》；"), (2, "2023", "金融学专业", "金融学至少选修其中一门：《英语》"), (3, "2023", "金融学专业", "金融学随意")], "module_id int, cohort string, major string, rule_text string")
    courses = spark.createDataFrame([("2023", "金融学专业", "M1", "高等数学"), ("2023", "金融学专业", "E1", "大学英语"), ("2022", "金融学专业", "E0", "英语")], "cohort string, major string, code string, name string")
    assert sorted(map(tuple, T.constraint_rules(modules, courses).collect())) == [(1, "all_of", ["E1", "M1"]), (2, "any_of", ["E1"])]


def test_normal_form(spark):
    df = spark.createDataFrame([(1, "ﬁ"), (2, None), (3, "第 一⻚\r\n\r\n\r\n\r\nＡ  b\x00"), (4, " \u00a0a \u2028 b\t\n\n")], "i int, t string")
    assert [r.t for r in T.normalised(df, "t").orderBy("i").collect()] == ["fi", None, "第一页\n\nA b", "a\nb"]


def test_row_is_cleaned_once(spark):
    """A row's cells are cleaned at one place of the plan; before, at each use."""
    rows = spark.createDataFrame([(["ABC123", "a  b", "2", "必修", "1"],), (["x", None],), (None,)], "cells array<string>")
    plan = rows.select(T.course_of_row(F.col("cells")).alias("c"))
    text = plan._jdf.queryExecution().analyzed().toString()
    assert text.count("\\s+, ") <= 3
    got = [r.c for r in plan.collect()]
    assert (got[0].code, got[0].name, got[0].credits, got[0].nature, got[0].semester) == ("ABC123", "a b", 2.0, "必修", "1")
    assert got[1] is None and got[2] is None
