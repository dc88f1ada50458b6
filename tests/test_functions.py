from pyspark.sql import functions as F

from verdigris.functions import terms, text
from verdigris.functions.subjects import subjects_of


def one(spark, column, *values):
    """The column over rows of v."""
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in rows.orderBy("i").select(column).collect()]


def test_semesters(spark):
    cells = ("1", "1-2", "3—6", "S2", "未标注", "", None, "2,4", "6～3", "12", "第5学期")
    assert one(spark, terms.semester_values(F.col("v")), *cells) == [[1], [1, 2], [3, 4, 5, 6], [], [], [], [], [2, 4], [3, 4, 5, 6], [], [5]]
    assert one(spark, terms.semester_positions(F.col("v")), *cells)[3] == [4.5]
    assert one(spark, terms.semester_display(F.col("v")), "s1", None, " 3 ") == ["暑期学期1", "未标注", "3"]
    assert one(spark, terms.semester_sort_key(F.col("v")), "S2", "3—6", None, "x") == [4, 3, 99, 99]
    assert one(spark, terms.leading_semester(F.col("v")), "S2", "3", None) == [0, 3, None]


def test_compaction(spark):
    assert one(spark, text.compact_listed(F.col("v")), "A·B（c）-1+", None) == ["abc1+", ""]
    assert one(spark, text.compact_strict(F.col("v")), "A·B（c）-1+") == ["abc1"]
    assert one(spark, text.compact_roman(F.col("v")), "英语Ⅱ") == ["英语ii"]


def test_tokens(spark):
    assert one(spark, text.tokens(F.col("v")), "ENG101 学分制 3.5%", "学", None) == [["eng101", "3.5%", "学分", "分制", "学", "分", "制"], ["学"], []]
    assert one(spark, text.token_set(F.col("v")), "学分 学分 a a") == [["a", "学分"]]


def test_hash_ignores_header_pages_and_space(spark):
    a, b, c = one(spark, text.content_hash(F.col("v")), "标题\n正文 第3页表格 A", "别的\n正文a", "正文b")
    assert a == b != c


def test_course_names(spark):
    assert one(spark, text.clean_course_name(F.col("v")), "[A1]高等 数学 Advanced Math", "大学英语） B", None) == ["高等数学", "大学英语）", ""]


def test_subjects(spark):
    rows = spark.createDataFrame([("Python程序设计", "CST101"), ("数据结构与算法", "XXX"), ("大学英语", "ENG1"), (None, None)], "n string, c string")
    got = [r[0] for r in rows.select(subjects_of(F.col("n"), F.col("c"), F.lit(None), F.lit(None))).collect()]
    assert got == [["computing", "programming"], ["computing"], ["foreign_language"], []]


def test_domain(spark):
    assert one(spark, text.in_domain(F.col("v"), "a.cn"), "https://x.a.cn/1", "http://a.cn", "https://ba.cn", "ftp://a.cn", None, "https://a.cn@evil.org") == [True, True, False, False, False, False]
