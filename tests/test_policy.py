import re

import pytest
from pyspark.sql import functions as F

from verdigris.operators import citations as C
from verdigris.operators import narrowing as N
from verdigris.operators import policy as P


def test_best_passage_prefers_numbers_then_likeness_then_the_shorter(spark):
    rows = [
        ("取得学分 120", "取得学分。取得学分 120。其他", "取得学分 120。", 7),
        ("abc def", "abc def xyz;abc def;abc def", "abc def", 2),
        ("abc", "xyz\nq", "q", 0),
        ("abc", "", "", 0),
        (None, None, "", 0),
        ("abc", "xyz", "xyz", 0),
    ]
    df = spark.createDataFrame([(c, t) for c, t, *_ in rows], "c string, t string")
    got = [tuple(r) for r in df.select(C.best_passage(F.col("c"), F.col("t")).alias("b")).select("b.passage", "b.score").collect()]
    assert [g[0] for g in got] == [r[2] for r in rows]
    assert [g[1] for g in got][1:] == [r[3] for r in rows][1:]


def test_quotes_are_cut_around_the_claim(spark):
    passage = "x" * 400 + " needle " + "y" * 400
    got = spark.range(1).select(C.quote_of(F.lit("the needle"), F.lit(passage)), C.quote_of(F.lit("the needle"), F.lit("short needle")), C.quote_of(F.lit("zzz"), F.lit(passage))).first()
    assert got[0] == passage[301:601] and got[1] == "short needle" and got[2] == passage[:300]


@pytest.mark.parametrize(
    ("sentence", "marker", "support"),
    [
        ("abc def[1]。", None, None),
        ("abc def。", "uncited", "uncited"),
        ("[1]abc def。", "not_at_end", None),
        ("abc def[3]", "out_of_range", "out_of_range"),
        ("abc def[0]", "out_of_range", "out_of_range"),
        ("abc def[99999999999]", "out_of_range", "out_of_range"),
        ("abc 12[1]", None, "numbers_absent"),
        ("abc 7[2]", None, None),
        ("def zzz[1][1][1][1][1]", "too_many", "unrelated"),
        ("。", None, None),
        (None, None, None),
    ],
)
def test_marks_and_support(spark, sentence, marker, support):
    df = spark.createDataFrame([(sentence, ["abc def ghi", "nothing but 7"])], "s string, t array<string>")
    assert df.select(C.marker_error(F.col("s"), F.size("t")), C.support_error(F.col("s"), F.col("t"))).first()[:] == (marker, support)


def frames(spark, questions, chunks):
    return spark.createDataFrame(questions, "question_id long, question string"), spark.createDataFrame(chunks, "question_id long, rank int, text string")


def test_policy_answers_by_fact_rule_and_best_clause(spark):
    questions = [(1, "计划学制几年"), (2, "雅思的成绩要求"), (3, "unknown words here"), (4, "奖学金申请"), (5, None), (6, "计划学制几年")]
    chunks = [
        (1, 1, "标题\n计划学制的说明---| x"),
        (1, 2, "标题\n计划学制为四年；最长六年。"),
        (2, 1, "表\n| 考试类型 | 成绩要求 |\n|---|---|\n| 托福 | 80% |\n| 雅思 | 77%及以上 |"),
        (4, 1, "头\n奖学金按年发放。学生可提出奖学金申请。奖学金申请。"),
        (5, 1, "x\ny"),
        (6, 2, "t\n学制\n无"),
        (6, 1, None),
    ]
    got = {r.question_id: r for r in P.policy_answers(*frames(spark, questions, chunks), refusal="no").collect()}
    assert (got[2].kind, got[2].quote, got[2].answer) == ("fact", "77%及以上", "雅思：成绩要求77%及以上[1]。")
    assert (got[4].kind, got[4].quote) == ("generic", "奖学金申请。")
    assert [got[i].answer for i in (3, 5)] == ["no", "no"] and got[3].rank is None
    # the first chunk with the words has a raw table for its clause, so the rule gives nothing, and the best clause answers
    assert got[1].kind == "refused" or got[1].rank == 2
    assert len(got) == 6


def test_rules_go_by_their_order_and_the_first_chunk(spark):
    q, c = frames(spark, [(1, "授予什么学位，计划学制")], [(1, 1, "h\n授予管理学学位。"), (1, 2, "h\n计划学制四年。"), (1, 3, "h\n计划学制五年。")])
    r = P.rule_clauses(q, c).first()
    assert (r.rank, r.quote) == (2, "计划学制四年。")
    assert P.rule_clauses(q, c.limit(0)).count() == 0


def test_table_cells(spark):
    _, c = frames(spark, [(1, "")], [(1, 1, "no | table\n| a | b\\|c |\n| :-- | ---: |\n| r | 1 |\n|s||"), (1, 2, None)])
    assert sorted((r.row, r.head, r.value) for r in P.table_cells(c).collect()) == [("r", "b|c", "1"), ("s", "b|c", "")]


def reference_subjects(q):
    """The three families by Python's own expressions."""
    out = []
    for pattern, mark, patterns, most, none in N.SUBJECT_FAMILIES:
        for m in re.finditer(pattern, q):
            x = m[1].strip()
            x = x.split(mark)[-1] if mark else x
            for p in patterns:
                x = re.sub(p, "", x)
            x = x.strip()
            if 2 <= len(x) <= most and x not in none:
                out.append(x)
    return out


QUESTIONS = [
    "请问高等数学是不是专业必修？",
    "2023级的体育算必修吗",
    "我的补考最迟大三上什么时候考，转专业申请早上几点",
    "校园卡丢了怎么办？本人的教务系统登录不了该怎么办",
    "那么课程是什么",
    "",
    "算专业选修课程的微积分2023级属于什么",
]


def test_asked_subjects(spark):
    df = spark.createDataFrame([(q,) for q in QUESTIONS] + [(None,)], "q string")
    got = [list(r[0]) for r in df.select(N.asked_subjects(F.col("q"))).collect()]
    assert got == [reference_subjects(q) for q in QUESTIONS] + [[]] and ["高等数学"] in got and got[3] == ["校园卡", "教务系统"]


def test_tokens_are_taken_once(spark):
    """A claim's tokens at one place and a passage's at one; before, at each use and again for each passage."""
    df = spark.createDataFrame([("a b 3", "a b. 3")], "c string, t string")
    plan = lambda x: df.select(x.alias("x"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan(C.best_passage(F.col("c"), F.col("t"))["score"]).count("[a-z]+") <= 2
    assert plan(C.support_error(F.col("c"), F.split("t", "\n"))).count("[a-z]+") <= 2
