from pyspark.sql import functions as F

from verdigris.functions import questions as Q


def row(spark, *columns):
    return spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first()


def test_questions(spark):
    q = F.lit("23级CS  学份多少")
    r = row(
        spark,
        Q.rewritten(q),
        Q.rewritten(F.lit("2023届智能专业")),
        Q.expansions(F.lit("挂科了还能保研吗，挂过")),
        Q.cohort_covered(F.lit("2023级推免"), F.array(F.lit("2022"))),
        Q.cohort_covered(F.lit("2023级推免"), F.array(F.lit("2023"))),
        Q.cohort_covered(F.lit("2023级作息"), F.array(F.lit("2022"))),
    )
    assert tuple(r) == ("2023级计算机科学与技术专业 学分多少", "2023级人工智能专业", ["不及格", "重修", "推免", "推荐免试"], False, True, True)


def test_sentences(spark):
    r = row(spark, Q.sentences(F.lit("甲[1]。乙！\n丙")), Q.exempt(F.lit("[1]。")), Q.exempt(F.lit("要求如下：")), Q.exempt(F.lit("需要4学分")), Q.cited_at_end(F.lit("甲[1][2]。")), Q.cited_at_end(F.lit("甲[1]乙")))
    assert tuple(r) == (["甲[1]。", "乙！", "丙"], True, True, False, True, False)


def test_payload_and_urls(spark):
    r = row(
        spark,
        Q.fenced_json(F.lit('```json\n{"a": 2}\n```'), "a int")["a"],
        Q.page_url(F.lit("https://x/p.htm"), F.lit("https://x/f.PDF#z"), F.lit("原文件第12页")),
        Q.page_url(F.lit("https://x/p.htm"), F.lit("https://x/f.doc"), F.lit("第3页")),
        Q.search_text(F.lit("T"), F.lit("A"), F.lit("x")),
        Q.logical_lines(F.lit("总则 第二条 内容\n\n尾")),
    )
    assert tuple(r) == (2, "https://x/f.PDF#page=12", "https://x/p.htm", "T\nT\nA\nA\nA\nx", ["总则", "第二条 内容", "尾"])
