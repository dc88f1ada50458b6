import re

from pyspark.sql import functions as F

from verdigris.operators import passages as P
from verdigris.sources.driver_tables import values


def brute(scores, passages, text, limit, enough):
    """The excerpt by a plain loop over scored passages."""
    if len(text) <= limit:
        return text
    if not passages:
        return text[:limit]
    order = sorted(range(len(passages)), key=lambda i: (-scores[i], i))
    taken, used = [], 0
    for i in order:
        cost = len(passages[i]) + (3 if taken else 0)
        if used + cost <= limit:
            taken.append(i)
            used += cost
        if used >= min(limit, enough):
            break
    return "\n…\n".join(passages[i] for i in sorted(taken)) if taken else passages[order[0]][:limit]


def test_excerpts_by_a_plain_loop(spark):
    texts = ["短。", "", None, "\n" * 40, "字" * 60, "第3条 a。" + "b " * 9 + "。MAT101 12；第3条 MAT-101！end of it? tail", "a。" * 30, "；；；" * 20, "x" * 25 + "。" + "mat101。" * 4]
    rows = values(spark, "n int, t string", list(enumerate(texts)))
    asked = F.lit("MAT 101 第3条 12 a")
    scored = F.transform(P.passages_of(F.col("t")), lambda x: P.passage_score(asked, x))
    got = rows.select("t", P.passages_of(F.col("t")).alias("p"), scored.alias("s"), P.excerpt(asked, F.col("t"), 30, 20).alias("e")).collect()
    for r in got:
        t = r["t"] or ""
        assert r["p"] == [m.strip() for m in re.findall(r"[^\n。！？!?；;]+[。！？!?；;]?|[^\n]+", t) if m.strip()]
        assert r["e"] == brute(r["s"], r["p"], t, 30, 20)
        assert len(r["e"]) <= 30


def test_scores(spark):
    rows = values(spark, "q string, p string", [("第3条是什么 MAT101", "第3条 mat-101"), ("x", "《办法》"), (None, None), ("几门课", "选 3 门")])
    got = [round(r[0], 6) for r in rows.select(P.passage_score(F.col("q"), F.col("p"))).collect()]
    assert got[0] > 3.2 and got[1] == -2.0 and got[2] == 0.0 and got[3] >= 1.2


def test_question_semesters(spark):
    rows = values(spark, "q string", [("第一学期、第1学期",), ("大四下",), ("大二",), (None,)])
    assert [r[0] for r in rows.select(P.question_semesters(F.col("q"))).collect()] == [["1"], ["8"], ["3", "4"], []]


def test_clarification_without_majors(spark):
    rows = values(spark, "m string", [("major",)]).select(F.split("m", ",").alias("m"), F.lit(None).cast("array<string>").alias("n"))
    assert rows.select(P.clarification(F.col("m"), F.col("n"))).first()[0].endswith("准确查询。")


def test_passages_are_normalised_and_exclamation_marks_keep_a_header(spark):
    score = lambda q, p: spark.range(1).select(P.passage_score(F.lit(q), F.lit(p))).first()[0]
    assert score("毕业学分", "毕业学份 2") == score("毕业学分", "毕业学分 2") > score("毕业学分", "2") + 0.5
    assert score("abc", "《规定》abc!") == score("abc", "《规定》abc") < 0 < score("abc", "《规定》abc！")


def test_passages_are_scored_once(spark):
    """An excerpt scored all passages at each use of their order, and took the question's tokens for each of them."""
    plan = spark.range(1).select(P.excerpt(F.lit("q"), F.col("id").cast("string"), 8, 6).alias("x"))._jdf.queryExecution().analyzed().toString()
    assert plan.count("[a-z]+") <= 2
