"""Answers from policy texts: a table's fact, a rule's clause, or the clause that names most of the question."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import body, text_of
from ..sources.driver_tables import values

# What a clause is, which texts are raw tables, the limits, and words that say nothing.
CLAUSE = r"([^。；;\n]+[。；;]?)"
RAW_TABLE = r"原表[:：]|Course\s+Credi|Weekly\s+Total|---\s*\|"
RULE_CHARS, CLAUSE_CHARS = 520, 360
WORDS = r"([一-鿿]{2,8}|[A-Za-z]{2,}\d*)"
NO_WORDS = ("哪些课程", "多少学分", "是什么", "有哪些", "专业2023级")
EDGES = " |，,；;。\n"
#: Fixed values, in order: what a question asks and what the clause that answers it says.
CLAUSE_RULES = (
    (r"毕业学分.*范围|建议.*毕业.*学分", ("建议毕业学分要求",)),
    (r"每学期.*(?:最多|至多|不超过)", ("每学期修读课程学分数不超过",)),
    (r"通识教育核心.*学分", ("通识教育核心课程须取得",)),
    (r"跨专业选修.*学分", ("跨专业选修课程须取得",)),
    (r"至少.*艺术类|艺术类.*几门", ("至少 1 门艺术类课程",)),
    (r"理工类.*实践教学", ("理工类本科专业不少于",)),
    (r"新财经.*场景化", ("新财经", "场景化教学项目课程")),
    (r"新财经", ("不少于3门", "新财经")),
    (r"大学科基础课程.*多少门", ("大学科基础课程为7门",)),
    (r"专业课程.*第几个学期", ("专业课程:自第二学年第二学期",)),
    (r"选修课程.*第几个学期", ("选修课程:从第二学年第一学期",)),
    (r"春季学期.*秋季学期|秋季学期.*春季学期", ("教学周数均为19周",)),
    (r"暑期学期.*教学周", ("暑期学期的教学周数为2周",)),
    (r"计划学制", ("计划学制",)),
    (r"最长修业年限|最长.*年限", ("最长", "年")),
    (r"授予.*学位|什么学位", ("授予", "学位")),
    (r"专业准入", ("专业准入课程:",)),
    (r"专业准出", ("专业准出课程:",)),
    (r"科技竞赛.*证明", ("科技竞赛", "证明")),
)


def clauses(text: Column) -> Column:
    """The clauses after a chunk's first line, or of its only one, without white space at their ends."""
    return F.filter(F.transform(F.regexp_extract_all(body(text_of(text)), F.lit(CLAUSE), F.lit(1)), lambda x: F.btrim(x, F.lit(" \t\r\n"))), lambda x: x != "")


def clause_with(text: Column, needles: Column, most: int = RULE_CHARS) -> Column:
    """The first clause that holds all needles; null if none does."""
    return F.get(F.filter(clauses(text), lambda c: (F.char_length(c) <= most) & F.forall(needles, lambda n: F.contains(c, n))), F.lit(0))


def rule_clauses(questions: DataFrame, chunks: DataFrame, rules=CLAUSE_RULES) -> DataFrame:
    """(question_id, rule, rank, quote): of the rules that a question triggers, in order, the first whose first chunk has the clause.

    questions: (question_id, question); chunks: (question_id, rank, text), what was
    retrieved for each. The rules are a table of literals, a row each.
    """
    spark = questions.sparkSession
    table = values(spark, "rule int, pattern string, needle string", [(i, p, "\u0001".join(n)) for i, (p, n) in enumerate(rules)])
    table = F.broadcast(table.select("rule", "pattern", F.split("needle", "\u0001").alias("needles")))
    asked = questions.join(table, F.expr("coalesce(question, '') rlike pattern")).select("question_id", "rule", "needles")
    met = chunks.join(asked, "question_id").where(F.forall("needles", lambda n: F.contains(text_of(F.col("text")), n)))
    first = met.groupBy("question_id", "rule").agg(F.min_by(F.struct("rank", "text", "needles"), "rank").alias("m"))
    quoted = first.select("question_id", "rule", "m.rank", clause_with(F.col("m.text"), F.col("m.needles")).alias("quote"))
    good = quoted.where(F.col("quote").isNotNull() & ~F.col("quote").rlike(RAW_TABLE))
    return good.groupBy("question_id").agg(F.min(F.struct("rule", "rank", "quote")).alias("m")).select("question_id", "m.*")


def table_cells(chunks: DataFrame) -> DataFrame:
    """(question_id, rank, place, row, head, value) of the cells of Markdown tables: place in reading order, row the first cell of the line, head the column's.

    A table is a run of lines that begin with |; its first line is the header, a line of dashes is none.
    """
    lines = chunks.select("question_id", "rank", F.posexplode(F.split(text_of(F.col("text")), "\n", -1)).alias("line", "raw"))
    listed = lines.where(F.trim("raw").startswith("|")).withColumn("cells", F.transform(F.split(F.regexp_replace(F.trim("raw"), r"^\||\|$", ""), r"(?<!\\)\|", -1), lambda c: F.replace(F.trim(c), F.lit("\\|"), F.lit("|"))))
    listed = listed.where(~F.forall("cells", lambda c: c.rlike(r"^:?-*:?$")))
    # lines of one table follow one another: their number less their place is the same
    each = listed.groupBy("question_id", "rank").agg(F.array_sort(F.collect_list(F.struct("line", "cells"))).alias("lines"))
    numbered = each.select("question_id", "rank", F.posexplode("lines").alias("n", "l"), F.col("lines").alias("all"))
    head = F.get(F.col("all"), F.lit(0))["cells"]
    cell = numbered.where("n > 0").select("question_id", "rank", F.col("l.line").alias("line"), F.get("l.cells", F.lit(0)).alias("row"), head.alias("heads"), F.posexplode("l.cells").alias("at", "value"))
    return cell.where("at > 0").select("question_id", "rank", (F.col("line") * 1000 + F.col("at")).alias("place"), "row", F.get("heads", F.col("at")).alias("head"), "value")


def table_facts(questions: DataFrame, chunks: DataFrame) -> DataFrame:
    """(question_id, rank, row, head, value): the first cell whose row and column a question both names, letters of either case alike."""
    asked = table_cells(chunks).join(questions, "question_id")
    named = lambda c: (F.col(c) != "") & F.contains(F.lower("question"), F.lower(c))
    hit = asked.where(named("row") & named("head") & (F.col("value") != ""))
    first = hit.groupBy("question_id").agg(F.min(F.struct("rank", "place", "row", "head", "value")).alias("m"))
    return first.select("question_id", "m.rank", "m.row", "m.head", "m.value")


def best_clauses(questions: DataFrame, chunks: DataFrame) -> DataFrame:
    """(question_id, rank, score, quote): the clause that holds most of the question's words, one at least; then the shortest, then the first."""
    words = F.filter(F.regexp_extract_all(text_of(F.col("question")), F.lit(WORDS), F.lit(1)), lambda w: ~w.isin(*NO_WORDS))
    each = chunks.select("question_id", "rank", F.posexplode(clauses(F.col("text"))).alias("place", "quote")).where((F.char_length("quote") <= CLAUSE_CHARS) & ~F.col("quote").rlike(RAW_TABLE))
    met = each.join(questions.select("question_id", words.alias("words")), "question_id").withColumn("score", F.size(F.filter("words", lambda w: F.contains(F.col("quote"), w))))
    best = met.where("score > 0").groupBy("question_id").agg(F.min(F.struct((-F.col("score")).alias("s"), F.char_length("quote").alias("n"), "rank", "place", "quote")).alias("m"))
    return best.select("question_id", "m.rank", (-F.col("m.s")).alias("score"), "m.quote")


def policy_answers(questions: DataFrame, chunks: DataFrame, rules=CLAUSE_RULES, refusal: str = "") -> DataFrame:
    """(question_id, kind, rank, quote, answer): a table's fact, else a rule's clause, else the best clause, else the refusal.

    The quote stands in the chunk as it is; the answer is the quote, or the fact in
    words, without marks at its ends and with the chunk's number. A question
    without chunks is refused; repeated chunks are no matter.
    """
    fact = table_facts(questions, chunks).select("question_id", F.struct("rank", F.col("value").alias("quote"), F.concat("row", F.lit("："), "head", "value").alias("said")).alias("fact"))
    rule = rule_clauses(questions, chunks, rules).select("question_id", F.struct("rank", "quote", F.col("quote").alias("said")).alias("clause"))
    best = best_clauses(questions, chunks).select("question_id", F.struct("rank", "quote", F.col("quote").alias("said")).alias("generic"))
    a = questions.select("question_id").join(fact, "question_id", "left").join(rule, "question_id", "left").join(best, "question_id", "left")
    found = F.coalesce("fact", "clause", "generic")
    kind = F.when(F.col("fact").isNotNull(), "fact").when(F.col("clause").isNotNull(), "clause").when(F.col("generic").isNotNull(), "generic").otherwise("refused")
    text = F.btrim(F.regexp_replace(found["said"], r"\s+", " "), F.lit(EDGES))
    told = (kind != "refused") & (text != "")
    answer = F.when(told, F.concat(text, F.lit("["), found["rank"].cast("string"), F.lit("]。"))).otherwise(refusal)
    return a.select("question_id", F.when(told, kind).otherwise("refused").alias("kind"), F.when(told, found["rank"]).alias("rank"), F.when(told, found["quote"]).alias("quote"), answer.alias("answer"))
