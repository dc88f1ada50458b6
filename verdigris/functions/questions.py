"""Question columns: rewriting, expansion, cohorts, sentences, payloads."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import article_page, text_of

# Rewritings in order (pattern, replacement); expansions (triggers, additions); terms that need a cohort's own evidence.
REWRITINGS = (
    (r"学份", "学分"),
    (r"(?<!\d)(\d{2})\s*(?:级|届)", "20$1级"),
    (r"(?<!\d)((?:19|20)\d{2})\s*届", "$1级"),
    (r"(?i)(?<![A-Za-z0-9])CS(?=\d{2}(?!\d))", "计算机科学与技术专业20"),
    (r"(?i)(?<![A-Za-z0-9])CS(?:专业)?(?![A-Za-z0-9])", "计算机科学与技术专业"),
    (r"计科", "计算机科学与技术专业"),
    (r"计算机科学专业", "计算机科学与技术专业"),
    (r"计算机科学(?=\s*(?:19|20)\d{2}级)", "计算机科学与技术专业"),
    (r"AI专业", "人工智能专业"),
    (r"(?<!人工)智能专业", "人工智能专业"),
    (r"C语言程序设计", "程序设计(C语言)"),
)
EXPANSIONS = (
    (("挂科", "挂过", "没及格"), ("不及格", "重修")),
    (("保研",), ("推免", "推荐免试")),
    (("专选",), ("专业选修",)),
    (("必修课",), ("必修课程",)),
    (("学分够不够", "学分够吗", "能毕业吗"), ("毕业要求", "学分")),
    (("换专业",), ("转专业",)),
    (("申请转专业前", "转专业前必须"), ("第一学年", "全部必修课程")),
    (("休学一年",), ("休学", "学籍")),
    (("计科", "计算机科学"), ("计算机科学与技术专业",)),
    (("AI专业", "智能专业"), ("人工智能专业",)),
    (("大一上", "第一学期"), ("第1学期", "开课学期")),
    (("大一下", "第二学期"), ("第2学期", "开课学期")),
    (("大一要修", "大一修什么", "大一课程"), ("第一学期", "第二学期", "开课学期", "课程设置")),
    (("专业方向课", "专业方向课程"), ("专业选修课",)),
    (("专业选修课", "专业选修课程"), ("专业方向课程",)),
    (("自选课",), ("自由选修课",)),
    (("总学分", "修满多少分"), ("毕业最低学分",)),
    (("考试必须带哪些证件", "考试带什么证件", "参加考试带哪些证件"), ("有效身份证件", "准考证")),
)
COHORT_TERMS = ("培养方案", "专业选修", "跨专业选修", "毕业最低", "毕业学分", "推免", "保研", "竞赛", "比赛", "加分")
COHORT = r"(?<!\d)((?:19|20)\d{2})\s*级"
MARKER = r"\[\d+\]"
ADVICE_START = r"^(?:建议咨询|仅供参考|以下条款仅供参考)"
INTRO_END = r"(?:如下|如下所示)$"
HEADING_AHEAD = r"(?<=\S)[ \t]*(?=第[一二三四五六七八九十百零〇\d]+[条章节]\s)"


def rewritten(question: Column) -> Column:
    """The rewritings in order, then single spaces. NFKC comes first where it matters (table_rows.normalised)."""
    out = reduce(lambda c, r: F.regexp_replace(c, r[0], r[1]), REWRITINGS, text_of(question))
    return F.trim(F.regexp_replace(out, r"\s+", " "))


def expansions(question: Column) -> Column:
    """Additions of every triggered rule, in rule order, each once."""
    groups = [F.when(reduce(lambda a, b: a | b, [question.contains(t) for t in triggers]), F.array(*map(F.lit, more))) for triggers, more in EXPANSIONS]
    return F.array_distinct(F.flatten(F.array_compact(F.array(*groups))))


def cohorts_of(question: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(question, F.lit(COHORT), F.lit(1)))


def needs_cohort_evidence(question: Column) -> Column:
    """A cohort is named beside a term that differs from cohort to cohort."""
    return (F.size(cohorts_of(question)) > 0) & reduce(lambda a, b: a | b, [question.contains(t) for t in COHORT_TERMS])


def cohort_covered(question: Column, shown_cohorts: Column) -> Column:
    """Every named cohort has evidence of its own, where it must."""
    return ~needs_cohort_evidence(question) | (F.size(F.array_except(cohorts_of(question), shown_cohorts)) == 0)


def search_text(title: Column, article: Column, text: Column) -> Column:
    """The title twice and the article three times, then the text."""
    return F.concat_ws("\n", title, title, article, article, article, text)


def sentences(answer: Column) -> Column:
    return F.filter(F.transform(F.split(answer, r"(?<=[。！？!?；;])|\n+"), lambda x: F.btrim(x, F.lit(" \t\r\n"))), lambda s: s != "")


def exempt(sentence: Column) -> Column:
    """Nothing but marks, advice to ask elsewhere, or an introduction: no citation is due."""
    bare = F.btrim(F.regexp_replace(sentence, MARKER, ""), F.lit(" \t-*#>。.!！?？;；:："))
    return (bare == "") | bare.rlike(ADVICE_START) | bare.rlike(INTRO_END)


def cited_at_end(sentence: Column) -> Column:
    return F.rtrim(F.regexp_replace(F.trim(sentence), r"[。！？!?；;]+$", "")).rlike(r"(?:\[\d+\]){1,4}$")


def fenced_json(answer: Column, schema: str) -> Column:
    """The JSON of an answer that may stand in a code fence; null if it doesn't parse."""
    return F.from_json(F.regexp_replace(F.trim(answer), r"^```(?:json)?\s*|\s*```$", ""), schema)


def page_url(page: Column, file: Column, article: Column) -> Column:
    """The PDF's page where the article names one, else the page's own URL."""
    is_pdf = lambda u: F.lower(F.regexp_replace(u, r"[?#].*$", "")).endswith(".pdf")
    target = F.when(is_pdf(file), file).when(is_pdf(page), page)
    at = article_page(article)
    return F.when(at.isNull() | target.isNull(), page).otherwise(F.concat(F.substring_index(target, "#", 1), F.lit("#page="), at.cast("string")))


def logical_lines(text: Column) -> Column:
    """Lines, with a break before a heading that stands within one."""
    return F.filter(F.transform(F.split(F.regexp_replace(text, HEADING_AHEAD, "\n"), "\n"), lambda x: F.trim(x)), lambda x: x != "")
