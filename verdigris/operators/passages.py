"""Passages: scores and excerpts, evidence of neighbours, grounded lines; questions: semesters, repairs, routes, terms."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.questions import rewritten
from ..functions.text import COURSE_EDGES, bound, text_of, token_set
from .lookups import ordered_union, semester_bounds
from .narrowing import ENTITY_CODE
from .render import number_text

# What a question asks, what a passage that answers it holds, and the bonus; weights; mere headers.
BONUSES = (
    (r"最迟|什么时候|多久|时间", r"\d|小时|工作日|日前|月前|周前|学期前|开考前", 1.0),
    (r"多少|几分|比例|学分|分数|怎么计算|怎么算", r"\d|%|％|×|=|学分|分", 0.8),
    (r"怎么计算|怎么算", r"%|％|×|=|构成|占比", 1.0),
    (r"进考场|进入考场|迟到", r"未进入考场|取消.*考试资格", 1.2),
    (r"什么时候", r"期中|期末|学期|大一|大二", 1.0),
    (r"多少门|几门", r"\d+\s*门", 1.2),
    (r"最长学习年限", r"最长为|最长学习年限.*\d", 1.5),
)
CODE_WEIGHT, ARTICLE_WEIGHT, NUMBER_WEIGHT, HEADER_PENALTY, HEADER_UNDER = 2.0, 1.2, 0.35, 2.0, 150
HEADERS = r"^(?:《[^》]+》[^。！？；;]*|下表为.{0,120}的原表[:：])$"
ARTICLE_REF = r"(第[一二三四五六七八九十百零〇\d]+条)"
NUMBER, YEAR = r"(\d+(?:\.\d+)?)", r"^(?:19|20)\d{2}$"
PASSAGE = r"([^\n。！？!?；;]+[。！？!?；;]?|[^\n]+)"
GAP = "\n…\n"
# Semesters and stages in a question.
SEMESTER_ASKED, STAGE, STAGE_HALF = r"第([一二三四五六七八1-8])学期", r"大([一二三四])", r"大[一二三四]([上下])?"
ZH_DIGITS, DIGITS = "一二三四五六七八", "12345678"
# What makes a question one about the whole school, about courses, or about a stage it names.
SCHOOL_WIDE = r"公共外语|大学英语|通识教育核心|跨专业选修|每学期最多|暑期学期|教学周|艺术类课程|新财经|大学科基础课程"
COURSE_WORD = r"哪些.*课|什么.*课|课程|选修|必修"
STAGE_TARGET = r"大[一二三][上下].{0,10}(?:课|课程|选修|必修)"
# Names of missing fields, and the text that asks for them.
MISSING_LABELS = {"cohort": "入学年级", "major": "具体专业", "current_stage": "当前年级和上下学期", "completed_courses": "已修课程清单或成绩单"}
ASK_FOR, ASK_WHY, ASK_NEAR = "还需要你补充：", "。信息齐全后我才能按对应培养方案准确查询。", "\n\n当前年级下名称相近的专业有：\n"
# What may be taken over several semesters, and the labels of a schedule.
FLEXIBLE_NATURE, FLEXIBLE_MODULE, FLEXIBLE_LABEL = "必修", "通识教育基础课", "跨学期安排（以培养方案标注范围为准）"
# Labels of hours, and of what a course lacks.
HOURS = (("weekly_hours", "周学时"), ("total_hours", "总学时"), ("teaching_hours", "课堂学时"), ("practice_hours", "实践学时"))
UNLABELLED = "未标注"
SUMMARY_CHARS, LEAST_RESULTS = 260, 12
NO_TEXTS = "array<string>"


def _held(items: Column, text: Column) -> Column:
    """How many of the items stand in the text."""
    return F.size(F.filter(items, lambda x: F.contains(text, x)))


def _codes(text: Column) -> Column:
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(ENTITY_CODE), F.lit(1)), lambda x: F.upper(F.regexp_replace(x, "[- ]", ""))))


def passage_score(question: Column, passage: Column) -> Column:
    """Share of the question's tokens in the passage, its codes, articles and numbers there, bonuses; less for a mere header.

    The question comes normalised; the passage's tokens and codes are taken from its
    normalised form, all else from the passage as it is. Null reads as empty on both sides.
    """
    return bound(_asked(question), lambda asked: _score(asked, passage))


def _asked(question: Column) -> Column:
    """What a question asks for: text, tokens, codes, articles, numbers, and which bonuses it may have."""
    q = text_of(question)
    numbers = F.filter(F.array_distinct(F.regexp_extract_all(q, F.lit(NUMBER), F.lit(1))), lambda x: ~x.rlike(YEAR))
    articles = F.array_distinct(F.regexp_extract_all(q, F.lit(ARTICLE_REF), F.lit(1)))
    return F.struct(token_set(q).alias("tokens"), _codes(q).alias("codes"), articles.alias("articles"), numbers.alias("numbers"), *[q.rlike(asks).alias(f"b{i}") for i, (asks, _, _) in enumerate(BONUSES)])


def _score(asked: Column, passage: Column) -> Column:
    """passage_score for an _asked question."""

    def of(p: Column, plain: Column) -> Column:
        n = F.size(asked["tokens"])
        coverage = F.when(n > 0, F.size(F.array_intersect(asked["tokens"], token_set(plain))) / n).otherwise(0.0)
        codes = F.when(F.size(asked["codes"]) > 0, bound(F.regexp_replace(F.upper(plain), "[- ]", ""), lambda flat: _held(asked["codes"], flat))).otherwise(0)
        bonus = reduce(lambda a, b: a + b, [F.when(asked[f"b{i}"] & p.rlike(holds), worth).otherwise(0.0) for i, (_, holds, worth) in enumerate(BONUSES)])
        header = F.when((F.char_length(p) < HEADER_UNDER) & p.rlike(HEADERS), HEADER_PENALTY).otherwise(0.0)
        return coverage + codes * CODE_WEIGHT + _held(asked["articles"], p) * ARTICLE_WEIGHT + _held(asked["numbers"], p) * NUMBER_WEIGHT + bonus - header

    return bound(text_of(passage), lambda p: bound(rewritten(p), lambda plain: of(p, plain)))


def passages_of(text: Column) -> Column:
    found = F.regexp_extract_all(text_of(text), F.lit(PASSAGE), F.lit(1))
    return F.filter(F.transform(found, lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: x != "")


def excerpt(question: Column, text: Column, limit: int, enough: int) -> Column:
    """A text of over limit characters as its best passages in their own order, until min(limit, enough) characters are taken.

    Passages that don't fit are passed over; if none fits, the best one is cut; a text without passages too.
    """
    target = min(limit, enough)
    none = F.array().cast("array<struct<i:int,x:string>>")

    def take(state: Column, item: Column) -> Column:
        cost = F.char_length(item["x"]) + F.when(F.size(state["kept"]) > 0, len(GAP)).otherwise(0)
        fits = ~state["done"] & (state["used"] + cost <= limit)
        used = state["used"] + F.when(fits, cost).otherwise(0)
        kept = F.when(fits, F.concat(state["kept"], F.array(F.struct(item["i"].alias("i"), item["x"].alias("x"))))).otherwise(state["kept"])
        return F.struct(used.cast("int").alias("used"), (state["done"] | (used >= target)).alias("done"), kept.alias("kept"))

    start = F.struct(F.lit(0).alias("used"), F.lit(False).alias("done"), none.alias("kept"))

    def packed(t: Column, ranked: Column) -> Column:
        best = F.substring(F.get(ranked, F.lit(0))["x"], 1, limit)
        kept = F.aggregate(ranked, start, take, lambda s: F.transform(F.array_sort(s["kept"]), lambda k: k["x"]))
        return bound(kept, lambda k: F.when(F.size(k) > 0, F.array_join(k, GAP)).otherwise(F.coalesce(best, F.substring(t, 1, limit))))

    def ranked(t: Column, asked: Column) -> Column:
        return F.array_sort(F.transform(passages_of(t), lambda x, i: F.struct((-_score(asked, x)).alias("s"), i.alias("i"), x.alias("x"))))

    # each passage is scored once, and a short text's not at all
    t = text_of(text)
    return F.when(F.char_length(t) <= limit, t).otherwise(bound(_asked(question), lambda asked: bound(ranked(t, asked), lambda r: packed(t, r))))


def with_neighbours(chunks: DataFrame, by: str, seq: str, chunk_id: str, text: str) -> DataFrame:
    """chunks with near: (id, text) of the chunk before and after in its document, where there is one."""
    order = Window.partitionBy(by).orderBy(seq)
    cell = F.struct(F.col(chunk_id).alias("id"), text_of(F.col(text)).alias("text"))
    return chunks.withColumn("near", F.array_compact(F.array(F.lag(cell).over(order), F.lead(cell).over(order))))


def covering_evidence(chunk_id: Column, text: Column, near: Column, required: Column) -> Column:
    """The chunk's id, then those of its neighbours, in order, until all that is required stands in them together."""
    wanted = F.filter(required, lambda x: F.coalesce(x, F.lit("")) != "")

    def add(state: Column, cell: Column) -> Column:
        covered = F.forall(wanted, lambda x: F.contains(state["text"], x))
        ids = F.when(covered, state["ids"]).otherwise(F.concat(state["ids"], F.array(cell["id"])))
        return F.struct(ids.alias("ids"), F.when(covered, state["text"]).otherwise(F.concat(state["text"], F.lit("\n"), cell["text"])).alias("text"))

    return F.aggregate(near, F.struct(F.array(chunk_id).alias("ids"), text_of(text).alias("text")), add, lambda s: s["ids"])


def grounded_lines(lines: DataFrame, by: list[str], seq: str, line: str, ids: str) -> DataFrame:
    """(by, answer): the lines that have evidence, in order, each with its markers; chunks are numbered as they first appear.

    by names one answer, whose lines are of bounded number; line ends where its markers go. Lines of equal place go by text, then ids.
    """
    cells = lines.where(F.size(ids) > 0).groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(F.col(seq).alias("n"), F.col(line).alias("t"), F.col(ids).alias("ids")))).alias("_l"))
    cells = cells.withColumn("_c", F.array_distinct(F.flatten(F.transform("_l", lambda x: x["ids"]))))
    marked = lambda x: F.concat(x["t"], F.lit("["), F.array_join(F.transform(F.array_distinct(x["ids"]), lambda i: F.array_position(F.col("_c"), i).cast("string")), "]["), F.lit("]。"))
    return cells.select(*by, F.array_join(F.transform("_l", marked), "\n").alias("answer"))


def schedule(courses: DataFrame, by: list[str]) -> DataFrame:
    """(by, answer): courses of the asked semesters as grounded lines, one for each semester and chunk, then those over several.

    courses: by, code, name, semester (a cell like 1 or 1-2), nature, module, chunk, asked (semesters). A course of one
    asked semester is listed under it; a longer one that meets an asked semester only if it is a required foundation course.
    Repeated rows count once; rows without a chunk have no evidence and go. Groups stand by semester, chunks by id.
    """
    c = courses.withColumn("_b", semester_bounds(F.col("semester"))).where(F.col("_b").isNotNull() & (text_of(F.col("chunk")) != ""))
    first, last = F.col("_b.first"), F.col("_b.last")
    flexible = F.exists("asked", lambda x: (first <= x) & (x <= last)) & F.contains(text_of(F.col("nature")), F.lit(FLEXIBLE_NATURE)) & F.contains(text_of(F.col("module")), F.lit(FLEXIBLE_MODULE))
    place = F.when((first == last) & F.array_contains("asked", first), first).when((first < last) & flexible, F.lit(9))
    cells = c.withColumn("_k", place).where("_k IS NOT NULL").groupBy(*by, "_k", "chunk").agg(F.array_sort(F.collect_set(F.struct(text_of(F.col("code")).alias("c"), text_of(F.col("name")).alias("n"), F.col("semester").alias("s")))).alias("_n"))
    names = F.array_join(F.transform("_n", lambda x: F.trim(F.concat_ws(" ", x["c"], x["n"]))), "、")
    label = F.when(F.col("_k") == 9, FLEXIBLE_LABEL).otherwise(F.concat(F.lit("第"), F.col("_k").cast("string"), F.lit("学期")))
    lines = cells.select(*by, F.struct("_k", "chunk").alias("_s"), F.concat(F.lit("- "), label, F.lit("："), names).alias("_t"), F.array("chunk").alias("_ids"))
    return grounded_lines(lines, by, "_s", "_t", "_ids")


def index_checks(chunks: DataFrame, vectors: DataFrame, on: str, vector: str, dimension: int) -> DataFrame:
    """One row: counts, ids without a vector, vectors without a chunk, vectors of another dimension, and whether the index is ready."""
    told = chunks.select(on, F.lit(1).alias("_c"), F.lit(0).alias("_v"), F.lit(0).alias("_w"))
    misshapen = F.coalesce(F.size(vector) != dimension, F.lit(True)).cast("int")
    told = told.unionByName(vectors.select(on, F.lit(0).alias("_c"), F.lit(1).alias("_v"), misshapen.alias("_w")))
    held = told.groupBy(on).agg(*[F.sum(x).alias(x) for x in ("_c", "_v", "_w")])
    total = lambda x: F.coalesce(F.sum(x), F.lit(0))
    out = held.agg(total("_c").alias("n_chunks"), total("_v").alias("n_vectors"), F.count_if(F.col("_v") == 0).alias("n_missing"), F.count_if(F.col("_c") == 0).alias("n_extra"), total("_w").alias("n_misshapen"), F.count_if((F.col("_c") != 1) | (F.col("_v") != 1)).alias("_odd"))
    return out.withColumn("ready", (F.col("_odd") == 0) & (F.col("n_misshapen") == 0)).drop("_odd")


def question_semesters(question: Column) -> Column:
    """Semesters that a question names by number, then those of the first stage it names, each once, as texts."""
    q = text_of(question)
    numbered = F.transform(F.regexp_extract_all(q, F.lit(SEMESTER_ASKED), F.lit(1)), lambda x: F.translate(x, ZH_DIGITS, DIGITS).cast("int"))
    last = 2 * F.translate(F.regexp_extract(q, STAGE, 1), ZH_DIGITS, DIGITS).try_cast("int")
    half = F.regexp_extract(q, STAGE_HALF, 1)
    staged = F.when(half == "上", F.array(last - 1)).when(half == "下", F.array(last)).otherwise(F.array(last - 1, last))
    return F.array_distinct(F.concat(numbered, F.when(last.isNull(), F.array().cast("array<int>")).otherwise(staged))).cast(NO_TEXTS)


def repaired_intent(question: Column, domain: Column, intent: Column, major: Column, outputs: Column, relation: Column) -> Column:
    """(intent, outputs, relation) after the repairs: questions about the whole school, about courses, about a named stage."""
    q = text_of(question)
    school_wide = q.rlike(SCHOOL_WIDE)
    to_school = school_wide & (text_of(major) == "")
    to_courses = F.coalesce((domain == "school") & (intent == "school_requirement"), F.lit(False)) & q.rlike(COURSE_WORD) & ~school_wide
    now = F.when(to_school, "school_requirement").when(to_courses, "course_query").otherwise(intent)
    more = F.when(to_school, F.array(F.lit("policy_explanation"))).when(to_courses, F.array(F.lit("course_list"))).otherwise(F.array().cast(NO_TEXTS))
    cleared = F.when(~F.coalesce((relation == "during_year_4") & q.rlike(STAGE_TARGET), F.lit(False)), relation)
    return F.struct(now.alias("intent"), F.when(F.size(more) > 0, ordered_union(outputs, more)).otherwise(outputs).alias("outputs"), cleared.alias("relation"))


def repaired_modules(intent: Column, operation: Column, modules: Column, completed: Column) -> Column:
    """(modules, excluded) of a step: in an audit's course lists the completed modules go and are named as excluded."""
    applies = F.coalesce((intent == "progress_audit") & (operation == "list_courses"), F.lit(False)) & (F.size(completed) > 0)
    return F.struct(
        F.when(applies, F.filter(modules, lambda x: ~F.array_contains(completed, x))).otherwise(modules).alias("modules"),
        F.when(applies, completed).alias("excluded"),
    )


def clarification(missing: Column, majors: Column) -> Column:
    """The text that asks for the missing fields by their names, with majors of a like name if the major is missing."""
    labels = F.create_map(*[F.lit(x) for pair in MISSING_LABELS.items() for x in pair])
    asked = F.array_join(F.transform(missing, lambda x: F.coalesce(F.try_element_at(labels, x), x)), "、")
    shown = F.array_contains(missing, "major") & (F.size(majors) > 0)
    near = F.when(F.coalesce(shown, F.lit(False)), F.concat(F.lit(ASK_NEAR), F.array_join(F.transform(majors, lambda x: F.concat(F.lit("- "), x)), "\n"))).otherwise("")
    return F.concat(F.lit(ASK_FOR), asked, F.lit(ASK_WHY), near)


def terms_of(*parts: Column) -> Column:
    """The parts, texts or lists of them, that aren't null or empty, in order."""
    return F.filter(F.concat(*[F.coalesce(p, F.array().cast(NO_TEXTS)) for p in parts]), lambda x: F.coalesce(x, F.lit("")) != "")


def route_of(question: Column, domain: Column, intent: Column, cohort: Column, terms: Column) -> list[Column]:
    """The route that a normalised question takes."""
    school = F.coalesce(domain == "school", F.lit(False))
    mode = F.when(school, "school_rag").otherwise("general_chat")
    return [mode.alias("mode"), school.alias("requires_school_facts"), intent.alias("intent"), cohort.cast("string").alias("cohort"), question.alias("rewritten_query"), terms.alias("search_terms")]


def scoped_search(question: Column, major: Column, natures: Column, k: Column) -> list[Column]:
    """(query, k): the normalised question, the question, its major and natures, each once; at least 12 results."""
    parts = terms_of(F.array(rewritten(question), question, major), natures)
    return [F.array_join(F.array_distinct(parts), " ").alias("query"), F.greatest(k, F.lit(LEAST_RESULTS)).alias("k")]


def summary_of(text: Column) -> Column:
    return F.substring(text_of(text), 1, SUMMARY_CHARS)


def short_label(value: Column) -> Column:
    """A label on one line without its English tail and edge bars."""
    plain = F.trim(F.regexp_replace(F.replace(text_of(value), F.lit("　"), F.lit(" ")), r"\s+", " "))
    return F.btrim(F.element_at(F.split(plain, r"\s+[A-Za-z][A-Za-z ]{3,}", 2), 1), F.lit(COURSE_EDGES[:2]))


def course_line(semester: Column, code: Column, name: Column, credits: Column, nature: Column, module: Column, hours: dict[str, Column]) -> Column:
    """One course as a line of an answer, with the hours that are known; its markers follow it."""
    known = [F.when(hours[field].isNotNull(), F.concat(F.lit(label), number_text(hours[field]))) for field, label in HOURS if field in hours]
    told = lambda c: F.when(text_of(c) == "", UNLABELLED).otherwise(text_of(c))
    detail = F.concat_ws("，", F.concat(number_text(F.coalesce(credits, F.lit(0))), F.lit("学分")), told(nature), told(module), *known)
    return F.concat(F.lit("- 第"), text_of(semester), F.lit("学期："), told(code), F.lit(" "), text_of(name), F.lit("，"), detail)


def enabled_sources(sources: DataFrame) -> DataFrame:
    """Rows of the source table as they are first loaded: years as numbers, each enabled."""
    return sources.withColumn("year", F.col("year").cast("int")).withColumn("enabled", F.lit(1))
