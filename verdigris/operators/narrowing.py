"""Narrowing of candidates, resolution of modules and programs, checks of drafts, links and passages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import compact_listed, compact_strict, text_of
from .lookups import ordered_union
from .resolve import _small

# What a question asks for, what a course's text holds then, and the prefix of its code.
COURSE_TOPICS = (
    ("数学课程|哪些数学|数学课", "数学|代数|微积分|概率|统计", None),
    ("程序设计课程|程序设计课", "程序设计|编程|程序语言", None),
    ("思想政治|思政", "马克思|思想|政治|形势与政策|近现代史|毛泽东|习近平", None),
    ("体育课程|体育课", "体育", "PED"),
    ("军事教育|军事课程|军事课", "军事", "MTT"),
)
# Entities of a question.
ENTITY_CODE = r"(?<![A-Za-z0-9])([A-Za-z]{2,}[- ]?\d{2,4})(?![A-Za-z0-9])"
ENTITY_LATIN = r"(?<![A-Za-z0-9])([A-Za-z][A-Za-z0-9+._-]{2,})(?![A-Za-z0-9])"
NO_ENTITY = ("HTTP", "HTTPS", "PDF", "RAG", "API")
#: For each family of questions its pattern, the mark that a subject follows, what goes from its ends in turn, its greatest length, and subjects that name nothing.
SUBJECT_FAMILIES = (
    (
        r"([^，。！？!?；;]{2,24}?)(?:算不算|是不是|属于|是|算(?=专选|专业选修|选修|必修))(?:什么|哪类|专业|课程|专选|选修|必修)?",
        "的",
        (r"^(请问|想问|那么|这个)", r"\d{4}级$", r"(?:还|分别|范围|是否|属于)$"),
        10,
        ("课程", "课", "这门课", "要求", "条件", "学分"),
    ),
    (
        r"([^，。！？!?；;]{2,30}?)(?:什么时候|何时|几点)",
        None,
        (r"^(请问|想问|我想知道|那么|这个)", r"^(?:我(?:的)?|本人(?:的)?)", r"(?:最迟|最晚|通常|一般|大概|大约)$", r"(?:在)?大[一二三四](?:上|下)?(?:学期)?$", r"(?:早上|上午|中午|下午|晚上)$", r"^\s+|\s+$", r"的+$"),
        24,
        ("考试", "课程", "规定", "政策", "学校"),
    ),
    (
        r"([^，。！？!?；;]{2,24}?)(?:忘了|丢了|遗失了|找不到了|打不开|登录不了)(?:该)?怎么办",
        None,
        (r"^(请问|想问|我想知道|那么|这个)", r"^(?:我(?:的)?|本人(?:的)?)", r"^\s+|\s+$", r"的+$"),
        24,
        ("",),
    ),
)
ENTITY_PHRASES = ("专业选修课", "跨专业选修课", "毕业最低学分")
# Fields of an explanation, and what its text must not echo or invent.
DRAFT_FIELDS = ("summary", "explanations", "warnings", "clarification_question")
DRAFT_URL = r"(?i)https?://|www\."
DRAFT_TABLE = r"(?i)Course\s*Credi|Weekly\s*Total|Teaching\s*Practice|Course\s*Nature\s*Department"
DRAFT_CODE = r"(?i)\b([A-Z]{2,5}\d{3})\b"
DRAFT_NUMBER = r"(?<![A-Za-z])(\d+(?:\.\d+)?)"
DRAFT_PAUSE = r"[。！？；：\n]"
DRAFT_RUN = 120
# Characters that count as text on a page, and how few call for recognition.
MEANINGFUL = r"[^㐀-鿿A-Za-z0-9]"
LEAST_IN_FILE, LEAST_ON_PAGE = 160, 80
# Marks that end a passage, the note sign and the least note.
FINAL_MARK = r"([。！？!?；;])$"
LAST_NOTE = r"(?s)^.*(注[：:].*)$"
LEAST_NOTE = 15
PROGRAM_SUFFIX = "专业"
CROSS_MAJOR, CROSS = "跨专业", "跨"
NAME_BREAKS = r"[、,，/；;]+"


def narrow_in_turn(candidates: DataFrame, by: list[str], steps: list[tuple[Column, Column]]) -> DataFrame:
    """After each step (applies, preferred) the preferred rows alone, for questions where it applies and there are any.

    by names the question; its candidates are a window of bounded size. All steps share one shuffle.
    """
    for applies, preferred in steps:
        wanted = F.coalesce(preferred, F.lit(False))
        any_wanted = F.max(wanted & F.coalesce(applies, F.lit(False))).over(Window.partitionBy(*by))
        candidates = candidates.withColumn("_wanted", wanted).withColumn("_any", any_wanted).where("_wanted OR NOT _any").drop("_wanted", "_any")
    return candidates


def topic_filter(question: Column, searched: Column, code: Column, topics=COURSE_TOPICS) -> Column:
    """Whether a course meets every topic that the question names, by its text or its code's prefix."""
    out = F.lit(True)
    for asks, holds, prefix in topics:
        met = searched.rlike(holds)
        if prefix:
            met = met | F.upper(text_of(code)).startswith(prefix)
        out = out & (~text_of(question).rlike(asks) | F.coalesce(met, F.lit(False)))
    return out


def module_visible(course_count: Column, required: Column, rule_text: Column) -> Column:
    """A module shows if it has courses, a minimum or a rule."""
    return (F.coalesce(course_count, F.lit(0)) > 0) | required.isNotNull() | (text_of(rule_text) != "")


def overlay_trusted(required: Column, rule_text: Column, evidence: Column) -> Column:
    """An overlay row counts only with a minimum, its rule and its evidence."""
    return required.isNotNull() & (text_of(rule_text) != "") & (text_of(evidence) != "")


def overlay_key(cohort: Column, major: Column, module: Column) -> list[Column]:
    return [text_of(cohort).alias("cohort_key"), compact_listed(major).alias("major_key"), compact_listed(module).alias("module_key")]


def public_course(code: str, name: str, credits: str, module: str, nature: str, semester: str) -> list[Column]:
    named = {"code": code, "name": name, "credits": credits, "module": module, "nature": nature, "semester": semester}
    return [F.col(source).alias(shown) for shown, source in named.items()]


def requirements_of(requirements: DataFrame, major: str, module_term: str | None = None) -> DataFrame:
    """A program's requirements; with a term those whose module contains it or lies in it, compacted."""
    rows = requirements.where(F.col("major") == major)
    if not module_term:
        return rows
    term, module = compact_listed(F.lit(module_term)), compact_listed(F.col("module"))
    return rows.where(F.contains(module, term) | F.contains(term, module))


def longest_stem(questions: DataFrame, majors: DataFrame, id_col: str, text: str) -> DataFrame:
    """(id_col, major): the longest major whose stem of two characters or more the question holds, of equal ones the first by name.

    Questions with one text are matched once; majors are a catalog's list, broadcast if a count proves them few.
    """
    known = majors.select("major").distinct().withColumn("_stem", compact_strict(F.regexp_replace("major", PROGRAM_SUFFIX + "$", ""))).where(F.char_length("_stem") >= 2)
    values = questions.select(F.col(text).alias("_v")).distinct()
    met = values.join(_small(known), F.contains(compact_strict(F.col("_v")), F.col("_stem")))
    best = met.groupBy("_v").agg(F.min(F.struct((-F.char_length(compact_strict(F.col("major")))).alias("n"), "major")).alias("m"))
    return questions.join(best, questions[text] == best["_v"]).select(id_col, "m.major")


def module_for(wishes: DataFrame, modules: DataFrame, aliases: DataFrame) -> DataFrame:
    """(wish_id, module): the module that contains the wish or lies in it; else the first one by an alias in the wish; else null.

    Modules of other majors come last unless the wish names them, then the closest in
    length, then by name. aliases: (place, alias, preferred). modules and aliases are catalog lists.
    """
    w = wishes.withColumn("_w", compact_strict(F.col("wish")))
    m = _small(modules.select("module").distinct().withColumn("_m", compact_strict(F.col("module"))).where("_m <> ''"))
    cross = F.contains(F.col("module"), F.lit(CROSS_MAJOR)) & ~F.contains(F.col("wish"), F.lit(CROSS))
    direct = w.where("_w <> ''").join(m, F.contains("_m", "_w") | F.contains("_w", "_m"))
    rank = F.struct(cross.cast("int").alias("tier"), F.abs(F.char_length("_m") - F.char_length("_w")).alias("gap"), "module")
    direct = direct.select("wish_id", rank.alias("rank"))
    a = _small(aliases.withColumn("_a", compact_strict(F.col("alias"))).withColumn("_p", compact_strict(F.col("preferred"))))
    named = w.join(a, F.contains("_w", "_a")).join(m, F.contains("_m", "_p") | F.contains("_m", "_a"))
    named = named.select("wish_id", F.struct(F.lit(2).alias("tier"), F.col("place").cast("int").alias("gap"), "module").alias("rank"))
    best = direct.unionByName(named).groupBy("wish_id").agg(F.min("rank").alias("rank"))
    return wishes.select("wish_id").join(best, "wish_id", "left").select("wish_id", F.col("rank.module").alias("module"))


def candidate_names(questions: DataFrame, catalog: DataFrame) -> DataFrame:
    """(question_id, names): the planner's names, then the catalog's that the question holds, each once. catalog: (name, place)."""
    c = _small(catalog.withColumn("_n", compact_strict(F.col("name"))).where(F.char_length("_n") >= 2))
    held = questions.join(c, F.contains(compact_strict(F.col("question")), F.col("_n")))
    held = held.groupBy("question_id").agg(F.array_sort(F.collect_list(F.struct("place", "name"))).alias("_c"))
    planned = F.filter(F.transform(F.split(text_of(F.col("planned")), NAME_BREAKS), lambda x: F.trim(x)), lambda x: x != "")
    listed = F.coalesce(F.transform("_c", lambda x: F.trim(x["name"])), F.array().cast("array<string>"))
    return questions.join(held, "question_id", "left").select("question_id", ordered_union(planned, listed).alias("names"))


def _trimmed(found: Column, patterns: tuple[str, ...]) -> Column:
    """Each pattern's match goes, in turn."""
    for pattern in patterns:
        found = F.regexp_replace(found, pattern, "")
    return F.trim(found)


def asked_subjects(question: Column) -> Column:
    """The subjects of questions of kind, of time and for help: what stands before the question words, without what is said around it."""
    q = text_of(question)

    def family(pattern: str, mark: str | None, patterns: tuple[str, ...], most: int, none: tuple[str, ...]) -> Column:
        found = F.transform(F.regexp_extract_all(q, F.lit(pattern), F.lit(1)), lambda x: F.trim(x))
        if mark:
            found = F.transform(found, lambda x: F.element_at(F.split(x, mark, -1), -1))
        found = F.transform(found, lambda x: _trimmed(x, patterns))
        return F.filter(found, lambda x: F.char_length(x).between(2, most) & ~x.isin(*none))

    return F.concat(*[family(*rules) for rules in SUBJECT_FAMILIES])


def required_entities(question: Column) -> Column:
    """What a source must hold: the course codes if there are any, else Latin names, fixed phrases and asked subjects, in order, each once."""
    q = text_of(question)
    codes = F.transform(F.regexp_extract_all(q, F.lit(ENTITY_CODE), F.lit(1)), lambda x: F.upper(F.regexp_replace(x, "[- ]", "")))
    latin = F.filter(F.regexp_extract_all(q, F.lit(ENTITY_LATIN), F.lit(1)), lambda x: ~F.upper(x).isin(*NO_ENTITY))
    phrases = F.filter(F.array(*map(F.lit, ENTITY_PHRASES)), lambda x: F.contains(q, x))
    return F.array_distinct(F.when(F.size(codes) > 0, codes).otherwise(F.concat(latin, phrases, asked_subjects(q))))


def explanation_error(fields: Column, evidence: Column, known: Column, text: Column, codes: Column, numbers: Column) -> Column:
    """The first rule that an explanation breaks, null if none: fields, evidence, text, echoes, codes, numbers, readability.

    known: the packet's evidence; codes: its course codes in upper case; numbers: doubles that may be named.
    """
    t = F.btrim(text_of(text))
    said = F.transform(F.regexp_extract_all(t, F.lit(DRAFT_CODE), F.lit(1)), F.upper)
    counted = F.transform(F.regexp_extract_all(t, F.lit(DRAFT_NUMBER), F.lit(1)), lambda x: x.cast("double"))
    rules = (
        ("unexpected_fields", F.size(F.array_except(fields, F.array(*map(F.lit, DRAFT_FIELDS)))) > 0),
        ("invalid_evidence_id", F.size(F.array_except(evidence, known)) > 0),
        ("empty_draft", t == ""),
        ("unsafe_or_raw_output", t.rlike(DRAFT_URL) | t.rlike(DRAFT_TABLE)),
        ("invented_course_code", F.size(F.array_except(said, codes)) > 0),
        ("invented_number", F.size(F.array_except(counted, numbers)) > 0),
        ("unreadable_unpunctuated_output", (F.char_length(t) > DRAFT_RUN) & ~t.rlike(DRAFT_PAUSE)),
    )
    return F.coalesce(*[F.when(broken, F.lit(name)) for name, broken in rules])


def recognition_needed(pages: DataFrame, by: str, text: str) -> DataFrame:
    """(by, n_pages, meaningful, needs_ocr): files whose pages hold too few letters and digits."""
    meaningful = F.char_length(F.regexp_replace(text_of(F.col(text)), MEANINGFUL, ""))
    out = pages.groupBy(by).agg(F.count(F.lit(1)).alias("n_pages"), F.sum(meaningful).alias("meaningful"))
    return out.withColumn("needs_ocr", F.col("meaningful") < F.greatest(F.lit(LEAST_IN_FILE), LEAST_ON_PAGE * F.col("n_pages")))


def cited(passage: Column, marker: Column, refusal: str) -> Column:
    """The passage on one line with its marker before the final mark; its last note alone if that is long; a blank one is refused."""
    t = F.regexp_replace(text_of(passage), r"^\s+|\s+$", "")
    note = F.regexp_extract(t, LAST_NOTE, 1)
    t = F.when(F.char_length(note) >= LEAST_NOTE, note).otherwise(t)
    for pattern, joined in ((r"[；;。]\s*\n", "，"), (r"[:：]\s*\n", "："), (r"\s*\n\s*", "")):
        t = F.regexp_replace(t, pattern, joined)
    sign = F.concat(F.lit("["), marker.cast("string"), F.lit("]"))
    ended = F.concat(F.regexp_replace(t, FINAL_MARK, ""), sign, F.regexp_extract(t, FINAL_MARK, 1))
    return F.when(t == "", F.lit(refusal)).when(t.rlike(FINAL_MARK), ended).otherwise(F.concat(t, sign, F.lit("。")))


def link_error(url: Column) -> Column:
    """'empty' for null or blank, 'url' for what is no absolute HTTP(S) address."""
    t = F.btrim(text_of(url))
    return F.when(t == "", "empty").when(~t.rlike(r"^(?i)https?://[^/?#]+"), "url")
