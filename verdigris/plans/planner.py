"""Questions to plans: typed drafts, normalised queries, whitelisted operations, routes."""

from __future__ import annotations

import re
from dataclasses import dataclass, field, replace

from pyspark.sql import Column
from pyspark.sql import functions as F

# Intents by the words that name them, in order of precedence; stages of study; Chinese numerals.
INTENTS = (
    ("progress_audit", "还差|还需|修完|已修|剩余|进度|提前修"),
    ("promotion", "推免|保研|推荐免试"),
    ("policy", "政策|规定|办法|流程|缓考|转专业|休学|重修"),
    ("graduation_requirement", "毕业要求|毕业学分|总学分|最低学分"),
    ("course_query", "课程|课|学期|选修|必修"),
)
STAGES = {"大一上": 1, "大一下": 2, "大二上": 3, "大二下": 4, "大三上": 5, "大三下": 6, "大四上": 7, "大四下": 8}
YEARS = {"大一": (1, 2), "大二": (3, 4), "大三": (5, 6), "大四": (7, 8)}
NATURES = ("自由选修", "选修", "必修")
OPERATIONS = frozenset(
    "general_chat retrieve_policy get_graduation_requirements list_courses get_course_detail audit_completed_courses list_courses_before_semester list_unavoidable_courses_after_semester check_curriculum_feasibility".split()
)
SCOPED_INTENTS = frozenset("course_query progress_audit graduation_requirement".split())


@dataclass(frozen=True)
class NormalizedQuery:
    question: str
    domain: str = "curriculum"
    intent: str = "course_query"
    cohort: str | None = None
    major: str | None = None
    target_semesters: tuple[int, ...] = ()
    deadline_semester: int | None = None
    current_semester: int | None = None
    avoid_semesters: tuple[int, ...] = ()
    course_names: tuple[str, ...] = ()
    course_codes: tuple[str, ...] = ()
    natures: tuple[str, ...] = ()
    modules: tuple[str, ...] = ()
    subjects: tuple[str, ...] = ()
    completed_courses: tuple[str, ...] = ()
    module_claims: tuple[str, ...] = ()
    scope_claims: tuple[tuple[str, int | None], ...] = ()
    outputs: tuple[str, ...] = ()
    missing: tuple[str, ...] = ()


@dataclass(frozen=True)
class Operation:
    name: str
    arguments: dict = field(default_factory=dict)

    def __post_init__(self):
        if self.name not in OPERATIONS:
            raise ValueError(f"{self.name} is not an operation")


@dataclass(frozen=True)
class ExecutionPlan:
    query: NormalizedQuery
    operations: tuple[Operation, ...]
    path: str
    coverage: tuple[str, ...] = ()


def understand(question: str, **scope) -> NormalizedQuery:
    """A deterministic reading of the question; stated scope wins over what the text says."""
    intent = next((name for name, words in INTENTS if re.search(words, question)), None)
    cohort = re.search(r"(20\d{2})\s*级", question) or re.search(r"(?<!\d)(\d{2})\s*级", question)
    semesters = [n for stage, n in STAGES.items() if stage in question]
    if not semesters:
        semesters = [n for year, both in YEARS.items() if year in question for n in both]
    semesters += [int(n) for n in re.findall(r"第\s*([1-8])\s*学期", question)]
    deadline = re.search(r"(?:在|到)?(大[一二三四])(?:结束)?(?:之)?前", question)
    codes = tuple(dict.fromkeys(re.findall(r"(?<![A-Z])[A-Z]{3}\d{3}(?!\d)", question.upper())))
    read = NormalizedQuery(
        question=question,
        domain="curriculum" if intent else "general",
        intent=intent or "general",
        cohort=("20" + cohort[1])[-4:] if cohort else None,
        target_semesters=() if deadline else tuple(dict.fromkeys(semesters)),
        deadline_semester=YEARS[deadline[1]][0] if deadline else None,
        course_codes=codes,
        natures=next(((n,) for n in NATURES if n in question), ()),
    )
    stated = {k: v for k, v in scope.items() if v not in (None, "", ())}
    return normalise(replace(read, **stated))


def normalise(q: NormalizedQuery) -> NormalizedQuery:
    """What the intent needs and the query lacks; a classification question drops course names as filters."""
    missing = []
    if q.domain != "general" and q.intent in SCOPED_INTENTS:
        missing += [name for name, v in (("cohort", q.cohort), ("major", q.major)) if not v]
    if q.intent == "progress_audit" and not (q.completed_courses or q.module_claims or q.scope_claims):
        missing.append("completed_courses")
    if q.subjects and q.course_names:
        q = replace(q, course_names=())
    return replace(q, missing=tuple(missing))


def build_plan(q: NormalizedQuery) -> ExecutionPlan:
    """Operations from the whitelist alone. A completed-course gap never blocks; other gaps ask back."""
    if q.domain == "general":
        return ExecutionPlan(q, (Operation("general_chat"),), "general_llm")
    if any(m != "completed_courses" for m in q.missing):
        return ExecutionPlan(q, (), "clarify")
    base = {"cohort": q.cohort, "major": q.major}
    if q.intent in ("policy", "promotion", "school_requirement"):
        return ExecutionPlan(q, (Operation("retrieve_policy", {"question": q.question, **base}),), "rag", ("policy_corpus",))
    filters = {"course_natures": q.natures, "course_modules": q.modules, "subject_domains": q.subjects}
    informed = bool(q.completed_courses or q.module_claims or q.scope_claims)
    progress = Operation("audit_completed_courses", {**base, "completed_courses": q.completed_courses, "module_claims": q.module_claims, "scope_claims": q.scope_claims, "current_semester": q.current_semester})
    ops: list[Operation] = []
    coverage: list[str] = []
    if q.intent == "graduation_requirement":
        ops.append(Operation("get_graduation_requirements", base))
        ops += [Operation("list_courses", base)] * ("course_list" in q.outputs)
        coverage += ["program", "requirements"]
    elif q.intent == "course_query":
        if informed:
            ops += [Operation("get_graduation_requirements", base), progress]
            coverage += ["requirements", "progress"]
        detail = bool(q.course_names or q.course_codes)
        ops.append(Operation("get_course_detail" if detail else "list_courses", {**base, **filters, "semesters": q.target_semesters, "course_names": q.course_names, "course_codes": q.course_codes}))
        coverage += ["program", "semester", *["subject_classification"] * bool(q.subjects)]
    elif q.intent == "progress_audit":
        ops.append(Operation("get_graduation_requirements", base))
        ops += [progress] * informed
        if q.target_semesters:
            ops.append(Operation("list_courses", {**base, **filters, "semesters": q.target_semesters, "exclude_modules": q.module_claims}))
        if q.deadline_semester is not None:
            until = {"deadline_semester": q.deadline_semester}
            ops.append(Operation("list_courses_before_semester", {**base, **filters, **until}))
            ops.append(Operation("list_unavoidable_courses_after_semester", {**base, **until}))
            ops.append(Operation("check_curriculum_feasibility", {**base, **until, "avoid_semesters": q.avoid_semesters, "completed_courses": q.completed_courses, "module_claims": q.module_claims}))
        coverage += ["program", "requirements", "semester"]
    return ExecutionPlan(q, tuple(ops), "sql", tuple(dict.fromkeys(coverage)))


def route(text: Column, rules: list[tuple[str, str]], default: str) -> Column:
    """The first rule whose pattern the text has."""
    out = F.lit(default)
    for name, pattern in reversed(rules):
        out = F.when(text.rlike(pattern), name).otherwise(out)
    return out
