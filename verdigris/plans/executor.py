"""Runs a plan's operations as DataFrames over offerings and requirements."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import audit, resolve, store
from ..functions.text import text_of
from .planner import ExecutionPlan, Operation


class Executor:
    """offerings and requirements hold cohort and major; nothing is collected here."""

    def __init__(self, offerings: DataFrame, requirements: DataFrame):
        self.offerings, self.requirements = offerings, requirements

    def _scope(self, frame: DataFrame, a: dict) -> DataFrame:
        terms = [F.col(k) == a[k] for k in ("cohort", "major") if a.get(k) is not None]
        return frame.where(store.every(terms))

    def run(self, plan: ExecutionPlan) -> dict[str, DataFrame]:
        return {f"{i}_{op.name}": self.operation(op) for i, op in enumerate(plan.operations) if hasattr(self, f"_{op.name}")}

    def operation(self, op: Operation) -> DataFrame:
        return getattr(self, f"_{op.name}")(op.arguments)

    def _rows(self, a: dict) -> DataFrame:
        return store.course_filter(
            self._scope(self.offerings, a), semesters=a.get("semesters", ()), codes=a.get("course_codes", ()), names=a.get("course_names", ()), natures=a.get("course_natures", ()),
            modules=a.get("course_modules", ()), exclude_modules=a.get("exclude_modules", ()), subjects=a.get("subject_domains", ()),
        )

    def _list_courses(self, a: dict) -> DataFrame:
        key = F.coalesce(F.col("course_code").cast("string"), F.col("course_name"))
        return store.keep_first(self._rows(a), [key, text_of(F.col("semester")), text_of(F.col("module"))], ["seq"])

    _get_course_detail = _list_courses

    def _get_graduation_requirements(self, a: dict) -> DataFrame:
        return self._scope(self.requirements, a)

    def _list_courses_before_semester(self, a: dict) -> DataFrame:
        return audit.before_deadline(self._rows(a), a["deadline_semester"])

    def _list_unavoidable_courses_after_semester(self, a: dict) -> DataFrame:
        return audit.unavoidable_after(self._scope(self.offerings, a), a["deadline_semester"])

    def _check_curriculum_feasibility(self, a: dict) -> DataFrame:
        informed = bool(a.get("completed_courses") or a.get("module_claims"))
        return audit.feasibility(self._scope(self.offerings, a), a["deadline_semester"], ["cohort", "major"], F.lit(informed))

    def _audit_completed_courses(self, a: dict) -> DataFrame:
        rows = self._scope(self.offerings, a)
        done = rows.limit(0)
        if a.get("completed_courses"):
            spark = rows.sparkSession
            listed = F.array(*[F.struct(F.lit(i).alias("done_id"), F.lit(c).alias("done")) for i, c in enumerate(a["completed_courses"])])
            met = resolve.match_completed(spark.range(1).select(F.inline(listed)), rows).where("tier is not null").select("course_code").distinct()
            done = rows.join(met, "course_code", "left_semi").select(*rows.columns)
        for relation, semester in a.get("scope_claims", ()):
            done = done.unionByName(audit.claimed_rows(rows, relation, semester))
        return audit.module_audit(self._scope(self.requirements, a).select("module", "required_credits"), rows, done, list(a.get("module_claims", ())))
