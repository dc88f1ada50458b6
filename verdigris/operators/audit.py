"""Progress audits: module balances, claims, constraints, recommendations, feasibility."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.terms import semester_positions, semester_sort_key
from ..functions.text import compact_strict, clean_course_name, text_of
from .store import REQUIRED

#: Fixed value: names that no deadline avoids.
UNAVOIDABLE = "毕业实习|毕业论文|实践环节"


def module_audit(requirements: DataFrame, rows: DataFrame, completed: DataFrame, claims: list[str] = (), *, by: list[str] = ()) -> DataFrame:
    """For each requirement (module, required_credits): what is done, what remains, and whether that is known.

    completed holds (course_code, semester), matched null-safe. A claim settles its
    module whatever is done; without claim or completed course the remainder stays
    unknown, as does that of an unknown minimum. Sums are rounded half-even.
    """
    keys = completed.select("course_code", "semester", *by).distinct().withColumn("_done", F.lit(True))
    same = rows["course_code"].eqNullSafe(keys["course_code"]) & rows["semester"].eqNullSafe(keys["semester"])
    for c in by:
        same = same & rows[c].eqNullSafe(keys[c])
    done = rows.join(keys, same, "left_semi").groupBy(*by, "module").agg(F.sum(F.coalesce("credits", F.lit(0.0))).alias("_sum"), F.count(F.lit(1)).alias("n_done"))
    out = requirements.join(done, [*by, "module"], "left")
    claimed = F.lit(False)
    for c in claims:
        claimed = claimed | (F.instr(compact_strict(F.col("module")), compact_strict(F.lit(c))) > 0)
    known = F.col("n_done").isNotNull() | claimed
    total = F.coalesce("_sum", F.lit(0.0))
    remaining = F.when(F.col("required_credits").isNotNull() & known, F.when(claimed, 0.0).otherwise(F.greatest(F.lit(0.0), F.col("required_credits") - total)))
    return out.select(
        *by,
        "module",
        "required_credits",
        F.when(known, F.bround(total, 2)).alias("completed_credits"),
        F.bround(remaining, 2).alias("remaining_credits"),
        F.coalesce("n_done", F.lit(0).cast("bigint")).alias("n_done"),
        claimed.alias("claimed"),
        known.alias("completion_known"),
    )


def claimed_rows(rows: DataFrame, relation: str, semester: int | None = None) -> DataFrame:
    """Rows that a claim on the calendar completes: strictly before, through, or the whole program."""
    positions = semester_positions(F.col("semester"))
    if relation == "all_program":
        return rows
    last = F.array_max(positions)
    return rows.where(last < semester if relation == "before" else last <= semester)


def before_deadline(rows: DataFrame, deadline: float) -> DataFrame:
    """Rows whose first place in time lies before the deadline; rows without a semester don't."""
    return rows.where(F.array_min(semester_positions(F.col("semester"))) < deadline)


def unavoidable_predicate() -> Column:
    named = F.concat_ws(" ", clean_course_name(F.col("course_name")), text_of(F.col("module"))).rlike(UNAVOIDABLE)
    return text_of(F.col("course_nature")).contains(REQUIRED) | named


def unavoidable_after(rows: DataFrame, deadline: float) -> DataFrame:
    return rows.where((F.array_max(semester_positions(F.col("semester"))) >= deadline) & unavoidable_predicate())


def feasibility(rows: DataFrame, deadline: float, by: list[str], informed: Column) -> DataFrame:
    """insufficient_input without completed courses or claims, infeasible with rows that no deadline avoids, else feasible."""
    blocking = (F.array_max(semester_positions(F.col("semester"))) >= deadline) & unavoidable_predicate()
    n = F.sum(F.when(blocking, 1).otherwise(0)).cast("bigint")
    agg = rows.groupBy(*by).agg(n.alias("n_blocking"), F.max(informed.cast("int")).alias("_informed"))
    status = F.when(F.coalesce("_informed", F.lit(0)) == 0, "insufficient_input").when(F.col("n_blocking") > 0, "infeasible").otherwise("feasible")
    return agg.select(*by, "n_blocking", status.alias("status"))


def constraint_status(constraints: DataFrame, completed: DataFrame, by: list[str]) -> DataFrame:
    """all_of and any_of over (constraint_id, kind, codes): met or not, and the codes that are missing."""
    done = completed.groupBy(*by).agg(F.collect_set("course_code").alias("_done"))
    met = F.when(F.col("kind") == "all_of", F.size(F.array_except("codes", "_done")) == 0).otherwise(F.arrays_overlap("codes", "_done"))
    missing = F.when(met, F.array_except("codes", "codes")).otherwise(F.array_sort(F.array_except("codes", "_done")))
    return constraints.crossJoin(done).select("constraint_id", *by, "kind", met.alias("met"), missing.alias("missing"))  # as many constraints as a catalog lists


def recommendation_order(current: int | None = None) -> list[Column]:
    """Constraint courses first, past semesters last, then by semester and code."""
    key = semester_sort_key(F.col("semester"))
    past = (key < current).cast("int") if current is not None else F.lit(0)
    return [F.desc("needed"), past, key, F.col("course_code")]


def recommend(rows: DataFrame, by: list[str], *, gap: str = "remaining", limit: int = 8, current: int | None = None) -> DataFrame:
    """Takes courses in order until the gap is closed and every needed course is in, eight at most for each group.

    Courses that aren't needed are passed over once the gap is closed. The fold
    keeps its state from row to row, so each group's first rows (limit needed and
    limit others suffice) go through one Arrow function.
    """
    order = recommendation_order(current)
    ranked = rows.withColumn("seq", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
    ranked = ranked.withColumn("_n", F.row_number().over(Window.partitionBy(*by, "needed").orderBy("seq"))).where(F.col("_n") <= limit)

    def run(group):
        group = group.sort_by("seq")
        left, kept = (group.column(gap)[0].as_py() or 0.0), []
        needed = group.column("needed").to_pylist()
        open_needs = sum(needed)
        for i, (need, credits) in enumerate(zip(needed, group.column("credits").to_pylist(), strict=True)):
            if len(kept) == limit or left <= 0 and not open_needs:
                break
            if left <= 0 and not need:
                continue
            kept.append(i)
            left -= credits or 0.0
            open_needs -= need
        out = group.take(pa.array(kept, pa.int64()))
        return out.select([*by, "course_code"]).append_column("place", pa.array(range(1, len(kept) + 1), pa.int32()))

    from ..shipping import ship

    ship(rows.sparkSession)
    kinds = dict(rows.dtypes)
    return ranked.groupBy(*by).applyInArrow(run, ", ".join(f"{c} {kinds[c]}" for c in [*by, "course_code"]) + ", place int")
