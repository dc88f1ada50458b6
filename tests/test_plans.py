from verdigris.plans.executor import Executor
from verdigris.plans.planner import Operation, build_plan, understand

import pytest

SCOPE = {"cohort": "2023", "major": "M"}


def names(question, **scope):
    plan = build_plan(understand(question, **scope))
    return plan.path, [op.name for op in plan.operations]


def test_paths():
    assert names("你好") == ("general_llm", ["general_chat"])
    assert names("2023级大一上有哪些必修课程") == ("clarify", [])
    assert names("缓考流程是什么") == ("rag", ["retrieve_policy"])
    assert names("大一上有哪些必修课程", **SCOPE) == ("sql", ["list_courses"])
    assert names("ENG101是什么课", **SCOPE) == ("sql", ["get_course_detail"])
    assert names("毕业学分要求是多少", **SCOPE) == ("sql", ["get_graduation_requirements"])


def test_progress_with_deadline():
    path, ops = names("我想在大四前修完所有课程", **SCOPE)
    assert path == "sql" and ops == ["get_graduation_requirements", "list_courses_before_semester", "list_unavoidable_courses_after_semester", "check_curriculum_feasibility"]


def test_two_digit_cohort_and_years():
    q = understand("23级大二有什么选修课", major="M")
    assert (q.cohort, q.target_semesters, q.natures) == ("2023", (3, 4), ("选修",))


def test_only_listed_operations():
    with pytest.raises(ValueError):
        Operation("drop_table")


def test_executor(spark):
    offers = spark.createDataFrame(
        [(1, "2023", "M", "C1", "数学", "A", "必修", "1-2", 4.0), (2, "2023", "M", "C1", "数学", "A", "必修", "1-2", 4.0), (3, "2023", "M", "C2", "论文", "A", "必修", "8", 6.0), (4, "2022", "M", "C3", "英语", "A", "选修", "1", 2.0)],
        "seq int, cohort string, major string, course_code string, course_name string, module string, course_nature string, semester string, credits double",
    )
    req = spark.createDataFrame([("2023", "M", "A", 10.0)], "cohort string, major string, module string, required_credits double")
    run = Executor(offers, req)
    got = run.run(build_plan(understand("大一上有哪些必修课程", **SCOPE)))
    assert [r.seq for r in got["0_list_courses"].collect()] == [1]
    plan = build_plan(understand("我已修数学，想在大四前修完", **SCOPE, completed_courses=("数学",)))
    out = run.run(plan)
    audit = out["1_audit_completed_courses"].first()
    assert audit.completed_credits == 8.0 and audit.remaining_credits == 2.0
    assert out["4_check_curriculum_feasibility"].first().status == "infeasible"
    assert [r.course_code for r in out["3_list_unavoidable_courses_after_semester"].collect()] == ["C2"]
