from verdigris.operators import overrides as O


def chunks(spark, rows):
    return spark.createDataFrame(rows, "plan int, stem string, chunk_id int, article string, text string, is_table boolean, seq int")


def test_headers(spark):
    rows = [
        (1, "金融", 1, "金融方案", "毕业最低学分要求为150学分", False, 1),
        (1, "金融", 2, "其他", "会计140学分 金融专业 155.5 学分", True, 2),
        (2, "会计", 3, "会计方案", "毕业最低学分：160学分", True, 1),
        (2, "会计", 4, "会计方案", "毕业最低学分：161学分", False, 9),
        (3, "法学", 5, "其他", "毕业最低学分：160学分", False, 1),
        (4, "a.b", 6, "", "axb 100 学分 a.b 120 学分 1 2 3 4 5 6 7 8", False, 1),
        (5, "法", 7, None, None, False, 1),
    ]
    got = {r.plan: (r.chunk_id, r.total, list(r.module_credits)) for r in O.program_headers(chunks(spark, rows), ["plan"]).collect()}
    assert got == {1: (2, 155.5, []), 2: (4, 161.0, []), 4: (6, 120.0, [1.0, 2.0, 3.0, 4.0, 5.0, 6.0, 7.0])}
    assert O.program_headers(chunks(spark, rows[-1:]), ["plan"]).count() == 0


def test_overriding_drops_old_evidence(spark):
    headers = O.program_headers(chunks(spark, [(1, "x", 9, "x", "x 120 学分 1 2 3 4 5 6 7 8", False, 1), (2, "x", 8, "x", "x 120 学分", False, 1)]), ["plan"])
    base = spark.createDataFrame([(p, "m", 5.0, e) for p, e in ((1, 1), (2, 1), (3, 1))], "plan int, module string, required_credits double, evidence int")
    requirements = O.overridden(base, headers, ["plan"])
    assert {r.plan: r["count"] for r in requirements.groupBy("plan").count().collect()} == {1: 7, 2: 1, 3: 1}
    facts = O.minimum_facts(spark.createDataFrame([(p, "graduation_min_credits", 1.0, 2) for p in (1, 2, 3)], "plan int, field string, value double, evidence int"), headers, ["plan"])
    assert {r.plan: (r.value, r.evidence) for r in facts.collect()} == {1: (120.0, 9), 2: (120.0, 8), 3: (1.0, 2)}
    cited = spark.createDataFrame([(p, e, s) for p in (1, 2, 3) for e, s in ((2, 1), (1, 2))] + [(2, 8, 0)], "plan int, evidence int, seq int")
    used = facts.select("plan", "evidence").unionByName(requirements.select("plan", "evidence"))
    got = sorted((r.plan, r.number, r.evidence) for r in O.compacted(cited, headers, used, ["plan"]).collect())
    assert got == [(1, 1, 9), (2, 1, 8), (2, 2, 1), (3, 1, 2), (3, 2, 1)]
