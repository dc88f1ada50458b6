"""Operator semantics beyond the queries: nulls, ties, unknown values, empty frames."""

from pyspark.sql import functions as F

from verdigris.operators import audit, catalog, grounding, ingest, render, resolve, retrieval, store


def test_unknown_minimum_is_not_zero(spark):
    req = spark.createDataFrame([("A", 8.0), ("B", None), ("C", 5.0), ("D", 2.0)], "module string, required_credits double")
    rows = spark.createDataFrame([(1, "1", "A", 2.0), (2, None, "A", 2.0), (3, "1", "B", 4.0), (4, "2", "D", 3.0)], "course_code int, semester string, module string, credits double")
    done = rows.where("course_code < 4").select("course_code", "semester")
    got = {r.module: r for r in audit.module_audit(req, rows, done, ["d"]).collect()}
    assert (got["A"].completed_credits, got["A"].remaining_credits) == (4.0, 4.0)  # a null semester matches
    assert got["B"].completion_known and got["B"].remaining_credits is None
    assert not got["C"].completion_known and got["C"].completed_credits is None
    assert got["D"].claimed and got["D"].remaining_credits == 0.0


def test_remaining_is_never_negative(spark):
    req = spark.createDataFrame([("A", 1.0)], "module string, required_credits double")
    rows = spark.createDataFrame([(1, "1", "A", 9.0)], "course_code int, semester string, module string, credits double")
    assert audit.module_audit(req, rows, rows).first().remaining_credits == 0.0


def test_filter_comes_before_the_cut(spark):
    scores = spark.createDataFrame([(1, 10, 0.9), (1, 11, 0.9), (1, 12, 0.1), (2, 10, 0.0)], "query_id int, doc_id int, score double")
    assert [(r.query_id, r.doc_id) for r in retrieval.top_k(scores.where("score > 0"), 2, "doc_id").orderBy("rank").collect()] == [(1, 10), (1, 11)]


def test_mmr_prefers_the_unlike():
    assert retrieval.mmr_order([[1, 0], [1, 0], [0, 1]], [1.0, 0.99, 0.9], 2, 0.5) == [0, 2]
    assert retrieval.mmr_order([[1, 0], [1, 0]], [0.5, 0.5], 2) == [0, 1]
    assert retrieval.mmr_order([], [], 3) == []


def test_bm25_counts_repeated_query_terms(spark):
    docs = spark.createDataFrame([(1, "apple pear"), (2, "pear"), (3, None)], "doc_id int, text string")
    once = spark.createDataFrame([(1, "apple")], "query_id int, query_text string")
    twice = spark.createDataFrame([(1, "apple apple")], "query_id int, query_text string")
    a, b = (retrieval.bm25_scores(docs, q, "doc_id", "text").first().score for q in (once, twice))
    assert abs(b - 2 * a) < 1e-9


def test_fusion_is_monotone(spark):
    a = spark.createDataFrame([(1, 1, 1), (1, 2, 2)], "query_id int, doc_id int, rank int")
    got = {r.doc_id: r.fused for r in retrieval.fuse([a, a], "doc_id").collect()}
    assert got[1] > got[2] and abs(got[1] - 2 / 61) < 1e-12


def test_primary_is_unique_and_ignores_input_order(spark):
    rows = spark.createDataFrame([("k", 1, "a"), ("k", 5, "b"), ("k", 5, "c"), ("m", 0, "d")], "key string, priority int, source_id string")
    order = [F.desc("priority"), F.desc("source_id")]
    for frame in (rows, rows.orderBy("source_id"), rows.orderBy(F.desc("source_id"))):
        assert sorted(r.source_id for r in store.primary(frame, ["key"], order).where("is_primary").collect()) == ["c", "d"]


def test_name_match_prefers_exact(spark):
    rows = spark.createDataFrame([("数学",), ("高等数学",)], "course_name string")
    assert [r[0] for r in store.name_match(rows, "数学").collect()] == ["数学"]
    assert [r[0] for r in store.name_match(rows, "等数").collect()] == ["高等数学"]
    assert store.name_match(rows, "化学").count() == 0


def test_course_listing_sorts_by_columns(spark):
    """The listing order, and no key that a sort would work out at every comparison."""
    rows = [("S2", "M", "c", "n"), ("3", "M", "c", "n"), (None, "Z", "z", "n"), ("1-2", "M", "d", "n"), ("1", "M", "c", "o"), ("1", "A", "z", "n"), ("1", "M", "c", "n")]
    df = spark.createDataFrame([(*r, "选修") for r in rows], "semester string, module string, course_code string, course_name string, course_nature string")
    out = store.course_query(df, elective=True)
    assert out.columns == df.columns
    assert [tuple(r)[:4] for r in out.collect()] == [rows[i] for i in (2, 0, 5, 6, 4, 3, 1)]
    plan = out._jdf.queryExecution().optimizedPlan().toString().splitlines()
    assert [line for line in plan if "Sort [" in line] and not [line for line in plan if "Sort [" in line and "substring" in line]


def test_natures_and_modules(spark):
    rows = spark.createDataFrame([("选修", "x"), ("必修", "专业方向课程"), ("必修", "自由选修")], "course_nature string, module string")
    assert rows.where(store.nature_predicate(["选修"])).count() == 2
    assert rows.where(store.nature_predicate(["自由选修"])).count() == 1
    assert rows.where(store.module_predicate(["专业方向课"])).count() == 1


def test_completed_match_keeps_the_unmatched(spark):
    courses = spark.createDataFrame([(1, "red widget"), (2, "red"), (3, None)], "course_code int, course_name string")
    done = spark.createDataFrame([(1, "Red"), (2, "nothing"), (3, "widg")], "done_id int, done string")
    got = sorted((r.done_id, r.course_code, r.tier) for r in resolve.match_completed(done, courses).collect() if r.course_code)
    assert got[0] == (1, 2, 1) and (3, 1, 2) in got
    assert resolve.match_completed(done, courses.limit(0)).where("tier is null").count() == 3


def test_fill_down_resets(spark):
    rows = spark.createDataFrame([(1, i, a, b) for i, (a, b) in enumerate([("X", None), (None, "m"), (None, None), ("Y", None), (None, "n")])], "doc int, seq int, a string, b string")
    got = [(r.major, r.module) for r in catalog.fill_down(rows, ["doc"], "seq", F.col("a"), F.col("b")).orderBy("seq").collect()]
    assert got == [("X", None), ("X", "m"), ("X", "m"), ("Y", None), ("Y", "n")]


def test_subset_sums_are_closed(spark):
    rows = spark.createDataFrame([("a", 1.5), ("a", 2.0), ("a", 2.0)], "g string, c double")
    assert grounding.subset_sums(rows, ["g"], "c").first().sums == [0, 3, 4, 7, 8, 11]


def test_subset_sums_in_tenths_without_a_cap(spark):
    values = {"a": [0.3, 2.7, 0.3, None], "b": [90.0, 90.0, 45.5, 0.0], "c": [None], "d": [-1.5, 2.0]}
    rows = spark.createDataFrame([(g, x) for g, v in values.items() for x in v], "g string, c double")
    got = {r.g: r.sums for r in grounding.subset_sums(rows, ["g"], "c", unit=10).collect()}
    for g, v in values.items():
        want = {0}
        for x in v:
            want |= {s + round(x * 10) for s in want} if x is not None else set()
        assert got[g] == sorted(want)


def test_numeric_closure_takes_every_part(spark):
    from compare import SMALL
    from verdigris.plans import registry

    totals = {r.p_brand: r.t for r in spark.read.parquet(f"{SMALL}/part.parquet").groupBy("p_brand").agg(F.sum("p_size").alias("t")).collect()}
    got = {r.p_brand: r.sums.split(",") for r in registry.QUERIES["numeric_closure"](spark, SMALL).collect()}
    assert {g: int(s[-1]) for g, s in got.items()} == {g: 5 * t for g, t in totals.items()}


def test_split_body_and_table():
    text = "一" * 50 + "。" + "二" * 50 + "。" + "三" * 200
    parts = ingest.split_body(text, 100)
    assert "".join(parts) == text and max(map(len, parts)) <= 100
    table = "| a | b |\n|---|---|\n" + "\n".join(f"| {i} | x |" for i in range(60))
    cut = ingest.split_table(table, 120)
    assert len(cut) > 1 and all(len(p) <= 120 and "| a | b |" in p for p in cut)
    assert sum(p.count("| x |") for p in cut) == 60


def test_recommend_stops_when_closed(spark):
    rows = spark.createDataFrame([("p", i, i in (4, 5), "1", 3.0, 5.0) for i in range(1, 9)], "major string, course_code long, needed boolean, semester string, credits double, remaining double")
    assert [r.course_code for r in audit.recommend(rows, ["major"]).orderBy("place").collect()] == [4, 5]


def test_numbers_and_tables(spark):
    rows = spark.createDataFrame([(2.50,), (3.0,), (None,), (10.0,)], "x double")
    assert [r[0] for r in rows.select(render.number_text(F.col("x"))).collect()] == ["2.5", "3", "", "10"]
    t = spark.createDataFrame([("g", 1, "a|b"), ("g", 2, None)], "g string, i int, v string")
    assert render.markdown_table(t, ["g"], {"i": F.col("i"), "v": F.col("v")}, ["i"]).first().table.endswith("| 1 | a\\|b |\n| 2 |  |")
    assert spark.range(1).select(render.citation_format(F.lit("x【e 1】[E1] y"))).first()[0] == "x[E1] y"


def test_empty_frames(spark):
    docs = spark.createDataFrame([], "doc_id int, text string")
    q = spark.createDataFrame([(1, "a")], "query_id int, query_text string")
    assert retrieval.bm25_scores(docs, q, "doc_id", "text").count() == 0
    assert ingest.chunk_bodies(docs, "doc_id", "text", 100).count() == 0


def test_hashed_features_have_unit_length(spark):
    rows = spark.createDataFrame([(1, "a b a"), (2, None), (3, "学分")], "id int, text string")
    got = {r.id: r.embedding for r in retrieval.hashed_features(rows, "text", 16).collect()}
    assert all(len(v) == 16 for v in got.values()) and sum(got[2]) == 0
    assert abs(sum(x * x for x in got[1]) - 1) < 1e-9 and abs(sum(x * x for x in got[3]) - 1) < 1e-9


def test_equal_rows_keep_their_interval(spark):
    from verdigris.operators import resolve

    rows = spark.createDataFrame([("a", 2, "x"), ("a", 2, "x"), ("a", 5, "y"), ("a", 9, "z")], "file string, page int, note string")
    intervals = spark.createDataFrame([("a", 1, 3, "one"), ("a", 4, 6, "two"), ("a", 5, 7, "three")], "file string, start int, end int, label string")
    got = sorted((r.page, r.note, r.label) for r in resolve.label_by_interval(rows, intervals, ["file"], "page").collect())
    assert got == [(2, "x", "one"), (2, "x", "one")]
