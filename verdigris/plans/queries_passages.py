"""Passage, evidence and question queries with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import passages as P
from ..sources.driver_tables import SOURCES_SQL, load, sources

QUERIES, ORACLES = {}, {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


_ASKED = "in th 第3条 ER 101 12 2023 多少门"


@query(
    """WITH p AS (SELECT item_id, text || CASE item_id % 4 WHEN 0 THEN ' er-101' WHEN 1 THEN ' 第3条 12 门' WHEN 2 THEN ' 2023' ELSE '' END AS p FROM benchmark),
    t AS (SELECT *, list_distinct(regexp_extract_all(lower(p), '[a-z]+\\d*|\\d+(?:\\.\\d+)?%?')) AS w FROM p)
    SELECT item_id, round((len(list_intersect(['in', 'th', '3', 'er', '101', '12', '2023'], w)) + CASE WHEN item_id % 4 = 1 THEN 2 ELSE 0 END) / 11.0
      + CASE item_id % 4 WHEN 0 THEN 2.0 + 0.35 + 0.8 WHEN 1 THEN 1.2 + 0.7 + 0.8 + 1.2 WHEN 2 THEN 0.35 + 0.8 ELSE 0 END, 6) AS score FROM t"""
)
def passage_scores(spark, d):
    i = F.col("item_id") % 4
    tail = F.when(i == 0, " er-101").when(i == 1, " 第3条 12 门").when(i == 2, " 2023").otherwise("")
    return load(spark, d, "benchmark").select("item_id", F.round(P.passage_score(F.lit(_ASKED), F.concat("text", tail)), 6).alias("score"))


@query(None)
def excerpts(spark, d):
    """Every document's best passages for a question, in 800 characters (tested against a plain loop)."""
    return load(spark, d, "documents").select("doc_id", P.excerpt(F.lit("that and the nation in 2023"), F.col("text"), 800, 600).alias("excerpt"))


@query(
    """WITH n AS (SELECT conv_id, turn, coalesce(text, '') AS t, lag(turn) OVER w AS a, lag(coalesce(text, '')) OVER w AS a_text, lead(turn) OVER w AS b FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
    s AS (SELECT *, contains(t, 'er') AND contains(t, 'Th') AS own, a IS NOT NULL AND contains(t || chr(10) || a_text, 'er') AND contains(t || chr(10) || a_text, 'Th') AS two FROM n)
    SELECT conv_id, turn, turn || CASE WHEN own THEN '' ELSE coalesce(',' || a, '') || CASE WHEN two THEN '' ELSE coalesce(',' || b, '') END END AS evidence FROM s"""
)
def covering_evidence(spark, d):
    near = P.with_neighbours(load(spark, d, "conversations"), "conv_id", "turn", "turn", "text")
    ids = P.covering_evidence(F.col("turn"), F.col("text"), F.col("near"), F.array(F.lit("er"), F.lit("Th"), F.lit("")))
    return near.select("conv_id", "turn", F.array_join(ids.cast("array<string>"), ",").alias("evidence"))


@query(
    """WITH l AS (SELECT o_custkey, o_orderkey, o_orderpriority AS p, o_orderstatus AS t FROM orders WHERE o_orderkey % 4 <> 0),
    f AS (SELECT o_custkey, p, row_number() OVER (PARTITION BY o_custkey ORDER BY min(o_orderkey)) AS n FROM l GROUP BY 1, 2)
    SELECT o_custkey, string_agg(t || '[' || n || ']。', chr(10) ORDER BY o_orderkey) AS answer FROM l JOIN f USING (o_custkey, p) GROUP BY 1"""
)
def grounded_lines(spark, d):
    ids = F.when(F.col("o_orderkey") % 4 == 0, F.array().cast("array<string>")).otherwise(F.array("o_orderpriority"))
    line = load(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderstatus", ids.alias("ids"))
    return P.grounded_lines(line, ["o_custkey"], "o_orderkey", "o_orderstatus", "ids")


@query(
    """WITH c AS (SELECT *, p_size % 9 AS s, p_size % 4 AS w FROM part), r AS (SELECT p_brand, p_type AS chunk, p_partkey, p_name,
      CASE WHEN s IN (1, 2) AND w = 0 THEN s WHEN w = 1 AND s <= 2 AND p_partkey % 2 = 0 THEN 9 END AS k FROM c),
    u AS (SELECT DISTINCT * FROM r WHERE k IS NOT NULL),
    l AS (SELECT p_brand, k, chunk, string_agg(p_partkey || ' ' || p_name, '、' ORDER BY p_partkey::VARCHAR) AS names FROM u GROUP BY 1, 2, 3),
    f AS (SELECT p_brand, chunk, row_number() OVER (PARTITION BY p_brand ORDER BY min(k), chunk) AS n FROM l GROUP BY 1, 2)
    SELECT p_brand, string_agg('- ' || CASE k WHEN 9 THEN '跨学期安排（以培养方案标注范围为准）' ELSE '第' || k || '学期' END || '：' || names || '[' || n || ']。', chr(10) ORDER BY k, chunk) AS answer FROM l JOIN f USING (p_brand, chunk) GROUP BY 1"""
)
def schedule_answers(spark, d):
    s, w = F.col("p_size") % 9, F.col("p_size") % 4
    cell = F.when(w == 0, s.cast("string")).when(w == 1, F.concat(s, F.lit("-"), s + 1))
    rows = load(spark, d, "part").select(
        "p_brand", F.col("p_partkey").cast("string").alias("code"), F.col("p_name").alias("name"), cell.alias("semester"), F.col("p_type").alias("chunk"),
        F.when(F.col("p_partkey") % 2 == 0, "专业必修").otherwise("选修").alias("nature"), F.lit("通识教育基础课").alias("module"), F.array(F.lit(1), F.lit(2)).alias("asked"),
    )
    return P.schedule(rows, ["p_brand"])


@query(
    """WITH v AS (SELECT vec_id AS id, len(embedding) AS n FROM embeddings) SELECT (SELECT count(*) FROM documents) AS n_chunks, (SELECT count(*) FROM v) AS n_vectors, (SELECT count(*) FROM documents WHERE doc_id NOT IN (SELECT id FROM v)) AS n_missing,
    (SELECT count(*) FROM v WHERE id NOT IN (SELECT doc_id FROM documents)) AS n_extra, (SELECT count(*) FROM v WHERE n <> 64) AS n_misshapen, (SELECT count(*) FROM documents) = (SELECT count(*) FROM v WHERE n = 64 AND id IN (SELECT doc_id FROM documents)) AND (SELECT count(*) FROM v) = (SELECT count(*) FROM documents) AS ready"""
)
def index_checks(spark, d):
    vectors = load(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    return P.index_checks(load(spark, d, "documents").select(F.col("doc_id").alias("id")), vectors, "id", "embedding", 64)


@query(
    """SELECT item_id, CASE item_id % 5 WHEN 0 THEN '3,1' WHEN 1 THEN '3,4' WHEN 2 THEN '8,2' WHEN 3 THEN '5' ELSE '' END AS semesters FROM benchmark"""
)
def question_semesters(spark, d):
    i = F.col("item_id") % 5
    head = F.when(i == 0, "第三学期和第1学期 ").when(i == 1, "大二 ").when(i == 2, "第8学期 大一下 ").when(i == 3, "第5学期 大三上 ").otherwise("第9学期 ")
    return load(spark, d, "benchmark").select("item_id", F.array_join(P.question_semesters(F.concat(head, "text")), ",").alias("semesters"))


@query(
    """SELECT item_id, CASE item_id % 4 WHEN 0 THEN 'school_requirement' WHEN 1 THEN 'course_query' WHEN 2 THEN 'progress_audit' ELSE 'school_requirement' END AS intent,
    CASE item_id % 4 WHEN 0 THEN 'x,policy_explanation' WHEN 1 THEN 'x,course_list' ELSE 'x' END AS outputs, CASE WHEN item_id % 4 <> 1 THEN 'during_year_4' END AS relation FROM benchmark"""
)
def repaired_intents(spark, d):
    i = F.col("item_id") % 4
    q = F.concat(F.when(i == 0, "大学英语课程 ").when(i == 1, "大三上有哪些选修课 ").when(i == 2, "毕业 ").otherwise("艺术类课程 "), "text")
    intent = F.when(i == 0, "course_query").when(i == 2, "progress_audit").otherwise("school_requirement")
    out = P.repaired_intent(q, F.lit("school"), intent, F.when(i == 3, "m"), F.array(F.lit("x")), F.lit("during_year_4"))
    return load(spark, d, "benchmark").select("item_id", out.alias("o")).select("item_id", "o.intent", F.array_join("o.outputs", ",").alias("outputs"), "o.relation")


@query(
    """WITH m AS (SELECT l_orderkey, list_sort(list(DISTINCT 'm' || l_suppkey % 4)) AS m, list_sort(list(DISTINCT 'm' || l_suppkey % 4) FILTER (l_returnflag = 'R')) AS c FROM lineitem GROUP BY 1)
    SELECT l_orderkey, CASE WHEN c IS NOT NULL AND l_orderkey % 2 = 0 THEN array_to_string(list_filter(m, lambda x: NOT list_contains(c, x)), ',') ELSE array_to_string(m, ',') END AS modules,
    CASE WHEN c IS NOT NULL AND l_orderkey % 2 = 0 THEN array_to_string(c, ',') END AS excluded FROM m"""
)
def repaired_modules(spark, d):
    module = F.concat(F.lit("m"), F.col("l_suppkey") % 4)
    taken = F.collect_set(F.when(F.col("l_returnflag") == "R", module))
    m = load(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_set(module)).alias("m"), F.array_sort(taken).alias("c"))
    out = P.repaired_modules(F.lit("progress_audit"), F.when(F.col("l_orderkey") % 2 == 0, "list_courses").otherwise("audit"), F.col("m"), F.col("c"))
    return m.select("l_orderkey", out.alias("o")).select("l_orderkey", F.array_join("o.modules", ",").alias("modules"), F.array_join("o.excluded", ",").alias("excluded"))


@query(
    """SELECT r_regionkey, '还需要你补充：' || CASE r_regionkey % 2 WHEN 0 THEN '入学年级、具体专业' ELSE '已修课程清单或成绩单、other' END || '。信息齐全后我才能按对应培养方案准确查询。'
    || CASE WHEN r_regionkey % 2 = 0 THEN chr(10) || chr(10) || '当前年级下名称相近的专业有：' || chr(10) || (SELECT string_agg('- ' || n_name, chr(10) ORDER BY n_name) FROM nation WHERE n_regionkey = r_regionkey) ELSE '' END AS asked FROM region"""
)
def clarification_texts(spark, d):
    near = load(spark, d, "nation").groupBy(F.col("n_regionkey").alias("r_regionkey")).agg(F.array_sort(F.collect_list("n_name")).alias("near"))
    missing = F.when(F.col("r_regionkey") % 2 == 0, F.array(F.lit("cohort"), F.lit("major"))).otherwise(F.array(F.lit("completed_courses"), F.lit("other")))
    return load(spark, d, "region").join(near, "r_regionkey", "left").select("r_regionkey", P.clarification(missing, F.col("near")).alias("asked"))


@query(
    """SELECT c_custkey, CASE WHEN c_nationkey % 2 = 0 THEN 'school_rag' ELSE 'general_chat' END AS mode, c_nationkey % 2 = 0 AS requires_school_facts, c_mktsegment AS intent, CASE WHEN c_custkey % 3 <> 0 THEN '2023' END AS cohort,
    c_name AS rewritten_query, CASE WHEN c_custkey % 3 <> 0 THEN '2023|' ELSE '' END || c_name || '|' || c_mktsegment AS search_terms FROM customer"""
)
def routes_of_plans(spark, d):
    cohort = F.when(F.col("c_custkey") % 3 != 0, 2023)
    terms = P.terms_of(F.array(F.lit(None).cast("string"), cohort.cast("string")), F.array(F.col("c_name"), F.lit("")), F.lit(None).cast("array<string>"), F.array(F.col("c_mktsegment")))
    domain = F.when(F.col("c_nationkey") % 2 == 0, "school")
    return load(spark, d, "customer").select("c_custkey", *P.route_of(F.col("c_name"), domain, F.col("c_mktsegment"), cohort, F.array_join(terms, "|")))


@query("SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN p_name || ' 学分 ' || p_name || ' 学份' ELSE p_name END || CASE WHEN p_size % 3 = 0 THEN ' ' || p_brand ELSE '' END || ' ' || p_type AS query, greatest(p_size, 12) AS k FROM part")
def scoped_searches(spark, d):
    question = F.when(F.col("p_size") % 2 == 0, F.concat("p_name", F.lit(" 学份"))).otherwise(F.col("p_name"))
    major = F.when(F.col("p_size") % 3 == 0, F.col("p_brand"))
    return load(spark, d, "part").select("p_partkey", *P.scoped_search(question, major, F.array("p_type"), F.col("p_size")))


@query("SELECT doc_id, source, lang, substr(coalesce(text, ''), 1, 260) AS summary FROM documents")
def retrieved_summaries(spark, d):
    return load(spark, d, "documents").select("doc_id", "source", "lang", P.summary_of(F.col("text")).alias("summary"))


@query("SELECT p_partkey, '课程 ' || p_size AS label FROM part")
def short_labels(spark, d):
    raw = F.concat(F.lit(" |课程　 "), F.col("p_size"), F.lit(" Course "), "p_name", F.lit(" |"))
    return load(spark, d, "part").select("p_partkey", P.short_label(raw).alias("label"))


@query(
    """SELECT p_partkey, '- 第' || p_size % 8 || '学期：' || CASE WHEN p_partkey % 5 = 0 THEN '未标注' ELSE p_partkey::VARCHAR END || ' ' || p_name || '，' || CASE WHEN p_size % 4 = 0 THEN '0' ELSE replace(p_size / 2.0 || '', '.0', '') END || '学分，未标注，' || p_type
    || CASE WHEN p_size % 3 <> 0 THEN '，周学时' || p_size ELSE '' END || '，总学时17.5' AS line FROM part"""
)
def course_lines(spark, d):
    size = F.col("p_size")
    code, credits = F.when(F.col("p_partkey") % 5 != 0, F.col("p_partkey")), F.when(size % 4 != 0, size / 2)
    hours = {"weekly_hours": F.when(size % 3 != 0, size), "total_hours": F.lit(17.5), "practice_hours": F.lit(None).cast("double")}
    return load(spark, d, "part").select("p_partkey", P.course_line(size % 8, code, F.col("p_name"), credits, F.lit(None).cast("string"), F.col("p_type"), hours).alias("line"))


@query(SOURCES_SQL + " SELECT source, college, year::INTEGER AS year, 1 AS enabled FROM sources")
def loaded_sources(spark, d):
    return P.enabled_sources(sources(spark, d)).select("source", "college", "year", "enabled")
