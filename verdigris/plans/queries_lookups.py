"""Lookup, projection and contract queries with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import lookups as L
from ..sources.driver_tables import SEMESTER_SQL, SOURCES_SQL, courses, load, sources, values

QUERIES, ORACLES = {}, {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return add


def _chunks(spark, d):
    return load(spark, d, "documents").join(sources(spark, d), "source")


_CHUNKS = SOURCES_SQL + ", chunks AS (SELECT d.*, s.* EXCLUDE (source) FROM documents d JOIN sources s ON d.source = s.source)"


@query(_CHUNKS + " SELECT doc_id, source FROM chunks WHERE cohort = '2023' AND source LIKE 'src%' AND text LIKE '%e%' ORDER BY (lang = 'de') DESC, doc_id LIMIT 20")
def metadata_lookup(spark, d):
    return L.metadata_lookup(_chunks(spark, d), {"cohort": "2023", "source": "src%", "text": "%e%"}, F.col("lang") == "de", "doc_id", 20).select("doc_id", "source")


_RULES = (("(?i)the", "2023"), ("(?i)und", "2024"))


@query(
    _CHUNKS
    + """, a AS (SELECT doc_id FROM chunks WHERE cohort = '2023' ORDER BY doc_id LIMIT 3), b AS (SELECT doc_id FROM chunks WHERE cohort = '2024' ORDER BY doc_id LIMIT 3)
    SELECT item_id AS question_id, doc_id FROM benchmark, a WHERE regexp_matches(text, '(?i)the') UNION SELECT item_id, doc_id FROM benchmark, b WHERE regexp_matches(text, '(?i)und')"""
)
def authoritative_lookups(spark, d):
    rules = [(p, L.metadata_lookup(_chunks(spark, d), {"cohort": c}, F.lit(False), "doc_id", 3).select("doc_id")) for p, c in _RULES]
    return L.triggered(load(spark, d, "benchmark").withColumnRenamed("item_id", "question_id"), "text", rules)


@query(SOURCES_SQL + " SELECT doc_id, source, lang, n_chars FROM documents WHERE source IN (SELECT source FROM sources WHERE enabled AND trusted) AND doc_id IN (SELECT doc_id FROM labels)")
def trusted_point_lookup(spark, d):
    wanted = load(spark, d, "documents").join(load(spark, d, "labels").select("doc_id"), "doc_id", "left_semi")
    return L.trusted_only(wanted, sources(spark, d), "source").select("doc_id", "source", "lang", "n_chars")


@query("SELECT n_nationkey, s AS segment, EXISTS (SELECT 1 FROM customer WHERE c_nationkey = n_nationkey AND c_mktsegment = s) AS found FROM nation, (VALUES ('BUILDING'), ('NOWHERE')) v(s)")
def program_exists(spark, d):
    pairs = load(spark, d, "nation").select("n_nationkey", F.explode(F.array(F.lit("BUILDING"), F.lit("NOWHERE"))).alias("segment"))
    rows = load(spark, d, "customer").select(F.col("c_nationkey").alias("n_nationkey"), F.col("c_mktsegment").alias("segment"))
    return L.exists_in(pairs, rows, ["n_nationkey", "segment"])


@query(f"SELECT 'row-' || p_partkey AS record_id, trim(regexp_replace(p_name, '\\s+', ' ', 'g')) AS name, coalesce({SEMESTER_SQL}, '未标注') AS semester, CASE WHEN p_size % 5 = 0 THEN 0.0 ELSE p_size END::DOUBLE AS credits FROM part WHERE p_partkey % 2 = 0 UNION ALL SELECT p_partkey::VARCHAR, trim(regexp_replace(p_name, '\\s+', ' ', 'g')), coalesce({SEMESTER_SQL}, '未标注'), CASE WHEN p_size % 5 = 0 THEN 0.0 ELSE p_size END::DOUBLE FROM part WHERE p_partkey % 2 = 1")
def course_facts(spark, d):
    c = courses(spark, d).withColumn("code", F.when(F.col("course_code") % 2 == 1, F.col("course_code"))).withColumn("credits", F.when(F.col("p_size") % 5 != 0, F.col("credits")))
    return c.select(*L.course_fact("course_code", "code", "course_name", "semester", "credits"))


@query("SELECT count(DISTINCT page_id) AS pages, count(DISTINCT CASE WHEN contains(html, '<table') THEN page_id END) AS table_pages FROM pages")
def table_pages(spark, d):
    p = load(spark, d, "pages")
    return p.agg(F.countDistinct("page_id").alias("pages"), F.countDistinct(F.when(F.contains(F.col("html"), F.lit("<table")), F.col("page_id"))).alias("table_pages"))


@query("SELECT o_custkey, array_to_string(list_distinct_ordered, ',') AS ids FROM (SELECT o_custkey, list_transform(list_sort(list(DISTINCT o_orderkey)), lambda x: x::VARCHAR) AS list_distinct_ordered FROM orders GROUP BY 1)")
def evidence_id_sets(spark, d):
    o = load(spark, d, "orders").groupBy("o_custkey").agg(F.min("o_orderkey").cast("string").alias("main"), F.transform(F.array_sort(F.collect_list("o_orderkey")), lambda x: x.cast("string")).alias("supporting"))
    return o.select("o_custkey", F.array_join(L.evidence_ids(F.col("main"), F.col("supporting")), ",").alias("ids"))


@query(f"SELECT p_brand, count(*) AS unmarked FROM part WHERE ({SEMESTER_SQL}) IS NULL GROUP BY 1")
def unmarked_baseline(spark, d):
    c = courses(spark, d).where("semester IS NULL")
    return c.join(load(spark, d, "part").select(F.col("p_partkey").alias("course_code"), "p_brand"), "course_code").groupBy("p_brand").agg(F.count(F.lit(1)).alias("unmarked"))


@query("SELECT l_orderkey, l_linenumber FROM lineitem a WHERE EXISTS (SELECT 1 FROM lineitem b WHERE b.l_quantity > 49 AND (a.l_orderkey, a.l_partkey, a.l_suppkey, a.l_linenumber, a.l_returnflag, a.l_quantity) = (b.l_orderkey, b.l_partkey, b.l_suppkey, b.l_linenumber, b.l_returnflag, b.l_quantity))")
def affected_courses(spark, d):
    line, keys = load(spark, d, "lineitem"), ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_returnflag", "l_quantity"]
    return line.join(line.where("l_quantity > 49").select(*keys), keys, "left_semi").select("l_orderkey", "l_linenumber")


@query(
    """WITH c AS (SELECT doc_id AS claim_id, lang, source, substr(text, 5, 6) AS needle FROM documents WHERE length(text) > 11),
    m AS (SELECT claim_id, d.doc_id, row_number() OVER (PARTITION BY claim_id ORDER BY d.doc_id % 2 DESC, length(d.text), d.doc_id) AS n FROM c JOIN documents d ON c.lang = d.lang AND c.source = d.source WHERE contains(d.text, c.needle)) SELECT claim_id, doc_id FROM m WHERE n = 1"""
)
def evidence_by_containment(spark, d):
    docs = load(spark, d, "documents").select("doc_id", "lang", "source", "text")
    claims = docs.where(F.char_length("text") > 11).select(F.col("doc_id").alias("claim_id"), "lang", "source", F.substring("text", 5, 6).alias("needle"))
    order = [-(F.col("doc_id") % 2), F.char_length("text")]
    return L.best_evidence(claims, docs, ["lang", "source"], "needle", "text", order, "claim_id", "doc_id")


@query("WITH f AS (SELECT o_custkey, o_orderpriority, min(o_orderkey) AS s FROM orders GROUP BY 1, 2) SELECT o_custkey, o_orderpriority, row_number() OVER (PARTITION BY o_custkey ORDER BY s, o_orderpriority)::INTEGER AS marker FROM f")
def citation_markers(spark, d):
    return L.citation_markers(load(spark, d, "orders"), ["o_custkey"], "o_orderpriority", "o_orderkey")


@query(SOURCES_SQL + " SELECT DISTINCT source AS major FROM sources WHERE college = 'src4' OR college = '全校' ORDER BY 1 LIMIT 8")
def major_candidates(spark, d):
    return sources(spark, d).where(F.col("college").isin("src4", "全校")).select(F.col("source").alias("major")).distinct().orderBy("major").limit(8)


@query("SELECT p_name, p_partkey AS last_key, n FROM (SELECT p_name, p_partkey, row_number() OVER (PARTITION BY p_name ORDER BY p_partkey DESC) AS r, count(*) OVER (PARTITION BY p_name) AS n FROM part) WHERE r = 1")
def source_lookup_maps(spark, d):
    p = load(spark, d, "part").select("p_name", "p_partkey")
    return L.latest_by_key(p, "p_name", "p_partkey").withColumnRenamed("p_partkey", "last_key").join(p.groupBy("p_name").agg(F.count(F.lit(1)).alias("n")), "p_name")


@query(SOURCES_SQL + " SELECT 'college' AS kind, college AS value FROM sources GROUP BY 2 UNION ALL SELECT 'cohort', cohort FROM sources GROUP BY 2")
def known_values(spark, d):
    s = sources(spark, d)
    kinds = [s.select(F.lit(k).alias("kind"), F.col(k).alias("value")).distinct() for k in ("college", "cohort")]
    return kinds[0].unionByName(kinds[1])


@query("SELECT p_brand AS plan, array_to_string(list_sort(list(DISTINCT p_type)), ',') AS modules, count(*) AS n FROM part GROUP BY 1")
def modules_by_plan(spark, d):
    return courses(spark, d).groupBy(F.col("major").alias("plan")).agg(F.array_join(F.array_sort(F.collect_set("module")), ",").alias("modules"), F.count(F.lit(1)).alias("n"))


@query(f"SELECT (SELECT count(*) FROM (SELECT DISTINCT p_brand, p_type, p_name, p_size, {SEMESTER_SQL} AS s FROM part)) AS with_semester, (SELECT count(*) FROM (SELECT DISTINCT p_brand, p_type, p_name, p_size FROM part)) AS without, (SELECT sum(k) FROM (SELECT min(p_partkey) AS k FROM part GROUP BY p_brand, p_type, p_name, p_size))::BIGINT AS kept_ids")
def catalog_dedup(spark, d):
    c, four = courses(spark, d), ["major", "module", "course_name", "p_size"]
    five = L.first_by_keys(c, [*four, "semester"], "course_code").agg(F.count(F.lit(1)).alias("with_semester"))
    return five.join(L.first_by_keys(c, four, "course_code").agg(F.count(F.lit(1)).alias("without"), F.sum("course_code").alias("kept_ids")))


@query("SELECT p_brand, sum(n)::BIGINT AS row_count, sum(CASE WHEN c % 5 = 0 THEN 0.0 ELSE c END)::DOUBLE AS total FROM (SELECT p_brand, p_name, count(*) AS n, arg_min(p_size, p_partkey)::DOUBLE AS c FROM part GROUP BY 1, 2) GROUP BY 1")
def deduplicated_total(spark, d):
    p = load(spark, d, "part").withColumn("credits", F.when(F.col("p_size") % 5 != 0, F.col("p_size").cast("double")))
    return L.deduplicated_total(p, ["p_brand"], ["p_name"], "p_partkey", "credits")


@query("SELECT k, least(50, greatest(24, 4 * k)) AS size FROM (VALUES (1), (6), (10), (40)) v(k)")
def candidate_windows(spark, d):
    k = values(spark, "k int", [(1,), (6,), (10,), (40,)])
    return k.select("k", L.candidate_window(F.lit(24), F.col("k")).alias("size"))


@query("SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY (l_returnflag = 'R') DESC, l_quantity DESC, l_linenumber)::INTEGER AS place FROM lineitem")
def authoritative_first(spark, d):
    return L.clause_first(load(spark, d, "lineitem"), ["l_orderkey"], F.col("l_returnflag") == "R", "l_quantity", "l_linenumber").select("l_orderkey", "l_linenumber", "place")


@query("SELECT p_partkey, CASE WHEN p_type = p_name THEN p_name || '|x' WHEN p_type = 'x' THEN 'x|' || p_name ELSE p_type || '|' || p_name || '|x' END AS merged FROM part")
def ordered_union(spark, d):
    lists = [F.array("p_type"), F.array("p_name", "p_type"), F.array(F.lit("x"))]
    return load(spark, d, "part").select("p_partkey", F.array_join(L.ordered_union(*lists), "|").alias("merged"))


@query("SELECT item_id, array_to_string(list_sort(list_filter(list_distinct(regexp_extract_all(lower(regexp_replace(text, '\\[\\d+\\]', '', 'g')), '[a-z]+\\d*|\\d+(?:\\.\\d+)?%?')), lambda x: x NOT IN ('the', 'and', 'und'))), ' ') AS tokens FROM benchmark")
def claim_tokens(spark, d):
    return load(spark, d, "benchmark").select("item_id", F.array_join(L.claim_tokens(F.col("text"), ["the", "and", "und"]), " ").alias("tokens"))


@query("SELECT conv_id, string_agg('[' || n || '] ' || role || chr(10) || text, chr(10) || chr(10) ORDER BY n) AS context FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations) GROUP BY 1")
def context_blocks(spark, d):
    return L.context_blocks(load(spark, d, "conversations"), ["conv_id"], "turn", "role", "text")


@query("SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN 'score' END AS error FROM embeddings")
def retrieved_contract_errors(spark, d):
    score = F.when(F.col("vec_id") % 7 != 0, F.get("embedding", F.lit(0)).cast("double"))
    return load(spark, d, "embeddings").select("vec_id", L.score_error(score).alias("error"))


@query("SELECT conv_id, turn, CASE WHEN trim(text) = '' THEN 'answer_md' WHEN turn % 5 = 4 THEN 'refused' WHEN turn % 5 = 3 THEN 'citations' END AS error FROM conversations")
def answer_contract_errors(spark, d):
    e = L.answer_error(F.col("text"), F.when(F.col("turn") % 5 != 4, F.lit(False)), F.when(F.col("turn") % 5 != 3, F.array(F.lit(1))))
    return load(spark, d, "conversations").select("conv_id", "turn", e.alias("error"))


@query("SELECT event_id, CASE WHEN event_id % 3 = 1 THEN 'forbidden' WHEN event_id % 3 = 2 THEN 'json' END AS error FROM events")
def draft_errors(spark, d):
    payload = F.when(F.col("event_id") % 3 == 0, F.col("props")).when(F.col("event_id") % 3 == 1, F.lit('{"intent": 1, "sql": "x"}')).otherwise("[1, 2")
    return load(spark, d, "events").select("event_id", L.draft_error(payload).alias("error"))


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)")
def ineligible_ids(spark, d):
    vectors = load(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"))
    return L.ineligible(load(spark, d, "documents").select("doc_id"), vectors, "doc_id")


@query("SELECT l_orderkey, arg_min(l_quantity, l_linenumber * 1000 + l_quantity) / 50 >= 0.35 AS baseline, max(l_quantity) / 50 >= 0.35 AS advanced FROM lineitem GROUP BY 1")
def baseline_and_advanced_gate(spark, d):
    return L.both_gates(load(spark, d, "lineitem").withColumn("score", F.col("l_quantity") / 50), "l_orderkey", "l_linenumber", "score")


@query(f"SELECT p_partkey, CASE WHEN p_size % 12 < 8 THEN p_size % 12 + 1 WHEN p_size % 12 = 8 THEN 1 END::INTEGER AS first, CASE WHEN p_size % 12 < 8 THEN p_size % 12 + 1 WHEN p_size % 12 = 8 THEN 2 END::INTEGER AS last FROM part")
def semester_bounds(spark, d):
    b = L.semester_bounds(F.col("semester"))
    return courses(spark, d).select(F.col("course_code").alias("p_partkey"), b["first"].alias("first"), b["last"].alias("last"))


@query("SELECT 'documents' AS name, count(*) AS n, count(*) >= 100 AS passed FROM documents UNION ALL SELECT 'nation', count(*), count(*) >= 1000 FROM nation")
def row_gates(spark, d):
    counts = [load(spark, d, t).agg(F.lit(t).alias("name"), F.count(F.lit(1)).alias("n")) for t in ("documents", "nation")]
    return L.row_gates(counts[0].unionByName(counts[1]), {"documents": 100, "nation": 1000})


@query("SELECT lang, round(avg(CASE WHEN (length(text) < 300) = (quality = 0) THEN 1.0::DOUBLE ELSE 0 END), 6) AS refusal_accuracy, count_if(toxic = 1 AND length(text) >= 300) AS unsupported, count(*) AS n FROM documents JOIN labels USING (doc_id) WHERE quality IS NOT NULL GROUP BY 1")
def refusal_accuracy(spark, d):
    rows = load(spark, d, "documents").join(load(spark, d, "labels").where("quality IS NOT NULL"), "doc_id")
    refused = F.char_length("text") < 300
    right = F.when(refused == (F.col("quality") == 0), 1.0).otherwise(0.0)
    return rows.groupBy("lang").agg(F.round(F.avg(right), 6).alias("refusal_accuracy"), F.count_if((F.col("toxic") == 1) & ~refused).alias("unsupported"), F.count(F.lit(1)).alias("n"))
