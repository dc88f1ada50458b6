"""Narrowing, module and draft queries with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import narrowing as N
from ..sources.driver_tables import OFFERINGS_SQL, courses, load, offerings, values

QUERIES, ORACLES = {}, {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return add


@query(
    """WITH a AS (SELECT *, bool_or(l_returnflag = 'R') OVER (PARTITION BY l_orderkey) AS h FROM lineitem), b AS (SELECT * EXCLUDE (h) FROM a WHERE NOT h OR l_returnflag = 'R'),
    c AS (SELECT *, bool_or(l_quantity > 40) OVER (PARTITION BY l_orderkey) AS h FROM b) SELECT l_orderkey, l_linenumber FROM c WHERE l_orderkey % 2 = 1 OR NOT h OR l_quantity > 40"""
)
def narrowed_candidates(spark, d):
    line = load(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_quantity")
    steps = [(F.lit(True), F.col("l_returnflag") == "R"), (F.col("l_orderkey") % 2 == 0, F.col("l_quantity") > 40)]
    return N.narrow_in_turn(line, ["l_orderkey"], steps).select("l_orderkey", "l_linenumber")


_TOPICS = (("ECON|SMALL", "widget|ring", None), ("PROMO|LARGE", "plate", "1"))


@query("SELECT p_partkey FROM part WHERE (NOT regexp_matches(p_type, 'ECON|SMALL') OR regexp_matches(p_name, 'widget|ring')) AND (NOT regexp_matches(p_type, 'PROMO|LARGE') OR regexp_matches(p_name, 'plate') OR starts_with(p_partkey::VARCHAR, '1'))")
def course_topic_filter(spark, d):
    return load(spark, d, "part").where(N.topic_filter(F.col("p_type"), F.col("p_name"), F.col("p_partkey"), _TOPICS)).select("p_partkey")


@query("WITH m AS (SELECT p_brand, p_type, count_if(p_size > 40) AS n, max(CASE WHEN p_size = 7 THEN 2.0 END) AS r, max(CASE WHEN p_size = 9 THEN p_name ELSE '' END) AS t FROM part GROUP BY 1, 2) SELECT p_brand, p_type FROM m WHERE n > 0 OR r IS NOT NULL OR t <> ''")
def visible_modules(spark, d):
    m = load(spark, d, "part").groupBy("p_brand", "p_type").agg(
        F.count_if(F.col("p_size") > 40).alias("n"), F.max(F.when(F.col("p_size") == 7, 2.0)).alias("r"), F.max(F.when(F.col("p_size") == 9, F.col("p_name")).otherwise("")).alias("t")
    )
    return m.where(N.module_visible(F.col("n"), F.col("r"), F.col("t"))).select("p_brand", "p_type")


@query("SELECT p_partkey, (p_size % 10)::VARCHAR AS cohort_key, lower(p_brand) AS major_key, lower(replace(p_name, ' ', '')) AS module_key FROM part WHERE p_size % 5 <> 0 AND p_type <> 'PROMO' AND p_partkey % 3 <> 0")
def trusted_overlay_keys(spark, d):
    p = load(spark, d, "part")
    trusted = N.overlay_trusted(F.when(F.col("p_size") % 5 != 0, F.col("p_size")), F.when(F.col("p_type") != "PROMO", F.col("p_type")), F.when(F.col("p_partkey") % 3 != 0, F.col("p_name")))
    return p.where(trusted).select("p_partkey", *N.overlay_key(F.col("p_size") % 10, F.col("p_brand"), F.col("p_name")))


@query(OFFERINGS_SQL + " SELECT course_code AS code, course_name AS name, credits, module, course_nature AS nature, semester FROM offerings")
def public_courses(spark, d):
    return offerings(spark, d).select(*N.public_course("course_code", "course_name", "credits", "module", "course_nature", "semester"))


@query("SELECT p_partkey, p_type FROM part WHERE p_brand = 'Brand#13' AND p_type IN ('PROMO', 'SMALL')")
def requirements_by_module(spark, d):
    r = courses(spark, d).select("course_code", "major", "module")
    return N.requirements_of(r, "Brand#13", "Small / Promo").select(F.col("course_code").alias("p_partkey"), F.col("module").alias("p_type"))


_MAJORS = [("widget专业",), ("red widget专业",), ("ring专业",), ("d专业",), ("hot ring",)]


@query("SELECT p_partkey, CASE WHEN p_name LIKE '%red widget%' THEN 'red widget专业' WHEN p_name LIKE '%widget%' THEN 'widget专业' WHEN p_name LIKE '%hot ring%' THEN 'hot ring' ELSE 'ring专业' END AS major FROM part WHERE p_name LIKE '%widget%' OR p_name LIKE '%ring%'")
def longest_stem(spark, d):
    return N.longest_stem(load(spark, d, "part").select("p_partkey", "p_name"), values(spark, "major string", _MAJORS), "p_partkey", "p_name")


_WISHES = [(1, "promo items"), (2, "M"), (3, "xy-unknown"), (4, ""), (5, "none"), (6, "跨 standard")]
_ALIASES = [(1, "xy", "nothing"), (2, "unknown", "standard"), (3, "xy", "economy")]


@query(
    """WITH w(wish_id, w) AS (VALUES (1, 'promoitems'), (2, 'm'), (3, 'xyunknown'), (4, ''), (5, 'none'), (6, '跨standard')), a(place, a, p) AS (VALUES (1, 'xy', 'nothing'), (2, 'unknown', 'standard'), (3, 'xy', 'economy')),
    m AS (SELECT DISTINCT p_type AS module, lower(p_type) AS m FROM part),
    r AS (SELECT wish_id, 0 AS tier, abs(length(m) - length(w)) AS gap, module FROM w, m WHERE w <> '' AND (contains(m, w) OR contains(w, m)) UNION ALL SELECT wish_id, 2, place, module FROM w, a, m WHERE contains(w, a) AND (contains(m, p) OR contains(m, a))),
    b AS (SELECT *, row_number() OVER (PARTITION BY wish_id ORDER BY tier, gap, module) AS n FROM r) SELECT w.wish_id, module FROM w LEFT JOIN b ON w.wish_id = b.wish_id AND n = 1"""
)
def module_for_wish(spark, d):
    wishes, aliases = values(spark, "wish_id int, wish string", _WISHES), values(spark, "place int, alias string, preferred string", _ALIASES)
    return N.module_for(wishes, courses(spark, d).select("module"), aliases)


@query(
    """WITH q(question_id, s, planned) AS (VALUES (1, 'whatisaredwidget', ['old rod', 'red widget']), (2, 'hotringsandcoldwidgets', []::VARCHAR[]), (3, 'nothing', ['x'])),
    n AS (SELECT question_id, list_position(planned, x) AS k, x FROM (SELECT question_id, planned, unnest(planned) AS x FROM q)
    UNION ALL SELECT question_id, 10 + place, name FROM q JOIN (SELECT p_name AS name, min(p_partkey) AS place FROM part GROUP BY 1) ON contains(s, replace(name, ' ', ''))),
    f AS (SELECT question_id, x, min(k) AS k FROM n GROUP BY 1, 2) SELECT question_id, string_agg(x, '|' ORDER BY k) AS names FROM f GROUP BY 1"""
)
def candidate_names(spark, d):
    asked = [(1, "What is a red widget?", "old rod、 red widget"), (2, "hot rings and cold widgets", None), (3, "nothing", "x;")]
    q = values(spark, "question_id int, question string, planned string", asked)
    catalog = courses(spark, d).groupBy(F.col("course_name").alias("name")).agg(F.min("course_code").alias("place"))
    return N.candidate_names(q, catalog).select("question_id", F.array_join("names", "|").alias("names"))


@query(
    """SELECT item_id, CASE WHEN item_id % 2 = 0 THEN 'MAT' || (100 + item_id % 7) ELSE array_to_string(list_sort(list_distinct(list_filter(regexp_extract_all(text, '[A-Za-z][A-Za-z0-9+._-]{2,}'), lambda x: upper(x) NOT IN ('API', 'PDF')))), '|') || CASE WHEN item_id % 3 = 0 THEN '|毕业最低学分' ELSE '' END END AS entities FROM benchmark"""
)
def required_entities(spark, d):
    b = load(spark, d, "benchmark")
    tail = F.when(F.col("item_id") % 2 == 0, F.concat(F.lit(" mat-"), 100 + F.col("item_id") % 7)).when(F.col("item_id") % 3 == 0, F.lit(" API 毕业最低学分")).otherwise(" pdf")
    return b.select("item_id", F.array_join(F.array_sort(N.required_entities(F.concat("text", tail))), "|").alias("entities"))


@query(
    """WITH t AS (SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN ' ' WHEN doc_id % 9 = 0 THEN 'see www.example.org ' || text ELSE 'ABC10' || doc_id % 4 || ' ' || text || ' ' || doc_id % 5 || CASE WHEN doc_id % 2 = 0 THEN '。' ELSE '' END END AS t FROM documents)
    SELECT doc_id, CASE WHEN doc_id % 13 = 0 THEN 'unexpected_fields' WHEN doc_id % 7 = 0 THEN 'invalid_evidence_id' WHEN trim(t) = '' THEN 'empty_draft'
      WHEN regexp_matches(t, '(?i)https?://|www\\.') THEN 'unsafe_or_raw_output' WHEN doc_id % 4 = 3 THEN 'invented_course_code'
      WHEN len(list_filter(regexp_extract_all(regexp_replace(t, '[A-Za-z]\\d', '', 'g'), '\\d+(?:\\.\\d+)?'), lambda x: x::DOUBLE NOT IN (0, 1, 2, 3))) > 0 THEN 'invented_number'
      WHEN length(trim(t)) > 120 AND NOT regexp_matches(t, '[。！？；：\\n]') THEN 'unreadable_unpunctuated_output' END AS error FROM t"""
)
def explanation_errors(spark, d):
    i = F.col("doc_id")
    said = F.concat(F.lit("ABC10"), i % 4, F.lit(" "), F.col("text"), F.lit(" "), i % 5, F.when(i % 2 == 0, "。").otherwise(""))
    text = F.when(i % 11 == 0, " ").when(i % 9 == 0, F.concat(F.lit("see www.example.org "), "text")).otherwise(said)
    fields = F.when(i % 13 == 0, F.array(F.lit("summary"), F.lit("sql"))).otherwise(F.array(F.lit("summary")))
    known, numbers = F.array(*[F.lit(x).cast("bigint") for x in range(1, 7)]), F.array(*[F.lit(float(x)) for x in range(4)])
    error = N.explanation_error(fields, F.array((i % 7).cast("bigint")), known, text, F.array(*[F.lit(f"ABC10{x}") for x in range(3)]), numbers)
    return load(spark, d, "documents").select("doc_id", error.alias("error"))


@query("SELECT conv_id, count(*) AS n_pages, sum(length(regexp_replace(text, '[^㐀-鿿A-Za-z0-9]', '', 'g')))::BIGINT AS meaningful, sum(length(regexp_replace(text, '[^㐀-鿿A-Za-z0-9]', '', 'g'))) < greatest(160, 80 * count(*)) AS needs_ocr FROM conversations GROUP BY 1")
def recognition_needed(spark, d):
    return N.recognition_needed(load(spark, d, "conversations"), "conv_id", "text")


@query(
    """WITH p AS (SELECT item_id, text || CASE item_id % 5 WHEN 0 THEN '？' WHEN 1 THEN E'。\\n next' WHEN 2 THEN ' 注：short' WHEN 3 THEN ' 注：a note of enough characters；' ELSE ' ' END AS t FROM benchmark)
    SELECT item_id, CASE item_id % 5 WHEN 3 THEN '注：a note of enough characters[1]；' WHEN 0 THEN replace(trim(t, E' \\n')[:-2], E'\\n', '') || '[1]？' ELSE replace(replace(trim(t, E' \\n'), E'。\\n', '，'), E'\\n', '') || '[1]。' END AS cited FROM p"""
)
def cited_passages(spark, d):
    i = F.col("item_id") % 5
    tail = F.when(i == 0, "？").when(i == 1, "。\n next").when(i == 2, " 注：short").when(i == 3, " 注：a note of enough characters；").otherwise(" ")
    return load(spark, d, "benchmark").select("item_id", N.cited(F.concat("text", tail), F.lit(1), "-").alias("cited"))


@query("SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'empty' WHEN 1 THEN 'url' END AS error FROM pages")
def link_errors(spark, d):
    i = F.col("page_id") % 4
    url = F.when(i == 0, " ").when(i == 1, F.concat(F.lit("/"), "url")).when(i == 2, F.concat(F.lit(" HTTP://x.org/"), "url")).otherwise(F.col("url"))
    return load(spark, d, "pages").select("page_id", N.link_error(url).alias("error"))


@query("SELECT doc_id, lang FROM documents WHERE source = 'src4'")
def chunks_by_title(spark, d):
    return load(spark, d, "documents").where(F.col("source") == "src4").select("doc_id", "lang")
