"""Store, resolution and catalog queries with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.text import compact_listed, compact_strict, host_of, in_domain, topic_of
from ..functions.terms import semester_display, semester_positions, semester_sort_key, semester_values
from ..functions.subjects import subjects_of
from ..operators import catalog, resolve, store
from ..sources.driver_tables import FIRST_SQL, LAST_SQL, OFFERINGS_SQL, SEMESTER_SQL, SOURCES_SQL, courses, load, offerings, sources, values

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _scope(spark, d, **scope):
    chunks = load(spark, d, "documents").select("doc_id", "source", "lang")
    return store.scoped(chunks, sources(spark, d), "source", **scope).select("doc_id", "source", "status", "cohort", "year")


_CHUNKS = "SELECT d.doc_id, d.source, s.status, s.cohort, s.year FROM documents d JOIN sources s ON d.source = s.source WHERE s.enabled AND s.trusted"


@query(SOURCES_SQL + _CHUNKS + " AND s.status = '现行'")
def scope_candidates_default(spark, d):
    return _scope(spark, d)


@query(SOURCES_SQL + _CHUNKS + " AND (s.status = '现行' OR s.cohort = '2023') AND s.cohort IN ('不限', '2023') AND (s.level = '校级' OR s.college = 'src4')")
def scope_candidates_cohort(spark, d):
    return _scope(spark, d, cohort="2023", college="src4")


@query(SOURCES_SQL + _CHUNKS + " AND s.year = 2019 AND s.topic = 'promotion'")
def scope_candidates_year(spark, d):
    return _scope(spark, d, year=2019, topic="promotion")


@query(SOURCES_SQL + "SELECT source, level, year FROM sources WHERE enabled AND trusted AND status = '现行' AND cohort IN ('不限', '2023') ORDER BY CASE WHEN level = '院级' THEN 0 ELSE 1 END, year DESC, source LIMIT 3")
def scope_links_top3(spark, d):
    s = sources(spark, d).withColumn("doc_title", F.col("source"))
    return store.official_links(s, cohort="2023").select("source", "level", "year")


@query(SOURCES_SQL + ", state(source, t, e) AS (VALUES ('src3', true, true), ('src4', false, NULL)) SELECT s.source, coalesce(t, trusted) AS trusted, coalesce(e, enabled) AS enabled FROM sources s LEFT JOIN state USING (source)")
def scope_state_overlay(spark, d):
    state = values(spark, "source string, trusted boolean, enabled boolean", [("src3", True, True), ("src4", False, None)])
    return store.with_state(sources(spark, d), state, "source").select("source", "trusted", "enabled")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_acctbal > 0)")
def integrity_orphans(spark, d):
    good = load(spark, d, "customer").where("c_acctbal > 0")
    return store.orphans(load(spark, d, "orders").select("o_orderkey", "o_custkey"), good, "o_custkey", "c_custkey").select("o_orderkey", "o_custkey")


@query("SELECT o_orderstatus, count(*) AS n FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING') GROUP BY 1")
def integrity_semi(spark, d):
    c = load(spark, d, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return load(spark, d, "orders").join(c, "o_custkey", "left_semi").groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"))


@query(
    """SELECT doc_id, first_value(doc_id) OVER (PARTITION BY h ORDER BY n_chars DESC, doc_id) AS canonical_id, h AS content_hash
    FROM (SELECT doc_id, n_chars, sha256(lower(regexp_replace(regexp_replace(CASE WHEN strpos(text, chr(10)) > 0 THEN substr(text, strpos(text, chr(10)) + 1) ELSE text END, '原文件第\\d+页|第\\d+页表格', '', 'g'), '[\\s\\v]+', '', 'g'))) AS h FROM documents)"""
)
def near_dup_canonical(spark, d):
    docs = load(spark, d, "documents")
    return store.canonical_chunks(docs, "text", [F.desc("n_chars"), F.col("doc_id")], "doc_id").select("doc_id", "canonical_id", "content_hash")


@query(
    """WITH a AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, s_acctbal, row_number() OVER (PARTITION BY l_partkey, l_suppkey ORDER BY s_acctbal DESC, l_orderkey DESC, l_linenumber, l_extendedprice, l_quantity) AS n FROM lineitem JOIN supplier ON l_suppkey = s_suppkey)
    SELECT l_partkey, l_suppkey, l_orderkey, l_linenumber FROM a WHERE n = 1"""
)
def primary_offering(spark, d):
    rows = load(spark, d, "lineitem").join(load(spark, d, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_acctbal"), "l_suppkey")
    order = [F.desc("s_acctbal"), F.desc("l_orderkey"), F.col("l_linenumber"), F.col("l_extendedprice"), F.col("l_quantity")]
    return store.primary(rows, ["l_partkey", "l_suppkey"], order).where("is_primary").select("l_partkey", "l_suppkey", "l_orderkey", "l_linenumber")


@query("SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice)::INTEGER AS source_row, l_partkey FROM lineitem")
def page_row_ordinal(spark, d):
    rows = load(spark, d, "lineitem")
    return store.page_ordinal(rows, ["l_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]).select("l_orderkey", "l_linenumber", "source_row", "l_partkey")


@query(
    """WITH base AS (SELECT p_type AS module, 100 AS priority, sum(p_size)::DOUBLE AS minimum, 0 AS header FROM part GROUP BY 1),
    head(module, priority, minimum, header) AS (VALUES ('STANDARD', 1100, 12.0::DOUBLE, 1), ('PROMO', 1100, 7.5::DOUBLE, 1)),
    u AS (SELECT * FROM base UNION ALL SELECT * FROM head), r AS (SELECT *, row_number() OVER (PARTITION BY module ORDER BY priority DESC, header DESC) AS n FROM u)
    SELECT module, minimum, header::INTEGER AS header FROM r WHERE n = 1"""
)
def header_override_requirement(spark, d):
    base = load(spark, d, "part").groupBy(F.col("p_type").alias("module")).agg(F.sum("p_size").cast("double").alias("minimum")).select("module", F.lit(100).alias("priority"), "minimum", F.lit(0).alias("header"))
    head = values(spark, "module string, priority int, minimum double, header int", [("STANDARD", 100 + store.HEADER_PRIORITY, 12.0, 1), ("PROMO", 100 + store.HEADER_PRIORITY, 7.5, 1)])
    return store.primary(base.unionByName(head), ["module"], [F.desc("priority"), F.desc("header")]).where("is_primary").select("module", "minimum", "header")


@query(
    """WITH w(want_id, title, cohort, url) AS (VALUES (1, 'O', '1-URGENT', 'c7'), (2, 'F', '5-LOW', 'none'), (3, 'P', 'none', 'none')),
    s AS (SELECT o_orderstatus AS title, o_orderpriority AS cohort, 'c' || o_custkey AS url, o_orderkey AS file, round(o_totalprice)::BIGINT AS priority FROM orders),
    m AS (SELECT want_id, file, priority, CASE WHEN w.cohort = s.cohort AND w.url = s.url THEN 1 WHEN w.cohort = s.cohort THEN 2 ELSE 3 END AS tier FROM w JOIN s USING (title)),
    r AS (SELECT *, row_number() OVER (PARTITION BY want_id ORDER BY tier, priority DESC, file) AS n FROM m)
    SELECT want_id, tier, file FROM r WHERE n = 1"""
)
def source_resolution_fallback(spark, d):
    wanted = values(spark, "want_id int, title string, cohort string, url string", [(1, "O", "1-URGENT", "c7"), (2, "F", "5-LOW", "none"), (3, "P", "none", "none")])
    have = load(spark, d, "orders").select(F.col("o_orderstatus").alias("doc_title"), F.col("o_orderpriority").alias("cohort"), F.concat(F.lit("c"), "o_custkey").alias("page_url"), F.col("o_orderkey").alias("file"), F.round("o_totalprice").cast("bigint").alias("priority"))
    return store.resolve_sources(wanted, have)


_OFFER = "SELECT l_orderkey, l_linenumber, course_code, semester FROM offerings"


@query(OFFERINGS_SQL + _OFFER + " WHERE p_size % 12 IN (0, 8)")
def course_query_semesters(spark, d):
    return store.course_query(offerings(spark, d), semesters=[1]).select("l_orderkey", "l_linenumber", "course_code", "semester")


@query(OFFERINGS_SQL + _OFFER + " WHERE contains(course_nature, '选修') OR contains(module, '专业方向')")
def course_query_elective(spark, d):
    return store.course_query(offerings(spark, d), elective=True).select("l_orderkey", "l_linenumber", "course_code", "semester")


@query("SELECT p_partkey AS course_code, p_name AS course_name FROM part WHERE lower(regexp_replace(p_name, '[^0-9A-Za-z]+', '', 'g')) = 'redwidget'")
def course_query_exact_or_contains(spark, d):
    return store.name_match(courses(spark, d), "Red  Widget").select("course_code", "course_name")


@query(
    OFFERINGS_SQL
    + _OFFER
    + " WHERE p_size % 12 IN (1, 2, 8, 10) AND (contains(course_name, 'widget') OR contains(course_name, 'bolt')) AND contains(course_nature, '必修') AND NOT contains(module, 'PROMO')"
)
def course_filter_live(spark, d):
    rows = store.course_filter(offerings(spark, d), semesters=[2, 3], names=["widget", "bolt"], natures=["必修"], exclude_modules=["promo"])
    return rows.select("l_orderkey", "l_linenumber", "course_code", "semester")


@query(
    "SELECT p_partkey, CASE WHEN p_size % 12 < 8 THEN (p_size % 12 + 1)::VARCHAR WHEN p_size % 12 = 8 THEN '1,2' WHEN p_size % 12 = 10 THEN '3,4,5,6' ELSE '' END AS semesters, "
    f"coalesce(upper({SEMESTER_SQL}).replace('S1', '暑期学期1'), '未标注') AS label FROM part"
)
def semester_expand(spark, d):
    c = courses(spark, d)
    return c.select(F.col("course_code").alias("p_partkey"), F.array_join(F.transform(semester_values(F.col("semester")), lambda x: x.cast("string")), ",").alias("semesters"), semester_display(F.col("semester")).alias("label"))


@query(f"SELECT p_partkey, ({FIRST_SQL})::DOUBLE AS first_place, ({LAST_SQL})::DOUBLE AS last_place, (CASE WHEN p_size % 12 < 8 THEN p_size % 12 + 1 WHEN p_size % 12 = 8 THEN 1 WHEN p_size % 12 = 9 THEN 2 WHEN p_size % 12 = 10 THEN 3 ELSE 99 END)::INTEGER AS sort_key FROM part")
def semester_positions_range(spark, d):
    p = semester_positions(F.col("semester"))
    return courses(spark, d).select(F.col("course_code").alias("p_partkey"), F.array_min(p).alias("first_place"), F.array_max(p).alias("last_place"), semester_sort_key(F.col("semester")).alias("sort_key"))


@query(
    """SELECT p_partkey, concat_ws(',', CASE WHEN regexp_matches(s, 'widget|gizmo') OR starts_with(c, 'BRAND#1') THEN 'gadgets' END, CASE WHEN regexp_matches(s, 'bolt|gear|plate') THEN 'hardware' END, CASE WHEN regexp_matches(s, 'PROMO') THEN 'offers' END) AS subjects
    FROM (SELECT p_partkey, upper(p_brand) AS c, concat_ws(' ', p_name, upper(p_brand), p_type, '') AS s FROM part)"""
)
def subject_multilabel(spark, d):
    rules = (("gadgets", ("BRAND#1",), "widget|gizmo"), ("hardware", (), "bolt|gear|plate"), ("offers", (), "PROMO"))
    p = load(spark, d, "part")
    return p.select("p_partkey", F.array_join(subjects_of(F.col("p_name"), F.col("p_brand"), F.col("p_type"), F.lit(None), rules), ",").alias("subjects"))


@query("SELECT doc_id, CASE WHEN contains(t, 'the ') OR contains(t, 'and ') THEN 'english' WHEN contains(t, ' la ') OR contains(t, ' le ') THEN 'romance' WHEN contains(t, 'sch') THEN 'german' ELSE 'other' END AS topic FROM (SELECT doc_id, source || chr(10) || substr(text, 1, 1000) AS t FROM documents)")
def topic_first_rule(spark, d):
    rules = (("english", ("the ", "and ")), ("romance", (" la ", " le ")), ("german", ("sch",)))
    return load(spark, d, "documents").select("doc_id", topic_of(F.col("source"), F.col("text"), rules, "other").alias("topic"))


@query(
    """SELECT doc_id, lower(regexp_replace(t, '[\\s\\v·•，,。；;：:（）()《》\\[\\]【】\\-_/]+', '', 'g')) AS listed, lower(regexp_replace(t, '[^0-9A-Za-z\\x{4e00}-\\x{9fff}]+', '', 'g')) AS strict
    FROM (SELECT doc_id, CASE WHEN strpos(text, chr(10)) > 0 THEN substr(text, 1, strpos(text, chr(10)) - 1) ELSE text END AS t FROM documents)"""
)
def compact_variants(spark, d):
    t = F.substring_index("text", "\n", 1)
    return load(spark, d, "documents").select("doc_id", compact_listed(t).alias("listed"), compact_strict(t).alias("strict"))


@query("SELECT a.o_orderkey AS anchor, b.o_orderkey, b.o_custkey FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey AND abs(a.o_orderkey - b.o_orderkey) <= 500 WHERE a.o_totalprice > 400000")
def neighbours_radius(spark, d):
    o = load(spark, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return store.neighbours(o, o.where("o_totalprice > 400000"), ["o_custkey"], "o_orderkey", 500).select("anchor", "o_orderkey", "o_custkey")


_RANGES = [("STANDARD", "low half", 1, 25), ("STANDARD", "high half", 20, 50), ("PROMO", "all", 1, 50), ("SMALL", "start", 5, 10)]


@query(
    """WITH r(p_type, label, low, high) AS (VALUES ('STANDARD', 'low half', 1, 25), ('STANDARD', 'high half', 20, 50), ('PROMO', 'all', 1, 50), ('SMALL', 'start', 5, 10)),
    i AS (SELECT p_type, label, coalesce(max(high) OVER (PARTITION BY p_type ORDER BY high, low, label ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1, low) AS s, high AS e FROM r)
    SELECT p_partkey, min(label) AS label FROM part JOIN i USING (p_type) WHERE p_size BETWEEN s AND e GROUP BY p_partkey HAVING count(*) = 1"""
)
def interval_label_unique(spark, d):
    ranges = values(spark, "p_type string, label string, low int, high int", _RANGES)
    spans = resolve.intervals_of(ranges, ["p_type"])
    return resolve.label_by_interval(load(spark, d, "part").select("p_partkey", "p_type", "p_size"), spans, ["p_type"], "p_size").select("p_partkey", "label")


@query(
    """WITH q AS (SELECT lang, source, min(length(text)) AS n FROM documents GROUP BY 1, 2)
    SELECT item_id, (SELECT min(doc_id) FROM documents d WHERE d.lang = 'en' AND d.source = 'src' || (item_id % 20) AND length(text) = q.n) AS evidence, q.n AS evidence_chars
    FROM benchmark LEFT JOIN q ON q.lang = 'en' AND q.source = 'src' || (item_id % 20)"""
)
def evidence_shortest(spark, d):
    claims = load(spark, d, "benchmark").select("item_id", F.lit("en").alias("lang"), F.concat(F.lit("src"), F.col("item_id") % 20).alias("source"))
    found = catalog.shortest_evidence(claims, load(spark, d, "documents").select("lang", "source", "text", "doc_id"), ["lang", "source"], "text", "doc_id")
    return found.select("item_id", "evidence", F.col("evidence_chars").cast("bigint").alias("evidence_chars"))


_ALIASES = [("widget", "WIDGETS"), ("red widget", "RED WIDGETS"), ("bolt", "BOLTS"), ("old", "OLD THINGS"), ("gizmo", "NOWHERE")]


@query(
    """WITH a(alias, canonical) AS (VALUES ('widget', 'WIDGETS'), ('red widget', 'RED WIDGETS'), ('bolt', 'BOLTS'), ('old', 'OLD THINGS')),
    m AS (SELECT p_partkey, alias, canonical, row_number() OVER (PARTITION BY p_partkey ORDER BY length(alias) DESC, alias DESC, canonical DESC) AS n FROM part JOIN a ON contains(replace(p_name, ' ', ''), replace(alias, ' ', '')))
    SELECT p_partkey, alias, canonical FROM m WHERE n = 1"""
)
def alias_longest_match(spark, d):
    aliases = values(spark, "alias string, canonical string", _ALIASES)
    plans = aliases.where("canonical <> 'NOWHERE'").select("canonical")
    return resolve.longest_alias(load(spark, d, "part").select("p_partkey", "p_name"), aliases, "p_partkey", "p_name", plans)


@query(
    """WITH w(want_id, wanted) AS (VALUES (1, 'red bolt'), (2, 'bolt'), (3, 'xyzzy'), (4, ''), (5, 'a big red bolt here')), p AS (SELECT DISTINCT p_name AS program, replace(p_name, ' ', '') AS k FROM part),
    m AS (SELECT want_id, min(CASE WHEN k = replace(wanted, ' ', '') THEN program END) AS exact, count(*) AS n, min(program) AS one FROM w JOIN p ON wanted <> '' AND (contains(k, replace(wanted, ' ', '')) OR contains(replace(wanted, ' ', ''), k)) GROUP BY 1)
    SELECT want_id, CASE WHEN wanted = '' THEN 'missing' WHEN exact IS NOT NULL THEN 'exact' WHEN n = 1 THEN 'contained' WHEN n > 1 THEN 'ambiguous' ELSE 'uncovered' END AS status, coalesce(exact, CASE WHEN n = 1 THEN one END) AS canonical FROM w LEFT JOIN m USING (want_id)"""
)
def major_status(spark, d):
    wanted = values(spark, "want_id int, wanted string", [(1, "red bolt"), (2, "bolt"), (3, "xyzzy"), (4, ""), (5, "a big red bolt here")])
    return resolve.program_status(wanted, load(spark, d, "part").select(F.col("p_name").alias("program")))


_DONE = [(1, "17"), (2, "Red Widget"), (3, "gizmo"), (4, "no such course")]


@query(
    """WITH d(done_id, done) AS (VALUES (1, '17'), (2, 'redwidget'), (3, 'gizmo'), (4, 'nosuchcourse')), c AS (SELECT p_partkey, p_name, replace(p_name, ' ', '') AS k FROM part),
    m AS (SELECT done_id, p_partkey, p_name, CASE WHEN done = p_partkey::VARCHAR OR done = k THEN 1 ELSE 2 END AS tier FROM d JOIN c ON done = p_partkey::VARCHAR OR contains(k, done) OR contains(done, k)),
    b AS (SELECT *, min(tier) OVER (PARTITION BY done_id) AS best FROM m)
    SELECT done_id, p_partkey AS course_code, p_name AS course_name, tier FROM b WHERE tier = best UNION ALL SELECT done_id, NULL, NULL, NULL FROM d WHERE done_id NOT IN (SELECT done_id FROM m)"""
)
def completed_match_tiers(spark, d):
    return resolve.match_completed(values(spark, "done_id int, done string", _DONE), courses(spark, d))


@query(
    """WITH d(done_id, done) AS (VALUES (1, '17'), (2, 'redwidget'), (3, 'gizmo'), (4, 'nosuchcourse')), c AS (SELECT p_partkey, replace(p_name, ' ', '') AS k FROM part)
    SELECT done_id, min(p_partkey) AS course_code FROM d JOIN c ON done = p_partkey::VARCHAR OR contains(k, done) OR contains(done, k) GROUP BY 1"""
)
def completed_match_lowest_code(spark, d):
    return resolve.match_lowest_code(values(spark, "done_id int, done string", _DONE), courses(spark, d))


_MODULES = "SELECT p_brand AS major, p_type AS module, round_even(sum(p_size), 2)::DOUBLE AS required_credits FROM part GROUP BY 1, 2"


@query(
    f"""WITH base AS ({_MODULES}), v(major, module, credits) AS (VALUES ('Brand#1', 'PROMO', 9.0::DOUBLE), ('Brand#2', 'SMALL', NULL))
    SELECT b.major, b.module, required_credits AS before, CASE WHEN v.major IS NOT NULL THEN v.credits ELSE required_credits END AS required_credits,
           required_credits IS DISTINCT FROM CASE WHEN v.major IS NOT NULL THEN v.credits ELSE required_credits END AS changed
    FROM base b LEFT JOIN v ON b.major = v.major AND b.module = v.module"""
)
def overlay_merge_changes(spark, d):
    base = load(spark, d, "part").groupBy(F.col("p_brand").alias("major"), F.col("p_type").alias("module")).agg(F.bround(F.sum("p_size").cast("double"), 2).alias("required_credits"))
    verified = values(spark, "major string, module string, required_credits double", [("Brand#1", "PROMO", 9.0), ("Brand#2", "SMALL", None)])
    return catalog.overlay(base, verified, ["major", "module"], "required_credits")


@query(
    """WITH s AS (SELECT l_partkey, max(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS a, max(CASE WHEN l_returnflag = 'N' THEN 1 ELSE 0 END) AS b FROM lineitem WHERE l_returnflag IN ('R', 'N') GROUP BY 1)
    SELECT l_partkey, CASE WHEN a = 1 AND b = 1 THEN 'common' WHEN a = 1 THEN 'only_a' ELSE 'only_b' END AS side FROM s"""
)
def set_compare_codes(spark, d):
    return catalog.compare_sets(load(spark, d, "lineitem"), "l_returnflag", "l_partkey", "R", "N")


@query(
    OFFERINGS_SQL
    + """SELECT module, course_nature, round_even(sum(coalesce(credits, 0)), 2) AS catalog_credits, count(*) AS course_count, CASE WHEN min(contains(course_nature, '必修')::INTEGER) = 1 THEN round_even(sum(coalesce(credits, 0)), 2) END AS required_credits FROM offerings GROUP BY 1, 2"""
)
def module_rollup(spark, d):
    return catalog.module_rollup(offerings(spark, d), ["module", "course_nature"])


@query(
    """WITH c AS (SELECT c_mktsegment, o_orderpriority, count(*) AS n, min(o_orderkey) AS s FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2),
    r AS (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY n DESC, s) AS k FROM c)
    SELECT c_mktsegment, o_orderpriority AS owner FROM r WHERE k = 1"""
)
def owner_mode(spark, d):
    rows = load(spark, d, "orders").join(load(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment"), "o_custkey")
    return catalog.mode_of(rows, ["c_mktsegment"], "o_orderpriority", "o_orderkey", "owner")


@query(
    """SELECT p_brand, min(p_size)::VARCHAR || '-' || max(p_size)::VARCHAR AS pages, count(*) AS course_count, count(DISTINCT p_type) AS modules FROM part GROUP BY 1"""
)
def plan_rollup(spark, d):
    return load(spark, d, "part").groupBy("p_brand").agg(F.concat_ws("-", F.min("p_size").cast("string"), F.max("p_size").cast("string")).alias("pages"), F.count(F.lit(1)).alias("course_count"), F.countDistinct("p_type").alias("modules"))


@query(
    """WITH c AS (SELECT l_linenumber, l_shipmode, sum(w)::BIGINT AS w, count(*) AS n FROM (SELECT l_linenumber, l_returnflag || l_linestatus AS l_shipmode, CASE WHEN l_discount > 0.05 THEN 4 ELSE 1 END AS w FROM lineitem) GROUP BY 1, 2),
    r AS (SELECT *, row_number() OVER (PARTITION BY l_linenumber ORDER BY w DESC, n DESC, length(l_shipmode) DESC, l_shipmode DESC) AS k FROM c)
    SELECT l_linenumber, l_shipmode AS article, w AS weight FROM r WHERE k = 1"""
)
def page_article_weighted_mode(spark, d):
    rows = load(spark, d, "lineitem").select("l_linenumber", F.concat("l_returnflag", "l_linestatus").alias("value"), "l_discount")
    return catalog.weighted_mode(rows, ["l_linenumber"], "value", F.when(F.col("l_discount") > 0.05, 4).otherwise(1), "article")


@query(
    """SELECT s.source, coalesce(d.n, 0) AS docs, coalesce(d.chars, 0)::BIGINT AS chars, coalesce(q.good, 0)::BIGINT AS good FROM (SELECT DISTINCT source FROM documents) s
    LEFT JOIN (SELECT source, count(*) AS n, sum(n_chars) AS chars FROM documents GROUP BY 1) d USING (source)
    LEFT JOIN (SELECT source, sum(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good FROM documents JOIN labels USING (doc_id) GROUP BY 1) q USING (source)"""
)
def coverage_by_source(spark, d):
    docs = load(spark, d, "documents").select("doc_id", "source", "n_chars")
    a = docs.groupBy("source").agg(F.count(F.lit(1)).alias("docs"), F.sum("n_chars").alias("chars"))
    q = docs.join(load(spark, d, "labels"), "doc_id").groupBy("source").agg(F.sum(F.when(F.col("quality") == 1, 1).otherwise(0)).alias("good"))
    zero = F.lit(0).cast("bigint")
    return a.join(q, "source", "left").select("source", F.coalesce("docs", zero).alias("docs"), F.coalesce("chars", zero).alias("chars"), F.coalesce("good", zero).alias("good"))


@query("SELECT CASE WHEN contains(url, '/en/') THEN 'english' WHEN contains(url, '/de/') THEN 'german' ELSE 'other' END AS category, count(*) AS pages, sum(length(html))::BIGINT AS chars, count_if(contains(url, '?')) AS queried FROM pages GROUP BY 1")
def category_rollup(spark, d):
    category = F.when(F.col("url").contains("/en/"), "english").when(F.col("url").contains("/de/"), "german").otherwise("other")
    return load(spark, d, "pages").groupBy(category.alias("category")).agg(F.count(F.lit(1)).alias("pages"), F.sum(F.char_length("html")).alias("chars"), F.count_if(F.col("url").contains("?")).alias("queried"))


@query("SELECT o_orderpriority AS cohort, count(DISTINCT o_custkey) AS majors, count(*) AS rows_n FROM orders GROUP BY 1")
def distinct_by_cohort(spark, d):
    return load(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("cohort")).agg(F.countDistinct("o_custkey").alias("majors"), F.count(F.lit(1)).alias("rows_n"))


@query(OFFERINGS_SQL + "SELECT count(*) AS n, count_if(semester IS NULL) AS unmarked, count_if(semester = 'S1') AS summer, count_if(credits IS NULL) AS no_credits FROM offerings")
def field_completeness(spark, d):
    return offerings(spark, d).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("semester").isNull()).alias("unmarked"), F.count_if(F.col("semester") == "S1").alias("summer"), F.count_if(F.col("credits").isNull()).alias("no_credits"))


@query("SELECT k.l_orderkey, k.l_linenumber FROM (SELECT l_orderkey, unnest(range(1, max(l_linenumber) + 1))::INTEGER AS l_linenumber FROM lineitem GROUP BY 1) k WHERE NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = k.l_orderkey AND l.l_linenumber = k.l_linenumber)")
def missing_pages(spark, d):
    line = load(spark, d, "lineitem").select("l_orderkey", "l_linenumber")
    totals = line.groupBy("l_orderkey").agg(F.max("l_linenumber").alias("total"))
    return catalog.missing_places(line, totals, ["l_orderkey"], "l_linenumber", "total")


@query("SELECT md5(text) AS digest, count(*) AS n FROM documents GROUP BY 1 HAVING count(*) > 1")
def duplicate_keys(spark, d):
    return catalog.duplicate_keys(load(spark, d, "documents").select(F.md5("text").alias("digest")), ["digest"])


@query("SELECT count(DISTINCT doc_id) = count(*) AS unique_ids, bool_and(length(text) > 0) AS has_text, bool_and(lang IN ('en', 'de', 'fr', 'es')) AS known_lang, bool_and(n_chars = length(text)) AS sizes_right FROM documents")
def hard_checks(spark, d):
    return load(spark, d, "documents").agg(
        (F.countDistinct("doc_id") == F.count(F.lit(1))).alias("unique_ids"), F.bool_and(F.char_length("text") > 0).alias("has_text"), F.bool_and(F.col("lang").isin("en", "de", "fr", "es")).alias("known_lang"), F.bool_and(F.col("n_chars") == F.char_length("text")).alias("sizes_right")
    )


@query(
    """WITH m AS (SELECT p_brand AS major, p_type AS module, sum(p_size)::DOUBLE AS catalog_credits, CASE WHEN count(*) % 3 = 0 THEN NULL ELSE (count(*) * 25)::DOUBLE END AS required_credits FROM part GROUP BY 1, 2)
    SELECT CASE WHEN required_credits IS NULL THEN 'unknown' WHEN required_credits > catalog_credits THEN 'impossible' ELSE 'ok' END AS finding, count(*) AS n FROM m GROUP BY 1"""
)
def requirement_note_audit(spark, d):
    m = load(spark, d, "part").groupBy(F.col("p_brand").alias("major"), F.col("p_type").alias("module")).agg(F.sum("p_size").cast("double").alias("catalog_credits"), F.when(F.count(F.lit(1)) % 3 != 0, (F.count(F.lit(1)) * 25).cast("double")).alias("required_credits"))
    return catalog.impossible_minima(m).groupBy("finding").agg(F.count(F.lit(1)).alias("n"))


@query(
    f"""WITH c AS (SELECT p_partkey, p_name, {SEMESTER_SQL} AS semester FROM part), x AS (SELECT p_name, list(DISTINCT semester) AS v FROM c WHERE semester IS NOT NULL GROUP BY 1)
    SELECT p_partkey, CASE WHEN semester IS NULL AND len(v) = 1 THEN v[1] ELSE semester END AS semester, CASE WHEN semester IS NOT NULL THEN 'kept' WHEN len(v) = 1 THEN 'repaired' WHEN len(v) > 1 THEN 'ambiguous' ELSE 'missing' END AS state FROM c LEFT JOIN x USING (p_name)"""
)
def semester_repair(spark, d):
    c = courses(spark, d).select(F.col("course_code").alias("p_partkey"), "course_name", "semester")
    return catalog.repair_single(c, c, ["course_name"], "semester").select("p_partkey", "semester", "state")


@query(
    """SELECT page_id, host, host = 'example.org' OR ends_with(host, '.example.org') AS official FROM (SELECT page_id, lower(regexp_extract(url, '^https?://(?:[^/?#@]*@)?([^/?#:@]+)', 1)) AS host FROM pages)"""
)
def url_host_filter(spark, d):
    return load(spark, d, "pages").select("page_id", host_of(F.col("url")).alias("host"), in_domain(F.col("url"), "example.org").alias("official"))


@query("SELECT c_nationkey, array_to_string(list_sort(list(DISTINCT c_mktsegment)), ',') AS options FROM customer GROUP BY 1")
def options_by_cohort(spark, d):
    return load(spark, d, "customer").groupBy("c_nationkey").agg(F.array_join(F.array_sort(F.collect_set("c_mktsegment")), ",").alias("options"))
