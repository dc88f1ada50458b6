"""Evidence, set and evaluation queries with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import catalog, evidence, store
from ..sources.driver_tables import load, sources, values, SOURCES_SQL

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


@query("SELECT doc_id, lead(doc_id) OVER (PARTITION BY source, lang ORDER BY doc_id) AS next FROM documents")
def evidence_following(spark, d):
    return evidence.following(load(spark, d, "documents").select("doc_id", "source", "lang"), ["source", "lang"], "doc_id", "doc_id").select("doc_id", "next")


@query(
    """WITH c AS (SELECT o_orderkey AS claim_id, o_custkey, o_orderkey % 7 AS current FROM orders),
    m AS (SELECT claim_id, x.o_orderkey AS chunk_id, row_number() OVER (PARTITION BY claim_id ORDER BY x.o_orderkey = c.current DESC, x.o_totalprice, x.o_orderkey) AS n FROM c JOIN orders x ON x.o_custkey = c.o_custkey WHERE x.o_orderstatus = 'F')
    SELECT c.claim_id, c.current, m.chunk_id AS evidence FROM c LEFT JOIN m ON c.claim_id = m.claim_id AND n = 1"""
)
def evidence_rebind(spark, d):
    orders = load(spark, d, "orders")
    claims = orders.select(F.col("o_orderkey").alias("claim_id"), "o_custkey", (F.col("o_orderkey") % 7).alias("current"))
    chunks = orders.select("o_custkey", F.col("o_orderkey").alias("chunk_id"), "o_orderstatus", "o_totalprice")
    return evidence.rebind(claims, chunks, "o_custkey", F.col("o_orderstatus") == "F", [F.col("o_totalprice")])


@query(
    """WITH q(question_id, question) AS (VALUES (1, 'isredwidgetofferedandbolt'), (2, 'thesmallgear'), (3, 'nothing')), k AS (SELECT DISTINCT p_name AS name, replace(p_name, ' ', '') AS k FROM part),
    m AS (SELECT question_id, name, length(k) AS n, max(length(k)) OVER (PARTITION BY question_id) AS best FROM q JOIN k ON contains(question, k)) SELECT question_id, name FROM m WHERE n = best"""
)
def names_in_question(spark, d):
    questions = values(spark, "question_id int, question string", [(1, "Is Red Widget offered and bolt?"), (2, "the small gear"), (3, "nothing")])
    return evidence.names_in(questions, load(spark, d, "part").select(F.col("p_name").alias("name")))


@query(
    """WITH s AS (SELECT p_brand, p_partkey, CASE WHEN p_name = 'red widget' THEN 20 ELSE 0 END + CASE WHEN contains(p_name, 'widget') THEN 10 ELSE 0 END + CASE WHEN p_type = 'PROMO' THEN 3 ELSE 0 END + 1 AS score, p_type = 'PROMO' AS t FROM part),
    r AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY score DESC, t DESC, p_partkey) AS n FROM s) SELECT p_brand, p_partkey, score FROM r WHERE n = 1"""
)
def program_header_rank(spark, d):
    rows = evidence.header_rank(load(spark, d, "part"), ["p_brand"], F.col("p_name") == "red widget", F.col("p_name").contains("widget"), F.col("p_type") == "PROMO", "p_partkey")
    return rows.select("p_brand", "p_partkey", "score")


@query(
    """WITH h AS (SELECT event_type, regexp_extract(props, '"k": (\\d+)', 1) AS hit, row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) AS n FROM events WHERE regexp_extract(props, '"k": (\\d+)', 1) <> '') SELECT event_type, hit FROM h WHERE n = 1"""
)
def graduation_minimum(spark, d):
    return evidence.first_hit(load(spark, d, "events"), ["event_type"], "props", r'"k": (\d+)', [F.desc("value"), F.col("event_id")])


@query("SELECT event_type, sum((props->>'$.k')::BIGINT)::BIGINT AS total, count(*) AS n FROM events GROUP BY 1")
def json_payload(spark, d):
    k = F.from_json("props", "k long")["k"]
    return load(spark, d, "events").groupBy("event_type").agg(F.sum(k).alias("total"), F.count(F.lit(1)).alias("n"))


@query(
    """SELECT doc_id, round(least(1, 0.45::DOUBLE * (contains(text, 'the')::INTEGER + contains(text, 'ung')::INTEGER) / 2 + 0.25::DOUBLE * contains(text, 'and')::INTEGER + 0.1::DOUBLE * (source = 'src4')::INTEGER), 6) AS signal FROM documents"""
)
def exact_signal(spark, d):
    lits = lambda *v: F.array(*map(F.lit, v)) if v else F.array().cast("array<string>")
    s = evidence.exact_signal(lits("the", "ung"), lits("and"), lits(), lits("src4"), F.col("text"), F.col("source"))
    return load(spark, d, "documents").select("doc_id", F.round(s, 6).alias("signal"))


@query(
    """WITH w AS (SELECT source, unnest(['th', 'qu', CASE WHEN source = 'src3' THEN 'zzzz' ELSE 'e' END]) AS entity FROM (SELECT DISTINCT source FROM documents)),
    m AS (SELECT source, entity, max(contains(text, entity)::INTEGER) AS hit FROM w JOIN documents USING (source) GROUP BY 1, 2) SELECT source, min(hit) = 1 AS covered FROM m GROUP BY 1"""
)
def entity_coverage(spark, d):
    docs = load(spark, d, "documents").select("source", "text")
    wanted = docs.select("source").distinct().withColumn("entities", F.array(F.lit("th"), F.lit("qu"), F.when(F.col("source") == "src3", "zzzz").otherwise("e")))
    return evidence.entity_coverage(docs, wanted, "source", "text")


@query(
    """WITH q AS (SELECT item_id AS query_id, list_distinct(regexp_extract_all(lower(text), '[a-z]+\\d*|\\d+(?:\\.\\d+)?%?')) AS w FROM benchmark WHERE item_id % 50 = 0),
    l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents),
    s AS (SELECT query_id, doc_id, pos, length(line) AS n, CASE WHEN len(w) > 0 THEN len(list_intersect(w, list_distinct(regexp_extract_all(lower(line), '[a-z]+\\d*|\\d+(?:\\.\\d+)?%?'))))::DOUBLE / len(w) ELSE 0 END AS share FROM l CROSS JOIN q WHERE line <> ''),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY share DESC, n, doc_id, pos) AS k FROM s WHERE share >= 0.12)
    SELECT query_id, doc_id, pos::INTEGER AS passage_no, round(share, 6) AS share FROM r WHERE k = 1"""
)
def extractive_answer(spark, d):
    q = load(spark, d, "benchmark").where(F.col("item_id") % 50 == 0).select(F.col("item_id").alias("query_id"), F.col("text").alias("query_text"))
    return evidence.best_passage(load(spark, d, "documents"), q, "doc_id", "text").withColumn("share", F.round("share", 6))


@query("SELECT conv_id, turn, used FROM (SELECT conv_id, turn, sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)::BIGINT AS used FROM conversations) WHERE used <= 1500")
def context_packing(spark, d):
    return evidence.pack_context(load(spark, d, "conversations"), "conv_id", "turn", F.char_length("text"), 1500).select("conv_id", "turn", "used")


@query(
    """SELECT doc_id, CASE WHEN trim(a) = '' THEN 'empty' WHEN list_sort(list_distinct(regexp_extract_all(a, '\\d+(?:\\.\\d+)?'))) <> list_sort(list_distinct(regexp_extract_all(text, '\\d+(?:\\.\\d+)?'))) THEN 'numbers' END AS violation
    FROM (SELECT doc_id, text, CASE WHEN doc_id % 3 = 0 THEN text || ' 7' WHEN doc_id % 3 = 1 THEN ' ' ELSE text END AS a FROM documents)"""
)
def wording_violations(spark, d):
    docs = load(spark, d, "documents").select("doc_id", "text", F.when(F.col("doc_id") % 3 == 0, F.concat("text", F.lit(" 7"))).when(F.col("doc_id") % 3 == 1, " ").otherwise(F.col("text")).alias("a"))
    return docs.select("doc_id", evidence.wording_violation(F.col("a"), F.col("text")).alias("violation"))


@query("SELECT doc_id, contains(text, 'the') AND contains(text, 'and') AS complete FROM documents")
def completeness_guard(spark, d):
    return load(spark, d, "documents").select("doc_id", evidence.complete(F.array(F.lit("the"), F.lit("and")), F.col("text")).alias("complete"))


@query("SELECT doc_id, 'only_a' AS side FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) UNION ALL SELECT DISTINCT doc_id, 'only_b' FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)")
def registered_vs_physical(spark, d):
    return evidence.both_ways(load(spark, d, "documents"), load(spark, d, "labels"), "doc_id")


@query("SELECT a.doc_id, count(b.doc_id) AS mirrors, min(b.doc_id) AS first_mirror FROM documents a JOIN documents b ON md5(a.text) = md5(b.text) AND a.source <> b.source GROUP BY 1")
def mirror_match(spark, d):
    docs = load(spark, d, "documents").select("doc_id", "source", F.md5("text").alias("h"))
    # per digest and source, not per pair: a row's mirrors are its digest's rows less those of its own source
    by_source = docs.groupBy("h", "source").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("low"))
    window = Window.partitionBy("h")
    sides = by_source.withColumn("all_n", F.sum("n").over(window)).withColumn("lows", F.slice(F.array_sort(F.collect_list(F.struct("low", "source")).over(window)), 1, 2)).where("all_n > n")
    own = F.filter("lows", lambda x: x["source"] != F.col("source"))
    return docs.join(sides.select("h", "source", (F.col("all_n") - F.col("n")).alias("mirrors"), F.get(own, F.lit(0))["low"].alias("first_mirror")), ["h", "source"]).select("doc_id", "mirrors", "first_mirror")


@query("SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN 'fixed' ELSE p_name END AS p_name FROM part")
def merge_later_wins(spark, d):
    p = load(spark, d, "part").select("p_partkey", "p_name")
    return evidence.later_wins(p, p.where("p_partkey % 5 = 0").withColumn("p_name", F.lit("fixed")), "p_partkey").select("p_partkey", "p_name")


@query("SELECT DISTINCT alias, canonical FROM (SELECT p_name AS alias, p_type AS canonical FROM part UNION ALL SELECT lower(p_brand), p_type FROM part UNION ALL SELECT p_type, p_type FROM part)")
def alias_union(spark, d):
    p = load(spark, d, "part")
    makers = [p.select(F.col("p_name").alias("alias"), F.col("p_type").alias("canonical")), p.select(F.lower("p_brand").alias("alias"), F.col("p_type").alias("canonical")), p.select(F.col("p_type").alias("alias"), F.col("p_type").alias("canonical"))]
    return makers[0].unionByName(makers[1]).unionByName(makers[2]).distinct()


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag = 'A' THEN 0.0 ELSE l_quantity END AS credits FROM lineitem")
def cohort_replace(spark, d):
    line = load(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("credits"), "l_returnflag")
    fixed = line.where("l_returnflag = 'A'").withColumn("credits", F.lit(0.0))
    return line.where("l_returnflag <> 'A'").unionByName(fixed).drop("l_returnflag")


@query("SELECT lang, round(avg(CASE WHEN quality = 1 AND toxic = 0 THEN 1.0::DOUBLE ELSE 0 END), 6) AS accepted, round(avg(toxic), 6) AS leaked, count(*) AS n FROM documents JOIN labels USING (doc_id) GROUP BY 1")
def route_confusion(spark, d):
    rows = load(spark, d, "documents").select("doc_id", "lang").join(load(spark, d, "labels"), "doc_id")
    ok = F.when((F.col("quality") == 1) & (F.col("toxic") == 0), 1.0).otherwise(0.0)
    return rows.groupBy("lang").agg(F.round(F.avg(ok), 6).alias("accepted"), F.round(F.avg("toxic"), 6).alias("leaked"), F.count(F.lit(1)).alias("n"))


@query(
    """SELECT doc_id, len(list_filter([length(text) > 100, contains(text, 'e'), NOT contains(text, 'http'), n_chars = length(text), lang <> 'xx', source <> '', strpos(text, chr(0)) = 0], lambda x: x)) AS passed, length(text) > 100 AND contains(text, 'e') AND NOT contains(text, 'http') AS all_passed FROM documents"""
)
def answer_checks(spark, d):
    t = F.col("text")
    checks = [F.char_length(t) > 100, t.contains("e"), ~t.contains("http"), F.col("n_chars") == F.char_length(t), F.col("lang") != "xx", F.col("source") != "", F.instr(t, "\u0000") == 0]
    return load(spark, d, "documents").select("doc_id", F.size(F.filter(F.array(*checks), lambda x: x)).cast("bigint").alias("passed"), store.every(checks).alias("all_passed"))


@query("SELECT lang AS grp, count(*) AS n, sum((n_chars % 4 = doc_id % 4)::INTEGER)::BIGINT AS matched, count_if(n_chars % 3 = 0) AS path_sql, count_if(n_chars % 3 = 1) AS path_rag, count_if(n_chars % 3 = 2) AS path_clarify FROM documents GROUP BY 1")
def tool_match_summary(spark, d):
    path = F.col("n_chars") % 3
    match = F.when(F.col("n_chars") % 4 == F.col("doc_id") % 4, 1).otherwise(0)
    return load(spark, d, "documents").groupBy(F.col("lang").alias("grp")).agg(F.count(F.lit(1)).alias("n"), F.sum(match).alias("matched"), F.count_if(path == 0).alias("path_sql"), F.count_if(path == 1).alias("path_rag"), F.count_if(path == 2).alias("path_clarify"))


@query(
    SOURCES_SQL
    + """, q(question_id, college, cohort, intent) AS (VALUES (1, 'src4', '2023', 'policy'), (2, 'nowhere', '2023', 'policy'), (3, NULL, '1999', 'course'), (4, NULL, NULL, 'promotion'), (5, NULL, NULL, 'course'))
    SELECT question_id, CASE WHEN college IS NOT NULL AND college NOT IN (SELECT college FROM sources) THEN 'unknown_college' WHEN cohort IS NOT NULL AND cohort NOT IN (SELECT cohort FROM sources) THEN 'unknown_cohort' WHEN intent = 'promotion' AND college IS NULL THEN 'needs_college' WHEN intent = 'course' AND cohort IS NULL THEN 'needs_cohort' END AS ask FROM q"""
)
def scope_clarification(spark, d):
    s = sources(spark, d)
    q = values(spark, "question_id int, college string, cohort string, intent string", [(1, "src4", "2023", "policy"), (2, "nowhere", "2023", "policy"), (3, None, "1999", "course"), (4, None, None, "promotion"), (5, None, None, "course")])
    q = q.join(s.select("college").distinct().withColumn("_c", F.lit(True)), "college", "left").join(s.select("cohort").distinct().withColumn("_h", F.lit(True)), "cohort", "left")
    ask = (
        F.when(F.col("college").isNotNull() & F.col("_c").isNull(), "unknown_college")
        .when(F.col("cohort").isNotNull() & F.col("_h").isNull(), "unknown_cohort")
        .when((F.col("intent") == "promotion") & F.col("college").isNull(), "needs_college")
        .when((F.col("intent") == "course") & F.col("cohort").isNull(), "needs_cohort")
    )
    return q.select("question_id", ask.alias("ask"))


@query(
    """WITH m AS (SELECT p_brand, p_type, sum(p_size)::DOUBLE AS total, bool_or(p_size = 50) AS elective FROM part GROUP BY 1, 2)
    SELECT p_brand, p_type, CASE WHEN elective AND total > 300 THEN NULL ELSE total END AS required_credits, elective AND total > 300 AS cleared FROM m"""
)
def unsafe_minimum_cleared(spark, d):
    m = load(spark, d, "part").groupBy("p_brand", "p_type").agg(F.sum("p_size").cast("double").alias("required_credits"), F.bool_or(F.col("p_size") == 50).alias("elective"))
    return catalog.clear_minima(m, F.col("elective") & (F.col("required_credits") > 300)).drop("elective")
