"""Queries of header overrides and of sessions, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import overrides as O
from ..sources.driver_tables import courses, load
from ..streaming import session_store

QUERIES, ORACLES = {}, {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


_MODULES_SQL = "[" + ", ".join(f"'{m}'" for m in O.MODULES) + "]"
_CHUNKS_SQL = f"""c AS (SELECT o_custkey, o_orderkey AS chunk_id, 'S' || o_custkey || 'x' AS stem, o_orderstatus = 'F' AS is_table,
      CASE WHEN o_orderkey % 2 = 0 THEN 'S' || o_custkey || 'x方案' ELSE '其他' END AS article,
      CASE o_orderkey % 4 WHEN 0 THEN '毕业最低学分要求为' || (100 + o_orderkey % 80) || '学分' WHEN 1 THEN 'S' || o_custkey || 'x专业 ' || (100 + o_orderkey % 90) || ' 学分 10 ' || (o_orderkey % 50) || ' 30 4 5.5 6 7 8' ELSE '无' END AS text FROM orders),
    n AS (SELECT *, regexp_extract(text, '^S\\d+x(?:专业)?\\s*(\\d{{2,3}}(?:\\.\\d+)?)\\s*学分', 1) AS own, CASE WHEN contains(article, stem) THEN regexp_extract(text, '毕业最低学分(?:要求)?(?:为|[:：]|.{{0,20}}?)(\\d{{2,3}}(?:\\.\\d+)?)\\s*学分', 1) ELSE '' END AS gen FROM c),
    h AS (SELECT o_custkey, chunk_id, (CASE WHEN own <> '' THEN own ELSE gen END)::DOUBLE AS total, list_transform(regexp_extract_all(regexp_extract(text, '学分\\s+((?:\\d+(?:\\.\\d+)?\\s+){{7}}\\d+(?:\\.\\d+)?)', 1), '\\d+(?:\\.\\d+)?'), lambda x: x::DOUBLE)[1:7] AS mc
      FROM n WHERE own <> '' OR gen <> '' QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY CASE WHEN own <> '' THEN 20 ELSE 10 END + CASE WHEN contains(article, stem) THEN 3 ELSE 0 END + CASE WHEN contains(text, stem) THEN 1 ELSE 0 END DESC, is_table, chunk_id) = 1),
    b AS (SELECT o_custkey, min(o_orderkey) AS lo, max(o_orderkey) AS hi FROM orders GROUP BY 1)"""
_AUDIT_SQL = f"""req AS (SELECT b.o_custkey, 'STANDARD' AS module, 12.5 AS required_credits, lo AS evidence FROM b LEFT JOIN h USING (o_custkey) WHERE coalesce(len(mc), 0) < 7
      UNION ALL SELECT o_custkey, ({_MODULES_SQL})[i], mc[i], chunk_id FROM h, (SELECT unnest(range(1, 8)) AS i) WHERE len(mc) >= 7),
    fin AS (SELECT DISTINCT o_custkey, l_partkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderstatus = 'F'),
    done AS (SELECT o_custkey, CASE WHEN p_partkey % 3 = 0 THEN p_type ELSE ({_MODULES_SQL})[p_partkey % 7 + 1] END AS module, sum(p_size::DOUBLE) AS s, count(*) AS n FROM fin JOIN part ON p_partkey = l_partkey GROUP BY 1, 2)"""


def _plans(spark, d):
    """(chunks, bounds) of customers as plans: their orders are chunks, the first and last of which are cited."""
    orders = load(spark, d, "orders")
    k = F.col("o_orderkey")
    stem = F.concat(F.lit("S"), F.col("o_custkey").cast("string"), F.lit("x"))
    said = (
        F.when(k % 4 == 0, F.concat(F.lit("毕业最低学分要求为"), (100 + k % 80).cast("string"), F.lit("学分")))
        .when(k % 4 == 1, F.concat(stem, F.lit("专业 "), (100 + k % 90).cast("string"), F.lit(" 学分 10 "), (k % 50).cast("string"), F.lit(" 30 4 5.5 6 7 8")))
        .otherwise("无")
    )
    chunks = orders.select("o_custkey", k.alias("chunk_id"), k.alias("seq"), stem.alias("stem"), (F.col("o_orderstatus") == "F").alias("is_table"), F.when(k % 2 == 0, F.concat(stem, F.lit("方案"))).otherwise("其他").alias("article"), said.alias("text"))
    return chunks, orders.groupBy("o_custkey").agg(F.min("o_orderkey").alias("lo"), F.max("o_orderkey").alias("hi"))


@query(f"WITH {_CHUNKS_SQL} SELECT o_custkey, chunk_id, total, CASE WHEN len(mc) >= 7 THEN list_sum(mc) ELSE 0 END AS listed FROM h")
def program_headers(spark, d):
    """The best header of each plan, its total and the sum of the modules that it lists."""
    found = O.program_headers(_plans(spark, d)[0], ["o_custkey"])
    return found.select("o_custkey", "chunk_id", "total", F.aggregate("module_credits", F.lit(0.0), lambda s, x: s + x).alias("listed"))


@query(
    f"""WITH {_CHUNKS_SQL}, {_AUDIT_SQL} SELECT r.o_custkey, r.module, required_credits, CASE WHEN n IS NOT NULL THEN round_even(s, 2) END AS completed_credits, CASE WHEN n IS NOT NULL THEN round_even(greatest(0, required_credits - s), 2) END AS remaining_credits, coalesce(n, 0) AS n_done
    FROM req r LEFT JOIN done USING (o_custkey, module)"""
)
def header_override_audit(spark, d):
    """The audit after headers have replaced the minima of the plans whose modules they list."""
    chunks, bounds = _plans(spark, d)
    base = bounds.select("o_custkey", F.lit("STANDARD").alias("module"), F.lit(12.5).alias("required_credits"), F.col("lo").alias("evidence"))
    requirements = O.overridden(base, O.program_headers(chunks, ["o_custkey"]), ["o_custkey"])
    k = F.col("course_code")
    own = courses(spark, d).withColumn("module", F.when(k % 3 == 0, F.col("module")).otherwise(F.get(F.array(*map(F.lit, O.MODULES)), (k % 7).cast("int"))))
    finished = load(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    done = load(spark, d, "lineitem").select("l_orderkey", F.col("l_partkey").alias("course_code")).join(finished, "l_orderkey").select("o_custkey", "course_code").distinct()
    rows = done.join(own.select("course_code", "semester", "module", "credits"), "course_code")
    audit = O.recomputed(requirements, rows, rows.select("o_custkey", "course_code", "semester"), ["o_custkey"])
    return audit.select("o_custkey", "module", "required_credits", "completed_credits", "remaining_credits", "n_done")


@query(
    f"""WITH {_CHUNKS_SQL},
    u AS (SELECT o_custkey, coalesce(h.chunk_id, lo) AS e FROM b LEFT JOIN h USING (o_custkey) UNION SELECT o_custkey, hi FROM b UNION SELECT o_custkey, CASE WHEN coalesce(len(mc), 0) < 7 THEN lo ELSE h.chunk_id END FROM b LEFT JOIN h USING (o_custkey)),
    l AS (SELECT o_custkey, e, min(seq) AS seq FROM (SELECT o_custkey, lo AS e, lo AS seq FROM b UNION ALL SELECT o_custkey, hi, hi FROM b UNION ALL SELECT o_custkey, chunk_id, NULL FROM h) GROUP BY 1, 2)
    SELECT o_custkey, e AS evidence, row_number() OVER (PARTITION BY o_custkey ORDER BY seq NULLS LAST, e)::INTEGER AS number FROM l JOIN u USING (o_custkey, e)"""
)
def header_override_citations(spark, d):
    """The citations that facts and requirements still name once headers have overridden them, numbered anew."""
    chunks, bounds = _plans(spark, d)
    headers = O.program_headers(chunks, ["o_custkey"])
    said = lambda field, value, e: bounds.select("o_custkey", F.lit(field).alias("field"), F.lit(value).alias("value"), F.col(e).alias("evidence"))
    facts = O.minimum_facts(said("graduation_min_credits", 120.0, "lo").unionByName(said("other", 1.0, "hi")), headers, ["o_custkey"])
    base = bounds.select("o_custkey", F.lit("STANDARD").alias("module"), F.lit(12.5).alias("required_credits"), F.col("lo").alias("evidence"))
    requirements = O.overridden(base, headers, ["o_custkey"])
    cited = bounds.select("o_custkey", F.explode(F.array("lo", "hi")).alias("evidence")).withColumn("seq", F.col("evidence"))
    return O.compacted(cited, headers, facts.select("o_custkey", "evidence").unionByName(requirements.select("o_custkey", "evidence")), ["o_custkey"])


@query(
    """WITH t AS (SELECT conv_id, turn, coalesce(text, '') AS text, CASE WHEN turn % 3 = 0 THEN role END AS mode, CASE WHEN turn % 2 = 1 THEN string_split(text, ' ')[1] END AS topic FROM conversations)
    SELECT conv_id, turn, last_value(mode IGNORE NULLS) OVER w AS mode, last_value(topic IGNORE NULLS) OVER w AS topic, array_to_string(list(left(text, 20)) OVER (PARTITION BY conv_id ORDER BY turn, text ROWS 7 PRECEDING), '|') AS recent, count(*) OVER w AS seen
    FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn, text ROWS UNBOUNDED PRECEDING)"""
)
def session_contexts(spark, d):
    """What every turn sees of its session; the stream's states give the same (test)."""
    t = load(spark, d, "conversations")
    turns = t.withColumn("mode", F.when(F.col("turn") % 3 == 0, F.col("role"))).withColumn("topic", F.when(F.col("turn") % 2 == 1, F.get(F.split("text", " ", -1), F.lit(0))))
    found = session_store.batch_contexts(turns, "conv_id", "turn", "text", ["mode", "topic"])
    return found.select("conv_id", "turn", "mode", "topic", F.array_join(F.transform("recent", lambda x: F.left(x, F.lit(20))), "|").alias("recent"), "seen")
