"""Queries of headings, listed names and the catalog of plans, with SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import catalog_build as B
from ..operators import headings as H
from ..sources import snapshots
from ..sources.driver_tables import load

QUERIES, ORACLES = {}, {}

#: The tables' own text has no headings of programmes: a capitalised word before a comma or full stop stands for one, a line for a page.
WORD = r"([A-Z][a-z]{4,})[.,]"
MARK = r"(?:^|[ ,.])(in[a-z]{3,}|th[a-z]{4,})\."


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _lines(spark, d) -> DataFrame:
    return load(spark, d, "documents").select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n", -1)).alias("page", "line")).withColumn("page", F.col("page") + 1)


_LINES_SQL = """l AS (SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS page FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents))"""
_PAGE_LABELS_SQL = f"""{_LINES_SQL},
  w AS (SELECT doc_id, page, 1 AS priority, unnest(c) AS label, generate_subscripts(c, 1) AS place FROM (SELECT doc_id, page, regexp_extract_all(line, '([A-Z][a-z]{{4,}})[.,]', 1) AS c FROM l)),
  m AS (SELECT doc_id, page, 1 AS priority, unnest(c) AS label, generate_subscripts(c, 1) AS place FROM (SELECT doc_id, page, regexp_extract_all(line, '(?:^|[ ,.])(in[a-z]{{3,}}|th[a-z]{{4,}})\\.', 1) AS c FROM l)),
  k AS (SELECT doc_id, page, place, count(DISTINCT label) AS n, min(label) AS label FROM (SELECT * FROM w UNION ALL SELECT * FROM m) GROUP BY 1, 2, 3),
  p AS (SELECT doc_id, page, CASE WHEN n = 1 THEN label END AS label, n > 1 AS contested FROM k QUALIFY row_number() OVER (PARTITION BY doc_id, page ORDER BY place) = 1)"""


def _labels(spark, d) -> DataFrame:
    lines = _lines(spark, d)
    found = H.candidates(lines, ["doc_id"], "page", "line", WORD, 1).unionByName(H.candidates(lines, ["doc_id"], "page", "line", MARK, 1))
    return H.page_labels(found, ["doc_id"], "page")


@query(f"WITH {_PAGE_LABELS_SQL} SELECT doc_id, page, label, contested FROM p")
def heading_labels(spark, d):
    """Each page's heading; two sources that disagree at one place leave it open."""
    return _labels(spark, d)


@query(
    f"""WITH {_PAGE_LABELS_SQL},
    t AS (SELECT doc_id, page, label FROM p WINDOW o AS (PARTITION BY doc_id ORDER BY page) QUALIFY row_number() OVER o = 1 OR label IS DISTINCT FROM lag(label) OVER o),
    e AS (SELECT doc_id, max(page) AS last FROM l GROUP BY 1),
    i AS (SELECT t.doc_id, label, page AS first_page, coalesce(lead(page) OVER (PARTITION BY t.doc_id ORDER BY page) - 1, last) AS last_page FROM t JOIN e USING (doc_id))
    SELECT * FROM i WHERE label IS NOT NULL"""
)
def heading_intervals(spark, d):
    """The pages that a heading holds for: up to the next other one."""
    ends = _lines(spark, d).groupBy("doc_id").agg(F.max("page").alias("last"))
    return H.label_intervals(_labels(spark, d), ends, ["doc_id"], "page", "last")


@query(
    f"""WITH {_LINES_SQL}, e AS (SELECT doc_id, max(page) AS last FROM l GROUP BY 1),
    a AS (SELECT doc_id, page, regexp_extract_all(line, '([A-Z][a-z]{{4,}})[.,]', 1) AS c FROM l),
    h AS (SELECT doc_id, page, c[1] AS label FROM a WHERE len(c) > 0),
    t AS (SELECT * FROM h WINDOW o AS (PARTITION BY doc_id ORDER BY page) QUALIFY row_number() OVER o = 1 OR label IS DISTINCT FROM lag(label) OVER o),
    i AS (SELECT doc_id, label, page AS first_page, coalesce(lead(page) OVER (PARTITION BY doc_id ORDER BY page) - 1, last) AS last_page, 1 AS priority FROM t JOIN e USING (doc_id)),
    b AS (SELECT doc_id, c[1] AS label, greatest(page - 1, 1) AS first_page, least(page + 1, last) AS last_page, CASE WHEN page % 2 = 0 THEN 0 ELSE 1 END AS priority FROM a JOIN e USING (doc_id) WHERE len(c) > 1),
    x AS (SELECT DISTINCT doc_id, unnest(generate_series(first_page, last_page)) AS page, label, priority FROM (SELECT * FROM i UNION ALL SELECT * FROM b)),
    m AS (SELECT doc_id, page, min(priority) AS priority, count(DISTINCT label) = 1 AS agreed FROM x GROUP BY 1, 2)
    SELECT doc_id, page, min(label) AS label, bool_and(agreed) AS agreed FROM x JOIN m USING (doc_id, page, priority) GROUP BY 1, 2 HAVING count(DISTINCT label) = 1"""
)
def settled_labels(spark, d):
    """Pages under intervals of two sources that overlap: the stronger source counts, equal ones must agree."""
    lines = _lines(spark, d)
    ends = lines.groupBy("doc_id").agg(F.max("page").alias("last"))
    found = H.candidates(lines, ["doc_id"], "page", "line", WORD)
    by_heading = H.label_intervals(H.page_labels(found, ["doc_id"], "page"), ends, ["doc_id"], "page", "last").withColumn("priority", F.lit(1))
    twice = found.groupBy("doc_id", "page").agg(F.min_by("label", "place").alias("label"), F.count(F.lit(1)).alias("n")).where("n > 1").join(ends, "doc_id")
    near = twice.select("doc_id", "label", F.greatest(F.col("page") - 1, F.lit(1)).alias("first_page"), F.least(F.col("page") + 1, "last").alias("last_page"), F.when(F.col("page") % 2 == 0, 0).otherwise(1).alias("priority"))
    return H.settled(by_heading.unionByName(near), ["doc_id"])


_CODE, _END, _BETWEEN = r"[A-Z][a-z]*[.,]?\s+", r"\sand\s|\sder\s|\sde\s", r"[,.]"


@query(
    """WITH p AS (SELECT item_id, list_transform(string_split_regex(text, '[A-Z][a-z]*[.,]?\\s+')[2:], lambda x: string_split_regex(x, '\\sand\\s|\\sder\\s|\\sde\\s')[1]) AS a FROM benchmark),
    q AS (SELECT item_id, a, flatten(list_transform(a, lambda x: string_split_regex(x, '[,.]'))) AS b FROM p),
    t AS (SELECT item_id, list_filter(list_transform(a, lambda x: trim(x, ' ,，、;/；')), lambda x: regexp_matches(x, '[a-z]')) AS a, list_filter(list_transform(b, lambda x: trim(x, ' ,，、;/；')), lambda x: regexp_matches(x, '[a-z]')) AS b FROM q)
    SELECT item_id, array_to_string(list_transform(list_filter(list_transform(a, lambda x, i: {'x': x, 'i': i}), lambda s: list_position(a, s.x) = s.i), lambda s: s.x), '|') AS names,
      array_to_string(list_transform(list_filter(list_transform(b, lambda x, i: {'x': x, 'i': i}), lambda s: list_position(b, s.x) = s.i), lambda s: s.x), '|') AS parts FROM t"""
)
def listed_names(spark, d):
    """The names after each code of a block, whole and split at lists' marks. A capitalised word stands for a code."""
    rules = {"code": _CODE, "end": _END, "has": "[a-z]"}
    text = F.col("text")
    return load(spark, d, "benchmark").select("item_id", F.array_join(H.listed_names(text, **rules), "|").alias("names"), F.array_join(H.listed_names(text, **rules, between=_BETWEEN), "|").alias("parts"))


def table_stream(spark, d) -> tuple[DataFrame, DataFrame]:
    """(rows, pages): a customer's orders as a file's pages, their lines as a table's rows, with headings, rules and totals between them."""
    orders = load(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("file"), F.year("o_orderdate").alias("year"), F.left("o_orderpriority", F.lit(1)).alias("p"))
    name = F.element_at(F.array(*map(F.lit, "甲乙丙丁戊")), F.col("p").cast("int"))
    said = F.when(F.col("o_orderkey") % 3 > 0, F.concat(F.lit("第"), "p", F.lit("页 "), name, F.lit("类专业 "), F.col("year").cast("string"), F.lit(" 级本科人才培养方案"))).otherwise("无标题")
    pages = orders.select("file", F.col("o_orderkey").alias("page"), said.alias("text"))
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    line = load(spark, d, "lineitem").withColumn("n", F.row_number().over(order))
    k, credits = F.col("l_partkey"), F.format_number(F.col("l_quantity") % 32, 1)
    nature = F.when(F.col("l_returnflag") == "R", "选修").otherwise("必修")
    cells = lambda *c: F.array(*[x if not isinstance(x, str) else F.lit(x) for x in c]).cast("array<string>")
    each = F.array(
        F.when((F.col("l_linestatus") == "F") & (F.col("l_linenumber") <= 2), F.struct(F.lit(0).alias("s"), cells(F.concat(F.lit("一、"), "l_returnflag", F.lit("类课程模块")), "").alias("cells"))),
        F.struct(
            F.lit(1).alias("s"),
            cells(F.concat(F.lit("ABC"), F.lpad((k % 1000).cast("string"), 3, "0")), F.concat(F.lit("课程"), (k % 50).cast("string")), credits, "16", nature, (k % 8 + 1).cast("string"), "计算机学院").alias("cells"),
        ),
        F.when(k % 7 == 0, F.struct(F.lit(2).alias("s"), cells("", F.concat(F.lit("本模块至少修读 "), (k % 9 + 1).cast("string"), F.lit(" 学分。甲类必须选修《课程"), (k % 50).cast("string"), F.lit("》"))).alias("cells"))),
        F.when(k % 5 == 0, F.struct(F.lit(3).alias("s"), cells("合计", (k % 40).cast("string")).alias("cells"))),
    )
    stream = line.select("l_orderkey", "n", F.explode(F.array_compact(each)).alias("x"))
    facts = orders.join(stream, F.col("o_orderkey") == F.col("l_orderkey"))
    rows = facts.select("file", F.lit("学院甲").alias("college"), F.lit("2023").alias("cohort"), F.concat(F.lit("方案"), F.col("file").cast("string")).alias("source_title"), F.col("o_orderkey").alias("page"), (F.col("n") * 10 + F.col("x.s")).alias("seq"), "x.cells")
    # a customer's plans are their own
    return rows.withColumn("cohort", F.concat("cohort", F.lit("-"), F.col("file").cast("string"))), pages


def _catalog(spark, d) -> tuple[DataFrame, DataFrame]:
    rows, pages = table_stream(spark, d)
    labels = H.page_labels(H.candidates(pages, ["file"], "page", "text"), ["file"], "page")

    def written(df: DataFrame) -> DataFrame:
        path = snapshots.new_folder(spark, "catalog-rows")
        df.write.parquet(path)
        return spark.read.parquet(path)

    return B.build_catalog(rows, labels, written)


@query(None)
def catalog_plans(spark, d):
    """The nested document of every plan (tested against a loop over the rows)."""
    plans, _ = _catalog(spark, d)
    return plans.select("cohort", "major", "course_count", F.size("modules").alias("n_modules"), B.as_json(plans).alias("document"))


@query(None)
def catalog_snapshot(spark, d):
    """The catalog, written as a snapshot and read again: its courses, and the counts of its manifest."""
    plans, courses = _catalog(spark, d)
    path = snapshots.new_folder(spark, "catalog")
    snapshots.write_catalog(plans, courses, path, generated_at="2024-01-01", source_sha256="", version=B.CATALOG_VERSION)
    _, manifest = snapshots.current(spark, path)
    kept = snapshots.read(spark, path, "courses", B.CATALOG_VERSION)
    facts = manifest["facts"]
    return kept.select("cohort", "major", "module", "code", "name", "credits", "nature", "semester", F.lit(facts["plan_count"]).alias("plan_count"), F.lit(facts["course_count"]).alias("course_count"))
