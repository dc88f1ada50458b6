"""Queries of text and question functions over whole tables, with their SQL; rule tables in the SQL come from the same fixed values."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import questions as Q
from ..functions import subjects as S
from ..functions import text as T
from ..operators import render
from ..sources.driver_tables import load

QUERIES, ORACLES = {}, {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


@query("SELECT doc_id, md5(concat_ws(chr(10), source, source, lang, lang, lang, text)) AS search_text FROM documents")
def search_texts(spark, d):
    """The title twice and the article three times before the text."""
    return load(spark, d, "documents").select("doc_id", F.md5(Q.search_text(F.col("source"), F.col("lang"), F.col("text"))).alias("search_text"))


_TRIGGERS = [t for triggers, _ in Q.EXPANSIONS for t in triggers]
_TRIGGER_LIST = "[" + ", ".join(f"'{t}'" for t in _TRIGGERS) + "]"
_N = len(_TRIGGERS)
_EXPANDED = ", ".join(f"CASE WHEN {' OR '.join(f'contains(q, {chr(39)}{t}{chr(39)})' for t in triggers)} THEN [{', '.join(f'{chr(39)}{m}{chr(39)}' for m in more)}] ELSE [] END" for triggers, more in Q.EXPANSIONS)


@query(
    f"""WITH q AS (SELECT item_id, text || ({_TRIGGER_LIST})[item_id % {_N} + 1] || ' ' || CASE WHEN length(text) % 2 = 0 THEN ({_TRIGGER_LIST})[(item_id * 5 + length(text)) % {_N} + 1] ELSE '' END AS q FROM benchmark),
    e AS (SELECT item_id, q, unnest(x) AS w, generate_subscripts(x, 1) AS place FROM (SELECT *, flatten([{_EXPANDED}]) AS x FROM q)), f AS (SELECT item_id, w, min(place) AS place FROM e GROUP BY 1, 2)
    SELECT q.item_id, coalesce(string_agg(w, '|' ORDER BY place), '') AS added FROM q LEFT JOIN f USING (item_id) GROUP BY 1"""
)
def question_expansions(spark, d):
    """What each triggered rule adds to a question, in the rules' order."""
    at = lambda i: F.get(F.array(*map(F.lit, _TRIGGERS)), (i % _N).cast("int"))
    n = F.char_length("text")
    asked = F.concat("text", at(F.col("item_id")), F.lit(" "), F.when(n % 2 == 0, at(F.col("item_id") * 5 + n)).otherwise(""))
    return load(spark, d, "benchmark").select("item_id", F.array_join(Q.expansions(asked), "|").alias("added"))


_COHORT_TERMS = " OR ".join(f"contains(q, '{t}')" for t in Q.COHORT_TERMS)


@query(
    f"""WITH q AS (SELECT doc_id, coalesce(lang, '') || (2018 + doc_id % 8) || CASE WHEN doc_id % 3 = 0 THEN '' ELSE '级' END || CASE doc_id % 4 WHEN 0 THEN '培养方案' WHEN 1 THEN '竞赛' ELSE '图书馆' END || CASE WHEN doc_id % 5 = 0 THEN '与 2020 级' ELSE '' END AS q, n_chars % 2 = 0 AS even, (2018 + n_chars % 8)::VARCHAR AS shown FROM documents),
    c AS (SELECT *, list_distinct(regexp_extract_all(q, '((?:19|20)\\d{{2}})\\s*级', 1)) AS asked FROM q), k AS (SELECT *, len(asked) > 0 AND ({_COHORT_TERMS}) AS needs FROM c)
    SELECT doc_id, needs, NOT needs OR len(list_filter(asked, lambda x: NOT list_contains(CASE WHEN even THEN [shown, '2020'] ELSE [shown] END, x))) = 0 AS covered FROM k"""
)
def cohort_coverage(spark, d):
    """Whether the cohorts that a question names have evidence of their own, where its terms ask for that."""
    i = F.col("doc_id")
    asked = F.concat(F.coalesce("lang", F.lit("")), (2018 + i % 8).cast("string"), F.when(i % 3 == 0, "").otherwise("级"), F.when(i % 4 == 0, "培养方案").when(i % 4 == 1, "竞赛").otherwise("图书馆"), F.when(i % 5 == 0, "与 2020 级").otherwise(""))
    one = (2018 + F.col("n_chars") % 8).cast("string")
    shown = F.when(F.col("n_chars") % 2 == 0, F.array(one, F.lit("2020"))).otherwise(F.array(one))
    return load(spark, d, "documents").select("doc_id", Q.needs_cohort_evidence(asked).alias("needs"), F.coalesce(Q.cohort_covered(asked, shown), F.lit(True)).alias("covered"))


@query(
    """WITH a AS (SELECT page_id, url, CASE page_id % 4 WHEN 0 THEN url || '.pdf?v=1#page=3' WHEN 1 THEN url || '.PDF' WHEN 2 THEN url ELSE '' END AS file, CASE page_id % 3 WHEN 0 THEN '第' || length(html) % 90 || '页表格' WHEN 1 THEN '原文件第' || page_id || '页 第2页' ELSE '附则' END AS article FROM pages),
    b AS (SELECT *, coalesce(nullif(regexp_extract(article, '原文件第(\\d+)页', 1), ''), nullif(regexp_extract(article, '第(\\d+)页', 1), ''))::INTEGER AS pg,
      CASE WHEN ends_with(lower(regexp_replace(file, '[?#].*$', '')), '.pdf') THEN file WHEN ends_with(lower(regexp_replace(url, '[?#].*$', '')), '.pdf') THEN url END AS target FROM a)
    SELECT page_id, CASE WHEN pg IS NULL OR target IS NULL THEN url ELSE string_split(target, '#')[1] || '#page=' || pg END AS link FROM b"""
)
def page_links(spark, d):
    """The page of a file that an article names, as a link."""
    i, url = F.col("page_id"), F.col("url")
    file = F.when(i % 4 == 0, F.concat(url, F.lit(".pdf?v=1#page=3"))).when(i % 4 == 1, F.concat(url, F.lit(".PDF"))).when(i % 4 == 2, url).otherwise("")
    article = F.when(i % 3 == 0, F.concat(F.lit("第"), (F.char_length("html") % 90).cast("string"), F.lit("页表格"))).when(i % 3 == 1, F.concat(F.lit("原文件第"), i.cast("string"), F.lit("页 第2页"))).otherwise("附则")
    return load(spark, d, "pages").select("page_id", Q.page_url(url, file, article).alias("link"))


@query(
    """WITH a AS (SELECT conv_id, turn, '前言 ' || coalesce(text, '') || CASE WHEN turn % 2 = 0 THEN ' 第' || (turn + 1) || '条 ' || role ELSE '第二章 ' || role END || chr(10) || ' x ' AS t FROM conversations),
    b AS (SELECT *, list_filter(list_transform(string_split(regexp_replace(t, '([^\\s])[ \\t]*(第[一二三四五六七八九十百零〇\\d]+[条章节]\\s)', '\\1' || chr(10) || '\\2', 'g'), chr(10)), lambda x: trim(x, ' ')), lambda x: x <> '') AS l FROM a)
    SELECT conv_id, turn, len(l) AS n, md5(array_to_string(l, chr(10))) AS lines FROM b"""
)
def logical_lines(spark, d):
    """A text's lines, with a break before a heading that stands within one."""
    t = F.concat(F.lit("前言 "), F.coalesce("text", F.lit("")), F.when(F.col("turn") % 2 == 0, F.concat(F.lit(" 第"), (F.col("turn") + 1).cast("string"), F.lit("条 "), "role")).otherwise(F.concat(F.lit("第二章 "), "role")), F.lit("\n x "))
    found = load(spark, d, "conversations").select("conv_id", "turn", Q.logical_lines(t).alias("l"))
    return found.select("conv_id", "turn", F.size("l").alias("n"), F.md5(F.array_join("l", "\n")).alias("lines"))


@query(
    """WITH a AS (SELECT conv_id, turn, coalesce(text, '') || '【e' || turn || '】[ E' || turn || ' ] ［E' || (turn + length(text) % 2) || '］' AS t FROM conversations)
    SELECT conv_id, turn, md5(CASE WHEN b.same THEN regexp_replace(t2, '(\\[E\\d+\\])\\[E\\d+\\] \\[E\\d+\\]$', '\\1') ELSE regexp_replace(t2, '(\\[E\\d+\\])\\[E\\d+\\]( \\[E\\d+\\])$', '\\1\\2') END) AS said
    FROM (SELECT a.conv_id, a.turn, regexp_replace(t, '[【\\[［]\\s*[Ee]\\s*(\\d+)\\s*[】\\]］]', '[E\\1]', 'g') AS t2, length(c.text) % 2 = 0 AS same FROM a JOIN conversations c USING (conv_id, turn)) b"""
)
def citation_formats(spark, d):
    """Marks of every form in one, neighbours of one number as one."""
    turn = F.col("turn")
    other = (turn + F.char_length("text") % 2).cast("string")
    t = F.concat(F.coalesce("text", F.lit("")), F.lit("【e"), turn.cast("string"), F.lit("】[ E"), turn.cast("string"), F.lit(" ] ［E"), other, F.lit("］"))
    return load(spark, d, "conversations").where("text IS NOT NULL").select("conv_id", "turn", F.md5(render.citation_format(t)).alias("said"))


@query("SELECT l_orderkey, string_agg('[' || n || '] ' || p_name || ' /p/' || l_partkey, chr(10) ORDER BY n) AS appendix FROM (SELECT l_orderkey, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey) AS n FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem)) JOIN part ON p_partkey = l_partkey GROUP BY 1")
def source_appendices(spark, d):
    """Each order's distinct parts as numbered sources."""
    from pyspark.sql import Window

    cited = load(spark, d, "lineitem").select("l_orderkey", "l_partkey").distinct().withColumn("number", F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_partkey")))
    named = cited.join(load(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_name").alias("doc_title")), "l_partkey")
    return render.source_appendix(named.withColumn("page_url", F.concat(F.lit("/p/"), F.col("l_partkey").cast("string"))), ["l_orderkey"])


_WANTED = ("mathematics", "programming")


@query(
    """WITH n AS (SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN '数据结构与算法' WHEN 1 THEN 'Python程序设计' WHEN 2 THEN '高等数学' WHEN 3 THEN '体育舞蹈' ELSE p_name END AS name, CASE WHEN p_size % 5 = 0 THEN 'mat101' ELSE 'XYZ' END AS code FROM part)
    SELECT p_partkey, regexp_matches(upper(name || ' ' || code), '数学|微积分|代数|概率|数理统计|运筹学|离散') OR upper(code) LIKE 'MAT%' OR regexp_matches(name, '程序设计|编程|Python|Java|C语言') AND NOT contains(name, '数据结构') AS matches FROM n"""
)
def subject_matches(spark, d):
    """Courses of either of two subjects, by name or code."""
    k = F.col("p_partkey") % 6
    name = F.when(k == 0, "数据结构与算法").when(k == 1, "Python程序设计").when(k == 2, "高等数学").when(k == 3, "体育舞蹈").otherwise(F.col("p_name"))
    code = F.when(F.col("p_size") % 5 == 0, "mat101").otherwise("XYZ")
    found = S.subjects_of(name, code, F.lit(""), F.lit(""))
    return load(spark, d, "part").select("p_partkey", S.matches_subjects(found, list(_WANTED)).alias("matches"))


@query("SELECT p_partkey, 'src_' || substr(sha256(p_name || '|' || p_brand), 1, 24) AS source_id FROM part")
def source_ids(spark, d):
    """Ids of sources by their key's hash."""
    return load(spark, d, "part").select("p_partkey", T.source_id(F.concat_ws("|", "p_name", "p_brand")).alias("source_id"))
