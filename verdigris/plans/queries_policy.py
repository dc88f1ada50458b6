"""Queries of quotes, marks, support, policy answers and asked subjects, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import citations as C
from ..operators import narrowing as N
from ..operators import policy as P
from ..operators.chunk_table import chunks_of
from ..operators.models import HashingEncoder, LexicalReranker, encoded, reranked
from ..sources.driver_tables import load

QUERIES, ORACLES = {}, {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


_TOKENS = "list_distinct(regexp_extract_all(lower({x}), '[a-z]+\\d*|\\d+(?:\\.\\d+)?%?'))"
_NUMBERS = "list_distinct(regexp_extract_all({x}, '\\d+(?:\\.\\d+)?%?'))"
_PASSAGES = "list_filter(list_transform(string_split_regex(regexp_replace({x}, '([。！？!?；;])', '\\1' || chr(10), 'g'), '\\n+'), lambda x: trim(x, ' ' || chr(9) || chr(13) || chr(10))), lambda x: x <> '')"
_PAIRS_SQL = """d AS (SELECT doc_id, coalesce(d.text, '') AS t, coalesce(b.text, '') AS claim FROM documents d JOIN benchmark b ON b.item_id = d.doc_id % (SELECT count(*) FROM benchmark))"""


def _pairs(spark, d) -> DataFrame:
    """Every document with a text of benchmark as the claim that is held against it."""
    b = load(spark, d, "benchmark").select("item_id", F.col("text").alias("claim"))
    return load(spark, d, "documents").withColumn("item_id", F.col("doc_id") % b.count()).join(b, "item_id").select("doc_id", "text", "claim")


@query(
    f"""WITH {_PAIRS_SQL},
    p AS (SELECT doc_id, t, claim, {_TOKENS.format(x='claim')} AS w, {_NUMBERS.format(x='claim')} AS nums, unnest(ps) AS p, generate_subscripts(ps, 1) AS place FROM (SELECT *, {_PASSAGES.format(x='t')} AS ps FROM d)),
    k AS (SELECT *, len(list_intersect(w, {_TOKENS.format(x='p')})) AS shared, len(list_distinct(list_concat(w, {_TOKENS.format(x='p')}))) AS u, 2 * len(list_intersect(nums, {_NUMBERS.format(x='p')})) AS bonus FROM p),
    b AS (SELECT *, shared + bonus AS score, CASE WHEN u > 0 THEN shared / u ELSE 0 END AS j FROM k QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY shared + bonus DESC, CASE WHEN u > 0 THEN shared / u ELSE 0 END DESC, length(p), place) = 1),
    r AS (SELECT d.doc_id, d.claim, {_TOKENS.format(x='d.claim')} AS w, coalesce(b.score, 0) AS score, coalesce(b.j, 0) AS j, coalesce(b.shared, 0) AS shared, CASE WHEN b.p IS NULL OR b.score = 0 AND b.j = 0 AND length(b.p) >= length(d.t) THEN d.t ELSE b.p END AS p FROM d LEFT JOIN b USING (doc_id)),
    c AS (SELECT *, greatest(0, least(coalesce(list_min(list_filter(list_transform(w, lambda x: instr(p, x) - 1), lambda i: i >= 0)), 0) - 100, length(p) - 300)) AS start FROM r)
    SELECT doc_id, score, round(j, 6) AS jaccard, CASE WHEN len(w) > 0 THEN round(shared / len(w), 6) ELSE 0 END AS coverage, CASE WHEN length(p) <= 300 THEN p ELSE substr(p, (start + 1)::INTEGER, 300) END AS quote FROM c"""
)
def quote_windows(spark, d):
    """The passage of each document that supports its claim best, and at most 300 characters of it around the first shared token."""
    best = C.best_passage(F.col("claim"), F.col("text"))
    a = _pairs(spark, d).withColumn("b", best)
    n = F.size(C.content_tokens(F.col("claim")))
    return a.select("doc_id", F.col("b.score").alias("score"), F.round("b.jaccard", 6).alias("jaccard"), F.when(n > 0, F.round(F.col("b.shared") / n, 6)).otherwise(0.0).alias("coverage"), C.quote_of(F.col("claim"), F.col("b.passage")).alias("quote"))


_MARKED = "CASE turn % 5 WHEN 0 THEN t || '[' || (length(t) % 7) || '].' WHEN 1 THEN t || '[1][' || (turn % 4 + 1) || ']' WHEN 2 THEN '[2] ' || t WHEN 3 THEN t || '[1][2][3][4]' || CASE WHEN length(t) % 2 = 0 THEN '[1]' ELSE '' END ELSE t END"


@query(
    f"""WITH c AS (SELECT conv_id, turn, regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g') AS t FROM conversations), s AS (SELECT conv_id, turn, {_MARKED} AS s FROM c),
    m AS (SELECT *, list_transform(regexp_extract_all(s, '\\[(\\d+)\\]', 1), lambda x: x::INTEGER) AS marks, trim(regexp_replace(s, '\\[\\d+\\]', '', 'g'), ' ' || chr(9) || '-*#>。.!！?？;；:：') = '' AS bare FROM s)
    SELECT conv_id, turn, CASE WHEN bare THEN NULL WHEN len(marks) = 0 THEN 'uncited' WHEN len(marks) > 4 THEN 'too_many'
      WHEN NOT regexp_matches(rtrim(regexp_replace(trim(s), '[。！？!?；;]+$', '')), '(?:\\[\\d+\\]){{1,4}}$') THEN 'not_at_end'
      WHEN len(list_filter(marks, lambda x: x < 1 OR x > 5)) > 0 THEN 'out_of_range' END AS error FROM m"""
)
def marker_errors(spark, d):
    """The rule on marks that each turn's text breaks, with marks where its length and turn put them; five sources."""
    t, turn = F.regexp_replace(F.coalesce("text", F.lit("")), r"\s+", " "), F.col("turn") % 5
    mark = lambda x: F.concat(F.lit("["), x.cast("string"), F.lit("]"))
    said = (
        F.when(turn == 0, F.concat(t, mark(F.char_length(t) % 7), F.lit(".")))
        .when(turn == 1, F.concat(t, F.lit("[1]"), mark(F.col("turn") % 4 + 1)))
        .when(turn == 2, F.concat(F.lit("[2] "), t))
        .when(turn == 3, F.concat(t, F.lit("[1][2][3][4]"), F.when(F.char_length(t) % 2 == 0, "[1]").otherwise("")))
        .otherwise(t)
    )
    return load(spark, d, "conversations").select("conv_id", "turn", C.marker_error(said, F.lit(5)).alias("error"))


@query(
    f"""WITH {_PAIRS_SQL},
    s AS (SELECT doc_id, claim || CASE WHEN doc_id % 3 = 0 THEN ' ' || length(t) % 100 ELSE '' END AS c, doc_id % 4 AS m, string_split(t, chr(10)) AS lines FROM d),
    x AS (SELECT *, CASE WHEN m = 0 OR m > len(lines) THEN '' ELSE lines[m] END AS src FROM s),
    p AS (SELECT doc_id, {_TOKENS.format(x='c')} AS w, {_NUMBERS.format(x='c')} AS nums, unnest(ps) AS p, generate_subscripts(ps, 1) AS place FROM (SELECT *, {_PASSAGES.format(x='src')} AS ps FROM x)),
    k AS (SELECT *, len(list_intersect(w, {_TOKENS.format(x='p')})) AS shared, len(list_distinct(list_concat(w, {_TOKENS.format(x='p')}))) AS u, 2 * len(list_intersect(nums, {_NUMBERS.format(x='p')})) AS bonus FROM p),
    b AS (SELECT doc_id, shared + bonus AS score, CASE WHEN u > 0 THEN shared / u ELSE 0 END AS j FROM k QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY shared + bonus DESC, CASE WHEN u > 0 THEN shared / u ELSE 0 END DESC, length(p), place) = 1)
    SELECT x.doc_id, CASE WHEN m = 0 THEN 'uncited' WHEN m > len(lines) THEN 'out_of_range'
      WHEN len(list_filter({_NUMBERS.format(x='c')}, lambda n: NOT contains(src, n))) > 0 THEN 'numbers_absent'
      WHEN len({_NUMBERS.format(x='c')}) = 0 AND (coalesce(score, 0) < 2 OR coalesce(j, 0) < 0.1) THEN 'unrelated' END AS error FROM x LEFT JOIN b USING (doc_id)"""
)
def support_errors(spark, d):
    """The simple validator on a claim against the line of each document that it cites."""
    i = F.col("doc_id")
    t = F.coalesce("text", F.lit(""))
    number = F.when(i % 3 == 0, F.concat(F.lit(" "), (F.char_length(t) % 100).cast("string"))).otherwise("")
    said = F.concat("claim", number, F.when(i % 4 > 0, F.concat(F.lit("["), (i % 4).cast("string"), F.lit("]"))).otherwise(""))
    return _pairs(spark, d).select("doc_id", C.support_error(said, F.split(t, "\n", -1)).alias("error"))


#: The tables' own text has no policy questions: these ask and say by words that it has.
RULES = ((r"^(?:The|That|Th)[a-z]* .*and", ("that ", "of ")), (r"(?:^| )of the ", ("the ", "with ")), (r"(?:^| )(?:die|der) ", ("und ", "ist ")), (r"(?:^| )que ", ("de ",)))


@query(
    """WITH q AS (SELECT doc_id, coalesce(text, '') AS t, lang, n_chars FROM documents),
    a AS (SELECT doc_id, t, lang, CASE WHEN doc_id % 5 = 0 THEN 'how many Chars in ' || lang || '? ' ELSE '' END || string_split(t, '.')[1] AS question, n_chars FROM q),
    c AS (SELECT doc_id, question, unnest(ls) AS line, generate_subscripts(ls, 1) AS rank FROM (SELECT *, list_transform(string_split(t, chr(10)), lambda x: replace(x, '. ', '。')) AS ls FROM a)),
    f AS (SELECT doc_id, 'fact' AS kind, 0 AS rank, n_chars::VARCHAR AS quote, lang || '：chars' || n_chars AS said FROM a WHERE doc_id % 5 = 0 AND lang <> '' AND n_chars IS NOT NULL),
    cl AS (SELECT doc_id, question, rank, line, unnest(x) AS clause, generate_subscripts(x, 1) AS place FROM (SELECT *, list_filter(list_transform(regexp_extract_all(line, '[^。；;\\n]+[。；;]?'), lambda x: trim(x, ' ' || chr(9) || chr(13) || chr(10))), lambda x: x <> '') AS x FROM c)),
    r(rule, pattern, a, b) AS (VALUES (0, '^(?:The|That|Th)[a-z]* .*and', 'that ', 'of '), (1, '(?:^| )of the ', 'the ', 'with '), (2, '(?:^| )(?:die|der) ', 'und ', 'ist '), (3, '(?:^| )que ', 'de ', 'de ')),
    h AS (SELECT c.doc_id, rule, min(rank) AS rank, a, b FROM c JOIN r ON regexp_matches(question, pattern) AND contains(line, a) AND contains(line, b) GROUP BY 1, 2, 4, 5),
    g AS (SELECT h.doc_id, h.rule, h.rank, cl.clause FROM h JOIN cl ON h.doc_id = cl.doc_id AND h.rank = cl.rank AND contains(clause, a) AND contains(clause, b) AND length(clause) <= 520 QUALIFY row_number() OVER (PARTITION BY h.doc_id, h.rule ORDER BY place) = 1),
    u AS (SELECT doc_id, 'clause' AS kind, rank, clause AS quote, clause AS said FROM g WHERE NOT regexp_matches(clause, '原表[:：]|Course\\s+Credi|Weekly\\s+Total|---\\s*\\|') QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY rule) = 1),
    s AS (SELECT doc_id, rank, place, clause, len(list_filter(regexp_extract_all(question, '[一-鿿]{2,8}|[A-Za-z]{2,}\\d*'), lambda w: contains(clause, w))) AS score FROM cl WHERE length(clause) <= 360 AND NOT regexp_matches(clause, '原表[:：]|Course\\s+Credi|Weekly\\s+Total|---\\s*\\|')),
    b AS (SELECT doc_id, 'generic' AS kind, rank, clause AS quote, clause AS said FROM s WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, length(clause), rank, place) = 1),
    z AS (SELECT *, 1 AS o FROM f UNION ALL SELECT *, 2 FROM u UNION ALL SELECT *, 3 FROM b),
    y AS (SELECT *, trim(regexp_replace(said, '\\s+', ' ', 'g'), ' |，,；;。' || chr(10)) AS body FROM z QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY o) = 1)
    SELECT a.doc_id AS question_id, CASE WHEN coalesce(body, '') <> '' THEN kind ELSE 'refused' END AS kind, CASE WHEN body <> '' THEN rank END AS rank, CASE WHEN body <> '' THEN quote END AS quote,
      CASE WHEN coalesce(body, '') <> '' THEN body || '[' || rank || ']。' ELSE 'none' END AS answer FROM a LEFT JOIN y USING (doc_id)"""
)
def policy_answers(spark, d):
    """A document's first sentence asks, its lines answer; a table of its facts stands before them."""
    docs = load(spark, d, "documents").withColumn("text", F.coalesce("text", F.lit("")))
    i = F.col("doc_id")
    asked = F.concat(F.when(i % 5 == 0, F.concat(F.lit("how many Chars in "), "lang", F.lit("? "))).otherwise(""), F.get(F.split("text", r"\.", -1), F.lit(0)))
    questions = docs.select(i.alias("question_id"), asked.alias("question"))
    lines = docs.select(i.alias("question_id"), F.posexplode(F.split("text", "\n", -1)).alias("rank", "text")).select("question_id", (F.col("rank") + 1).alias("rank"), F.replace("text", F.lit(". "), F.lit("。")).alias("text"))
    table = docs.where(i % 5 == 0).select(i.alias("question_id"), F.lit(0).alias("rank"), F.concat(F.lit("facts\n| lang | chars |\n|---|---:|\n| "), "lang", F.lit(" | "), F.col("n_chars").cast("string"), F.lit(" |")).alias("text"))
    # the table's own line is no clause, as a line of dashes marks it
    return P.policy_answers(questions, lines.unionByName(table), RULES, "none")


_QUESTION = "CASE item_id % 4 WHEN 0 THEN '请问' || w[1] || '的' || w[2] || '是不是专业课程，' || w[3] || '2023级算选修？' WHEN 1 THEN '我的' || w[1] || '最迟大三上什么时候交？' || '这个' || w[2] || '早上几点开始' WHEN 2 THEN '想问' || w[1] || ' ' || w[2] || '的忘了怎么办；本人的' || w[3] || '打不开该怎么办' ELSE w[1] || '考试什么时候？课程是什么' END"


@query(
    f"""WITH b AS (SELECT item_id, regexp_extract_all(text, '[a-z]+') AS w FROM benchmark), q AS (SELECT item_id, {_QUESTION} AS q FROM b WHERE len(w) > 2),
    x AS (SELECT item_id, q, 1 AS f, list_transform(regexp_extract_all(q, '([^，。！？!?；;]{{2,24}}?)(?:算不算|是不是|属于|是|算(?:专选|专业选修|选修|必修))(?:什么|哪类|专业|课程|专选|选修|必修)?', 1), lambda x: regexp_replace(regexp_replace(regexp_replace(string_split(trim(x), '的')[-1], '^(请问|想问|那么|这个)', ''), '\\d{{4}}级$', ''), '(?:还|分别|范围|是否|属于)$', '')) AS c FROM q
      UNION ALL SELECT item_id, q, 2, list_transform(regexp_extract_all(q, '([^，。！？!?；;]{{2,30}}?)(?:什么时候|何时|几点)', 1), lambda x: rtrim(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(trim(x), '^(请问|想问|我想知道|那么|这个)', ''), '^(?:我(?:的)?|本人(?:的)?)', ''), '(?:最迟|最晚|通常|一般|大概|大约)$', ''), '(?:在)?大[一二三四](?:上|下)?(?:学期)?$', ''), '(?:早上|上午|中午|下午|晚上)$', '')), '的')) FROM q
      UNION ALL SELECT item_id, q, 3, list_transform(regexp_extract_all(q, '([^，。！？!?；;]{{2,24}}?)(?:忘了|丢了|遗失了|找不到了|打不开|登录不了)(?:该)?怎么办', 1), lambda x: rtrim(trim(regexp_replace(regexp_replace(trim(x), '^(请问|想问|我想知道|那么|这个)', ''), '^(?:我(?:的)?|本人(?:的)?)', '')), '的')) FROM q),
    y AS (SELECT item_id, q, f, list_filter(list_transform(c, lambda x: trim(x)), lambda x: length(x) BETWEEN 2 AND CASE f WHEN 1 THEN 10 ELSE 24 END AND (f <> 1 OR x NOT IN ('课程', '课', '这门课', '要求', '条件', '学分')) AND (f <> 2 OR x NOT IN ('考试', '课程', '规定', '政策', '学校'))) AS c FROM x)
    SELECT item_id, q AS question, coalesce(string_agg(array_to_string(c, '|'), '|' ORDER BY f) FILTER (WHERE len(c) > 0), '') AS subjects FROM y GROUP BY 1, 2"""
)
def asked_subjects(spark, d):
    """What questions of kind, of time and for help are about; the words come from the table."""
    w = lambda i: F.get("w", F.lit(i - 1))
    k = F.col("item_id") % 4
    b = load(spark, d, "benchmark").select("item_id", F.regexp_extract_all("text", F.lit("([a-z]+)"), F.lit(1)).alias("w")).where(F.size("w") > 2)
    lit = F.lit
    asked = (
        F.when(k == 0, F.concat(lit("请问"), w(1), lit("的"), w(2), lit("是不是专业课程，"), w(3), lit("2023级算选修？")))
        .when(k == 1, F.concat(lit("我的"), w(1), lit("最迟大三上什么时候交？这个"), w(2), lit("早上几点开始")))
        .when(k == 2, F.concat(lit("想问"), w(1), lit(" "), w(2), lit("的忘了怎么办；本人的"), w(3), lit("打不开该怎么办")))
        .otherwise(F.concat(w(1), lit("考试什么时候？课程是什么")))
    )
    return b.select("item_id", asked.alias("question")).withColumn("subjects", F.array_join(N.asked_subjects(F.col("question")), "|"))


@query(None)
def chunk_table(spark, d):
    """Each document's chunks by one lateral call: its lines under a chapter, then its lines as a table under an article (tested against the parts' own operators)."""
    docs = load(spark, d, "documents")
    t = F.coalesce("text", F.lit(""))
    rows = F.transform(F.split(t, "\n", -1), lambda x, i: F.concat(F.lit("| "), i.cast("string"), F.lit(" | "), F.replace(x, F.lit("|"), F.lit("/")), F.lit(" |")))
    text = F.concat(F.lit("第1章 "), F.coalesce("lang", F.lit("")), F.lit("\n"), t, F.lit("\n第2条 表\n| n | line |\n|---|---|\n"), F.array_join(rows, "\n"))
    found = chunks_of(docs, text, 400, ["doc_id"])
    return found.select("doc_id", "part", "chapter", "article", "kind", F.char_length("body").cast("bigint").alias("n_chars"), F.md5("body").alias("body"))


@query(
    f"""WITH {_PAIRS_SQL}, l AS (SELECT doc_id, claim, unnest(string_split(t, chr(10))) AS line, generate_subscripts(string_split(t, chr(10)), 1) AS place FROM d),
    s AS (SELECT *, list_distinct(regexp_extract_all(lower(claim), '[a-z]+\\d*|\\d+(?:\\.\\d+)?%?')) AS w, list_distinct(regexp_extract_all(lower(line), '[a-z]+\\d*|\\d+(?:\\.\\d+)?%?')) AS o, list_distinct(regexp_extract_all(claim, '[A-Za-z]{{2,}}[- ]?\\d{{2,4}}|第[一二三四五六七八九十百零〇\\d]+条|\\d+(?:\\.\\d+)?')) AS e FROM l)
    SELECT doc_id, place, round(0.65 * CASE WHEN len(w) > 0 THEN len(list_intersect(w, o)) / len(w) ELSE 0 END + 0.35 * CASE WHEN len(e) > 0 THEN len(list_filter(e, lambda x: contains(line, x))) / len(e) ELSE 0 END, 6) AS rerank FROM s"""
)
def lexical_rerank(spark, d):
    """The lexical reranker through the checked slot: every line of every document for the claim that is held against it."""
    lines = _pairs(spark, d).select("doc_id", "claim", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n", -1)).alias("place", "line"))
    return reranked(lines, "doc_id", "claim", "line", LexicalReranker()).select("doc_id", (F.col("place") + 1).alias("place"), F.round("rerank", 6).alias("rerank"))


@query(None)
def hashed_vectors(spark, d):
    """Every text of benchmark by the hashing encoder, through the checked slot (tested against its own loop)."""
    b = load(spark, d, "benchmark").select("item_id", "text")
    found = encoded(b, "item_id", "text", HashingEncoder(64))
    return found.select("item_id", F.transform("embedding", lambda x: F.round(x, 9)).alias("embedding"))
