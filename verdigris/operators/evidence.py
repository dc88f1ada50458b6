"""Evidence rows: following and rebound evidence, headers, signals, coverage, passages, context."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import compact_strict, token_set
from .resolve import _small

# Weights of the exact signal, the passage threshold, header scores.
SIGNAL = {"codes": 0.45, "articles": 0.25, "numbers": 0.2, "title": 0.1}
PASSAGE_THRESHOLD = 0.12
HEADER_SCORES = {"exact": 20, "article": 10, "table": 3, "any": 1}


def following(rows: DataFrame, by: list[str], seq: str, value: str, out: str = "next") -> DataFrame:
    """The value of the next row with the same keys."""
    return rows.withColumn(out, F.lead(value).over(Window.partitionBy(*by).orderBy(seq)))


def rebind(claims: DataFrame, chunks: DataFrame, key: str, holds: Column, order: list[Column]) -> DataFrame:
    """claims (claim_id, key, current, ...): the current chunk if it still holds, else the first that does, else none.

    chunks meet on the key alone; holds and order refer to both sides.
    """
    met = claims.join(chunks, key).where(holds)
    keeps = (F.col("chunk_id") == F.col("current")).cast("int")
    best = met.withColumn("_n", F.row_number().over(Window.partitionBy("claim_id").orderBy(keeps.desc(), *order, "chunk_id"))).where("_n = 1")
    return claims.join(best.select("claim_id", "chunk_id"), "claim_id", "left").select("claim_id", "current", F.col("chunk_id").alias("evidence"))


def names_in(questions: DataFrame, names: DataFrame) -> DataFrame:
    """(question_id, name) of the longest compact names within each question. names is a catalog's list."""
    q = questions.withColumn("_q", compact_strict(F.col("question")))
    k = names.select("name").distinct().withColumn("_k", compact_strict(F.col("name"))).where("_k <> ''")
    met = k.join(_small(q), F.instr(F.col("_q"), F.col("_k")) > 0)  # the questions are the stated query set
    longest = met.withColumn("_m", F.max(F.char_length("_k")).over(Window.partitionBy("question_id")))
    return longest.where(F.char_length("_k") == F.col("_m")).select("question_id", "name")


def header_rank(rows: DataFrame, by: list[str], exact: Column, article: Column, table: Column, seq: str) -> DataFrame:
    """The best header row of each key: exact match counts most, tables and earlier rows win ties."""
    score = F.when(exact, HEADER_SCORES["exact"]).otherwise(0) + F.when(article, HEADER_SCORES["article"]).otherwise(0) + F.when(table, HEADER_SCORES["table"]).otherwise(0) + HEADER_SCORES["any"]
    ranked = rows.withColumn("score", score).withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), table.desc(), seq)))
    return ranked.where("_n = 1").drop("_n")


def first_hit(rows: DataFrame, by: list[str], text: str, pattern: str, order: list[Column]) -> DataFrame:
    """The first regex hit of each key, in order."""
    hits = rows.withColumn("hit", F.regexp_extract(text, pattern, 1)).where("hit <> ''")
    return hits.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where("_n = 1").select(*by, "hit")


def share_in(wanted: Column, text: Column) -> Column:
    """Share of the wanted strings that the text contains; 0 if none are wanted."""
    return F.when(F.size(wanted) > 0, F.size(F.filter(wanted, lambda x: F.instr(text, x) > 0)) / F.size(wanted)).otherwise(0.0)


def exact_signal(codes: Column, articles: Column, numbers: Column, title_tokens: Column, text: Column, title: Column) -> Column:
    total = SIGNAL["codes"] * share_in(codes, text) + SIGNAL["articles"] * share_in(articles, text) + SIGNAL["numbers"] * share_in(numbers, text)
    shared = F.when(F.size(title_tokens) > 0, F.size(F.array_intersect(title_tokens, token_set(title))) / F.size(title_tokens)).otherwise(0.0)
    return F.least(F.lit(1.0), total + SIGNAL["title"] * shared)


def entity_coverage(shown: DataFrame, wanted: DataFrame, by: str, text: str) -> DataFrame:
    """Whether every required entity of a query stands in one of its shown texts. The texts are not gathered: each row answers for itself."""
    each = wanted.select(by, F.explode("entities").alias("entity"))
    met = each.join(shown.select(by, text), by, "left").groupBy(by, "entity").agg(F.max(F.coalesce(F.instr(F.col(text), F.col("entity")) > 0, F.lit(False)).cast("int")).alias("_in"))
    return met.groupBy(by).agg((F.min("_in") == 1).alias("covered"))


def best_passage(texts: DataFrame, questions: DataFrame, key: str, text: str, threshold: float = PASSAGE_THRESHOLD) -> DataFrame:
    """(query_id, key, passage_no, share): for each question its best line, the shortest and first of equals, if it reaches the threshold."""
    asked = questions.select("query_id", token_set(F.col("query_text")).alias("_want"))
    lines = texts.select(key, F.posexplode(F.split(text, "\n", -1)).alias("passage_no", "_line")).where("_line <> ''").withColumn("_has", token_set(F.col("_line")))
    met = lines.crossJoin(_small(asked))  # the stated query set against all passages
    share = F.when(F.size("_want") > 0, F.size(F.array_intersect("_want", "_has")) / F.size("_want")).otherwise(0.0)
    scored = met.select("query_id", key, "passage_no", F.char_length("_line").alias("_n"), share.alias("share")).where(F.col("share") >= threshold)
    best = scored.groupBy("query_id").agg(F.max(F.struct("share", (-F.col("_n")).alias("n"), (-F.col(key)).alias("k"), (-F.col("passage_no")).alias("p"))).alias("m"))
    return best.select("query_id", (-F.col("m.k")).alias(key), (-F.col("m.p")).alias("passage_no"), F.col("m.share").alias("share"))


def pack_context(ranked: DataFrame, by: str, rank: str, size: Column, budget: int) -> DataFrame:
    """Chunks in rank order while they fit; the first that doesn't ends it."""
    running = F.sum(size).over(Window.partitionBy(by).orderBy(rank).rowsBetween(Window.unboundedPreceding, 0))
    return ranked.withColumn("used", running).where(F.col("used") <= budget)


def numbers_of(text: Column) -> Column:
    return F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit(r"(\d+(?:\.\d+)?)"), F.lit(1))))


def wording_violation(text: Column, body: Column) -> Column:
    """numbers if a rewording has other numbers than its body, length if it is empty, else null."""
    return F.when(F.trim(text) == "", "empty").when(numbers_of(text) != numbers_of(body), "numbers")


def complete(required: Column, text: Column) -> Column:
    return F.forall(required, lambda x: F.instr(text, x) > 0)


def both_ways(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Keys of one side alone."""
    left = a.select(key).distinct().join(b.select(key), key, "left_anti").withColumn("side", F.lit("only_a"))
    right = b.select(key).distinct().join(a.select(key), key, "left_anti").withColumn("side", F.lit("only_b"))
    return left.unionByName(right)


def later_wins(first: DataFrame, second: DataFrame, key: str) -> DataFrame:
    """The union by key; the second frame's row replaces the first's."""
    return second.unionByName(first.join(second.select(key), key, "left_anti"))
