"""Citations of an answer's sentences: which passage supports a claim, what is quoted, and which rule a sentence breaks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.questions import cited_at_end, exempt
from ..functions.text import bound, text_of, token_set

# Marks, numbers, passages' ends, words that carry no claim, and the limits.
MARKER = r"\[(\d+)\]"
NUMBER = r"\d+(?:\.\d+)?%?"
PASSAGE_END = r"(?<=[。！？!?；;])|\n+"
STOP_WORDS = ("的", "了", "和", "与", "及", "或", "是", "为", "在", "按", "由", "应", "须", "可以", "规定", "学生", "申请人", "根据", "其中")
QUOTE_CHARS = 300
LEAST_SHARED, LEAST_JACCARD = 2, 0.1
MOST_MARKERS = 4


def content_tokens(text: Column) -> Column:
    """Distinct tokens without marks and the words that carry no claim."""
    return F.array_except(token_set(F.regexp_replace(text_of(text), MARKER, "")), F.array(*map(F.lit, STOP_WORDS)))


def numbers_in(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.regexp_replace(text_of(text), MARKER, ""), F.lit(f"({NUMBER})"), F.lit(1)))


def passages(text: Column) -> Column:
    """The text's passages without white space at their ends; the text itself if there is none."""
    found = F.filter(F.transform(F.split(text_of(text), PASSAGE_END, -1), lambda x: F.btrim(x, F.lit(" \t\r\n"))), lambda x: x != "")
    return bound(found, lambda x: F.when(F.size(x) > 0, x).otherwise(F.array(text_of(text))))


def best_passage(claim: Column, text: Column) -> Column:
    """struct(passage, score, jaccard, shared) of the passage that shares most with the claim.

    score: shared tokens, and two for each number of the claim that the passage
    has. Equal scores go by the Jaccard similarity of the tokens, then to the
    shorter, then to the first; where nothing is shared, the whole text stays
    unless a passage is shorter. Null texts count as empty.
    """
    return bound(F.struct(content_tokens(claim).alias("tokens"), numbers_in(claim).alias("numbers")), lambda asked: _best_of(asked["tokens"], asked["numbers"], text))


def _best_of(wanted: Column, numbers: Column, text: Column) -> Column:
    """best_passage for a claim's tokens and numbers. What is used twice is bound, as higher-order functions share nothing."""

    def counted(passage: Column, own: Column) -> Column:
        bonus = 2 * F.size(F.array_intersect(numbers, F.array_distinct(F.regexp_extract_all(passage, F.lit(f"({NUMBER})"), F.lit(1)))))
        return F.struct(F.size(F.array_intersect(wanted, own)).alias("shared"), F.size(F.array_union(wanted, own)).alias("union"), bonus.alias("bonus"))

    def judged(passage: Column, n: Column) -> Column:
        jaccard = F.when(n["union"] > 0, n["shared"] / n["union"]).otherwise(F.lit(0.0))
        key = F.struct((n["shared"] + n["bonus"]).cast("int").alias("score"), jaccard.cast("double").alias("jaccard"), (-F.char_length(passage)).cast("int").alias("short"))
        return F.struct(key.alias("key"), passage.alias("passage"), n["shared"].cast("int").alias("shared"))

    each = lambda x: bound(content_tokens(x), lambda own: bound(counted(x, own), lambda n: judged(x, n)))
    none = F.struct(F.struct(F.lit(0).alias("score"), F.lit(0.0).alias("jaccard"), (-F.char_length(text_of(text))).cast("int").alias("short")).alias("key"), text_of(text).alias("passage"), F.lit(0).alias("shared"))
    best = F.aggregate(F.transform(passages(text), each), none, lambda a, b: F.when(b["key"] > a["key"], b).otherwise(a))
    return bound(best, lambda x: F.struct(x["passage"].alias("passage"), x["key"]["score"].alias("score"), x["key"]["jaccard"].alias("jaccard"), x["shared"].alias("shared")))


def quote_of(claim: Column, passage: Column, most: int = QUOTE_CHARS) -> Column:
    """At most so many characters of the passage: a third of them before the first token of the claim that stands there as it is."""

    def cut(x: Column) -> Column:
        places = F.filter(F.transform(content_tokens(claim), lambda t: F.instr(x, t) - 1), lambda i: i >= 0)
        start = F.greatest(F.lit(0), F.least(F.coalesce(F.array_min(places), F.lit(0)) - most // 3, F.char_length(x) - most))
        return F.when(F.char_length(x) <= most, x).otherwise(F.substring(x, start + 1, F.lit(most)))

    return bound(passage, cut)


def markers_of(sentence: Column) -> Column:
    return F.transform(F.regexp_extract_all(text_of(sentence), F.lit(MARKER), F.lit(1)), lambda x: x.try_cast("int"))


def marker_error(sentence: Column, n_sources: Column) -> Column:
    """The first rule on marks that a sentence breaks, or null: one at least, four at most, at its end, each of a source."""
    marks = markers_of(sentence)
    return F.when(
        ~exempt(text_of(sentence)),
        F.when(F.size(marks) == 0, "uncited")
        .when(F.size(marks) > MOST_MARKERS, "too_many")
        .when(~cited_at_end(text_of(sentence)), "not_at_end")
        .when(F.exists(marks, lambda m: F.coalesce((m < 1) | (m > n_sources), F.lit(True))), "out_of_range"),
    )


def support_error(sentence: Column, sources: Column) -> Column:
    """The simple validator's first objection, or null. sources: the texts that marks number from 1.

    A claim with numbers needs all of them in what it cites; one without needs two
    shared tokens and a Jaccard similarity of 0.1 with the best passage.
    """
    asked = F.struct(text_of(sentence).alias("said"), F.array_distinct(markers_of(sentence)).alias("marks"), content_tokens(sentence).alias("tokens"), numbers_in(sentence).alias("numbers"))

    def objection(x: Column) -> Column:
        marks, numbers = x["marks"], x["numbers"]
        bad = F.exists(marks, lambda m: F.coalesce((m < 1) | (m > F.size(sources)), F.lit(True)))
        cited = F.transform(marks, lambda m: text_of(F.get(sources, m - 1)))
        best = F.transform(cited, lambda c: _best_of(x["tokens"], numbers, c))
        most = lambda b, field: F.coalesce(F.array_max(F.transform(b, lambda y: y[field])), F.lit(0))
        return F.when(
            ~exempt(x["said"]),
            F.when(F.size(marks) == 0, "uncited")
            .when(bad, "out_of_range")
            .when(bound(F.array_join(cited, "\n"), lambda all_of: F.exists(numbers, lambda n: ~F.contains(all_of, n))), "numbers_absent")
            .when((F.size(numbers) == 0) & bound(best, lambda b: (most(b, "score") < LEAST_SHARED) | (most(b, "jaccard") < LEAST_JACCARD)), "unrelated"),
        )

    return bound(asked, objection)
