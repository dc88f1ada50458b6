"""Quality rules whose cutoffs carry a guarantee.

Features of every whole text are computed with array functions alone. Cutoffs
come from labelled documents in two halves (by a hash of doc_id). On the first,
each stratum and feature takes, at each of a few tolerances, the lowest cutoff of
a fixed grid that rejects no more good documents than that. On the second, the
exact binomial upper bound of each joint rule's false rejections is tested at
DELTA, divided by the number of strata and tolerances (Bonferroni); a stratum
uses the rule that rejects most among those whose bound is at most ALPHA. With
probability 1 - DELTA no stratum rejects over ALPHA of its good documents.
A stratum with too few labels to prove this gets no rule.

Only counts for each stratum, feature and grid step reach the driver.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE, SPACE_CLASS, boxed, table, whole, written

ALPHA = 0.02
DELTA = 0.05
TOLERANCES = (0.0, 0.0005, 0.002)
MIN_WORDS = 50
#: A document fails if its value is above the cutoff. The grids are fixed before any label is seen.
GRIDS = {
    "symbol_ratio": tuple(i / 100 for i in range(2, 61, 2)),
    "dup_line_ratio": tuple(i / 20 for i in range(1, 20)),
    "repeat_ratio": tuple(i / 40 for i in range(2, 40)),
    "upper_ratio": tuple(i / 40 for i in range(3, 40)),
    "bang_ratio": tuple(i / 20 for i in range(1, 20)),
    "word_length": tuple(i / 2 for i in range(10, 41)),
}
MEASURED = frozenset({"n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", *GRIDS})
#: Bits that hold a word's position beside the hash of the window that begins there, in texts of no more words than that.
_POS_BITS = 24
_POS_MASK = (1 << _POS_BITS) - 1


def binomial_tail(k: int, n: int, p: float) -> float:
    """P(X <= k) for X ~ Binomial(n, p), by the continued fraction of the incomplete beta function."""
    if k >= n:
        return 1.0
    if p <= 0:
        return 1.0
    if p >= 1:
        return 0.0
    return _beta(n - k, k + 1, 1 - p)


def _beta(a: float, b: float, x: float) -> float:
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x > (a + 1) / (a + b + 2):
        return 1 - front * _fraction(b, a, 1 - x) / b
    return front * _fraction(a, b, x) / a


def _fraction(a: float, b: float, x: float) -> float:
    tiny = 1e-300
    c, d = 1.0, 1 / max(1 - (a + b) * x / (a + 1), tiny)
    out = d
    for m in range(1, 20_000):
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + top * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + top / c
            c = c if abs(c) > tiny else tiny
            out *= c * d
        if abs(c * d - 1) < 1e-13:
            break
    return out


def upper_bound(k: int, n: int, delta: float) -> float:
    """Clopper and Pearson: the largest rate under which k or fewer of n still happens with probability delta."""
    if n == 0 or k >= n:
        return 1.0
    low, high = k / n, 1.0
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if binomial_tail(k, n, mid) > delta else (low, mid)
    return high


def _measured(docs: DataFrame, text_col: str) -> DataFrame:
    """(row, text, the counts and features of every text); row holds all columns but the text."""
    own, text = ["row", "text"], F.col("text")
    a = docs.select(boxed(docs, text_col), whole(F.col(f"`{text_col}`")).alias("text"), F.col(f"`{text_col}`").isNull().alias("null")).select(
        "row",
        F.when(~F.col("null"), text).alias("text"),
        F.filter(F.split(text, SPACE_CLASS + "+", -1), lambda w: w != "").alias("_words"),
        F.filter(F.split(text, "\n", -1), lambda x: F.btrim(x, F.lit(SPACE)) != "").alias("_lines"),
        F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("bigint").alias("n_symbols"),
        F.regexp_count(text, F.lit("[A-Z]")).cast("bigint").alias("_upper"),
        F.regexp_count(text, F.lit("!")).cast("bigint").alias("_bang"),
    )
    b = a.select(
        *own,
        "n_symbols",
        "_upper",
        "_bang",
        F.size("_words").alias("_n"),
        F.aggregate("_words", F.lit(0).cast("bigint"), lambda s, w: s + F.char_length(w)).alias("word_chars"),
        F.size("_lines").alias("_n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("bigint").alias("n_dup_lines"),
        F.transform("_words", lambda w: F.xxhash64(w)).alias("_h"),
    )
    starts = F.when(F.col("_n") >= 3, F.sequence(F.lit(0), F.col("_n") - 3)).otherwise(F.array().cast("array<int>"))
    c = b.withColumn("_w", F.transform(starts, lambda i: F.xxhash64(F.get("_h", i), F.get("_h", i + 1), F.get("_h", i + 2))))
    # the window's hash above its position: equal windows meet when sorted
    packed = F.zip_with("_w", starts, lambda h, i: h.bitwiseAND(F.lit(~_POS_MASK)).bitwiseOR(i.cast("bigint")))
    d = c.withColumn("_s", F.sort_array(packed))
    n = F.size("_s")
    at = lambda x: x.bitwiseAND(F.lit(_POS_MASK)).cast("int")
    upper = lambda x, y: F.shiftright(x, _POS_BITS) == F.shiftright(y, _POS_BITS)
    equal = lambda x, y: F.get("_w", at(x)) == F.get("_w", at(y))
    neighbours = lambda f: F.zip_with(F.slice("_s", 1, n - 1), F.slice("_s", 2, n - 1), f)
    # where positions don't fit beside the hash, or windows that differ agree in its upper bits and so may stand between equal ones: pairs of both, whole
    mixed = F.exists(neighbours(lambda x, y: upper(x, y) & ~equal(x, y)), lambda x: x)
    apart = F.sort_array(F.zip_with("_w", starts, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    d = d.withColumn("_z", F.when(F.when(F.col("_n") - 3 > _POS_MASK, True).otherwise((n >= 2) & mixed), apart))
    far = F.filter(F.zip_with(F.slice("_z", 1, n - 1), F.slice("_z", 2, n - 1), lambda x, y: F.when(x["h"] == y["h"], F.array(x["i"], y["i"]))), lambda p: p.isNotNull())
    near = F.filter(neighbours(lambda x, y: F.when(upper(x, y) & equal(x, y), F.array(at(x), at(y)))), lambda p: p.isNotNull())
    pairs = F.when((n >= 2) & F.col("_z").isNotNull(), far).when(n >= 2, near).otherwise(F.array().cast("array<array<int>>"))
    e = d.withColumn("_p", F.sort_array(F.array_distinct(F.flatten(pairs)))).drop("_s", "_z", "_w", "_h")
    m = F.size("_p")
    gaps = F.aggregate(F.zip_with(F.slice("_p", 1, F.greatest(m - 1, F.lit(0))), F.slice("_p", 2, F.greatest(m - 1, F.lit(0))), lambda x, y: F.least(y - x, F.lit(3))), F.lit(0).cast("bigint"), lambda s, x: s + x)
    f = e.withColumn("n_repeat_words", F.when(m > 0, gaps + 3).otherwise(F.lit(0).cast("bigint"))).withColumn("n_words", F.col("_n").cast("bigint"))
    over = lambda x, y: F.when(F.col(y) > 0, F.col(x) / F.col(y)).otherwise(0.0)
    g = f.withColumns(
        {
            "base_failed": (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")),
            "symbol_ratio": over("n_symbols", "word_chars"),
            "dup_line_ratio": over("n_dup_lines", "_n_lines"),
            "repeat_ratio": over("n_repeat_words", "n_words"),
            "upper_ratio": over("_upper", "word_chars"),
            "bang_ratio": over("_bang", "n_words"),
            "word_length": over("word_chars", "n_words"),
        }
    )
    return g.drop("_p", "_n", "_n_lines", "_upper", "_bang")


def measured(docs: DataFrame, text_col: str = "text", keep_text: bool = False) -> DataFrame:
    """Adds the counts: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed and the grids' features.

    A null or empty text has no words; every count is then 0 and base_failed true.
    Columns of these names are replaced, others pass through, whatever their names;
    the text is dropped unless keep_text. Repeated rows stay; an empty frame gives none.
    """
    names = [c for c in docs.columns if c not in MEASURED and (keep_text or c != text_col)]
    return _measured(docs, text_col).select(*[F.col("text").alias(c) if c == text_col else F.col("row")[c].alias(c) for c in names], *sorted(MEASURED))


def _steps(feature: str) -> Column:
    """How many cutoffs of the grid the value is above."""
    return F.size(F.filter(F.array(*[F.lit(float(x)) for x in GRIDS[feature]]), lambda x: x < F.col(feature)))


def cutoffs(features: DataFrame, labels: DataFrame, stratum: str = "lang", alpha: float = ALPHA, delta: float = DELTA) -> dict[str | None, dict[str, float]]:
    """For each stratum the cutoff of each feature that has one. labels: doc_id, quality (1 good, 0 bad).

    Repeated labels count once, as good if any says so; null labels don't count.
    Documents that fail the base rules need no cutoff and take no part.
    """
    truth = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("_id")).agg(F.max("quality").alias("_q"))
    # written first: a filter or join would otherwise be pushed below the feature columns, which are then computed again within one another's lambdas
    ready = written(features.select(F.col("doc_id").alias("_doc"), F.col(stratum).alias("_stratum"), "base_failed", *GRIDS), "quality-ready")
    known = ready.where(~F.col("base_failed")).join(truth, F.col("_doc") == F.col("_id"))
    known = known.select("_stratum", (F.pmod(F.xxhash64(F.lit("half"), "_id"), F.lit(2)) == 0).alias("_first"), "_q", *GRIDS)
    known = written(known, "quality-labels")
    steps = known.where("_first").select("_stratum", "_q", F.inline(F.array(*[F.struct(F.lit(k).alias("feature"), _steps(k).alias("step")) for k in GRIDS])))
    counts = steps.groupBy("_stratum", "_q", "feature", "step").count().collect()  # strata x features x grid
    strata = sorted({r[0] for r in counts}, key=lambda x: (x is not None, x))
    rules = []
    for s in strata:
        good = sum(r["count"] for r in counts if r[0] == s and r[1] == 1 and r[2] == "word_length")
        for level, tolerance in enumerate(TOLERANCES):
            rule = {}
            for k, grid in GRIDS.items():
                above = lambda q, i, k=k, s=s: sum(r["count"] for r in counts if r[0] == s and r[1] == q and r[2] == k and r[3] > i)
                fit = next((i for i in range(len(grid)) if above(1, i) <= tolerance * good), None)
                if fit is not None and above(0, fit):
                    rule[k] = grid[fit]
            rules.append((s, level, rule))
    rules = [x for x in rules if x[2]]
    if not rules:
        return {}
    fails = lambda s, rule: F.col("_stratum").eqNullSafe(F.lit(s)) & _any([F.col(k) > F.lit(float(x)) for k, x in rule.items()])
    sums = [F.sum(F.when(fails(s, rule) & (F.col("_q") == q), 1).otherwise(0)).alias(f"r{i}_{q}") for i, (s, _, rule) in enumerate(rules) for q in (0, 1)]
    sizes = dict(known.where(~F.col("_first") & (F.col("_q") == 1)).groupBy("_stratum").count().collect())
    seen = known.where(~F.col("_first")).agg(*sums).first()
    out: dict[str | None, dict[str, float]] = {}
    most: dict[str | None, int] = {}
    for i, (s, _, rule) in enumerate(rules):
        n = sizes.get(s, 0)
        if n and upper_bound(seen[f"r{i}_1"] or 0, n, delta / (len(strata) * len(TOLERANCES))) <= alpha and (seen[f"r{i}_0"] or 0) > most.get(s, 0):
            out[s], most[s] = rule, seen[f"r{i}_0"]
    return out


def _any(columns: list[Column]) -> Column:
    out = F.lit(False)
    for x in columns:
        out = out | x
    return out


def judged(docs: DataFrame, labels: DataFrame, stratum: str = "lang", text_col: str = "text") -> DataFrame:
    """Every row of docs without its text, with the counts of measured() and kept.

    kept is false if base_failed or if the stratum's rule rejects. Repeated rows
    stay; a null stratum is a stratum of its own; an empty frame gives none.
    """
    features = written(measured(docs, text_col), "quality-features")
    return features.withColumn("kept", ~F.col("base_failed") & ~_rejected(cutoffs(features, labels, stratum), stratum))


def _rejected(rules: dict[str | None, dict[str, float]], stratum: str) -> Column:
    return _any([F.col(stratum).eqNullSafe(F.lit(s)) & _any([F.col(k) > F.lit(float(x)) for k, x in rule.items()]) for s, rule in rules.items()])


def filter_quality(docs: DataFrame, labels: DataFrame, stratum: str = "lang", text_col: str = "text") -> DataFrame:
    """The rows of docs that judged() keeps, whole and with their own columns, whatever their names.

    Null and empty texts fail the base rules and go; repeated rows are judged alike;
    an empty frame gives none. Rows and features are written together before the
    filter, for the reason given in cutoffs().
    """
    rows = written(_measured(docs, text_col), "quality-rows")
    rules = cutoffs(rows.select(F.col("row")["doc_id"].alias("doc_id"), F.col("row")[stratum].alias(stratum), "base_failed", *GRIDS), labels, stratum)
    kept = rows.withColumn("_stratum", F.col("row")[stratum]).where(~F.col("base_failed") & ~_rejected(rules, "_stratum"))
    return kept.select(*[F.col("text").alias(c) if c == text_col else F.col("row")[c].alias(c) for c in docs.columns])


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document judged: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept.

    A null text has no words; repeated rows stay; an empty table gives none.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    out = judged(docs, table(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
