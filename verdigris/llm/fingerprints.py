"""Document fingerprints by one-permutation MinHash, with array functions alone.

Each five-word shingle is hashed once; the top bits name its bin and a bin keeps
its least hash. An empty bin borrows from a filled one: the first filled bin in a
random order of its own (the least of one hash for each pair of bins), which is
optimal densification without repeated draws. The low-order BITS of each bin's
hash are packed in hexadecimal. Two fingerprints agree in a bin by chance with
probability 2^-BITS, which the estimate takes off.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import SPACE_CLASS, table, whole

BIN_BITS = 7
BINS = 1 << BIN_BITS
BITS = 8
SHINGLE = 5
#: Row ranges for each shuffle partition, or more: one for every so many bytes of text, up to a number whose bounds are a small literal.
RANGES = 4
RANGE_BYTES = 64 << 20
MOST_RANGES = 20_000


def _bin(x: Column) -> Column:
    return F.shiftrightunsigned(x, 64 - BIN_BITS).cast("int")


def with_bins(df: DataFrame, text: str, out: str) -> DataFrame:
    """Adds out, the low-order bits of every bin (array of BINS ints), for the string column text.

    A text of fewer words than a shingle has one shingle; all texts without a word
    share one fingerprint.
    """
    own = df.columns
    h, s, f, b = (f"_{out}_{x}" for x in "hsfb")
    words = F.filter(F.split(F.col(text), SPACE_CLASS + "+", -1), lambda w: w != "")
    a = df.withColumn(h, F.transform(words, lambda w: F.xxhash64(w)))
    n = F.size(h)
    # each step refers to the last one's column twice or more, or outside of lambdas alone: the optimizer then keeps it apart
    rolled = F.transform(F.sequence(F.lit(0), n - SHINGLE), lambda i: F.xxhash64(*[F.get(F.col(h), i + k) for k in range(SHINGLE)]))
    a = a.withColumn(s, F.sort_array(F.when(n >= SHINGLE, rolled).otherwise(F.array(F.xxhash64(F.lit("short"), F.col(h))))))
    a = a.select(*own, s).withColumn(f, F.filter(F.col(s), lambda x, i: (i == 0) | (_bin(x) != _bin(F.get(F.col(s), i - 1)))))
    a = a.select(*own, f).withColumn(b, F.transform(F.col(f), _bin))
    pick = lambda i: F.when(
        F.array_position(F.col(b), i) > 0, F.get(F.col(f), (F.array_position(F.col(b), i) - 1).cast("int"))
    ).otherwise(F.get(F.col(f), F.array_min(F.transform(F.col(b), lambda j, at: F.xxhash64(i, j).bitwiseAND(F.lit(~(BINS - 1))).bitwiseOR(at.cast("bigint")))).bitwiseAND(F.lit(BINS - 1)).cast("int")))
    low = lambda x: x.bitwiseAND(F.lit((1 << BITS) - 1)).cast("int")
    return a.select(*own, F.transform(F.sequence(F.lit(0), F.lit(BINS - 1)), lambda i: low(pick(i))).alias(out))


def packed(bins: Column) -> Column:
    """BITS for each bin, in lower-case hexadecimal."""
    return F.lower(F.array_join(F.transform(bins, lambda x: F.lpad(F.hex(x), BITS // 4, "0")), ""))


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity of two bin arrays: the share of equal bins less those equal by chance, from 0 to 1."""
    chance = 2.0**-BITS
    equal = F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x) / BINS
    return F.greatest(F.lit(0.0), (equal - chance) / (1 - chance))


def _ranged(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) with _range, and rows again where a range needs the first row after it (_extra 1; after the last: _extra 2)."""
    size = docs.agg(F.sum(F.octet_length("text").cast("bigint"))).first()[0] or 0
    n = min(MOST_RANGES, max(RANGES * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // RANGE_BYTES)))
    cuts = docs.agg(F.percentile_approx("doc_id", [i / n for i in range(1, n)], 20 * n).alias("c")).first()["c"]  # one id for each range
    bounds = sorted(set(cuts or []))
    listed = lambda ids: F.split(F.lit(",".join(map(str, ids))), ",").cast("array<bigint>")  # noqa: E731  folds to one literal
    if not bounds:
        where = F.lit(0)
    else:
        step = max(1, int(len(bounds) ** 0.5))
        coarse = bounds[step - 1 :: step]
        skipped = F.size(F.filter(listed(coarse), lambda x: x < F.col("doc_id"))) * step
        where = skipped + F.size(F.filter(F.slice(listed(bounds), skipped + 1, F.lit(step)), lambda x: x < F.col("doc_id")))
    placed = docs.withColumn("_range", F.when(F.col("doc_id").isNull(), 0).otherwise(where))
    firsts = sorted(placed.groupBy("_range").agg(F.min(F.struct(F.col("doc_id").isNotNull().alias("n"), "doc_id")).alias("m")).collect(), key=lambda r: r["_range"])  # one row for each range
    again = [(firsts[i]["m"]["doc_id"], firsts[i - 1]["_range"], 1) for i in range(1, len(firsts))]
    if firsts:
        again.append((firsts[0]["m"]["doc_id"], firsts[-1]["_range"], 2))
    text = ",".join(f"{'' if i is None else i}:{r}:{e}" for i, r, e in again) or ":-1:1"
    parts = F.split("x", ":")
    extra = docs.sparkSession.range(1).select(F.explode(F.split(F.lit(text), ",")).alias("x"))
    extra = extra.select(F.when(parts[0] != "", parts[0]).cast("bigint").alias("_id"), F.struct(parts[1].cast("int").alias("r"), parts[2].cast("int").alias("e")).alias("to"))
    extra = extra.groupBy("_id").agg(F.collect_list("to").alias("_more"))  # at most one row for each range
    met = placed.join(F.broadcast(extra), F.col("doc_id").eqNullSafe(F.col("_id")), "left")
    own = F.array(F.struct(F.col("_range").alias("r"), F.lit(0).alias("e")))
    return met.withColumn("_to", F.explode(F.concat(own, F.coalesce("_more", F.slice(own, 1, 0))))).select("doc_id", "text", F.col("_to.r").alias("_range"), F.col("_to.e").alias("_extra"))


def fingerprint_neighbours(docs: DataFrame) -> DataFrame:
    """For each row of (doc_id, text): n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    Rows stand by doc_id (null first), then text; the edited text takes the next
    row's first code points for its last quarter, and the first row follows the
    last. A null text counts as empty; a single row is its own next one. Repeated
    rows stay. Ranges of ids, cut at percentiles, are windows of their own: no
    window spans all rows.
    """
    spans = Window.partitionBy("_range").orderBy("_extra", F.col("doc_id").asc_nulls_first(), "text")
    a = _ranged(docs.select("doc_id", whole(F.col("text")).alias("text"))).withColumn("_next", F.lead("text").over(spans))
    n = F.char_length("text")
    cut = F.floor(n / 4).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - cut), F.substring(F.coalesce("_next", F.lit("")), F.lit(1), cut))
    a = a.select("doc_id", "text", "_range", "_extra", n.cast("bigint").alias("n_chars"), edited.alias("_edited"))
    a = with_bins(with_bins(a, "text", "_own"), "_edited", "_other")
    a = a.withColumn("_after", F.lead("_own").over(spans))
    return a.where(F.col("_extra") == 0).select(
        "doc_id",
        "n_chars",
        F.sha2("_edited", 256).alias("edited_sha256"),
        packed(F.col("_own")).alias("fingerprint"),
        packed(F.col("_other")).alias("edited_fingerprint"),
        likeness(F.col("_own"), F.col("_other")).alias("near_edited"),
        likeness(F.col("_own"), F.col("_after")).alias("near_next"),
    )


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document beside its edited text and the next document: see fingerprint_neighbours(). An empty table gives none."""
    return fingerprint_neighbours(table(spark, sf_dir, "documents").select("doc_id", "text"))
