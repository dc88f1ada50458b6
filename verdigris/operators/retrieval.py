"""Scoped hybrid retrieval: exact dense scores, BM25, rank fusion, weighted relevance, diversity."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import alnum_fingerprint, tokens
from ..shipping import ship

# Fixed values of the ranking model.
BM25_K1, BM25_B = 1.5, 0.75
FUSION_K = 60
WEIGHTS = {"dense": 0.35, "lexical": 0.25, "rerank": 0.35, "prior": 0.05}
COLLEGE_BONUS = 0.12
MMR_LAMBDA = 0.78
COVERAGE_SHARE, EXACT_SHARE = 0.65, 0.35
#: Scores are rounded, so that ranks don't hang on the order in which a sum is formed.
SCORE_PLACES = 11
#: Asked terms up to which they are broadcast, some 5 MB.
FEW_TERMS = 100_000
#: Asked terms up to which they are a filter of the scan.
PUSHED_TERMS = 2_000


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def normalised(v: Column) -> Column:
    """Unit length; a zero vector stays."""
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.transform(v, lambda x: x.cast("double") / F.when(norm == 0, 1.0).otherwise(norm))


#: Queries that meet the vectors as one row, and bytes of query vectors up to which these rows are broadcast.
QUERY_BLOCK = 256
BROADCAST_BYTES = 32 << 20
#: Scores that a task holds at once, 16 MB in each of a few arrays, whatever the number of queries.
TILE_SCORES = 2_000_000


def dense_scores(vectors: DataFrame, queries: DataFrame, id_col: str, vector: str = "embedding") -> DataFrame:
    """(query_id, id_col, score) of every vector for every query.

    queries (query_id, query_vector) is the stated query set. It meets the vectors in
    blocks, broadcast where its size allows that, else as partitions of its own.
    Scores are inner products in double precision, to SCORE_PLACES places.
    """
    size = queries.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.size("query_vector")), F.lit(0)).alias("values")).first()
    block = F.pmod(F.xxhash64("query_id"), F.lit(max(1, -(-size["n"] // QUERY_BLOCK))))
    asked = queries.groupBy(block.alias("_block")).agg(F.collect_list(F.struct("query_id", "query_vector")).alias("_asked")).select("_asked")
    met = vectors.crossJoin(F.broadcast(asked) if 8 * size["values"] <= BROADCAST_BYTES else asked).select(id_col, vector, F.explode("_asked").alias("_q"))
    return met.select(F.col("_q.query_id").alias("query_id"), id_col, F.round(dot(F.col(vector), F.col("_q.query_vector")), SCORE_PLACES).alias("score"))


def dense_top_k(vectors: DataFrame, queries: DataFrame, id_col: str, k: int, vector: str = "embedding") -> DataFrame:
    """(query_id, id_col, score, rank) of the k best of each query, as top_k of dense_scores.

    Where the query vectors fit a broadcast, each batch of vectors meets them in one
    matrix product for each tile of queries, and only its k best of each query leave the task. Rows without a
    vector have no score; all vectors must have the queries' length.
    """
    size = queries.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.size("query_vector")), F.lit(0)).alias("values")).first()
    if 8 * size["values"] > BROADCAST_BYTES or not size["n"]:
        return top_k(dense_scores(vectors, queries, id_col, vector), k, id_col)
    ship(vectors.sparkSession)
    asked = queries.orderBy("query_id").collect()  # at most BROADCAST_BYTES
    matrix = np.array([r["query_vector"] for r in asked], np.float64).T
    ids = [r["query_id"] for r in asked]
    shape = T.StructType([queries.schema["query_id"], vectors.schema[id_col], T.StructField("score", T.DoubleType())])

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked_ids = pa.array(ids)
        for batch in batches:
            if not batch.num_rows:
                continue
            values, own = batch.column(1), batch.column(0)
            if pa.compute.any(pa.compute.not_equal(pa.compute.list_value_length(values), matrix.shape[0])).as_py():
                raise ValueError(f"vectors must have the queries' {matrix.shape[0]} values")
            # by id first: of equal scores the least id stays
            order = pa.compute.sort_indices(own).to_numpy()
            data = values.flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)[order]
            own, most = own.take(pa.array(order)), min(k, batch.num_rows)
            step = max(1, TILE_SCORES // batch.num_rows)
            for start in range(0, len(ids), step):
                scores = np.round(matrix.T[start : start + step] @ data.T, SCORE_PLACES)
                # rows of the k-th score or better, then of these the first k
                least = np.partition(scores, batch.num_rows - most, axis=1)[:, batch.num_rows - most, None]
                query, row = np.nonzero(scores >= least)
                found = scores[query, row]
                ranked = np.lexsort((row, -found, query))
                query, row, found = query[ranked], row[ranked], found[ranked]
                kept = np.arange(len(query)) - np.searchsorted(query, query) < most
                yield pa.RecordBatch.from_arrays([asked_ids.take(pa.array(query[kept] + start)), own.take(pa.array(row[kept])), pa.array(found[kept])], ["query_id", id_col, "score"])

    some = vectors.where(F.col(vector).isNotNull()).select(id_col, F.col(vector).cast("array<double>").alias("_v"))
    return top_k(some.mapInArrow(best, shape), k, id_col)


def dense_of(pairs: DataFrame, vectors: DataFrame, queries: DataFrame, id_col: str, vector: str = "embedding") -> DataFrame:
    """pairs (query_id, id_col, ...) with score, for chosen pairs alone."""
    met = pairs.join(vectors.select(id_col, F.col(vector).alias("_v")), id_col).join(queries.select("query_id", "query_vector"), "query_id")
    return met.select(*pairs.columns, F.round(dot(F.col("_v"), F.col("query_vector")), SCORE_PLACES).alias("score"))


def top_k(scores: DataFrame, k: int, id_col: str, score: str = "score") -> DataFrame:
    """The k best of each query, ties by id. Spark prunes to k in each task before the shuffle."""
    ranked = scores.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(score), id_col)))
    return ranked.where(F.col("rank") <= k)


def term_counts(docs: DataFrame, id_col: str, text: str, terms: DataFrame | None = None) -> DataFrame:
    """(id_col, term, tf, length) in one pass over the texts; of the given terms (term) alone, which join before any shuffle where they are few."""
    listed = docs.select(id_col, tokens(F.col(text)).alias("_tokens")).withColumn("length", F.size("_tokens"))
    listed = listed.select(id_col, "length", F.explode("_tokens").alias("term"))
    if terms is not None:
        few = terms.limit(FEW_TERMS + 1).count() <= FEW_TERMS
        listed = listed.join(F.broadcast(terms) if few else terms, "term", "left_semi")
    return listed.groupBy(id_col, "term").agg(F.count(F.lit(1)).alias("tf"), F.first("length").alias("length"))


def row_counts(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    """(id_col, term, tf, length) of each row by itself: no shuffle, and no table of a task's pairs of row and term. length is the row's number of tokens."""
    ship(docs.sparkSession)
    shape = T.StructType([docs.schema[id_col], T.StructField("term", T.StringType()), T.StructField("tf", T.LongType()), T.StructField("length", T.IntegerType())])

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column(1).value_lengths()
            terms = batch.column(1).flatten().dictionary_encode()
            if not len(terms):
                continue
            row = np.repeat(np.arange(batch.num_rows), sizes.to_numpy())
            found, tf = np.unique(row * len(terms.dictionary) + terms.indices.to_numpy(), return_counts=True)
            at = pa.array(found // len(terms.dictionary))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), terms.dictionary.take(pa.array(found % len(terms.dictionary))), pa.array(tf), sizes.take(at)], shape.names)

    return docs.select(id_col, tokens(F.col(text)).alias("_t")).mapInArrow(counted, shape)


def document_counts(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    """row_counts, where rows of one id count as one document: only if there are such rows are the counts grouped."""
    counted = row_counts(docs, id_col, text)
    if not _repeats(docs, id_col):
        return counted
    return counted.groupBy(id_col, "term").agg(F.sum("tf").alias("tf"), F.max("length").alias("length"))


def document_frequencies(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    """(term, df): a row's distinct terms are summed by term at once, so that a task holds terms and no pairs."""
    each = docs.select(id_col, F.explode(F.array_distinct(tokens(F.col(text)))).alias("term"))
    return (each.distinct() if _repeats(docs, id_col) else each).groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def _repeats(docs: DataFrame, id_col: str) -> bool:
    return not docs.groupBy(id_col).count().where("count > 1").isEmpty()


def corpus_statistics(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    """One row: number of documents in scope and their mean length; documents without tokens count."""
    return docs.agg(F.count(F.lit(1)).alias("n_docs"), F.avg(F.size(tokens(F.col(text)))).alias("avg_length"))


def bm25_scores(docs: DataFrame, queries: DataFrame, id_col: str, text: str) -> DataFrame:
    """(query_id, id_col, score) with statistics of docs, which are the scope; zero scores don't appear.

    queries: (query_id, query_text). A term that a query repeats counts each time.
    Only postings of asked terms leave the scan.
    """
    asked = queries.select("query_id", F.explode(tokens(F.col("query_text"))).alias("term")).groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("times"))
    postings = term_counts(docs, id_col, text, asked.select("term").distinct())
    frequencies = postings.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    stats = corpus_statistics(docs, id_col, text)
    weighed = postings.join(frequencies, "term").join(F.broadcast(stats))  # one row
    idf = F.log(1.0 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    tf = F.col("tf").cast("double")
    part = idf * tf * (BM25_K1 + 1) / (tf + BM25_K1 * (1 - BM25_B + BM25_B * F.col("length") / F.greatest(F.col("avg_length"), F.lit(1.0))))
    scored = weighed.select(id_col, "term", part.alias("part")).join(asked, "term")
    return scored.groupBy("query_id", id_col).agg(F.round(F.sum(F.col("part") * F.col("times")), SCORE_PLACES).alias("score"))


def postings(docs: DataFrame, id_col: str, text: str) -> dict[str, DataFrame]:
    """The lexical index of a scope: postings (term, id_col, tf, length), sorted by term so that a filter on terms skips most row groups, and lengths (id_col, length) of every document."""
    listed = docs.select(id_col, tokens(F.col(text)).alias("_tokens"))
    counted = document_counts(docs, id_col, text)
    return {"postings": counted.select("term", id_col, "tf", "length").repartitionByRange("term", id_col).sortWithinPartitions("term", id_col), "lengths": listed.select(id_col, F.size("_tokens").alias("length"))}


def bm25_of_index(index: dict[str, DataFrame], queries: DataFrame, id_col: str) -> DataFrame:
    """bm25_scores from a scope's index: only asked terms are read, and df comes from their own postings."""
    asked = queries.select("query_id", F.explode(tokens(F.col("query_text"))).alias("term")).groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("times"))
    terms = [r["term"] for r in asked.select("term").distinct().limit(FEW_TERMS + 1).collect()]
    few = len(terms) <= FEW_TERMS
    held = index["postings"]
    held = held.where(F.col("term").isin(terms)) if len(terms) <= PUSHED_TERMS else held.join(F.broadcast(asked.select("term").distinct()) if few else asked.select("term").distinct(), "term", "left_semi")
    df = held.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    stats = index["lengths"].agg(F.count(F.lit(1)).alias("n_docs"), F.avg("length").alias("avg_length"))
    known = df.join(asked, "term").join(F.broadcast(stats))  # one row
    met = held.join(F.broadcast(known) if few else known, "term")
    idf = F.log(1.0 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    tf = F.col("tf").cast("double")
    part = idf * tf * (BM25_K1 + 1) / (tf + BM25_K1 * (1 - BM25_B + BM25_B * F.col("length") / F.greatest(F.col("avg_length"), F.lit(1.0))))
    return met.groupBy("query_id", id_col).agg(F.round(F.sum(part * F.col("times")), SCORE_PLACES).alias("score"))


def fuse(lists: list[DataFrame], id_col: str, k: int = FUSION_K) -> DataFrame:
    """Reciprocal-rank fusion of ranked lists (query_id, id_col, rank)."""
    out = lists[0].select("query_id", id_col, "rank")
    for x in lists[1:]:
        out = out.unionByName(x.select("query_id", id_col, "rank"))
    return out.groupBy("query_id", id_col).agg(F.sum(1.0 / (k + F.col("rank"))).alias("fused"))


def hybrid(docs: DataFrame, vectors: DataFrame, queries: DataFrame, id_col: str, text: str, k: int, depth: int, index: dict[str, DataFrame] | None = None) -> DataFrame:
    """The k best of each query by fused rank, then dense score, then id; score is the dense one. index: the scope's postings, if they have been made."""
    dense = dense_top_k(vectors, queries, id_col, depth)
    scored = bm25_scores(docs, queries, id_col, text) if index is None else bm25_of_index(index, queries, id_col)
    lexical = top_k(scored.where("score > 0"), depth, id_col)
    fused = dense_of(fuse([dense, lexical], id_col), vectors, queries, id_col)
    order = Window.partitionBy("query_id").orderBy(F.desc("fused"), F.desc("score"), id_col)
    return fused.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)


def dedup_ranked(rows: DataFrame, text: str, by: list[str], seq: list[Column]) -> DataFrame:
    """The first of equal fingerprints in each list."""
    marked = rows.withColumn("_print", alnum_fingerprint(F.col(text)))
    ranked = marked.withColumn("_n", F.row_number().over(Window.partitionBy(*by, "_print").orderBy(*seq)))
    return ranked.where("_n = 1").drop("_n", "_print")


def relevance(rows: DataFrame, *, dense: str, lexical: str, rerank: str, place: str, own_college: Column | None = None) -> DataFrame:
    """The weighted relevance; dense scores from [-1, 1] to [0, 1], the prior is one over the place."""
    dense01 = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col(dense) + 1) / 2))
    total = WEIGHTS["dense"] * dense01 + WEIGHTS["lexical"] * F.col(lexical) + WEIGHTS["rerank"] * F.col(rerank) + WEIGHTS["prior"] / F.col(place)
    if own_college is not None:
        total = total + F.when(own_college, COLLEGE_BONUS).otherwise(0.0)
    return rows.withColumn("relevance", total)


def squash(rows: DataFrame, score: str, by: str) -> DataFrame:
    """Scores of a list as they are if all lie in [0, 1], else their logistic values (arguments within 30 of 0)."""
    fits = F.min(F.col(score).between(0, 1).cast("int")).over(Window.partitionBy(by)) == 1
    clipped = F.greatest(F.lit(-30.0), F.least(F.lit(30.0), F.col(score)))
    return rows.withColumn(score, F.when(fits, F.col(score)).otherwise(1 / (1 + F.exp(-clipped))))


def mmr_order(vectors: list[list[float]], weights: list[float], k: int, balance: float = MMR_LAMBDA) -> list[int]:
    """Greedy maximal marginal relevance; ties by relevance, then by place."""
    import numpy as np

    data = np.asarray(vectors, float)
    chosen: list[int] = []
    nearest = np.zeros(len(weights))
    left = list(range(len(weights)))
    while left and len(chosen) < k:
        best = max(left, key=lambda i: (balance * weights[i] - (1 - balance) * max(nearest[i], 0.0), weights[i], -i))
        chosen.append(best)
        left.remove(best)
        if len(data):
            near = data @ data[best]
            nearest = near if len(chosen) == 1 else np.maximum(nearest, near)
    return chosen


def mmr_select(rows: DataFrame, *, id_col: str, vector: str, weight: str, k: int, balance: float = MMR_LAMBDA, slot: str | None = None) -> DataFrame:
    """(query_id, id_col, place): a diverse choice for each query among its candidates, at most 50 rows a query.

    slot: a boolean column; if no chosen row has it but a candidate does, the best such takes the last place.
    """

    def run(group):
        group = group.sort_by([(weight, "descending"), (id_col, "ascending")])
        ids, weights = group.column(id_col).to_pylist(), group.column(weight).to_pylist()
        chosen = mmr_order(group.column(vector).to_pylist(), weights, k, balance)
        if slot and chosen:
            flags = group.column(slot).to_pylist()
            if not any(flags[i] for i in chosen) and any(flags):
                chosen[-1] = flags.index(True)
        return pa.table({"query_id": pa.array([group.column("query_id")[0].as_py()] * len(chosen), pa.int64()), id_col: pa.array([ids[i] for i in chosen], pa.int64()), "place": pa.array(range(1, len(chosen) + 1), pa.int64())})


    ship(rows.sparkSession)
    cols = ["query_id", id_col, vector, weight, *([slot] if slot else [])]
    return rows.select(*cols).groupBy("query_id").applyInArrow(run, f"query_id bigint, {id_col} bigint, place bigint")


def hashed_features(texts: DataFrame, text: str, dimension: int, out: str = "embedding") -> DataFrame:
    """A deterministic encoder: token counts by hash, unit length. Hashing needs blake2b, so it runs in Arrow batches."""
    import hashlib
    import math
    import re

    names = texts.columns

    def features(value: str) -> list[str]:
        low = (value or "").lower()
        runs = re.findall(r"[一-鿿]+", low)
        return re.findall(r"[a-z]+\d*|\d+(?:\.\d+)?%?", low) + [r[i : i + n] for r in runs for n in (1, 2) for i in range(len(r) - n + 1)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for value in batch.column(text).to_pylist():
                v = [0.0] * dimension
                for f in features(value):
                    v[int.from_bytes(hashlib.blake2b(f.encode(), digest_size=8).digest(), "little") % dimension] += 1
                norm = math.sqrt(sum(x * x for x in v)) or 1.0
                rows.append([x / norm for x in v])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rows, pa.list_(pa.float64()))], [*names, out])


    ship(texts.sparkSession)
    return texts.mapInArrow(run, type(texts.schema)([*texts.schema.fields]).add(out, T.ArrayType(T.DoubleType())))
