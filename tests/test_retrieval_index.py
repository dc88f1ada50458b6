from pyspark.sql import functions as F

from verdigris.operators import retrieval as R
from verdigris.plans import queries_answers as Q
from verdigris.sources import scope_views as V
from verdigris.sources.driver_tables import load
from verdigris.sources.snapshots import new_folder

from compare import SMALL


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_matrix_products_give_the_scores_of_the_columns(spark, monkeypatch):
    vectors = load(spark, SMALL, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding").repartition(5)
    extra = spark.createDataFrame([(None, [0.5] * 64), (10**6, None)], "doc_id long, embedding array<float>")
    vectors = vectors.unionByName(extra.withColumn("embedding", F.col("embedding").cast(vectors.schema["embedding"].dataType)))
    queries = vectors.where("doc_id % 7 = 0 and embedding is not null").select(F.col("doc_id").alias("query_id"), F.col("embedding").alias("query_vector"))
    known = vectors.where("doc_id is not null and embedding is not null")
    want = rows(R.top_k(R.dense_scores(known, queries, "doc_id"), 9, "doc_id"), "query_id", "rank", "doc_id", "score")
    assert rows(R.dense_top_k(known, queries, "doc_id", 9), "query_id", "rank", "doc_id", "score") == want
    assert R.dense_top_k(vectors, queries, "doc_id", 9).count() == len(want)
    pairs = R.dense_top_k(known, queries, "doc_id", 9).select("query_id", "doc_id")
    assert rows(R.dense_of(pairs, known, queries, "doc_id"), "query_id", "doc_id", "score") == sorted((q, d, s) for q, _, d, s in want)
    monkeypatch.setattr(R, "BROADCAST_BYTES", 0)
    assert rows(R.dense_top_k(known, queries, "doc_id", 9), "query_id", "rank", "doc_id", "score") == want
    assert R.dense_top_k(known, queries.limit(0), "doc_id", 9).count() == 0


def test_index_gives_the_scores_of_the_texts(spark, monkeypatch):
    docs = Q._scoped(spark, SMALL)
    questions = load(spark, SMALL, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query_text"))
    want = rows(R.bm25_scores(docs, questions, "doc_id", "text"), "query_id", "doc_id", "score")
    index = R.postings(docs, "doc_id", "text")
    close = lambda got: [g[:2] for g in got] == [w[:2] for w in want] and all(abs(g[2] - w[2]) < 1e-9 for g, w in zip(got, want, strict=True))
    assert close(rows(R.bm25_of_index(index, questions, "doc_id"), "query_id", "doc_id", "score"))
    monkeypatch.setattr(R, "PUSHED_TERMS", 0)
    assert close(rows(R.bm25_of_index(index, questions, "doc_id"), "query_id", "doc_id", "score"))
    monkeypatch.setattr(R, "FEW_TERMS", 0)
    assert close(rows(R.bm25_of_index(index, questions, "doc_id"), "query_id", "doc_id", "score"))


def test_views_are_made_once_for_a_scope_and_a_snapshot(spark, tmp_path):
    made = []

    def make():
        made.append(1)
        return {"rows": spark.read.parquet(f"{tmp_path}/t")}

    spark.range(3).write.parquet(f"{tmp_path}/t")
    views = V.ScopeViews(spark, new_folder(spark, "test-views"))
    first = V.snapshot_id(spark.read.parquet(f"{tmp_path}/t"))
    for _ in range(2):
        assert views.view({"a": 1}, first, make)["rows"].count() == 3
    assert len(made) == 1 and views.view({"a": 2}, first, make)["rows"].count() == 3 and len(made) == 2
    spark.range(5).write.mode("append").parquet(f"{tmp_path}/t")
    second = V.snapshot_id(spark.read.parquet(f"{tmp_path}/t"))
    assert second != first and views.view({"a": 1}, second, make)["rows"].count() == 8 and len(made) == 3


def test_scores_are_held_by_tiles(spark, monkeypatch):
    """A batch's scores of all queries at once took memory with the square of the input."""
    vectors = spark.range(60).select(F.col("id").alias("doc_id"), F.array((F.col("id") % 3).cast("double"), F.lit(1.0)).alias("embedding")).coalesce(1)
    queries = vectors.where("doc_id < 20").select(F.col("doc_id").alias("query_id"), F.col("embedding").alias("query_vector"))
    want = rows(R.top_k(R.dense_scores(vectors, queries, "doc_id"), 4, "doc_id"), "query_id", "rank", "doc_id", "score")
    for most in (1, 150, 10**6):
        monkeypatch.setattr(R, "TILE_SCORES", most)
        assert rows(R.dense_top_k(vectors, queries, "doc_id", 4), "query_id", "rank", "doc_id", "score") == want


def test_evaluation_forms_no_pairs(spark):
    from verdigris.operators import evaluate as E

    for name in ("eval_recall_at_k", "eval_pollution", "evidence_gate"):
        plan = Q.QUERIES[name](spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
        assert "Join Cross" not in plan and "MapInArrow" in plan, name
    labels = spark.createDataFrame([(1, 7), (2, 7), (3, 8), (4, None)], "doc_id long, label int")
    found = spark.createDataFrame([(1, 2, 1), (1, 3, 2), (3, 1, 1), (3, 3, 9), (4, 1, 1), (4, 4, 2)], "query_id long, doc_id long, rank int")
    asked = labels.where("doc_id <> 2").withColumnRenamed("doc_id", "query_id")
    gold = asked.join(labels, "label").select("query_id", "doc_id")
    assert E.recall_of_labels(found, labels, asked, 5).collect() == E.recall_at(found, gold, 5).collect()


def test_terms_are_counted_within_a_row(spark):
    """Before, a task's pairs of document and term were one hash table, and candidates met shuffled texts."""
    docs = spark.createDataFrame([(1, "b a b 7"), (2, ""), (3, None), (4, "a")], "doc_id long, text string")
    want = [(1, "7", 1, 4), (1, "a", 1, 4), (1, "b", 2, 4), (4, "a", 1, 1)]
    got = R.document_counts(docs, "doc_id", "text")
    assert rows(got, "doc_id", "term", "tf", "length") == want == rows(R.term_counts(docs, "doc_id", "text"), "doc_id", "term", "tf", "length")
    assert "Aggregate" not in got._jdf.queryExecution().optimizedPlan().toString()
    twice = docs.unionByName(spark.createDataFrame([(4, "a b")], docs.schema))
    assert rows(R.document_counts(twice, "doc_id", "text"), "doc_id", "term", "tf") == [w[:3] for w in want[:3]] + [(4, "a", 2), (4, "b", 1)]
    plan = Q.QUERIES["relevance_rerank"](spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
    assert "documents" not in plan and "Join" not in plan
