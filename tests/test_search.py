"""JN-01..07, FLT-01/02/07/11/12/13, AGG-02/16, SRC-13, SRT-01, SET-05 (traps T-01, T-02, T-09..T-11)."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenlake.functions import vector
from lumenlake.operators import search


@pytest.fixture(scope="module")
def corpus(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.standard_normal(6).astype("float32")], f"v{i % 4}", f"o{i % 3}") for i in range(60)]
    rows += [(100, rows[7][1], "v3", "o1"), (101, None, "v1", "o1"), (102, [], "v1", "o1"), (103, [1.0, 2.0], "v1", "o1"), (104, [0.0] * 6, "v2", "o0")]
    return spark.createDataFrame(rows, "id long, vector array<float>, video string, owner string").withColumn("score", F.lit("clash"))


def brute(corpus, q, k, metric, skip=None):
    rows = [(r.id, np.array(r.vector, dtype="float64")) for r in corpus.collect() if r.vector is not None and len(r.vector) == len(q) and r.id != skip]
    out = []
    for i, v in rows:
        if metric == "cosine":
            if not np.linalg.norm(v):
                continue
            s = v @ q / np.linalg.norm(v) / np.linalg.norm(q)
        else:
            s = v @ q if metric == "dot" else -np.linalg.norm(v - q)
        out.append((-s, i))
    return [i for _, i in sorted((round(s, 12), i) for s, i in out)][:k]


@pytest.mark.parametrize("metric", ["cosine", "dot", "euclid"])
def test_knn_join_and_single(spark, corpus, metric):
    queries = corpus.where("id % 20 = 7 AND id < 60")
    got = {}
    for r in search.knn_join(queries, corpus, 5, metric, exclude_self=True).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.id)
    for q in queries.collect():
        v = np.array(q.vector, dtype="float64")
        assert got[q.id] == brute(corpus, v, 5, metric, q.id)
        assert [r.id for r in search.knn(corpus.drop("score"), list(v), 5, metric).collect()] == brute(corpus, v, 5, metric)


def test_self_hit_is_first_and_ties_go_to_the_smaller_id(corpus):
    got = search.knn_join(corpus.where("id IN (7, 100)"), corpus, 2).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.id, round(r.score, 6)) for r in got] == [(7, 7, 1.0), (7, 100, 1.0), (100, 7, 1.0), (100, 100, 1.0)]


def test_queries_in_blocks_and_empty_query_table(corpus, monkeypatch):
    whole = {tuple(r) for r in search.knn_join(corpus.where("id < 9"), corpus, 3).collect()}
    monkeypatch.setattr(search, "BLOCK_BYTES", 150)
    assert {tuple(r)[:2] for r in search.knn_join(corpus.where("id < 9"), corpus, 3).collect()} == {x[:2] for x in whole}
    assert search.knn_join(corpus.where("id < 0"), corpus, 3).count() == 0


def test_corpus_is_not_shuffled(corpus):
    plan = search.knn_join(corpus.where("id < 9"), corpus, 3)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_filter_applies_before_the_top(corpus):
    q = [1.0] * 6
    assert all(r.video == "v2" for r in search.knn(corpus.drop("score"), q, 5, where=F.col("video") == "v2").collect())


def test_stored_query_owner_rules(spark, corpus):
    assert search.search_by_stored(corpus, corpus, 7, "o1", 3).count() == 3
    assert search.search_by_stored(corpus, corpus, 7, "o2", 3).count() == 0
    assert search.search_by_stored(corpus, corpus, 101, "o1", 3).count() == 0
    p = spark.createDataFrame([(1, "u", {"a": "b"}), (2, None, {"a": "b"}), (3, None, None)], "id int, owner string, payload map<string,string>")
    assert [r.id for r in search.owned(p, "u", payload="payload").collect()] == [1, 3]


def test_point_lookup(corpus):
    assert [r.id for r in search.get_points(corpus, [5]).collect()] == [5]
    with pytest.raises(ValueError):
        search.get_points(corpus, [" "])


def test_video_hits(spark, corpus):
    hits = spark.createDataFrame([(1, 4, -0.5, 1), (1, 5, 0.25, 2), (2, 5, 0.75, 1), (2, 9, 0.1, 2)], "query_id long, id long, score double, rank int")
    named = search.hits_with_video(hits, corpus, F.when(F.col("id") != 9, F.col("video")))
    best = {r.video_id: r.score for r in search.best_hit_per_video(named).collect()}
    assert best == {"v0": 0.0, "v1": 0.75, "unknown": 0.1}  # clamped at 0.0
    grouped = [(r.video_id, r.total_frames, [f.frame for f in r.frame_results]) for r in search.hits_by_video(named).collect()]
    assert grouped == [("v1", 2, [5]), ("unknown", 1, [9]), ("v0", 1, [4])]


def test_vector_expressions(spark):
    df = spark.createDataFrame([([3.0, 4.0], [4.0, 3.0]), ([0.0, 0.0], [1.0, 1.0]), (None, [1.0, 1.0])], "a array<float>, b array<float>")
    got = [tuple(r) for r in df.select(vector.cosine(F.col("a"), F.col("b")), vector.norm(F.col("a")), vector.sad(F.col("a"), F.col("b"))).collect()]
    assert got[0] == (0.96, 5.0, 2.0) and got[1][0] is None and got[2][0] is None
    assert df.select(vector.normalised(F.col("a")).alias("n")).first().n == [0.6, 0.8]
    with pytest.raises(Exception, match="expected 3"):
        df.select(vector.guarded(F.col("a"), 3)).collect()
    with pytest.raises(ValueError):
        vector.metric("manhattan")
