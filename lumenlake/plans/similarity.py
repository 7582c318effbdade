"""Similarity-search queries. A point is a row of ``embeddings``, its video and its owner are the label; query sets are all rows with an id divisible by 50."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import hashing, vector
from ..operators import search
from ..session import table
from .registry import Registry

R = Registry()


def points(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")


def query_points(p: DataFrame) -> DataFrame:
    return p.where(F.col("id") % 50 == 0)


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumn("score", F.round("score", 6))


def _first_vector(p: DataFrame) -> list[float]:
    """The query vector of single searches: that of the smallest id, one row."""
    row = p.orderBy("id").select("vector").first()
    return [float(x) for x in row.vector] if row else [1.0]


_E = "e.embedding::DOUBLE[]"
_COS = "list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[])"
_DOT = "list_inner_product(q.embedding::DOUBLE[], e.embedding::DOUBLE[])"
_L2 = "list_distance(q.embedding::DOUBLE[], e.embedding::DOUBLE[])"


def _join_sql(score: str, k: int, direction: str = "DESC", extra: str = "") -> str:
    return f"""SELECT query_id, id, round(score, 6) AS score, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score {direction}, id) AS rank FROM (
    SELECT q.vec_id AS query_id, e.vec_id AS id, {score} AS score FROM embeddings q, embeddings e WHERE q.vec_id % 50 = 0 {extra})) WHERE rank <= {k}"""


def _single_sql(score: str, k: int, direction: str = "DESC", extra: str = "") -> str:
    return f"""SELECT e.vec_id AS id, e.label, round({score}, 6) AS score FROM embeddings e, (SELECT * FROM embeddings ORDER BY vec_id LIMIT 1) q
WHERE true {extra} ORDER BY {score} {direction}, e.vec_id LIMIT {k}"""


@R.query(_join_sql(_COS, 5))
def knn_join(spark, d):
    p = points(spark, d)
    return _rounded(search.knn_join(query_points(p), p, 5))


@R.query(_join_sql(_COS, 5, extra="AND q.vec_id <> e.vec_id"))
def knn_excluding_self(spark, d):
    p = points(spark, d)
    return _rounded(search.knn_join(query_points(p), p, 5, exclude_self=True))


@R.query(_join_sql(_DOT, 10))
def knn_dot(spark, d):
    p = points(spark, d)
    return _rounded(search.knn_join(query_points(p), p, 10, "dot"))


@R.query(_join_sql(_L2, 10, "ASC", "AND q.vec_id <> e.vec_id"))
def knn_euclid(spark, d):
    p = points(spark, d)
    return _rounded(search.knn_join(query_points(p), p, 10, "euclid", exclude_self=True))


@R.query(_join_sql("list_cosine_similarity((q.embedding::DOUBLE[])[1:32], (e.embedding::DOUBLE[])[1:32])", 5))
def knn_prefix32(spark, d):
    p = points(spark, d)
    return _rounded(search.knn_join(query_points(p), p, 5, prefix=32))


@R.query(_join_sql(_COS, 5, extra="AND e.label = 3"))
def knn_join_filtered(spark, d):
    p = points(spark, d)
    return _rounded(search.knn_join(query_points(p), p.where("label = 3"), 5))


@R.query(_single_sql(_COS, 5))
def knn_single(spark, d):
    p = points(spark, d)
    return _rounded(search.knn(p, _first_vector(p), 5))


@R.query(_single_sql(_COS, 5, extra="AND e.label = 3"))
def knn_filtered_label(spark, d):
    p = points(spark, d)
    return _rounded(search.knn(p, _first_vector(p), 5, where=F.col("label") == 3))


@R.query(_single_sql(_L2, 10, "ASC"))
def knn_single_euclid(spark, d):
    p = points(spark, d)
    return _rounded(search.knn(p, _first_vector(p), 10, "euclid"))


@R.query(
    """SELECT 'own' AS asked_by, query_id, id, round(score, 6) AS score, rank FROM (SELECT q.vec_id AS query_id, e.vec_id AS id, list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[]) AS score,
  row_number() OVER (ORDER BY list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[]) DESC, e.vec_id) AS rank
  FROM embeddings q, embeddings e WHERE q.vec_id = 7 AND q.label = (SELECT label FROM embeddings WHERE vec_id = 7)) WHERE rank <= 10"""
)
def search_by_stored_owner(spark, d):
    """Searches by a stored point of its owner, of another user, and by a point that does not exist: only the first finds anything."""
    p = points(spark, d)
    owner = p.where("id = 7").agg(F.max("label")).first()[0]
    asked = (("own", 7, owner), ("foreign", 7, owner + 1), ("missing", -1, owner))
    found = [search.search_by_stored(p, p, point, who, 10, owner_column="label").select(F.lit(name).alias("asked_by"), "*") for name, point, who in asked]
    return _rounded(found[0].unionByName(found[1]).unionByName(found[2]))


def _video_hits(spark, d):
    p = points(spark, d)
    hits = search.knn_join(query_points(p), p, 10)
    return search.hits_with_video(hits, p, F.col("label"))


_HITS = f"hits AS (SELECT h.*, coalesce(CAST(label AS VARCHAR), 'unknown') AS video_id FROM (SELECT query_id, id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM (SELECT q.vec_id AS query_id, e.vec_id AS id, {_COS} AS score FROM embeddings q, embeddings e WHERE q.vec_id % 50 = 0)) WHERE rank <= 10) h JOIN embeddings x ON x.vec_id = h.id)"


@R.query(f"WITH {_HITS} SELECT query_id, id, round(score, 6) AS score, rank, video_id FROM hits")
def search_by_video_flat(spark, d):
    """All hits of all query frames in one list, best first; a point may occur once per query frame."""
    return _rounded(_video_hits(spark, d).orderBy(F.desc("score"), "id", "query_id"))


@R.query(f"WITH {_HITS} SELECT video_id, round(greatest(0.0, max(score)), 6) AS score FROM hits GROUP BY video_id")
def best_hit_per_video(spark, d):
    return _rounded(search.best_hit_per_video(_video_hits(spark, d)))


@R.query(f"WITH {_HITS} SELECT video_id, count(*) AS total_frames, round(max(score), 6) AS best_score, array_to_string(list_sort(list_distinct(list(id))), ',') AS frames FROM hits GROUP BY video_id")
def search_by_video_grouped(spark, d):
    g = search.hits_by_video(_video_hits(spark, d))
    return g.select("video_id", "total_frames", F.round("best_score", 6).alias("best_score"), F.array_join(F.col("frame_results.frame").cast("array<string>"), ",").alias("frames"))


@R.query("SELECT vec_id AS id, label FROM embeddings WHERE label = 3")
def fetch_video_frames(spark, d):
    p = points(spark, d).withColumn("frame_number", F.col("id"))
    return search.video_frames(p, 3, 3, "label", "label").select("id", "label")


@R.query("SELECT vec_id AS id, label, len(embedding) AS dim FROM embeddings WHERE vec_id IN (1, 2, 77)")
def point_lookup(spark, d):
    return search.get_points(points(spark, d), [1, 2, 77]).select("id", "label", F.size("vector").alias("dim"))


@R.query("SELECT vec_id AS id, round(sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x))), 6) AS norm, round(embedding[1]::DOUBLE / sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x))), 6) AS first FROM embeddings")
def l2_normalised(spark, d):
    p = points(spark, d)
    return p.select("id", F.round(vector.norm(F.col("vector")), 6).alias("norm"), F.round(F.element_at(vector.normalised(F.col("vector")), 1), 6).alias("first"))


@R.query("SELECT vec_id AS id, len(embedding[1:32]) AS dim FROM embeddings")
def vector_guard_and_prefix(spark, d):
    p = points(spark, d)
    return p.select("id", F.size(vector.prefix(vector.guarded(F.col("vector"), 64), 32)).alias("dim"))


@R.query(
    """SELECT vec_id AS id, list_sum(list_transform(range(0, 49), lambda i: CASE WHEN embedding[(i // 7) * 8 + (i % 7) + 2] > embedding[(i // 7) * 8 + (i % 7) + 1] THEN 1::BIGINT << i::INT ELSE 0 END))::BIGINT AS dhash FROM embeddings"""
)
def dhash_bits(spark, d):
    return points(spark, d).select("id", hashing.dhash(F.col("vector"), 7).alias("dhash"))


_AVG = "list_sum(list_transform(range(0, 62), lambda i: CASE WHEN embedding[i + 1]::DOUBLE > list_sum(list_transform(embedding[1:62], lambda y: y::DOUBLE)) / 62 THEN 1::BIGINT << i::INT ELSE 0 END))::BIGINT"


@R.query(f"SELECT vec_id AS id, {_AVG} AS average_hash, bit_count(xor({_AVG}, 21845::BIGINT))::INT AS distance FROM embeddings")
def average_hash(spark, d):
    h = points(spark, d).select("id", hashing.average_hash(F.col("vector"), 62).alias("average_hash"))
    return h.select("id", "average_hash", hashing.hamming(F.col("average_hash"), F.lit(21845).cast("long")).alias("distance"))


@R.query(
    """SELECT a.vec_id AS id, round(list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda x: (x[1]::DOUBLE - x[2]::DOUBLE) * (x[1]::DOUBLE - x[2]::DOUBLE))) / len(a.embedding), 6) AS mse
FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1"""
)
def frame_mse(spark, d):
    p = points(spark, d)
    nxt = p.select((F.col("id") - 1).alias("id"), F.col("vector").alias("next_vector"))
    return p.join(nxt, "id").select("id", F.round(vector.mse(F.col("vector"), F.col("next_vector")), 6).alias("mse"))
