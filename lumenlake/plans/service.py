"""Queries of the service's counts, pages, logs and job lists, and of pixel and sample checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import api
from ..functions import hashing, text
from ..operators import jobs, migrate, quality, relational, search
from ..session import table
from ..sources import collections
from .registry import Registry
from .scalars import old_points
from .similarity import _COS, points, query_points

R = Registry()


@R.query(
    """SELECT count(*) AS read, count(*) FILTER (n IS NOT NULL) AS upserted, count(*) FILTER (n IS NULL) AS skipped
FROM (SELECT CASE WHEN event_id % 7 > 0 THEN event_id % 7 WHEN event_id % 2 = 1 THEN user_id END AS n FROM events)"""
)
def migration_counts(spark, d):
    return migrate.migration_counts(old_points(spark, d), F.lit("2024-01-01"))


@R.query("SELECT count(*) FILTER (caption <> '' AND frames IS NOT NULL) AS kept, count(*) - count(*) FILTER (caption <> '' AND frames IS NOT NULL) AS skipped FROM insta_content")
def required_counts(spark, d):
    return relational.required_counts(table(spark, d, "insta_content"), "caption", "frames")


_FRAMES = f"""hits AS (SELECT h.*, coalesce(CAST(label AS VARCHAR), 'unknown') AS video_id FROM (SELECT query_id, id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM (SELECT q.vec_id AS query_id, e.vec_id AS id, {_COS} AS score FROM embeddings q, embeddings e WHERE q.vec_id % 50 = 0)) WHERE rank <= 10) h JOIN embeddings x ON x.vec_id = h.id),
per AS (SELECT video_id, id, max(score) AS score, count(*) AS n FROM hits GROUP BY 1, 2)"""


@R.query(f"WITH {_FRAMES} SELECT video_id, CAST(sum(n) OVER (PARTITION BY video_id) AS BIGINT) AS total_frames, id AS frame, round(score, 6) AS score FROM per")
def search_by_video_frames(spark, d):
    """Hits grouped by the video they hit, with the score of every frame, one row per frame."""
    p = points(spark, d)
    grouped = search.hits_by_video(search.hits_with_video(search.knn_join(query_points(p), p, 10), p, F.col("label")))
    frames = grouped.select("video_id", "total_frames", F.explode("frame_results").alias("f"))
    return frames.select("video_id", "total_frames", F.col("f.frame").alias("frame"), F.round("f.score", 6).alias("score"))


@R.query("SELECT vec_id AS id, label, round(embedding[1]::DOUBLE, 6) AS first FROM embeddings WHERE vec_id > 100 ORDER BY vec_id LIMIT 256")
def scroll_page(spark, d):
    page = search.scroll(points(spark, d), 100)
    return page.select("id", "label", F.round(F.element_at("vector", 1).cast("double"), 6).alias("first"))


@R.query("SELECT vec_id AS id, CAST(i AS INT) AS pos, CAST(1000 + i AS INT) AS frame, round(embedding[i + 1]::DOUBLE, 6) AS value FROM embeddings, range(0, 50) r(i)")
def zip_positions(spark, d):
    """Fifty frame numbers beside the 64 elements of each vector: the longer list is cut."""
    p = points(spark, d).withColumn("frame", F.sequence(F.lit(1000), F.lit(1049)))
    z = relational.zip_positions(p, "frame", "vector", "id")
    return z.select("id", "pos", "frame", F.round(F.col("vector").cast("double"), 6).alias("value"))


@R.query("SELECT o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY (o_orderkey % 12) || '_' || o_orderkey || '.png') - 1 AS INT) AS position FROM orders")
def lexical_positions(spark, d):
    o = table(spark, d, "orders").select("o_custkey", "o_orderkey", F.concat((F.col("o_orderkey") % 12), F.lit("_"), "o_orderkey", F.lit(".png")).alias("path"))
    return relational.lexical_positions(o, "path", "o_custkey").select("o_orderkey", "position")


@R.query("SELECT count(*) AS n, count(*) AS n_distinct, count(*) AS n_well_formed FROM events")
def random_ids(spark, d):
    ids = table(spark, d, "events").select(text.random_id().alias("u"))
    return ids.agg(F.count("*").alias("n"), F.count_distinct("u").alias("n_distinct"), F.count_if(F.col("u").rlike("^[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}$")).alias("n_well_formed"))


@R.query(
    """SELECT event_id, 'users/' || user_id || '/vid/' || event_id || '.mp4' AS key, 'https://media.s3.eu-west-1.amazonaws.com/users/' || user_id || '/vid/' || event_id || '.mp4' AS url FROM events"""
)
def object_keys(spark, d):
    key = text.object_key(F.col("user_id"), F.col("event_id"))
    return table(spark, d, "events").select("event_id", key.alias("key"), text.object_url(key, "media", "eu-west-1").alias("url"))


@R.query("SELECT event_id, least(30.0, 0.5 * 2.0 ** (event_id % 9)) AS wait FROM events")
def backoff_waits(spark, d):
    return table(spark, d, "events").select("event_id", jobs.backoff(F.col("event_id") % 9, 0.5, 2.0, 30.0).alias("wait"))


@R.query(
    """SELECT user_id, count(*) AS total_videos, count(*) FILTER (event_type <> 'error') AS success, coalesce(array_to_string(list(event_id ORDER BY ts) FILTER (event_type = 'error'), ','), '') AS errors,
  round((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6, 2) AS downloaded_in_secs FROM events GROUP BY 1"""
)
def download_seconds(spark, d):
    ev = table(spark, d, "events").withColumn("at", F.col("ts").cast("timestamp"))
    s = relational.download_summary(ev, F.col("event_type") != "error", F.col("event_id"), F.col("at"), F.col("at"), F.col("at"), "user_id")
    return s.withColumn("errors", F.array_join(F.col("errors").cast("array<string>"), ","))


_STATUS = "CASE event_type WHEN 'click' THEN 'PENDING' WHEN 'view' THEN 'RUNNING' WHEN 'error' THEN 'failed' ELSE 'completed' END"


def _job_events(spark, d):
    ev = table(spark, d, "events")
    return ev.select(F.col("user_id").alias("job_id"), F.col("ts").cast("timestamp").alias("ts"), F.expr(_STATUS).alias("status"), F.concat(F.lit("line "), "event_id").alias("log"))


_LATEST = f"latest AS (SELECT user_id AS job_id, arg_max({_STATUS}, ts) AS status, max(ts) AS updated_at, count(*) AS n_events FROM events GROUP BY 1)"


@R.query(
    f"""WITH {_LATEST}, c AS (SELECT count(*) FILTER (lower(status) = 'pending') AS q, least(2, count(*) FILTER (lower(status) = 'running')) AS a FROM latest)
SELECT 2 AS max_parallel_jobs, q AS queue_size, a AS active_workers, a > 0 AS workers_running, 2 - a AS gpu_semaphore_available FROM c"""
)
def concurrency_stats(spark, d):
    return api.concurrency_stats(_job_events(spark, d))


@R.query(f"WITH {_LATEST} SELECT job_id, status, n_events FROM latest WHERE lower(status) = 'running' ORDER BY updated_at DESC, job_id LIMIT 20")
def jobs_list(spark, d):
    return api.jobs_list(_job_events(spark, d), "running", 20).select("job_id", "status", "n_events")


@R.query("SELECT user_id AS job_id, array_to_string(list(line ORDER BY ts), ',') AS log_tail FROM (SELECT user_id, ts, 'line ' || event_id AS line, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC) AS r FROM events) WHERE r <= 3 GROUP BY 1")
def job_log_tail(spark, d):
    return api.job_status(_job_events(spark, d), 3).select("job_id", F.array_join("log_tail", ",").alias("log_tail"))


@R.query("""SELECT '{"time":"' || strftime(ts, '%Y-%m-%dT%H:%M:%S') || '","level":"' || CASE WHEN event_type = 'error' THEN 'ERROR' ELSE 'INFO' END || '","module":"m' || (user_id % 5) || '","msg":"' || event_type || ' ' || event_id || '"}' AS value FROM events""")
def log_lines(spark, d):
    ev = table(spark, d, "events")
    return collections.log_lines(
        ev.select(F.col("ts").cast("timestamp").alias("ts"), F.when(F.col("event_type") == "error", "ERROR").otherwise("INFO").alias("level"), F.concat(F.lit("m"), F.col("user_id") % 5).alias("module"), F.concat_ws(" ", "event_type", "event_id").alias("msg"))
    )


@R.query("SELECT id, code, username, caption, video_url, is_extracted FROM insta_content")
def project_columns(spark, d):
    return table(spark, d, "insta_content").select("id", "code", "username", "caption", "video_url", "is_extracted")


@R.query("SELECT event_id, user_id AS owner FROM events WHERE event_id % 5 = 0 OR (event_id % 7 > 0 AND user_id = 3)")
def owned_points(spark, d):
    """Points that user 3 may use: one without payload passes, one whose payload names nobody or another does not."""
    owner = F.when((F.col("event_id") % 5 != 0) & (F.col("event_id") % 7 > 0), F.col("user_id"))
    p = table(spark, d, "events").select("event_id", "user_id", F.when(F.col("event_id") % 5 != 0, "{}").alias("payload"), owner.alias("o"))
    return search.owned(p, 3, "o", "payload").select("event_id", F.col("user_id").alias("owner"))


# Pixels and samples: the 64 elements of a vector stand for a frame of 8 x 8 grey pixels
_PIXELS = "list_transform(embedding, lambda x: CAST(floor((x::DOUBLE + 1) * 127) AS INT))"


def _frames(spark, d):
    return points(spark, d).select("id", F.transform("vector", lambda x: F.floor((x.cast("double") + 1) * 127).cast("int")).alias("pixels"))


@R.query(f"SELECT vec_id AS id, CAST(len(list_filter({_PIXELS}, lambda p: p < 120)) * 100 // 64 AS INT) AS dark FROM embeddings")
def dark_frames(spark, d):
    return _frames(spark, d).select("id", quality.dark_percent(F.col("pixels"), 120).alias("dark"))


@R.query(
    f"""SELECT id, CAST(min(i % 8) AS INT) AS x1, CAST(min(i // 8) AS INT) AS y1, CAST(max(i % 8) AS INT) AS x2, CAST(max(i // 8) AS INT) AS y2
FROM (SELECT vec_id AS id, i, ({_PIXELS})[i + 1] AS p FROM embeddings, range(0, 64) r(i)) WHERE p > 150 GROUP BY 1"""
)
def content_boxes(spark, d):
    return _frames(spark, d).select("id", quality.content_box(F.col("pixels"), 8, 150).alias("b")).where("b IS NOT NULL").select("id", "b.*")


_SAMPLES = "(SELECT user_id, CAST(floor(value * 37) % 32768 AS BIGINT) AS s FROM events)"


def _samples(spark, d):
    return table(spark, d, "events").select("user_id", F.expr("CAST(floor(value * 37) % 32768 AS BIGINT)").alias("s"))


def _db(power: str) -> str:
    return f"CASE WHEN {power} > 0 THEN 10 * log10({power} / (32768.0 * 32768.0)) ELSE -91.0 END"


@R.query(
    f"""SELECT user_id, n AS n_samples, round({_db('p')}, 6) AS mean_volume, round({_db('m * m')}, 6) AS max_volume
FROM (SELECT user_id, count(s) AS n, CAST(floor((sum(s * s) + count(s) // 2) / count(s)) AS DOUBLE) AS p, CAST(max(abs(s)) AS DOUBLE) AS m FROM {_SAMPLES} GROUP BY 1)"""
)
def volumes(spark, d):
    v = quality.volume(_samples(spark, d), "s", "user_id")
    return v.select("user_id", "n_samples", F.round("mean_volume", 6).alias("mean_volume"), F.round("max_volume", 6).alias("max_volume"))


@R.query(f"SELECT CAST(floor(-({_db('CAST(s * s AS DOUBLE)')})) AS INT) AS db, count(*) AS n FROM {_SAMPLES} GROUP BY 1")
def loudness_histogram(spark, d):
    return quality.loudness_histogram(_samples(spark, d), "s")


@R.query(
    f"""WITH f AS (SELECT vec_id AS id, list_transform({_PIXELS}, lambda p: p::DOUBLE) AS p FROM embeddings),
m AS (SELECT a.id, list_avg(a.p) AS ma, list_avg(b.p) AS mb, list_avg(list_transform(a.p, lambda x: x * x)) AS aa, list_avg(list_transform(b.p, lambda x: x * x)) AS bb, list_avg(list_transform(list_zip(a.p, b.p), lambda z: z[1] * z[2])) AS ab FROM f a JOIN f b ON b.id = a.id + 1)
SELECT id, round(((2 * ma * mb + 6.5025) * (2 * (ab - ma * mb) + 58.5225)) / ((ma * ma + mb * mb + 6.5025) * (aa - ma * ma + bb - mb * mb + 58.5225)), 6) AS ssim FROM m"""
)
def frame_ssim(spark, d):
    p = _frames(spark, d)
    following = p.select((F.col("id") - 1).alias("id"), F.col("pixels").alias("next"))
    return p.join(following, "id").select("id", F.round(quality.ssim(F.col("pixels"), F.col("next")), 6).alias("ssim"))


_AVERAGE = "list_sum(list_transform(range(0, 62), lambda i: CASE WHEN {0}[i + 1]::DOUBLE > list_sum(list_transform({0}[1:62], lambda y: y::DOUBLE)) / 62 THEN 1::BIGINT << i::INT ELSE 0 END))::BIGINT"


@R.query(f"SELECT a.vec_id AS id, bit_count(xor({_AVERAGE.format('a.embedding')}, {_AVERAGE.format('b.embedding')}))::INT AS distance FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def hash_compare(spark, d):
    """Hashes of neighbouring frames by one hasher, and their distance by the same."""
    hasher = hashing.Hasher(lambda grid: hashing.average_hash(grid, 62))
    p = points(spark, d).select("id", hasher.compute(F.col("vector")).alias("h"))
    following = p.select((F.col("id") - 1).alias("id"), F.col("h").alias("n"))
    return p.join(following, "id").select("id", hasher.compare(F.col("h"), F.col("n")).alias("distance"))
