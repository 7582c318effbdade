"""The service surface as functions: searches, point lookup, ingestion and job status over DataFrames.

Encoders are passed in (functions from a list of inputs to an array of vectors); none is part of the library.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .operators import jobs, migrate, search
from .sources import frames

# Collections that may be read, limits of a request, the default number of hits, jobs that run at a time.
COLLECTIONS = ("user_images", "user_videos", "watched_frames")
MOST_FILES, MOST_ITEMS, DEFAULT_LIMIT, PARALLEL_JOBS = 50, 1000, 5, 2

Encoder = Callable[[list], np.ndarray]


def search_text(corpus: DataFrame, prompt: str, encoder: Encoder, k: int = DEFAULT_LIMIT, where: Column | None = None) -> DataFrame:
    """Points nearest to a text; a blank prompt is an error."""
    if not (prompt or "").strip():
        raise ValueError("blank prompt")
    return search_vector(corpus, list(map(float, encoder([prompt])[0])), k, where)


def search_vector(corpus: DataFrame, vector: list[float], k: int = DEFAULT_LIMIT, where: Column | None = None) -> DataFrame:
    """Points nearest to a vector (that of an image, say)."""
    return search.knn(corpus, vector, k, where=where)


def search_by_image(corpus: DataFrame, library: DataFrame, image_id, owner, k: int = DEFAULT_LIMIT) -> DataFrame:
    """Points nearest to a stored image of a user; others' images are not found."""
    return search.search_by_stored(corpus, library, image_id, owner, k)


def search_by_video(corpus: DataFrame, library: DataFrame, video, owner, k: int = DEFAULT_LIMIT, grouped: bool = False, top: int | None = None) -> DataFrame:
    """Hits of all frames of a user's stored video: flat, best first, or grouped by the video they hit.

    ``library`` and ``corpus``: ``id, vector, video``, ``library`` also ``owner``. A video without frames gives no rows.
    """
    queries = library.where((F.col("video") == video) & F.col("owner").eqNullSafe(F.lit(owner)))
    hits = search.hits_with_video(search.knn_join(queries, corpus, k), corpus, F.col("video"))
    if grouped:
        return search.hits_by_video(hits) if top is None else search.hits_by_video(hits).limit(top)
    return hits.orderBy(F.desc("score"), "id", "query_id")


def search_video_to_video(corpus: DataFrame, library: DataFrame, video, owner, k: int = 10, top: int | None = None) -> DataFrame:
    """``video_id, score``: videos by their best hit."""
    return search.best_hit_per_video(search_by_video(corpus, library, video, owner, k), top)


def get_embedding(collections: dict[str, DataFrame], collection: str, point_id) -> DataFrame:
    """A point with vector and payload by collection and id; unknown collections and blank ids are errors."""
    if collection not in COLLECTIONS or collection not in collections:
        raise ValueError(f"unknown collection {collection!r}")
    return search.get_points(collections[collection], [point_id])


def ingest_frames(listing: DataFrame, make_encoder: Callable[[], Encoder], created_at: Column, dim: int | None = None) -> DataFrame:
    """Points of the frames in ``listing`` (``code, name, position, content``): payload, deterministic id and vector.

    Frames without readable content keep a null vector; with ``dim`` a vector of another length fails the job.
    """
    points = frames.encode(migrate.frame_points(listing, created_at, keep=("content",)), "content", make_encoder).drop("content")  # vector and payload in the same row
    if dim is not None:
        from .functions.vector import guarded

        points = points.withColumn("vector", F.when(F.col("vector").isNotNull(), guarded(F.col("vector"), dim)))
    return points


def ingest_images(uploads: DataFrame, make_encoder: Callable[[], Encoder], user_id: str) -> DataFrame:
    """``id, user_id, filename, size_bytes, ok, vector`` of uploaded images (``filename, content_type, content``).

    Files of another type or without content are marked as failed and have no vector; more than MOST_FILES are an error.
    """
    if uploads.limit(MOST_FILES + 1).count() > MOST_FILES:
        raise ValueError(f"more than {MOST_FILES} files")
    size = F.coalesce(F.length("content"), F.lit(0))
    checked = uploads.select(
        F.concat_ws("_", F.lit(user_id), "filename").alias("name"), "filename", size.cast("long").alias("size_bytes"),
        jobs.valid_upload(F.col("content_type"), size, "image").alias("ok"), F.when(jobs.valid_upload(F.col("content_type"), size, "image"), F.col("content")).alias("content"),
    )
    from .functions.hashing import uuid5

    encoded = frames.encode(checked, "content", make_encoder)
    return encoded.select(uuid5("url", F.col("name")).alias("id"), F.lit(user_id).alias("user_id"), "filename", "size_bytes", "ok", "vector")


def upload_summary(ingested: DataFrame) -> DataFrame:
    """``total, successful, failed``: the file names by outcome, in order."""
    from .operators.relational import outcome_lists

    return outcome_lists(ingested, F.col("ok"), F.col("filename"), F.col("filename"))


def process_codes(codes: DataFrame, processed: DataFrame) -> DataFrame:
    """``code, ok`` of every requested code: true if it has frames and all of them succeeded (``processed``: ``code, ok``)."""
    per = processed.groupBy("code").agg(F.bool_and(F.coalesce("ok", F.lit(False))).alias("_ok"))
    return codes.select("code").where("code IS NOT NULL").distinct().join(per, "code", "left").select("code", F.coalesce("_ok", F.lit(False)).alias("ok"))


def job_status(events: DataFrame, tail: int = 100) -> DataFrame:
    """Status per job with its log's last lines; ``events``: ``job_id, ts, status, log``."""
    state = jobs.latest_state(events, "job_id", "ts", "status")
    lines = events.where("log IS NOT NULL").select("job_id", "ts", "log")
    w = Window.partitionBy("job_id").orderBy(F.desc("ts"), F.desc("log"))
    last = lines.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= tail)  # a limit per group, so no more than the tail is collected
    logs = last.groupBy("job_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ts", "log"))), lambda x: x["log"]).alias("log_tail"))
    return state.join(logs, "job_id", "left").withColumn("log_tail", F.coalesce("log_tail", F.array().cast("array<string>")))


def jobs_list(events: DataFrame, status: str | None = None, limit: int = 100) -> DataFrame:
    """The newest jobs, of one status (any case) if it is given: ``job_id, status, created_at, updated_at, n_events, terminal``."""
    state = jobs.latest_state(events, "job_id", "ts", "status")
    mine = state if status is None else state.where(F.lower("status") == status.lower())
    return mine.orderBy(F.desc("updated_at"), "job_id").limit(limit)


def config() -> dict[str, int]:
    """The limits of the service."""
    return {"max_videos_per_request": MOST_ITEMS, "pipeline_max_parallel_jobs": PARALLEL_JOBS, "max_files_per_upload": MOST_FILES, "default_limit": DEFAULT_LIMIT}


def concurrency_stats(events: DataFrame, parallel: int | None = None) -> DataFrame:
    """One row ``max_parallel_jobs, queue_size, active_workers, workers_running, gpu_semaphore_available`` from the jobs' latest states."""
    most = F.lit(PARALLEL_JOBS if parallel is None else parallel)
    state = jobs.latest_state(events, "job_id", "ts", "status").select(F.lower("status").alias("status"))
    active = F.least(F.count_if(F.col("status") == "running"), most.cast("long"))
    return state.agg(
        most.alias("max_parallel_jobs"), F.count_if(F.col("status") == "pending").alias("queue_size"), active.alias("active_workers"), (active > 0).alias("workers_running"), (most - active).alias("gpu_semaphore_available")
    )
