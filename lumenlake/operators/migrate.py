"""Reshaping of payloads, logs and API rows between generations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..functions import hashing, text


def point_id(platform: Column, code: Column, n: Column, sec: Column) -> Column:
    """Deterministic id of a frame in the name space of domains; ``sec`` is written as Python writes a float."""
    return hashing.uuid5("dns", F.concat_ws(":", platform, code, n.cast("string"), text.float_text(sec)))


def migrate_payload(points: DataFrame, now: Column, dim: int | None = None, strict: bool = False) -> DataFrame:
    """Points of generation 1 in the payload of generation 2; points without number, second or path are skipped.

    Missing is what Python calls false: null, '' and 0 — so a ``frame_idx`` of 0 falls back to ``frame_number``.
    ``strict`` removes only known media extensions from codes; else the last dot cuts dotted codes.
    With ``dim`` a vector of another length fails the job. :func:`migration_counts` says how many points that were.
    """
    kept = _generation_2(points, now, dim, strict).where("kept").drop("kept")
    return kept.withColumn("id", point_id(F.col("platform"), F.col("video_code"), F.col("frame_number"), F.col("frame_second")))


def migration_counts(points: DataFrame, now: Column, dim: int | None = None, strict: bool = False) -> DataFrame:
    """One row ``read, upserted, skipped`` of :func:`migrate_payload`; zeros for an empty table."""
    kept = F.count_if("kept")
    return _generation_2(points, now, dim, strict).agg(F.count("*").alias("read"), kept.alias("upserted"), (F.count("*") - kept).alias("skipped"))


def observed_migration(points: DataFrame, now: Column, observation: Observation, dim: int | None = None, strict: bool = False) -> DataFrame:
    """:func:`migrate_payload` whose counts come as metrics of the job that writes its result, without a second pass."""
    shaped = _generation_2(points, now, dim, strict).observe(observation, F.count_if("kept").alias("upserted"), F.count_if(~F.col("kept")).alias("skipped"))
    return shaped.where("kept").drop("kept").withColumn("id", point_id(F.col("platform"), F.col("video_code"), F.col("frame_number"), F.col("frame_second")))


def _generation_2(points: DataFrame, now: Column, dim: int | None, strict: bool) -> DataFrame:
    platform = text.truthy(F.col("platform"), F.lit("instagram"))
    code = text.strip_extension(text.truthy(F.col("video"), F.col("video_code"), F.lit(""), zero=False), known_only=strict)
    number = text.truthy(F.col("frame_idx"), F.col("frame_number"))
    second = text.truthy(F.col("timestamp_s"), F.col("frame_second"))
    shaped = points.select(
        *([F.col("vector") if dim is None else _vector(dim)] if "vector" in points.columns else []),
        platform.alias("platform"), code.alias("video_code"), number.alias("frame_number"), second.alias("frame_second"), text.prefixed(F.col("path"), platform).alias("path"), now.alias("created_at"),
    )
    return shaped.withColumn("kept", F.col("frame_number").isNotNull() & F.col("frame_second").isNotNull() & F.col("path").isNotNull())


def _vector(dim: int) -> Column:
    from ..functions import vector

    return vector.guarded(F.col("vector"), dim).alias("vector")


def frame_points(frames: DataFrame, created_at: Column, platform: str = "instagram", keep: tuple[str, ...] = ()) -> DataFrame:
    """Points of frames given by ``code, name, position``: index and second from the name, or the position; the id is uuid5 of the natural key, which is kept, as are the columns ``keep``."""
    n, sec = text.frame_index(F.col("name"), F.col("position")), text.frame_second(F.col("name"), F.col("position"))
    shaped = frames.select(*keep, "code", "name", n.alias("frame_number"), sec.alias("frame_second"), F.concat_ws("/", F.lit(platform), "code", "name").alias("path"), created_at.alias("created_at"))
    key = F.concat_ws("_", "code", F.col("frame_number").cast("string"), text.float_text(F.col("frame_second")))
    return shaped.withColumn("uuid", hashing.uuid5("url", key)).withColumn("natural_key", F.concat_ws("_", "code", F.col("frame_number").cast("string")))


def migrate_logs(jobs: DataFrame, ts: Column, level: str = "INFO") -> DataFrame:
    """``log`` text as ``logs``, an array of one entry; none for rows without a log. The old column is dropped."""
    entry = F.struct(ts.cast("string").alias("ts"), F.lit(level).alias("level"), F.col("log").alias("msg"))
    return jobs.withColumn("logs", F.when(F.col("log").isNotNull(), F.array(entry)).otherwise(F.array().cast("array<struct<ts:string,level:string,msg:string>>"))).drop("log")


def view_model(rows: DataFrame) -> DataFrame:
    """Catalog rows for display: the code is the media id, counters default to 0, the monitoring team is a list."""
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return rows.select(
        "id", F.col("media_id").alias("code"), "username", F.coalesce("caption", F.lit("")).alias("caption"), zero("ig_play_count").alias("plays"), zero("reshare_count").alias("reshares"),
        F.lit(0).alias("n_alerts"), F.when(F.col("monitored_by").isNotNull(), F.array("monitored_by")).otherwise(F.array().cast("array<string>")).alias("monitored_by"),
    )


def search_results(hits: DataFrame, payload: str = "payload") -> DataFrame:
    """Hits with text ids and an empty map for a missing payload."""
    return hits.select(F.col("id").cast("string").alias("id"), "score", F.coalesce(F.col(payload), F.create_map().cast("map<string,string>")).alias(payload))
