"""Object-store listings and contents through Spark's binary file source; bytes are read only where a query asks for them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text


def listing(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """``key, path, modified, bytes`` of all files below ``root``; the content column is pruned. Keys are relative to the root."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)
    base = root.split(":", 1)[-1].rstrip("/")
    key = F.regexp_replace(F.element_at(F.split("path", base.replace(".", r"\.")), -1), "^/+", "")
    return files.select(key.alias("key"), "path", F.col("modificationTime").alias("modified"), F.col("length").alias("bytes"))


def contents(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """``path, content`` of all files below ``root``."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root).select("path", "content")


def frame_keys(keys: DataFrame, key: str = "key", own_platform: str = "own") -> DataFrame:
    """``key, platform, video_code, video_id, n, sec`` of the keys of frames; other keys are skipped. Keys of ``own_platform`` have four parts."""
    parsed = keys.where(F.endswith(F.col(key), F.lit(".png"))).select(key, text.parse_key(F.col(key), own_platform).alias("p")).where("p IS NOT NULL")
    return parsed.select(key, "p.*")


def video_keys(keys: DataFrame, key: str = "key") -> DataFrame:
    parsed = keys.select(key, text.video_key(F.col(key)).alias("p")).where("p IS NOT NULL")
    return parsed.select(key, "p.*")


def available(items: DataFrame, keys: DataFrame) -> DataFrame:
    """Items (``platform, code``) whose video is listed; those without platform or code are skipped. ``items`` keep their columns."""
    return items.where("platform IS NOT NULL AND code IS NOT NULL").join(video_keys(keys).select("platform", "code").distinct(), ["platform", "code"], "left_semi")


def downloads(items: DataFrame, stored: DataFrame) -> DataFrame:
    """Items with the content of ``stored`` (``platform, code, content``); missing videos stay with null content."""
    return items.join(stored, ["platform", "code"], "left")


def with_suffix(keys: DataFrame, *suffixes: str, key: str = "key") -> DataFrame:
    hit: Column = F.lit(False)
    for s in suffixes:
        hit = hit | F.endswith(F.lower(F.col(key)), F.lit(s.lower()))
    return keys.where(hit)


def frame_files(spark: SparkSession, root: str) -> DataFrame:
    """``code, name, position, content`` of the files ``<platform>/<code>/frames/<name>.png`` (or without ``frames``) below ``root``; the position follows the name as text."""
    from ..operators.relational import lexical_positions

    files = contents(spark, root, "*.png").withColumn("_p", F.split("path", "/"))
    folder = F.when(F.element_at("_p", -2) == "frames", F.element_at("_p", -3)).otherwise(F.element_at("_p", -2))
    named = files.select(folder.alias("code"), F.element_at("_p", -1).alias("name"), "content")
    return lexical_positions(named, "name", "code")
