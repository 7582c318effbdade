"""Vector collections: declarative configuration, idempotent creation, upserts, migration and reload as parquet datasets."""

from __future__ import annotations

import json
import warnings

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.vector import METRICS
from ..operators.relational import upsert_latest

# Names of payload index kinds and their types.
INDEX_TYPES = {"keyword": "string", "integer": "bigint", "float": "double", "geo": "struct<lat:double,lon:double>", "text": "string", "bool": "boolean", "datetime": "timestamp"}


def parse_config(text: str) -> dict:
    """Collection configuration; the name, size and distance are required, an unknown distance is an error, an unknown index kind is skipped with a warning."""
    config = json.loads(text)
    try:
        name, size, distance = config["collection_name"], int(config["vector_params"]["size"]), str(config["vector_params"]["distance"]).lower()
    except KeyError as e:
        raise ValueError(f"missing key {e}") from None
    if distance not in METRICS:
        raise ValueError(f"unknown distance {distance!r}")
    indexes = {}
    for index in config.get("payload_indexes", []):
        kind = str(index["field_schema"]).lower()
        if kind not in INDEX_TYPES:
            warnings.warn(f"unknown index kind {kind!r} skipped", stacklevel=2)
            continue
        indexes[index["field_name"]] = INDEX_TYPES[kind]
    return {"name": name, "size": size, "distance": distance, "indexes": indexes}


def create(spark: SparkSession, config: dict) -> bool:
    """Creates the collection's table unless it exists; says whether it did. Payload indexes become typed columns, which parquet statistics serve."""
    if spark.catalog.tableExists(config["name"]):
        return False
    columns = ", ".join(["id STRING", "vector ARRAY<FLOAT>", *(f"`{c}` {t}" for c, t in config["indexes"].items())])
    spark.sql(f"CREATE TABLE IF NOT EXISTS `{config['name']}` ({columns}) USING parquet TBLPROPERTIES ('dim' = '{config['size']}', 'distance' = '{config['distance']}')")
    return True


def checked(points: DataFrame, dim: int) -> DataFrame:
    """``points``, failing the job at a vector of another length."""
    from ..functions import vector

    return points.withColumn("vector", vector.guarded(F.col("vector"), dim))


def upsert(spark: SparkSession, path: str, points: DataFrame, version: str = "created_at") -> None:
    """Keeps the last version of every id; written beside the old data and swapped, as a dataset cannot be overwritten while it is read.

    The old data is renamed aside before the new takes its place, and deleted last: after a crash at any point the
    next call finds one of them whole. Run one upsert of a collection at a time.
    """
    fs, p = _fs(spark, path)
    old = f"{path.rstrip('/')}__old"
    if fs.exists(p(old)):  # a run ended between the renames
        if fs.exists(p(path)):
            fs.delete(p(old), True)
        else:
            fs.rename(p(old), p(path))
    exists = _exists(spark, path)
    merged = upsert_latest(spark.read.parquet(path), points, "id", version) if exists else upsert_latest(points, points.limit(0), "id", version)
    staged = f"{path.rstrip('/')}__staged"
    merged.write.mode("overwrite").parquet(staged)
    if exists:
        _rename(fs, p(path), p(old))
    _rename(fs, p(staged), p(path))
    if exists:
        fs.delete(p(old), True)


def truncate(spark: SparkSession, path: str) -> None:
    schema: T.StructType = spark.read.parquet(path).schema
    spark.createDataFrame([], schema).write.mode("overwrite").parquet(path)


def reload(points: DataFrame, path: str, sort: str = "id") -> None:
    """Drops and writes a dataset again, sorted within files so that statistics prune lookups."""
    points.sortWithinPartitions(sort).write.mode("overwrite").parquet(path)


def write_report(df: DataFrame, path: str) -> None:
    """CSV with the header ``platform,shortcode``."""
    df.select("platform", F.col("code").alias("shortcode")).write.mode("overwrite").option("header", "true").csv(path)


def write_job_input(items: DataFrame, path: str) -> None:
    """JSON lines of ``platform, code``."""
    items.select("platform", "code").write.mode("overwrite").json(path)


def write_log(lines: DataFrame, path: str) -> None:
    """JSON lines of ``time, level, module, msg``, see :func:`log_lines`."""
    log_lines(lines).write.mode("overwrite").text(path)


def log_lines(lines: DataFrame) -> DataFrame:
    """``value``: one JSON object per row of ``ts, level, module, msg``; the time in seconds, missing fields left out."""
    return lines.select(F.to_json(F.struct(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("time"), "level", "module", "msg")).alias("value"))


def write_performance(calls: DataFrame, path: str) -> None:
    """JSON lines of a profiler's rows."""
    calls.write.mode("overwrite").json(path)


def delete_keys(keys: DataFrame, gone: DataFrame, *on: str) -> DataFrame:
    """Keys that remain when those in ``gone`` are deleted."""
    return keys.join(gone.select(*on).distinct(), list(on), "left_anti")


def _rename(fs, source, target) -> None:
    if not fs.rename(source, target):
        raise OSError(f"{source.toString()} could not be renamed to {target.toString()}")


def _fs(spark: SparkSession, path: str):
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path
    return p(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def _exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return bool(fs.exists(p(path)))
