"""Structured Streaming forms of the continuous operators. Every query ends by itself (``availableNow``) and resumes from its checkpoint."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.jobs import TERMINAL
from ..session import cut_lineage


def file_stream(spark: SparkSession, folder: str, schema, pattern: str = "*.parquet", files_per_batch: int = 1000) -> DataFrame:
    return spark.readStream.schema(schema).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def checkpointed_loop(stream: DataFrame, checkpoint: str, handle: Callable[[DataFrame, int], None]) -> None:
    """Feeds what is new since the last run to ``handle`` in micro-batches; progress is committed only after a batch succeeds."""
    query = stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(handle).start()
    query.awaitTermination()
    if query.exception():
        raise RuntimeError(str(query.exception()))


def run_to_parquet(stream: DataFrame, checkpoint: str, out: str, mode: str = "append") -> None:
    query = stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", checkpoint).option("path", out).trigger(availableNow=True).start()
    query.awaitTermination()


def run_in_folder(stream: DataFrame, folder: str) -> DataFrame:
    """What a stream gives until its end, as a table: run in a new folder below ``folder``, which is removed; the result is checkpointed."""
    spark = stream.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder.rstrip('/')}/stream-{uuid.uuid4().hex}")
    base = path.toString()
    try:
        run_to_parquet(stream, f"{base}/checkpoint", f"{base}/out")
        return cut_lineage(spark.read.parquet(f"{base}/out"))
    finally:
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def dedup_within(stream: DataFrame, key: str, ts: str, delay: str = "1 hour") -> DataFrame:
    """The first row of every key within the watermark; state older than ``delay`` is dropped."""
    return stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay).dropDuplicatesWithinWatermark([key])


def windowed_counts(stream: DataFrame, ts: str, by: str, value: str, width: str = "1 day", delay: str = "1 hour") -> DataFrame:
    """Engine extension: tumbling windows with count and sum per group; works on batch tables too."""
    timed = stream.withColumn("_ts", F.col(ts).cast("timestamp"))
    timed = timed.withWatermark("_ts", delay) if stream.isStreaming else timed
    out = timed.groupBy(F.window("_ts", width), by).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return out.select(F.col("window.start").alias("window_start"), by, "n", "total")


def sessions(df: DataFrame, ts: str, by: str, gap: str = "30 minutes") -> DataFrame:
    """Engine extension: sessions per key, closed after ``gap`` without a row."""
    timed = df.withColumn("_ts", F.col(ts).cast("timestamp"))
    timed = timed.withWatermark("_ts", gap) if df.isStreaming else timed
    out = timed.groupBy(F.session_window("_ts", gap), by).agg(F.count("*").alias("n"))
    return out.select(by, F.col("session_window.start").alias("session_start"), F.col("session_window.end").alias("session_end"), "n")


def job_states(stream: DataFrame, job: str, ts: str, status: str) -> DataFrame:
    """State machine per job over a stream of events: emits ``job, status, n_events`` whenever it changes; terminal states stay."""

    def step(key: tuple, batches, state: GroupState):
        current, n = state.get if state.exists else (None, 0)
        for frame in batches:
            for value in frame.sort_values(ts)[status]:
                n += 1
                if current is None or current.lower() not in TERMINAL:
                    current = value
        state.update((current, n))
        yield pd.DataFrame({job: [key[0]], "status": [current], "n_events": [n]})

    kind = dict(stream.dtypes)[job]
    return stream.groupBy(job).applyInPandasWithState(step, f"{job} {kind}, status string, n_events long", "status string, n long", "update", GroupStateTimeout.NoTimeout)


# What Spark says of a missing and of a corrupt dataset.
_ABSENT = ("PATH_NOT_FOUND", "does not exist", "is not a Parquet file", "CANNOT_READ_FILE_FOOTER", "FAILED_READ_FILE.CANNOT_READ")


class Checkpoint:
    """Show, set and reset the one-row checkpoint table of a batch loop; ids are text."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def show(self) -> str | None:
        """The last processed id; None for a missing or corrupt checkpoint. A store that fails is an error, as a loop must not begin anew because of it."""
        try:
            row = self.spark.read.schema("id string, updated_at timestamp").parquet(self.path).orderBy(F.desc("updated_at")).first()
        except Exception as e:
            if any(sign in str(e) for sign in _ABSENT):
                return None
            raise
        return row.id if row else None

    def set(self, last_id: str) -> None:
        self.spark.range(1).select(F.lit(str(last_id)).alias("id"), F.current_timestamp().alias("updated_at")).write.mode("overwrite").parquet(self.path)

    def reset(self) -> None:
        self.spark.createDataFrame([], "id string, updated_at timestamp").write.mode("overwrite").parquet(self.path)
