"""Job bookkeeping: latest state, progress deltas, validation, retries."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from ..session import cut_lineage

# States that end a job.
TERMINAL = ("completed", "failed", "error", "cancelled")


def latest_state(events: DataFrame, job: str, ts: str, status: str) -> DataFrame:
    """Per job its latest status (ties by the larger status), first and last time, number of events and whether the state is terminal."""
    last = F.max_by(status, F.struct(ts, status))
    return events.groupBy(job).agg(last.alias("status"), F.min(ts).alias("created_at"), F.max(ts).alias("updated_at"), F.count("*").alias("n_events"), F.lower(last).isin(*TERMINAL).alias("terminal"))


def progress_deltas(lines: DataFrame, line_no: str, line: str, total: Column, *by: str) -> DataFrame:
    """Beacons of the log lines with their delta to the beacon before (0 at first) in whole percent of ``total``, cut off."""
    if not by:
        raise ValueError("name the columns of one log: a single order over the whole table would be one task")
    w = Window.partitionBy(*by).orderBy(line_no)
    beacons = lines.withColumn("done", text.beacon(F.col(line))).where("done IS NOT NULL")
    return beacons.withColumn("delta", F.col("done") - F.lag("done", 1, 0).over(w)).withColumn("percent", (F.lit(100) * F.col("delta") / total).cast("int"))


def progress_marks(df: DataFrame, order: str, *by: str) -> DataFrame:
    """The rows at which progress is logged: every fifth of a group of more than five, with ``completed`` and ``n``."""
    w = Window.partitionBy(*by)
    counted = df.withColumn("n", F.count("*").over(w)).withColumn("completed", F.row_number().over(w.orderBy(order)))
    return counted.where((F.col("n") > 5) & (F.pmod("completed", F.greatest(F.lit(1).cast("long"), F.floor(F.col("n") / 5))) == 0))


def valid_items(items: Column, most: int = 1000) -> Column:
    """Whether a request's items are present and at most ``most``."""
    return F.coalesce(F.size(items).between(1, most), F.lit(False))


def valid_text(prompt: Column) -> Column:
    return F.coalesce(F.trim(prompt) != "", F.lit(False))


def valid_upload(content_type: Column, size: Column, kind: str) -> Column:
    return F.coalesce(F.startswith(content_type, F.lit(f"{kind}/")) & (size > 0), F.lit(False))


def backoff(attempt: Column, base: float = 1.0, factor: float = 2.0, most: float = 60.0) -> Column:
    """Seconds to wait before retry number ``attempt`` (from 0): ``base`` times powers of ``factor``, at most ``most``."""
    return F.least(F.lit(most), F.lit(base) * F.pow(F.lit(factor), attempt))


def with_backoff(call: Callable, retries: int = 3, base: float = 1.0, factor: float = 2.0, most: float = 60.0, errors: tuple = (OSError,), sleep: Callable[[float], None] = time.sleep):
    """What ``call()`` returns; network errors are tried again after growing waits, the last one is raised."""
    for n in range(retries + 1):
        try:
            return call()
        except errors:
            if n == retries:
                raise
            sleep(min(most, base * factor**n))


def retry(items: DataFrame, attempt: Callable[[DataFrame, int], DataFrame], most: int = 3) -> DataFrame:
    """Runs ``attempt`` (items, number -> items with BOOLEAN ``ok``) on all items, then on those that failed, at most ``most`` times more.

    Result: the items with ``ok`` and ``attempts``. The number of rounds is bounded; each round's outcome is
    checkpointed, so later rounds do not run the earlier ones again.
    """
    columns, done, left = items.columns, None, items
    for n in range(most + 1):
        outcome = cut_lineage(attempt(left, n).withColumn("attempts", F.lit(n + 1)))
        ended = outcome if n == most else outcome.where(F.col("ok"))
        done = ended if done is None else done.unionByName(ended)
        if n == most or outcome.where(~F.coalesce(F.col("ok"), F.lit(False))).isEmpty():
            break
        left = outcome.where(~F.coalesce(F.col("ok"), F.lit(False))).select(*columns)
    return done
