"""Wall time, CPU time and memory of calls in the driver, one row per call, as a DataFrame and as a report."""

from __future__ import annotations

import functools
import json
import resource
import threading
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

SCHEMA = "func string, sec double, cpu double, ram long"


class Profiler:
    """Collects ``func, sec, cpu, ram`` (CPU seconds of the user, growth of the peak memory in MiB) of the calls of decorated functions, those that raise included."""

    def __init__(self) -> None:
        self.rows: list[tuple[str, float, float, int]] = []
        self._lock = threading.Lock()

    def profile(self, f: Callable) -> Callable:
        @functools.wraps(f)
        def wrapper(*args, **kwargs):
            before, begun = resource.getrusage(resource.RUSAGE_SELF), time.perf_counter()
            try:
                return f(*args, **kwargs)
            finally:
                seconds, after = time.perf_counter() - begun, resource.getrusage(resource.RUSAGE_SELF)
                row = (f.__qualname__, round(seconds, 4), round(after.ru_utime - before.ru_utime, 4), int(after.ru_maxrss - before.ru_maxrss) // 1024)
                with self._lock:
                    self.rows.append(row)

        return wrapper

    def frame(self, spark: SparkSession) -> DataFrame:
        """The rows so far; ``relational.profile`` rolls them up."""
        return spark.createDataFrame(list(self.rows), SCHEMA)

    def report(self) -> str:
        """The rows so far as a JSON list."""
        return json.dumps([dict(zip(("func", "sec", "cpu", "ram"), r, strict=True)) for r in self.rows], indent=2)
