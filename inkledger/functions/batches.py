"""Arrow passes over tables in bounded portions, so that what a worker holds doesn't grow with its task."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession

#: Rows and megabytes of an Arrow batch between the JVM and a worker, and of a portion that a worker turns into Python objects at once.
BATCH_ROWS, BATCH_MB = 1000, 4
ROWS, MB = 250, 1
SETTINGS = {"spark.sql.execution.arrow.maxRecordsPerBatch": BATCH_ROWS, "spark.sql.execution.arrow.maxBytesPerBatch": BATCH_MB << 20}


def bounded(spark: SparkSession) -> None:
    """Arrow batches of bounded size in this session; smaller settings stay. They are read when a frame is run, not when it is made."""
    for name, most in SETTINGS.items():
        now = spark.conf.get(name)
        size = int(re.sub(r"\D", "", now)) << {"k": 10, "m": 20, "g": 30}.get(now.rstrip("bB").lower()[-1:], 0)
        if now.startswith("-") or not 0 < size <= most:
            spark.conf.set(name, str(most))


def portions(batches: Iterator, rows: int = ROWS, mb: int = MB) -> Iterator:
    """The batches in parts of at most so many rows and, down to single rows, megabytes, in order."""
    for batch in batches:
        left = [batch]
        while left:
            part = left.pop()
            if part.num_rows > 1 and (part.num_rows > rows or part.nbytes > mb << 20):
                middle = part.num_rows // 2
                left += [part.slice(middle), part.slice(0, middle)]
            else:
                yield part


def give_back() -> None:
    """Memory that a task has freed goes back to the system, so that it doesn't add to the peak of what the worker does next."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def mapped(rows: DataFrame, run: Callable[[Iterator], Iterator], schema) -> DataFrame:
    """rows.mapInArrow(run, schema) in portions, after each few of which the worker gives back what it has freed."""
    bounded(rows.sparkSession)

    def pieces(batches: Iterator) -> Iterator:
        done = 0
        for part in portions(batches):
            yield part
            done += part.nbytes
            if done > BATCH_MB << 22:
                give_back()
                done = 0
        give_back()

    return rows.mapInArrow(lambda batches: run(pieces(batches)), schema)
