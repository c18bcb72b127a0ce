"""Arrow batches of bounded size, so that long texts do not fill the memory of executors and their Python workers."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

_ROWS, _BYTES = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"


@contextmanager
def small_batches(spark: SparkSession, rows: int = 2000, size: str = "8m") -> Iterator[None]:
    """Jobs of this block get at most so many rows and about so many bytes in a batch; afterwards the session is as it was."""
    before = {key: spark.conf.get(key, None) for key in (_ROWS, _BYTES)}
    spark.conf.set(_ROWS, str(rows))
    spark.conf.set(_BYTES, size)
    try:
        yield
    finally:
        for key, value in before.items():
            if value is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, value)
