"""Arrow batches between the JVM and Python workers: both sides hold whole batches of whole texts."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Rows and bytes of a batch at most. A page becomes several times its size while it is parsed.
ROWS, BYTES = 256, 4 << 20
_ROWS, _BYTES = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"


def bounded(spark: SparkSession) -> None:
    """Cut the session's Arrow batches, unless they are smaller already."""
    if not 0 < int(spark.conf.get(_ROWS)) <= ROWS:
        spark.conf.set(_ROWS, str(ROWS))
    if not 0 < int(spark.conf.get(_BYTES).rstrip("bB")) <= BYTES:
        spark.conf.set(_BYTES, f"{BYTES}b")
