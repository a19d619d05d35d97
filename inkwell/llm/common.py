"""What the operators share: tables, words, bounded slices of Arrow batches, tables in the shared folder."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A word, in the regex dialects of Java, Python and RE2. bytes.split() without arguments cuts at the same six bytes.
WORD = r"[^\x20\x09-\x0D]+"
#: Text that is worked on at once in a Python worker; a longer text is a slice of its own.
SLICE_BYTES = 1 << 20


#: Rows of an Arrow batch between the JVM and Python workers: both sides hold whole batches of whole texts.
BATCH_ROWS = 1000
_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def bounded(spark: SparkSession) -> None:
    """Cut the session's Arrow batches to BATCH_ROWS, unless they are shorter already."""
    if not 0 < int(spark.conf.get(_ROWS)) <= BATCH_ROWS:
        spark.conf.set(_ROWS, str(BATCH_ROWS))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bounded(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: spark.checkpoint.dir. Where it is unset on one machine (tests), a temporary one."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors see")
    if not _own:
        _own.append("file://" + tempfile.mkdtemp(prefix="inkwell-"))
    return _own[0]


_own: list[str] = []
#: Of the GNU C library alone.
_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def _path(spark: SparkSession, path: str):
    """Hadoop's file system and path."""
    found = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), found


def staged(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet in the shared folder and read back: its lineage is cut, and lost executors cost nothing of it.

    The shuffle files of what led to df are removed with the write, and the folder when the application ends.
    """
    release()  # what the driver took to fit models, or for rows that it collected
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEAN, "false")
    spark.conf.set(_CLEAN, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEAN, before)
    fs, folder = _path(spark, path)
    fs.deleteOnExit(folder)
    return spark.read.schema(df.schema).parquet(path)


def unstage(df: DataFrame) -> None:
    """Remove the files of a staged table that is no longer needed."""
    spark = df.sparkSession
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        fs, path = _path(spark, folder)
        fs.delete(path, True)


def slices(batches: Iterable[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut so that a slice holds about `limit` bytes of the column, and a row at least."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes, dtype=np.int64)
        at = 0
        while at < batch.num_rows:
            base = ends[at - 1] if at else 0
            upto = max(at + 1, int(np.searchsorted(ends, base + limit, side="right")))
            yield batch.slice(at, upto - at)
            at = upto
    release()


def release() -> None:
    """Give free memory of Arrow and of the C library back: a worker serves many tasks, the driver many stages, and keeps what they took at most otherwise."""
    pa.default_memory_pool().release_unused()
    if _trim:
        _trim(0)


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[bytes]:
    """UTF-8 of each row; null counts as empty."""
    return [x or b"" for x in batch.column(column).cast(pa.binary()).to_pylist()]


def _enough(n: int) -> float:
    """Distinct rows that a sample of n is drawn from: fewer than n come of it with a chance below 1e-20, if they are counted to a tenth."""
    return 1.3 * n + 10 * n**0.5 + 200


def least(rows: DataFrame, group: str, order: list[Column], n: int) -> DataFrame:
    """At most n rows of each group, the first by the first column of order, a 64-bit hash, then by the others; rank has their place.

    Rows whose hash is above the share that _enough(n) distinct rows have of their group go first, and equal rows are
    counted before any shuffle, so that the one task that ranks a group gets a number of rows that does not grow with
    the input. Groups are few: one row of each is broadcast.
    """
    hashed = rows.withColumn("__h", order[0])
    sizes = hashed.groupBy(group).agg(F.approx_count_distinct("__h", 0.02).alias("__n"))
    near = hashed.join(F.broadcast(sizes), group).where((F.col("__h").cast("double") + 2.0**63) / 2.0**64 <= F.lit(_enough(n)) / F.col("__n"))
    packed = near.groupBy(*rows.columns, "__h").agg(F.count("*").alias("__copies"))
    own = Window.partitionBy(group).orderBy("__h", *order[1:]).rowsBetween(Window.unboundedPreceding, -1)
    left = F.lit(n) - F.coalesce(F.sum("__copies").over(own), F.lit(0))
    few = packed.withColumn("__left", left).where("__left > 0")
    taken = few.withColumn("__i", F.explode(F.sequence(F.lit(1).cast("long"), F.least("__copies", "__left"))))
    return taken.withColumn("rank", (n - F.col("__left") + F.col("__i")).cast("int")).select(*rows.columns, "rank")


def bucket(column: str, n: int):
    """crc32 of the id as text, modulo n."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % n


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit; works in place."""
    x ^= x >> np.uint64(31)
    x *= np.uint64(0x7FB5D329728EA185)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x81DADEF4BC2DD44D)
    x ^= x >> np.uint64(33)
    return x
