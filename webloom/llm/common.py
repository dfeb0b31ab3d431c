"""What the operators share: the folder that all executors see, tables that cut lineage, fold columns."""

from __future__ import annotations

import contextlib
import ctypes
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_root(spark: SparkSession) -> str:
    """URI of the folder that driver and executors share: what the cluster names in ``spark.checkpoint.dir``.

    Where that is unset, the folder given to ``SparkContext.setCheckpointDir``. Only a local master, as in tests, may do
    without both: then a folder under the temporary directory is set. A cluster must name one.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not (spark.sparkContext.master or "").startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = "file://" + os.path.join(tempfile.gettempdir(), f"webloom-shared-{os.getuid()}")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def shared_path(spark: SparkSession, label: str) -> str:
    """A new path below the shared folder; no two calls get the same one."""
    return f"{shared_root(spark)}/webloom/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex[:12]}"


def remove(spark: SparkSession, path: str) -> None:
    """Delete a table written by :func:`materialize`, through the file system that Spark uses for it."""
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jpath, True)


#: Rows of a file of a small table.
ROWS_A_FILE = 100_000
#: Spark's setting that removes a query's shuffle files when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialize(df: DataFrame, label: str, rows: int | None = None) -> tuple[DataFrame, str]:
    """Write ``df`` to the shared folder and read it back: lineage ends there, and a lost executor loses nothing.

    ``rows``: about how many rows it has, if known; then it gets files of ``ROWS_A_FILE`` rows, so many small partitions don't make many small files.
    The shuffles that made the table go when it is written, so stages that follow each other don't add up on the disks.
    """
    spark = df.sparkSession
    path = shared_path(spark, label)
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        (df if rows is None else df.coalesce(1 + rows // ROWS_A_FILE)).write.parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path), path


#: Rows of whole texts that go to a Python worker at once, and that Spark reads from a file at once.
ROWS_A_BATCH, ROWS_READ = 1000, 512


def small_batches(spark: SparkSession) -> None:
    """Texts are long: batches of Spark's default 10,000 rows would take tens of megabytes several times over, and so do
    the 4096 rows of a reader, in arrays that grow by doubling. Settings of one's own stay.
    """
    for key, default, rows in (("spark.sql.execution.arrow.maxRecordsPerBatch", "10000", ROWS_A_BATCH), ("spark.sql.parquet.columnarReaderBatchSize", "4096", ROWS_READ)):
        if spark.conf.get(key) == default:
            spark.conf.set(key, str(rows))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def whole_text(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only ``doc_id`` and ``text``; a null text becomes the empty one. Extra columns, whatever their names, go."""
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def fold(id_col: Column | str, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; a null id falls into fold 0."""
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.coalesce(F.crc32(c.cast("string").cast("binary")) % folds, F.lit(0))


_held: dict[tuple, object] = {}


def held(key: tuple, make: Callable[[], object]) -> object:
    """What a Python worker keeps from task to task: one thing at a time, so stages that follow each other don't add up."""
    if key not in _held:
        release()
        _held[key] = make()
    return _held[key]


def release() -> None:
    """Drop what the worker keeps of an earlier stage, and hand its memory back to the system. For stages that keep nothing."""
    if _held:
        _held.clear()
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(AttributeError, OSError):  # glibc has it
            ctypes.CDLL(None).malloc_trim(0)


def slices(batches: Iterator[pa.RecordBatch], rows: int = 512, size: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that each holds at most ``rows`` rows and, beyond one row, about ``size`` bytes of ``text``."""
    for batch in batches:
        if not batch.num_rows:
            continue
        lengths = pc.binary_length(batch.column("text")).to_pylist()
        start = held = 0
        for i, n in enumerate(lengths):
            if i > start and (i - start >= rows or held + (n or 0) > size):
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += n or 0
        yield batch.slice(start)
