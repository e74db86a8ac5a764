"""What the operators of this subpackage share: reading columns, scratch tables, sizes."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowloom.session import scratch_folder, ship_package

BATCH_ROWS = 2048


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data folder, read by Spark."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def columns(df: DataFrame, **wanted: str) -> DataFrame:
    """The columns named by the values, under the names of the keys; all others are left out.

    Operators work on this narrow table only, so extra columns cannot clash with theirs.
    """
    return df.select(*[F.col(f"`{source}`").alias(name) for name, source in wanted.items()])


def bound_batches(spark: SparkSession) -> None:
    """Fewer rows in an Arrow batch than Spark's 10,000, as each may be a long text."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def texts(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``doc_id`` and ``text`` with a null text read as empty."""
    ship_package(df.sparkSession)
    narrow = columns(df, doc_id=id_col, text=text_col)
    return narrow.withColumn("text", F.coalesce(F.col("text").cast("string"), F.lit("")))


def in_order(narrow: DataFrame) -> DataFrame:
    """``doc_id`` and ``text`` in ranges, sorted by id, then by hash of the text, then by text.

    Rows of one id, or of one id and text, may fill several ranges, so that no task holds a frequent key alone.
    """
    keyed = narrow.withColumns({"_hash": F.xxhash64("text"), "_row": F.monotonically_increasing_id()})
    ranges = keyed.repartitionByRange("doc_id", "_hash", "_row")
    return ranges.sortWithinPartitions("doc_id", "_hash", "text").select("doc_id", "text")


def written(df: DataFrame, purpose: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: computed once, safe from lost executors."""
    folder = scratch_folder(df.sparkSession, purpose)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def tidied(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], *at_end: Callable[[], None]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` with a clean-up at the end of each task, so that an idle worker holds little memory.

    Calls ``at_end``, then gives free memory back to the system.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            for free in at_end:
                free()
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL(None).malloc_trim(0)
            except (OSError, AttributeError):  # not this C library
                pass

    return each


def task_count(spark: SparkSession) -> int:
    """Partitions for an exchange whose number is fixed by us."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def slices(batch: pa.RecordBatch, column: str, limit: int = 2 << 20) -> Iterable[pa.RecordBatch]:
    """Parts of a batch of about ``limit`` bytes in ``column``, so that long texts stay bounded."""
    total = batch.column(column).nbytes
    rows = batch.num_rows
    step = max(1, int(rows * limit / total)) if total > limit else max(1, rows)
    for begin in range(0, rows, step):
        yield batch.slice(begin, step)


def in_slices(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield from slices(batch, column)
