"""What the operators share: written intermediate tables and text columns inside Arrow batches."""

from __future__ import annotations

import contextlib
import ctypes
import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

LONG, TEXT = T.LongType(), T.StringType()


def fields(**kinds: T.DataType) -> list[T.StructField]:
    return [T.StructField(name, kind) for name, kind in kinds.items()]


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster shares (spark.checkpoint.dir); a temporary one only where that is unset and Spark runs on one machine."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="timeloom-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/timeloom/{name}-{uuid.uuid4().hex}"


#: Bytes of one Arrow batch that goes to a Python worker while a table is written.
BATCH_BYTES = "4m"


#: What operators keep in a Python worker from one task to the next, to be emptied when another operator uses the worker.
WORKER_CACHES: list[dict] = []


def give_back(own: dict | None = None) -> None:
    """Memory that this Python worker no longer uses goes back to the system: Spark keeps workers, and gives them other work.

    Caches but ``own`` are emptied.
    """
    for cache in WORKER_CACHES:
        if cache is not own:
            cache.clear()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):
        ctypes.CDLL(None).malloc_trim(0)


def _number(size: str | None) -> float:
    """Bytes that a setting like 4m or 256MB stands for; without a limit if there is none."""
    found = re.fullmatch(r"(\d+)([kmg]?)b?", (size or "").strip().lower())
    return int(found[1]) * 1024 ** " kmg".index(found[2] or " ") if found and int(found[1]) else float("inf")


@contextlib.contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Arrow batches of BATCH_BYTES; where the session asks for smaller ones, it gets them."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name, None)
    if _number(before) > _number(BATCH_BYTES):
        spark.conf.set(name, BATCH_BYTES)
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows as a Parquet table in the shared folder: lineage ends there and outlives any executor.

    Python workers get small Arrow batches meanwhile, so that long texts do not fill their memory.
    """
    path = new_path(df.sparkSession, name)
    with small_batches(df.sparkSession):
        df.write.parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table._timeloom_path = path
    return table


def fewer(table: DataFrame) -> DataFrame:
    """A table of ``written`` read by a quarter of the tasks, for rows of a few numbers that are shuffled: each task that
    writes a shuffle opens a file for each of its partitions, which costs as much as tens of thousands of such rows.
    """
    return table.coalesce(-(-table.rdd.getNumPartitions() // 4) or 1)


def discard(*tables: DataFrame) -> None:
    """Deletes tables of ``written`` that nothing reads any more."""
    for table in tables:
        spark = table.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(table._timeloom_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def own_name(df: DataFrame, wanted: str) -> str:
    """``wanted``, or with underscores behind it if the table has such a column."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


def ascii_lower(column):
    """Lower-cases A-Z only."""
    return F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string or binary column and the offsets of its rows; null counts as empty."""
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, at, data = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(at, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if data is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(batches: Iterator[pa.RecordBatch], column: str, most: int, own: dict | None = None) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Cuts batches between rows so that the texts of one piece have about ``most`` bytes; a longer text stands alone.

    The caches of other operators than that of ``own`` are emptied first.
    """
    give_back(own)
    for batch in batches:
        if not batch.num_rows:
            continue
        data, offsets = text_bytes(batch.column(column))
        row = 0
        while row < batch.num_rows:
            end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + most, "right")) - 1)
            end = min(end, batch.num_rows)
            yield batch.slice(row, end - row), data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
            row = end
    give_back(own)


def lists(values: pa.Array, sizes: np.ndarray) -> pa.ListArray:
    """A list column from its flat values and the number that each row has."""
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), values)
