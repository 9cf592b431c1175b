"""Helpers shared by the training-data operators."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Word separators of every contract here: space, tab, line feed, VT, FF, CR.
SEPARATORS = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"

_own_shared: str | None = None


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Only where that is unset (a local session, as in tests) is a folder made.
    """
    global _own_shared
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir is not set: executors need a shared folder")
    if _own_shared is None:
        _own_shared = tempfile.mkdtemp(prefix="veinworks-")
    return f"file://{_own_shared}"


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/veinworks/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str, partition_by: str | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends in
    committed files, so a lost executor costs a re-read, not a recompute. Shuffle
    files of finished steps go when the driver's JVM collects what refers to
    them; it is asked to, or they would fill the executors' disks."""
    path = new_path(df.sparkSession, name)
    writer = df.write.option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(partition_by)
    writer.parquet(path)
    gc.collect()
    df.sparkSession.sparkContext._jvm.System.gc()
    return df.sparkSession.read.schema(df.schema).parquet(path)


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return df.select(*columns) if columns else df


#: Rows of an Arrow batch of whole texts.
TEXT_ROWS = 500


def whole_texts(df: DataFrame) -> DataFrame:
    """``df``, whose texts go to Python in batches of TEXT_ROWS: the default of
    10,000 rows would hold tens of megabytes in each worker several times over."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(TEXT_ROWS))
    return df


def doc_remainder(modulus: int, doc_id: str | Column = "doc_id") -> Column:
    """crc32(doc_id as text) mod ``modulus``; a null id counts as 0 (held out)."""
    col = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(col.cast("string")) % modulus, F.lit(0))


def sized_partitions(df: DataFrame, bytes_each: int = 64 << 20, usual: int = 200_000) -> int:
    """How many shuffle partitions hold ``df``: by the size of the tables it reads,
    and no fewer than the session's own setting or ``usual``, whichever is less.
    Sizes over a petabyte are those of tables without statistics and count as
    unknown."""
    spark = df.sparkSession
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    estimate = sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))
    floor = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return floor if estimate > 10**15 else max(min(floor, usual), min(200_000, estimate // bytes_each + 1))


def slices(batches: Iterable[pa.RecordBatch], column: str, max_bytes: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that ``column`` holds about ``max_bytes`` in each, or
    one row that is longer."""
    for batch in batches:
        total = batch.column(column).nbytes
        if batch.num_rows <= 1 or total <= max_bytes:
            if batch.num_rows:
                yield batch
            continue
        sizes = pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0).to_pylist()
        start = held = 0
        for i, n in enumerate(sizes):
            if held and held + n > max_bytes:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += n
        yield batch.slice(start)


def text_bytes(column: pa.Array):
    """The UTF-8 bytes of a string column as one uint8 array with row offsets;
    nulls are empty rows."""
    import numpy as np

    if column.null_count:
        column = pa.compute.fill_null(column, "")
    if pa.types.is_large_string(column.type):
        offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    else:
        offsets = np.frombuffer(column.buffers()[1], dtype=np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    whole = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]
