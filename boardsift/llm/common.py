"""Shared helpers: input tables, the shared scratch folder and Arrow batches."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text bytes handled at once inside one Python task.
SLICE_BYTES = 8 << 20
#: Text bytes after which a task gives back what it has freed.
RELEASE_BYTES = 4 << 20
#: Rows and bytes sent to a Python worker at once: executors keep buffers of this size for every task.
BATCH_ROWS, BATCH_BYTES = 1000, 8 << 20

_own_scratch: list[str] = []


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``; a temporary one only where it is unset and driver and
    executors are one process."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not _own_scratch:
        _own_scratch.append("file://" + tempfile.mkdtemp(prefix="boardsift-"))
    return _own_scratch[0]


def scratch_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/boardsift/{tag}-{uuid.uuid4().hex}"


def staged(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back, which cuts its lineage and survives lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, tag)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_staged(df: DataFrame) -> None:
    """Delete the files of a table made by :func:`staged` once nothing reads it any more."""
    spark = df.sparkSession
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for folder in {name.rsplit("/", 1)[0] for name in df.inputFiles()}:
        if "/boardsift/" in folder:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(conf).delete(path, True)


def arrow_batches(df: DataFrame) -> DataFrame:
    """Bound the Arrow batches before a Python operator."""
    conf = df.sparkSession.conf
    conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return df


def frugal(work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``work`` that gives its worker's memory back when a task ends, as idle workers stay alive."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from work(batches)
        finally:
            release()

    return run


def release() -> None:
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def text_slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that the text of each piece stays near ``limit`` bytes; a longer single text stays whole.  What
    a worker has freed goes back to the system now and then, as an executor's workers share its memory."""
    done = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
        start = 0
        while start < batch.num_rows:
            used = size[start - 1] if start else 0
            end = max(start + 1, int(np.searchsorted(size, used + limit, side="right")))
            yield batch.slice(start, end - start)
            done += int(size[end - 1]) - int(used)
            if done > RELEASE_BYTES:
                done = 0
                release()
            start = end


def rows_where(keep: Callable[[pa.Array], np.ndarray]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The rows, with all their columns, whose texts (column ``text``) ``keep`` accepts."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, limit=2 << 20):
            yield batch.filter(pa.array(keep(batch.column("text").cast(pa.string())), pa.bool_()))

    return frugal(work)


def numbered(df: DataFrame) -> tuple[DataFrame, str]:
    """A copy of ``df`` in the shared folder with a column of row numbers, and the name of that column.

    Numbers are written once, as those of a scan (``monotonically_increasing_id``) change with the way its files are
    cut, which depends on the cores that are live when it is planned."""
    name = "row"
    while name.lower() in {c.lower() for c in df.columns}:
        name += "_"
    return staged(df.withColumn(name, F.monotonically_increasing_id()), "numbered"), name


def with_groups(rows: DataFrame, groups: DataFrame, key: str, size: str) -> DataFrame:
    """``rows`` with the columns of the group of their ``key``, null where there is none.

    Groups of over a thousandth of all rows, of which there are fewer than 1,000, are broadcast, so that no task
    gathers the rows of a hot key; the others are joined by key."""
    least = max(1000, rows.count() // 1000)
    heavy, light = F.broadcast(groups.where(F.col(size) > least)), groups.where(F.col(size) <= least)
    return rows.join(heavy, key).unionByName(rows.join(heavy, key, "left_anti").join(light, key, "left"))


def without_rows(docs: DataFrame, name: str, lost: DataFrame) -> DataFrame:
    """``docs`` of :func:`numbered` without the rows whose numbers ``lost`` holds in its column row; all columns but
    the number stay, whatever their names."""
    return docs.join(lost.select(F.col("row").alias(name)), name, "left_anti").drop(name)


def held_out(doc_id) -> "F.Column":
    """Rows that no model may learn labels from: crc32 of the id as text, mod 5, is 0."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def text_column(docs: DataFrame, name: str = "text"):
    return F.coalesce(docs[name], F.lit(""))
