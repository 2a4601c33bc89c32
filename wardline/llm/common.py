"""Helpers shared by the corpus operators: shared-folder tables, sizing and Arrow plumbing."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Prefix of the columns that operators add while they work; input columns never carry it.
PRIVATE = "__wl_"
#: Most bytes that any operator broadcasts. Larger state takes another way.
BROADCAST_BYTES = 32 << 20


#: Most rows of an Arrow batch: with texts of a few kilobytes a batch takes some megabytes on either side.
BATCH_ROWS = 2000
#: Most ids that are broadcast to pick rows by.
BROADCAST_IDS = 1 << 20
#: Rows of a key from which on it may fill a task, and the most keys that are broadcast for that.
HOT_ROWS, HOT_KEYS = 1000, 100_000


def released() -> None:
    """Gives memory that a worker has freed back to the system, where the C library can."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def tidied(run):
    """``run``, a function of mapInArrow, that gives freed memory back behind its last batch: its worker lives on beside others."""

    def whole(batches):
        yield from run(batches)
        released()

    return whole


def small_batches(spark: SparkSession) -> None:
    """Bounds the session's Arrow batches for plans made from here on, if they are larger."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def within(df: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of ``df`` whose doc_id is among ``ids``, which are counted: few are broadcast, more are shuffled."""
    few = ids.count() <= BROADCAST_IDS
    return df.join(F.broadcast(ids) if few else ids, "doc_id", "left_semi")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only a local session, whose driver is the executor, may
    leave it unset and gets a temporary folder."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="wardline-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def written(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: lost executors cost no recomputation, lineage ends here."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._wardline_path = path
    return out


def discarded(*tables: DataFrame) -> None:
    """Deletes tables that ``written`` made, when nothing reads them any more."""
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df._wardline_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def matched(rows: DataFrame, table: DataFrame, key: str, size: str, total: int) -> DataFrame:
    """``rows`` joined with ``table``, which has one row a key and in ``size`` how many of the ``total`` rows carry the key. Keys with so
    many rows that they would fill a task are broadcast, at most HOT_KEYS of them by their count; the other keys are shuffled."""
    limit = max(HOT_ROWS, total // HOT_KEYS)
    table = table.withColumnRenamed(key, PRIVATE + "key")
    hot, cold = table.where(F.col(size) > limit), table.where(F.col(size) <= limit)
    meets = F.col(key) == F.col(PRIVATE + "key")
    rest = rows.join(F.broadcast(hot.select(PRIVATE + "key")), meets, "left_anti").join(cold, meets)
    return rows.join(F.broadcast(hot), meets).union(rest).drop(PRIVATE + "key")


def attached(docs: DataFrame, extra: DataFrame, key: str, size: int, by: str = "doc_id") -> DataFrame:
    """``docs`` left-joined with ``extra``, a written table with one row for some values of ``by`` (in ``key``, which is dropped) and about ``size``
    bytes. Within BROADCAST_BYTES it is broadcast. Beyond, only the documents that have such a row are shuffled, as long as their
    ids can be broadcast (BROADCAST_IDS); else all are."""
    meets = docs[by] == extra[key]
    if size <= BROADCAST_BYTES:
        return docs.join(F.broadcast(extra), meets, "left").drop(key)
    if extra.count() > BROADCAST_IDS:
        return docs.join(extra, meets, "left").drop(key)
    name = free_name(docs, "own")
    ids = F.broadcast(extra.select(F.col(key).alias(name)))
    own = docs[by] == F.col(name)
    whole = docs.join(ids, own, "left_anti")
    for field in extra.schema:
        if field.name != key:
            whole = whole.withColumn(field.name, F.lit(None).cast(field.dataType))
    return docs.join(ids, own, "left_semi").join(extra, meets).drop(key).unionByName(whole)


def estimated_bytes(df: DataFrame, unknown: int = 1 << 30) -> int:
    """Catalyst's size estimate, only for sizing partitions; ``unknown`` where there is none."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return size if size < 1 << 55 else unknown


def raw_text(df: DataFrame, *more: str) -> DataFrame:
    """doc_id, the text's UTF-8 bytes and ``more``. Other columns are left behind, so none can clash."""
    small_batches(df.sparkSession)
    return df.select("doc_id", *more, F.col("text").cast("binary").alias("text"))


def extended(df: DataFrame, fields: list[T.StructField]) -> T.StructType:
    """The schema of ``df`` and ``fields``."""
    small_batches(df.sparkSession)
    return T.StructType([*df.schema.fields, *fields])


def arrow_type(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def batch_of(schema: T.StructType, columns: list) -> pa.RecordBatch:
    """A record batch of Python or NumPy columns, typed as ``schema``."""
    types = [arrow_type(f.dataType) for f in schema.fields]
    arrays = [c if isinstance(c, pa.Array) else pa.array(c, type=t) for c, t in zip(columns, types, strict=True)]
    return pa.RecordBatch.from_arrays([a.cast(t) if a.type != t else a for a, t in zip(arrays, types, strict=True)], names=schema.names)


def pieces(batches, limit: int = 16 << 20, column: str = "text"):
    """The batches, sliced so that the text in each is about ``limit`` bytes at most (a single longer text stays whole)."""
    for batch in batches:
        size = max(1, batch.column(batch.schema.get_field_index(column)).nbytes)
        step = max(1, int(batch.num_rows * limit / size))
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)


def joined(batches, limit: int, column: str = "text"):
    """The rows of the batches in parts of about ``limit`` bytes of text (a single longer text stays whole)."""
    held, size = [], 0

    def whole():
        return pa.Table.from_batches(held).combine_chunks().to_batches()[0]

    for batch in pieces(batches, limit, column):
        own = batch.column(batch.schema.get_field_index(column)).nbytes
        if held and size + own > limit:
            yield whole()
            held.clear()
            size = 0
        if batch.num_rows:
            held.append(batch)
            size += own
    if held:
        yield whole()


def free_name(df: DataFrame, name: str) -> str:
    """A column name that ``df`` doesn't have, ``__wl_name`` if it is free."""
    found = PRIVATE + name
    while found.lower() in {c.lower() for c in df.columns}:
        found += "_"
    return found


def column(batch: pa.RecordBatch, name: str) -> list:
    return batch.column(batch.schema.get_field_index(name)).to_pylist()
