"""What the corpus operators share: the scratch tables, ranks without large groups, and text batches."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Text of one numpy step, in bytes; it bounds the memory of a Python worker, not the size of a text.
STEP_BYTES = 2 << 20

_made: dict[str, SparkSession] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as ``spark.checkpoint.dir`` names it. Where a session on one machine names none, it
    gets a temporary folder; on a cluster that would lose rows, so there it is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if not re.fullmatch(r"local(\[.*\])?", master):
            raise ValueError(f"set spark.checkpoint.dir to a folder that all executors of {master} share")
        found = "file://" + tempfile.mkdtemp(prefix="timbrel-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _made[path] = spark
    return path


def materialize(df: DataFrame, name: str, **options) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.options(**options).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def release(*tables: DataFrame) -> None:
    """Delete scratch tables that nothing lazy reads any more."""
    for df in tables:
        if path := getattr(df, "_scratch", None):
            _delete(df.sparkSession, path)


def drop_shuffles(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of finished jobs: it does so when the driver's collector finds their plans gone."""
    spark.sparkContext._jvm.System.gc()


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    _made.pop(path, None)


@atexit.register
def _clean() -> None:
    for path, spark in list(_made.items()):
        try:
            _delete(spark, path)
        except Exception:  # noqa: BLE001  the JVM is gone already
            return


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of bounded bytes, so that long texts do not fill a worker. The session's limits are lowered, and stay
    so: results are lazy, and their batches are cut when they are read."""
    for name, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", 2000), ("spark.sql.execution.arrow.maxBytesPerBatch", 8 << 20)):
        now = str(spark.conf.get(name)).removesuffix("b")
        if not (now.isdigit() and 0 < int(now) <= most):
            spark.conf.set(name, str(most))


def documents(spark: SparkSession, sf_dir: str, table: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def bucket_bits(rows: int, most: int = 2000) -> int:
    """Bits of a hash, so that buckets of ``rows`` rows have about ``most`` rows at most."""
    return max(1, (max(1, rows) // most).bit_length())


def hash_bucket(code: Column, bits: int) -> Column:
    """The upper bits of a 64-bit hash."""
    return F.shiftrightunsigned(code, 64 - bits)


def ranked(df: DataFrame, keys: list[str], order: list[Column], bucket: Column, rank: str = "rank") -> DataFrame:
    """0-based rank of each row within ``keys``, by (bucket, order). ``bucket`` is a long that splits a hot key into
    windows of bounded size; rows of a smaller bucket come first. Only counts by (keys, bucket) are gathered by key."""
    rows = df.withColumn("_bucket", bucket)
    sizes = rows.groupBy(*keys, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_bucket").alias("_b"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy(*keys, "_bucket").orderBy(*order)
    rows = rows.withColumn("_inside", F.row_number().over(inside) - 1)
    on = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)] + [F.col("_bucket") == F.col("_b")]
    joined = rows.join(starts, on)
    return joined.select(*df.columns, (F.col("_start") + F.col("_inside")).cast("long").alias(rank))


#: Up to so many ids (8 bytes each) are broadcast; beyond, the join is shuffled.
BROADCAST_IDS = 250_000


def small(table: DataFrame) -> DataFrame:
    """A written table, to be broadcast if its rows were counted and are few."""
    if rows_of(table) <= BROADCAST_IDS:
        return table
    return F.broadcast(table) if table.count() <= BROADCAST_IDS else table


#: Rows that the driver takes at once.
FEW = 100_000


def local(spark: SparkSession, table: pa.Table) -> DataFrame:
    """A bounded table of the driver, to be broadcast: no task writes or reads it."""
    out = F.broadcast(spark.createDataFrame(table))
    out._rows = table.num_rows
    return out


def rows_of(df: DataFrame) -> float:
    """The rows of a ``local`` table; of any other, not known to be few."""
    return getattr(df, "_rows", float("inf"))


def gathered(df: DataFrame, name: str, most: float) -> DataFrame:
    """``df``, of no more than ``most`` rows, from the driver if those are few; else written as by ``materialize``."""
    return local(df.sparkSession, df.toArrow()) if most <= FEW else materialize(df, name)


def join_groups(rows: DataFrame, groups: DataFrame, keys: list[str], members: str) -> DataFrame:
    """``rows`` with the columns of their group in ``groups`` (unique ``keys`` without nulls, number of ``members``). A group
    with a third of all rows is no task of its own: groups of more than one in BROADCAST_IDS of all rows, so BROADCAST_IDS
    groups at most, are broadcast, and only the others' rows are dealt by key."""
    groups = materialize(groups, "groups")
    most = max(256, -(-(groups.agg(F.sum(members)).first()[0] or 0) // BROADCAST_IDS))
    large = F.broadcast(groups.filter(F.col(members) > most))
    rest = rows.join(large.select(*keys), keys, "left_anti")
    return rows.join(large, keys).unionByName(rest.join(groups.filter(F.col(members) <= most), keys))


def trimmed(run):
    """A function of Arrow batches that gives freed memory back when its task ends; the worker process lives on."""

    def whole(batches):
        some = False

        def counted():
            nonlocal some
            for batch in batches:
                some = True
                yield batch

        try:
            yield from run(counted())
        finally:
            if some:
                pa.default_memory_pool().release_unused()
                if trim := getattr(_libc(), "malloc_trim", None):
                    trim(0)

    return whole


@lru_cache(maxsize=1)
def _libc():
    import ctypes

    return ctypes.CDLL(None)


def drop_ids(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose doc_id isn't in ``ids`` (doc_id), null ids among them."""
    ids = materialize(ids.select("doc_id").filter("doc_id IS NOT NULL").distinct(), "ids")
    return docs.join(small(ids), "doc_id", "left_anti").select(docs.columns)


def byte_texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All UTF-8 bytes of a string or binary array, and the n + 1 offsets into them; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[ends[0] : ends[-1]], ends - ends[0]


def steps(batch: pa.RecordBatch, column: str, most: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with at most ``most`` bytes of text each, or one longer text."""
    _, ends = byte_texts(batch.column(column))
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(ends, ends[at] + most, "right")) - 1)
        yield batch.slice(at, to - at)
        at = to
