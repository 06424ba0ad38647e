"""What the operators of this package share: the shared folder, row keys and text slices."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import cache, wraps

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Text bytes that one Python step holds at once; a longer single text is a slice of its own.
SLICE_BYTES = 8 << 20

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Unset, a local master gets a temporary one; a cluster is an error."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    found = tempfile.mkdtemp(prefix="pitlake-")
    spark.conf.set("spark.checkpoint.dir", found)
    return found


#: With it, Spark removes a query's shuffle files when it ends, not when the driver happens to collect garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def save(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Write df as Parquet to the shared folder and read it again: a short lineage that outlives executors.

    The table stays until the folder is cleared, since frames that read it are lazy. The shuffle files of the write go at
    once: no other query reads them, and those of many steps together would take more disk than any step.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", codec).parquet(path)
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def lower_ascii(c: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(c, _UPPER, _LOWER)


def text_of(c: str = "text") -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit(""))


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Arrow batches of at most so many rows from now on in this session, unless it sets a size itself: the default of
    10,000 whole texts takes buffers of 100 MB on either side."""
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def text_bytes(df: DataFrame, column: str = "text") -> int:
    """Bytes in a text column: one pass in the JVM."""
    return int(df.agg(F.sum(F.octet_length(column))).first()[0] or 0)


def histogram_median(df: DataFrame, by: str, value: Column, name: str, step: float = 1e-3) -> DataFrame:
    """by, name: the lower median of values (not below 0, null ones left out) to within a step, from counts of steps: the
    same however the rows lie, and a step is counted before it is shuffled."""
    steps = df.where(value.isNotNull()).groupBy(by, F.floor(value / step).alias("_step")).agg(F.count(F.lit(1)).alias("_n"))
    so_far, all_ = Window.partitionBy(by).orderBy("_step"), Window.partitionBy(by)
    at = steps.select(by, "_step", F.sum("_n").over(so_far).alias("_upto"), F.sum("_n").over(all_).alias("_all"))
    return at.where(2 * F.col("_upto") >= F.col("_all")).groupBy(by).agg(((F.min("_step") + 0.5) * step).alias(name))


def numbered(df: DataFrame, column: str, name: str) -> DataFrame:
    """Distinct values of a column with numbers from 0 on without gaps, in their order: ranges are numbered each and offset."""
    rows = save(df.select(column).distinct().repartitionByRange(column).sortWithinPartitions(column).withColumn("_at", F.monotonically_increasing_id()), "numbered")
    part, place = F.shiftright("_at", 33), F.col("_at").bitwiseAND((1 << 33) - 1)
    counts = rows.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))  # a row a partition
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return rows.withColumn("_part", part).join(F.broadcast(offsets), "_part").select(column, (place + F.col("_before")).alias(name))


def parts_for(total_bytes: int, each: int = 16 << 20) -> int:
    """Partitions of about `each` bytes."""
    return max(1, -(-total_bytes // each))


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that each part has about `most` text bytes; a longer text is alone in its part."""
    for batch in batches:
        size = np.asarray(pa.compute.fill_null(pa.compute.binary_length(batch.column(text)), 0), dtype=np.int64)
        ends = np.cumsum(size)
        at, n = 0, batch.num_rows
        while at < n:
            base = ends[at] - size[at]
            to = max(at + 1, int(np.searchsorted(ends, base + most, side="right")))
            yield batch.slice(at, to - at)
            at = to


def gather(batches: Iterator[pa.RecordBatch], rows: int, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Batches of short rows put together to about `rows` or `most` bytes."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= rows or sum(b.nbytes for b in held) >= most:
            yield pa.concat_batches(held)
            held = []
    if held:
        yield pa.concat_batches(held)


@cache
def _libc() -> ctypes.CDLL | None:
    try:
        return ctypes.CDLL("libc.so.6")
    except OSError:
        return None


def release() -> None:
    """Give freed memory back to the system: a worker is used again by other tasks and would keep its peak."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if _libc() is not None:
        _libc().malloc_trim(0)


def frugal(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A step over batches that releases its memory when it ends."""

    @wraps(run)
    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            release()

    return step


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (splitmix64), vectorised."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x
