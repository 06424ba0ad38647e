"""Append-only logs as streams: records that arrive late or again, rolled up by watermark, and a registry kept current."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery


def read_log(spark: SparkSession, path: str, schema: T.StructType, per_trigger: int = 1000) -> DataFrame:
    """A folder of JSON lines as a stream of rows."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).json(path)


def windowed_counts(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Events (event_id, ts, event_type, value) by window and type; the same event again within the watermark counts once."""
    once = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])
    return once.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def upsert_latest(stream: DataFrame, path: str, checkpoint: str, key: list[str], order: str) -> StreamingQuery:
    """Keep the latest record of each key in a table: each batch is merged with what is there and written beside it, and a
    pointer names the table that counts. Runs until the source is read up."""

    def merge(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        fs_path = spark._jvm.org.apache.hadoop.fs.Path(path)
        fs = fs_path.getFileSystem(spark._jsc.hadoopConfiguration())
        now = current(spark, path)
        both = batch.select(*batch.columns) if now is None else now.unionByName(batch)
        rest = [c for c in both.columns if c not in key]
        kept = both.groupBy(*key).agg(F.max(F.struct(order, *[c for c in rest if c != order])).alias("r")).select(*key, *[F.col(f"r.{c}").alias(c) for c in rest])
        kept.select(*batch.columns).write.mode("overwrite").parquet(f"{path}/v{n:09d}")
        fs.create(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_current-{n:09d}"), True).close()

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(spark: SparkSession, path: str) -> DataFrame | None:
    """The table that `upsert_latest` wrote last, None before the first."""
    jvm = spark._jvm.org.apache.hadoop.fs
    top = jvm.Path(path)
    fs = top.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(top):
        return None
    done = sorted(s.getPath().getName() for s in fs.listStatus(top) if s.getPath().getName().startswith("_current-"))
    return spark.read.parquet(f"{path}/v{done[-1].removeprefix('_current-')}") if done else None
