"""Structured Streaming over append logs: a resumable scan, the latest state of each key, and progress."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomstone.operators.dedup import scratch
from loomstone.sources import io


def _fed(spark: SparkSession, log: DataFrame, parts: int = 2) -> tuple[DataFrame, str]:
    """The log as a file stream, written in a few appends."""
    path = scratch(spark)
    for k in range(parts):
        log.where(F.pmod(F.xxhash64(*log.columns), F.lit(parts)) == k).write.mode("append").parquet(f"{path}/in")
    return spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 4).parquet(f"{path}/in"), path


def resumable(spark: SparkSession, log: DataFrame, keys: list[str]) -> DataFrame:
    """Counts by key from a stream that stops and starts again at its checkpoint: no record is read twice."""
    source, path = _fed(spark, log)
    for _ in range(2):  # the second run finds nothing new
        q = source.select(*keys).writeStream.option("checkpointLocation", f"{path}/ck").format("parquet").option("path", f"{path}/out").trigger(availableNow=True).start()
        q.awaitTermination()
    return spark.read.parquet(f"{path}/out").groupBy(*keys).agg(F.count("*").alias("n"))


def latest_view(spark: SparkSession, log: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last record of each key, merged batch by batch into a new version of the view."""
    source, path = _fed(spark, log)
    version = {"at": None}

    def merge(batch: DataFrame, epoch: int) -> None:
        old = version["at"]
        both = batch if old is None else batch.unionByName(spark.read.schema(batch.schema).parquet(old))
        version["at"] = f"{path}/v{epoch}"
        io.latest(both, keys, order).select(batch.columns).write.mode("overwrite").parquet(version["at"])

    source.writeStream.option("checkpointLocation", f"{path}/ck").foreachBatch(merge).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(log.schema).parquet(version["at"])


def progress(spark: SparkSession, log: DataFrame) -> DataFrame:
    """batch, n: the rows of each batch. Batches record themselves, however many there are; one that runs again replaces its record."""
    source, path = _fed(spark, log)

    def record(batch: DataFrame, epoch: int) -> None:
        batch.agg(F.lit(epoch).cast("bigint").alias("batch"), F.count("*").alias("n")).write.mode("overwrite").parquet(f"{path}/progress/{epoch}")

    source.writeStream.option("checkpointLocation", f"{path}/ck").foreachBatch(record).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("batch bigint, n bigint").option("recursiveFileLookup", "true").parquet(f"{path}/progress")


def windowed_counts(events: DataFrame, ts: str, key: str, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Event counts by tumbling window and key; works on streams, where late rows beyond the watermark are dropped."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, width), key).agg(F.count("*").alias("n"))
