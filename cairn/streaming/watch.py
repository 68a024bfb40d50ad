"""A catalog that grows: batches of scan rows as a stream, and counts that stay current."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from cairn.schemas import FILES


def arrivals(spark: SparkSession, folder: str, per_trigger: int = 100) -> DataFrame:
    """Parquet files of catalog rows that land in a folder, as a stream."""
    return spark.readStream.schema(FILES).option("maxFilesPerTrigger", per_trigger).parquet(folder)


def by_period(stream: DataFrame, delay: str = "7 days", period: str = "1 day") -> DataFrame:
    """Rows and bytes of each period of scanned_at; rows later than delay are left out."""
    timed = stream.withColumn("at", F.col("scanned_at").cast("timestamp")).withWatermark("at", delay)
    w = timed.groupBy(F.window("at", period)).agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes"))
    return w.select(F.col("window.start").alias("period"), "n", "bytes")


def keep(stream: DataFrame, store, checkpoint: str) -> StreamingQuery:
    """Upsert every batch into the buckets of the store's files table that it touches; a batch that is run again changes nothing."""
    from cairn.sinks.store import upsert_files

    def put(batch: DataFrame, _: int) -> None:
        now = batch.agg(F.max("scanned_at")).first()[0]
        if now is not None:
            store.merge("files", batch.where("path is not null"), lambda old, new, top: upsert_files(old, new, now, top=top))

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
