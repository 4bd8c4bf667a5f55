"""A folder kept in the index, and windows over event streams.

Spark's file source never gives a changed or deleted file again, so the folder
is listed in every micro-batch and compared with the stored fingerprints,
which are the only state: a batch that runs twice changes nothing.
"""

import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.loaders import scan
from ..sources.store import Store, fingerprints


def settled(files: DataFrame, before: DataFrame, quiet: float) -> DataFrame:
    """files with those changed in the last `quiet` seconds as they were before, or left out if they are new."""
    limit = F.lit(datetime.datetime.now(datetime.UTC) - datetime.timedelta(seconds=quiet))
    fresh = files.filter(F.col("modified") > limit).select("path")
    return files.filter(F.col("modified") <= limit).unionByName(before.join(fresh, "path", "left_semi").select(*files.columns))


def sync_folder(store: Store, root: str, index, extensions: list[str] | None = None, quiet: float = 0.5, model: str | None = None) -> dict[str, int]:
    """One comparison of the folder with the index; index maps scan() rows to chunks with source_id = path."""
    files = scan(store.spark, root, extensions)
    now = settled(fingerprints(files), store.table("fingerprints"), quiet)
    return store.sync(now, lambda fresh: index(files.join(fresh.select("path"), "path", "left_semi")), model)


def watch(spark: SparkSession, store: Store, root: str, index, extensions: list[str] | None = None, quiet: float = 0.5, every: str = "5 seconds", checkpoint: str | None = None, model: str | None = None):
    """A streaming query that runs sync_folder() in each micro-batch, until it is stopped."""

    def batch(_: DataFrame, number: int) -> None:
        sync_folder(store, root, index, extensions, quiet, model)

    ticks = spark.readStream.format("rate").option("rowsPerSecond", 1).load()
    writer = ticks.writeStream.foreachBatch(batch).trigger(processingTime=every)
    return (writer.option("checkpointLocation", checkpoint) if checkpoint else writer).start()


def event_windows(events: DataFrame, size: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(window_start, event_type, n, total) over tumbling windows of ts; on a stream rows later than `late` are dropped."""
    if events.isStreaming:
        events = events.withWatermark("ts", late)
    rows = events.groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return rows.select(F.col("w.start").alias("window_start"), "event_type", "n", "total")
