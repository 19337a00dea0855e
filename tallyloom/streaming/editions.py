"""Streams: windows over events with late data, and new editions compared as their files arrive. An extension, not part of the registers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.editions import compare


def event_windows(events: DataFrame, size: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """event_type, window_start, n, total by tumbling windows; events later than the watermark are dropped. Works on streams and tables."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select("event_type", F.col("w.start").alias("window_start"), "n", "total")


def watch_editions(stream: DataFrame, base: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Compare each arriving batch of panel rows with base and append the flows to out. Only what is there is taken, then the query ends."""

    def each(batch: DataFrame, number: int) -> None:
        # a batch that is tried again replaces its own folder
        compare(base, batch).withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
