"""Run a stream to the end of its input, and observe its health."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from tapline.session import scratch


def drain(df: DataFrame, name: str) -> DataFrame:
    """Process everything available into a table and return the table."""
    spark = df.sparkSession
    base = scratch(spark, name)
    query = (df.writeStream.format("parquet").outputMode("append").option("path", f"{base}/out")
             .option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start())
    query.awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{base}/out")


def drain_writer(writer, checkpoint: str) -> None:
    writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def observed(df: DataFrame, name: str = "stream_health") -> DataFrame:
    """Attach packet count and newest event as metrics of every micro-batch."""
    return df.observe(name, F.count(F.lit(1)).alias("packets_captured"), F.max("timestamp").alias("last_event"))


class Health(StreamingQueryListener):
    """Totals over micro-batches, for a health view."""

    def __init__(self, name: str = "stream_health") -> None:
        self.name, self.packets, self.last_event, self.rows_per_second = name, 0, None, 0.0

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        m = event.progress.observedMetrics.get(self.name)
        if m is not None:
            self.packets += m["packets_captured"]
            self.last_event = m["last_event"] or self.last_event
        self.rows_per_second = event.progress.processedRowsPerSecond

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass


def settled(health: Health, seconds: float = 5.0) -> Health:
    """Wait until the totals stand still: progress reaches listeners a moment after the query ended."""
    end, seen = time.monotonic() + seconds, None
    while time.monotonic() < end and (seen is None or health.packets != seen or not health.packets):
        seen = health.packets
        time.sleep(0.5)
    return health


def watch(spark: SparkSession, name: str = "stream_health") -> Health:
    listener = Health(name)
    spark.streams.addListener(listener)
    return listener
