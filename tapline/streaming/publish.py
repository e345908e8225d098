"""Several tables per micro-batch, published together, and subscribers that hear of each batch once.

The tables of a batch are written first, each in its folder; then one commit record makes all of them visible. Readers
take committed batches only. Subscribers are called after the commit, and a record per subscriber keeps a repeated
batch from calling it again; a subscriber that raised is called again when the batch repeats, and does not stop the stream.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from tapline.sources.keyed import _exists, _numbers

Tables = dict[str, Callable[[DataFrame], DataFrame]]
Subscribers = dict[str, Callable[[DataFrame], None]]


def _record(spark: SparkSession, path: str, batch_id: int) -> None:
    spark.range(1).select(F.lit(batch_id).alias("batch"), F.current_timestamp().alias("at")).coalesce(1).write.mode("overwrite").parquet(path)


def publish(batch: DataFrame, batch_id: int, path: str, tables: Tables, subscribers: Subscribers | None = None) -> None:
    """Write, commit, notify."""
    spark = batch.sparkSession
    batch = batch.persist()
    try:
        for name, build in tables.items():
            build(batch).write.mode("overwrite").parquet(f"{path}/{name}/batch={batch_id}")
        _record(spark, f"{path}/_commits/batch={batch_id}", batch_id)
        for name, call in (subscribers or {}).items():
            told = f"{path}/_told/{name}/batch={batch_id}"
            if _exists(spark, f"{told}/_SUCCESS"):
                continue
            try:
                call(batch)
            except Exception:  # noqa: BLE001, S112  (subscribers must not stop the stream)
                continue
            _record(spark, told, batch_id)
    finally:
        batch.unpersist()


def committed(spark: SparkSession, path: str) -> list[int]:
    return [b for b in _numbers(spark, f"{path}/_commits", "batch") if _exists(spark, f"{path}/_commits/batch={b}/_SUCCESS")]


def published(spark: SparkSession, path: str, name: str) -> DataFrame | None:
    """Rows of a table from all committed batches."""
    batches = committed(spark, path)
    return spark.read.option("basePath", f"{path}/{name}").parquet(*[f"{path}/{name}/batch={b}" for b in batches]) if batches else None


def publisher(df: DataFrame, path: str, tables: Tables, subscribers: Subscribers | None = None) -> DataStreamWriter:
    return df.writeStream.foreachBatch(lambda batch, i: publish(batch, i, path, tables, subscribers))
