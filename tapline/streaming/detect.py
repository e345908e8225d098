"""Per-event detection on a stream.

Each micro-batch runs the batch operators on its rows together with the rows of the preceding
horizon. The carried rows are a table with one folder per batch: batch n reads folder n - 1 and
replaces folder n, so a repeated batch gives the same result and no executor holds state; older
folders are removed. A hot source is split into time chunks exactly as in batch.

Without ``lateness_us`` a batch reports the signals of its own rows at once, which equals the batch result for rows
in event order. With it, rows are judged when the watermark (newest event minus lateness) has passed them, rows behind
the watermark are dropped, and `flush` judges the rest: the result equals the batch result for any arrival within the lateness.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.types import StructType

from tapline.config import DEFAULT, Config
from tapline.operators import behaviors, intel, signatures

CARRIED = ["ts_us", "event_id", "src_ip", "dst_ip", "src_port", "dst_port", "protocol", "tcp_flags"]


def _carry_path(state: str, batch_id: int) -> str:
    return f"{state}/carry/batch={batch_id}"


def _carried(batch: DataFrame, state: str, batch_id: int) -> DataFrame:
    spark = batch.sparkSession
    if batch_id == 0:
        return batch.select(*CARRIED).limit(0)
    return spark.read.schema(batch.select(*CARRIED).schema).parquet(_carry_path(state, batch_id - 1))


def _remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def behaviour_batch(batch: DataFrame, state: str, batch_id: int, cfg: Config = DEFAULT, lateness_us: int | None = None,
                    flush: bool = False) -> DataFrame:
    """Signals due with one micro-batch; writes the carry for the next."""
    horizon = max(cfg.port_scan_us, cfg.host_sweep_us, cfg.beacon_us, cfg.rst_storm_us)
    carry = _carried(batch, state, batch_id)
    rows = batch.select(*CARRIED)
    if lateness_us is not None:
        seen = carry.agg(F.max("ts_us")).first()[0]
        passed = seen - lateness_us if seen is not None else None
        if passed is not None:
            rows = rows.filter(F.col("ts_us") > passed)
    both = carry.unionByName(rows)
    newest = both.agg(F.max("ts_us")).first()[0]
    if newest is None:
        both.write.mode("overwrite").parquet(_carry_path(state, batch_id))
        return behaviors.behavioural_signals(both, cfg)
    due = newest - (lateness_us or 0)
    both.filter(F.col("ts_us") > due - horizon - 1).write.mode("overwrite").parquet(_carry_path(state, batch_id))
    if batch_id > 1:
        _remove(batch.sparkSession, _carry_path(state, batch_id - 2))
    found = behaviors.behavioural_signals(both, cfg)
    if lateness_us is None:
        # A signal belongs to this batch when its row does.
        return found.join(rows.select("event_id").distinct(), "event_id", "left_semi")
    if passed is not None:
        found = found.filter(F.col("ts_us") > passed)
    return found if flush else found.filter(F.col("ts_us") <= due)


def flush(spark: SparkSession, schema: StructType, state: str, batch_id: int, lateness_us: int, cfg: Config = DEFAULT) -> DataFrame:
    """Behaviour signals of the rows that still wait after the last batch; ``batch_id`` is one more than the last."""
    return behaviour_batch(spark.createDataFrame([], schema), state, batch_id, cfg, lateness_us, flush=True)


def signals_writer(df: DataFrame, state: str, sink: Callable[[DataFrame, int], None],
                   verdicts: DataFrame | None = None, cfg: Config = DEFAULT, lateness_us: int | None = None) -> DataStreamWriter:
    """Signature, behaviour and reputation signals of a stream, handed to ``sink(signals, batch_id)``."""

    def run(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()  # read once, used by every rule
        out = signatures.signature_signals(batch).unionByName(behaviour_batch(batch, state, batch_id, cfg, lateness_us))
        if verdicts is not None:
            out = out.unionByName(intel.intel_signals(batch, verdicts))
        sink(out, batch_id)
        batch.unpersist()

    return df.writeStream.foreachBatch(run)


def fan_out(df: DataFrame, path: str, tables: dict[str, Callable[[DataFrame], DataFrame]],
            subscribers: list[Callable[[DataFrame], None]] | None = None) -> DataStreamWriter:
    """Write several tables per micro-batch, then call subscribers; a failing subscriber is ignored."""

    def run(batch: DataFrame, batch_id: int) -> None:
        for name, build in tables.items():
            build(batch).write.mode("overwrite").parquet(f"{path}/{name}/batch={batch_id}")
        for call in subscribers or []:
            try:
                call(batch)
            except Exception:  # noqa: BLE001  (subscribers must not stop the stream)
                pass

    return df.writeStream.foreachBatch(run)
