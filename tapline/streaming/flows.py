"""Flow sessions on a stream, with all columns of the batch.

A packet is judged when the watermark (newest packet less the lateness) has passed it; then it becomes part of a native
fragment, one per endpoint pair, slice and reset. Fragments of open flows are the state: at most one per slice of the
age limit and reset, however many packets a pair sends. The batch operators name the session of every
fragment. A flow is emitted when a later packet of its pair opened another one (idle gap, age sweep, reset), or when
the watermark passes its idle limit; `flush` emits the rest. State is read by batch number, so a repeated
batch gives the same rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.types import StructType

from tapline.config import DEFAULT, SECOND, Config
from tapline.operators import flows
from tapline.streaming.state import State

LATENESS_US = 6 * SECOND
WAITING = ["ts_us", "event_id", "src_ip", "dst_ip", "src_port", "dst_port", "protocol", "packet_len", "tcp_flags",
           "app_protocol", "tls_sni", "dns_query"]


def flow_batch(batch: DataFrame, path: str, batch_id: int, cfg: Config = DEFAULT, lateness_us: int = LATENESS_US,
               flush: bool = False, grace_us: int = 0) -> DataFrame:
    """Flows that end with one micro-batch; writes the state for the next.

    ``grace_us`` keeps idle flows open for so long beyond their limit.
    """
    state = State(batch.sparkSession, path, batch_id)
    clock = state.before("clock")
    clock = clock.first() if clock is not None else None
    rows = flows.with_fields(batch).select(*WAITING)
    if clock is not None and clock.due is not None:
        rows = rows.filter(F.col("ts_us") > clock.due)
    both = state.joined("rows", rows)
    newest = max((t for t in (both.agg(F.max("ts_us")).first()[0], clock and clock.newest) if t is not None), default=None)
    due = None if newest is None else newest if flush else newest - lateness_us
    if due is not None and clock is not None and clock.due is not None:
        due = max(due, clock.due)
    state.keep("clock", state.spark.createDataFrame([(newest, due)], "newest long, due long"))
    limit = -(1 << 62) if due is None else due
    state.keep("rows", both.filter(F.col("ts_us") > limit))
    frag = state.joined("open", flows.fragments(both.filter(F.col("ts_us") <= limit), cfg))
    aged = state.keep("fragments", flows.assigned(frag, cfg))
    per_key = Window.partitionBy(*flows.KEY).orderBy("_from")
    known = aged.groupBy(*flows.SESSION).agg(F.min("_open").alias("_from"), F.max("last_us").alias("_to"))
    # timers have millisecond resolution
    idle = F.floor((F.col("_to") + cfg.flow_idle_us) / 1000) + 1 <= F.lit((limit - grace_us) // 1000)
    ended = F.lead("_from").over(per_key).isNotNull() | idle | F.lit(flush)
    known = state.keep("sessions", known.withColumn("_ended", ended).select(*flows.SESSION, "_ended"))
    marked = aged.join(known, flows.SESSION)
    state.keep("open", marked.filter(~F.col("_ended")).drop("_base", "_flow_pane", "_ended"))
    return flows.sessions(marked.filter("_ended").drop("_ended"), cfg)


def flush(spark: SparkSession, schema: StructType, path: str, batch_id: int, cfg: Config = DEFAULT) -> DataFrame:
    """Flows still open after the last batch; ``batch_id`` is one more than the last."""
    return flow_batch(spark.createDataFrame([], schema), path, batch_id, cfg, flush=True)


def flows_writer(df: DataFrame, path: str, sink: Callable[[DataFrame, int], None], cfg: Config = DEFAULT,
                 lateness_us: int = LATENESS_US, grace_us: int = 0) -> DataStreamWriter:
    """Flows of a stream, handed to ``sink(flows, batch_id)``."""
    return df.writeStream.foreachBatch(lambda batch, i: sink(flow_batch(batch, path, i, cfg, lateness_us, grace_us=grace_us), i))
