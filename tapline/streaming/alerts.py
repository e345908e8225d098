"""The window path on a stream: slots, features, scores, risk, persistence and alerts.

An event is judged once, when the watermark (newest event less the lateness, moved down to the slide grid) has passed
it. Until then it waits as a row; then it becomes part of one slot and one slide interval, which are complete at that
moment and never change. Windows whose end the watermark has passed are put together from slots by the batch operators,
so a closed window has the columns and values of the batch. Between micro-batches there remain: rows not yet
judged, slots and value counts of one window length, event times of one window length (for spectra beyond the array
bound), the online model's means, the last scores of keys that scored high, and the newest emission of keys in
cool-down. `flush` judges what waits after the last batch and, if asked, emits the windows that were not yet due.

Rows behind the watermark are dropped, and counted in `clock`. The state is read by batch number, so repeating a batch,
or the flush, gives the same rows again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.types import StructType

from tapline.config import DEFAULT, Config
from tapline.operators import baseline, features, persistence, windows
from tapline.plans import window_alerts
from tapline.session import tasks_for
from tapline.streaming.state import State

#: What a waiting row must keep; absent columns stay absent.
WAITING = ["ts_us", "event_id", "src_ip", "dst_ip", "src_port", "dst_port", "protocol", "packet_len", "ttl", "ip_id", "ip_flags",
           "tcp_flags", "dscp", "payload_hex", "data_source", "asset_id", "altered", "spoofed"]


def closed_features(batch: DataFrame, state: State, cfg: Config = DEFAULT, lateness_us: int | None = None, group_cols: tuple[str, ...] = (),
                    flush: bool = False, emit_partial: bool = False) -> tuple[DataFrame, int]:
    """(feature rows of the windows that close with this micro-batch, the watermark after it)."""
    late = cfg.window_us + cfg.slide_us if lateness_us is None else lateness_us
    clock = state.before("clock")
    clock = clock.first() if clock is not None else None
    rows = batch.select(*[c for c in dict.fromkeys([*WAITING, *group_cols]) if c in batch.columns])
    behind = 0
    if clock is not None and clock.due is not None:
        behind = rows.filter(F.col("ts_us") <= clock.due).count()
        rows = rows.filter(F.col("ts_us") > clock.due)
    both = state.joined("rows", rows)
    newest = max((t for t in (both.agg(F.max("ts_us")).first()[0], clock and clock.newest) if t is not None), default=None)
    due = None
    if newest is not None:
        reach = newest if flush else newest - late
        due = (reach - cfg.origin_us) // cfg.slide_us * cfg.slide_us + cfg.origin_us
        due = due if clock is None or clock.due is None else max(due, clock.due)
    judged_to = (1 << 62) if flush else due if due is not None else -(1 << 62)
    state.keep("clock", state.spark.createDataFrame(
        [(newest, due, (clock.late if clock else 0) + behind)], "newest long, due long, late long"))
    judged = both.filter(F.col("ts_us") <= judged_to)
    state.keep("rows", both.filter(F.col("ts_us") > judged_to))
    begun = clock.due if clock is not None and clock.due is not None else -(1 << 62)

    def held(name: str, new: DataFrame, alive: Column) -> DataFrame:
        """What open windows still need of the preceding batches, with what this one adds; written before it is read twice."""
        old = state.before(name)
        return state.keep(name, new if old is None else old.filter(alive).unionByName(new))

    n = tasks_for(judged)
    slots = held("slots", windows.slots(judged, cfg, group_cols, times=True, tasks=n), windows.last_end(windows.pane_of_slot(F.col("slot"), cfg), cfg) > begun)
    panes = held("panes", windows.pane_counts(judged, cfg, group_cols, tasks=n), windows.last_end(F.col("pane"), cfg) > begun)
    times = held("times", judged.select(*group_cols, "ts_us", "event_id"), F.col("ts_us") > begun - cfg.window_us)
    horizon = due if due is not None else -(1 << 62)
    ends_at = (1 << 62) if flush and emit_partial else horizon
    fresh = (F.col("window_end") > begun) & (F.col("window_end") <= ends_at)
    w = features.combine_slots(slots, cfg, group_cols, times=True, tasks=n).filter(fresh)
    counted, protocols = panes.filter("field <> 'proto'").drop("seen"), panes.filter("field = 'proto'")
    v = features.value_features(windows.window_counts(counted, cfg, group_cols, n).filter(fresh),
                                windows.window_counts(protocols, cfg, group_cols).filter(fresh), group_cols)
    out = features.feature_columns(w.join(v, [*group_cols, "window_end"]), times, cfg, group_cols)
    return state.keep("features", out.orderBy(*group_cols, "window_end")), horizon


def assessed_batch(batch: DataFrame, path: str, batch_id: int, cfg: Config = DEFAULT, lateness_us: int | None = None,
                   group_cols: tuple[str, ...] = (), flush: bool = False, emit_partial: bool = False) -> DataFrame:
    """Windows that close with one micro-batch, scored, with risk and `persistent`; writes the state for the next."""
    state = State(batch.sparkSession, path, batch_id)
    f, horizon = closed_features(batch, state, cfg, lateness_us, group_cols, flush, emit_partial)
    distance, means = baseline.continued_distance(f, state.before("means"), cfg, group_cols, lambda df, name: state.keep(name, df))
    state.keep("means", means)
    scored = window_alerts.assessed(f.join(distance, [*group_cols, "window_end"]), F.col("kitsune"), cfg)
    scored = state.keep("assessed", scored.drop("kitsune"))
    marked, recent, emitted = persistence.continued(scored, state.before("recent"), state.before("emitted"), horizon, "src_ip", cfg)
    state.keep("recent", recent)
    state.keep("emitted", emitted)
    return marked


def alert_batch(batch: DataFrame, path: str, batch_id: int, verdicts: DataFrame | None = None, cfg: Config = DEFAULT,
                lateness_us: int | None = None, flush: bool = False, emit_partial: bool = False) -> DataFrame:
    """Alerts of the windows that close with one micro-batch."""
    return window_alerts.alert_rows(assessed_batch(batch, path, batch_id, cfg, lateness_us, (), flush, emit_partial), verdicts, cfg)


def flush(spark: SparkSession, schema: StructType, path: str, batch_id: int, verdicts: DataFrame | None = None, cfg: Config = DEFAULT,
          lateness_us: int | None = None, emit_partial: bool = False) -> DataFrame:
    """Alerts of what waits after the last batch; ``batch_id`` is one more than the last.

    Windows that end after the newest event come only with ``emit_partial``.
    """
    return alert_batch(spark.createDataFrame([], schema), path, batch_id, verdicts, cfg, lateness_us, True, emit_partial)


def alerts_writer(df: DataFrame, path: str, sink: Callable[[DataFrame, int], None], verdicts: DataFrame | None = None,
                  cfg: Config = DEFAULT, lateness_us: int | None = None) -> DataStreamWriter:
    """Window alerts of a stream, handed to ``sink(alerts, batch_id)``."""
    return df.writeStream.foreachBatch(lambda batch, i: sink(alert_batch(batch, path, i, verdicts, cfg, lateness_us), i))
