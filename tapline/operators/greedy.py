"""Greedy choices along time: a chosen row shuts out those of its key that follow within a step.

Rows of a key come sorted to one task and pass through it as a stream that remembers the last choice only, so a chain
of any length takes constant memory; inside a batch the next choice is found by binary search. Callers hand over at
most one row per key and grid interval, however heavy the key's traffic.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def picks(times: np.ndarray, step: int, last: int | None) -> list[int]:
    """Positions chosen in ascending ``times`` after a choice at ``last``."""
    out = []
    at = 0 if last is None else int(np.searchsorted(times, last + step))
    while at < len(times):
        out.append(at)
        at = max(at + 1, int(np.searchsorted(times, times[at] + step)))
    return out


def spaced(rows: DataFrame, keys: list[str], at: str, step: int) -> DataFrame:
    """The rows (distinct by ``keys`` and ``at``) chosen: the first of a key, then the first at least ``step`` later, and so on."""
    order = rows.withColumn("_key", F.to_json(F.struct(*keys), {"ignoreNullFields": "false"}))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, last = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            times = np.asarray(batch.column(at))
            runs = pc.run_end_encode(batch.column("_key"))
            chosen, start = [], 0
            for name, end in zip(runs.values.to_pylist(), runs.run_ends.to_pylist()):
                found = picks(times[start:end], step, last if name == key else None)
                if found:
                    last = int(times[start + found[-1]])
                elif name != key:
                    last = None
                key = name
                chosen += [start + i for i in found]
                start = end
            if chosen:
                yield batch.take(pa.array(chosen, pa.int64())).drop_columns(["_key"])

    return order.repartition(*keys).sortWithinPartitions("_key", at).mapInArrow(run, rows.schema)
