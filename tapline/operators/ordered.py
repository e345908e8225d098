"""Running values along a total order without ordering the whole table in one task.

Rows are cut into chunks along the order; each chunk is summarised with map-side combine, the
summaries (one row per chunk) are scanned, and the scan result is joined back to the rows of its
chunk. Only chunk summaries ever meet in one task.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapline.session import materialise


def running_totals(df: DataFrame, levels: list[str], order: list, sums: dict[str, Column],
                   keys: tuple[str, ...] = ()) -> DataFrame:
    """Add inclusive running totals of ``sums`` in the order (levels..., order...).

    ``levels`` are chunk columns from coarse to fine, ascending. A finer level splits chunks that a
    coarser one leaves too large, such as a single frequent score.
    """
    work = df.withColumns({f"_v_{n}": c for n, c in sums.items()})
    totals = {}
    for depth in range(len(levels), 0, -1):
        src = work if depth == len(levels) else totals[depth + 1]
        totals[depth] = src.groupBy(*keys, *levels[:depth]).agg(*[F.sum(f"_v_{n}").alias(f"_v_{n}") for n in sums])
    offsets = None
    for depth in range(1, len(levels) + 1):
        w = (Window.partitionBy(*keys, *levels[:depth - 1]).orderBy(levels[depth - 1])
             .rowsBetween(Window.unboundedPreceding, 0))
        here = totals[depth].select(*keys, *levels[:depth], *[
            (F.sum(f"_v_{n}").over(w) - F.col(f"_v_{n}")).alias(f"_o_{n}") for n in sums])
        if offsets is not None:
            up = offsets.select(*keys, *levels[:depth - 1], *[F.col(f"_o_{n}").alias(f"_u_{n}") for n in sums])
            here = here.join(up, [*keys, *levels[:depth - 1]]).select(*keys, *levels[:depth], *[
                (F.col(f"_o_{n}") + F.col(f"_u_{n}")).alias(f"_o_{n}") for n in sums])
        offsets = here
    inside = (Window.partitionBy(*keys, *levels).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    work = work.withColumns({f"_v_{n}": F.sum(f"_v_{n}").over(inside) for n in sums})
    joined = work.join(offsets, [*keys, *levels])
    return joined.withColumns({n: F.col(f"_v_{n}") + F.col(f"_o_{n}") for n in sums}).drop(
        *[f"_v_{n}" for n in sums], *[f"_o_{n}" for n in sums])


def rank(df: DataFrame, levels: list[str], order: list, out: str = "rank", keys: tuple[str, ...] = ()) -> DataFrame:
    """1-based position in the order (levels..., order...)."""
    return running_totals(df, levels, order, {out: F.lit(1).cast("bigint")}, keys)


def previous(df: DataFrame, chunk: str, order: str, cols: dict[str, str], keys: tuple[str, ...] = ()) -> DataFrame:
    """Add the preceding row's values (``{new name: column}``) in the order of ``order``."""
    tails = df.groupBy(*keys, chunk).agg(*[F.max_by(c, order).alias(f"_t_{n}") for n, c in cols.items()])
    w = Window.partitionBy(*keys).orderBy(chunk)
    tails = tails.select(*keys, chunk, *[F.lag(f"_t_{n}").over(w).alias(f"_t_{n}") for n in cols])
    inside = Window.partitionBy(*keys, chunk).orderBy(order)
    out = df.withColumn("_first", F.row_number().over(inside) == 1).withColumns(
        {n: F.lag(c).over(inside) for n, c in cols.items()})
    out = out.join(tails, [*keys, chunk])
    return out.withColumns({n: F.when(F.col("_first"), F.col(f"_t_{n}")).otherwise(F.col(n)) for n in cols}).drop(
        "_first", *[f"_t_{n}" for n in cols])


def decayed(df: DataFrame, keys: tuple[str, ...], rank_col: str, values: dict[str, Column], decay: float,
            store: Callable[[DataFrame, str], DataFrame] = materialise) -> DataFrame:
    """Add, per name, y with y_n = decay * y_(n-1) + value_n and y_0 = 0, in rank order per key (1, 2, ... without holes).

    Inside a chunk of ranks y is a running sum of scaled values. Chunk ends follow the same recurrence with
    decay ** size, so they take the same scan, up to two thousand times shorter, until what a chunk inherits
    from all but its predecessor is far below the last digit of a double. All names share the scans. ``store(rows,
    name)`` writes the chunk ends, so that the levels above do not repeat the scan.
    """
    if decay < 1e-30:  # what lies two steps back weighs less than 1e-60
        work = df.withColumns({**{f"_x_{n}": c for n, c in values.items()}, "_c": F.floor(F.col(rank_col) / 4096)})
        work = previous(work, "_c", rank_col, {f"_p_{n}": f"_x_{n}" for n in values}, keys)
        work = work.withColumns({n: F.col(f"_x_{n}") + F.lit(decay) * F.coalesce(f"_p_{n}", F.lit(0.0)) for n in values})
        return work.drop("_c", *[f"_x_{n}" for n in values], *[f"_p_{n}" for n in values])
    size = max(1, min(2048, int(600 / -math.log(decay))))
    i = F.pmod(F.col(rank_col) - 1, F.lit(size)).cast("int") + 1
    work = df.withColumns({"_chunk": F.floor((F.col(rank_col) - 1) / size) + 1, "_i": i,
                           **{f"_x_{n}": c for n, c in values.items()}})
    work = work.withColumns({"_up": F.pow(F.lit(decay), -F.col("_i")), "_down": F.pow(F.lit(decay), F.col("_i"))})
    inside = (Window.partitionBy(*keys, "_chunk").orderBy(rank_col).rowsBetween(Window.unboundedPreceding, 0))
    work = work.withColumns({f"_x_{n}": F.sum(F.col(f"_x_{n}") * F.col("_up")).over(inside) * F.col("_down") for n in values})
    ends = work.groupBy(*keys, "_chunk").agg(F.max_by(F.struct(*[F.col(f"_x_{n}").alias(n) for n in values]), "_i").alias("_end"))
    ends = store(ends.select(*keys, F.col("_chunk").alias("_rank"), "_end"), f"ends-{size}-{decay:.3g}")
    carries = decayed(ends, keys, "_rank", {f"_y_{n}": F.col("_end")[n] for n in values}, decay ** size, store).select(
        *keys, (F.col("_rank") + 1).alias("_chunk"), *[f"_y_{n}" for n in values])
    out = work.join(carries, [*keys, "_chunk"], "left").withColumns({
        n: F.col(f"_x_{n}") + F.coalesce(f"_y_{n}", F.lit(0.0)) * F.col("_down") for n in values})
    return out.drop("_chunk", "_i", "_up", "_down", *[f"_x_{n}" for n in values], *[f"_y_{n}" for n in values])
