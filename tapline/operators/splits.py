"""Deterministic train, calibration and test splits (60/20/20), as a column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapline.operators import ordered

TRAIN, CALIBRATION = 0.60, 0.80


def _cut(position: Column, n: Column) -> Column:
    """Name of the part a 0-based position falls in."""
    first = F.greatest(F.lit(1), F.floor(n * TRAIN))
    second = F.greatest(first + 1, F.floor(n * CALIBRATION))
    return (F.when(position < first, F.lit("train")).when(position < second, F.lit("calibration"))
            .otherwise(F.lit("test")))


def temporal(df: DataFrame, time_us: str, row_id: str, chunk_us: int = 60_000_000) -> DataFrame:
    """Earliest 60 % train, next 20 % calibrate, rest test. Busy minutes are cut a thousandfold."""
    work = df.withColumns({"_chunk": F.floor(F.col(time_us) / chunk_us),
                           "_part": F.floor(F.col(time_us) / (chunk_us / 1000))})
    ranked = ordered.rank(work, ["_chunk", "_part"], [time_us, row_id], "_rank").drop("_chunk", "_part")
    n = df.agg(F.count(F.lit(1))).scalar()
    return ranked.withColumn("split", _cut(F.col("_rank") - 1, n)).drop("_rank")


def by_group(df: DataFrame, group: str, seed: int = 42) -> DataFrame:
    """Whole groups in rotated name order; a group goes where its first row falls, so none is cut."""
    sizes = df.groupBy(group).agg(F.count(F.lit(1)).alias("_n"))
    sizes = sizes.withColumn("_p", F.substring(F.col(group), 1, 2))
    named = ordered.running_totals(sizes, ["_p"], [group], {"_i": F.lit(1).cast("bigint"), "_upto": F.col("_n")})
    groups, rows = sizes.agg(F.count(F.lit(1))).scalar(), sizes.agg(F.sum("_n")).scalar()
    rotation = F.pmod(F.lit(seed), F.greatest(groups, F.lit(1)))
    start = F.col("_upto") - F.col("_n")
    # Groups before the rotation point move behind the rest.
    pivot = named.agg(F.coalesce(F.min(F.when(F.col("_i") - 1 >= rotation, start)), F.lit(0))).scalar()
    position = F.when(F.col("_i") - 1 >= rotation, start - pivot).otherwise(start + rows - pivot)
    placed = named.select(group, _cut(position, rows).alias("split"))
    return df.join(placed, group)


def stratified(df: DataFrame, label: str, row_id: str, seed: int = 42, chunks: int = 4096) -> DataFrame:
    """Both classes cut 60/20/20 in a seeded pseudo-random order."""
    h = F.xxhash64(F.col(row_id), F.lit(seed))
    work = df.withColumns({"_h": h, "_chunk": F.pmod(F.shiftright(h, 20), F.lit(chunks))})
    ranked = ordered.rank(work, ["_chunk"], ["_h", row_id], "_rank", (label,))
    sizes = df.groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    # One row per class.
    return (ranked.join(F.broadcast(sizes), label)
            .withColumn("split", _cut(F.col("_rank") - 1, F.col("_n"))).drop("_h", "_chunk", "_rank", "_n"))


def split_sizes(df: DataFrame) -> DataFrame:
    return df.groupBy("split").agg(F.count(F.lit(1)).alias("rows"))


