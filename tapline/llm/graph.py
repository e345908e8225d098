"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from tapline.llm.common import BROADCAST_ROWS, saved

SALTS = 64


def _star(edges: DataFrame, large: bool, small: bool = False) -> DataFrame:
    """Every node hands its smallest neighbour to its larger (or, small star, its smaller) neighbours; rows may repeat.

    ``small`` says that the nodes fit a broadcast, so that the edges stay where they are.
    """
    both = edges.select(F.col("u").alias("a"), F.col("v").alias("b"))
    if large:
        both = both.union(edges.select("v", "u"))
    if small:
        least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        out = both.join(F.broadcast(least), "a")
    else:
        # edges of a node meet in SALTS parts, so that the root of a large family is the work of many tasks
        both = both.withColumn("_salt", F.pmod(F.xxhash64("b"), F.lit(SALTS)))
        parts = both.groupBy("a", "_salt").agg(F.min("b").alias("m"))
        least = parts.groupBy("a").agg(F.min("m").alias("m")).withColumn("m", F.least("a", "m"))
        out = both.join(parts.select("a", "_salt").join(least, "a"), ["a", "_salt"])
    if large:
        out = out.filter("b > a").select(F.col("b").alias("u"), F.col("m").alias("v"))
    else:
        out = out.select(F.col("b").alias("u"), F.col("m").alias("v")).union(least.select("a", "m"))
    return out.filter("u > v")


def components(edges: DataFrame) -> DataFrame:
    """node, root (the smallest node of its component) for every node of the edges (u, v)."""
    first = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u > v").distinct()
    now, before = saved(first, "components"), None
    while True:
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            roots = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
            return roots.union(roots.select("root", "root")).distinct()
        before = state
        small = 2 * state[0] <= BROADCAST_ROWS
        now = saved(_star(_star(now, True, small), False, small).distinct(), "components")


def streamed_groups(df: DataFrame, keys: list[str], fn: Callable[[list[tuple]], list[tuple]], schema: str) -> DataFrame:
    """``fn(rows of one key) -> output rows``; rows arrive sorted, one group in memory at a time."""
    names = df.columns
    n, out_schema = len(keys), to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def emit(rows: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*rows)) if rows else [[] for _ in out_schema]
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, out_schema)], schema=out_schema)

        key, group, done = None, [], []
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in names)):
                if row[:n] != key:
                    if group:
                        done += fn(group)
                    key, group = row[:n], []
                group.append(row)
            if done:
                yield emit(done)
                done = []
        yield emit(done + (fn(group) if group else []))

    return df.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, schema)


def forest(pairs: Iterator[tuple[int, int]], parent: dict[int, int] | None = None) -> list[tuple[int, int]]:
    """The pairs that join trees: a spanning forest of the links a task has found."""
    parent = {} if parent is None else parent

    def root(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out = []
    for a, b in pairs:
        ra, rb = root(a), root(b)
        if ra != rb:
            parent[ra] = rb
            out.append((a, b))
    return out
