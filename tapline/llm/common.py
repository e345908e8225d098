"""Shared expressions and small helpers of the corpus operators."""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from tapline.session import scratch

WORD = r"[^\x20\x09-\x0D]+"
#: Rows of an Arrow batch: documents may be long, so batches hold few of them.
BATCH_ROWS = 2000
BROADCAST_ROWS = 1_000_000
P61 = (1 << 61) - 1


def prepare(spark: SparkSession) -> None:
    """Small Arrow batches, and this package on the path of Python workers that run beside it."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    paths = spark.sparkContext.environment.get("PYTHONPATH", "").split(os.pathsep)
    if root not in paths:
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join([root, *filter(None, paths)])


def table(spark: SparkSession, sf_dir: str, name: str, *cols: str) -> DataFrame:
    """Columns of a supplied table."""
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*cols)


def saved(df: DataFrame, purpose: str, codec: str = "snappy", block: int | None = None) -> DataFrame:
    """Write below spark.checkpoint.dir and read back: cuts the lineage and survives lost executors.

    ``block`` bounds the bytes of a row group, for tables of large rows.
    """
    path = scratch(df.sparkSession, purpose)
    writer = df.write.option("compression", codec)
    (writer.option("parquet.block.size", block) if block else writer).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fitting(df: DataFrame, rows: int = BROADCAST_ROWS, counted: int | None = None) -> DataFrame:
    """A stored table of a few numbers a row, broadcast if it has at most ``rows`` rows; else the join shuffles."""
    n = df.limit(rows + 1).count() if counted is None else counted
    return F.broadcast(df) if n <= rows else df


def struct_of(df: DataFrame, columns: tuple[str, ...]) -> StructType:
    return StructType([df.schema[c] for c in columns])


def shared_folder(spark: SparkSession, purpose: str) -> str:
    return scratch(spark, purpose)


def fold(n: int, doc_id: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo n; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % n


def texts_of(batch: pa.RecordBatch, name: str = "text") -> list[bytes]:
    """The texts of a batch as UTF-8 bytes; null is empty."""
    return [x or b"" for x in batch.column(name).cast(pa.binary()).to_pylist()]


def mapped(df: DataFrame, fn, schema: str, carried: StructType | None = None) -> DataFrame:
    """mapInArrow with ``fn(batch) -> dict of columns`` (or None for no rows), columns as in ``schema``.

    ``carried`` is the type of a struct column _carry that passes through as it is.
    """
    shape = StructType.fromDDL(schema)
    if carried is not None:
        shape = shape.add("_carry", carried)
    fields = to_arrow_schema(shape)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows and (cols := fn(batch)) is not None:
                yield pa.RecordBatch.from_arrays(
                    [c if isinstance(c, pa.Array) else pa.array(c, f.type)
                     for f, c in ((f, cols[f.name]) for f in fields)], schema=fields)

    return df.mapInArrow(run, shape)


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit moves every output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))
