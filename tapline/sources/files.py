"""Files of any size through the line reader: digests without a file in memory, and JSON arrays read by many tasks.

Lines arrive with their file, the start of their split and their place in it, which is a total order per file however
the splits were dealt to tasks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tapline.operators import ordered
from tapline.session import tasks_for

BOM = b"\xef\xbb\xbf"
CHUNK_LINES = 1 << 14  # lines of a split over which running totals are taken together
LINES_A_TASK = 1 << 18


def lines(spark: SparkSession, path: str) -> DataFrame:
    """file, block, pos, value: lines cut at line feeds only, in order of (block, pos) per file."""
    raw = spark.read.option("lineSep", "\n").text(path)
    return raw.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
                      F.monotonically_increasing_id().alias("pos"), F.col("_metadata.file_size").alias("bytes"), "value")


def digests(spark: SparkSession, path: str) -> DataFrame:
    """path, bytes and SHA-256 of every file; a task holds a batch of lines, never a file.

    A line end after the last line, and a byte order mark, which the reader takes away, are known from the file's size.
    A single line must stay below two gigabytes. Spark lists no empty files, so they have no row.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name = None

        def done() -> pa.RecordBatch:
            for mark, h in ((0, plain), (len(BOM), marked)):
                for end in (b"", b"\n"):
                    if seen + mark + len(end) == size:
                        h.update(end)
                        return pa.RecordBatch.from_pydict({"file": [name], "bytes": [size], "sha256": [h.hexdigest()]})
            raise ValueError(f"{name}: {seen} bytes read of {size}")

        for batch in batches:
            for file, total, value in zip(batch.column("file").to_pylist(), batch.column("bytes").to_pylist(),
                                          batch.column("value").to_pylist()):
                if file != name:
                    if name is not None:
                        yield done()
                    name, size, seen = file, total, 0
                    plain, marked = hashlib.sha256(), hashlib.sha256(BOM)
                else:
                    value = b"\n" + value
                seen += len(value)
                plain.update(value)
                marked.update(value)
        if name is not None:
            yield done()

    rows = lines(spark, path).withColumn("value", F.col("value").cast("binary"))
    sums = rows.repartition("file").sortWithinPartitions("file", "block", "pos").select("file", "bytes", "value").mapInArrow(
        run, "file string, bytes long, sha256 string")
    return sums.select(F.try_url_decode(F.regexp_replace("file", r"\+", "%2B")).alias("path"), "bytes", "sha256")


def _depth(value: Column) -> Column:
    """What a line adds to the nesting depth; brackets inside strings do not count."""
    bare = F.regexp_replace(value, r'"(\\.|[^"\\])*"', "")
    return (F.length(F.regexp_replace(bare, r"[^\[{]", "")) - F.length(F.regexp_replace(bare, r"[^\]}]", ""))).cast("bigint")


def json_elements(spark: SparkSession, path: str) -> DataFrame:
    """One variant `element` per element of the array that a file holds, or per top-level document of a file without one.

    A file may be read by many tasks. Lines that begin inside an element belong to the line that opened it; depths are running
    totals over splits, chunks of their lines, and lines. An element is gathered in one task, and so is a line that holds several.
    """
    rows = lines(spark, path).withColumn("chunk", F.shiftright("pos", CHUNK_LINES.bit_length() - 1))
    tasks = tasks_for(rows, LINES_A_TASK)
    rows = rows.filter(F.trim("value") != "").withColumn("_d", _depth(F.col("value"))).repartition(tasks, "file", "block", "chunk")
    first = rows.groupBy("file").agg(F.min_by(F.substring(F.ltrim("value"), 1, 1), F.struct("block", "pos")).alias("_root"))
    rows = ordered.running_totals(rows, ["block", "chunk"], ["pos"], {"_after": F.col("_d")}, ("file",)).join(first, "file")
    inside = F.when(F.col("_root") == "[", F.lit(1)).otherwise(F.lit(0))
    rows = rows.withColumn("_opens", F.when(F.col("_after") - F.col("_d") <= inside, F.lit(1)).otherwise(F.lit(0)).cast("bigint"))
    rows = ordered.running_totals(rows, ["block", "chunk"], ["pos"], {"_group": F.col("_opens")}, ("file",))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "pos", "value"))), lambda r: r["value"]), "\n")
    groups = rows.repartition(tasks, "file", "_group").groupBy("file", "_group").agg(
        text.alias("t"), F.min_by(F.col("_after") - F.col("_d"), F.struct("block", "pos")).alias("_before"),
        F.max_by("_after", F.struct("block", "pos")).alias("_end"), F.first("_root").alias("_root"))
    array = F.col("_root") == "["
    t = F.trim(F.regexp_replace("t", r"^\s+|\s+$", ""))
    t = F.when(array & (F.col("_before") == 0), F.regexp_replace(t, r"^\[\s*", "")).otherwise(t)
    t = F.when(array & (F.col("_end") == 0), F.regexp_replace(t, r"\s*\]$", "")).otherwise(t)
    t = F.regexp_replace(t, r"^,\s*|\s*,$", "")
    many = F.try_parse_json(F.concat(F.lit("["), t, F.lit("]")))
    return groups.select(F.explode(F.try_variant_get(many, "$", "array<variant>")).alias("element"))
