"""Mixing sources to target weights, with DataFrame functions only.

Rows get a hash-random key; within a source they are ranked by it through (source, key chunk) prefix sums, so
a source that owns a third of all rows is spread over thousands of chunks. A source's budget is cut exactly:
whole epochs for every document, then the remainder along the random order, the last document in part.

Defined results: a null text has size 0 and takes 0; a null source is a source (ordered last); a null doc_id is a
value like any other; rows that are equal in all columns may swap their results; an empty table gives an empty
table; extra columns of any name are ignored unless named in ``carry``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tapline.llm.common import WORD, saved, table

CHUNK_DIGITS = 3  # leading hex digits of the key: 4,096 chunks a source


def sized(docs: DataFrame, seed: str = "mix", carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, source, size, random key, and the columns of ``carry`` as one struct; written once."""
    kept = [F.struct(*carry).alias("_carry")] if carry else []
    return saved(docs.select(
        "doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("bigint").alias("size"),
        F.md5(F.concat_ws("|", F.lit(seed), F.col("doc_id").cast("string"), "source", "text")).alias("_key"), *kept), "mix", "zstd")


def targets(rows: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """source, source_size, target: weights shared out, no target above cap x its source (water level over sources)."""
    sums = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    in_order = Window.orderBy(F.col("source").asc_nulls_last())
    turn = F.pmod(F.row_number().over(in_order) - 1, F.lit(len(weights))) + 1
    sums = sums.withColumn("_w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), turn.cast("int")))
    sums = sums.withColumns({"_cap": F.col("source_size") * F.lit(cap), "_all": F.sum("source_size").over(Window.partitionBy())
                             * F.lit(share)}).withColumn("_full_at", F.col("_cap") / F.col("_w"))
    by_level = Window.orderBy("_full_at", F.col("source").asc_nulls_last())
    below = F.coalesce(F.sum("_cap").over(by_level.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("_w").over(by_level.rowsBetween(0, Window.unboundedFollowing))
    sums = sums.withColumn("_level", (F.col("_all") - below) / rest)
    level = F.min(F.when(F.col("_level") <= F.col("_full_at"), F.struct("_full_at", "source", "_level"))).over(Window.partitionBy())
    level = F.coalesce(level["_level"], F.max("_full_at").over(Window.partitionBy()))
    return sums.select("source", "source_size", F.least("_cap", level * F.col("_w")).alias("target"))


def mix(rows: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """Add source_size, target and taken (words the mix takes of the document) to rows of ``sized``."""
    # plain keys that tell null from empty, so that the join and the window share one shuffle of the rows
    keys = ["_src", "_none", "_chunk"]
    rows = rows.withColumns({"_src": F.coalesce("source", F.lit("")), "_none": F.col("source").isNull(),
                             "_chunk": F.substring("_key", 1, CHUNK_DIGITS)})
    chunks = rows.groupBy(*keys).agg(F.sum("size").alias("_sum"))
    along = Window.partitionBy("_src", "_none").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, 0)
    chunks = chunks.withColumn("_offset", F.sum("_sum").over(along) - F.col("_sum")).drop("_sum")
    goals = targets(rows, weights, share, cap).select(
        F.coalesce("source", F.lit("")).alias("_src"), F.col("source").isNull().alias("_none"), "source_size", "target")
    out = rows.join(chunks.join(goals, ["_src", "_none"]), keys)
    inside = Window.partitionBy(*keys).orderBy("_key", "doc_id", "size")
    before = F.col("_offset") + F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")
    out = out.withColumns({"_before": before, "_budget": F.floor("target")})
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("_budget") / F.col("source_size"))).otherwise(F.lit(0))
    rest = F.greatest(F.lit(0), F.least("size", F.col("_budget") - epochs * F.col("source_size") - F.col("_before")))
    return out.withColumn("taken", (epochs * F.col("size") + rest).cast("bigint")).drop(
        *keys, "_offset", "_before", "_budget")


def repeated(mixed: DataFrame) -> DataFrame:
    """The mixed documents as rows: a document appears once per epoch that takes at least half of it.

    A document without words appears once: it uses no budget.
    """
    times = F.when(F.col("size") == 0, F.lit(1)).otherwise(F.floor(F.col("taken") / F.col("size") + 0.5).cast("int"))
    return (mixed.withColumn("_times", times).filter("_times > 0")
            .withColumn("_epoch", F.explode(F.sequence(F.lit(1), F.col("_times")))).select("_carry.*"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "source", "text")
    return mix(sized(docs)).select("doc_id", "size", "source_size", "target", "taken")


SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5(concat_ws('|', 'mix', doc_id::VARCHAR, source, text)) AS k FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS w,
             source_size * 2.0::DOUBLE AS cap, sum(source_size) OVER () * 1.5::DOUBLE AS total FROM s),
l AS (SELECT *, (total - coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
             / sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lev FROM w),
b AS (SELECT coalesce((SELECT lev FROM l WHERE lev <= cap / w ORDER BY cap / w, source NULLS LAST LIMIT 1), (SELECT max(cap / w) FROM l)) AS lev),
t AS (SELECT l.source, l.source_size, least(cap, b.lev * w) AS target FROM l, b),
p AS (SELECT d.doc_id, d.size, t.source_size, t.target, floor(t.target) AS budget,
             sum(d.size) OVER (PARTITION BY d.source ORDER BY k, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - d.size AS before
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       (CASE WHEN source_size > 0 THEN floor(budget / source_size) * size
             + greatest(0, least(size, budget - floor(budget / source_size) * source_size - before)) ELSE 0 END)::BIGINT AS taken
FROM p
"""
