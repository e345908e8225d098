"""Keyed tables: one row per key, merged into hash buckets under versioned manifests.

A merge rewrites only the buckets that its keys fall into: it reads them, keeps the last row per key and writes the
result aside under its version; then it writes the manifest of that version, which names the version of every bucket.
A manifest counts once its success marker is there, so readers see a merge whole or not at all, a failed one leaves
the old version, and a repeated one replaces itself. A bucket has the files of one version only, so nothing piles up
between merges; `vacuum` removes versions that no kept manifest names. One writer at a time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tapline.sources.sinks import latest


def _fs(spark: SparkSession, path: str):
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), folder


def _numbers(spark: SparkSession, path: str, prefix: str) -> list[int]:
    """Numbers of the subfolders ``prefix=n``, ascending."""
    fs, folder = _fs(spark, path)
    if not fs.exists(folder):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(folder)]
    return sorted(int(n.split("=")[1]) for n in names if n.startswith(f"{prefix}="))


class KeyedTable:
    def __init__(self, spark: SparkSession, path: str, key: str, buckets: int = 64) -> None:
        self.spark, self.path, self.key, self.buckets = spark, path, key, buckets

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(F.col(f"`{self.key}`")), F.lit(self.buckets)).cast("int")

    def versions(self) -> list[int]:
        """Committed versions."""
        found = _numbers(self.spark, f"{self.path}/manifest", "version")
        return [v for v in found if _exists(self.spark, f"{self.path}/manifest/version={v}/_SUCCESS")]

    def manifest(self, version: int | None = None) -> dict[int, int]:
        """Bucket to the version that wrote it; at most one entry per bucket."""
        known = [v for v in self.versions() if version is None or v <= version]
        if not known:
            return {}
        rows = self.spark.read.parquet(f"{self.path}/manifest/version={known[-1]}").collect()
        return {r["bucket"]: r["written"] for r in rows}

    def _read(self, entries: dict[int, int]) -> DataFrame | None:
        paths = [f"{self.path}/data/version={v}/bucket={b}" for b, v in sorted(entries.items())]
        return self.spark.read.option("mergeSchema", True).parquet(*paths) if paths else None

    def read(self, version: int | None = None) -> DataFrame | None:
        """The table as of a version (default: the newest); nothing before the first merge."""
        return self._read(self.manifest(version))

    def merge(self, rows: DataFrame, version: int, order: str | None = None) -> None:
        """Insert and replace by key. Of rows with one key the greatest ``order`` stays, in storage too; without it new rows win."""
        before = self.manifest(version - 1)
        new = rows.withColumn("_rank", F.lit(1))
        # the distinct buckets of the batch: a number per bucket at most
        touched = sorted(r[0] for r in rows.select(self.bucket()).distinct().collect())
        old = self._read({b: v for b, v in before.items() if b in set(touched)})
        both = new if old is None else new.unionByName(old.withColumn("_rank", F.lit(0)), allowMissingColumns=True)
        by = F.struct(F.col(f"`{order}`").alias("o"), "_rank") if order else F.struct("_rank")
        last = latest(both.withColumn("_by", by), self.key, "_by").drop("_by", "_rank")
        out = last.withColumn("bucket", self.bucket()).repartition(self.buckets, "bucket")
        out.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/data/version={version}")
        entries = [(b, v) for b, v in {**before, **dict.fromkeys(touched, version)}.items()]
        (self.spark.createDataFrame(entries, "bucket int, written int").coalesce(1)
         .write.mode("overwrite").parquet(f"{self.path}/manifest/version={version}"))

    def vacuum(self, keep: int = 1) -> list[int]:
        """Remove older manifests and the data that only they, or failed merges before them, name."""
        versions = self.versions()
        kept = versions[-keep:]
        used = {v for k in kept for v in self.manifest(k).values()}
        gone = [v for v in _numbers(self.spark, f"{self.path}/data", "version") if kept and v < kept[-1] and v not in used]
        for v in gone:
            _remove(self.spark, f"{self.path}/data/version={v}")
        for v in versions[:-keep]:
            _remove(self.spark, f"{self.path}/manifest/version={v}")
        return gone


def _exists(spark: SparkSession, path: str) -> bool:
    fs, folder = _fs(spark, path)
    return fs.exists(folder)


def _remove(spark: SparkSession, path: str) -> None:
    fs, folder = _fs(spark, path)
    fs.delete(folder, True)
