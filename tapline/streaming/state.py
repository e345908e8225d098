"""State of a stream as small tables, one folder per micro-batch.

Batch n reads the tables of batch n - 1 and writes its own, so a repeated batch gives the same result, no executor
holds anything, and a lost one is recomputed from files. Folders two batches back are removed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


class State:
    def __init__(self, spark: SparkSession, path: str, batch_id: int) -> None:
        self.spark, self.path, self.batch_id = spark, path, batch_id

    def _folder(self, name: str, batch_id: int) -> str:
        return f"{self.path}/{name}/batch={batch_id}"

    def before(self, name: str) -> DataFrame | None:
        """The table as the preceding batch left it; nothing before the first batch."""
        return self.spark.read.parquet(self._folder(name, self.batch_id - 1)) if self.batch_id > 0 else None

    def joined(self, name: str, rows: DataFrame) -> DataFrame:
        """The preceding batch's rows and these."""
        old = self.before(name)
        return rows if old is None else old.unionByName(rows)

    def keep(self, name: str, rows: DataFrame) -> DataFrame:
        """Write a table of this batch and read it back."""
        rows.write.mode("overwrite").parquet(self._folder(name, self.batch_id))
        if self.batch_id > 1:
            remove(self.spark, self._folder(name, self.batch_id - 2))
        return self.spark.read.parquet(self._folder(name, self.batch_id))


def remove(spark: SparkSession, path: str) -> None:
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
