"""Session construction and the shared scratch location."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL_FALLBACK: dict[str, str] = {}
#: Events of a task of the operators that gather, sort or multiply them, where the number of tasks follows the table.
TASK_ROWS = 50_000


def build(app: str = "tapline", master: str | None = None, partitions: int | None = None) -> SparkSession:
    b = (SparkSession.builder.appName(app)
         .config("spark.sql.session.timeZone", "UTC")
         .config("spark.sql.adaptive.enabled", "true")
         .config("spark.sql.adaptive.skewJoin.enabled", "true")
         .config("spark.python.sql.dataFrameDebugging.enabled", "false")  # skips call-site capture per column
         .config("spark.ui.enabled", "false")
         .config("spark.ui.showConsoleProgress", "false"))
    if master:
        b = b.master(master).config("spark.driver.memory", "8g")
    if partitions:
        b = b.config("spark.sql.shuffle.partitions", str(partitions))
    return b.getOrCreate()


def scratch(spark: SparkSession, purpose: str) -> str:
    """A fresh folder under the cluster's shared checkpoint location.

    The machine-local fallback is only reached when the setting is absent, as in tests.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        app = spark.sparkContext.applicationId
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        base = _LOCAL_FALLBACK.setdefault(app, tempfile.mkdtemp(prefix="tapline-"))
    return f"{base.rstrip('/')}/{purpose}-{uuid.uuid4().hex[:12]}"


def tasks_for(df: DataFrame, rows: int = TASK_ROWS) -> int:
    """Tasks for a shuffle of a table's rows, so that one holds about ``rows`` of them however many there are."""
    return max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // rows))


def materialise(df, purpose: str):
    """Cut lineage through a written table, which survives the loss of executors."""
    spark = df.sparkSession
    path = scratch(spark, purpose)
    df.write.parquet(path)
    return spark.read.parquet(path)
