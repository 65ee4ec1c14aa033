"""Written tables in the shared checkpoint folder, for loops and for results that are used more than once.

A written table ends the lineage like a checkpoint does and survives lost executors. Unlike one,
it tells the planner its real size, so a loop's joins are planned from data instead of from
estimates that multiply with every round. Loops drop the tables of past rounds as they go.
"""

from __future__ import annotations

import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

PLAN_CHARS = "8k"


def checkpoint_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, else the folder set on the context, else one beside the session's warehouse tables."""
    folder = (spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
              or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_lineage")
    return folder.rstrip("/")


@contextmanager
def lean(spark: SparkSession):
    """Queries made and run inside delete their shuffle files when they end, and describe their plans to Spark's listeners in short.

    Else the files lie until the driver collects its garbage, and the driver writes a plan out in full after each of its stages.
    For frames that run once: a second run of the same frame would have to shuffle again.
    """
    new = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.maxPlanStringLength": PLAN_CHARS}
    before = {name: spark.conf.get(name, None) for name in new}
    for name, value in new.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def written(df: DataFrame) -> tuple[DataFrame, str]:
    """The frame written and read again, and its path for ``drop_written``."""
    spark = df.sparkSession
    path = f"{checkpoint_folder(spark)}/factorseg-{uuid.uuid4().hex}"
    with lean(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def cut_lineage(df: DataFrame) -> DataFrame:
    return written(df)[0]


class Scratch:
    """Written tables of one computation, dropped together once its result has been written."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def cut(self, df: DataFrame) -> DataFrame:
        table, path = written(df)
        self.paths.append(path)
        return table

    def drop(self) -> None:
        drop_written(self.spark, *self.paths)
        self.paths = []


def drop_written(spark: SparkSession, *paths: str) -> None:
    """Delete tables that nothing reads any more, on whatever file system they lie."""
    for path in paths:
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
