"""Written tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

TASK_ROWS = 1_000_000  # rows a task sorts or joins at once


def new_folder(spark: SparkSession) -> str:
    """A path of its own in the session's checkpoint folder. Only a local session without one gets a temporary folder."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not where:
        if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):  # a folder of one machine would lose rows
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="workgraph-"))
        where = spark.sparkContext.getCheckpointDir()
    return f"{where}/{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """df as a Parquet table in the session's checkpoint folder, read back: lineage ends, and the size is known."""
    path = new_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def in_order(df: DataFrame, *keys: str) -> DataFrame:
    """df sorted by keys, with TASK_ROWS a task: written first, so that its rows are counted without being made twice."""
    df = written(df)
    return df.repartitionByRange(parts_of(df), *keys).sortWithinPartitions(*keys)


def parts_of(*dfs: DataFrame) -> int:
    """How many tasks of TASK_ROWS the tables make together, by their files' row counts."""
    return 1 + sum(df.count() for df in dfs) // TASK_ROWS


@contextmanager
def small_tasks(spark: SparkSession, parts: int = 1000, size: str = "32m") -> Iterator[None]:
    """While it lasts, Spark deals shuffles to so many parts and puts small ones together again up to a size: what a task gets
    does not grow with the tables. Splits of files stay as they are, since places in files are told by them."""
    new = {"spark.sql.adaptive.coalescePartitions.initialPartitionNum": str(parts), "spark.sql.adaptive.advisoryPartitionSizeInBytes": size}
    old = {name: spark.conf.get(name, None) for name in new}
    try:
        for name, value in new.items():
            spark.conf.set(name, value)
        yield
    finally:
        for name, value in old.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)
