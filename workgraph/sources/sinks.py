"""Sinks: findings, registry snapshots and metric baselines."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.lint import SEEDED
from ..operators.registry import registry_violations
from ..tables import in_order, parts_of, small_tasks

SNAPSHOT = ("items", "deps", "capabilities")
FINDING = {"rule": "string", "line": "int", "column": "int", "snippet": "string", "message": "string", "path": "string"}


def write_findings(df: DataFrame, path: str) -> None:
    """Findings with one schema, nulls kept, a folder for each rule."""
    have = {c: F.col(c) if c in df.columns else F.lit(None) for c in FINDING}
    df.select(*[c.cast(FINDING[n]).alias(n) for n, c in have.items()]).write.mode("overwrite").partitionBy("rule").parquet(path)


def export_registry(items: DataFrame, deps: DataFrame, caps: DataFrame, path: str) -> None:
    """A snapshot in a fixed order: items, edges and capabilities; leases never."""
    with small_tasks(items.sparkSession):
        in_order(items, "id").write.mode("overwrite").parquet(f"{path}/items")
        in_order(deps, "from_id", "to_id", "kind").write.mode("overwrite").parquet(f"{path}/deps")
        in_order(caps, "work_item_id", "capability").write.mode("overwrite").parquet(f"{path}/capabilities")


def import_registry(spark: SparkSession, path: str, to: str | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A snapshot's tables, or ValueError naming some violations: all or nothing.

    With to, the tables are first written to a folder beside it, which takes the name to only when all are there; a folder
    of that name is an error, and nothing is ever left half written under it.
    """
    items, deps, caps = tables = tuple(spark.read.parquet(f"{path}/{t}") for t in SNAPSHOT)
    if bad := registry_violations(items, deps, caps, parts_of(items, deps, deps, caps)).limit(10).collect():
        raise ValueError("; ".join(f"{r['rule']}: {r['subject']}" for r in bad))
    if to is None:
        return tables
    staging = f"{to}.staging-{uuid.uuid4().hex}"
    for name, df in zip(SNAPSHOT, tables, strict=True):
        df.write.parquet(f"{staging}/{name}")
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs  # the file system that Spark itself writes by
    target = hadoop.Path(to)
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.exists(target) or not fs.rename(hadoop.Path(staging), target):
        fs.delete(hadoop.Path(staging), True)
        raise ValueError(f"{to} is there already")
    return tuple(spark.read.parquet(f"{to}/{t}") for t in SNAPSHOT)


def write_baseline(metrics: DataFrame, path: str) -> None:
    """Long-form non-zero metrics by path, and the seeded metrics at 0, so that they count as established."""
    names = [c for c in metrics.columns if c != "path"]
    each = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("long").alias("n")) for m in names])).alias("e")
    metrics.select("path", each).select("path", "e.*").filter((F.col("n") != 0) | F.col("metric").isin(*SEEDED)).write.mode("overwrite").json(path)


def read_baseline(spark: SparkSession, path: str) -> DataFrame:
    """A baseline read back; entries that are not numbers are left out, and a missing one is empty."""
    schema = "path string, metric string, n string"
    try:
        raw = spark.read.schema(schema).json(path)
        raw.schema  # noqa: B018  a missing path shows here
    except Exception as e:  # the reader's error class for a missing path is an AnalysisException
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], "path string, metric string, n long")
    return raw.withColumn("n", F.expr("try_cast(n as bigint)")).filter("n is not null and path is not null and metric is not null")
