"""Session construction shared by tests, the bench and the CLI."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | str | None = None, partitions: int = 8, app: str = "sparkloupe") -> SparkSession:
    """A local session with adaptive execution; on a cluster use the cluster's own session instead."""
    cpus = cpus or os.environ.get("BENCH_CPUS", "8")
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("SPARKLOUPE_DRIVER_MEMORY", "6g"))
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """The folder of intermediate tables: spark.checkpoint.dir, else one in the warehouse."""
    return (spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/checkpoints").rstrip("/")


#: Folders that stored() wrote and nothing has deleted yet.
_PATHS: list[str] = []


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes a table into the shared folder and reads it back: cuts lineage, and survives lost executors."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    back._sparkloupe_path = path
    _PATHS.append(path)
    return back


def discard(*tables: DataFrame) -> None:
    """Deletes tables of stored() that no later plan reads."""
    for df in tables:
        _delete(df.sparkSession, df._sparkloupe_path)


def release(spark: SparkSession) -> None:
    """Deletes all tables of stored(); for a caller that has written or read its results."""
    for path in [*_PATHS]:
        _delete(spark, path)


def _delete(spark: SparkSession, path: str) -> None:
    _PATHS.remove(path)
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
