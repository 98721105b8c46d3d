"""Session and lineage helpers shared by all operators."""

from __future__ import annotations

import gc
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def get_spark(app: str = "navlytics", cpus: str | None = None) -> SparkSession:
    """A local session for tests and the bench; on a cluster pass your own session instead."""
    cpus = cpus or os.environ.get("BENCH_CPUS", "8")
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", cpus if cpus.isdigit() else "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("NAVLYTICS_DRIVER_MEMORY", "16g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, as spark.checkpoint.dir names it.

    Unset, a temporary folder serves a local master (plain tests); on a cluster that is an error, since
    executors cannot see each other's temporary folders.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not named:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = _own.setdefault(sc.applicationId, "")
        if not named:
            named = _own[sc.applicationId] = "file://" + tempfile.mkdtemp(prefix="navlytics-shared-")
    return named.rstrip("/")


_own: dict[str, str] = {}


def cut_lineage(df: DataFrame) -> DataFrame:
    """Checkpoint into the shared folder."""
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def written(df: DataFrame, name: str = "table") -> DataFrame:
    """Write a table to the shared folder and read it again.

    Like a checkpoint, but computed once, and without the constraints that a checkpoint hands on: in loops with many conditional
    columns these grow from round to round until planning takes longer than the work.
    """
    path = f"{shared_folder(df.sparkSession)}/navlytics-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.__dict__["navlytics_path"] = path
    return out


def is_written(df: DataFrame) -> bool:
    return "navlytics_path" in df.__dict__


def discard(df: DataFrame) -> None:
    """Delete a table that ``written`` returned, once nothing reads it any more."""
    sc = df.sparkSession.sparkContext
    path = sc._jvm.org.apache.hadoop.fs.Path(df.__dict__["navlytics_path"])
    path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def free_shuffles(spark: SparkSession) -> None:
    """Have Spark delete the shuffle files and checkpoints of plans that are gone.

    It does so when the driver collects its garbage, which a driver with little to do hardly ever does by itself.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def parallelism(spark: SparkSession) -> int:
    return max(2, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))
