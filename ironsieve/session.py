"""Session helpers shared by every part of the library."""

from __future__ import annotations

import gc
import os

from pyspark.sql import DataFrame, SparkSession


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def local_session(cpus: int | None = None, partitions: int | None = None) -> SparkSession:
    """A local session for tests and benches; clusters bring their own."""
    n = cpus or int(os.environ.get("BENCH_CPUS", "8"))
    return (
        SparkSession.builder.master(f"local[{n}]")
        .appName("ironsieve")
        .config("spark.sql.shuffle.partitions", str(partitions or n))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", os.environ.get("IRONSIEVE_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder: the session's own, or a local one where none is set (tests in one process only)."""
    sc = spark.sparkContext
    at = sc.getCheckpointDir()
    if at is None:
        conf = sc.getConf().get("spark.checkpoint.dir")
        if not conf and sc.master != "local" and not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(conf or f"/tmp/ironsieve-checkpoints-{os.getpid()}")
        at = sc.getCheckpointDir()
    return at


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint, so that a lost executor costs no recomputation of what came before."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def spread(df: DataFrame) -> DataFrame:
    """Deal rows over at least as many tasks as there are cores, before costly work on each: a small file is read by few
    tasks, however many rows it holds. Give only the columns that are needed, as they are shuffled."""
    spark = df.sparkSession
    return df.repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))))


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files and checkpoints of finished steps now: it does so when the driver's garbage
    collector finds that nothing refers to them, which on a driver with memory to spare comes late."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def delete_folder(spark: SparkSession, folder: str) -> None:
    """Delete a folder of intermediate results, on whatever file system it is."""
    at = spark._jvm.org.apache.hadoop.fs.Path(folder)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
