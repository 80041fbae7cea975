"""Session settings and stable cut points for iterative jobs."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def prepare(spark: SparkSession) -> SparkSession:
    """Pin the settings results depend on: naive timestamps are UTC."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def local_session(cores: str = "8", partitions: int = 8) -> SparkSession:
    """A local session for tests and the benchmark; a cluster brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("siltmark")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def release(spark: SparkSession) -> None:
    """Let go of what no table refers to any more.

    Spark removes shuffle files and driver-side state of dropped tables only when the driver collects garbage,
    which a long iterative job with a large heap may put off until disks are full.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def checkpoint_root(spark: SparkSession) -> str:
    """The folder ``spark.checkpoint.dir`` names; only a local session may fall back to a fresh temporary one."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if shared:
            sc.setCheckpointDir(shared)
        elif sc.master.startswith("local"):
            sc.setCheckpointDir(tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
        else:
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    return sc.getCheckpointDir()


def shared_folder(spark: SparkSession, label: str) -> str:
    """A fresh folder that the driver and all executors can reach."""
    return f"{checkpoint_root(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str) -> DataFrame:
    """The rows as a table in a fresh shared folder: computed once for all that read it, column by column, and of known size."""
    path = shared_folder(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stored(df: DataFrame, label: str) -> DataFrame:
    """``written``, and what was shuffled to make the rows let go, so that the steps of a long plan do not pile up on disk."""
    out = written(df, label)
    df.sparkSession.range(1).count()  # listeners hold on to the last query until they hear of another
    release(df.sparkSession)
    return out


def stable(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: the rows survive lost executors and are never recomputed."""
    checkpoint_root(df.sparkSession)
    return df.checkpoint(True)
