"""Checkpoints in the folder that all machines of a cluster share."""

from __future__ import annotations

import tempfile
import threading

from pyspark.sql import DataFrame, SparkSession


def checkpoint_folder(spark: SparkSession) -> str:
    """The session's shared checkpoint folder, as spark.checkpoint.dir names it.

    Where that is unset, a session on one machine (master local) gets a folder of the operating system's temporary
    directory; on a cluster, whose machines don't share such a folder, it is an error.
    """
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        folder = sc.getConf().get("spark.checkpoint.dir")
        if not folder and not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="querylens-"))
    return sc._jsc.sc().getCheckpointDir().get()


_ONE_AT_A_TIME = threading.Lock()
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared checkpoint folder.

    What the frame shuffled is not needed any more once it is written, so Spark is told to delete it then.
    """
    spark = df.sparkSession
    checkpoint_folder(spark)
    with _ONE_AT_A_TIME:  # the setting is the session's
        before = spark.conf.get(CLEANUP, None)
        spark.conf.set(CLEANUP, "true")
        try:
            return df.select("*").checkpoint(eager=True)  # a plan made under the setting
        finally:
            spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)


def delete_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder of intermediate data, on whatever file system it is."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
