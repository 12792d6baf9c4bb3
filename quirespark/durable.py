"""What must outlive a plan or an executor is written to a folder that all of them share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_root(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: ``spark.checkpoint.dir`` of the session.

    Where it is unset in a local session, as in tests, a temporary folder takes its place and the
    setting is filled in for the rest of the session.  On a cluster there is no such folder that all
    see, so that there the setting must be given.
    """
    context = spark.sparkContext
    root = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("quirespark.shared.dir", None)
    if not root:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="quirespark-")
        spark.conf.set("quirespark.shared.dir", root)
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(root)
    return root.rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder, which the driver deletes when it ends."""
    folder = f"{shared_root(spark)}/quirespark/{uuid.uuid4().hex}"
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files.mkdirs(path)  # else there is nothing yet to be deleted
    files.deleteOnExit(path)
    return f"{folder}/{label}"


def written(df: DataFrame, label: str) -> DataFrame:
    """``df``, written to the shared folder and read again."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def durable(df: DataFrame) -> DataFrame:
    """``df``, checkpointed to the shared folder, so that it is neither dealt anew nor lost with an executor."""
    shared_root(df.sparkSession)
    return df.checkpoint()
