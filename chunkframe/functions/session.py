"""Where a session may put shared files."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def shared_folder(spark: SparkSession, what: str) -> str:
    """A fresh folder below ``spark.checkpoint.dir``, which driver and executors share; where
    that is unset, a session in one process sets a temporary one, and on a cluster it is
    an error.  The folder goes when the session's file system closes."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        top = "file://" + tempfile.mkdtemp(prefix="chunkframe-shared-")
        spark.conf.set("spark.checkpoint.dir", top)
    path = f"{top.rstrip('/')}/chunkframe-{what}-{uuid.uuid4().hex}"
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return path
