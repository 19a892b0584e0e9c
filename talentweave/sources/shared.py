"""The folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from py4j.java_gateway import JavaObject
from pyspark.sql import SparkSession

#: Folders of applications that are there already, and go with their JVM.
_MADE: set[str] = set()


def filesystem(spark: SparkSession, path: str) -> tuple[JavaObject, JavaObject]:
    """The file system of a path, as Spark knows it, and the path in it."""
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    return there.getFileSystem(spark._jsc.hadoopConfiguration()), there


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path under the folder that the session names in spark.checkpoint.dir; it is deleted when the session's JVM ends.

    Only a single-machine session that names none gets a temporary folder of its own.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        master = spark.sparkContext.master
        if not master.startswith("local[") and master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", root)
    own = f"{root.rstrip('/')}/made-by-{spark.sparkContext.applicationId}"
    if own not in _MADE:
        files, there = filesystem(spark, own)
        files.mkdirs(there)
        files.deleteOnExit(there)
        _MADE.add(own)
    return f"{own}/{name}-{uuid.uuid4().hex}"
