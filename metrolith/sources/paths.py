"""Folders for intermediate tables."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


def put(spark: SparkSession, path: str, data: bytes) -> str:
    """Write one file to any file system that Spark knows."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark._jsc.hadoopConfiguration()).create(at, True)
    out.write(bytearray(data))
    out.close()
    return path


def scratch(spark: SparkSession, label: str) -> str:
    """A new path in the folder that driver and executors share: the session's
    ``spark.checkpoint.dir``, or a folder of the warehouse where that is unset (in local
    sessions, or if the warehouse is no machine's own)."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        at = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/shared"
        if at.startswith(("file:", "/")) and spark.sparkContext.master.partition("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
    return f"{at.rstrip('/')}/{label}-{uuid.uuid4().hex}"
