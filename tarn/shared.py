"""The folder that driver and executors share."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``.  Where that is unset, a local master gets a folder of its own; a cluster is an error."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        at = "file://" + os.path.join(tempfile.gettempdir(), f"tarn-{os.getpid()}")
        os.makedirs(at[7:], exist_ok=True)
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(at)
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    at = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()
    return re.sub(r"^file:/+", "file:///", at).rstrip("/")


#: Paths given out by ``scratch`` in this process and not removed yet.
MADE: list[str] = []


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    MADE.append(f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}")
    return MADE[-1]


def saved(df: DataFrame, path: str, **options: str) -> DataFrame:
    """Write as Parquet in the shared folder and read back: cuts the lineage, survives lost executors."""
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, *paths: str) -> None:
    """Delete folders that nothing reads any more."""
    for path in paths:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
        if path in MADE:
            MADE.remove(path)
