"""Durable cuts of lineage in the folder that all executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``; a folder of our own only in local mode."""
    sc = spark.sparkContext
    shared = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not shared:
        current = sc.getCheckpointDir()
        if current:
            return current
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is not set: it must name a folder that all executors share")
        import tempfile

        shared = tempfile.mkdtemp(prefix="ridgeline-checkpoint-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared)
    return shared


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder's path in the shared folder, for a table that is written and read again."""
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder of ``scratch`` that nothing will be read from any more, on whatever file system it is."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def cut(df: DataFrame) -> DataFrame:
    """Cut lineage through a reliable checkpoint in the shared folder."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()
