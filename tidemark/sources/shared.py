"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Where the setting is missing a temporary folder is made, but only in plain local mode, where
    one process holds driver and executors; anywhere else that is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="tidemark-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def remove(spark: SparkSession, folder: str) -> None:
    """Deletes a folder of the shared store, if it's there."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def discard(df: DataFrame) -> None:
    """Deletes the folder of a ``stored`` table that nothing will read again."""
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if folder.rsplit("/", 1)[1].startswith("tidemark-"):
            remove(df.sparkSession, folder)


def stored(df: DataFrame, codec: str = "snappy") -> DataFrame:
    """``df`` written once to the shared folder, compressed by ``codec``, and read back.

    Cuts the lineage: what comes after doesn't compute ``df`` again, and a lost executor takes none
    of it along.
    """
    path = f"{shared_folder(df.sparkSession)}/tidemark-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=codec)
    return df.sparkSession.read.schema(df.schema).parquet(path)
