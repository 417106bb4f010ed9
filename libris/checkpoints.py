"""Checkpoints in the folder that all machines share."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """This application's folder below the one that ``spark.checkpoint.dir`` names.

    Only a local session that names none gets a temporary folder.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not sc.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a shared folder")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="libris-checkpoint-"))
        if not named:
            temporary(spark, sc.getCheckpointDir())
    return sc.getCheckpointDir()


def _at(spark: SparkSession, folder: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def temporary(spark: SparkSession, folder: str) -> str:
    """``folder``, deleted when the session's process ends."""
    fs, path = _at(spark, folder)
    fs.deleteOnExit(path)
    return folder


def deleted(spark: SparkSession, folder: str) -> None:
    """Deletes a folder that nothing reads any more."""
    fs, path = _at(spark, folder)
    fs.delete(path, True)


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()
