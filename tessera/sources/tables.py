"""Reading the base tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that the session names in ``spark.checkpoint.dir``, a part of its own for each session.

    Where none is named, a local master gets a temporary folder; a cluster must name one that all its machines share.
    """
    context = spark.sparkContext
    if not spark.conf.get("spark.checkpoint.dir", None) and not context.getCheckpointDir():
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="spark-checkpoints-"))
    return context.getCheckpointDir()


def new_folder(spark: SparkSession) -> str:
    """A path in the shared folder where nothing is yet."""
    return f"{shared_folder(spark)}/files-{uuid.uuid4().hex}"


def kept(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder, its lineage cut."""
    shared_folder(df.sparkSession)
    return df.checkpoint()
