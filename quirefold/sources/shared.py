"""Cutting lineage in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that the session names in ``spark.checkpoint.dir``; where it names none, a local session gets a temporary one, and a cluster an error."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not named:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and the executors share")
        named = f"file://{tempfile.mkdtemp(prefix='spark-checkpoint-')}"
        sc.setCheckpointDir(named)
    return named.rstrip("/")


def checkpointed(df: DataFrame) -> DataFrame:
    """A reliable checkpoint, in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def as_table(df: DataFrame, name: str) -> DataFrame:
    """Written as Parquet to the shared folder and read back."""
    path = f"{shared_folder(df.sparkSession)}/quirefold-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
