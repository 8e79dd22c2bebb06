"""Tables that a job keeps between its steps, in the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, or in local mode, where there is one machine, a temporary one."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if found is None:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="spindrift-")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(found)
    return found


def kept(df: DataFrame) -> DataFrame:
    """The rows of df as a written table, which survives the loss of executors. Unlike a checkpoint's, its
    size is that of its files: estimates of a plan that joins kept tables again and again don't multiply."""
    path = f"{shared_folder(df.sparkSession).rstrip('/')}/kept-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows that a task gets of a table that is dealt by a key.
DEALT = 200_000


def dealt(df: DataFrame, rows: int, *by: str) -> DataFrame:
    """df dealt by some of its columns to as many tasks as its number of rows, or of those it is joined with, asks for, so
    that no task grows with the input."""
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(least, -(-rows // DEALT)), *by)
