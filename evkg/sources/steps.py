"""Tables between the steps of a job, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names, which driver and executors share.

    Only a session on one machine (tests) may leave it unset and gets a temporary one; a cluster is refused.
    """
    at = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if at is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        at = tempfile.mkdtemp(prefix="checkpoint-")
        spark.sparkContext.setCheckpointDir(at)
    return at


def kept(df: DataFrame) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, which the cluster cleans up: its plan is run once, and later steps
    have a plan that begins with the table, so that the driver's memory doesn't grow with the number of its uses."""
    path = f"{shared_folder(df.sparkSession).rstrip('/')}/step-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
