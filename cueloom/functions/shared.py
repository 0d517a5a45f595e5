"""The shared scratch folder, checkpoints, and tables of a data folder."""

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: spark.checkpoint.dir.

    Where it is unset in a local session (one process, as in tests), a temporary folder is
    set as the checkpoint folder of this Spark context and used from then on; on a cluster this raises RuntimeError.
    """
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir")
    current = context.getCheckpointDir()
    if current is None:
        if named is None and not re.match(r"local(\[|$)", context.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="cueloom-"))
        current = context.getCheckpointDir()
    return (named or current).rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, for a table that one run writes and reads."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def cut(frame: DataFrame) -> DataFrame:
    """Write the frame to the shared checkpoint folder and go on from there."""
    shared_dir(frame.sparkSession)
    return frame.checkpoint(eager=True)
