"""Session helpers: where lineage is cut, and how many partitions a step should have."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, which all executors see. Where it is unset a single machine gets a folder of
    its own; a cluster gets an error, as executors couldn't read one another's files."""
    context = spark.sparkContext
    known = context.getCheckpointDir() or context.getConf().get("spark.checkpoint.dir")
    if known is None and not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
        raise ValueError("spark.checkpoint.dir isn't set: name a folder that the driver and all executors share")
    return known or tempfile.mkdtemp(prefix="srcfacts-")


def cut(df: DataFrame) -> DataFrame:
    """Checkpoint to the shared folder."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """Written to the shared folder and read again, for loops that join a result with itself: a checkpoint keeps the estimate of its plan's size, which
    such loops square in every round until planning takes all memory; files have their own size, small ones are broadcast."""
    folder = f"{shared_folder(df.sparkSession)}/stored-{uuid.uuid4().hex}"
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's Parquet tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
