"""Writing what is read again, and cutting lineage in iterative operators."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def _shared(spark: SparkSession) -> str:
    """The checkpoint folder of the session: as set, else that of ``spark.checkpoint.dir``; a temporary one on one machine only."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        shared = sc.getConf().get("spark.checkpoint.dir", None)
        if shared is None and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="spark-"))
    return sc.getCheckpointDir()


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder in the shared one."""
    return f"{_shared(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read again. Unlike a checkpoint it also drops what the planner
    knows of the columns' origin, which would grow with every turn of a loop."""
    path = shared_folder(df.sparkSession, "turn")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def materialize(df: DataFrame) -> DataFrame:
    """``df`` computed once. It is written as Parquet, since a checkpoint holds rows as they are in memory, many times as
    large, and hides from the planner how small a table is."""
    return written(df)
