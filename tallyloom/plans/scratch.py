"""Tables that a plan reads several times, written once to the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a kept table that may be sent to every task.
BROADCAST_ROWS = 200_000
#: Rows of a kept table that a task gets when they are dealt.
TASK_ROWS = 500_000


def kept(df: DataFrame, name: str) -> DataFrame:
    """The rows as a Parquet table below ``spark.checkpoint.dir``: read again and again, it costs no second scan or score, and a lost executor
    loses nothing of it. The folder is scratch; its owner empties it. Without the setting a local Spark gets a folder of its own."""
    spark = df.sparkSession
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no folder that the executors share")
        root = f"file://{tempfile.mkdtemp(prefix='tallyloom-')}"
        spark.sparkContext.setCheckpointDir(root)
    path = f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def kept_small(df: DataFrame, name: str) -> DataFrame:
    """The rows as a kept table, marked for broadcast if they are few: then no join on them deals a large table by a few keys."""
    once = kept(df, name)
    return F.broadcast(once) if once.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else once


def dealt(df: DataFrame, name: str, *keys: str) -> DataFrame:
    """The rows as a kept table, dealt by keys to as many tasks as their number asks for: what a task holds of them doesn't grow with the
    table, as it does where Spark merges partitions by their packed size."""
    once = kept(df, name)
    return once.repartition(max(1, -(-once.count() // TASK_ROWS)), *keys)
