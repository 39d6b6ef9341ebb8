"""Scratch tables in the shared folder, size-checked joins, Arrow batches of bounded size, connected components."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that the small side of a join may have to be sent to every executor (ids and a few numbers: some MB).
BROADCAST_ROWS = 250_000
#: Bytes of text that a Python function takes at once; a longer single text comes alone.
SLICE_BYTES = 2_000_000


class Scratch:
    """Tables written below ``spark.checkpoint.dir``, which all executors share; reading one back cuts the lineage."""

    def __init__(self, spark: SparkSession, name: str):
        root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
        if not root:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir names no folder that the executors share")
            root = f"file://{tempfile.mkdtemp(prefix='tallyloom-')}"  # tests: one machine
            spark.sparkContext.setCheckpointDir(root)
        self.spark, self.at = spark, f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"

    def keep(self, df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
        path = f"{self.at}/{name}"
        df.write.mode("overwrite").option("compression", compression).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def path(self, name: str) -> str:
        return f"{self.at}/{name}"

    def drop(self, *names: str) -> None:
        jvm = self.spark.sparkContext._jvm
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.at}/{name}")
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)

    def release(self) -> None:
        """Lets Spark remove the shuffle files of finished steps, which it keeps until the driver's garbage is collected."""
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def small(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """Marks a side for broadcast if it has at most so many rows; else Spark shuffles and splits skewed keys."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def bounded_batches(spark: SparkSession) -> None:
    """Arrow batches end at some MB as well as at a row count, so that long texts don't pile up in one batch."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    try:
        now = int(spark.conf.get(key))
    except Exception:  # a Spark without the setting
        return
    if not 0 < now <= 16 << 20:
        spark.conf.set(key, str(16 << 20))


_remembered: dict[str, Callable[[], None]] = {}


def claim(owner: str, forget: Callable[[], None]) -> None:
    """In a Python worker, which later stages use again: what other operators remember there is forgotten."""
    for other in [x for x in _remembered if x != owner]:
        _remembered.pop(other)()
    _remembered[owner] = forget


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts Arrow batches so that the column's texts have at most so many bytes, one text at least."""
    import numpy as np
    import pyarrow.compute as pc

    for batch in batches:
        sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(column))), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        start = 0
        while start < batch.num_rows:
            before = sizes[start - 1] if start else 0
            end = max(start + 1, int(np.searchsorted(sizes, before + most, side="right")))
            yield batch.slice(start, end - start)
            start = end


def components(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(node, label): the smallest node that can be reached, for every node of the edges (a, b).

    Each round takes the smallest label among neighbours and then the label of the label, so paths
    shorten by more than half; it ends when no label changes. Every round is a written table.
    """
    both = scratch.keep(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(), f"{name}-edges")
    labels = scratch.keep(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")), f"{name}-0")
    step = 0
    while True:
        near = both.join(labels, both.b == labels.node).groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        low = labels.join(near, "node").select("node", "label", F.least("label", "near").alias("low"))
        step += 1
        low = scratch.keep(low, f"{name}-{step}l")
        jump = low.select(F.col("node").alias("low"), F.col("low").alias("lower"))
        new = low.join(jump, "low", "left").select("node", F.coalesce("lower", "low").alias("label"), (F.coalesce("lower", "low") < F.col("label")).alias("moved"))
        new = scratch.keep(new, f"{name}-{step}")
        moved = new.where("moved").limit(1).count()
        scratch.drop(f"{name}-{step - 1}", f"{name}-{step}l")
        labels = new.select("node", "label")
        if not moved:
            scratch.drop(f"{name}-edges")
            return labels
