"""An extension: reports arrive as a stream and the best values are kept up to date."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators.consolidate import best_value


def consolidate_stream(candidates: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Each micro-batch competes with the values that stand, and a new version is written beside the old one.

    Versions are folders named by batch; the last one with a success mark counts, so a batch that is run again
    after a failure overwrites its own folder only.
    """

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rows = batch
        if number:
            try:
                rows = spark.read.parquet(f"{path}/v={number - 1}").select(*batch.columns).unionByName(batch)
            except Exception as e:
                if "PATH_NOT_FOUND" not in str(e):
                    raise
        best_value(rows).select(*batch.columns).write.mode("overwrite").parquet(f"{path}/v={number}")

    return candidates.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
