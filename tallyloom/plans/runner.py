"""Layers in order, each by itself: a failed layer is recorded and does not stop the others."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Layer = Callable[[SparkSession, dict[str, DataFrame]], dict[str, DataFrame]]


def run_layers(spark: SparkSession, layers: list[tuple[str, Layer]], tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Adds each layer's tables to the others, and layer_results and pipeline_errors (Q8: FAILED if there is an error)."""
    tables, results, errors = dict(tables), [], []
    for name, layer in layers:
        began = time.perf_counter()
        try:
            tables |= layer(spark, tables)
            status = "SUCCESS"
        except Exception as e:
            errors.append((name, type(e).__name__, str(e)[:2000] or type(e).__name__))
            status = "FAILED"
        results.append((name, status, time.perf_counter() - began))
    tables["layer_results"] = spark.createDataFrame(results, "layer string, status string, seconds double")
    tables["pipeline_errors"] = spark.createDataFrame(errors, "layer string, error string, message string")
    return tables
