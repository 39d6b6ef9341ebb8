"""Sinks: JSON documents, a folder of tables for each sheet, audits."""

from __future__ import annotations

import logging
import uuid
from datetime import datetime, timezone

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

log = logging.getLogger(__name__)


def context_json(tables: dict[str, DataFrame], path: str) -> None:
    """K1: a folder of JSON lines for each table, by report year where it has one."""
    for name, df in tables.items():
        w = df.write.mode("overwrite")
        (w.partitionBy("source_report_year") if "source_report_year" in df.columns else w).json(f"{path}/{name}")


def sheets(sheets: dict[str, DataFrame], path: str, form: str = "csv") -> list[str]:
    """K2: a folder for each sheet that has rows; none at all makes an empty model."""
    from ..functions.text import sheet_base

    out = []
    for name, df in sheets.items():
        if df.limit(1).count():
            safe = df.sparkSession.range(1).select(sheet_base(F.lit(name))).first()[0]
            df.write.mode("overwrite").option("header", "true").format(form).save(f"{path}/{safe}")
            out.append(safe)
    return out


def cell_plan(template: DataFrame, values: DataFrame) -> DataFrame:
    """K3: what happens to each cell: formulas are never overwritten. values: sheet, row, col, new."""
    p = template.join(values, ["sheet", "row", "col"], "full_outer")
    action = F.when(F.col("new").isNull(), "keep").when(F.coalesce("value", F.lit("")).startswith("="), "keep_formula").when(F.col("value").isNull(), "create").when(F.col("value") == F.col("new"), "reuse").otherwise("replace")
    return p.select("sheet", "row", "col", F.col("value").alias("old"), "new", action.alias("action"))


def unique_name(stem: str, extension: str) -> str:
    """K4."""
    return f"{stem}_{datetime.now(timezone.utc):%Y%m%dT%H%M%SZ}_{uuid.uuid4().hex[:8]}.{extension}"


def audit(decisions: DataFrame, path: str) -> bool:
    """K5: the governance decisions as JSON; a failure is logged, never raised."""
    try:
        decisions.select(F.to_json(F.struct("*")).alias("value")).write.mode("overwrite").text(path)
        return True
    except Exception:
        log.exception("audit not written")
        return False
