"""What goes into a workbook, as tables: pivots, sheets, coverage; and the registry's lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import normalize_text, sheet_base, title_case
from ..plans import dims


def pivot(values: DataFrame, years: list[int] | None = None) -> DataFrame:
    """Metric by year; a cell is its last write, rows of a sheet are numbered as they were first seen. Without ``years`` all of the values' years, which one pass looks for."""
    if years is None:
        years = sorted(r.value_year for r in values.select("value_year").where("value_year is not null").distinct().collect())
    g = values.groupBy("metric", "table_type", "value_year").agg(F.max_by("value", "input_key").alias("value"), F.min("input_key").alias("first"))
    cell = lambda y: F.max(F.when(F.col("value_year") == y, F.col("value"))).alias(f"y{y}")
    p = g.groupBy("metric", "table_type").agg(*map(cell, years), F.min("first").alias("first"))
    order = F.row_number().over(Window.partitionBy("table_type").orderBy("first")).alias("row_order")
    return p.select("metric", "table_type", *[f"y{y}" for y in years], order)


def suffixed(values: DataFrame) -> DataFrame:
    """A10: a metric that several table types have is told apart by the type."""
    d = values.select("metric", "table_type").distinct()
    n = F.count("*").over(Window.partitionBy("metric"))
    return d.select("metric", "table_type", F.when(n > 1, F.concat("metric", F.lit(" ("), "table_type", F.lit(")"))).otherwise(F.col("metric")).alias("label"))


def sheet(table_type: Column) -> Column:
    """The sheet of a table type, else its name in title case."""
    return F.coalesce(*[F.when(table_type == k, v) for k, v in dims.SHEETS.items()], title_case(F.replace(table_type, F.lit("_"), F.lit(" "))))


def coverage(values: DataFrame, metrics: int, years: int) -> DataFrame:
    """Weighted shares of a template's metrics and years that the values have."""
    g = values.groupBy("table_type").agg(F.count_distinct("metric").alias("have"), F.count_distinct("value_year").alias("years"))
    return g.select("table_type", F.round(50.0 * F.col("have") / metrics + 25.0 * F.least(F.col("years"), F.lit(years)) / years, 2).alias("score"))


def sheet_names(names: DataFrame) -> DataFrame:
    """Names that are the same but for case get _2, _3 and so on within the length."""
    n = names.withColumn("base", sheet_base(F.col("name")))
    k = F.row_number().over(Window.partitionBy(F.lower("base")).orderBy("id"))
    tail = F.concat(F.lit("_"), F.col("k").cast("string"))
    return n.withColumn("k", k).withColumn("sheet", F.when(F.col("k") == 1, F.col("base")).otherwise(F.concat(F.substr("base", F.lit(1), 31 - F.length(tail)), tail)))


def batches(rows: DataFrame, group: list[str], order: list[str], size: int) -> DataFrame:
    """Numbered batches inside each group."""
    rn = F.row_number().over(Window.partitionBy(*group).orderBy(*order))
    return rows.withColumn("batch", F.floor((rn - 1) / size).cast("long"))


def lookup(labels: DataFrame, terms: DataFrame) -> DataFrame:
    """Registry terms (key, kind 0 exact or 1 alias, term): the exact ones first, then the first alias."""
    best = terms.groupBy(F.col("term").alias("norm")).agg(F.min(F.struct("kind", "key")).alias("x"))
    confidence = F.when(F.col("x.kind") == 0, 1.0).when(F.col("x.kind") == 1, 0.96)
    return labels.withColumn("norm", normalize_text(F.col("label"))).join(best, "norm", "left").select("insight_id", "label", F.col("x.key").alias("key"), confidence.alias("confidence"))


def nearest(queries: DataFrame, registry: DataFrame, most: int = 5000) -> DataFrame:
    """The registry vector of greatest cosine for each query, ties by the least id.

    The registry becomes arrays that every query scans, of about ``most`` vectors each, so no rows of pairs are made; the bests of several
    blocks are compared in the end.
    """
    blocks = max(1, -(-registry.count() // most))
    if blocks == 1:
        return _nearest_block(queries, registry).select("vec_id", "best", "score")
    dealt = [registry.where(F.pmod(F.hash("vec_id"), F.lit(blocks)) == k) for k in range(blocks)]
    bests = _nearest_block(queries, dealt[0])
    for block in dealt[1:]:
        bests = bests.unionByName(_nearest_block(queries, block))
    top = F.max(F.when(F.col("best").isNotNull(), F.struct("score", (-F.col("best")).alias("neg"))))
    return bests.groupBy("vec_id").agg(top.alias("b")).select("vec_id", (-F.col("b.neg")).alias("best"), "b.score")


def _nearest_block(queries: DataFrame, registry: DataFrame) -> DataFrame:
    unit = lambda v: F.transform(v, lambda x: x.cast("double"))
    r = registry.agg(F.collect_list(F.struct("vec_id", unit(F.col("embedding")).alias("v"))).alias("r"))
    q = queries.select("vec_id", unit(F.col("embedding")).alias("q")).withColumn("r", r.scalar())
    dot = "aggregate(zip_with({a}, {b}, (u, w) -> u * w), 0D, (s, z) -> s + z)"
    score = f"round({dot.format(a='q', b='x.v')} / sqrt({dot.format(a='q', b='q')} * {dot.format(a='x.v', b='x.v')}), 4)"
    best = F.expr(f"array_max(transform(r, x -> struct({score} as score, -x.vec_id as neg)))")
    return q.select("vec_id", best.alias("b")).select("vec_id", (-F.col("b.neg")).alias("best"), "b.score")
