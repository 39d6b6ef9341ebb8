"""Registry normalization: labels to metrics, by equality first, then by the nearest vector; with and without what stands before the last dash.

A fact and its mapping are one row from here on, so rows, values and mappings can't come apart. Every distinct label, and every distinct
child of one, is looked up once, all of them together.

Results for odd input: null and blank labels have no metric and a confidence of 0; a label without a vector has no nearest one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import normalize_text, strip
from .workbook import nearest

EXACT, ALIAS, STRONG, REVIEW = 1.0, 0.96, 0.90, 0.80


def looked_up(labels: DataFrame, terms: DataFrame, vectors: DataFrame | None = None, registry: DataFrame | None = None) -> DataFrame:
    """J10, J11, N14 for distinct labels: (label, key, confidence, requires_review).

    terms: key, kind (0 canonical, 1 alias), term as normalized, ordinal: the first key that claims a term has it.
    vectors: label, embedding. registry: vec_id, key, embedding; the nearest vector counts for labels that no term is.
    A key of less confidence than REVIEW is left out, and the label is to be reviewed.
    """
    first = terms.groupBy(F.col("term").alias("norm")).agg(F.min(F.struct("kind", "ordinal", "key")).alias("x"))
    found = labels.select("label").distinct().withColumn("norm", normalize_text(F.col("label"))).join(first, "norm", "left")
    found = found.select("label", F.col("x.key").alias("key"), F.when(F.col("x.kind") == 0, EXACT).when(F.col("x.kind") == 1, ALIAS).alias("confidence"))
    if vectors is not None and registry is not None:
        open_ = found.where("key is null").select("label").join(vectors, "label").select(F.col("label").alias("vec_id"), "embedding")
        near = nearest(open_, registry.select("vec_id", "embedding")).join(registry.select(F.col("vec_id").alias("best"), F.col("key").alias("near_key")), "best")
        found = found.join(near.select(F.col("vec_id").alias("label"), "near_key", F.greatest(F.lit(0.0), F.least(F.lit(1.0), "score")).alias("score")), "label", "left")
        found = found.select("label", F.coalesce("key", "near_key").alias("key"), F.coalesce("confidence", "score").alias("confidence"))
    sure = F.coalesce("confidence", F.lit(0.0))
    return found.select("label", F.when(sure >= REVIEW, F.col("key")).alias("key"), sure.alias("confidence"), (F.col("key").isNull() | (sure < REVIEW)).alias("requires_review"))


def parent_and_child(label: Column) -> tuple[Column, Column]:
    """What stands before the last spaced dash, and after it; null unless both have letters."""
    parts = F.filter(F.transform(F.split(label, r"\s+[-–—]\s+"), strip), lambda p: p != "")
    parent, child = F.array_join(F.slice(parts, 1, F.greatest(F.lit(1), F.size(parts) - 1)), " - "), F.element_at(parts, -1)
    both = (F.size(parts) >= 2) & parent.rlike("[A-Za-z]") & child.rlike("[A-Za-z]")
    return F.when(both, parent), F.when(both, child)


def normalized(facts: DataFrame, terms: DataFrame, vectors: DataFrame | None = None, registry: DataFrame | None = None) -> DataFrame:
    """The facts (column ``metric``) with the metric normalized and the mapping beside it.

    The child alone counts if it is a strong match, unless the whole label is a strong match of something else.
    """
    parent, child = parent_and_child(F.col("label"))
    once = facts.select(F.col("metric").alias("label")).distinct().withColumn("parent", parent).withColumn("child", child)
    both = once.select("label").unionByName(once.where("child is not null").select(F.col("child").alias("label")))
    known = looked_up(both, terms, vectors, registry)
    own, of_child = (known.select(F.col("label").alias(name), F.struct("key", "confidence", "requires_review").alias(f"{name}_is")) for name in ("label", "child"))
    d = once.join(own, "label", "left").join(of_child, "child", "left")
    strong = lambda x: F.col(f"{x}.key").isNotNull() & (F.col(f"{x}.confidence") >= STRONG)
    stripped = F.coalesce(strong("child_is") & ~(strong("label_is") & (F.col("label_is.key") != F.col("child_is.key"))), F.lit(False))
    d = d.withColumn("stripped", stripped).withColumn("is", F.when(F.col("stripped"), F.col("child_is")).otherwise(F.col("label_is")))
    d = d.select(
        F.col("label").alias("original_metric"), F.col("is.key").alias("normalized_metric"), F.coalesce("is.confidence", F.lit(0.0)).alias("confidence"), F.coalesce("is.requires_review", F.lit(True)).alias("requires_review"),
        F.when(F.col("stripped"), F.col("parent")).alias("parent_metric_context"), F.when(F.col("stripped"), F.col("child")).alias("child_metric"), F.when(F.col("stripped"), "parent_prefix_stripping").alias("normalization_rule"),
    )
    out = facts.withColumnRenamed("metric", "original_metric").join(d, "original_metric", "left")
    return out.withColumn("metric", F.coalesce("normalized_metric", "original_metric")).withColumn("confidence", F.coalesce("confidence", F.lit(0.0))).withColumn("requires_review", F.coalesce("requires_review", F.lit(True)))


def relabelled(cells: DataFrame, terms: DataFrame) -> DataFrame:
    """Grids whose label cells (the first of a row with a letter) are the keys of the registry, where it has one."""
    row = ["page_number", "table_index", "row_index"]
    text = strip(F.coalesce("cell", F.lit("")))
    at = cells.where(text.rlike("[A-Za-z]")).groupBy(*row).agg(F.min(F.struct("col_index", text.alias("label"))).alias("l")).select(*row, F.col("l.col_index").alias("col_index"), F.col("l.label").alias("label"))
    keys = at.join(looked_up(at, terms).where("key is not null").select("label", "key"), "label").select(*row, "col_index", "key")
    return cells.withColumn("cell", text).join(keys, [*row, "col_index"], "left").withColumn("cell", F.coalesce("key", "cell")).drop("key")
