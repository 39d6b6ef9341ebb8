"""Accounting rules, label checks and scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import amounts_match
from ..functions.text import normalize_text
from ..plans import dims

ISSUE = ["entity_id", "value_year", "rule_name", "severity", "expected", "actual"]


def sum_rule(rows: DataFrame, name: str, severity: str, actual: str, terms: list[tuple[str, int]]) -> DataFrame:
    """Actual should be the signed sum of terms; a row that lacks one is skipped."""
    total = sum((F.col(c) * s for c, s in terms[1:]), F.col(terms[0][0]) * terms[0][1])
    bad = total.isNotNull() & F.col(actual).isNotNull() & ~amounts_match(total.cast("double"), F.col(actual).cast("double"))
    return rows.where(bad).select("entity_id", "value_year", F.lit(name).alias("rule_name"), F.lit(severity).alias("severity"), F.round(total.cast("double"), 4).alias("expected"), F.round(F.col(actual).cast("double"), 4).alias("actual"))


def ratio_rule(rows: DataFrame, name: str, severity: str, actual: str, over: str, under: str) -> DataFrame:
    """A ratio; a denominator of zero is an issue; an actual in percent may stand for a fraction."""
    expected = F.col(over).cast("double") / F.nullif(F.col(under).cast("double"), F.lit(0.0))
    a = F.col(actual).cast("double")
    as_fraction = F.when(~amounts_match(expected, a, 0.0001) & (F.abs(expected) <= 1) & (F.abs(a) > 1), a / 100).otherwise(a)
    bad = F.when(F.col(under) == 0, True).otherwise(~amounts_match(expected, as_fraction, 0.0001))
    return rows.where(bad & F.col(over).isNotNull() & F.col(under).isNotNull() & a.isNotNull()).select("entity_id", "value_year", F.lit(name).alias("rule_name"), F.lit(severity).alias("severity"), F.round(expected, 4).alias("expected"), F.round(a, 4).alias("actual"))


def scores(entities: DataFrame, issues: DataFrame) -> DataFrame:
    """100 less deductions for distinct issues, within 0 and 100; valid from 80 if nothing is critical."""
    cost = F.coalesce(*[F.when(F.col("severity") == k, v) for k, v in dims.DEDUCTIONS.items()], F.lit(10))
    once = issues.select("entity_id", "rule_name", "severity", "expected", "actual").distinct()
    g = once.groupBy("entity_id").agg(F.sum(cost).alias("cost"), F.max(F.col("severity") == "critical").alias("critical"))
    score = F.greatest(F.lit(0), F.least(F.lit(100), 100 - F.coalesce("cost", F.lit(0)))).cast("double")
    return entities.join(g, "entity_id", "left").select("entity_id", score.alias("score"), ((score >= 80) & ~F.coalesce("critical", F.lit(False))).alias("is_valid"))


def duplicate_labels(cells: DataFrame) -> DataFrame:
    """Labels that a table has more than once, sorted and joined."""
    g = cells.where("col_index = 0 and row_index > 0").select("page_number", "table_index", normalize_text(F.col("cell")).alias("label")).where("label <> ''").groupBy("page_number", "table_index", "label").count().where("count > 1")
    return g.groupBy("page_number", "table_index").agg(F.array_join(F.sort_array(F.collect_list("label")), ", ").alias("labels"))


def missing(observed: DataFrame, required: list[str]) -> DataFrame:
    """Required metrics that an entity has not: one pass, an array of what is there, no cross product."""
    have = observed.groupBy("entity_id").agg(F.collect_set("metric").alias("have"))
    return have.select("entity_id", F.explode(F.array_except(F.array(*map(F.lit, required)), F.col("have"))).alias("metric"))


def years_out_of_order(years: DataFrame) -> DataFrame:
    """Tables whose header years don't strictly fall from left to right."""
    w = Window.partitionBy("page_number", "table_index").orderBy("col_index")
    return years.withColumn("before", F.lag("value_year").over(w)).groupBy("page_number", "table_index").agg(F.coalesce(F.max(F.col("before") <= F.col("value_year")), F.lit(False)).alias("bad")).where("bad").drop("bad")


def first_values(observations: DataFrame) -> DataFrame:
    """The first observation of each metric as a column: no join per term of a rule."""
    return observations.groupBy("entity_id", "metric").agg(F.min_by("value", "ordinal").alias("value"))
