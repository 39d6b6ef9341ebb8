"""Page assembly: grids of a page get the types that a classifier found on it, in six stages, each on what those before have left.

raw: page_number, raw (its index), text, n_years, n_labels, n_values, detected_id, x0, y0, x1, y1.
classified: page_number, cls (its index), table_type, detected_id, page_table_index, x0, y0, x1, y1.

Pairs are only made within a page, where both sides are few. Every stage yields candidates with a precedence; one greedy pass per page
over all of them, by precedence and then score, leaves each stage just the residue of the stages before it.
Null ids, boxes and indexes never match; a page without one of the sides has unmatched rows only.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import compact, has_phrase, normalize_text, snake_key
from ..plans import dims
from .matching import assign, overlaps

#: Methods by precedence; the two kinds of order are one method.
METHODS = ["detected_table_id", "bbox", "order", "order", "fallback_text_similarity", "fallback_structural_pattern"]
RECOVERED = ["detected_table_id", "bbox", "order", "fallback_structural_pattern"]


def name_tokens(table_type: Column) -> Column:
    """What a type's name says: tokens of three letters or more that are no stop word."""
    return F.filter(F.split(snake_key(table_type), "_"), lambda t: (F.length(t) > 2) & ~t.isin(dims.TYPE_STOPS))


def _of_type(key: Column, lists: Mapping[str, Sequence[str]]) -> Column:
    """The list of a type, from a vocabulary of a few types that is a literal map of the plan."""
    if not lists:
        return F.array().cast("array<string>")
    return F.element_at(F.create_map(*[x for k, v in lists.items() for x in (F.lit(k), F.array(*map(F.lit, v)))]), key)


def text_score(text: Column, table_type: Column, keywords: Mapping[str, Sequence[str]] = dims.TYPE_KEYWORDS) -> Column:
    """A point for each word of each keyword of the type that the normalized text has; of types without keywords, the name's tokens."""
    words = F.coalesce(_of_type(snake_key(table_type), keywords), name_tokens(table_type))
    return F.aggregate(F.filter(words, lambda p: has_phrase(text, p)), F.lit(0), lambda s, p: s + F.size(F.split(p, " ")))


def structural_score(text: Column, table_type: Column, n_years: Column, n_labels: Column, signals: Mapping[str, Sequence[str]] = dims.TYPE_SIGNALS, profiles: Mapping[str, str] = dims.TYPE_PROFILES) -> Column:
    """Signals of the type's profile in the text, also without its spaces; years and labels add to what was found."""
    key = snake_key(table_type)
    profile = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in profiles.items() for x in kv]), key), key)
    small = F.replace(text, F.lit(" "), F.lit(""))
    found = F.filter(_of_type(profile, signals), lambda p: has_phrase(text, p) | ((F.length(compact(p)) >= 8) & F.contains(small, compact(p))))
    points = F.aggregate(found, F.lit(0), lambda s, p: s + F.greatest(F.lit(1), F.least(F.lit(3), F.floor(F.size(F.split(p, " ")) / 2).cast("int"))))
    return F.when(points > 0, points + F.when(n_years > 0, 1).otherwise(0) + F.when(n_labels >= 3, 1).otherwise(0)).otherwise(0)


def _pairs(raw: DataFrame, classified: DataFrame) -> DataFrame:
    """Every grid with every type of its page, and both scores."""
    r = raw.select("page_number", "raw", normalize_text(F.coalesce("text", F.lit(""))).alias("t"), "n_years", "n_labels")
    p = r.join(classified.select("page_number", "cls", "table_type"), "page_number")
    return p.select("page_number", "raw", "cls", "table_type", text_score(F.col("t"), F.col("table_type")).alias("said"), structural_score(F.col("t"), F.col("table_type"), F.col("n_years"), F.col("n_labels")).alias("built"))


def candidates(raw: DataFrame, classified: DataFrame, pairs: DataFrame) -> DataFrame:
    """(page_number, precedence, score, raw, cls) of all six stages."""

    def stage(df: DataFrame, precedence: int, score: Column) -> DataFrame:
        return df.select("page_number", F.lit(precedence).alias("precedence"), score.cast("double").alias("score"), "raw", "cls")

    none = F.lit(0.0)
    # Of types with the same id the last counts
    by_id = classified.where("detected_id is not null and detected_id <> ''").groupBy("page_number", "detected_id").agg(F.max("cls").alias("cls"))
    same = raw.select("page_number", "raw", "detected_id").join(by_id, ["page_number", "detected_id"])
    boxes = [d.where("x0 is not null and y0 is not null and x1 is not null and y1 is not null").withColumnRenamed(k, "box_index") for d, k in ((raw, "raw"), (classified, "cls"))]
    placed = classified.select("page_number", "cls", F.col("page_table_index").alias("raw")).join(raw.select("page_number", "raw"), ["page_number", "raw"])
    one = lambda d, k: d.groupBy("page_number").agg(F.count("*").alias("n"), F.max(k).alias(k)).where("n = 1").drop("n")
    alone = one(raw, "raw").join(one(classified, "cls"), "page_number")
    stages = [stage(same, 0, none), stage(overlaps(*boxes, crowded=False), 1, F.col("score")), stage(placed, 2, none), stage(alone, 3, none), stage(pairs.where("said > 0"), 4, F.col("said")), stage(pairs.where("built >= 3"), 5, F.col("built"))]
    out = stages[0]
    for s in stages[1:]:
        out = out.unionByName(s)
    return out


def assemble(raw: DataFrame, classified: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(page_number, raw, cls, table_type, method) of every grid, with cls null and the type unclassified where none was left;
    and (page_number, cls, table_type, covered) of the types without a grid: covered if an assigned grid has the structure of it."""
    pairs = _pairs(raw, classified)
    method = F.element_at(F.array(*map(F.lit, METHODS)), F.col("precedence") + 1)
    won = assign(candidates(raw, classified, pairs)).select("page_number", "raw", "cls", method.alias("method"))
    named = won.join(classified.select("page_number", "cls", "table_type"), ["page_number", "cls"])
    grids = raw.select("page_number", "raw").join(named, ["page_number", "raw"], "left").withColumn("table_type", F.coalesce("table_type", F.lit("unclassified")))
    left = classified.select("page_number", "cls", "table_type").join(won, ["page_number", "cls"], "left_anti")
    profile = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in dims.TYPE_PROFILES.items() for x in kv]), snake_key(F.col("table_type"))), snake_key(F.col("table_type")))
    held = pairs.join(won.select("page_number", "raw"), ["page_number", "raw"]).groupBy("page_number", "cls").agg(F.max("built").alias("built"))
    left = left.join(held, ["page_number", "cls"], "left").select("page_number", "cls", "table_type", (~profile.isin(dims.PRIMARY_PROFILES) & (F.coalesce("built", F.lit(0)) >= 4)).alias("covered"))
    return grids.select("page_number", "raw", "cls", "table_type", "method"), left


def pages(raw: DataFrame, grids: DataFrame, left: DataFrame, classified: DataFrame) -> DataFrame:
    """Counts of each page: what was found, matched by which method, left over and recovered."""
    is_ = lambda *m: F.col("method").isin(*m)
    g = grids.join(raw.select("page_number", "raw", "n_values"), ["page_number", "raw"]).groupBy("page_number").agg(
        F.count("*").alias("extracted"), F.count("method").alias("matched"), F.count_if(is_("detected_table_id")).alias("id_matches"), F.count_if(is_("bbox")).alias("bbox_matches"), F.count_if(is_("order")).alias("order_matches"),
        F.count_if(is_("fallback_text_similarity")).alias("fallback_matches"), F.count_if(is_("fallback_structural_pattern")).alias("structural"), F.count_if(is_(*RECOVERED)).alias("recovered"),
        F.coalesce(F.sum(F.when(is_(*RECOVERED), F.col("n_values"))), F.lit(0)).cast("long").alias("values_recovered"), F.array_join(F.sort_array(F.collect_list(F.when(F.col("method").isNull(), F.col("raw")))).cast("array<string>"), ",").alias("unmatched_extractions"),
    )
    c = classified.groupBy("page_number").agg(F.count("*").alias("classified"))
    names = F.transform(F.sort_array(F.collect_list(F.when(~F.col("covered"), F.struct("cls", "table_type")))), lambda x: x["table_type"])
    l = left.groupBy("page_number").agg(F.count_if("covered").alias("covered"), F.array_join(names, ",").alias("unmatched_classifications"))
    p = c.join(g, "page_number", "full").join(l, "page_number", "left")
    n = lambda x: F.coalesce(x, F.lit(0)).alias(x)
    return p.select(
        "page_number", *map(n, ("classified", "extracted", "matched", "id_matches", "bbox_matches", "order_matches", "fallback_matches", "recovered", "values_recovered")),
        (F.coalesce("fallback_matches", F.lit(0)) + F.coalesce("structural", F.lit(0)) + F.coalesce("covered", F.lit(0))).alias("fallback_matches_applied"), (F.coalesce("structural", F.lit(0)) + F.coalesce("covered", F.lit(0))).alias("unmatched_reduced"),
        F.coalesce("unmatched_classifications", F.lit("")).alias("unmatched_classifications"), F.coalesce("unmatched_extractions", F.lit("")).alias("unmatched_extractions"),
    )


def report(found: DataFrame, key: str) -> DataFrame:
    """A4: sums of the pages of each report."""
    numbers = [c for c, kind in found.dtypes if kind == "bigint" and c not in (key, "page_number")]
    return found.groupBy(key).agg(*[F.sum(c).alias(c) for c in numbers])
