"""Repair of row labels. What needs several passes over tokens runs as an Arrow UDF on distinct labels, joined back."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import is_year, parse_amount
from ..functions.text import has_phrase, normalize_text, strip
from ..plans.scratch import kept_small

#: Words that scans tend to split; a parameter of the functions below.
WORDS = ("and", "ratio", "ratios", "operations", "expenditures", "activity", "activities", "value", "revaluation", "invested", "particulars", "june", "employee", "profit", "charges", "sales", "revenue", "operating", "assets", "liabilities", "equity", "depreciation", "financial", "property", "equipment")


def stop_reason(cell: Column) -> Column:
    """L1: why a label doesn't go on into this cell; null if it does."""
    x = strip(cell)
    return F.when(x == "", "blank").when(is_year(x), "year").when(x.rlike(r"^[0-9.,()-]+\s*%$"), "percent").when(normalize_text(x).rlike("^note [0-9]+$"), "note").when(x.rlike(r"^(AAA|AA|A|BBB|BB|B)[+-]?$"), "rating").when(parse_amount(x).isNotNull(), "numeric").when(~x.rlike("[A-Za-z]"), "not_text")


def reconstruct(cells: DataFrame) -> DataFrame:
    """L1: each row's label with the text cells that follow it, and how sure that is."""
    row = ["page_number", "table_index", "row_index"]
    w = Window.partitionBy(*row).orderBy("col_index")
    c = cells.withColumn("stop", stop_reason(F.col("cell")))
    c = c.withColumn("begun", F.sum(F.when(F.col("stop").isNull(), 1).otherwise(0)).over(w))
    c = c.withColumn("ended", F.max(F.when((F.col("begun") > 0) & F.col("stop").isNotNull(), 1).otherwise(0)).over(w))
    part = c.where("begun > 0 and ended = 0")
    stop = c.where("ended = 1 and begun > 0").groupBy(*row).agg(F.min_by("stop", "col_index").alias("stop_reason"))
    g = part.groupBy(*row).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("col_index", "cell"))), lambda x: strip(x["cell"])), " ").alias("label"), F.count("*").cast("int").alias("parts"))
    sure = 0.72 + F.when(F.col("parts") > 1, 0.18).otherwise(0.0) + F.when(F.coalesce("stop_reason", F.lit("")).isin("numeric", "year"), 0.06).otherwise(0.0) - F.when(F.col("parts") > 4, 0.12).otherwise(0.0) + F.when(F.length("label") >= 12, 0.03).otherwise(0.0)
    return g.join(stop, row, "left").select(*row, "label", "parts", "stop_reason", F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), sure)), 2).alias("confidence"))


def _glue(label: str, words: frozenset[str], passes: int = 4) -> str:
    tokens = label.split()
    for _ in range(passes):
        out, i = [], 0
        while i < len(tokens):
            pair = tokens[i] + tokens[i + 1] if i + 1 < len(tokens) else ""
            known = tokens[i].lower() in words and tokens[i + 1].lower() in words if pair else False
            if pair.lower() in words and not known:
                out.append(pair)
                i += 2
            else:
                out.append(tokens[i])
                i += 1
        if out == tokens:
            break
        tokens = out
    return " ".join(tokens)


def deglue(rows: DataFrame, column: str = "label", words: tuple[str, ...] = WORDS) -> DataFrame:
    """L2: joins neighbouring pieces that together are a known word, again and again."""
    known = frozenset(words)

    @F.pandas_udf("string")
    def repair(labels: pd.Series) -> pd.Series:
        return labels.map(lambda x: _glue(x, known) if isinstance(x, str) else None)

    once = rows.select(column).distinct().withColumn("repaired", repair(F.col(column)))
    return rows.join(once, column, "left")


def fuzzy(rows: DataFrame, phrases: tuple[str, ...], column: str = "label", least: float = 0.86) -> DataFrame:
    """The phrase that a window of the label's words is most like, by matching blocks."""

    @F.pandas_udf("phrase string, ratio double")
    def best(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        from difflib import SequenceMatcher

        for labels in batches:
            out = []
            for label in labels:
                words, top = (label or "").split(), (None, 0.0)
                for p in phrases:
                    n = len(p.split())
                    for size in range(max(1, n - 1), n + 3):
                        for i in range(max(1, len(words) - size + 1)):
                            ratio = SequenceMatcher(None, " ".join(words[i : i + size]), p).ratio()
                            if ratio >= least and ratio > top[1]:
                                top = (p, round(ratio, 6))
                out.append(top)
            yield pd.DataFrame(out, columns=["phrase", "ratio"])

    once = rows.select(column).distinct().withColumn("m", best(F.col(column)))
    return rows.join(once.select(column, "m.phrase", "m.ratio"), column, "left")


def note_context(rows: DataFrame) -> DataFrame:
    """Labels that depend on what stands above get the section or note header before them.

    rows: page_number, table_index, row_index, label, has_value, header (a note header), dependent.
    A new note header clears the section; a row without value that is no header is a section.
    """
    w = Window.partitionBy("page_number", "table_index").orderBy("row_index").rowsBetween(Window.unboundedPreceding, -1)
    at = F.struct("row_index", "label")
    note = F.last(F.when(F.col("header"), at), ignorenulls=True).over(w)
    section = F.last(F.when(~F.col("header") & ~F.col("has_value"), at), ignorenulls=True).over(w)
    r = rows.withColumn("note", note).withColumn("section", section)
    live = F.when(F.col("note").isNull() | (F.col("section.row_index") > F.col("note.row_index")), F.col("section.label"))
    context = F.coalesce(live, F.col("note.label"))
    return r.withColumn("inherited", F.when(F.col("has_value") & F.col("dependent") & context.isNotNull() & ~has_phrase(normalize_text(F.col("label")), normalize_text(context)), F.concat_ws(" - ", context, "label")).otherwise(F.col("label"))).drop("note", "section")


def strip_parent(label: Column) -> Column:
    """What follows the last spaced dash."""
    parts = F.split(label, r"\s+[-–—]\s+")
    return F.when(F.size(parts) > 1, F.element_at(parts, -1)).otherwise(label)


def canonical(labels: DataFrame, aliases: DataFrame) -> DataFrame:
    """The longest alias (metric, alias, ordinal) that is the label, or of several words and a phrase of it.

    Distinct labels and their phrases meet the aliases by equality; no pair of a label and an alias is tried in vain. What is found is
    kept and counted, so that few labels of many rows are broadcast: a shuffle by label would deal all rows to a few tasks.
    """
    a = aliases.select("metric", normalize_text(F.col("alias")).alias("phrase"), "ordinal")
    words = F.split(F.col("norm"), " ")
    n = F.size(words)

    def phrases(size: int) -> Column:
        return F.when(n > size, F.transform(F.sequence(F.lit(1), n - size + 1), lambda i: F.array_join(F.slice(words, i, F.lit(size)), " "))).otherwise(F.array().cast("array<string>"))

    longest = a.agg(F.max(F.size(F.split("phrase", " ")))).first()[0] or 1
    once = labels.select("label").distinct().withColumn("norm", normalize_text(F.col("label")))
    said = F.array_distinct(F.concat(F.array("norm"), *[phrases(k) for k in range(2, longest + 1)]))
    best = once.select("label", F.explode(said).alias("phrase")).where("phrase <> ''").join(F.broadcast(a), "phrase").groupBy("label").agg(F.max_by("metric", F.struct(F.length("phrase"), -F.col("ordinal"))).alias("metric"))
    return labels.join(kept_small(best, "canonical"), "label", "left")
