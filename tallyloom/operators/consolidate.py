"""One value for each metric and year out of all reports' candidates, with the reason.

Candidates: metric, value_year, source_report_year, page_number, table_type, original_metric,
confidence, requires_review, value (whole numbers), input_key (order of arrival).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import compact, strip
from ..plans import dims
from ..plans.scratch import kept

KEY = ["metric", "value_year"]
QUALITY = ["confidence", "cleanliness", "context", "priority"]


def _type(x: str = "table_type") -> Column:
    return F.lower(strip(F.col(x)))


def table_priority() -> Column:
    """P16."""
    t = _type()
    known = F.coalesce(*[F.when(t == k, v) for k, v in dims.PRIMARY_TYPES.items()])
    rest = F.when(t.contains("analysis") | t.contains("ratio"), 75).when(t.contains("schedule"), 65).when(t.contains("note") | t.contains("disclosure"), 35).when(t == "unclassified_table", 0).otherwise(50)
    return F.coalesce(known, rest)


def source_class() -> Column:
    """P16."""
    t = _type()
    return F.when(t.isin(*dims.PRIMARY_TYPES), "primary_statement").when(t.contains("note") | t.contains("disclosure"), "note_disclosure").when(t.contains("analysis") | t.contains("ratio"), "analysis_or_ratio").when(t == "unclassified_table", "unclassified").otherwise("supporting_schedule")


def statement_scope() -> Column:
    t = F.lower(F.concat_ws(" ", "original_metric", "table_type"))
    return F.when(t.rlike(r"\b(?:consolidated|group)\b"), "consolidated").when(t.rlike(r"\b(?:standalone|stand-alone|unconsolidated|separate|company only)\b"), "standalone").otherwise("unknown")


def cut_short(label: Column) -> Column:
    # the word is one of the last few characters
    return (label.contains("(") & label.rlike(dims.CUT_SHORT)) | F.right(label, F.lit(12)).rlike(dims.CUT_WORD)


def cleanliness(label: Column) -> Column:
    """P17."""
    x = strip(label)
    score = 100 - F.when(F.lower(x).rlike(dims.FRAGMENTS), 35).otherwise(0) - F.when(cut_short(x), 25).otherwise(0) - F.when(~x.rlike("(?:[A-Za-z][^A-Za-z]*+){4}"), 15).otherwise(0)
    return F.when(x == "", 0).otherwise(F.greatest(F.lit(0), score + F.least(F.lit(10), F.size(F.regexp_extract_all(x, F.lit("[A-Za-z]+"), F.lit(0))))))


def context_score() -> Column:
    """P18."""
    label = strip(F.col("original_metric"))
    return F.when(F.col("requires_review"), 0).otherwise(30) + F.when(label != strip(F.col("metric")), 10).otherwise(0) + F.when(label.rlike(r"\S\s+\S"), 10).otherwise(0) + F.when(F.col("page_number") > 0, 5).otherwise(0)


def candidates(df: DataFrame) -> DataFrame:
    """Labels fall back to the metric, confidences are clamped; then the scores that rank candidates."""
    label = F.when(strip(F.col("original_metric")) != "", strip(F.col("original_metric"))).otherwise(strip(F.col("metric")))
    df = df.withColumn("confidence", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce("confidence", F.lit(0.0))))).withColumn("original_metric", label).withColumn("requires_review", F.coalesce("requires_review", F.lit(False)))
    return df.withColumn("cleanliness", cleanliness(F.col("original_metric"))).withColumn("context", context_score()).withColumn("priority", table_priority()).withColumn("value_text", F.concat(F.lit("int:"), F.col("value").cast("string")))


def _order() -> list[Column]:
    return [*map(F.desc, QUALITY), F.desc("source_report_year"), F.desc("page_number"), F.asc(_type()), F.asc("value_text"), F.asc("input_key")]


def best_value(df: DataFrame) -> DataFrame:
    """The best candidate of each metric and year. The window keeps one row per task before the shuffle."""
    return _best(candidates(df))


def _best(c: DataFrame) -> DataFrame:
    w = Window.partitionBy(*KEY).orderBy(*_order())
    return c.withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")


def payload(df: DataFrame, most: int = 10) -> DataFrame:
    """The best candidates of each metric and year, ranked, the winner first: a report of the top ``most``, which the window keeps per task before the shuffle."""
    rank = F.row_number().over(Window.partitionBy(*KEY).orderBy(*_order()))
    keep = [*KEY, "value", "source_report_year", "page_number", "table_type", "original_metric", "requires_review", *QUALITY, "input_key"]
    return candidates(df).withColumn("rank", rank).where(F.col("rank") <= most).select(*keep, source_class().alias("source_class"), "rank")


def from_values(values: DataFrame) -> DataFrame:
    """Plain values as candidates: nobody has mapped them, so their confidence is 0 and their label is the metric."""
    return values.withColumn("confidence", F.lit(0.0)).withColumn("original_metric", F.col("metric")).withColumn("requires_review", F.lit(False))


def from_reports(reports: DataFrame, values: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The candidates of a whole context, and (report_id, year, error) of reports that have no values for their year.

    reports: report_id, year. values: source_report_year and a candidate's other columns. A report without values is an error row; the others count.
    """
    years = values.select(F.col("source_report_year").alias("year")).distinct()
    failed = reports.join(years, "year", "left_anti").select("report_id", "year", F.concat(F.lit("no values for report year "), F.col("year").cast("string")).alias("error"))
    known = reports.select(F.col("year").alias("source_report_year")).distinct()
    return values.join(known, "source_report_year", "left_semi"), failed


def _is_ratio() -> Column:
    return F.lower(F.concat_ws(" ", "table_type", "original_metric")).rlike(dims.RATIO_SOURCE)


def _scaled(a: Column, b: Column) -> Column:
    """B is a thousand, a million or a billion times a, within 5 %."""
    return F.exists(F.array(F.lit(1e3), F.lit(1e6), F.lit(1e9)), lambda s: F.abs(b / a - s) / s <= 0.05)


def scale_disagreements(df: DataFrame, keys: list[str] = KEY) -> DataFrame:
    """J15 for each group: whether two absolute values differ by a scale.

    Each distinct value asks for the least one from 0.95 times its thousandfold, millionfold and billionfold on; in a sorted window of a
    stretch of values, not by pairs. A stretch is half a unit of logarithm wide, so that an asked range lies in two at most.
    """
    amount = F.abs(F.col("value").cast("double"))
    values = df.select(*keys, amount.alias("a")).where("a > 0").distinct()
    stretch = lambda x: F.floor(F.log(x) * 2)
    low, high = F.col("a") * F.col("scale") * (0.95 - 1e-12), F.col("a") * F.col("scale") * (1.05 + 1e-12)
    asked = values.select(*keys, "a", F.explode(F.array(F.lit(1e3), F.lit(1e6), F.lit(1e9))).alias("scale")).select(*keys, "a", low.alias("at"), F.explode(F.array_distinct(F.array(stretch(low), stretch(high)))).alias("part"))
    both = asked.withColumn("b", F.lit(None).cast("double")).unionByName(values.select(*keys, F.lit(None).cast("double").alias("a"), F.col("a").alias("at"), stretch(F.col("a")).alias("part"), F.col("a").alias("b")))
    # from the largest down: what has been seen last is the least value from here on
    later = Window.partitionBy(*keys, "part").orderBy(F.desc("at"), F.col("b").isNull()).rowsBetween(Window.unboundedPreceding, 0)
    met = both.withColumn("next", F.min("b").over(later)).where("a is not null and next is not null")
    found = met.groupBy(*keys).agg(F.max(_scaled(F.col("a"), F.col("next"))).alias("found"))
    every = df.select(*keys).distinct()
    return every.join(found, keys, "left").select(*keys, F.coalesce("found", F.lit(False)).alias("disagrees"))


def _facts(df: DataFrame) -> DataFrame:
    """Candidates with what selectors and gates ask of a row."""
    t, label = _type(), F.lower("original_metric")
    c = candidates(df).withColumn("ratio", _is_ratio()).withColumn("compact", compact(F.col("original_metric")))
    c = c.withColumn("sheet", t.isin("balance_sheet", "statement_of_financial_position")).withColumn("income", t.isin("income_statement", "statement_of_profit_or_loss"))
    return c.withColumn("named", F.col("sheet") & label.contains("shareholders") & label.contains("equity"))


def candidate_groups(df: DataFrame) -> DataFrame:
    """A1: the candidates of each metric and year, and their distinct values."""
    return df.groupBy(*KEY).agg(F.count("*").cast("int").alias("candidate_count"), F.count_distinct("value").cast("int").alias("distinct_values"))


def _tied(c: DataFrame, won: DataFrame, name: str) -> DataFrame:
    """Whether rows as good as the winner, of its report, say something else."""
    of = ["source_report_year", *QUALITY]
    same = c.join(won.select(*KEY, *(F.col(x).alias(f"won_{x}") for x in of)), KEY).where(" and ".join(f"{x} = won_{x}" for x in of))
    return same.groupBy(*KEY).agg((F.count_distinct("value_text") > 1).alias(name))


def ties(df: DataFrame) -> DataFrame:
    """W2 for each metric and year."""
    return _tied(candidates(df), best_value(df), "tie")


def _selected(c: DataFrame) -> DataFrame:
    """The best candidate of the selector that applies to a metric, if any has what it asks."""
    label = F.lower("original_metric")
    keep = [*KEY, "source_report_year", "page_number", "table_type", "original_metric", "requires_review", "value", "value_text", "input_key", *QUALITY]
    row = [*KEY, "page_number", "table_type", "compact", "amount"]
    debt = c.where("metric = 'current_portion_long_term_debt'").withColumn("amount", F.abs("value"))
    debt = debt.where("value > 0 and sheet").join(debt.where("value < 0").select(*row).distinct(), row, "left_semi")
    equity = c.where("metric = 'equity'")
    equity = equity.where("sheet and not ratio").join(equity.where("ratio").select(*KEY).distinct(), KEY, "left_semi")
    eps = c.where("metric = 'earnings_per_share' and income").where(label.contains("earnings per share") & (label.contains("basic") | label.contains("diluted")) & ~cut_short(F.col("original_metric")))
    cash = c.where("metric = 'cash_and_bank_balances' and compact = 'cashandbankbalances'").where(source_class() == "primary_statement")
    cash = cash.join(cash.groupBy(*KEY, "value_text").agg(F.count("*").alias("n")).where("n > 1").drop("n"), [*KEY, "value_text"], "left_semi")
    revenue = c.where("metric = 'revenue'")
    scaled = scale_disagreements(revenue).where("disagrees").select(*KEY)
    revenue = revenue.where("income").where(F.col("original_metric").rlike(r"(?i)\b(?:turnover|net revenue|revenue)\b")).join(scaled, KEY, "left_semi")
    # a metric has one selector
    selectors = {
        "auto_positive_balance_sheet_liability": debt,
        "auto_equity_balance_over_ratio_metric": equity,
        "auto_statement_eps_over_summary_or_note": eps,
        "auto_cash_bank_primary_statement_consensus": cash,
        "auto_revenue_full_statement_scale_reconciliation": revenue,
    }
    every = None
    for name, rows in selectors.items():
        rows = rows.select(*keep, F.lit(name).alias("auto"))
        every = rows if every is None else every.unionByName(rows)
    pref = F.when(F.col("metric") != "cash_and_bank_balances", 0).when(_type() == "balance_sheet", 2).when(_type() == "cash_flow_statement", 1).otherwise(0)
    size = F.when(F.col("metric") == "revenue", F.abs("value")).otherwise(0)
    latest = F.when(F.col("metric") == "revenue", F.col("page_number")).otherwise(F.col("source_report_year"))
    w = Window.partitionBy(*KEY).orderBy(F.desc(size), F.desc(pref), *map(F.desc, QUALITY), F.desc(latest), F.desc("page_number"), F.asc("input_key"))
    return every.withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")


def final_groups(df: DataFrame) -> DataFrame:
    """A row for each metric and year: the choice, why, and what it beat.

    Groups are added up, and the winners joined to them; no window holds a group. The candidates are scored once and written, as
    the groups, the ties and the selectors each read them.
    """
    c = kept(_facts(df), "candidates")
    facts = c.groupBy(*KEY).agg(F.count("*").cast("int").alias("candidate_count"), F.count_distinct("value_text").cast("int").alias("distinct_values"), F.max("ratio").alias("any_ratio"), F.max("named").alias("named"), *[F.min(x).alias(f"min_{x}") for x in [*QUALITY, "source_report_year"]], F.max("source_report_year").alias("max_source_report_year"), F.sum(F.col("requires_review").cast("int")).alias("reviews"))
    base = _best(c)
    audited = ((F.col("metric") == "equity") & (F.col("value_year") <= 2023) & F.col("any_ratio") & F.col("named")) | ((F.col("metric") == "revenue") & F.col("value_year").isin(2021, 2022))
    gated = facts.join(_tied(c, base, "tie"), KEY).withColumn("gate", (F.col("candidate_count") > 1) & (F.col("tie") | audited))
    names = ["value", "source_report_year", "page_number", "table_type", "original_metric", "requires_review", *QUALITY]
    auto = _selected(c).join(gated.where("gate").select(*KEY), KEY, "left_semi")
    chosen = auto.select(*KEY, "auto", *names).unionByName(base.join(auto.select(*KEY), KEY, "left_anti").select(*KEY, F.lit(None).cast("string").alias("auto"), *names))
    # the gate is looked at again from the choice: only then does the selector's reason stand
    g = gated.join(chosen, KEY).join(_tied(c, chosen, "tied"), KEY)
    g = g.withColumn("stands", F.col("auto").isNotNull() & (F.col("tied") | (F.col("gate") & ~F.col("tie"))))
    conflict = F.col("distinct_values") > 1
    g = g.withColumn("unresolved", conflict & F.col("tied") & ~F.col("stands"))
    reasons = {"confidence": "higher_normalization_confidence", "cleanliness": "cleaner_reconstructed_label", "context": "more_complete_source_context", "priority": "preferred_financial_statement_source", "source_report_year": "latest_source_report_year"}
    ladder = F.coalesce(F.when(F.col("stands"), F.col("auto")), F.when(F.col("unresolved"), "unresolved_equal_precedence_conflict"), *[F.when(F.col(f"min_{k}") < F.col(k), v) for k, v in reasons.items()], F.lit("stable_tie_break"))
    status = F.when(F.col("unresolved"), "unresolved_conflict").when(conflict, "resolved_conflict").when(F.col("candidate_count") > 1, "duplicate_without_value_conflict").otherwise("single_candidate")
    return g.withColumn("resolution_reason", ladder).withColumn("conflict_status", status)


def summary(df: DataFrame) -> DataFrame:
    """The counters, one row. Q12: every group of two or more counts as a duplicate."""
    g = final_groups(df).where("candidate_count > 1")
    better = F.col("resolution_reason").isin("higher_normalization_confidence", "cleaner_reconstructed_label", "more_complete_source_context", "preferred_financial_statement_source") & (F.col("max_source_report_year") > F.col("source_report_year"))
    total = lambda x: F.coalesce(F.sum(x), F.lit(0)).cast("long")
    return g.agg(
        F.count("*").alias("duplicate_groups_resolved"),
        F.count_if((F.col("distinct_values") > 1) & ~F.col("unresolved")).alias("conflict_groups_resolved"),
        F.count_if("unresolved").alias("unresolved_conflict_groups"),
        F.count_if(better).alias("quality_overrode_recency"),
        total(F.col("candidate_count") - 1).alias("metric_values_removed"),
        total(F.when(~F.col("unresolved"), F.col("reviews") - F.col("requires_review").cast("int"))).alias("review_mappings_reduced"),
    )


def duplicates(df: DataFrame) -> DataFrame:
    """A2: several candidates of one report and table type."""
    g = df.groupBy(*KEY, "source_report_year", "table_type").agg(F.count("*").cast("int").alias("n"), F.count_distinct("value").cast("int").alias("n_values"), F.slice(F.sort_array(F.collect_list("page_number")), 1, 10).alias("pages"))
    return g.where("n > 1").withColumn("pages", F.array_join("pages", ","))


def sign_pairs(df: DataFrame) -> DataFrame:
    """A positive value with its negative on the same row of a page. Grouped, not joined to itself."""
    g = df.groupBy("page_number", "table_type", compact(F.col("original_metric")).alias("label"), F.abs("value").alias("amount")).agg(F.count_if(F.col("value") > 0).alias("n_pos"), F.count_if(F.col("value") < 0).alias("n_neg"))
    return g.where("n_pos > 0 and n_neg > 0")


def upsert(old: DataFrame, new: DataFrame) -> DataFrame:
    """The best value when another report's candidates arrive: the old winners compete with them."""
    return best_value(old.select(*new.columns).unionByName(new)).select(*new.columns)
