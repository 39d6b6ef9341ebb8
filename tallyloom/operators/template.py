"""Templates of workbooks against the values that should go into them: what is there, what is missing, and what to do with each sheet.

values: sheet, metric, value_year. cells: sheet, row, col (from 1), value (text) of the template. All work is grouping by sheet and term;
no sheet is held in one row but its lists of missing terms. Sheets are the same if their names' keys are.
Results for odd input: null cells say nothing; a sheet that the template lacks scores 0; without values there is no row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import snake_key, strip, title_case
from ..plans import dims

AUTO, ASK = 95.0, 80.0
#: Rows in which years are looked for, columns in which a metric is where it should be, missing metrics that a warning names.
YEAR_ROWS, LABEL_COLUMNS, NAMED = 20, 3, 5


def terms(cells: DataFrame) -> DataFrame:
    """(sheet_key, kind, term, placed): the labels of a template's sheets, without words that are no metrics, and the years of their first rows."""
    text = strip(F.coalesce("value", F.lit("")))
    year = F.when(text.rlike(r"^(?:19|20)[0-9]{2}$") & (F.col("row") <= YEAR_ROWS), text)
    key = F.nullif(snake_key(text), F.lit(""))
    label = F.when(text.rlike("[A-Za-z]") & ~key.isin(dims.TEMPLATE_WORDS), key)
    c = cells.select(snake_key(F.col("sheet")).alias("sheet_key"), "col", F.explode(F.array_compact(F.array(F.when(label.isNotNull(), F.struct(F.lit("metric").alias("kind"), label.alias("term"))), F.when(year.isNotNull(), F.struct(F.lit("year").alias("kind"), year.alias("term")))))).alias("x"))
    return c.groupBy("sheet_key", "x.kind", "x.term").agg(F.max(F.col("col") <= LABEL_COLUMNS).alias("placed"))


def _listed(test: Column, what: Column) -> Column:
    return F.sort_array(F.collect_list(F.when(test, what)))


def verdicts(values: DataFrame, cells: DataFrame, critical: Sequence[str] = dims.CRITICAL_TEMPLATE) -> DataFrame:
    """Each sheet's score (50 metrics, 25 years, 15 places, 10 critical metrics), what is missing, extra, and the action."""
    need = values.select("sheet", snake_key(F.col("sheet")).alias("sheet_key"), F.explode(F.array(F.struct(F.lit("metric").alias("kind"), snake_key(F.col("metric")).alias("term")), F.struct(F.lit("year").alias("kind"), F.col("value_year").cast("string").alias("term")))).alias("x")).select("sheet", "sheet_key", "x.*").distinct()
    have = terms(cells)
    met = need.join(have.withColumn("there", F.lit(True)), ["sheet_key", "kind", "term"], "left")
    is_ = lambda kind: F.col("kind") == kind
    share = lambda who, test: F.coalesce(F.count_if(who & test) / F.nullif(F.count_if(who), F.lit(0)), F.lit(0.0))
    there, gone, must = F.coalesce("there", F.lit(False)), F.col("there").isNull(), F.col("term").isin(list(critical))
    score = 50 * share(is_("metric"), there) + 25 * share(is_("year"), there) + 15 * share(is_("metric"), F.coalesce("placed", F.lit(False))) + 10 * share(is_("metric") & must, there)
    g = met.groupBy("sheet", "sheet_key").agg(F.round(score, 2).alias("score"), _listed(is_("metric") & gone, F.col("term")).alias("missing"), _listed(is_("year") & gone, F.col("term")).alias("years"), _listed(is_("metric") & gone & must, F.col("term")).alias("lost"))
    extra = have.where("kind = 'metric'").join(need.select("sheet_key", "kind", "term").distinct(), ["sheet_key", "kind", "term"], "left_anti").groupBy("sheet_key").agg(F.array_join(F.sort_array(F.collect_list("term")), ",").alias("extra"))
    known = cells.select(snake_key(F.col("sheet")).alias("sheet_key")).distinct().withColumn("known", F.lit(True))
    g = g.join(known, "sheet_key", "left").join(extra, "sheet_key", "left").withColumn("known", F.coalesce("known", F.lit(False)))
    g = g.withColumn("score", F.when(F.col("known"), F.col("score")).otherwise(0.0))
    action = F.when(~F.col("known"), "create").when(F.col("score") >= AUTO, "compatible").when(F.col("score") >= ASK, "user_decision").otherwise("replace")
    said = lambda *parts: F.concat("sheet", *[F.lit(p) if isinstance(p, str) else p for p in parts])
    rows = F.transform(F.slice("missing", 1, NAMED), lambda m: F.concat(title_case(F.replace(m, F.lit("_"), F.lit(" "))), F.lit(" row missing.")))
    warnings = F.concat(
        F.array(F.when(F.size("lost") > 0, said(" sheet missing critical metrics: ", F.array_join("lost", ", "), "."))),
        rows,
        F.array(
            F.when(F.size("missing") > NAMED, said(" sheet has ", (F.size("missing") - NAMED).cast("string"), " additional missing metrics.")),
            F.when(F.size("years") > 0, said(" sheet missing year columns: ", F.array_join("years", ", "), ".")),
            F.when(F.col("score") < ASK, said(" sheet is below 80% compatibility and will be replaced.")).when(F.col("score") < AUTO, said(" template requires user decision.")),
        ),
    )
    warnings = F.when(F.col("known"), F.array_compact(warnings)).otherwise(F.array(said(" sheet is missing and will be created.")))
    g = g.withColumn("action", action).withColumn("warnings", F.array_join(warnings, " "))
    return g.select("sheet", "score", "action", F.array_join("missing", ",").alias("missing_metrics"), F.coalesce("extra", F.lit("")).alias("extra_metrics"), "warnings")


def overall(sheets: DataFrame) -> DataFrame:
    """The template as a whole: the mean score, whether all sheets are compatible, and how to fill the workbook."""
    g = sheets.agg(F.round(F.avg("score"), 2).alias("score"), F.coalesce(F.min(F.col("action") == "compatible"), F.lit(False)).alias("is_match"), F.coalesce(F.max(F.col("action") == "user_decision"), F.lit(False)).alias("asks"))
    return g.select(F.coalesce("score", F.lit(0.0)).alias("score"), "is_match", F.when(F.col("is_match"), "template").when(F.col("asks"), "user_decision").otherwise("dynamic").alias("mode"))


def placed(values: DataFrame, cells: DataFrame) -> DataFrame:
    """The cell of each value in the template's sheet: the first row that names its metric, the first column that names its year."""
    c = cells.select(snake_key(F.col("sheet")).alias("sheet_key"), "row", "col", strip(F.coalesce("value", F.lit(""))).alias("t"))
    rows = c.where("t <> ''").groupBy("sheet_key", snake_key(F.col("t")).alias("metric_key")).agg(F.min("row").alias("at_row"))
    columns = c.where(F.col("t").rlike(r"^(?:19|20)[0-9]{2}$")).groupBy("sheet_key", F.col("t").try_cast("int").alias("value_year")).agg(F.min(F.struct("row", "col"))["col"].alias("at_col"))
    v = values.withColumn("sheet_key", snake_key(F.col("sheet"))).withColumn("metric_key", snake_key(F.col("metric")))
    return v.join(rows, ["sheet_key", "metric_key"], "left").join(columns, ["sheet_key", "value_year"], "left").drop("sheet_key", "metric_key")
