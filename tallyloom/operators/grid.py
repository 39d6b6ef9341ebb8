"""Table grids in long form: (page_number, table_index, row_index, col_index, cell).

Long form shuffles by table, not by document, and needs no array of a whole table in one row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import is_year, parse_amount, table_scale, years
from ..functions.text import normalize_text, strip
from ..plans import dims

TABLE = ["page_number", "table_index"]


def explode_rows(tables: DataFrame) -> DataFrame:
    """A column ``rows`` (array of rows of cells) as cells; null cells are empty, others trimmed."""
    rows = tables.select(*[c for c in tables.columns if c != "rows"], F.posexplode("rows").alias("row_index", "row"))
    return rows.select(*[c for c in rows.columns if c != "row"], F.posexplode("row").alias("col_index", "cell")).withColumn("cell", F.coalesce(strip(F.col("cell")), F.lit("")))


def decimals(cells: DataFrame) -> DataFrame:
    """Amounts below a header in row 0 and right of columns 0 and 1, written with a decimal, as an amount of 1961 would else be read as a year."""
    amount = (F.col("row_index") > 0) & (F.col("col_index") > 1)
    return cells.withColumn("cell", F.when(amount, F.regexp_replace("cell", r"^(\(?-?[0-9]+)(\)?)$", "$1.0$2")).otherwise(F.col("cell")))


def year_columns(cells: DataFrame) -> DataFrame:
    """The row with the most year cells, the first of such; a cell of several years spreads them over the columns
    from its own on, if its row has no year cell."""
    y = cells.select(*TABLE, "row_index", "col_index", years(F.col("cell")).alias("ys"), is_year(F.col("cell")).alias("single"))
    plain = y.where("single").select(*TABLE, "row_index", "col_index", F.col("ys")[0].alias("year"))
    several = y.where("size(ys) > 1").groupBy(*TABLE, "row_index").agg(F.min(F.struct("col_index", "ys")).alias("s"))
    several = several.join(plain.select(*TABLE, "row_index").distinct(), [*TABLE, "row_index"], "left_anti").select(*TABLE, "row_index", F.posexplode("s.ys").alias("k", "year"), "s.col_index").select(*TABLE, "row_index", (F.col("col_index") + F.col("k")).alias("col_index"), "year")
    every = plain.unionByName(several)
    best = every.groupBy(*TABLE, "row_index").agg(F.count("*").alias("n")).groupBy(*TABLE).agg(F.max_by("row_index", F.struct("n", -F.col("row_index"))).alias("row_index"))
    return every.join(best, [*TABLE, "row_index"]).select(*TABLE, F.col("row_index").alias("header_row"), "col_index", F.col("year").alias("value_year"))


def labels(cells: DataFrame) -> DataFrame:
    """Each row's first cell with a letter that is no year."""
    named = cells.where(F.col("cell").rlike("[A-Za-z]") & ~is_year(F.col("cell")))
    return named.groupBy(*TABLE, "row_index").agg(F.min(F.struct("col_index", "cell")).alias("x")).select(*TABLE, "row_index", F.col("x.col_index").alias("label_col"), F.col("x.cell").alias("metric"))


def note_columns(cells: DataFrame) -> DataFrame:
    """Columns of references to notes, by their head or by what most of their cells say."""
    x = normalize_text(F.col("cell"))
    g = cells.groupBy(*TABLE, "col_index").agg(F.max(x.isin("note", "notes", "reference", "ref")).alias("head"), F.count_if(x.rlike("^note [0-9]+$")).alias("notes"), F.count_if(x != "").alias("filled"))
    return g.where("head or (notes > 0 and 2 * notes >= filled)").select(*TABLE, "col_index")


def scales(cells: DataFrame) -> DataFrame:
    """A table's scale, from the first cell in reading order that names one."""
    s = cells.select(*TABLE, "row_index", "col_index", table_scale(F.col("cell")).alias("scale")).where("scale is not null")
    return s.groupBy(*TABLE).agg(F.min_by("scale", F.struct("row_index", "col_index")).alias("scale"))


def unpivot(cells: DataFrame) -> DataFrame:
    """(page_number, table_index, row_index, metric, value_year, value), numbers under year columns."""
    head = year_columns(cells)
    body = cells.join(head, [*TABLE, "col_index"]).where("row_index <> header_row")
    body = body.join(note_columns(cells), [*TABLE, "col_index"], "left_anti").join(scales(cells), TABLE, "left").join(labels(cells), [*TABLE, "row_index"])
    value = parse_amount(F.col("cell"), F.coalesce("scale", F.lit(1)))
    return body.where("col_index <> label_col").select(*TABLE, "row_index", "metric", "value_year", value.alias("value")).where("value is not null")


def quality(cells: DataFrame) -> DataFrame:
    """Year columns, labels, values and a score of each table; a table with numbers and no label is numeric only."""
    counts = [(year_columns(cells), "n_years"), (labels(cells), "n_labels"), (unpivot(cells), "n_values")]
    number = parse_amount(F.col("cell")).isNotNull()
    g = cells.groupBy(*TABLE).agg(F.count_if(number).alias("numbers"))
    for rows, name in counts:
        g = g.join(rows.groupBy(*TABLE).agg(F.count("*").cast("int").alias(name)), TABLE, "left").withColumn(name, F.coalesce(name, F.lit(0)))
    g = g.withColumn("numeric_only", (F.col("n_labels") == 0) & (F.col("numbers") > 0)).drop("numbers")
    parts = [F.when(F.col("numeric_only"), 10.0).otherwise(20.0), F.least(F.lit(25.0), 12.5 * F.col("n_years")), F.least(F.lit(25.0), 2.0 * F.col("n_labels")), F.least(F.lit(30.0), 2.0 * F.col("n_values"))]
    score = sum(parts[1:], parts[0]) - F.when(F.col("numeric_only"), 10.0).otherwise(0.0)
    return g.withColumn("score", F.round(F.greatest(F.lit(0.0), F.least(F.lit(100.0), score)), 2))


def suspicious(cells: DataFrame, top: int = 20) -> DataFrame:
    """O1: the tables that most ask for a look: a low score, and years, labels or values that are missing."""
    found = {"missing_years": F.col("n_years") == 0, "missing_labels": F.col("n_labels") == 0, "numeric_only_table": F.col("numeric_only"), "no_metric_values": F.col("n_values") == 0}
    more = sum(F.when(test, dims.SUSPICIONS[name]).otherwise(0) for name, test in found.items())
    reasons = F.array_join(F.array_compact(F.array(*[F.when(test, name) for name, test in found.items()])), ",")
    suspicion = F.round(F.greatest(F.lit(0.0), F.least(F.lit(100.0), 100 - F.col("score") + more)), 2)
    return quality(cells).select(*TABLE, "score", reasons.alias("reasons"), suspicion.alias("suspicion")).orderBy(F.desc("suspicion"), *TABLE).limit(top)


def split_negatives(cells: DataFrame) -> DataFrame:
    """A number whose opening parenthesis stands alone in one of the two cells before it is negative."""
    w = Window.partitionBy(*TABLE, "row_index").orderBy("col_index")
    alone = (F.trim(F.lag("cell", 1).over(w)) == "(") | (F.trim(F.lag("cell", 2).over(w)) == "(")
    bare = F.regexp_replace("cell", r"[()\s]", "")
    return cells.withColumn("cell", F.when(alone & bare.rlike(r"^[0-9][0-9,.]*$"), F.concat(F.lit("("), bare, F.lit(")"))).otherwise(F.col("cell")))


def shifted(cells: DataFrame, most: int = 2) -> DataFrame:
    """Rows that have as many numbers as there are years, all moved by one offset of 1 or 2 columns."""
    head = year_columns(cells)
    at = head.groupBy(*TABLE).agg(F.sort_array(F.collect_list("col_index")).alias("year_cols"), F.first("header_row").alias("header_row"))
    number = parse_amount(F.col("cell")).isNotNull() & ~is_year(F.col("cell"))
    rows = cells.where(number).join(note_columns(cells), [*TABLE, "col_index"], "left_anti").groupBy(*TABLE, "row_index").agg(F.sort_array(F.collect_list("col_index")).alias("cols")).join(at, TABLE).where("row_index <> header_row and size(cols) = size(year_cols)")
    off = F.array_distinct(F.zip_with("cols", "year_cols", lambda a, b: a - b))
    return rows.withColumn("off", off).where((F.size("off") == 1) & (F.abs(F.col("off")[0]) > 0) & (F.abs(F.col("off")[0]) <= most)).select(*TABLE, "row_index", F.col("off")[0].alias("offset"))


def merged_cells(cells: DataFrame) -> DataFrame:
    """One cell that holds as many numbers as the table has years."""
    n = year_columns(cells).groupBy(*TABLE).agg(F.count("*").alias("n"))
    parts = F.regexp_extract_all("cell", F.lit(r"\([0-9][0-9,.]*\)|-?[0-9][0-9,.]*"), F.lit(0))
    return cells.withColumn("parts", parts).join(n, TABLE).where("n > 1 and size(parts) = n").select(*TABLE, "row_index", "col_index", F.array_join("parts", "|").alias("parts"))


def sections(rows: DataFrame, marker: str) -> DataFrame:
    """Numbers the parts of a table that marker rows begin."""
    w = Window.partitionBy(*TABLE).orderBy("row_index")
    return rows.withColumn("section", F.sum(F.when(F.col("metric").rlike(marker), 1).otherwise(0)).over(w).cast("int"))


def inherit(rows: DataFrame) -> DataFrame:
    """The last row without values above a row is its heading; a unit row is none."""
    w = Window.partitionBy(*TABLE).orderBy("row_index").rowsBetween(Window.unboundedPreceding, -1)
    heading = F.when(~F.col("has_value") & ~F.lower("metric").rlike(r"^\s*(rupees|rs|pkr|usd|\(?in )"), F.col("metric"))
    return rows.withColumn("heading", F.last(heading, ignorenulls=True).over(w)).withColumn("label", F.when(F.col("has_value") & F.col("heading").isNotNull(), F.concat_ws(" - ", "heading", "metric")).otherwise(F.col("metric")))


def best_strategy(scans: DataFrame) -> DataFrame:
    """Of several scans of a page, the best by quality, values, years, labels and then strategy."""
    w = Window.partitionBy("page_number").orderBy(*map(F.desc, ("quality", "n_values", "n_years", "n_labels")), F.asc("strategy_rank"))
    return scans.withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")
