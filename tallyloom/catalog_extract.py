"""Queries of the composed extraction: facts of grids with the whole label chain, and what each step did.

The SQL knows the 16 kinds of rows of the fixture and says what must come of each; it has no rule of the operators in common with them
but the order of contexts.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from .operators import extract
from .plans.fixtures import fixture, with_fixture
from .registered import query

#: Labels after repair; rows that are dropped; contexts from rows above (h: header of a note, p: part, t: whichever was later, u: lone row).
_W = "OVER (PARTITION BY page_number ORDER BY row_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
CHAIN = f""", l1 AS (SELECT *, table_type = 'notes_schedule' AS notes, CASE kind WHEN 0 THEN 'Others' WHEN 1 THEN label || ' trade income' WHEN 2 THEN 'Sales of goods' WHEN 3 THEN 'Selling costs' WHEN 4 THEN 'Finance cost' WHEN 5 THEN 'Trade receivables' WHEN 6 THEN 'Operating expenses'
  WHEN 7 THEN 'Cost of sales' WHEN 8 THEN CASE page_number % 5 WHEN 0 THEN 'Notes' WHEN 1 THEN '-do-' WHEN 2 THEN 'Note 4.1' WHEN 3 THEN 'Brought forward' ELSE 'Amounts in Rs' END WHEN 9 THEN 'Movement of borrowings' WHEN 10 THEN 'Opening balance' WHEN 11 THEN 'Earnings per share' WHEN 12 THEN 'Net margin (%)'
  WHEN 13 THEN 'Current liabilities' WHEN 14 THEN 'Current portion of loans' ELSE 'Profit on sale of fixed plant' END AS done, kind NOT IN (8, 9, 13) AS valued FROM fx_lines),
l2 AS (SELECT *, last_value(CASE WHEN kind = 9 THEN row_index END IGNORE NULLS) {_W} AS h, last_value(CASE WHEN kind = 13 THEN row_index END IGNORE NULLS) {_W} AS p, last_value(CASE WHEN kind IN (9, 13) THEN row_index END IGNORE NULLS) {_W} AS t FROM l1),
l3 AS (SELECT *, notes AND valued AND kind NOT IN (0, 10) AND (kind = 15 OR t IS NULL) AS lone, CASE WHEN p > coalesce(h, -1) THEN 'Current liabilities' END AS part, CASE WHEN h IS NOT NULL THEN 'Movement of borrowings' END AS note FROM l2),
l4 AS (SELECT *, last_value(CASE WHEN lone THEN row_index END IGNORE NULLS) {_W} AS u, last_value(CASE WHEN lone THEN done END IGNORE NULLS) {_W} AS lone_label FROM l3),
l5 AS (SELECT *, CASE WHEN u > coalesce(t, -1) THEN lone_label END AS parent FROM l4),
l6 AS (SELECT *, CASE WHEN NOT (notes AND valued) OR kind = 15 THEN NULL WHEN kind = 0 THEN coalesce(parent, part, note) WHEN kind = 10 THEN coalesce(part, parent, note) ELSE coalesce(part, note) END AS above,
  CASE WHEN NOT (notes AND valued) OR kind = 15 THEN NULL WHEN kind = 0 THEN CASE WHEN parent IS NOT NULL THEN 'parent_row' WHEN part IS NOT NULL THEN 'section_header' ELSE 'note_header' END
    WHEN part IS NOT NULL THEN 'section_header' WHEN kind = 10 AND parent IS NOT NULL THEN 'parent_row' ELSE 'note_header' END || ':' || CASE kind WHEN 0 THEN 'generic_note_label' WHEN 10 THEN 'movement_label' ELSE 'note_context_label' END AS why FROM l5),
l7 AS (SELECT *, CASE WHEN above IS NULL THEN done ELSE above || ' - ' || done END AS noted, CASE WHEN p IS NOT NULL THEN 'Current liabilities' END AS section, CASE WHEN t = p THEN 'Current liabilities' WHEN t = h THEN 'Movement of borrowings' END AS head FROM l6),
l8 AS (SELECT *, CASE WHEN NOT valued OR above IS NOT NULL THEN noted WHEN kind = 6 THEN 'Operating expenses%' WHEN kind IN (12, 14) AND coalesce(section, head) IS NOT NULL THEN coalesce(section, head) || ' - ' || done ELSE noted END AS metric,
  CASE WHEN page_number % 3 = 0 THEN 1000 ELSE 1 END AS scale FROM l7)"""
_VALUES = """, y(k, value_year) AS (VALUES (0, 1998), (1, 1997), (2, 1996)), v AS (SELECT l8.*, value_year, k,
  CAST(CASE k WHEN 0 THEN CASE kind WHEN 4 THEN -a ELSE a END WHEN 1 THEN b ELSE CASE kind WHEN 3 THEN c ELSE -c END END AS DOUBLE) * CASE WHEN kind IN (11, 12) THEN 1 WHEN kind = 15 AND k = 0 THEN 1000000 ELSE scale END AS value,
  CASE kind WHEN 2 THEN 'shifted_row_repair' WHEN 3 THEN 'merged_numeric_cell_split' WHEN 4 THEN CASE k WHEN 0 THEN 'reconstructed_negative' ELSE 'direct' END ELSE 'direct' END AS source,
  scale > 1 AND kind IN (11, 12) AS exempt FROM l8, y WHERE valued)"""


def _chain(s, d):
    return extract.chain(fixture(s, d, "fx_grid"))


@query("p3_composed_facts", with_fixture("fx_lines", CHAIN + _VALUES + " SELECT page_number, 0 AS table_index, CAST(row_index AS INT) AS row_index, metric, CAST(value_year AS INT) AS value_year, value, source, exempt AS scale_exempt, exempt AS scale_corrected, kind = 4 AND k = 0 AS negative_recovered FROM v"))
def _(s, d):
    return extract.facts(_chain(s, d))


def _step(name, sql, step):
    @query(name, with_fixture("fx_lines", CHAIN + f" SELECT page_number, CAST(row_index AS INT) AS row_index, {sql}"))
    def _(s, d):
        return extract.diagnostics(_chain(s, d)).where(F.col("step") == step).select("page_number", "row_index", "before", "after", "reason", "n_values")


# every row that has values has three
_step("d1_label_reconstruction", "CASE kind WHEN 5 THEN 'Trade' ELSE 'Earnings per shar e' END AS before, done AS after, CASE kind WHEN 5 THEN 'year_column' ELSE 'note_number' END AS reason, 3 AS n_values FROM l8 WHERE kind IN (5, 11)", "label_reconstruction")
_step("d2_label_degluing", "'Operating ex penses' AS before, done AS after, 'known_financial_word_join' AS reason, 3 AS n_values FROM l8 WHERE kind = 6", "label_degluing")
_step("d3_fragmentation_cleanup", "CASE kind WHEN 7 THEN 'Cost of sa les' ELSE 'Net margin (' END AS before, done AS after, CASE kind WHEN 7 THEN 'remaining_spacing_repair' ELSE 'unit_context_completion' END AS reason, 3 AS n_values FROM l8 WHERE kind IN (7, 12)", "fragmentation_cleanup")
_step("d4_note_row_filtering", "done AS before, CAST(NULL AS VARCHAR) AS after, CASE page_number % 5 WHEN 0 THEN 'note_header' WHEN 1 THEN 'continuation_marker' WHEN 2 THEN 'standalone_note_reference' WHEN 3 THEN 'continuation_marker' ELSE 'unit_row' END AS reason, 3 AS n_values FROM l8 WHERE kind = 8", "note_row_filtering")
_step("d5_note_context_inheritance", "done AS before, noted AS after, why AS reason, 3 AS n_values FROM l8 WHERE above IS NOT NULL", "note_context_inheritance")
_step("d6_header_inheritance", "noted AS before, metric AS after, CASE WHEN kind = 6 THEN 'unit_context:unit_fragment_completion' ELSE CASE WHEN section IS NOT NULL THEN 'table_section_context:' ELSE 'table_header_context:' END || CASE kind WHEN 12 THEN 'unit_context_inheritance' ELSE 'section_context_inheritance' END END AS reason, 3 AS n_values FROM l8 WHERE valued AND metric <> noted", "header_inheritance")


@query(
    "d7_numeric_repairs",
    with_fixture("fx_lines", CHAIN + " SELECT page_number, 0 AS table_index, CAST(coalesce(sum(CASE WHEN scale > 1 AND kind IN (11, 12) THEN 3 END), 0) AS BIGINT) AS scale_exempt_values, CAST(coalesce(sum(CASE WHEN scale > 1 AND kind IN (11, 12) THEN 3 END), 0) AS BIGINT) AS scale_corrections_applied, count(*) FILTER (kind = 4) AS negative_values_recovered, count(*) FILTER (kind IN (2, 3)) AS shifted_rows_repaired, 3 * count(*) FILTER (kind IN (2, 3)) AS values_recovered FROM l8 WHERE valued GROUP BY 1"),
)
def _(s, d):
    return extract.numeric_diagnostics(_chain(s, d))


_TABLES = ", q AS (SELECT page_number, any_value(table_type) AS table_type, CAST(3 * count(*) FILTER (valued) AS INT) AS n_values, CAST(count(*) + 1 AS INT) AS n_labels FROM l8 GROUP BY 1)"


@query("d9_extraction_quality", with_fixture("fx_lines", CHAIN + _TABLES + " SELECT page_number, 0 AS table_index, table_type, 3 AS n_years, n_labels, n_values, false AS numeric_only, round(CAST(20 + 25 + least(25, 2.0 * n_labels) + least(30, 2.0 * n_values) AS DOUBLE), 2) AS score, n_values > 0 AS sufficient FROM q"))
def _(s, d):
    return extract.quality(_chain(s, d))


@query("a5_score_buckets", with_fixture("fx_lines", CHAIN + _TABLES + ", s AS (SELECT least(4, CAST(floor((45 + least(25, 2.0 * n_labels) + least(30, 2.0 * n_values)) / 20) AS INT)) AS k FROM q) SELECT ['0-20', '20-40', '40-60', '60-80', '80-100'][b + 1] AS bucket, (SELECT count(*) FROM s WHERE k = b) AS n FROM range(5) r(b)"))
def _(s, d):
    return extract.score_buckets(extract.quality(_chain(s, d)))


@query(
    "o1_suspicious_metrics",
    with_fixture("fx_metric_values", """, u AS (SELECT metric, value_year, source_report_year, kind AS table_type, count(*) AS n, count(DISTINCT value) AS n_values FROM (SELECT *, CASE WHEN page_number % 5 = 0 THEN 'unclassified' ELSE table_type END AS kind FROM fx_metric_values) f GROUP BY 1, 2, 3, 4)
SELECT *, array_to_string(list_filter([CASE WHEN n > 1 THEN 'duplicate_metric_values' END, CASE WHEN n_values > 1 THEN 'conflicting_values' END, CASE WHEN table_type = 'unclassified' THEN 'unclassified_table_metric' END], lambda x: x IS NOT NULL), ',') AS reasons,
  CAST(least(100, CASE WHEN n_values > 1 THEN 65 ELSE 0 END + CASE WHEN n > 1 THEN least(25, 5 * (n - 1)) ELSE 0 END + CASE WHEN table_type = 'unclassified' THEN 20 ELSE 0 END + CASE WHEN n_values > 2 THEN least(10, 2 * n_values) ELSE 0 END) AS DOUBLE) AS score FROM u WHERE n > 1 OR table_type = 'unclassified' ORDER BY score DESC, metric, value_year, table_type, source_report_year LIMIT 20"""),
)
def _(s, d):
    f = fixture(s, d, "fx_metric_values").withColumn("table_type", F.when(F.col("page_number") % 5 == 0, "unclassified").otherwise(F.col("table_type")))
    return extract.suspicious_metrics(f)


_REPAIRED = "count(*) FILTER (valued AND kind IN (2, 3))"
_COUNTS = {"label_reconstruction": "kind IN (5, 11)", "label_degluing": "kind = 6", "fragmentation_cleanup": "kind IN (7, 12)", "note_row_filtering": "kind = 8", "note_context_inheritance": "above IS NOT NULL", "header_inheritance": "valued AND metric <> noted"}


@query(
    "d8_quality_report",
    with_fixture("fx_lines", CHAIN + " SELECT count(DISTINCT page_number) AS tables, CAST(0 AS BIGINT) AS missing_years, CAST(0 AS BIGINT) AS missing_labels, CAST(0 AS BIGINT) AS numeric_only, CAST(0 AS BIGINT) AS unclassified, 3 * count(*) FILTER (valued) AS metric_values, " + ", ".join(f"count(*) FILTER ({w}) AS {n}_rows, 3 * count(*) FILTER ({w}) AS {n}_values" for n, w in _COUNTS.items())
    + f", 3 * count(*) FILTER (scale > 1 AND kind IN (11, 12)) AS scale_exempt_values, 3 * count(*) FILTER (scale > 1 AND kind IN (11, 12)) AS scale_corrections_applied, count(*) FILTER (kind = 4) AS negative_values_recovered, {_REPAIRED} AS shifted_rows_repaired, 3 * {_REPAIRED} AS values_recovered FROM l8"),
)
def _(s, d):
    return extract.quality_report(_chain(s, d))


_HAS = "EXISTS (SELECT 1 FROM fx_rows x WHERE x.page_number = r.page_number AND x.row_index = {0})"


@query(
    "w8_analysis_split",
    with_fixture("fx_rows", f""", r AS (SELECT DISTINCT page_number, row_index FROM fx_rows UNION SELECT DISTINCT page_number, 0 FROM fx_rows)
SELECT page_number, 0 AS table_index, CAST(row_index AS INT) AS row_index, CASE WHEN row_index < 2 THEN 0 WHEN row_index < 4 THEN 1 ELSE 2 END AS split, CASE WHEN row_index < 2 THEN 'Income Statement' WHEN (row_index < 4) = (page_number % 2 = 0) THEN 'vertical_analysis' ELSE 'horizontal_analysis' END AS logical_type
FROM r WHERE {_HAS.format(2)} AND {_HAS.format(4)} AND page_number % 5 > 0 AND page_number % 3 > 0 AND page_number % 7 > 0"""),
)
def _(s, d):
    # pages by number: one without horizontal analysis among its types, one whose second mark has no years, one without subtotals; the analyses change places
    cells = fixture(s, d, "fx_cells")
    p, i = F.col("page_number"), F.col("row_index")
    marks = F.when(p % 2 == 0, F.when(i == 2, "Vertical Ana lysis").when(i == 4, "Horizontal analysis")).otherwise(F.when(i == 2, "Horizontal an alysis").when(i == 4, "VERTICAL ANALYSIS"))
    label = F.when((i == 1) & (p % 7 > 0), "Gross profit").when(i.isin(2, 4), F.concat(marks, F.when((p % 3 == 0) & (i == 4), "").otherwise(" 2025 and 2024"))).otherwise(F.col("cell"))
    cells = cells.withColumn("cell", F.when(F.col("col_index") == 0, label).when((i == 4) & (p % 3 == 0), "").otherwise(F.col("cell")))
    types = cells.select("page_number").distinct().select("page_number", F.posexplode(F.array(F.lit("notes"), F.lit("Income Statement"), F.lit("Vertical analysis"), F.when(p % 5 > 0, "horizontal-analysis").otherwise("ratios"))).alias("cls", "table_type"))
    return extract.analysis_split(cells, types)
