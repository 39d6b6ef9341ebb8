"""Inputs of the engine's shapes, made from the general tables. Each is SQL that Spark and DuckDB read alike."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

#: Candidates for consolidation. input_key orders rows as they came.
METRIC_VALUES = """
SELECT CASE p.p_type WHEN 'MEDIUM' THEN 'revenue' WHEN 'STANDARD' THEN 'equity' WHEN 'LARGE' THEN 'earnings_per_share'
         WHEN 'PROMO' THEN 'cash_and_bank_balances' WHEN 'SMALL' THEN 'current_portion_long_term_debt' ELSE 'total_assets' END AS metric,
       CAST(year(o.o_orderdate) AS INT) AS value_year, CAST(year(o.o_orderdate) + (l.l_orderkey % 3) AS INT) AS source_report_year,
       CAST(1 + l.l_suppkey % 40 AS INT) AS page_number,
       CASE l.l_linenumber % 6 WHEN 0 THEN 'income_statement' WHEN 1 THEN 'balance_sheet' WHEN 2 THEN 'cash_flow_statement'
         WHEN 3 THEN 'ratio_analysis' WHEN 4 THEN 'debt_schedule' ELSE 'notes' END AS table_type,
       p.p_name AS original_metric,
       CAST(CASE l.l_partkey % 4 WHEN 0 THEN 1.0 WHEN 1 THEN 0.96 WHEN 2 THEN 0.85 ELSE 0.79 END AS DOUBLE) AS confidence,
       (l.l_partkey % 4 = 3) AS requires_review,
       CAST(round(l.l_extendedprice) AS BIGINT) * (CASE WHEN l.l_returnflag = 'R' THEN -1 ELSE 1 END) AS value,
       concat(lpad(CAST(l.l_orderkey AS VARCHAR(20)), 12, '0'), '-', lpad(CAST(l.l_linenumber AS VARCHAR(20)), 4, '0'), '-', lpad(CAST(l.l_partkey AS VARCHAR(20)), 12, '0'), '-',
         lpad(CAST(l.l_suppkey AS VARCHAR(20)), 12, '0'), '-', lpad(CAST(CAST(round(l.l_extendedprice) AS BIGINT) AS VARCHAR(20)), 12, '0')) AS input_key
FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN part p ON l.l_partkey = p.p_partkey"""

#: A template of the values' sheets: one sheet is missing, others lack metrics or a year, have more, or have a metric far to the right.
TEMPLATE = """
SELECT upper(replace(table_type, '_', ' ')) AS sheet, CAST(1 + r AS INT) AS row, CAST(CASE WHEN table_type = 'cash_flow_statement' AND r = 2 THEN 5 ELSE 1 END AS INT) AS col, replace(metric, '_', ' ') AS value
FROM (SELECT table_type, metric, dense_rank() OVER (PARTITION BY table_type ORDER BY metric) AS r FROM (SELECT DISTINCT table_type, metric FROM fx_metric_values) m) x WHERE table_type <> 'notes' AND NOT (table_type = 'ratio_analysis' AND r % 2 = 0) AND NOT (table_type = 'debt_schedule' AND r = 1)
UNION ALL SELECT upper(replace(table_type, '_', ' ')), 1, 1, 'Particulars' FROM (SELECT DISTINCT table_type FROM fx_metric_values) t WHERE table_type <> 'notes'
UNION ALL SELECT 'INCOME STATEMENT', 40, 1, 'Widget count' FROM (SELECT DISTINCT table_type FROM fx_metric_values) t WHERE table_type = 'income_statement'
UNION ALL SELECT upper(replace(table_type, '_', ' ')), CAST(CASE WHEN table_type = 'ratio_analysis' THEN 30 ELSE 1 END AS INT), CAST(value_year - 1990 AS INT), CAST(value_year AS VARCHAR(9)) FROM (SELECT DISTINCT table_type, value_year FROM fx_metric_values) y WHERE table_type <> 'notes' AND NOT (table_type = 'balance_sheet' AND value_year = 1999)"""

#: Candidates with the labels that selectors look for, in coarse values, so that copies, opposite signs and scales meet.
NAMED_VALUES = """
SELECT metric, value_year, source_report_year, page_number, table_type,
  CASE page_number % 9 WHEN 0 THEN 'Earnings per share - basic' WHEN 1 THEN 'Cash and bank balances' WHEN 2 THEN 'Net revenue' WHEN 3 THEN 'Shareholders equity'
    WHEN 4 THEN 'Pro fit a nd loss' WHEN 5 THEN 'EPS' WHEN 6 THEN 'Provision for (tax' ELSE original_metric END AS original_metric,
  confidence, requires_review, CAST((value - value % 2000) * (CASE page_number % 7 WHEN 0 THEN 1000 ELSE 1 END) AS BIGINT) AS value, input_key
FROM fx_metric_values"""

#: Table grids, a row for each cell: a header of years, labels, note references and amounts.
CELLS = """
SELECT DISTINCT page_number, 0 AS table_index, row_index, 0 AS col_index, label AS cell FROM fx_rows
UNION ALL SELECT DISTINCT page_number, 0, row_index, 1, concat('Note ', CAST(row_index AS VARCHAR(9))) FROM fx_rows
UNION ALL SELECT page_number, 0, row_index, 2 + (1998 - y), CASE WHEN v % 11 = 0 THEN '-' WHEN v < 0 THEN concat('(', CAST(-v AS VARCHAR(30)), ')') ELSE CAST(v AS VARCHAR(30)) END FROM fx_rows
UNION ALL SELECT DISTINCT page_number, 0, 0, 2 + (1998 - y), CAST(y AS VARCHAR(9)) FROM fx_rows
UNION ALL SELECT DISTINCT page_number, 0, 0, 0, 'Particulars' FROM fx_rows"""

ROWS = """
SELECT *, CAST(dense_rank() OVER (PARTITION BY page_number ORDER BY label) AS INT) AS row_index FROM (
  SELECT CAST(l.l_suppkey AS INT) AS page_number, p.p_type AS label, CAST(year(l.l_shipdate) AS INT) AS y,
    CAST(SUM(CAST(round(l.l_extendedprice) AS BIGINT) * (CASE WHEN l.l_returnflag = 'R' THEN -2 ELSE 1 END)) AS BIGINT) AS v
  FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey WHERE year(l.l_shipdate) BETWEEN 1996 AND 1998 GROUP BY 1, 2, 3) f"""

#: Rows of report tables, of 16 kinds: moved, merged and split values, split labels, rows of notes, headers and what depends on them.
LINES = """
SELECT page_number, row_index, CASE WHEN page_number % 2 = 0 THEN 'income_statement' ELSE 'notes_schedule' END AS table_type, CAST((page_number + row_index) % 16 AS INT) AS kind,
  label, CAST(3000 + abs(coalesce(MAX(CASE WHEN y = 1998 THEN v END), 0)) AS BIGINT) AS a, CAST(3000 + abs(coalesce(MAX(CASE WHEN y = 1997 THEN v END), 0)) AS BIGINT) AS b,
  CAST(3000 + abs(coalesce(MAX(CASE WHEN y = 1996 THEN v END), 0)) AS BIGINT) AS c
FROM fx_rows GROUP BY page_number, row_index, label"""

GRID = """
SELECT page_number, 0 AS table_index, row_index, col_index, table_type, CASE col_index
    WHEN 0 THEN CASE kind WHEN 0 THEN 'Others' WHEN 1 THEN concat(label, ' trade income') WHEN 2 THEN 'Sales of goods' WHEN 3 THEN 'Selling costs' WHEN 4 THEN 'Finance cost' WHEN 5 THEN 'Trade' WHEN 6 THEN 'Operating ex penses'
      WHEN 7 THEN 'Cost of sa les' WHEN 8 THEN CASE page_number % 5 WHEN 0 THEN 'Notes' WHEN 1 THEN '-do-' WHEN 2 THEN 'Note 4.1' WHEN 3 THEN 'Brought forward' ELSE 'Amounts in Rs' END WHEN 9 THEN 'Movement of borrowings'
      WHEN 10 THEN 'Opening balance' WHEN 11 THEN 'Earnings per shar e' WHEN 12 THEN 'Net margin (' WHEN 13 THEN 'Current liabilities' WHEN 14 THEN 'Current portion of loans' ELSE 'Profit on sale of fixed plant' END
    WHEN 1 THEN CASE kind WHEN 3 THEN concat(CAST(a AS VARCHAR(30)), ' ', CAST(b AS VARCHAR(30)), ' ', CAST(c AS VARCHAR(30))) WHEN 4 THEN '(' WHEN 5 THEN 'receiva bles' WHEN 6 THEN '%' WHEN 9 THEN '' WHEN 12 THEN '%)' WHEN 13 THEN '' ELSE '4.1' END
    WHEN 2 THEN CASE kind WHEN 2 THEN '' WHEN 3 THEN '' WHEN 4 THEN concat(CAST(a AS VARCHAR(30)), ')') WHEN 9 THEN '' WHEN 13 THEN '' WHEN 15 THEN concat(CAST(a AS VARCHAR(30)), ' million') ELSE CAST(a AS VARCHAR(30)) END
    WHEN 3 THEN CASE kind WHEN 2 THEN CAST(a AS VARCHAR(30)) WHEN 3 THEN '' WHEN 9 THEN '' WHEN 13 THEN '' ELSE CAST(b AS VARCHAR(30)) END
    WHEN 4 THEN CASE kind WHEN 2 THEN CAST(b AS VARCHAR(30)) WHEN 3 THEN '' WHEN 9 THEN '' WHEN 13 THEN '' ELSE concat('(', CAST(c AS VARCHAR(30)), ')') END
    ELSE CASE kind WHEN 2 THEN concat('(', CAST(c AS VARCHAR(30)), ')') ELSE '' END END AS cell
FROM fx_lines, (SELECT 0 AS col_index UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3 UNION ALL SELECT 4 UNION ALL SELECT 5) k
UNION ALL SELECT page_number, 0, 0, col_index, table_type, CASE col_index WHEN 0 THEN CASE WHEN page_number % 3 = 0 THEN 'Rupees in thousand' ELSE 'Particulars' END WHEN 1 THEN 'Note' ELSE CAST(2000 - col_index AS VARCHAR(9)) END
FROM (SELECT DISTINCT page_number, table_type FROM fx_lines) p, (SELECT 0 AS col_index UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3 UNION ALL SELECT 4) k"""

#: Narrative pages with headings.
PAGES = """
SELECT CAST((d.doc_id - d.doc_id % 50) / 50 AS BIGINT) AS report_id, CAST(1 + d.doc_id % 50 AS INT) AS page_number,
  concat(CASE d.doc_id % 10 WHEN 0 THEN 'Chairman''s Review' WHEN 2 THEN 'Directors'' Report' WHEN 4 THEN 'Independent Auditor''s Report'
    WHEN 6 THEN 'Risk Management' WHEN 8 THEN 'Future Outlook' ELSE '' END, chr(10), d.text,
    CASE d.doc_id % 4 WHEN 0 THEN concat(chr(10), 'Debt and finance cost increased due to capacity expansion in the year.')
      WHEN 1 THEN concat(chr(10), 'Exports grew 12% and margin improved on lower energy cost this period.') ELSE '' END) AS text
FROM documents d"""

#: Reports of 20 pages: sections that open, go on and end, headings with slips, scans without text, pages of other kinds.
REPORT_PAGES = """
SELECT report_id, page_number, CASE WHEN page_number = 14 THEN NULL ELSE concat('Annual accounts', chr(10), CASE page_number WHEN 1 THEN 'Chairman''s Review' WHEN 7 THEN 'Directros Report' WHEN 9 THEN 'Independent Auditor''s Report' WHEN 11 THEN 'Mana gement discu ssion and analysis' WHEN 12 THEN 'Pattern of Shareholding'
    WHEN 13 THEN 'Future Outlook' WHEN 15 THEN 'Risk Management' WHEN 16 THEN 'Corporate information' WHEN 18 THEN 'Strategic objctives' WHEN 19 THEN 'Stratgc objctvs' ELSE '' END, chr(10), 'Page text begins below', chr(10),
  CASE WHEN page_number BETWEEN 2 AND 6 AND report_id % 3 <> 1 THEN concat('Plant visit', chr(10), 'New line', chr(10), 'Good year') WHEN page_number = 17 AND report_id % 2 = 0 THEN concat('2024  10  20', chr(10), '2023  11  22', chr(10), 'Sum  21  42') ELSE text END) END AS text
FROM (SELECT CAST((doc_id - doc_id % 20) / 20 AS BIGINT) AS report_id, CAST(1 + doc_id % 20 AS INT) AS page_number, text FROM documents) d"""

INSIGHTS = """
SELECT d.doc_id AS insight_id, 2024 AS value_year, 2024 AS source_report_year, concat('Area ', d.source) AS area,
  concat(d.text, CASE d.doc_id % 5 WHEN 0 THEN ' Revenue rose 12%.' WHEN 1 THEN ' Code of conduct was followed.'
    WHEN 2 THEN ' Rs 450 million debt was repaid.' WHEN 3 THEN ' Going concern is not in doubt.' ELSE '' END) AS takeaway,
  CASE d.doc_id % 3 WHEN 0 THEN 'Business Review' WHEN 1 THEN 'Outlook' ELSE 'Risks' END AS source_section,
  CAST(1 + d.doc_id % 50 AS INT) AS page_number, CAST(d.doc_id % 101 AS DOUBLE) / 100 AS confidence
FROM documents d"""

BOXES = """
SELECT CAST(p_partkey % 100 AS INT) AS page_number, CAST((p_partkey - p_partkey % 100) / 100 AS INT) AS box_index,
  CAST(p_size * 5 AS DOUBLE) AS x0, CAST((p_partkey % 13) * 9 AS DOUBLE) AS y0, CAST(p_size * 5 + 60 + p_partkey % 17 AS DOUBLE) AS x1,
  CAST((p_partkey % 13) * 9 + 40 AS DOUBLE) AS y1, CASE WHEN p_partkey % 200 < 100 THEN 'detected' ELSE 'classified' END AS side
FROM part"""

#: Pages with grids and classified types whose ids, boxes, indexes and texts agree on some pages and differ on others.
RAW_TABLES = """
SELECT page_number, raw, CASE WHEN (page_number + raw) % 5 = 0 THEN concat(CAST(page_number AS VARCHAR(20)), ':', CAST(raw AS VARCHAR(9))) END AS detected_id,
  CASE (page_number * 5 + raw) % 9 WHEN 0 THEN 'Total assets, share capital & current liabilities' WHEN 1 THEN 'Revenue; cost of sales; Gross profit' WHEN 2 THEN 'Operating activities investing activities financing activities cash generated from operations'
    WHEN 3 THEN 'Borrowings and lease liabilities, long term financing: markup accrued repayable' WHEN 4 THEN 'Widget count by summary' WHEN 5 THEN '' WHEN 6 THEN 'Netassets totalequity financialposition' WHEN 7 THEN 'Distribution cost Other income Finance charges Profit for the year' ELSE 'Nothing here' END AS text,
  CAST((page_number + raw) % 3 AS INT) AS n_years, CAST((page_number + 2 * raw) % 5 AS INT) AS n_labels, CAST(raw * 3 + page_number % 4 AS INT) AS n_values,
  CAST(100 * raw AS DOUBLE) AS x0, CAST(0 AS DOUBLE) AS y0, CAST(100 * raw + 80 + page_number % 9 AS DOUBLE) AS x1, CAST(50 AS DOUBLE) AS y1
FROM (SELECT CAST((p_partkey - p_partkey % 8) / 8 AS INT) AS page_number, CAST(p_partkey % 8 AS INT) AS raw FROM part) p WHERE raw < 4 AND NOT (page_number % 7 = 0 AND raw > 0) AND page_number % 11 <> 0"""

PAGE_TYPES = """
SELECT page_number, cls, CASE (page_number * 3 + cls) % 6 WHEN 0 THEN 'Balance sheet' WHEN 1 THEN 'income_statement' WHEN 2 THEN 'statement_of_cash_flows' WHEN 3 THEN 'debt_schedule' WHEN 4 THEN 'notes' ELSE 'widget_summary_table' END AS table_type,
  CASE WHEN (page_number + cls) % 4 = 0 THEN concat(CAST(page_number AS VARCHAR(20)), ':', CAST((cls + page_number % 2) % 4 AS VARCHAR(9))) END AS detected_id,
  CASE WHEN (page_number + cls) % 4 = 1 THEN CAST((cls + page_number) % 5 AS INT) END AS page_table_index,
  CASE WHEN (page_number + cls) % 3 > 0 THEN CAST(100 * ((cls + page_number) % 4) + page_number % 20 AS DOUBLE) END AS x0, CAST(0 AS DOUBLE) AS y0,
  CASE WHEN (page_number + cls) % 3 > 0 THEN CAST(100 * ((cls + page_number) % 4) + 80 + page_number % 20 AS DOUBLE) END AS x1, CAST(50 AS DOUBLE) AS y1
FROM (SELECT CAST((p_partkey - p_partkey % 8) / 8 AS INT) AS page_number, CAST(p_partkey % 8 - 4 AS INT) AS cls FROM part) p WHERE cls >= 0 AND NOT (page_number % 7 < 2 AND cls > 0) AND page_number % 13 <> 0"""

STATEMENTS = """
SELECT CAST(l.l_suppkey AS INT) AS entity_id, CAST(year(l.l_shipdate) AS INT) AS value_year,
  CAST(SUM(CAST(round(l.l_extendedprice) AS BIGINT)) AS BIGINT) AS total_assets,
  CAST(SUM(CASE WHEN l.l_returnflag = 'R' THEN CAST(round(l.l_extendedprice) AS BIGINT) ELSE 0 END) AS BIGINT) AS total_liabilities,
  CAST(SUM(CASE WHEN l.l_returnflag = 'R' THEN 0 ELSE CAST(round(l.l_extendedprice) AS BIGINT) END) + MAX(CASE WHEN l.l_suppkey % 3 = 0 THEN 1000 ELSE 0 END) AS BIGINT) AS total_equity
FROM lineitem l GROUP BY 1, 2"""

#: Statement of each metric of the books, in the order in which they are observed.
BOOKS = {
    "balance": "total_assets current_assets non_current_assets cash inventory trade_receivables other_current_assets total_liabilities current_liabilities non_current_liabilities trade_payables short_term_borrowings current_portion_of_debt other_current_liabilities total_equity share_capital reserves retained_earnings",
    "income": "revenue cost_of_sales gross_profit operating_expenses operating_profit other_income ebit finance_cost profit_before_tax tax_expense profit_after_tax",
    "cash": "operating_cash_flow investing_cash_flow financing_cash_flow net_change_in_cash opening_cash closing_cash",
    "equity": "beginning_retained_earnings ending_retained_earnings dividends",
    "ppe": "beginning_ppe ending_ppe capex depreciation",
    "debt": "beginning_debt ending_debt new_borrowings repayments",
    "ratios": "eps weighted_average_shares roe average_equity current_ratio",
}
BOOK_METRICS = [(m, s) for s, ms in BOOKS.items() for m in ms.split()]
#: Books of entities, made so that the formulas of a validation hold, each but for one year in nine; values are left out here and there.
BOOK_STEPS = [
    {"cash": "100 + x % 1000", "inventory": "50 + x % 500 - (CASE WHEN (e + y) % 11 = 0 THEN 2000 ELSE 0 END)", "trade_receivables": "30 + x % 300", "other_current_assets": "20 + x % 200", "non_current_assets": "1000 + x % 5000", "trade_payables": "x % 400", "short_term_borrowings": "x % 250", "current_portion_of_debt": "x % 150", "other_current_liabilities": "10 + x % 90", "non_current_liabilities": "x % 700", "share_capital": "CAST(500 AS BIGINT)", "reserves": "x % 300", "revenue": "10000 + x % 9000", "cost_of_sales": "4000 + x % 3000", "operating_expenses": "x % 1000", "other_income": "x % 120", "finance_cost": "x % 80", "tax_expense": "x % 60", "operating_cash_flow": "x % 2000", "investing_cash_flow": "-(x % 900)", "financing_cash_flow": "x % 350", "beginning_retained_earnings": "x % 4000", "dividends": "x % 70", "beginning_ppe": "x % 6000", "capex": "x % 800", "depreciation": "x % 610", "beginning_debt": "x % 3000", "new_borrowings": "x % 450", "repayments": "x % 370", "average_equity": "CAST(50000 AS BIGINT)", "weighted_average_shares": "CAST(CASE WHEN (e + y) % 13 = 0 THEN 0 ELSE 1000 END AS BIGINT)"},
    {"current_assets": "cash + inventory + trade_receivables + other_current_assets + (CASE WHEN (e + y + 1) % 9 = 0 THEN 1000 ELSE 0 END)", "current_liabilities": "trade_payables + short_term_borrowings + current_portion_of_debt + other_current_liabilities + (CASE WHEN (e + y + 3) % 9 = 0 THEN 1000 ELSE 0 END)", "gross_profit": "revenue - cost_of_sales + (CASE WHEN (e + y + 7) % 9 = 0 THEN 1000 ELSE 0 END)", "net_change_in_cash": "operating_cash_flow + investing_cash_flow + financing_cash_flow + (CASE WHEN (e + y + 12) % 9 = 0 THEN 1000 ELSE 0 END)", "ending_ppe": "beginning_ppe + capex - depreciation + (CASE WHEN (e + y + 15) % 9 = 0 THEN 1000 ELSE 0 END)", "ending_debt": "beginning_debt + new_borrowings - repayments + (CASE WHEN (e + y + 16) % 9 = 0 THEN 1000 ELSE 0 END)"},
    {"total_assets": "current_assets + non_current_assets + (CASE WHEN (e + y + 2) % 9 = 0 THEN 1000 ELSE 0 END)", "total_liabilities": "current_liabilities + non_current_liabilities + (CASE WHEN (e + y + 4) % 9 = 0 THEN 1000 ELSE 0 END)", "operating_profit": "gross_profit - operating_expenses + (CASE WHEN (e + y + 8) % 9 = 0 THEN 1000 ELSE 0 END)", "opening_cash": "cash - net_change_in_cash", "closing_cash": "cash + (CASE WHEN (e + y + 13) % 9 = 0 THEN 1000 ELSE 0 END)", "current_ratio": "CAST(current_assets AS DOUBLE) / current_liabilities + (CASE WHEN (e + y + 18) % 9 = 0 THEN 0.5 ELSE 0.0 END)"},
    {"total_equity": "total_assets - total_liabilities + (CASE WHEN (e + y + 5) % 9 = 0 THEN 1000 ELSE 0 END)", "ebit": "operating_profit + other_income + (CASE WHEN (e + y + 9) % 9 = 0 THEN 1000 ELSE 0 END)"},
    {"retained_earnings": "total_equity - share_capital - reserves + (CASE WHEN (e + y + 6) % 9 = 0 THEN 1000 ELSE 0 END)", "profit_before_tax": "ebit - finance_cost + (CASE WHEN (e + y + 10) % 9 = 0 THEN 1000 ELSE 0 END)"},
    {"profit_after_tax": "profit_before_tax - tax_expense + (CASE WHEN (e + y + 11) % 9 = 0 THEN 1000 ELSE 0 END)"},
    {"ending_retained_earnings": "beginning_retained_earnings + profit_after_tax - dividends + (CASE WHEN (e + y + 14) % 9 = 0 THEN 1000 ELSE 0 END)", "eps": "CAST(profit_after_tax AS DOUBLE) / 1000 + (CASE WHEN (e + y + 17) % 9 = 0 THEN 3.0 ELSE 0.0 END)", "roe": "CAST(profit_after_tax AS DOUBLE) / 50000 * (CASE WHEN (e + y) % 4 = 0 THEN 100 WHEN (e + y) % 4 = 1 THEN 3 ELSE 1 END)"},
]
_GONE = {"cash": 5, "income": 6, "balance": 7}  #: entities, by their last digit, of which a statement is missing


def _books() -> str:
    out = "SELECT CAST(l.l_suppkey AS INT) AS e, CAST(year(l.l_shipdate) AS INT) AS y, CAST(SUM(CAST(round(l.l_extendedprice) AS BIGINT)) AS BIGINT) AS x FROM lineitem l GROUP BY 1, 2"
    for step in BOOK_STEPS:
        out = "SELECT *, " + ", ".join(f"{v} AS {k}" for k, v in step.items()) + f" FROM ({out}) q"
    seen = ", ".join(f"CASE WHEN (e + y + {k}) % 19 = 0" + (f" OR e % 10 = {_GONE[s]}" if s in _GONE else "") + f" THEN NULL ELSE {m} END AS {m}" for k, (m, s) in enumerate(BOOK_METRICS))
    return f"SELECT e AS entity_id, y AS value_year, {seen} FROM ({out}) q"


VIEWS = {"fx_template": TEMPLATE, "fx_report": REPORT_PAGES, "fx_books": _books(), "fx_raw": RAW_TABLES, "fx_types": PAGE_TYPES, "fx_lines": LINES, "fx_grid": GRID, "fx_metric_values": METRIC_VALUES, "fx_named_values": NAMED_VALUES, "fx_rows": ROWS, "fx_cells": CELLS, "fx_pages": PAGES, "fx_insights": INSIGHTS, "fx_boxes": BOXES, "fx_statements": STATEMENTS}
TABLES = {"fx_template": ("lineitem", "orders", "part"), "fx_report": ("documents",), "fx_books": ("lineitem",), "fx_raw": ("part",), "fx_types": ("part",), "fx_lines": ("lineitem", "part"), "fx_grid": ("lineitem", "part"), "fx_metric_values": ("lineitem", "orders", "part"), "fx_named_values": ("lineitem", "orders", "part"), "fx_rows": ("lineitem", "part"), "fx_cells": ("lineitem", "part"), "fx_pages": ("documents",), "fx_insights": ("documents",), "fx_boxes": ("part",), "fx_statements": ("lineitem",)}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Fixtures made from another one.
BASES = {"fx_template": "fx_metric_values", "fx_lines": "fx_rows", "fx_grid": "fx_lines", "fx_cells": "fx_rows", "fx_named_values": "fx_metric_values"}


def fixture(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The tables are arguments of the SQL, so that no view of the caller is replaced."""
    frames = {t: table(spark, sf_dir, t) for t in TABLES[name]}
    sql = VIEWS[name]
    if name in BASES:
        frames = {BASES[name]: fixture(spark, sf_dir, BASES[name])}
    for t in frames:
        sql = re.sub(rf"\b(FROM|JOIN) {t}\b", rf"\1 {{{t}}}", sql)
    return spark.sql(sql, **frames)


def with_fixture(name: str, rest: str, *more: str) -> str:
    """SQL that begins with the fixtures' definitions; rest is a query, or further definitions and a query."""
    names = [name, *more]
    while names[0] in BASES:
        names.insert(0, BASES[names[0]])
    return "WITH RECURSIVE " + ", ".join(f"{n} AS MATERIALIZED ({VIEWS[n]})" for n in names) + rest
