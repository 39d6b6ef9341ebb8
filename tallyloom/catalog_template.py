"""Queries of templates: the verdict on each sheet, the template as a whole, and where its cells are."""

from __future__ import annotations

from .operators import template
from .plans import dims
from .plans.fixtures import fixture, with_fixture
from .plans.oracles import listed
from .registered import query

_KEY = "replace(lower({x}), ' ', '_')"
SHEETS = f""", need AS (SELECT DISTINCT table_type AS sheet, metric AS term FROM fx_metric_values), yr AS (SELECT DISTINCT table_type AS sheet, value_year AS y FROM fx_metric_values),
have AS (SELECT DISTINCT {_KEY.format(x="sheet")} AS sheet, {_KEY.format(x="value")} AS term, bool_or(col <= 3) OVER (PARTITION BY sheet, value) AS placed FROM fx_template WHERE regexp_matches(value, '[A-Za-z]') AND value <> 'Particulars'),
years AS (SELECT DISTINCT {_KEY.format(x="sheet")} AS sheet, CAST(value AS INT) AS y FROM fx_template WHERE NOT regexp_matches(value, '[A-Za-z]') AND row <= 20),
m AS (SELECT n.sheet, count(*) AS n, count(h.term) AS have, count(*) FILTER (h.placed) AS placed, count(*) FILTER (list_contains({listed(dims.CRITICAL_TEMPLATE)}, n.term)) AS c, count(h.term) FILTER (list_contains({listed(dims.CRITICAL_TEMPLATE)}, n.term)) AS chave, list(n.term ORDER BY n.term) FILTER (h.term IS NULL) AS lost FROM need n LEFT JOIN have h USING (sheet, term) GROUP BY 1),
y AS (SELECT yr.sheet, count(*) AS n, count(years.y) AS have, list(CAST(yr.y AS VARCHAR) ORDER BY yr.y) FILTER (years.y IS NULL) AS lost FROM yr LEFT JOIN years ON years.sheet = yr.sheet AND years.y = yr.y GROUP BY 1),
ex AS (SELECT sheet, string_agg(term, ',' ORDER BY term) AS extra FROM have h WHERE NOT EXISTS (SELECT 1 FROM need n WHERE n.sheet = h.sheet AND n.term = h.term) GROUP BY 1),
s0 AS (SELECT m.sheet, m.sheet <> 'notes' AS known, coalesce(m.lost, []) AS lost, coalesce(y.lost, []) AS ylost, coalesce(extra, '') AS extra, CASE WHEN m.sheet = 'notes' THEN 0.0 ELSE round(50.0 * m.have / m.n + 25.0 * y.have / y.n + 15.0 * m.placed / m.n + 10.0 * CASE WHEN c = 0 THEN 0 ELSE chave / c END, 2) END::DOUBLE AS score FROM m JOIN y USING (sheet) LEFT JOIN ex USING (sheet)),
sheets AS (SELECT sheet, score, CASE WHEN NOT known THEN 'create' WHEN score >= 95 THEN 'compatible' WHEN score >= 80 THEN 'user_decision' ELSE 'replace' END AS action, array_to_string(lost, ',') AS missing_metrics, extra AS extra_metrics,
  CASE WHEN NOT known THEN sheet || ' sheet is missing and will be created.' ELSE array_to_string(list_filter([CASE WHEN len(list_filter(lost, lambda x: list_contains({listed(dims.CRITICAL_TEMPLATE)}, x))) > 0 THEN sheet || ' sheet missing critical metrics: ' || array_to_string(list_filter(lost, lambda x: list_contains({listed(dims.CRITICAL_TEMPLATE)}, x)), ', ') || '.' END] || list_transform(lost[1:5], lambda x: array_to_string(list_transform(string_split(x, '_'), lambda w: upper(w[1]) || w[2:]), ' ') || ' row missing.')
    || [CASE WHEN len(lost) > 5 THEN sheet || ' sheet has ' || (len(lost) - 5) || ' additional missing metrics.' END, CASE WHEN len(ylost) > 0 THEN sheet || ' sheet missing year columns: ' || array_to_string(ylost, ', ') || '.' END, CASE WHEN score < 80 THEN sheet || ' sheet is below 80% compatibility and will be replaced.' WHEN score < 95 THEN sheet || ' template requires user decision.' END], lambda x: x IS NOT NULL), ' ') END AS warnings FROM s0)"""


def _sides(s, d):
    v = fixture(s, d, "fx_metric_values")
    return v.withColumnRenamed("table_type", "sheet"), fixture(s, d, "fx_template")


@query("x2_template_sheets", with_fixture("fx_template", SHEETS + " SELECT * FROM sheets"))
def _(s, d):
    return template.verdicts(*_sides(s, d))


@query("x5_template_mode", with_fixture("fx_template", SHEETS + " SELECT round(avg(score), 2) AS score, bool_and(action = 'compatible') AS is_match, CASE WHEN bool_and(action = 'compatible') THEN 'template' WHEN bool_or(action = 'user_decision') THEN 'user_decision' ELSE 'dynamic' END AS mode FROM sheets"))
def _(s, d):
    return template.overall(template.verdicts(*_sides(s, d)))


@query("j17_template_cells", with_fixture("fx_template", f", v AS (SELECT DISTINCT table_type AS sheet, metric, value_year FROM fx_metric_values) SELECT v.*, (SELECT min(row) FROM fx_template t WHERE {_KEY.format(x='t.sheet')} = v.sheet AND {_KEY.format(x='t.value')} = v.metric) AS at_row, (SELECT arg_min(col, (row, col)) FROM fx_template t WHERE {_KEY.format(x='t.sheet')} = v.sheet AND t.value = CAST(v.value_year AS VARCHAR)) AS at_col FROM v"))
def _(s, d):
    values, cells = _sides(s, d)
    return template.placed(values.select("sheet", "metric", "value_year").distinct(), cells)


@query("x1_template_terms", with_fixture("fx_template", SHEETS + " SELECT sheet AS sheet_key, 'metric' AS kind, term, placed FROM have UNION ALL SELECT y.sheet, 'year', CAST(y.y AS VARCHAR), y.y - 1990 <= 3 FROM years y"))
def _(s, d):
    return template.terms(fixture(s, d, "fx_template"))
