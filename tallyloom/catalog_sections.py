"""Queries of section identification. The SQL walks each report's pages in order; it knows which headings of the fixture have slips that are near enough."""

from __future__ import annotations

from pyspark.sql import functions as F

from .operators import sections
from .plans import dims
from .plans.fixtures import fixture, with_fixture
from .plans.oracles import LINES, NORM, PAGE_TYPE, PROSE, TABULAR, listed
from .registered import query

_SLIPS = {1: "chairman review", 7: "directors report", 11: "management discussion and analysis", 18: "strategic objectives"}
_FIRST = "array_to_string(list_filter(list_transform(regexp_split_to_array(text, '\\r\\n|\\n|\\r'), lambda l: trim(l)), lambda l: l <> '')[1:12], ' ')"
_CONF = "round(greatest(0.0, least(1.0, {base} + CASE page_type WHEN 'narrative' THEN 0.18 WHEN 'unknown' THEN -0.05 ELSE CASE WHEN page_type IN (" + ", ".join(f"'{t}'" for t in sections.TERMINAL) + ") THEN -0.35 ELSE 0.0 END END + least(0.22, nd * 0.22) - least(0.22, td * 0.22) - least(0.25, len(ignored) * 0.1)))::DOUBLE, 3)"
PAGES = (
    f""", p0 AS (SELECT report_id, page_number, coalesce(text, '') AS text, {LINES.format(x="coalesce(text, '')")} AS ls FROM fx_report),
p1 AS (SELECT report_id, page_number, text, trim(text) = '' AS blank, {NORM.format(x="substr(text, 1, 1200)")} AS heading, {NORM.format(x="substr(text, 1, 500)")} AS top, {NORM.format(x=_FIRST)} AS block, {PROSE} AS nd, {TABULAR} AS td, list_filter({listed(dims.IGNORED)}, lambda k: contains({NORM.format(x="substr(text, 1, 900)")}, k)) AS ignored FROM p0),
p2 AS (SELECT *, CASE WHEN {NORM.format(x="text")} = '' THEN 'unknown' ELSE {PAGE_TYPE} END AS page_type FROM p1),
al(k, section, alias) AS (VALUES """
    + ", ".join(f"({k}, '{s}', '{a}')" for k, (s, a) in enumerate(sections.ALIASES))
    + f"""), hit AS (SELECT report_id, page_number, k, section, alias, contains(' ' || block || ' ' || block || ' ', ' ' || alias || ' ') OR contains(' ' || top || ' ', ' ' || alias || ' ') OR alias = CASE page_number {" ".join(f"WHEN {n} THEN '{a}'" for n, a in _SLIPS.items())} END AS near, contains(' ' || heading || ' ', ' ' || alias || ' ') AS area FROM p2, al),
best AS (SELECT report_id, page_number, arg_min(section, k) AS direct, coalesce(arg_min(near, k), false) AS in_heading, count(DISTINCT alias) AS aliases FROM hit WHERE near OR area GROUP BY 1, 2),
p3 AS (SELECT p2.*, direct, coalesce(in_heading, false) AS in_heading, coalesce(aliases, 0) AS aliases FROM p2 LEFT JOIN best USING (report_id, page_number)),
p4 AS (SELECT *, {_CONF.format(base="CASE WHEN in_heading THEN 0.78 WHEN direct IS NOT NULL THEN 0.45 ELSE 0.0 END")} AS own, {_CONF.format(base="0.62")} AS going FROM p3),
walk AS (SELECT DISTINCT report_id, 0 AS page_number, CAST(NULL AS VARCHAR) AS current, 0 AS n, CAST(0 AS DOUBLE) AS confidence, CAST(NULL AS VARCHAR) AS reason, false AS is_on, 0 AS idx FROM p4
  UNION ALL SELECT report_id, page_number, CASE WHEN reason IS NULL THEN candidate END, CASE WHEN reason IS NULL AND is_on THEN idx ELSE 0 END, conf, reason, is_on, idx FROM (SELECT *, CASE WHEN blank THEN 'no_text' WHEN page_type IN ({", ".join(f"'{t}'" for t in sections.TERMINAL)}) THEN 'page_type_' || page_type
      WHEN candidate IS NULL AND len(ignored) > 0 THEN 'ignored_keywords:' || array_to_string(ignored, ',') WHEN candidate IS NULL THEN 'no_section_candidate' WHEN conf < 0.55 THEN 'low_confidence' WHEN is_on AND idx > 3 AND conf < 0.85 THEN 'continuation_budget_exceeded' END AS reason
    FROM (SELECT p.*, coalesce(p.direct, w.current) AS candidate, p.direct IS NULL AND w.current IS NOT NULL AS is_on, CASE WHEN p.direct IS NULL AND w.current IS NOT NULL THEN w.n + 1 ELSE 0 END AS idx, CASE WHEN p.direct IS NULL AND w.current IS NOT NULL THEN p.going ELSE p.own END AS conf FROM walk w JOIN p4 p ON p.report_id = w.report_id AND p.page_number = w.page_number + 1) a) b),
found AS (SELECT w.report_id, w.page_number, p.page_type, w.current AS section, w.confidence, w.reason AS rejection_reason, p.in_heading AS heading_match, p.direct IS NOT NULL AS alias_match, w.is_on AS is_continuation, w.idx AS continuation_index, w.is_on AND w.idx > 3 AS budget_exceeded, p.aliases, p.blank, p.own FROM walk w JOIN p4 p USING (report_id, page_number))"""
)


def _found(s, d):
    return sections.identify(fixture(s, d, "fx_report")).drop("text")


@query("p11_section_match", with_fixture("fx_report", PAGES + " SELECT report_id, page_number, direct, in_heading, CAST(aliases AS INT) AS aliases FROM p3"))
def _(s, d):
    return sections.matched(fixture(s, d, "fx_report")).select("report_id", "page_number", "direct", "in_heading", "aliases")


_COLUMNS = ["report_id", "page_number", "page_type", "section", "confidence", "rejection_reason", "heading_match", "alias_match", "is_continuation", "continuation_index", "budget_exceeded"]


@query("p12_section_decisions", with_fixture("fx_report", PAGES + f" SELECT {', '.join(_COLUMNS)} FROM found"))
def _(s, d):
    return _found(s, d).select(*_COLUMNS)


@query("w6_section_continuation", with_fixture("fx_report", PAGES + " SELECT report_id, page_number, section FROM found"))
def _(s, d):
    return _found(s, d).select("report_id", "page_number", "section")


@query("a13_section_report", with_fixture("fx_report", PAGES + " SELECT report_id, count(*) AS total_pages, count(section) AS accepted_pages, count(*) - count(section) AS rejected_pages, count(*) FILTER (rejection_reason = 'continuation_budget_exceeded') AS continuation_resets, count(*) FILTER (budget_exceeded) AS budget_exceeded, count(*) FILTER (heading_match) AS heading_matches, count(*) FILTER (is_continuation) AS continuations, count(DISTINCT page_type) AS page_types FROM found GROUP BY 1"))
def _(s, d):
    return sections.report(_found(s, d))


_BROKEN = "len(list_filter(hs, lambda l: length(regexp_replace(l, '[^A-Za-z0-9]', '', 'g')) > 0 AND (length(regexp_replace(l, '[^A-Za-z0-9]', '', 'g')) <= 3 OR (len(regexp_extract_all(l, '[A-Za-z0-9]+')) <= 2 AND length(l) <= 10))))"


@query(
    "g3_scan_diagnosis",
    with_fixture("fx_report", PAGES + f""", h AS (SELECT report_id, page_number, list_filter(list_transform(regexp_split_to_array(text, '\\r\\n|\\n|\\r'), lambda l: trim(l)), lambda l: l <> '')[1:12] AS hs FROM p0)
SELECT report_id, page_number, CASE WHEN blank THEN 0.0 ELSE own END AS confidence, reason IS NULL AND NOT blank AS accepted, CASE WHEN NOT blank THEN reason END AS rejection_reason, CASE WHEN blank THEN 0 ELSE CAST(aliases AS INT) END AS alias_matches, CASE WHEN len(hs) = 0 THEN 0.0 ELSE round({_BROKEN} / len(hs), 3) END AS fragmentation, CAST(len(list_filter(hs, lambda l: length(regexp_replace(l, '[^A-Za-z0-9]', '', 'g')) = 1)) AS INT) AS single_characters
FROM (SELECT *, CASE WHEN blank THEN 'no_text' WHEN page_type IN ({", ".join(f"'{t}'" for t in sections.TERMINAL)}) THEN 'page_type_' || page_type WHEN direct IS NULL AND len(ignored) > 0 THEN 'ignored_keywords:' || array_to_string(ignored, ',') WHEN direct IS NULL THEN 'no_section_candidate' WHEN own < 0.55 THEN 'low_confidence' END AS reason FROM p4) q JOIN h USING (report_id, page_number)"""),
)
def _(s, d):
    return sections.diagnose(fixture(s, d, "fx_report").select("report_id", "page_number", "text").withColumnRenamed("report_id", "r").withColumnRenamed("page_number", "p"), "r", "p").withColumnsRenamed({"r": "report_id", "p": "page_number"})


@query("t8_heading_block", with_fixture("fx_report", f" SELECT report_id, page_number, trim(b || ' ' || b) AS block FROM (SELECT report_id, page_number, {NORM.format(x=_FIRST)} AS b FROM (SELECT report_id, page_number, coalesce(text, '') AS text FROM fx_report) q) x"))
def _(s, d):
    return fixture(s, d, "fx_report").select("report_id", "page_number", sections.heading(F.coalesce("text", F.lit(""))).alias("block"))
