"""Queries of pages: which grid has which type, in SQL as a fold over the candidates of each page."""

from __future__ import annotations

from pyspark.sql import functions as F

from .operators import assembly, matching
from .plans import dims
from .plans.fixtures import fixture, with_fixture
from .registered import query

_NORM = "trim(regexp_replace(replace(lower({x}), '&', ' and '), '[^a-z0-9]+', ' ', 'g'))"
_KEY = f"replace({_NORM.format(x='table_type')}, ' ', '_')"


def _values(lists) -> str:
    return ", ".join(f"('{k}', '{w}')" for k, v in lists.items() for w in v)


def fold(candidates: str) -> str:
    """Definitions that end in won(page_number, precedence, score, raw, cls): candidates by precedence, score, raw and class, of which one is taken if both its sides are free."""
    return f""", ranked AS (SELECT *, row_number() OVER (PARTITION BY page_number ORDER BY precedence, score DESC, raw, cls) AS rn FROM ({candidates})),
taken AS (SELECT page_number, CAST(0 AS BIGINT) AS rn, CAST([] AS INT[]) AS rs, CAST([] AS INT[]) AS cs, -1 AS precedence, CAST(0 AS DOUBLE) AS score, -1 AS raw, -1 AS cls, false AS ok FROM (SELECT DISTINCT page_number FROM ranked)
  UNION ALL SELECT t.page_number, r.rn, CASE WHEN free THEN list_append(rs, r.raw) ELSE rs END, CASE WHEN free THEN list_append(cs, r.cls) ELSE cs END, r.precedence, r.score, r.raw, r.cls, free
  FROM taken t JOIN ranked r ON r.page_number = t.page_number AND r.rn = t.rn + 1, LATERAL (SELECT NOT list_contains(t.rs, r.raw) AND NOT list_contains(t.cs, r.cls) AS free) f),
won AS (SELECT page_number, precedence, score, raw, cls FROM taken WHERE ok)"""


_AREA = "greatest(0, least(r.x1, c.x1) - greatest(r.x0, c.x0)) * greatest(0, least(r.y1, c.y1) - greatest(r.y0, c.y0))"
_FOUND = f""", kw(k, w) AS (VALUES {_values(dims.TYPE_KEYWORDS)}), sg(k, w) AS (VALUES {_values(dims.TYPE_SIGNALS)}), pf(k, p) AS (VALUES {", ".join(f"('{k}', '{v}')" for k, v in dims.TYPE_PROFILES.items())}),
t0 AS (SELECT *, {_KEY} AS key, list_filter(string_split({_KEY}, '_'), lambda x: length(x) > 2 AND x NOT IN ({", ".join(f"'{w}'" for w in dims.TYPE_STOPS)})) AS tokens FROM fx_types),
t AS (SELECT t0.*, coalesce(p, key) AS profile FROM t0 LEFT JOIN pf ON pf.k = key),
g AS (SELECT *, {_NORM.format(x='text')} AS said FROM fx_raw),
both_sides AS (SELECT g.page_number, raw, cls, table_type, profile, n_years, n_labels,
  CASE WHEN key IN (SELECT k FROM kw) THEN (SELECT coalesce(sum(len(string_split(w, ' '))), 0) FROM kw WHERE k = key AND contains(' ' || said || ' ', ' ' || w || ' ')) ELSE len(list_filter(tokens, lambda x: contains(' ' || said || ' ', ' ' || x || ' '))) END AS words,
  (SELECT coalesce(sum(greatest(1, least(3, len(string_split(w, ' ')) // 2))), 0) FROM sg WHERE k = profile AND (contains(' ' || said || ' ', ' ' || w || ' ') OR (length(replace(w, ' ', '')) >= 8 AND contains(replace(said, ' ', ''), replace(w, ' ', ''))))) AS points
  FROM g JOIN t ON t.page_number = g.page_number),
pairs AS (SELECT *, CASE WHEN points > 0 THEN points + (n_years > 0)::INT + (n_labels >= 3)::INT ELSE 0 END AS built FROM both_sides)"""
_CANDIDATES = f"""SELECT r.page_number, 0 AS precedence, CAST(0 AS DOUBLE) AS score, raw, max(cls) AS cls FROM fx_raw r JOIN fx_types c ON c.page_number = r.page_number AND c.detected_id = r.detected_id GROUP BY 1, 4
UNION ALL SELECT page_number, 1, score, raw, cls FROM (SELECT r.page_number, raw, cls, round(greatest({_AREA} / ((r.x1 - r.x0) * (r.y1 - r.y0) + (c.x1 - c.x0) * (c.y1 - c.y0) - {_AREA}), {_AREA} / least((r.x1 - r.x0) * (r.y1 - r.y0), (c.x1 - c.x0) * (c.y1 - c.y0))), 6) AS score FROM fx_raw r JOIN fx_types c ON c.page_number = r.page_number WHERE c.x0 IS NOT NULL) WHERE score >= 0.8
UNION ALL SELECT r.page_number, 2, 0, raw, cls FROM fx_raw r JOIN fx_types c ON c.page_number = r.page_number AND c.page_table_index = r.raw
UNION ALL SELECT page_number, 3, 0, raw, cls FROM (SELECT page_number, max(raw) AS raw FROM fx_raw GROUP BY 1 HAVING count(*) = 1) JOIN (SELECT page_number, max(cls) AS cls FROM fx_types GROUP BY 1 HAVING count(*) = 1) USING (page_number)
UNION ALL SELECT page_number, 4, words, raw, cls FROM pairs WHERE words > 0 UNION ALL SELECT page_number, 5, built, raw, cls FROM pairs WHERE built >= 3"""
_METHOD = "list_extract([" + ", ".join(f"'{m}'" for m in assembly.METHODS) + "], precedence + 1)"
_ASSEMBLED = _FOUND + fold(_CANDIDATES) + f""", grids AS (SELECT r.page_number, r.raw, w.cls, coalesce(c.table_type, 'unclassified') AS table_type, {_METHOD} AS method, n_values FROM fx_raw r LEFT JOIN won w ON w.page_number = r.page_number AND w.raw = r.raw LEFT JOIN fx_types c ON c.page_number = w.page_number AND c.cls = w.cls),
lost AS (SELECT t.page_number, t.cls, t.table_type, t.profile NOT IN ({", ".join(f"'{x}'" for x in dims.PRIMARY_PROFILES)}) AND coalesce((SELECT max(built) FROM pairs p JOIN won w ON w.page_number = p.page_number AND w.raw = p.raw WHERE p.page_number = t.page_number AND p.cls = t.cls), 0) >= 4 AS covered FROM t WHERE NOT EXISTS (SELECT 1 FROM won w WHERE w.page_number = t.page_number AND w.cls = t.cls))"""


def _sides(s, d):
    return fixture(s, d, "fx_raw"), fixture(s, d, "fx_types")


@query("j2_page_assembly", with_fixture("fx_raw", _ASSEMBLED + " SELECT page_number, raw, cls, table_type, method FROM grids", "fx_types"))
def _(s, d):
    return assembly.assemble(*_sides(s, d))[0]


@query("j8_residual_types", with_fixture("fx_raw", _ASSEMBLED + " SELECT * FROM lost", "fx_types"))
def _(s, d):
    return assembly.assemble(*_sides(s, d))[1]


@query("j6_structural_scores", with_fixture("fx_raw", _FOUND + " SELECT page_number, raw, cls, CAST(words AS INT) AS said, CAST(built AS INT) AS built FROM pairs", "fx_types"))
def _(s, d):
    return assembly._pairs(*_sides(s, d)).drop("table_type")


_RECOVERED = "method IN ('detected_table_id', 'bbox', 'order', 'fallback_structural_pattern')"
_PAGES = _ASSEMBLED + f""", gp AS (SELECT page_number, count(*) AS extracted, count(method) AS matched, count(*) FILTER (method = 'detected_table_id') AS id_matches, count(*) FILTER (method = 'bbox') AS bbox_matches, count(*) FILTER (method = 'order') AS order_matches, count(*) FILTER (method = 'fallback_text_similarity') AS fallback_matches,
  count(*) FILTER (method = 'fallback_structural_pattern') AS structural, count(*) FILTER ({_RECOVERED}) AS recovered, CAST(coalesce(sum(n_values) FILTER ({_RECOVERED}), 0) AS BIGINT) AS values_recovered, coalesce(string_agg(CAST(raw AS VARCHAR), ',' ORDER BY raw) FILTER (method IS NULL), '') AS unmatched_extractions FROM grids GROUP BY 1),
lp AS (SELECT page_number, count(*) FILTER (covered) AS covered, string_agg(table_type, ',' ORDER BY cls) FILTER (NOT covered) AS unmatched_classifications FROM lost GROUP BY 1), cp AS (SELECT page_number, count(*) AS classified FROM fx_types GROUP BY 1),
pg AS (SELECT page_number, coalesce(classified, 0) AS classified, coalesce(extracted, 0) AS extracted, coalesce(matched, 0) AS matched, coalesce(id_matches, 0) AS id_matches, coalesce(bbox_matches, 0) AS bbox_matches, coalesce(order_matches, 0) AS order_matches, coalesce(fallback_matches, 0) AS fallback_matches, coalesce(recovered, 0) AS recovered,
  coalesce(values_recovered, 0) AS values_recovered, coalesce(fallback_matches, 0) + coalesce(structural, 0) + coalesce(covered, 0) AS fallback_matches_applied, coalesce(structural, 0) + coalesce(covered, 0) AS unmatched_reduced, coalesce(unmatched_classifications, '') AS unmatched_classifications, coalesce(unmatched_extractions, '') AS unmatched_extractions
  FROM cp FULL JOIN gp USING (page_number) LEFT JOIN lp USING (page_number))"""


def _pages(s, d):
    raw, types = _sides(s, d)
    return assembly.pages(raw, *assembly.assemble(raw, types), types)


@query("d10_page_assembly_counts", with_fixture("fx_raw", _PAGES + " SELECT * FROM pg", "fx_types"))
def _(s, d):
    return _pages(s, d)


_SUMS = ["classified", "extracted", "matched", "id_matches", "bbox_matches", "order_matches", "fallback_matches", "recovered", "values_recovered", "fallback_matches_applied", "unmatched_reduced"]


@query("a4_report_sums", with_fixture("fx_raw", _PAGES + " SELECT CAST(page_number % 5 AS INT) AS report_id, " + ", ".join(f"CAST(sum({c}) AS BIGINT) AS {c}" for c in _SUMS) + " FROM pg GROUP BY 1", "fx_types"))
def _(s, d):
    return assembly.report(_pages(s, d).withColumn("report_id", F.col("page_number") % 5), "report_id")


@query("d11_type_tokens", with_fixture("fx_types", f" SELECT DISTINCT table_type, array_to_string(list_filter(string_split({_KEY}, '_'), lambda x: length(x) > 2 AND x NOT IN ({', '.join(repr(w) for w in dims.TYPE_STOPS)})), ' ') AS tokens FROM fx_types"))
def _(s, d):
    return fixture(s, d, "fx_types").select("table_type", F.array_join(assembly.name_tokens(F.col("table_type")), " ").alias("tokens")).distinct()


_BOX = "(l.x1 - l.x0) * (l.y1 - l.y0)"
_OVERLAP = "greatest(0, least(l.x1, r.x1) - greatest(l.x0, r.x0)) * greatest(0, least(l.y1, r.y1) - greatest(l.y0, r.y0))"


@query(
    "j7_greedy_match",
    with_fixture("fx_boxes", f", o AS (SELECT l.page_number, l.box_index AS raw, r.box_index AS cls, {_OVERLAP} AS i, {_BOX} AS a, {_BOX.replace('l.', 'r.')} AS b FROM fx_boxes l JOIN fx_boxes r ON l.page_number = r.page_number WHERE l.side = 'detected' AND r.side = 'classified')"
    + fold("SELECT page_number, 2 AS precedence, round(greatest(i / (a + b - i), i / least(a, b)), 6) AS score, raw, cls FROM o WHERE round(greatest(i / (a + b - i), i / least(a, b)), 6) >= 0.3 UNION ALL SELECT page_number, 3, 0, raw, cls FROM o WHERE raw = cls")
    + " SELECT * FROM won"),
)
def _(s, d):
    b = fixture(s, d, "fx_boxes")
    return matching.greedy_boxes(b.where("side = 'detected'"), b.where("side = 'classified'"), 0.3)
