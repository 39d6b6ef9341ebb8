"""Pieces of SQL that several queries' equivalents share."""

from __future__ import annotations

from . import dims

NORM = "trim(regexp_replace(replace(lower({x}), '&', ' and '), '[^a-z0-9]+', ' ', 'g'))"
SHOWN = "regexp_replace(l, '\\s', '', 'g')"
#: Lines of x.text as ls; their densities.
LINES = "list_filter(regexp_split_to_array({x}, '\\r\\n|\\n|\\r'), lambda l: length(trim(l)) > 0)"
TABULAR = f"CASE WHEN len(ls) = 0 THEN 0.0 ELSE round(len(list_filter(ls, lambda l: 4 * length(regexp_replace({SHOWN}, '[^0-9]', '', 'g')) >= length({SHOWN}) OR regexp_matches(l, '\\b(?:19|20)[0-9]{{2}}\\b') OR len(regexp_split_to_array(trim(l), ' {{2,}}')) >= 3)) / len(ls), 6) END"
PROSE = f"CASE WHEN len(ls) = 0 THEN 0.0 ELSE round(len(list_filter(ls, lambda l: len(regexp_split_to_array(trim(l), ' +')) >= 6 AND 100 * length(regexp_replace({SHOWN}, '[^A-Za-z]', '', 'g')) >= 55 * length({SHOWN}))) / len(ls), 6) END"
#: The page type of a heading with densities nd and td.
PAGE_TYPE = "CASE " + " ".join(f"WHEN regexp_matches(heading, '{'|'.join(ph)}') THEN '{k}'" for k, _, ph in dims.PAGE_TYPES) + f" WHEN regexp_matches(heading, '{'|'.join(dims.NARRATIVE_HEADINGS)}') AND nd >= 0.35 THEN 'narrative' WHEN td >= 0.55 AND nd < 0.45 THEN 'table_heavy' WHEN nd >= 0.55 AND td < 0.45 THEN 'narrative' ELSE 'unknown' END"


def listed(xs: list[str]) -> str:
    return "[" + ", ".join("'" + x.replace("'", "''") + "'" for x in xs) + "]"
