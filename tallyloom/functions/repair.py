"""Repair of labels that cells and scans have split (L2, L3): plain functions of one label, and an Arrow UDF over them."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..plans import dims

_TOKEN = re.compile(r"([^A-Za-z]*)([A-Za-z]+)([^A-Za-z]*)")
_FIXED = [(re.compile(p), w) for p, w in dims.SPLIT_WORDS]
_KNOWN, _NEVER = frozenset(dims.SPLIT_KNOWN), frozenset(dims.SPLIT_NEVER)
#: Every way to cut a word in two, to the word.
_CUTS = {(w[:k], w[k:]): w for w in sorted({*dims.SPLIT_KNOWN, *dims.SPLIT_LATER}) if len(w) > 3 or w in ("and", "per") for k in range(1, len(w))}
REPAIRED = "struct<deglued: string, completed: string, reasons: array<string>, with_unit: string>"


def normalize(label: str) -> str:
    """T6 of one label; the same as the Column ``text.normalize_label``."""
    out = " ".join(label.split())
    for pattern, whole in _FIXED:
        out = pattern.sub(whole, out)
    return re.sub(r"\(\s+", "(", re.sub(r"\s+([,;:)])", r"\1", out)).strip()


def _cased(word: str, upper: bool, capital: bool) -> str:
    """A repaired word as its parts were written."""
    if upper and len(word) > 2:
        return word.upper()
    return word.capitalize() if capital else word


def _pair(left: str, right: str) -> str | None:
    a, b = _TOKEN.fullmatch(left), _TOKEN.fullmatch(right)
    if not a or not b or a[3] or b[1] or a[2].upper() in _NEVER or b[2].upper() in _NEVER:
        return None
    word = (a[2] + b[2]).lower()
    if word not in _KNOWN:
        return None
    return a[1] + _cased(word, a[2].isupper() and b[2].isupper(), a[2][0].isupper()) + b[3]


def deglue(label: str, passes: int = 4) -> str:
    """L2: neighbouring tokens that make a known word are joined, from left to right, again and again."""
    tokens = normalize(label).split(" ")
    for _ in range(passes):
        out: list[str] = []
        rest = iter(range(len(tokens)))
        for i in rest:
            one = _pair(tokens[i], tokens[i + 1]) if i + 1 < len(tokens) else None
            out.append(one or tokens[i])
            if one:
                next(rest)
        if len(out) == len(tokens):
            break
        tokens = out
    return normalize(" ".join(tokens))


def respace(label: str) -> str:
    """L3: the two parts of a cut word with only white space between them are joined; longer words come first."""
    parts = re.findall(r"\w+|\W+", normalize(label))
    longest = 99
    while longest:
        found = [(len(w), -i) for i in range(len(parts) - 2) if parts[i + 1].isspace() and (w := _CUTS.get((parts[i].lower(), parts[i + 2].lower()))) and len(w) <= longest]
        if not found:
            break
        longest, at = max(found)
        at = -at
        seen = parts[at] + parts[at + 2]
        parts[at : at + 3] = [_cased(seen.lower(), seen.isupper(), seen[:1].isupper())]
    return normalize("".join(parts))


def _plain(x: str) -> str:
    return re.sub(r"[^a-z0-9]+", " ", x.lower().replace("&", " and ")).strip()


def unit_said(label: str, unit: str) -> bool:
    """Whether a label already has a word of the unit's kind."""
    a, b = _plain(label), _plain(unit)
    return bool(b) and any(any(t in b for t in group) and any(t in a for t in group) for group in dims.UNIT_GROUPS)


def _unit(unit: str) -> str:
    return re.sub(r"(?i)^(?:f|o\s*f)\s+(?=pkr|rs\.?|usd|rupees?)", "of ", normalize(unit))


def _open(label: str) -> bool:
    return label.endswith("(") or bool(re.search(r"\(\s*\d+$", label))


def with_unit(label: str, unit: str | None) -> str:
    """The label with the unit that stands in a cell beside it."""
    u = _unit(unit or "")
    if not u or unit_said(label, u) or ("%" in u and "%" in label):
        return label
    if _open(label) or u[0] in ")%":
        return normalize(label + u)
    return label if f" {_plain(u)} " in f" {_plain(label)} " and _plain(u) else normalize(f"{label} {u}")


def complete(label: str, unit: str | None) -> tuple[str, list[str]]:
    """L3: a unit closes what a label leaves open, cut ends are mended, parts of words joined; with the reasons."""
    out, reasons = normalize(label), []
    u = _unit(unit or "")
    if u and not unit_said(out, u) and (_open(out) or ("(" in out and ")" not in out and u[0] in "%)")):
        mended = with_unit(out, unit)
        if mended != out:
            out = mended
            reasons.append("unit_context_completion")
    for name, step in (("truncated_label_repair", lambda x: re.sub(r"(?i)\bnet assets\s*\(\s*100(?:\s*%)?$", "Net assets (100%)", x)), ("remaining_spacing_repair", respace)):
        mended = normalize(step(out))
        if mended != out:
            out = mended
            reasons.append(name)
    return out, reasons


def _whole(label: str, unit: str | None) -> tuple:
    glued = deglue(label)
    done, reasons = complete(glued, unit)
    return glued, done, reasons, with_unit(done, unit)


def repaired(label: Column, unit: Column) -> Column:
    """L2 and L3 of a label with the unit beside it; each label of an Arrow batch is repaired once."""

    @F.pandas_udf(REPAIRED)
    def run(labels: pd.Series, units: pd.Series) -> pd.DataFrame:
        known: dict[tuple, tuple] = {}
        out = []
        for key in zip(labels, units):
            if key not in known:
                known[key] = _whole(key[0], key[1]) if isinstance(key[0], str) else (None,) * 4
            out.append(known[key])
        return pd.DataFrame(out, columns=["deglued", "completed", "reasons", "with_unit"])

    return run(label, unit)
