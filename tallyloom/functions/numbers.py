"""Number functions: amounts as reports print them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..plans import dims
from .text import normalize_label, normalize_text, strip

#: Words that may stand beside an amount.
CURRENCY = r"(?i)\b(rs|pkr|usd|eur|gbp|rupees|rupee|amounts?|in)\b\.?"
SCALES = r"(?i)\b(thousands?|million|millions|mn|billion|billions|bn)\b\.?"
THOUSANDS = r"(?<![0-9])'000s?\b|(?<![0-9])\b000s?\b"
NULLS = ["", "-", "na", "n a", "nil", "none"]


def scale(x: Column) -> Column:
    """The factor that a text names, else null."""
    t = F.replace(F.lower(x), F.lit(","), F.lit(""))
    return F.when(t.rlike(r"\b(billion|billions|bn)\b"), 1_000_000_000).when(t.rlike(r"\b(million|millions|mn)\b"), 1_000_000).when(t.rlike(r"\b(thousand|thousands)\b") | t.rlike(THOUSANDS), 1_000).cast("long")


def table_scale(x: Column) -> Column:
    """Only a text that also says what is counted names a table's scale."""
    return F.when(F.lower(x).rlike(r"\b(in|amounts?|rs|pkr|usd|rupees?)\b"), scale(x))


def _token(x: Column) -> Column:
    t = F.replace(F.replace(x, F.lit(","), F.lit("")), F.lit("−"), F.lit("-"))
    for pattern in (CURRENCY, SCALES, "(?i)" + THOUSANDS):
        t = F.regexp_replace(t, pattern, " ")
    return F.replace(t, F.lit("%"), F.lit(" "))


def parse_amount(x: Column, table: Column | int = 1, percent_divides: bool = False, repair: bool = True) -> Column:
    """N1 (extractor: drops bars inside parentheses, else reads them as spaces, and drops a letter that stands for one before a negative number; a % changes nothing) and N2 (validator: a % divides by 100)."""
    t = strip(x)
    clean = _token(t)
    if repair:
        bars = F.when(clean.rlike(r"^\s*\(.*\)\s*$"), "").otherwise(" ")
        clean = F.regexp_replace(F.replace(clean, F.lit("|"), bars), r"\(\s*[Il]\s*(?=[+-]?[0-9])", "(")
        odd = F.contains(clean, F.lit(")")) & ~F.contains(clean, F.lit("("))
    else:
        odd = F.lit(False)
    found = F.regexp_extract(clean, r"\(\s*[+-]?[0-9]+(?:\.[0-9]+)?\s*\)|[-+]?[0-9]+(?:\.[0-9]+)?", 0)
    digits = F.regexp_extract(found, r"[0-9]+(?:\.[0-9]+)?", 0)
    factor = F.coalesce(scale(t), F.lit(table) if isinstance(table, int) else table)
    value = F.expr("1") * digits.try_cast("double") * factor
    value = F.when(found.startswith("(") | found.startswith("-"), -value).otherwise(value)
    if percent_divides:
        value = F.when(F.contains(t, F.lit("%")), value / 100).otherwise(value)
    none = x.isNull() | normalize_text(t).isin(NULLS) | odd | clean.rlike("[A-Za-z]") | (found == "")
    return F.when(~none, value)


def years(x: Column) -> Column:
    """N9."""
    return F.transform(F.regexp_extract_all(x, F.lit(r"\b(?:19|20)[0-9]{2}\b"), F.lit(0)), lambda y: y.cast("int"))


def is_year(x: Column) -> Column:
    return F.replace(F.trim(x), F.lit(","), F.lit("")).rlike(r"^(19|20)[0-9]{2}$")


def amounts_match(expected: Column, actual: Column, absolute: float = 0.5, relative: float = 0.0001) -> Column:
    """N11."""
    return F.abs(expected - actual) <= F.greatest(F.lit(absolute), F.abs(expected) * relative)


def scale_exempt(label: Column, cell: Column) -> Column:
    """P20: amounts per share, shares of a hundred, ratios and counts take no scale from their table."""
    said = normalize_text(normalize_label(F.concat_ws(" ", label, cell)))
    # percent signs are no part of the normalized text
    return said.rlike(dims.SCALE_EXEMPT) | F.replace(said, F.lit(" "), F.lit("")).rlike("|".join(dims.SCALE_EXEMPT_COMPACT))


def effective_scale(label: Column, cell: Column, table_multiplier: Column) -> Column:
    """The table's multiplier, or 1 if the metric is exempt."""
    return F.when((table_multiplier > 1) & scale_exempt(label, cell), F.lit(1).cast("long")).otherwise(table_multiplier.cast("long"))
