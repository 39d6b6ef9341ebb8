"""Text functions as Column expressions: they stay in the JVM and in generated code where that is possible."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..plans import dims


#: All that Unicode counts as white space.
SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def once(x: Column, use: Callable[[Column], Column]) -> Column:
    """What ``use`` makes of x, which is computed once for a row, however often and in whatever lambda ``use`` speaks of it."""
    return F.transform(F.array(x), use)[0]


def strip(x: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.btrim(x, F.lit(SPACE))


def normalize_text(x: Column, keep: str = "") -> Column:
    """Lower case, & as a word, all else but letters and digits (and ``keep``) as single spaces."""
    return F.trim(F.regexp_replace(F.replace(F.lower(x), F.lit("&"), F.lit(" and ")), f"[^a-z0-9{keep}]+", " "))


def snake_key(x: Column) -> Column:
    """T2."""
    return F.replace(normalize_text(x), F.lit(" "), F.lit("_"))


def compact(x: Column) -> Column:
    """T3."""
    return F.regexp_replace(F.lower(x), "[^a-z0-9]+", "")


def has_phrase(text: Column, phrase: Column) -> Column:
    """T4: on word bounds; both sides are outputs of normalize_text."""
    return (phrase != "") & F.contains(F.concat(F.lit(" "), text, F.lit(" ")), F.concat(F.lit(" "), phrase, F.lit(" ")))


def has_signal(text: Column, signal: str) -> Column:
    """T5: a phrase, or 8 or more compact characters anywhere."""
    small = "".join(c for c in signal.lower() if c.isalnum())
    found = has_phrase(normalize_text(text), normalize_text(F.lit(signal)))
    return found | F.contains(compact(text), F.lit(small)) if len(small) >= 8 else found


def lines(x: Column) -> Column:
    return F.split(x, r"\R")


def clean_text(x: Column) -> Column:
    """Each line with single spaces, blank ones dropped."""
    return F.array_join(F.filter(F.transform(lines(x), lambda l: strip(F.regexp_replace(l, r"(?U)\s+", " "))), lambda l: l != ""), "\n")


def table_density(x: Column) -> Column:
    """Share of lines that look like a table's row."""
    filled = F.filter(lines(x), lambda l: F.length(F.trim(l)) > 0)

    def tabular(l: Column) -> Column:
        shown = F.regexp_replace(l, r"\s+", "")
        digits = F.length(F.regexp_replace(l, "[^0-9]+", ""))
        return (4 * digits >= F.length(shown)) | F.regexp_like(l, F.lit(r"\b(?:19|20)[0-9]{2}\b")) | (F.size(F.split(F.trim(l), " {2,}")) >= 3)

    return once(filled, lambda ls: F.when(F.size(ls) == 0, 0.0).otherwise(F.round(F.size(F.filter(ls, tabular)) / F.size(ls), 6)))


def narrative_density(x: Column) -> Column:
    """Share of lines that look like prose: six words, and mostly letters."""
    filled = F.filter(lines(x), lambda l: F.length(F.trim(l)) > 0)

    def prose(l: Column) -> Column:
        shown = F.regexp_replace(l, r"\s+", "")
        letters = F.length(F.regexp_replace(l, r"[^A-Za-z]+", ""))
        return (F.size(F.split(F.trim(l), " +")) >= 6) & (100 * letters >= 55 * F.length(shown))

    return once(filled, lambda ls: F.when(F.size(ls) == 0, 0.0).otherwise(F.round(F.size(F.filter(ls, prose)) / F.size(ls), 6)))


#: Bytes of text that are looked at together, and from which length on a line is left to the expressions (its counts have 20 bits).
BLOCK, LONG_LINE = 1 << 20, 1 << 20
_ALNUM = [c for c in range(128) if chr(c).isalnum()]
_WORD = np.isin(np.arange(256), [*_ALNUM, ord("_")])
_ENDS = np.isin(np.arange(256), [10, 11, 12, 13])
#: What a byte adds: 1 if it begins a character that is no white space, 2**21 for a digit, 2**42 for a letter.
_WEIGHT = np.array([(not (128 <= c < 192 or c in (9, 10, 11, 12, 13, 32))) + ((48 <= c < 58) << 21) + ((c in _ALNUM and c > 57) << 42) for c in range(256)], dtype=np.int64)


def count_lines(texts: Sequence[str]) -> list[tuple[int, int, int] | None]:
    """For each text how many lines are filled, look like prose, look like a table's row (T9). None where Java's idea of a line or a word
    must decide: a year beside a letter that isn't ASCII, rare line ends, very long lines."""
    parts = [t.encode() for t in texts]
    first = np.cumsum([1] + [len(p) + 1 for p in parts])
    b = np.frombuffer(b"\n" + b"\n".join(parts) + b"\n\n\n\n\n", dtype=np.uint8)
    total = np.cumsum(_WEIGHT[b])
    cuts = np.flatnonzero(_ENDS[b])
    s, e = cuts[:-1] + 1, cuts[1:]
    s, e = s[e > s], e[e > s]
    row = np.searchsorted(first, s, "right") - 1
    sums = total[e - 1] - total[s - 1]
    shown, digits, letters = sums & 0x1FFFFF, (sums >> 21) & 0x1FFFFF, sums >> 42
    space = b == 32
    begins = np.flatnonzero(space[1:] & ~space[:-1]) + 1  # of runs of spaces; no run goes over a line's end
    long = begins[space[begins + 1]]
    inside = lambda xs: np.searchsorted(xs, e) - np.searchsorted(xs, s)
    starts, stops = space[s], space[e - 1]
    runs = inside(begins)
    filled, words = ~(starts & stops & (runs == 1)), runs - starts - stops + 1
    columns = inside(long) - (starts & space[s + 1]) - (stops & space[e - 2]) + 1
    y = np.flatnonzero(((b[:-4] == 49) & (b[1:-3] == 57)) | ((b[:-4] == 50) & (b[1:-3] == 48)))
    is_digit = lambda at: (b[at] >= 48) & (b[at] < 58)
    y = y[is_digit(y + 2) & is_digit(y + 3) & ~_WORD[b[y - 1]] & ~_WORD[b[y + 4]]]
    odd = set((np.searchsorted(first, y[(b[y - 1] > 127) | (b[y + 4] > 127)], "right") - 1).tolist())
    c2, e2 = np.flatnonzero(b == 0xC2), np.flatnonzero(b == 0xE2)
    rare = np.concatenate([c2[b[c2 + 1] == 0x85], e2[(b[e2 + 1] == 0x80) & ((b[e2 + 2] == 0xA8) | (b[e2 + 2] == 0xA9))]])
    odd |= set((np.searchsorted(first, rare, "right") - 1).tolist()) | set(row[e - s >= LONG_LINE].tolist())
    tabular = filled & ((4 * digits >= shown) | (inside(y) > 0) | (columns >= 3))
    prose = filled & (words >= 6) & (100 * letters >= 55 * shown)
    n, p, t = (np.bincount(row[x], minlength=len(parts)).tolist() for x in (filled, prose, tabular))
    return [None if k in odd else c for k, c in enumerate(zip(n, p, t))]


def blocks(texts: Sequence[str], most: int = BLOCK) -> list[tuple[int, int]]:
    """Ranges of texts of about ``most`` characters, so that what is computed for them stays small."""
    out, start, size = [], 0, 0
    for k, t in enumerate(texts):
        size += len(t)
        if size >= most:
            out.append((start, k + 1))
            start, size = k + 1, 0
    return out + [(start, len(texts))] * (start < len(texts))


def densities(x: Column) -> tuple[Column, Column]:
    """narrative_density and table_density, the lines of a batch looked at together; for texts without nulls."""

    @F.pandas_udf("struct<n int, prose int, tabular int>")
    def count(texts: pd.Series) -> pd.DataFrame:
        ts = texts.tolist()
        found = [c or (None, None, None) for i, j in blocks(ts) for c in count_lines(ts[i:j])]
        return pd.DataFrame(found, columns=["n", "prose", "tabular"], dtype="Int32")

    c = count(x)
    share = lambda k, exact: F.when(c["n"].isNull(), exact).when(c["n"] == 0, 0.0).otherwise(F.round(c[k] / c["n"], 6))
    return share("prose", narrative_density(x)), share("tabular", table_density(x))


def found_in(text: Column, phrases: Sequence[str]) -> Column:
    """The phrases that the text has, in the order given."""
    return once(text, lambda t: F.filter(F.array(*map(F.lit, phrases)), lambda p: F.contains(t, p)))


def chunks(x: Column, most: int, overlap: int) -> Column:
    """Paragraphs packed by new lines up to ``most`` characters; only a longer paragraph is cut, with an overlap."""
    step = most - overlap
    parts = F.filter(F.transform(lines(x), lambda l: strip(l)), lambda l: l != "")
    empty = F.struct(F.lit("").alias("now"), F.array().cast("array<string>").alias("done"))

    def cut(s: Column, p: Column) -> Column:
        done = F.when(s["now"] != "", F.array_append(s["done"], s["now"])).otherwise(s["done"])
        start = F.struct(p.alias("now"), done.alias("done"))
        return F.aggregate(
            F.sequence(F.lit(1), F.ceil(F.length(p) / step).cast("int") + 1),
            start,
            lambda t, _: F.when(F.length(t["now"]) > most, F.struct(strip(F.substr(t["now"], F.lit(step + 1))).alias("now"), F.array_append(t["done"], strip(F.substr(t["now"], F.lit(1), F.lit(most)))).alias("done"))).otherwise(t),
        )

    def add(s: Column, p: Column) -> Column:
        both = F.when(s["now"] == "", p).otherwise(F.concat(s["now"], F.lit("\n"), p))
        return F.when(F.length(both) <= most, F.struct(both.alias("now"), s["done"].alias("done"))).when(F.length(p) <= most, F.struct(p.alias("now"), F.array_append(s["done"], s["now"]).alias("done"))).otherwise(cut(s, p))

    return F.aggregate(parts, empty, add, lambda s: F.when(s["now"] != "", F.array_append(s["done"], s["now"])).otherwise(s["done"]))


def title_case(x: Column) -> Column:
    """Q10: a capital after anything but a letter."""
    return F.array_join(F.transform(F.regexp_extract_all(F.lower(x), F.lit("[a-z]+|[^a-z]+"), F.lit(0)), lambda p: F.initcap(p)), "")


def sheet_base(x: Column, most: int = 31) -> Column:
    """Without characters that sheet names can't have, cut between words."""
    clean = F.coalesce(F.nullif(F.trim(F.regexp_replace(F.regexp_replace(x, r"[\\/?*\[\]:]", " "), r"\s+", " ")), F.lit("")), F.lit("Sheet"))
    short = F.substr(clean, F.lit(1), F.lit(most + 1))
    words = F.trim(F.regexp_replace(short, r" [^ ]*$", ""))
    return F.when(F.length(clean) <= most, clean).when((words != "") & (F.length(words) <= most), words).otherwise(F.trim(F.substr(clean, F.lit(1), F.lit(most))))


def normalize_label(x: Column) -> Column:
    """White space, words that cells split, and the spaces beside punctuation."""
    out = F.trim(F.regexp_replace(x, r"\s+", " "))
    for split, whole in dims.SPLIT_WORDS:
        out = F.regexp_replace(out, split, whole)
    out = F.regexp_replace(out, r"\s+([,;:)])", "$1")
    return F.trim(F.regexp_replace(out, r"\(\s+", "("))


def type_matches(table_type: Column, candidates: Sequence[str]) -> Column:
    """The snake keys are equal, or one has the other in it."""
    key = snake_key(table_type)
    tests = [key.contains(snake_key(F.lit(c))) | F.contains(snake_key(F.lit(c)), key) for c in candidates]
    return F.coalesce(*[F.when(t, True) for t in tests], F.lit(False))


def no_value_cell(cell: Column) -> Column:
    """P5: cells that an alignment of values leaves out: blank, a year, a note's number, a rating."""
    x = strip(F.coalesce(cell, F.lit("")))
    return (x == "") | x.rlike(r"^(?:19|20)[0-9]{2}$") | x.rlike(dims.NOTE_CELL) | x.rlike(dims.RATING_CELL)
