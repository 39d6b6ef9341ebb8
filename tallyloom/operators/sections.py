"""Sections of narrative pages: aliases in headings, exact or nearly, how sure that is, and how long a section goes on.

Pages are rows of their own until the last step, which needs the pages of a report in order; nothing else is shuffled.

What a page's beginning says and its lines' kinds are found in two Arrow UDFs, a block of pages at a time. The near match
(Ratcliff/Obershelp ratio of 0.86 or more with a window of the heading) is bounded before it is computed: matching blocks of that much
text hold a known number of the alias's three-letter pieces, hardly shifted against each other, and only such stretches are compared.

Results for odd input: null texts are blank and have no section; a page without a report is a report's of its own kind (null).
"""

from __future__ import annotations

import re
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import SPACE, blocks, densities, lines, normalize_text, once, strip
from ..plans import dims
from .narrative import by_density

#: Characters that make the top of a page, and lines of its heading.
AREA, TOP, IGNORED_AREA, LINES = 1200, 500, 900, 12
#: From which ratio a window is an alias, from which confidence a page is taken, and, beyond BUDGET pages, goes on.
NEAR, ACCEPTED, BUDGET, SURE = 0.86, 0.55, 3, 0.85
TERMINAL = ["auditor_report", "financial_statement", "notes", "proxy", "shareholder", "table_heavy"]


def _plain(x: str) -> str:
    return " ".join("".join(c if c.isascii() and c.isalnum() else " " for c in x.lower().replace("&", " and ")).split())


#: (section, alias as normalized), in the order in which they are looked for.
ALIASES = [(s, _plain(a)) for s in dims.SECTIONS for a in dims.SECTION_ALIASES[s]]


def heading_lines(text: Column) -> Column:
    return F.slice(F.filter(F.transform(lines(text), strip), lambda l: l != ""), 1, LINES)


def heading(text: Column) -> Column:
    """The first lines, and again with runs of short lines joined; as both are joined in the end, the block is the lines twice."""
    return F.trim(F.concat_ws(" ", _first_lines(text), _first_lines(text)))


def _first_lines(text: Column) -> Column:
    return normalize_text(F.array_join(heading_lines(text), " "))


def matches_needed(n: int) -> list[tuple[int, int]]:
    """(u, m): a window that is near an alias of n characters leaves, for one of these, u characters of both without a match and matches m
    of the alias's or more: n - u, and as many as the ratio asks for. A pair that another one implies is left out.

    They match in u + 1 blocks at most, which are shifted against each other by u places at most. So m - (u + 1) pairs and m - 2 (u + 1)
    triples of neighbours match too, all of them on u + 1 neighbouring diagonals."""
    near, out = round(100 * NEAR), []
    for u in range(2 * n):
        m = max(-(-near * u // (200 - 2 * near)), n - u)
        if m > n:
            break
        out = [(v, k) for v, k in out if k < m] + [(u, m)]
    return out


def _may_be_near(alias: str) -> bool:
    words = alias.split()
    return len(words) >= 2 and len(alias) >= 10 and all(len(w) > 1 for w in words)


def _is_near(alias: str, text: str) -> bool:
    """Whether a window of one word less up to two more than the alias has the ratio; one of a wrong length or with too few of its letters isn't compared."""
    from difflib import SequenceMatcher

    words, size = text.split(), len(alias.split())
    m = SequenceMatcher(None, alias, "")
    seen = set()
    for n in range(max(1, size - 1), size + 3):
        for i in range(len(words) - n + 1):
            w = " ".join(words[i : i + n])
            if w in seen or 2 * min(len(w), len(alias)) < NEAR * (len(w) + len(alias)):
                continue
            seen.add(w)
            m.set_seq2(w)
            if m.quick_ratio() >= NEAR and m.ratio() >= NEAR:
                return True
    return False


class _Bounds:
    """Of the aliases that may be near something: their three-letter pieces, and how much of them a near window has on almost one diagonal."""

    GAP = 64

    def __init__(self) -> None:
        names = sorted({a for _, a in ALIASES if _may_be_near(a)})
        self.aliases = [(a, [k for k, (_, x) in enumerate(ALIASES) if x == a], matches_needed(len(a))) for a in names]
        assert all(len(a) + needs[-1][0] < self.GAP for a, _, needs in self.aliases)
        self.code = np.full(256, 37, dtype=np.uint8)
        self.code[np.frombuffer(b" abcdefghijklmnopqrstuvwxyz0123456789", dtype=np.uint8)] = np.arange(37)
        pieces = sorted((int(self._pieces(self._coded(a))[i]), n << 48 | i) for n, a in enumerate(names) for i in range(len(a) - 2))
        self.of = np.array([x for _, x in pieces], dtype=np.int64)
        self.start = np.searchsorted([c for c, _ in pieces], np.arange(38**3 + 1))

    def _coded(self, text: str) -> np.ndarray:
        return self.code[np.frombuffer(text.encode("ascii", "replace"), dtype=np.uint8)]

    @staticmethod
    def _pieces(c: np.ndarray) -> np.ndarray:
        return (c[:-2].astype(np.int64) * 38 + c[1:-1]) * 38 + c[2:]

    @staticmethod
    def _match(c: np.ndarray, alias: np.ndarray, d: np.ndarray, u: int, m: int) -> np.ndarray:
        """Of diagonals d, the lowest ones with a piece, whether enough of the alias matches on u + 1 diagonals with d among them."""
        n = len(alias)
        around = np.lib.stride_tricks.sliding_window_view(c, n + 2 * u)[d - u]
        two = [around[:, x : x + n] == alias for x in range(2 * u + 1)]
        two = [x[:, 1:] & x[:, :-1] for x in two]
        ok = np.logical_or.reduce(two).sum(1) >= m - (u + 1)  # most fail here
        left = np.flatnonzero(ok)
        one = [around[left, x : x + n] == alias for x in range(2 * u + 1)]
        two = [x[:, 1:] & x[:, :-1] for x in one]
        three = [x[:, 2:] & y[:, :-1] for x, y in zip(one, two)]
        fits = np.zeros(len(left), dtype=bool)
        for k in range(u + 1):
            fits |= np.logical_and.reduce([np.logical_or.reduce(xs[k : k + u + 1]).sum(1) >= m - less * (u + 1) for less, xs in enumerate((one, two, three))])
        ok[left] = fits
        return ok

    def spans(self, text: str) -> dict[int, list[str]]:
        """For each alias the stretches of the text that hold as many of its pieces, in about its order, as a near window does."""
        return self.all_spans([text])[0]

    def all_spans(self, texts: list[str]) -> list[dict[int, list[str]]]:
        out: list[dict[int, list[str]]] = [{} for _ in texts]
        gap = "_" * self.GAP
        first = np.cumsum([self.GAP] + [len(t) + self.GAP for t in texts])
        coded = self._coded(gap + gap.join(texts) + gap)
        pieces = self._pieces(coded)
        lo, n = self.start[pieces], self.start[pieces + 1] - self.start[pieces]
        at = np.flatnonzero(n)
        lo, n = lo[at], n[at]
        entry = self.of[np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())]
        place = entry & 0xFF  # a diagonal is where the alias would begin; it sorts before the place in the alias
        hits = np.sort((entry - place) | (np.repeat(at, n) - place) << 8 | place)
        bounds = np.searchsorted(hits, np.arange(len(self.aliases) + 1) << 48)
        for (alias, ks, needs), i, j in zip(self.aliases, bounds[:-1], bounds[1:]):
            if j - i < max(1, min(m - 2 * (u + 1) for u, m in needs)):
                continue
            line = (hits[i:j] >> 8) & 0xFFFFFFFFFF
            most, found = needs[-1][0], set()
            for u, m in needs:
                need = max(1, m - 2 * (u + 1))
                if need <= len(line):
                    h = np.flatnonzero(line[need - 1 :] - line[: len(line) - need + 1] <= u)
                    h = h[np.diff(line[h], prepend=-1) > 0]
                    for k in range(0, len(h), 4096):
                        part = h[k : k + 4096]
                        found |= set(part[self._match(coded, self._coded(alias), line[part], u, m)].tolist())
            ends: list[list[int]] = []
            for h in sorted(found):
                d = int(line[h])
                r = int(np.searchsorted(first, d + int(hits[i + h] & 0xFF), "right")) - 1
                a, z = max(0, d - int(first[r]) - most), d - int(first[r]) + len(alias) + 2 * most
                if ends and ends[-1][0] == r and a <= ends[-1][2]:
                    ends[-1][2] = z
                else:
                    ends.append([r, a, z])
            for r, a, z in ends:  # whole words, and what a window may begin or end with
                t = texts[r]
                part = t[t.rfind(" ", 0, a) + 1 : (e if (e := t.find(" ", min(z, len(t)))) >= 0 else len(t))]
                for k in ks:
                    out[r].setdefault(k, []).append(part)
        return out


#: Aliases by their first word; how many words more than a near window's go into what is searched again.
_STARTS: dict[str, list[tuple[int, str]]] = {}
for _k, (_, _a) in enumerate(ALIASES):
    _STARTS.setdefault(_a.split()[0], []).append((_k, f" {_a} "))
_JOINT = max(len(a.split()) for _, a in ALIASES) + 2
_LINE, _RUN, _FILLED = re.compile("[^\n\x0b\x0c\r\x85\u2028\u2029]+"), re.compile("[a-z0-9]+"), re.compile("[A-Za-z0-9&\u0130\u212a]")


def _normalize(x: str) -> str:
    """normalize_text."""
    return " ".join(_RUN.findall(x.lower().replace("&", " and ")))


def _tops(text: str) -> tuple[str, str, str]:
    """The first lines as one text, the top of the page, and its longer top."""
    firsts = islice((x for m in _LINE.finditer(text) if (x := m.group().strip(SPACE))), LINES)
    return _normalize(" ".join(firsts)), _normalize(text[:TOP]), _normalize(text[:AREA])


def _searched(first: str, top: str) -> list[str]:
    """Where near windows are looked for: the first lines and where their repetition joins them; of the top only windows that these don't have."""
    cut = top.rfind(" ") + 1
    if not f"{first} ".startswith(top[:cut]):
        rest = top
    else:
        rest = "" if f"{first} ".startswith(f"{top} ") else " ".join(top.split()[-_JOINT:])
    return [f"{first} {' '.join(first.split(' ', _JOINT)[:_JOINT])}", rest]


def _read(text: Column) -> Column:
    """What the beginning of a page says: ``headed`` and ``hits``, the numbers of the aliases in its heading, exact or near, and of all;
    ``kind``, the type that the heading names, and ``narrative``, whether it is one of prose; ``ignored`` phrases; ``filled`` and ``blank``."""

    @F.pandas_udf("struct<headed array<int>, hits array<int>, kind string, narrative boolean, ignored array<string>, filled boolean, blank boolean>")
    def run(texts: pd.Series) -> pd.DataFrame:
        bounds, ts, out = _Bounds(), texts.tolist(), []
        for i, j in blocks(ts):
            tops = [_tops(t) for t in ts[i:j]]
            spans = bounds.all_spans([x for first, top, _ in tops for x in _searched(first, top)])
            for t, (first, top, area), *parts in zip(ts[i:j], tops, spans[::2], spans[1::2]):
                words = {*first.split(), *top.split(), *area.split()}
                asked = [a for w in _STARTS.keys() & words for a in _STARTS[w]]
                block, heading, around = f" {first} {first} ", f" {top} ", f" {area} "
                headed = {k for k, a in asked if a in block or a in heading}
                for found in parts:
                    headed |= {k for k, xs in found.items() if k not in headed and any(_is_near(ALIASES[k][1], x) for x in xs)}
                hits = headed | {k for k, a in asked if a in around}
                kind = next((kind for kind, _, phrases in dims.PAGE_TYPES if any(p in area for p in phrases)), None)
                before = _normalize(t[:IGNORED_AREA])
                out.append((sorted(headed), sorted(hits), kind, any(p in area for p in dims.NARRATIVE_HEADINGS), [p for p in dims.IGNORED if p in before], _FILLED.search(t) is not None, not t.strip(SPACE)))
        return pd.DataFrame(out, columns=["headed", "hits", "kind", "narrative", "ignored", "filled", "blank"])

    return run(text)


def _found(r: Column) -> list[Column]:
    first = F.get(r["hits"], F.lit(0))
    of = lambda xs, k: F.get(F.array(*map(F.lit, xs)), k)
    names = F.array_distinct(F.transform(r["hits"], lambda k: of([a for _, a in ALIASES], k)))
    return [of([s for s, _ in ALIASES], first).alias("direct"), of([a for _, a in ALIASES], first).alias("alias"), F.coalesce(F.array_contains(r["headed"], first), F.lit(False)).alias("in_heading"), F.size(names).alias("aliases")]


def matched(pages: DataFrame) -> DataFrame:
    """``direct`` (the section whose alias comes first of those found), ``alias``, ``in_heading`` and ``aliases`` (how many there are)."""
    return pages.withColumn("read", _read(F.coalesce("text", F.lit("")))).select(*pages.columns, *_found(F.col("read")))


def confidence(kind: Column, prose: Column, table: Column, ignored: Column, base: Column) -> Column:
    """What the heading, the page's type and its densities say, within 0 and 1."""
    by_type = F.when(kind == "narrative", 0.18).when(kind == "unknown", -0.05).when(kind.isin(TERMINAL), -0.35).otherwise(0.0)
    score = base + by_type + F.least(F.lit(0.22), prose * 0.22) - F.least(F.lit(0.22), table * 0.22) - F.least(F.lit(0.25), ignored * 0.1)
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)), 3)


def _judged(pages: DataFrame, accepted: float) -> DataFrame:
    """What a page's own text says: its section, type and densities, its confidence if it opens a section (``own``) and if it goes on with one."""
    text = F.coalesce("text", F.lit(""))
    prose, tabular = densities(text)
    p = pages.select("*", _read(text).alias("read"), prose.alias("prose"), tabular.alias("tabular"))
    p = p.select(*pages.columns, "prose", "tabular", *_found(F.col("read")), "read.kind", "read.narrative", "read.ignored", "read.filled", "read.blank")
    by_text = F.coalesce(F.col("kind"), *[F.when(test, kind) for test, kind, _ in by_density(F.col("narrative"), F.col("prose"), F.col("tabular"))], F.lit("unknown"))
    p = p.withColumn("page_type", F.when(F.col("filled"), by_text).otherwise("unknown")).withColumn("terminal", F.col("page_type").isin(TERMINAL))
    score = lambda base: confidence(F.col("page_type"), F.col("prose"), F.col("tabular"), F.size("ignored"), base)
    p = p.withColumn("own", score(F.when(F.col("in_heading"), 0.78).when(F.col("direct").isNotNull(), 0.45).otherwise(0.0))).withColumn("going", score(F.lit(0.62)))
    return p.withColumn("opens", ~F.col("blank") & ~F.col("terminal") & F.col("direct").isNotNull() & (F.col("own") >= accepted))


def _reason(candidate: Column, sure_of: Column, accepted: float, *more: Column) -> Column:
    """Why a page has no section, or null."""
    return F.coalesce(
        F.when(F.col("blank"), "no_text"),
        F.when(F.col("terminal"), F.concat(F.lit("page_type_"), "page_type")),
        F.when(candidate.isNull() & (F.size("ignored") > 0), F.concat(F.lit("ignored_keywords:"), F.array_join("ignored", ","))),
        F.when(candidate.isNull(), "no_section_candidate"),
        F.when(sure_of < accepted, "low_confidence"),
        *more,
    )


def identify(pages: DataFrame, budget: int = BUDGET, sure: float = SURE, accepted: float = ACCEPTED) -> DataFrame:
    """The section of each page (report_id, page_number, text), or why it has none.

    A page with an alias opens a section; pages without one go on with the section of the page before while they are sure enough, more so
    beyond ``budget`` of them. Only the order within a report is needed: islands that open where a page is accepted and end where one is not.
    """
    fits = ~F.col("blank") & ~F.col("terminal")
    p = _judged(pages, accepted)
    w = Window.partitionBy("report_id").orderBy("page_number")
    p = p.withColumn("island", F.sum(F.col("opens").cast("int")).over(w))
    i = Window.partitionBy("report_id", "island").orderBy("page_number")
    p = p.withColumn("idx", F.row_number().over(i) - 1)
    ends = ~F.col("opens") & (~fits | F.col("direct").isNotNull() | (F.col("going") < accepted) | ((F.col("idx") > budget) & (F.col("going") < sure)))
    p = p.withColumn("ends", ends).withColumn("ended", F.sum(F.col("ends").cast("int")).over(i)).withColumn("current", F.first("direct").over(i))
    # the section of the page before, if it had one
    live = (F.col("island") > 0) & (F.col("ended") - F.col("ends").cast("int") == 0) & ~F.col("opens")
    p = p.withColumn("on", live & F.col("direct").isNull())
    candidate = F.coalesce("direct", F.when(F.col("on"), F.col("current")))
    sure_of = F.when(F.col("on"), F.col("going")).otherwise(F.col("own"))
    beyond = F.col("on") & (F.col("idx") > budget)
    reason = _reason(candidate, sure_of, accepted, F.when(beyond & (sure_of < sure), "continuation_budget_exceeded"))
    p = p.withColumn("rejection_reason", reason)
    return p.select(
        *pages.columns, "page_type", F.when(F.col("rejection_reason").isNull(), candidate).alias("section"), sure_of.alias("confidence"), "rejection_reason", F.col("in_heading").alias("heading_match"),
        F.col("direct").isNotNull().alias("alias_match"), F.col("on").alias("is_continuation"), F.when(F.col("on"), F.col("idx")).otherwise(0).cast("int").alias("continuation_index"), beyond.alias("budget_exceeded"), F.col("aliases").alias("alias_count"),
        F.col("prose").alias("narrative_density"), F.size("ignored").alias("ignored_count"),
    )


def report(found: DataFrame) -> DataFrame:
    """Sums of each report."""
    n = F.count_if
    return found.groupBy("report_id").agg(
        F.count("*").alias("total_pages"), n(F.col("section").isNotNull()).alias("accepted_pages"), n(F.col("section").isNull()).alias("rejected_pages"), n(F.col("rejection_reason") == "continuation_budget_exceeded").alias("continuation_resets"),
        n("budget_exceeded").alias("budget_exceeded"), n("heading_match").alias("heading_matches"), n("is_continuation").alias("continuations"), F.count_distinct("page_type").alias("page_types"),
    )


def fragmentation(text: Column) -> Column:
    """(ratio, singles): the share of heading lines that look like fragments, and how many have a single character."""
    # most lines have more letters than matter, which shows at their beginning
    letters = lambda l: F.when(F.regexp_like(l, F.lit("^(?:[^A-Za-z0-9]*[A-Za-z0-9]){4}")), 4).otherwise(F.length(F.regexp_replace(l, "[^A-Za-z0-9]+", "")))
    each = F.transform(heading_lines(text), lambda l: F.struct(l.alias("line"), letters(l).alias("letters")))
    short = lambda l: (F.length(l) <= 10) & (F.size(F.regexp_extract_all(l, F.lit("[A-Za-z0-9]+"), F.lit(0))) <= 2)
    broken = lambda x: (x["letters"] > 0) & ((x["letters"] <= 3) | short(x["line"]))
    ratio = lambda xs: F.when(F.size(xs) == 0, 0.0).otherwise(F.round(F.size(F.filter(xs, broken)) / F.size(xs), 3))
    return once(each, lambda xs: F.struct(ratio(xs).alias("ratio"), F.size(F.filter(xs, lambda x: x["letters"] == 1)).alias("singles")))


def diagnose(scans: DataFrame, *key: str) -> DataFrame:
    """Each scanned text judged as a page by itself, so nothing is shuffled: confidence, whether it is accepted, aliases, fragments."""
    d = _judged(scans, ACCEPTED).withColumn("reason", _reason(F.col("direct"), F.col("own"), ACCEPTED)).withColumn("f", fragmentation(F.coalesce("text", F.lit(""))))
    return d.select(*key, F.when(F.col("blank"), 0.0).otherwise(F.col("own")).alias("confidence"), (F.col("direct").isNotNull() & F.col("reason").isNull()).alias("accepted"), F.when(~F.col("blank"), F.col("reason")).alias("rejection_reason"), F.when(F.col("blank"), 0).otherwise(F.col("aliases")).alias("alias_matches"), F.col("f.ratio").alias("fragmentation"), F.col("f.singles").alias("single_characters"))
