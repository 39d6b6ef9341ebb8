"""Facts of table grids (P3) with the whole label chain (L1 to L6) and all repairs of numbers (N4 to N8), and what each step changed.

A table's cells meet once, in one shuffle; everything else are expressions of a row and windows over a table's rows:

* cell by cell: what a cell is (year, note, rating, number, ...) and its amount, in generated code;
* row by row: an array of the cells, the label with the cells that go on with it, and the unit beside it;
* table by table: the row of years, the scale, whether labels depend on notes; then, for each row, the last header, section,
  unit and parent above it. What a header resets is older than the header.

Order is ``row_index`` and ``col_index``. Results for odd input: null cells are empty; tables without a year have rows and no
facts; repeated cells of one place count as two; extra columns are dropped. ``table_type`` may be missing or null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import parse_amount, scale, scale_exempt, table_scale, years
from ..functions.repair import repaired
from ..functions.text import has_phrase, no_value_cell, normalize_label, normalize_text, snake_key, strip
from ..plans import dims

TABLE = ["page_number", "table_index"]
ROW = [*TABLE, "row_index"]
#: L1: what ends a label, and adds to the confidence in it.
SURE_STOPS = ["year_column", "numeric_value", "note_number", "rating", "percentage_column"]


def _first(xs: Column) -> Column:
    return F.get(xs, F.lit(0))


def cell_kind(t: Column, amount: Column) -> Column:
    """Why a label doesn't go on into a cell; null if it does, or if the cell is blank."""
    return (
        F.when(t == "", None)
        .when(t.rlike(r"^(?:19|20)[0-9]{2}$"), "year_column")
        .when(t.rlike(r"^[+-]?[0-9]+(?:\.[0-9]+)?%$"), "percentage_column")
        .when(t.rlike(dims.NOTE_CELL), "note_number")
        .when(t.rlike(dims.RATING_CELL), "rating")
        .when(amount.isNotNull(), "numeric_value")
        .when(~t.rlike("[A-Za-z]"), "non_text_cell")
    )


def _cells(cells: DataFrame) -> DataFrame:
    """Each cell with all that later steps ask of it."""
    kept = [c for c in (*ROW, "col_index") if c in cells.columns]
    kind = F.col("table_type") if "table_type" in cells.columns else F.lit(None).cast("string")
    c = cells.select(*kept, kind.alias("table_type"), strip(F.coalesce("cell", F.lit(""))).alias("t"))
    c = c.withColumn("amount", parse_amount(F.col("t")))
    t, none = F.col("t"), F.col("amount").isNull()
    closed = parse_amount(F.concat(F.lit("("), t))
    found = F.regexp_extract_all("t", F.lit(r"\(?\s*[+-]?[0-9][0-9,]*(?:\.[0-9]+)?\s*\)?%?"), F.lit(0))
    # several numbers in a cell: read once, and only where there are several
    c = c.withColumn("tokens", F.when((t != "") & ~t.rlike("[A-Za-z]"), found))
    c = c.withColumn("merged", F.when(F.size("tokens") > 1, F.transform("tokens", lambda x: parse_amount(x))))
    c = c.withColumn("closed", F.when(none, closed))
    return c.select(
        *ROW,
        "table_type",
        F.col("col_index").alias("col"),
        "t",
        cell_kind(t, F.col("amount")).alias("kind"),
        "amount",
        scale(t).isNotNull().alias("own"),
        # A number that only closes a parenthesis, and what may open one in the two cells before
        F.when(F.col("closed") < 0, F.col("closed")).alias("closed"),
        (t.contains("(") & ~t.contains(")") & ~t.rlike("[0-9]")).alias("opens"),
        (t.startswith("(") & t.contains(")") & F.replace(t, F.lit(","), F.lit("")).rlike(r"\(\s*[|Il]\s*[+-]?[0-9]")).alias("noise"),
        no_value_cell(t).alias("aside"),
        (t.isin("%)", "%", "(%)") | (t.rlike(dims.HEADER_UNITS) & none)).alias("unit"),
        t.rlike("[A-Za-z]").alias("letters"),
        years(t).alias("years"),
        table_scale(t).alias("scale"),
        F.when(F.forall("merged", lambda v: v.isNotNull()), F.col("merged")).alias("parts"),
    )


def rows(cells: DataFrame) -> DataFrame:
    """A row for each row of each table: ``cells`` in order, the table's ``header_row``, ``years`` (col, year), ``scale`` and ``notes``."""
    inner = ["col", "t", "kind", "amount", "own", "closed", "opens", "noise", "aside", "unit", "letters", "years", "scale", "parts"]
    r = _cells(cells).repartition(*TABLE).groupBy(*ROW).agg(F.sort_array(F.collect_list(F.struct(*inner))).alias("cells"), F.max("table_type").alias("table_type"))
    # Year cells; before the first of them a cell of several years spreads over the columns from its own on
    single = F.filter("cells", lambda c: c["kind"] == "year_column")
    several = _first(F.filter("cells", lambda c: F.size(c["years"]) > 1))
    spread = F.when(several.isNotNull() & ((F.size(single) == 0) | (several["col"] < _first(single)["col"])), F.transform(several["years"], lambda y, k: F.struct((several["col"] + k).alias("col"), y.alias("year"))))
    plain = F.transform(single, lambda c: F.struct(c["col"].alias("col"), F.get(c["years"], F.lit(0)).alias("year")))
    more = F.filter(F.coalesce(spread, F.array().cast("array<struct<col:int,year:int>>")), lambda y: ~F.exists(plain, lambda p: p["col"] == y["col"]))
    r = r.withColumn("ys", F.sort_array(F.concat(plain, more)))
    said = normalize_text(F.array_join(F.transform("cells", lambda c: c["t"]), " "))
    r = r.withColumn("row_text", normalize_label(F.array_join(F.transform(F.filter("cells", lambda c: c["t"] != ""), lambda c: c["t"]), " ")))
    r = r.withColumn("row_scale", _first(F.filter("cells", lambda c: c["scale"].isNotNull()))["scale"]).withColumn("noted", said.rlike(dims.NOTE_HEADERS) | said.rlike(r"\bnotes?\b"))
    w = Window.partitionBy(*TABLE)
    best = F.max_by(F.struct("row_index", "ys"), F.struct(F.size("ys"), -F.col("row_index"))).over(w)
    r = r.withColumn("best", best).withColumn("scale", F.coalesce(F.min_by("row_scale", F.when(F.col("row_scale").isNotNull(), F.col("row_index"))).over(w), F.lit(1)).cast("long")).withColumn("any_note", F.max("noted").over(w))
    kind = snake_key(F.coalesce("table_type", F.lit("")))
    hinted = F.lit(False)
    for hint in dims.NOTE_TYPE_HINTS:
        hinted = hinted | kind.contains(hint)
    notes = ~kind.isin(dims.STATEMENT_TYPES) & (hinted | F.col("any_note"))
    years_of = F.col("best.ys")
    return r.select(*ROW, "table_type", "cells", "row_text", F.when(F.size(years_of) > 0, F.col("best.row_index")).alias("header_row"), years_of.alias("years"), "scale", notes.alias("notes"))


def labelled(r: DataFrame) -> DataFrame:
    """The label cell, ``reconstructed``, ``deglued``, ``completed``, and ``dropped``: why a row is no metric."""
    r = r.withColumn("label_cell", _first(F.filter("cells", lambda c: c["letters"] & (c["kind"].isNull() | (c["kind"] != "year_column")))))
    at, ycols = F.col("label_cell.col"), F.transform("years", lambda y: y["col"])
    r = r.withColumn("label_col", at).withColumn("original", F.col("label_cell.t")).withColumn("after", F.filter("cells", lambda c: c["col"] > at))
    stop = _first(F.filter("after", lambda c: c["kind"].isNotNull() | F.array_contains(ycols, c["col"])))
    r = r.withColumn("stop", stop).withColumn("stop_reason", F.when(F.col("stop").isNull(), "row_end").when(F.array_contains(ycols, F.col("stop.col")), "year_column").otherwise(F.col("stop.kind")))
    parts = F.concat(F.array("original"), F.transform(F.filter("after", lambda c: (c["t"] != "") & (F.col("stop").isNull() | (c["col"] < F.col("stop.col")))), lambda c: c["t"]))
    r = r.withColumn("label_parts", parts).withColumn("reconstructed", normalize_label(F.array_join("label_parts", " ")))
    n = F.size("label_parts")
    sure = 0.72 + F.when(F.col("stop_reason").isin(SURE_STOPS), 0.18).otherwise(0.0) + F.when(n.between(2, 5), 0.06).otherwise(0.0) - F.when(n > 7, 0.12).otherwise(0.0) + F.when(F.startswith(F.lower("reconstructed"), F.lower("original")), 0.03).otherwise(0.0)
    r = r.withColumn("label_confidence", F.when(F.col("reconstructed") == F.col("original"), 1.0).otherwise(F.round(F.least(sure, F.lit(0.99)), 2)))
    # the unit beside a label: the first unit cells after it, before years, notes and numbers
    end = _first(F.filter("after", lambda c: F.array_contains(ycols, c["col"]) | (c["kind"] == "note_number") | c["amount"].isNotNull() | ((c["t"] != "") & ~c["unit"] & ~c["letters"])))
    r = r.withColumn("end", end["col"]).withColumn("near", F.filter("after", lambda c: (c["t"] != "") & (F.col("end").isNull() | (c["col"] < F.col("end")))))
    r = r.withColumn("unit_from", _first(F.filter("near", lambda c: c["unit"]))["col"])
    r = r.withColumn("unit_to", _first(F.filter("near", lambda c: (c["col"] > F.col("unit_from")) & ~c["unit"]))["col"])
    unit = F.array_join(F.transform(F.filter("near", lambda c: (c["col"] >= F.col("unit_from")) & (F.col("unit_to").isNull() | (c["col"] < F.col("unit_to")))), lambda c: c["t"]), "")
    r = r.withColumn("unit", F.nullif(normalize_label(F.coalesce(unit, F.lit(""))), F.lit("")))
    r = r.withColumn("repair", repaired(F.col("reconstructed"), F.col("unit")))
    r = r.select("*", "repair.deglued", "repair.completed", "repair.reasons", "repair.with_unit").withColumn("dropped", F.when(F.col("original").isNotNull(), note_row_reason(F.col("completed"))))
    return r.withColumn("merged_cells", n).drop("label_cell", "stop", "end", "near", "unit_from", "unit_to", "repair", "label_parts")


def note_row_reason(label: Column) -> Column:
    """Why a label, an output of T6, is a note's mark and no metric; null if it is one."""
    plain = normalize_text(label)
    small = F.replace(plain, F.lit(" "), F.lit(""))
    words = F.filter(F.regexp_extract_all(F.lower(label), F.lit("[a-z]+"), F.lit(0)), lambda x: ~x.isin(dims.UNIT_FILLERS))
    unit = label.rlike(dims.UNIT_NAMED) & ~label.rlike(dims.DISCLOSED) & ~label.rlike(dims.SUBTOTALS) & (label.rlike(dims.UNIT_BEGINS) | ((F.size(words) > 0) & F.forall(words, lambda x: x.isin(dims.UNIT_WORDS))))
    return (
        F.when(label == "", "formatting_only_row")
        .when(plain.isin("note", "notes"), "note_header")
        .when(small.rlike("^[do]*do[do]*$"), "continuation_marker")
        .when(label.rlike(dims.NOTE_REFERENCE), "standalone_note_reference")
        .when(label.rlike(dims.CONTINUED), "continuation_marker")
        .when(label.rlike(r"^[\W_]+$"), "formatting_only_row")
        .when(unit, "unit_row")
    )


def _words(plain: Column) -> Column:
    return F.filter(F.split(plain, " "), lambda x: x != "")


def usable_context(label: Column, plain: Column, reason: Column) -> Column:
    """Whether a label may be put before the labels below it. ``plain`` is its normal form, ``reason`` its ``note_row_reason``."""
    n, short = F.size(_words(plain)), F.size(F.filter(_words(plain), lambda x: F.length(x) <= 2))
    bad = plain.startswith("for the year ended") | plain.startswith("particulars ") | plain.startswith("represent ") | plain.contains(" has been") | plain.contains("if any")
    bad = bad | (10 * short > 4 * n) | ((n > 8) & ~plain.rlike(dims.NOTE_HEADERS)) | (n > 14) | ((n == 1) & ~plain.isin(dims.LONE_CONTEXTS))
    return F.coalesce((label != "") & reason.isNull() & ~bad, F.lit(False))


def usable_header(label: Column, plain: Column) -> Column:
    """P9 for headers of columns and sections."""
    n, short = F.size(_words(plain)), F.size(F.filter(_words(plain), lambda x: F.length(x) <= 2))
    bad = plain.startswith("metric ") | plain.startswith("except ") | plain.startswith("excluding ") | plain.startswith("for the year ended") | plain.rlike(r"^(?:19|20)[0-9]{2}(?: (?:19|20)[0-9]{2})*$")
    bad = bad | (n == 0) | (n > 12) | ((n > 2) & (2 * short > n))
    return F.coalesce((label != "") & note_row_reason(label).isNull() & ~bad, F.lit(False))


def dependence(plain: Column) -> Column:
    """Why a label in normal form says little without what stands above it; null if it stands alone."""
    out = None
    for reason, pattern in dims.DEPENDENT:
        out = F.when(plain.rlike(pattern), reason) if out is None else out.when(plain.rlike(pattern), reason)
    return out


def _said(a: Column, b: Column) -> Column:
    """Whether a context would only repeat the label, or the other way round; both in normal form."""
    return (a == "") | (b == "") | has_phrase(b, a) | has_phrase(a, b)


def valued(r: DataFrame) -> DataFrame:
    """``found``, an array of (col, year, base, own, source, negative): direct values if every year has one, else those of a row moved
    by one or two columns, else, if there is no direct one, those of one cell that holds all, else the direct ones. ``base`` has no table scale."""

    def opened(c: Column) -> Column:
        return F.exists("cells", lambda o: o["opens"] & (o["col"] < c["col"]) & (o["col"] >= c["col"] - 2))

    def read(c: Column) -> Column:
        split = c["amount"].isNull() & opened(c)
        value = F.when(c["amount"].isNotNull(), c["amount"]).when(split, c["closed"])
        return F.struct(c["col"].alias("col"), value.alias("base"), c["own"].alias("own"), c["aside"].alias("aside"), ((c["noise"] & (c["amount"] < 0)) | (split & c["closed"].isNotNull())).alias("negative"))

    r = r.withColumn("numbers", F.filter(F.transform("cells", read), lambda n: n["base"].isNotNull()))

    def value(n: Column, year: Column, source: str | Column) -> Column:
        return F.struct(n["col"].alias("col"), year.alias("year"), n["base"].alias("base"), n["own"].alias("own"), (F.lit(source) if isinstance(source, str) else source).alias("source"), n["negative"].alias("negative"))

    of = F.transform("years", lambda y: F.struct(y["year"].alias("year"), _first(F.filter("numbers", lambda n: (n["col"] == y["col"]) & (n["col"] != F.col("label_col")))).alias("n")))
    direct = F.transform(F.filter(of, lambda y: y["n"].isNotNull()), lambda y: value(y["n"], y["year"], F.when(y["n"]["negative"], "reconstructed_negative").otherwise("direct")))
    r = r.withColumn("direct", direct).withColumn("loose", F.filter("numbers", lambda n: (n["col"] > F.col("label_col")) & ~n["aside"]))
    off = F.array_distinct(F.zip_with("loose", "years", lambda n, y: n["col"] - y["col"]))
    r = r.withColumn("off", F.when(F.size("loose") == F.size("years"), off))
    moved = (F.size("off") == 1) & F.abs(F.get("off", F.lit(0))).between(1, 2)
    shifted = F.transform(F.arrays_zip("loose", "years"), lambda z: value(z["loose"], z["years"]["year"], "shifted_row_repair"))
    whole = _first(F.filter("after", lambda c: F.size(c["parts"]) == F.size("years")))
    merged = F.transform(F.arrays_zip(whole["parts"].alias("p"), F.col("years").alias("y")), lambda z: F.struct(whole["col"].alias("col"), z["y"]["year"].alias("year"), z["p"].alias("base"), F.lit(False).alias("own"), F.lit("merged_numeric_cell_split").alias("source"), F.lit(False).alias("negative")))
    found = F.when(F.size("direct") == F.size("years"), F.col("direct")).when(F.coalesce(moved, F.lit(False)), shifted).when((F.size("direct") == 0) & whole.isNotNull(), merged).otherwise(F.col("direct"))
    ready = F.col("original").isNotNull() & (F.size("years") > 0) & (F.col("row_index") != F.col("header_row"))
    none = F.array().cast("array<struct<col:int,year:int,base:double,own:boolean,source:string,negative:boolean>>")
    r = r.withColumn("found", F.when(F.coalesce(ready, F.lit(False)), found).otherwise(none))
    return r.withColumn("n_values", F.size("found")).drop("numbers", "direct", "loose", "off", "after")


def inherited(r: DataFrame) -> DataFrame:
    """``noted`` (the label with its note's context) and ``metric`` (with its header's, where the note's changed nothing), with sources and reasons."""
    w = Window.partitionBy(*TABLE).orderBy("row_index").rowsBetween(Window.unboundedPreceding, -1)
    label, head = F.col("completed"), F.col("row_index") == F.col("header_row")
    alive = F.col("original").isNotNull() & F.col("dropped").isNull() & ~F.coalesce(head, F.lit(False))
    empty, full = alive & (F.col("n_values") == 0), alive & (F.col("n_values") > 0)
    # what a label is in normal form is asked some fifty times: it is a column, as are the other texts that are compared
    r = r.withColumn("plain", normalize_text(label)).withColumn("plain_size", F.size(_words(F.col("plain")))).withColumn("type_key", snake_key(F.coalesce("table_type", F.lit(""))))
    plain, kind = F.col("plain"), F.col("type_key")
    before = F.coalesce(F.col("row_index") < F.col("header_row"), F.lit(False))
    r = r.withColumn("why", dependence(plain)).withColumn("usable", usable_context(label, plain, F.col("dropped")))
    event = empty & F.col("notes") & F.col("usable") & F.col("why").isNull()
    begins = before | plain.rlike(dims.NOTE_HEADERS) | (kind.contains("note") & (F.col("plain_size") >= 7))
    at = F.struct("row_index", label.alias("label"))
    # headers of columns and sections; the row of years is one as a whole
    r = r.withColumn("named", F.when(head, F.col("row_text")).when(empty, label))
    r = r.withColumn("said", normalize_text(F.col("named")))
    r = r.withColumn("said_size", F.size(_words(F.col("said")))).withColumn("ok", usable_header(F.col("named"), F.col("said")))
    named, said, ok = F.col("named"), F.col("said"), F.col("ok")
    section = ok & (said.rlike(dims.HEADER_SECTIONS) | (kind.contains("ratio") & said.contains("ratio")))
    filled = F.size(F.filter("cells", lambda c: c["t"] != ""))
    header = ok & (before | said.rlike(dims.HEADER_NAMES) | section | ((filled <= 3) & F.col("said_size").between(2, 8)))
    unit = F.when(F.col("said_size") <= 6, F.when(named.rlike(dims.HEADER_UNITS), named)).otherwise(F.nullif(F.regexp_extract(named, dims.HEADER_UNITS, 0), F.lit("")))
    last = lambda x: F.last(x, ignorenulls=True).over(w)
    r = r.select(
        "*",
        last(F.when(event & begins, at)).alias("note"),
        last(F.when(event & ~begins, at)).alias("part"),
        last(F.when(event, F.col("row_index"))).alias("turn"),
        last(F.when(section, named)).alias("head_section"),
        last(F.when(header, named)).alias("head_name"),
        last(F.when(ok, unit)).alias("head_unit"),
        full.alias("full"),
    )
    part = F.when(F.col("note").isNull() | (F.col("part.row_index") > F.col("note.row_index")), F.col("part.label"))
    r = r.withColumn("part", part).withColumn("note", F.col("note.label"))
    small = F.col("plain_size")
    sensitive = (small > 0) & ~plain.isin(dims.STANDALONE) & ((small <= 4) | ((small <= 7) & plain.rlike(dims.NEEDS_CONTEXT)))
    r = r.withColumn("near_plain", normalize_text(F.coalesce("part", "note"))).withColumn("sensitive", sensitive)
    near, sensitive = F.col("near_plain"), F.col("sensitive")
    # a row whose label stands alone is a parent, unless it has itself been put below a section or note
    lone = F.col("full") & F.col("notes") & F.col("usable") & F.col("why").isNull() & ~F.coalesce(sensitive & near.isNotNull() & ~_said(plain, near), F.lit(False))
    r = r.withColumn("parent_at", last(F.when(lone, at)))
    parent = F.when(F.col("turn").isNull() | (F.col("parent_at.row_index") > F.col("turn")), F.col("parent_at.label"))
    r = r.withColumn("parent", parent)
    reason = F.coalesce("why", F.when(sensitive & F.coalesce("parent", "part", "note").isNotNull(), "note_context_label"))
    r = r.withColumn("note_reason", F.when(F.col("full") & F.col("notes"), reason))
    sources = {"parent_row": "parent", "section_header": "part", "note_header": "note"}
    orders = {"generic_note_label": ["parent_row", "section_header", "note_header"], "note_context_label": ["section_header", "note_header"], "total_label": ["section_header", "note_header"]}
    rest = ["section_header", "parent_row", "note_header"]

    def pick(order: list[str]) -> Column:
        return F.coalesce(*[F.when(F.col(sources[s]).isNotNull(), F.struct(F.lit(s).alias("source"), F.col(sources[s]).alias("label"))) for s in order])

    chosen = F.when(F.col("note_reason").isNull(), None)
    for name, order in orders.items():
        chosen = chosen.when(F.col("note_reason") == name, pick(order))
    r = r.withColumn("note_from", chosen.otherwise(pick(rest)))
    r = r.withColumn("from_plain", normalize_text(F.col("note_from.label"))).withColumn("note_from", F.when(~_said(plain, F.col("from_plain")), F.col("note_from")))
    r = r.withColumn("noted", F.when(F.col("note_from").isNotNull(), normalize_label(F.concat_ws(" - ", "note_from.label", label))).otherwise(label))
    # L6
    free = F.col("full") & (F.col("noted") == label)
    why = (
        F.when((plain == "") | label.rlike(r"\(\s*[0-9]+\s*%\)"), None)
        .when(label.rlike(dims.HEADER_CUT), "truncated_label_completion")
        .when(plain.startswith("current portion"), "section_context_inheritance")
        .when(F.replace(plain, F.lit(" "), F.lit("")) == "cashequivalents", "current_assets_excluding_cash_completion")
        .when(plain.contains("ordinary shares") & plain.contains("each"), "security_header_inheritance")
        .when(plain == "investment at cost", "table_header_inheritance")
        .when(label.rlike(dims.HEADER_DEPENDENT), "unit_context_inheritance")
    )
    r = r.withColumn("head_reason", F.when(free & (F.col("with_unit") != label), "unit_fragment_completion").when(free, why))
    r = r.withColumn("unit_plain", normalize_text(F.col("head_unit")))
    places = {"table_section_context": F.col("head_section"), "table_header_context": F.col("head_name"), "unit_context": F.when(usable_header(F.col("head_unit"), F.col("unit_plain")), F.col("head_unit"))}

    def place(order: list[str]) -> Column:
        return F.coalesce(*[F.when(places[s].isNotNull(), F.struct(F.lit(s).alias("source"), places[s].alias("label"))) for s in order])

    cash = F.col("head_reason") == "current_assets_excluding_cash_completion"
    r = r.withColumn(
        "head_from",
        F.when(F.col("head_reason") == "unit_fragment_completion", F.struct(F.lit("unit_context").alias("source"), F.col("unit").alias("label")))
        .when(F.col("head_reason").isNull(), None)
        .when(cash, place(["table_section_context", "table_header_context"]))
        .when(F.col("head_reason") == "security_header_inheritance", place(["table_header_context", "table_section_context", "unit_context"]))
        .otherwise(place(["table_section_context", "table_header_context", "unit_context"])),
    )
    r = r.withColumn("above_plain", normalize_text(F.col("head_from.label")))
    above = F.col("head_from.label")
    metric = (
        F.when(F.col("head_from").isNull(), F.col("noted"))
        .when(F.col("head_reason") == "unit_fragment_completion", F.col("with_unit"))
        .when(cash, F.when(has_phrase(F.col("above_plain"), F.lit("current assets excluding cash")), "Current assets excluding cash and cash equivalents").otherwise(label))
        .when(_said(plain, F.col("above_plain")), label)
        .otherwise(normalize_label(F.concat_ws(" - ", above, label)))
    )
    return r.withColumn("metric", metric).drop("plain", "plain_size", "type_key", "named", "said", "said_size", "ok", "near_plain", "sensitive", "from_plain", "unit_plain", "above_plain")


def chain(cells: DataFrame) -> DataFrame:
    """A row for each table row, with every stage of its label and its values as columns. One shuffle."""
    return inherited(valued(labelled(rows(cells))))


def facts(chained: DataFrame) -> DataFrame:
    """(page_number, table_index, row_index, metric, value_year, value, source, scale_exempt, scale_corrected, negative_recovered)."""
    f = chained.where("full").select(*ROW, "metric", "scale", ((F.col("scale") > 1) & scale_exempt(F.col("metric"), F.lit(""))).alias("exempt"), F.explode("found").alias("v"))
    value = F.col("v.base") * F.when(F.col("v.own") | F.col("exempt"), 1).otherwise(F.col("scale"))
    return f.select(*ROW, "metric", F.col("v.year").alias("value_year"), value.alias("value"), F.col("v.source").alias("source"), F.col("exempt").alias("scale_exempt"), (F.col("exempt") & ~F.col("v.own")).alias("scale_corrected"), F.col("v.negative").alias("negative_recovered"))


def quality(chained: DataFrame) -> DataFrame:
    """Counts and score of each table; sufficient if it has years, labels and values."""
    number = F.exists("cells", lambda c: c["amount"].isNotNull())
    g = chained.groupBy(*TABLE).agg(
        F.max(F.size("years")).alias("n_years"), F.count("original").cast("int").alias("n_labels"), F.coalesce(F.sum(F.when(F.col("full"), F.col("n_values"))), F.lit(0)).cast("int").alias("n_values"), F.max(number).alias("any_number"), F.max("table_type").alias("table_type")
    )
    g = g.withColumn("numeric_only", (F.col("n_labels") == 0) & F.col("any_number"))
    score = F.when(F.col("numeric_only"), 0.0).otherwise(20.0) + F.least(F.lit(25.0), 12.5 * F.col("n_years")) + F.least(F.lit(25.0), 2.0 * F.col("n_labels")) + F.least(F.lit(30.0), 2.0 * F.col("n_values"))
    sufficient = (F.col("n_years") > 0) & (F.col("n_labels") > 0) & (F.col("n_values") > 0)
    return g.select(*TABLE, "table_type", "n_years", "n_labels", "n_values", "numeric_only", F.round(F.greatest(F.lit(0.0), F.least(F.lit(100.0), score)), 2).alias("score"), sufficient.alias("sufficient"))


#: Which rows a step changed, and what it made of them.
_STEPS = {
    "label_reconstruction": (lambda: F.col("dropped").isNull() & (F.col("reconstructed") != F.col("original")), "original", "reconstructed", "stop_reason"),
    "label_degluing": (lambda: F.col("dropped").isNull() & (F.col("deglued") != F.col("reconstructed")), "reconstructed", "deglued", "'known_financial_word_join'"),
    "fragmentation_cleanup": (lambda: F.col("dropped").isNull() & (F.col("completed") != F.col("deglued")), "deglued", "completed", "array_join(reasons, ',')"),
    "note_row_filtering": (lambda: F.col("dropped").isNotNull(), "completed", "cast(null as string)", "dropped"),
    "note_context_inheritance": (lambda: F.col("full") & (F.col("noted") != F.col("completed")), "completed", "noted", "concat(note_from.source, ':', note_reason)"),
    "header_inheritance": (lambda: F.col("full") & (F.col("metric") != F.col("noted")), "noted", "metric", "concat(head_from.source, ':', head_reason)"),
}


def diagnostics(chained: DataFrame) -> DataFrame:
    """(step, page_number, table_index, row_index, before, after, reason, n_values) of every change that touches a value; one pass."""
    found = F.array(*[F.when(test(), F.struct(F.lit(name).alias("step"), F.expr(a).alias("before"), F.expr(b).alias("after"), F.expr(c).alias("reason"))) for name, (test, a, b, c) in _STEPS.items()])
    return chained.where("n_values > 0").select(*ROW, "n_values", F.explode(F.array_compact(found)).alias("x")).select("x.step", *ROW, "x.before", "x.after", "x.reason", "n_values")


def numeric_diagnostics(chained: DataFrame) -> DataFrame:
    """Repairs of numbers by table; labels count as they are before L5 and L6."""
    exempt = (F.col("scale") > 1) & scale_exempt(F.col("completed"), F.lit(""))
    repaired_row = F.exists("found", lambda v: v["source"].isin("shifted_row_repair", "merged_numeric_cell_split"))
    n = lambda test: F.coalesce(F.sum(F.size(F.filter("found", test))), F.lit(0))
    return chained.where("full").withColumn("exempt", exempt).groupBy(*TABLE).agg(
        n(lambda v: F.col("exempt")).alias("scale_exempt_values"),
        n(lambda v: F.col("exempt") & ~v["own"]).alias("scale_corrections_applied"),
        n(lambda v: v["negative"]).alias("negative_values_recovered"),
        F.count_if(repaired_row).alias("shifted_rows_repaired"),
        n(lambda v: v["source"].isin("shifted_row_repair", "merged_numeric_cell_split")).alias("values_recovered"),
    )


def analysis_pages(types: DataFrame) -> DataFrame:
    """Pages that have a primary statement with its vertical and horizontal analysis, and the statement's type.

    types: page_number, cls (order), table_type.
    """
    key = snake_key(F.col("table_type"))
    primary = F.when(key.isin(dims.ANALYSIS_PRIMARY), F.struct("cls", "table_type"))
    g = types.groupBy("page_number").agg(F.min(primary)["table_type"].alias("primary"), F.max(key == "vertical_analysis").alias("v"), F.max(key == "horizontal_analysis").alias("h"))
    return g.where("primary is not null and v and h").select("page_number", "primary")


def analysis_split(cells: DataFrame, types: DataFrame) -> DataFrame:
    """(page_number, table_index, row_index, split, logical_type) of the rows of tables that hold a statement and both of its analyses.

    The analyses begin at the first rows that name them beside two years or more, the spaces in their names not counting. A table is
    split only if it has a subtotal, both analyses begin at rows of their own below the first, and each of the three parts says something.
    """
    c = cells.join(analysis_pages(types), "page_number").withColumn("t", strip(F.coalesce("cell", F.lit(""))))
    r = c.groupBy(*ROW, "primary").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("col_index", "t"))), lambda x: x["t"]), " ").alias("text"))
    said = normalize_text(F.col("text"))
    small, dated = F.replace(said, F.lit(" "), F.lit("")), F.size(years(F.col("text"))) >= 2
    total = F.lit(False)
    for phrase in dims.ANALYSIS_SUBTOTALS:
        total = total | has_phrase(said, F.lit(phrase))
    w = Window.partitionBy(*TABLE)
    begin = lambda name: F.min(F.when(dated & small.contains(name), F.col("row_index"))).over(w)
    r = r.withColumn("v", begin("verticalanalysis")).withColumn("h", begin("horizontalanalysis")).withColumn("first", F.min("row_index").over(w)).withColumn("total", F.max(total).over(w))
    part = F.when(F.col("row_index") < F.least("v", "h"), 0).when(F.col("row_index") < F.greatest("v", "h"), 1).otherwise(2)
    r = r.where("total and v > first and h > first and v <> h").withColumn("split", part)
    r = r.withColumn("parts", F.size(F.collect_set(F.when(said != "", F.col("split"))).over(w)))
    kind = F.when(F.col("split") == 0, F.col("primary")).when((F.col("split") == 1) == (F.col("v") < F.col("h")), "vertical_analysis").otherwise("horizontal_analysis")
    return r.where("parts = 3").select(*ROW, "split", kind.alias("logical_type"))


def score_buckets(tables: DataFrame) -> DataFrame:
    """A5: how many tables have a score in each fifth, empty fifths too."""
    names = ["0-20", "20-40", "40-60", "60-80", "80-100"]
    at = F.least(F.lit(4), F.floor(F.col("score") / 20).cast("int"))
    return tables.agg(*[F.count_if(at == k).alias(n) for k, n in enumerate(names)]).select(F.explode(F.array(*[F.struct(F.lit(n).alias("bucket"), F.col(n).alias("n")) for n in names])).alias("x")).select("x.*")


def suspicious_metrics(facts: DataFrame, top: int = 20) -> DataFrame:
    """O1: groups of a metric, year, report and table type that repeat, contradict themselves or have no type, the most suspicious first."""
    g = facts.groupBy("metric", "value_year", "source_report_year", "table_type").agg(F.count("*").alias("n"), F.count_distinct("value").alias("n_values"))
    found = {"duplicate_metric_values": F.col("n") > 1, "conflicting_values": F.col("n_values") > 1, "unclassified_table_metric": snake_key(F.col("table_type")) == "unclassified"}
    points = F.when(F.col("n_values") > 1, 65).otherwise(0) + F.when(F.col("n") > 1, F.least(F.lit(25), 5 * (F.col("n") - 1))).otherwise(0) + F.when(found["unclassified_table_metric"], 20).otherwise(0) + F.when(F.col("n_values") > 2, F.least(F.lit(10), 2 * F.col("n_values"))).otherwise(0)
    reasons = F.array_join(F.array_compact(F.array(*[F.when(test, name) for name, test in found.items()])), ",")
    g = g.withColumn("reasons", reasons).where("reasons <> ''").withColumn("score", F.least(F.lit(100), points).cast("double"))
    return g.orderBy(F.desc("score"), "metric", "value_year", "table_type", "source_report_year").limit(top)


def quality_report(chained: DataFrame) -> DataFrame:
    """One row of counts over all tables, their steps and their repairs."""
    t, steps, numbers = quality(chained), diagnostics(chained), numeric_diagnostics(chained)
    tables = t.agg(F.count("*").alias("tables"), F.count_if(F.col("n_years") == 0).alias("missing_years"), F.count_if(F.col("n_labels") == 0).alias("missing_labels"), F.count_if("numeric_only").alias("numeric_only"), F.count_if(F.coalesce(F.col("table_type"), F.lit("unclassified")) == "unclassified").alias("unclassified"), F.coalesce(F.sum("n_values"), F.lit(0)).alias("metric_values"))
    changed = steps.agg(*[F.count_if(F.col("step") == s).alias(f"{s}_rows") for s in _STEPS], *[F.coalesce(F.sum(F.when(F.col("step") == s, F.col("n_values"))), F.lit(0)).alias(f"{s}_values") for s in _STEPS])
    repairs = numbers.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in numbers.columns if c not in TABLE])
    return tables.crossJoin(changed).crossJoin(repairs)  # three single rows
