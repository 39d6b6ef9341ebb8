"""Literal cases of the extraction, the label repair, page assembly, sections, rules, registry and templates, and of odd rows."""

import random
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from tallyloom.functions import repair
from tallyloom.functions.text import found_in, normalize_text, strip
from tallyloom.operators import assembly, extract, registry, rules, sections, template, workbook
from tallyloom.operators.narrative import page_type
from tallyloom.plans import dims

CELLS = "page_number int, table_index int, row_index int, col_index int, cell string, table_type string"


def grid(rows, kind=None, page=1):
    return [(page, 0, i, j, c, kind) for i, r in enumerate(rows) for j, c in enumerate(r)]


@pytest.fixture(scope="module")
def chained(spark):
    rows = [
        ["Rupees in thousand", "Note", "2031", "2030"],
        ["Fees", "4", "71", "64"],
        ["Cost of sa les", "", "(45)", "(I50)"],
        ["Notes", "", "1", "2"],
        ["Earnings per share", "", "1.5", "2.5"],
        ["Trade", "receiva bles", "10", "20"],
        ["Movement in borrowings", "", "", ""],
        ["Opening balance", "5", "11", "12"],
        ["Closing balance", "", "", "(5)", "6"],
        ["Share of p rofit", "( ", "9)", "3"],
        ["Others", "8 9", "", ""],
        [None, "", "3", "4"],
    ]
    plain = [["Item", "2031"], ["Current portion of loan", "7"], ["Current liabilities", ""], ["Current portion of loan", "8 million"], ["Margin", "%", "9%"]]
    none = [["a", "b"], ["c", "1"]]
    cells = grid(rows, "notes") + grid(plain, "balance_sheet", 2) + grid(none, None, 3) + grid([["1", "2"], ["3", "4"]], None, 4)
    return extract.chain(spark.createDataFrame(cells, CELLS)).cache()


def test_facts(chained):
    got = {(r.page_number, r.row_index, r.value_year): (r.metric, r.value, r.source) for r in extract.facts(chained).collect()}
    move = "Movement in borrowings - "
    assert got == {
        (1, 1, 2031): ("Fees", 71000.0, "direct"),
        (1, 1, 2030): ("Fees", 64000.0, "direct"),
        (1, 2, 2031): ("Cost of sales", -45000.0, "direct"),
        (1, 2, 2030): ("Cost of sales", -50000.0, "reconstructed_negative"),
        (1, 4, 2031): ("Earnings per share", 1.5, "direct"),
        (1, 4, 2030): ("Earnings per share", 2.5, "direct"),
        (1, 5, 2031): ("Trade receivables", 10000.0, "direct"),
        (1, 5, 2030): ("Trade receivables", 20000.0, "direct"),
        (1, 7, 2031): (move + "Opening balance", 11000.0, "direct"),
        (1, 7, 2030): (move + "Opening balance", 12000.0, "direct"),
        (1, 8, 2031): (move + "Closing balance", -5000.0, "shifted_row_repair"),
        (1, 8, 2030): (move + "Closing balance", 6000.0, "shifted_row_repair"),
        (1, 9, 2031): (move + "Share of profit", -9000.0, "reconstructed_negative"),
        (1, 9, 2030): (move + "Share of profit", 3000.0, "direct"),
        (1, 10, 2031): (move + "Others", 8000.0, "merged_numeric_cell_split"),
        (1, 10, 2030): (move + "Others", 9000.0, "merged_numeric_cell_split"),
        (2, 1, 2031): ("Item 2031 - Current portion of loan", 7.0, "direct"),  # a short row of years is a header
        (2, 3, 2031): ("Current liabilities - Current portion of loan", 8000000.0, "direct"),
        (2, 4, 2031): ("Margin", 9.0, "shifted_row_repair"),  # what stands below a year is no unit
    }


def test_steps_and_quality(chained):
    steps = {(r.step, r.row_index): r.after for r in extract.diagnostics(chained).where("page_number = 1").collect()}
    assert steps["label_reconstruction", 5] == "Trade receivables" and steps["label_degluing", 9] == "Share of profit"
    assert steps["fragmentation_cleanup", 2] == "Cost of sales" and steps["note_row_filtering", 3] is None
    q = {r.page_number: r for r in extract.quality(chained).collect()}
    assert (q[3].n_years, q[3].n_values, q[3].sufficient) == (0, 0, False) and q[4].numeric_only and q[4].score == 0.0
    n = extract.numeric_diagnostics(chained).where("page_number = 1").first()
    assert (n.shifted_rows_repaired, n.values_recovered, n.scale_exempt_values) == (2, 4, 2)


def test_empty_tables(spark):
    empty = extract.chain(spark.createDataFrame([], CELLS))
    assert extract.facts(empty).count() == 0 and extract.diagnostics(empty).count() == 0
    assert extract.quality_report(empty).first().tables == 0


@pytest.mark.parametrize(
    ("label", "reason"),
    [("Notes", "note_header"), ("-do-", "continuation_marker"), ("Note 4.1", "standalone_note_reference"), ("Balance b/f", "continuation_marker"), ("(Rupees in '000)", "unit_row"), ("Amounts in PKR", "unit_row"), ("***", "formatting_only_row"), ("Number of persons in thousand", None), ("Total in rupees", None), ("Revenue", None)],
)
def test_rows_of_notes(spark, label, reason):
    assert spark.range(1).select(extract.note_row_reason(F.lit(label)).alias("x")).first().x == reason


def test_label_repair():
    said = {"Operating ex penses": "Operating expenses", "Cost of sa les": "Cost of sales", "CA SH and ba nk": "CASH and bank", "Net assets ( 100": "Net assets (100%)", "Earnings p er shar e": "Earnings per share", "": "", "A A": "A A"}
    for label, want in said.items():
        assert repair.complete(repair.deglue(label), None)[0] == want
    assert repair.complete("Gross margin (", "%)") == ("Gross margin (%)", ["unit_context_completion"])
    assert repair.with_unit("Ordinary shares", "o f Rs. 10 each") == "Ordinary shares of Rs. 10 each"
    assert repair.with_unit("Return in rupees", "Rs") == "Return in rupees"


def test_near_aliases_lose_nothing_to_the_bound():
    rng = random.Random(11)
    names = [a for _, a in sections.ALIASES if sections._may_be_near(a)]
    bounds, near = sections._Bounds(), 0
    for _ in range(3000):
        k = rng.choice([k for k, (_, a) in enumerate(sections.ALIASES) if a in names])
        alias = sections.ALIASES[k][1]
        w = list(alias)
        for _ in range(rng.randint(0, 4)):
            i = rng.randrange(len(w))
            w[i : i + 1] = rng.choice([[], [w[i], rng.choice("abe ")], [rng.choice("xyz")]])
        window = " ".join("".join(w).split())
        if SequenceMatcher(None, alias, window).ratio() >= sections.NEAR and abs(len(window.split()) - len(alias.split())) <= 1:
            near += 1
            text = "some words before " + window + " and after"
            assert k in bounds.spans(text) and any(sections._is_near(alias, part) for part in bounds.spans(text)[k])
    assert near > 500


def test_near_aliases_are_compared_only_where_they_may_be():
    bounds = sections._Bounds()
    names = sorted({a for _, a in sections.ALIASES if sections._may_be_near(a)})
    k = {a: i for i, (_, a) in reversed(list(enumerate(sections.ALIASES)))}
    mixed = " ".join(" ".join(reversed(a.split())) + " and of its own report on the risk" for a in names)
    for a in names:  # the pieces of an alias in another order are no reason to compare it, a slip is
        turned = " ".join(a[i : i + 4] for i in range(0, len(a), 4)[::-1])
        assert k[a] not in bounds.spans(f"the {turned} of it")
        slip = a[: len(a) // 2] + a[len(a) // 2 + 1 :]
        assert [sections._is_near(a, x) for x in bounds.all_spans(["", mixed, f"x {slip} y"])[2][k[a]]] == [True]
    assert sum(map(len, bounds.spans(mixed).values())) < 60


ODD = ["", " ", "\t\n \x0b\u3000", "Outlook", "OUTLOO\u212a & more\r\nS\u0130gns\x85Risk\u2028Manage ment\x0c2024", "a\nbc\n\n\n" * 9 + "Chairman's statement", "Md&a\rpage", "x" * 700 + "\nrisk factors", "y " * 249 + "risk factrs and more " + "z " * 300 + "outlook", "notes to the financial statements\nAuditor\nBusiness  Review", "Proxy form", "\u2029\u00e9\n\u00df 12"]


def test_page_beginnings_are_read_as_by_expressions(spark):
    d = spark.createDataFrame([(x,) for x in ODD], "text string")
    t, up_to = F.col("text"), lambda n: F.substr(F.col("text"), F.lit(1), F.lit(n))
    want = d.select(t, sections._first_lines(t), normalize_text(up_to(500)), normalize_text(up_to(1200)), strip(t) == "", F.lower(t).rlike("[a-z0-9&]"), found_in(normalize_text(up_to(900)), dims.IGNORED), page_type(t)["page_type"])
    got = {r.text: (r.blank, r.filled, r.ignored, r.page_type) for r in sections._judged(d, 0.55).collect()}
    for text, *rest in want.collect():
        assert [*sections._tops(text), *got[text]] == rest, text


def test_near_headings_are_found_at_joints_and_cuts():
    def all_near(first, top):
        return {a for _, a in sections.ALIASES if sections._may_be_near(a) and any(sections._is_near(a, x) for x in (f"{first} {first}", top))}

    bounds, rng = sections._Bounds(), random.Random(5)
    found = 0
    for _ in range(20):
        words = " ".join(rng.choice([a for _, a in sections.ALIASES] + ["plant", "the", "of"]) for _ in range(8)).split()
        first = " ".join(w[:1] + w[2:] if rng.random() < 0.2 else w for w in words)
        for top in (first[: rng.randrange(len(first))].strip(), first, "", "chairman " + first):
            spans = bounds.all_spans(sections._searched(first, top))
            got = {sections.ALIASES[k][1] for s in spans for k, xs in s.items() if any(sections._is_near(sections.ALIASES[k][1], x) for x in xs)}
            assert got == all_near(first, top)
            found += len(got)
    assert found > 80


def test_a_scan_is_judged_by_itself(spark):
    scans = spark.createDataFrame([(1, 1, "Outlook\n" + "We expect a good year in every market we serve now\n" * 3), (1, 2, "a\nB1\nab c\n\nWe expect a good year in every market we serve now"), (1, 2, None)], "r int, p int, text string")
    d = sections.diagnose(scans, "r", "p")
    assert "Exchange" not in d._jdf.queryExecution().executedPlan().toString()
    assert {tuple(x) for x in d.collect()} == {(1, 1, 1.0, True, None, 1, 0.25, 0), (1, 2, 0.0, False, None, 0, 0.0, 0), (1, 2, 0.0, False, "no_section_candidate", 0, 0.75, 1)}


def test_sections_of_odd_pages(spark):
    pages = [(1, 1, None), (1, 2, ""), (2, 1, "Outlook\n" + "We expect a good year in every market we serve now\n" * 3), (2, 2, "We also expect much of the new plant in the north\n" * 3), (3, 1, "Stratgc objctvs\nnothing")]
    got = {(r.report_id, r.page_number): (r.section, r.rejection_reason) for r in sections.identify(spark.createDataFrame(pages, "report_id int, page_number int, text string")).collect()}
    assert got == {(1, 1): (None, "no_text"), (1, 2): (None, "no_text"), (2, 1): ("Outlook", None), (2, 2): ("Outlook", None), (3, 1): (None, "no_section_candidate")}


def test_assembly_of_odd_pages(spark):
    side = "detected_id string, x0 double, y0 double, x1 double, y1 double"
    raw = spark.createDataFrame([(1, 0, "anything", 0, 0, 3, None, None, None, None, None), (2, 0, None, 0, 0, 1, "a", None, None, None, None), (2, 1, "net sales and revenue", 1, 3, 2, "a", None, None, None, None), (4, 0, "x", 0, 0, 0, None, None, None, None, None)], f"page_number int, raw int, text string, n_years int, n_labels int, n_values int, {side}")
    types = spark.createDataFrame([(1, 0, "notes", None, None, None, None, None, None), (2, 0, "notes", "a", None, None, None, None, None), (2, 1, "income_statement", None, 7, None, None, None, None), (3, 0, "notes", None, 0, None, None, None, None)], "page_number int, cls int, table_type string, detected_id string, page_table_index int, x0 double, y0 double, x1 double, y1 double")
    grids, left = assembly.assemble(raw, types)
    assert {(r.page_number, r.raw): (r.table_type, r.method) for r in grids.collect()} == {(1, 0): ("notes", "order"), (2, 0): ("notes", "detected_table_id"), (2, 1): ("income_statement", "fallback_text_similarity"), (4, 0): ("unclassified", None)}
    assert [(r.page_number, r.cls, r.covered) for r in left.collect()] == [(3, 0, False)]


def test_every_rule_fires_and_is_silent(spark):
    def books(wrong):
        out, k = [], 0
        values = {}
        for _, _, actual, terms in dims.SUM_RULES:
            for t in terms.split():
                values.setdefault(t[1:].split(":")[1], (float(10 + len(values)), t[1:].split(":")[0]))
        for name, _, actual, terms in dims.SUM_RULES:
            total = sum((1 if t[0] == "+" else -1) * values[t[1:].split(":")[1]][0] for t in terms.split())
            for t in terms.split():
                m = t[1:].split(":")[1]
                out.append((name, 2030, 1, 0, m.replace("_", " "), values[m][0], dims.SCOPES[t[1:].split(":")[0].split(",")[-1]][0], k))
                k += 1
            out.append((name, 2030, 1, 0, actual.split(":")[1].replace("_", " "), total + (50 if wrong else 0), dims.SCOPES[actual.split(":")[0].split(",")[0]][0], k))
            k += 1
        for name, _, actual, over, under in dims.RATIO_RULES:
            for x, v in ((actual, 9.0 if wrong else 2.5), (over, 5.0), (under, 2.0)):
                scope, m = x.split(":")
                out.append((name, 2030, 1, 0, m.replace("_", " "), v, dims.SCOPES[scope][0] if scope else "ratios", k))
                k += 1
        return spark.createDataFrame(out, "entity_id string, value_year int, page_number int, table_index int, label string, value double, table_type string, ordinal int")

    aliases = {m: [m.replace("_", " ")] for _, _, a, t in dims.SUM_RULES for m in [a.split(":")[1], *(x.split(":")[1] for x in t.split())]}
    names = {r[0] for r in (*dims.SUM_RULES, *dims.RATIO_RULES)}
    fired = rules.compared(rules.named(books(True), aliases), rules.catalogue(spark)).where("entity_id = rule_name").collect()
    assert {r.rule_name for r in fired} == names and len(names) == 20
    assert rules.compared(rules.named(books(False), aliases), rules.catalogue(spark)).where("entity_id = rule_name").count() == 0


def test_a_broken_group_is_an_issue(spark):
    facts = spark.createDataFrame([(1, 2030), (2, 2030)], "entity_id int, value_year int")

    def broken():
        return facts.select("no_such_column")

    got = rules.isolated(facts, {"broken": broken}).collect()
    assert [(r.rule_name, r.severity, r.expected_text) for r in got] == [("broken", "major", "validator completes")] * 2


def test_years_in_order(spark):
    cells = [(1, 2030, 1, 0, 0, 1, "2031"), (1, 2030, 1, 0, 0, 2, "2030"), (1, 2030, 1, 0, 1, 1, "2029 and 2031"), (1, 2030, 1, 0, 2, 1, "2029")]
    got = rules.unordered_years(spark.createDataFrame(cells, "entity_id int, value_year int, page_number int, table_index int, row_index int, col_index int, cell string")).collect()
    assert [(r.rule_name, r.actual_text) for r in got] == [("year_ordering", "2029, 2031")]


def test_nearest_in_blocks(spark):
    rng = random.Random(4)
    rows = [(i, [rng.uniform(-1, 1) for _ in range(6)]) for i in range(60)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    whole, cut = ({r.vec_id: (r.best, r.score) for r in workbook.nearest(df.where("vec_id >= 40"), df.where("vec_id < 40"), most).collect()} for most in (5000, 7))
    assert whole == cut and len(whole) == 20


def test_registry_without_labels(spark):
    terms = spark.createDataFrame([("revenue", 0, "revenue", 0), ("revenue", 1, "net sales", 1)], "key string, kind int, term string, ordinal int")
    got = {r.original_metric: (r.metric, r.confidence, r.requires_review) for r in registry.normalized(spark.createDataFrame([(None,), ("",), ("A - B",), ("Co - Net  Sales",)], "metric string"), terms).collect()}
    assert got == {None: (None, 0.0, True), "": ("", 0.0, True), "A - B": ("A - B", 0.0, True), "Co - Net  Sales": ("revenue", 0.96, False)}


def test_template_without_sheets(spark):
    values = spark.createDataFrame([("Notes", "revenue", 2030)], "sheet string, metric string, value_year int")
    none = spark.createDataFrame([], "sheet string, row int, col int, value string")
    got = template.verdicts(values, none).collect()
    assert [(r.score, r.action, r.missing_metrics) for r in got] == [(0.0, "create", "revenue")]
    assert template.overall(template.verdicts(values.limit(0), none)).first().mode == "dynamic"


def test_a_label_is_normalized_once(spark):
    """What stands above a label is found with one normal form of it, however many rules ask."""
    rows = [(1, 0, i, j, x, "notes_schedule") for i, r in enumerate([["Particulars", "2024", "2023"], ["Movement of borrowings", "", ""], ["Opening balance", "10", "20"], ["Others", "1", "2"]]) for j, x in enumerate(r)]
    chained = extract.chain(spark.createDataFrame(rows, "page_number int, table_index int, row_index int, col_index int, cell string, table_type string"))
    got = {x.row_index: x.metric for x in chained.where("full").collect()}
    assert got == {2: "Movement of borrowings - Opening balance", 3: "Movement of borrowings - Others"}
    plan = chained._jdf.queryExecution().optimizedPlan().toString()
    assert max(line.count("lower(completed") for line in plan.split("\n")) <= 2
