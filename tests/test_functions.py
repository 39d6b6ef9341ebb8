"""Literal cases, and folds in plain Python beside the expressions."""

import random

import pytest
from pyspark.sql import functions as F

from tallyloom.functions import numbers, text
from tallyloom.operators import consolidate, grid, matching, narrative


def one(spark, expr, value):
    return spark.createDataFrame([(value,)], "x string").select(expr(F.col("x"))).first()[0]


@pytest.mark.parametrize(
    ("cell", "want"),
    [("(1,234)", -1234.0), ("-5", -5.0), ("12%", 12.0), ("Rs 3 million", 3e6), ("(1|2)", -12.0), ("5)", None), ("abc 5", None), ("nil", None), ("", None), (None, None), ("−7.5", -7.5)],
)
def test_extractor_amounts(spark, cell, want):
    assert one(spark, numbers.parse_amount, cell) == want


def test_validator_amounts(spark):
    parse = lambda x: numbers.parse_amount(x, percent_divides=True, repair=False)
    assert one(spark, parse, "12%") == 0.12
    assert one(spark, lambda x: numbers.parse_amount(x, 1000), "7") == 7000.0


@pytest.mark.parametrize(("name", "want"), [("A & B!", "a and b"), ("  Profit/(Loss) ", "profit loss"), ("", "")])
def test_normalize(spark, name, want):
    assert one(spark, text.normalize_text, name) == want


def test_title_case(spark):
    assert one(spark, text.title_case, "debt schedule's x") == "Debt Schedule'S X"


def fold_chunks(x, most, overlap):
    done, now = [], ""
    for p in (line.strip() for line in x.split("\n")):
        if not p:
            continue
        both = p if not now else now + "\n" + p
        if len(both) <= most:
            now = both
            continue
        if now:
            done.append(now)
        while len(p) > most:
            done.append(p[:most].strip())
            p = p[most - overlap :].strip()
        now = p
    return [*done, now] if now else done


def test_chunks_equal_a_fold(spark):
    r = random.Random(3)
    texts = ["\n".join("".join(r.choice("ab ") for _ in range(r.randint(0, 60))) for _ in range(r.randint(0, 6))) for _ in range(60)]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, x string").select("i", text.chunks(F.col("x"), 20, 5).alias("c")).collect()
    for row in got:
        assert row.c == fold_chunks(texts[row.i], 20, 5)


def test_greedy_assignment_equals_a_fold(spark):
    r = random.Random(5)
    rows = sorted({(p, r.randint(1, 3), r.randint(0, 3) / 4, r.randint(0, 4), r.randint(0, 4)) for p in range(20) for _ in range(12)})
    got = {(x.page_number, x.raw, x.cls) for x in matching.assign(spark.createDataFrame(rows, "page_number int, precedence int, score double, raw int, cls int")).collect()}
    want = set()
    for page in range(20):
        raws, clss = set(), set()
        for _, pre, score, raw, cls in sorted((x for x in rows if x[0] == page), key=lambda x: (x[1], -x[2], x[3], x[4])):
            if raw not in raws and cls not in clss:
                raws.add(raw)
                clss.add(cls)
                want.add((page, raw, cls))
    assert got == want


def test_section_continuation_equals_a_fold(spark):
    r = random.Random(9)
    rows = [(d, p, r.choice([None, None, "A", "B"]), r.random() < 0.6, r.random(), r.random() < 0.1, r.random() < 0.8) for d in range(30) for p in range(12)]
    got = {(x.report_id, x.page_number): x.section for x in narrative.continued(spark.createDataFrame(rows, "report_id int, page_number int, direct string, accepted boolean, confidence double, terminal boolean, fits boolean")).collect()}
    for d in range(30):
        now, left = None, 0
        for _, p, direct, accepted, sure, terminal, fits in (x for x in rows if x[0] == d):
            if direct is not None and accepted:
                now, left = direct, 0
            elif now is not None:
                left += 1
                if terminal or not fits or direct is not None or (left > 3 and sure < 0.85):
                    now = None
            assert got[d, p] == now


def test_spread_year_header(spark):
    rows = [(1, 0, i, j, c) for i, row in enumerate([["Metric", "2025 2024", ""], ["Revenue", "100", "80"]]) for j, c in enumerate(row)]
    got = grid.unpivot(spark.createDataFrame(rows, "page_number int, table_index int, row_index int, col_index int, cell string")).collect()
    assert sorted((r.metric, r.value_year, r.value) for r in got) == [("Revenue", 2024, 80.0), ("Revenue", 2025, 100.0)]


CANDIDATE = "metric string, value_year int, source_report_year int, page_number int, table_type string, original_metric string, confidence double, requires_review boolean, value long, input_key string"


def groups(spark, rows):
    return consolidate.final_groups(spark.createDataFrame([(*r, f"{i:04}") for i, r in enumerate(rows)], CANDIDATE)).collect()


def test_equity_of_the_balance_sheet_wins_over_a_ratio(spark):
    rows = [("equity", 2022, 2023, 1, "ratio_analysis", "Return on equity", 1.0, False, 12), ("equity", 2022, 2023, 2, "balance_sheet", "Total shareholders equity", 0.9, False, 5000)]
    (g,) = groups(spark, rows)
    assert (g.value, g.resolution_reason) == (5000, "auto_equity_balance_over_ratio_metric")


def test_tie_stays_unresolved(spark):
    rows = [("assets", 2024, 2024, 1, "balance_sheet", "Total assets", 1.0, False, v) for v in (5, 6)]
    (g,) = groups(spark, rows)
    assert (g.conflict_status, g.resolution_reason) == ("unresolved_conflict", "unresolved_equal_precedence_conflict")


def test_confidence_wins_over_recency(spark):
    rows = [("assets", 2023, 2024, 1, "balance_sheet", "Total assets", 0.8, False, 5), ("assets", 2023, 2023, 1, "balance_sheet", "Total assets", 1.0, False, 6)]
    (g,) = groups(spark, rows)
    assert (g.value, g.resolution_reason) == (6, "higher_normalization_confidence")


def test_liability_pair(spark):
    rows = [("current_portion_long_term_debt", 2024, 2024, 3, "balance_sheet", "Current portion", 1.0, False, v) for v in (-9, 9)]
    (g,) = groups(spark, rows)
    assert (g.value, g.resolution_reason) == (9, "auto_positive_balance_sheet_liability")


def test_texts_are_normalized_once(spark):
    """A filter's lambda that holds the text's expression computes it again for each phrase."""
    rows = spark.createDataFrame([(1, "Going   CONCERN & code of\tconduct", "a", 0.4), (2, "sold finance-cost 7", "a", 0.6), (3, "7 % of it", "a", 0.1), (4, None, "a", 0.1), (5, "$ 5", "a", 0.1)], "k int, takeaway string, area string, confidence double")
    g = narrative.governed(rows).select("k", "quantified", "patterns", "route")
    assert [tuple(r) for r in g.orderBy("k").collect()] == [(1, False, "going concern|code of conduct", "reject"), (2, True, "", "review"), (3, True, "", "review"), (4, False, "", "reject"), (5, True, "", "review")]
    plan = g._jdf.queryExecution().optimizedPlan().toString()
    assert "lambdafunction(Contains(lambda" in plan and "lambdafunction(Contains(trim" not in plan and "lambdafunction(Contains(lower" not in plan


def test_densities_of_a_batch_are_those_of_the_expressions(spark):
    rng = random.Random(3)
    bits = ["a", "We", "expect", " ", "  ", "   ", "\t", "1", "1999", "2024", "x2024", "2024x", "_2001", "\u00e92001", "2001\u00e9", "19 99", "\u00e9", "\u4e2d", "\u00a0", "\n", "\n", "\r\n", "\r", "\x0b", "\x0c", "\x85", "\u2028", "\u2029", "\U0001f600", "%,.", " of the plant in the north "]
    texts = ["", " ", "\n", "\t", "2024", " 2024 ", "19", "2", "a b c d e f", "a  b  c"] + ["".join(rng.choices(bits, k=rng.randint(1, 30))) for _ in range(2000)]
    plain = ["".join(rng.choices([b for b in bits if b.isascii()], k=rng.randint(1, 60))) for _ in range(1000)]
    d = spark.createDataFrame([(x,) for x in texts + plain], "x string")
    p, t = text.densities(F.col("x"))
    assert d.select("x", p.alias("p"), t.alias("t"), text.narrative_density(F.col("x")).alias("wp"), text.table_density(F.col("x")).alias("wt")).where("p <> wp OR t <> wt OR p IS NULL OR t IS NULL").collect() == []
    assert None not in text.count_lines(plain) and text.blocks(["ab", "", "c"], 2) == [(0, 1), (1, 3)]
