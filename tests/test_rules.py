"""Literal cases of the rules whose queries run on made tables."""

import pytest
from pyspark.sql import functions as F

from tallyloom.functions import numbers, text
from tallyloom.operators import consolidate, grid, narrative


def test_table_quality(spark):
    rows = [["Item", "2031", "2030"], ["Fees", "71", "64"], ["Loans", "9", "12"]]
    cells = [(1, 0, i, j, c) for i, r in enumerate(rows) for j, c in enumerate(r)] + [(2, 0, i, j, str(10 * i + j)) for i in range(2) for j in range(2)] + [(3, 0, 0, 0, "")]
    got = {x.page_number: x for x in grid.quality(spark.createDataFrame(cells, "page_number int, table_index int, row_index int, col_index int, cell string")).collect()}
    # 10 + 10, two years, three labels, four values
    assert (got[1].n_years, got[1].n_labels, got[1].n_values, got[1].numeric_only, got[1].score) == (2, 3, 4, False, 59.0)
    assert (got[2].numeric_only, got[2].score) == (True, 0.0)
    assert (got[3].numeric_only, got[3].score) == (False, 20.0)


def test_page_types(spark):
    said = {
        "": ("unknown", 0.0),
        "Form of Proxy\nCorporate governance": ("proxy", 0.95),
        "Independent Auditor's Report": ("auditor_report", 0.95),
        "Audit Committee": ("governance", 0.85),
        "Statement of Cash Flows": ("financial_statement", 0.9),
        "Outlook\nThe company looks forward to a good year": ("narrative", 0.8),
        "1 2 3\n4 5 6": ("table_heavy", 0.8),
        "We had a good year in all markets": ("narrative", 0.65),
        "Hello": ("unknown", 0.35),
    }
    df = spark.createDataFrame(list(enumerate(said)), "id int, text string").select("id", narrative.page_type(F.col("text")).alias("t")).orderBy("id")
    assert [(x.t.page_type, x.t.confidence) for x in df.collect()] == list(said.values())


def test_scale_disagreements_by_pairs(spark):
    import random

    rnd = random.Random(3)
    rows = [("m", y, rnd.choice([-1, 1]) * int(10 ** rnd.uniform(0, 9))) for y in range(60) for _ in range(rnd.choice([1, 3, 6]))] + [("m", 99, 0), ("m", 98, 1000), ("m", 98, 950_000), ("m", 97, 1000), ("m", 97, 949_000)]
    got = {x.value_year: x.disagrees for x in consolidate.scale_disagreements(spark.createDataFrame(rows, "metric string, value_year int, value long")).collect()}
    for year in got:
        v = [abs(x) for _, y, x in rows if y == year and x]
        assert got[year] == any(abs(b / a - s) / s <= 0.05 for a in v for b in v for s in (1e3, 1e6, 1e9))


def test_labels_and_scales(spark):
    said = {"Curren t assets": "Curren t assets", "curren t  a ssets , net": "current assets, net", "Tax ( note 3 )": "Tax (note 3)"}
    df = spark.createDataFrame(list(enumerate(said)), "id int, x string").select("id", text.normalize_label(F.col("x")).alias("y"), numbers.scale_exempt(F.col("x"), F.lit("5")).alias("e")).orderBy("id")
    assert [x.y for x in df.collect()] == list(said.values())
    one = spark.range(1).select(numbers.effective_scale(F.lit("Earnings per shar e"), F.lit("4.2"), F.lit(1000)).alias("a"), numbers.effective_scale(F.lit("Revenue"), F.lit("4.2"), F.lit(1000)).alias("b")).first()
    assert (one.a, one.b) == (1, 1000)


@pytest.mark.parametrize("name", ["n7_shifted_rows", "v1_grid_observations"])
def test_amounts_like_years(spark, tmp_path, name):
    """Amounts of 1961 and 2040 are no years, whatever the operators make of such cells."""
    import duckdb

    import __spark_entry__ as entry

    kinds = ["LARGE", "MEDIUM", "SMALL", "ECONOMY", "PROMO"]
    spark.createDataFrame([(i, k, k) for i, k in enumerate(kinds)], "p_partkey long, p_type string, p_name string").write.parquet(f"{tmp_path}/part.parquet")
    lines = [(s, i, 1 + k, float([1961, 70000, 2040][(i + k + s) % 3]), "R" if (i + k) % 4 == 0 else "N", f"{1996 + k}-05-01") for s in (1, 2, 3) for i in range(5) for k in range(3)]
    spark.createDataFrame(lines, "l_suppkey long, l_partkey long, l_linenumber int, l_extendedprice double, l_returnflag string, d string").selectExpr("* except (d)", "cast(d as timestamp) as l_shipdate").write.parquet(f"{tmp_path}/lineitem.parquet")
    con = duckdb.connect()
    for t in ("part", "lineitem"):
        con.execute(f"create view {t} as select * from read_parquet('{tmp_path}/{t}.parquet/*.parquet')")
    got = entry.queries()[name](spark, str(tmp_path))
    result = con.execute(entry.oracle_sql()[name])
    columns = [x[0] for x in result.description]
    assert sorted(map(tuple, got.select(*columns).collect())) == sorted(result.fetchall())


def test_pages_are_read_once(spark):
    """The heading and the densities of a page are one expression each, however many types and densities ask for them."""
    rows = spark.createDataFrame([(1, "Outlook\nThe company looks forward to a good year"), (2, "1 2 3\n4 5 6"), (3, None), (4, "--")], "k int, text string")
    t = rows.select("k", narrative.page_type(F.col("text")).alias("t")).select("k", "t.page_type", "t.confidence")
    assert [tuple(r) for r in t.orderBy("k").collect()] == [(1, "narrative", 0.8), (2, "table_heavy", 0.8), (3, "unknown", 0.0), (4, "unknown", 0.0)]
    plan = t._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("1200") <= 2  # once for each field that is taken of the result


def test_label_scores_on_odd_labels(spark):
    import re

    from tallyloom.plans import dims

    labels = ["", "a", "a1b2c3", "a1b2c3d", "Cost of", "proof", "Cost of sales and", "Sand", "x from\r\n", "Gross (net", "Gross (net) of (", "Pro fit fro m", "Cash\tat bank", "Land", "and", "To", "(", "1 2", "é and", "a nd ra tio WITH", "cash \u00a0 bank"]
    got = {x.l: x for x in spark.createDataFrame([(x,) for x in labels], "l string").select("l", consolidate.cleanliness(F.col("l")).alias("c"), consolidate.cut_short(F.col("l")).alias("cut")).collect()}
    for x in labels:
        cut = bool(re.search(dims.CUT_SHORT, x) or re.search(dims.CUT_WORD.replace("$", r"(?:\r\n)?$"), x))
        assert got[x].cut == cut, x
        t = x.strip()
        cut = bool(re.search(dims.CUT_SHORT, t) or re.search(dims.CUT_WORD, t))
        score = 100 - 35 * bool(re.search(dims.FRAGMENTS, t.lower())) - 25 * cut - 15 * (len(re.sub("[^A-Za-z]", "", t)) < 4)
        assert got[x].c == (0 if t == "" else max(0, score + min(10, len(re.findall("[A-Za-z]+", t))))), x


def test_few_labels_of_many_rows_are_not_dealt_by_label(spark, monkeypatch):
    from tallyloom.operators import rules
    from tallyloom.plans import scratch

    rows = [(e, 2020, 1, 0, x, float(v), "statement_of_financial_position", k) for e in range(40) for k, (x, v) in enumerate([("Total assets", 9), ("Total liabilities", 4), ("Total equity", 5 + e % 2), ("Total assets", 7)])]
    facts = spark.createDataFrame(rows, "entity_id int, value_year int, page_number int, table_index int, label string, value double, table_type string, ordinal int")
    named = rules.named(facts)
    plan = named._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    monkeypatch.setattr(scratch, "TASK_ROWS", 10)
    found = rules.compared(named, rules.catalogue(spark))
    assert sorted((x.entity_id, x.rule_name, x.expected, x.actual) for x in found.collect()) == [(e, "accounting_equation", 10.0, 9.0) for e in range(1, 40, 2)]
    assert scratch.dealt(facts, "facts", "entity_id").rdd.getNumPartitions() == 16
    lost = rules.missing_metrics(named.where("entity_id = 3")).collect()
    assert sorted(x.expected_text for x in lost) == ["profit_after_tax", "revenue"]
