import pytest
from conftest import DATA
from pyspark.sql import functions as F

from tallyloom.operators import labels
from tallyloom.plans.fixtures import fixture
from tallyloom.plans.runner import run_layers
from tallyloom.sources import readers, sinks
from tallyloom.streaming.upsert import consolidate_stream


def test_html_tables(spark):
    html = "<table><tr><th colspan=2>A</th><th>B</th></tr><tr><td rowspan=2>1</td><td>2</td></tr><tr><td>3</td><td>4</td></tr><tr><td></td></tr></table>"
    assert readers.table_grids(html) == [[["A", "A", "B"], ["1", "2", ""], ["1", "3", "4"]]]
    assert readers.html_cells(spark.createDataFrame([(1, html), (2, None)], "page_id long, html string")).count() == 9


def test_registry_collisions(spark):
    with pytest.raises(ValueError):
        readers.registry(spark, [("a", "A", ["x"]), ("b", "B", ["X"])])
    assert readers.registry(spark, [("a_b", "A B", ["x"])]).count() == 2


def test_detections_and_types(spark):
    boxes = readers.detections(spark.createDataFrame([(2025, 20, None, 0, [1.0], 0.95, "t"), (2025, 20, None, 1, [1.0], 0.5, "t")], readers.PROVIDERS["detected_tables"]))
    assert [x.detected_table_id for x in boxes.collect()] == ["2025:20:0"]
    types = spark.createDataFrame([(2025, 20, ["a", "b", "a"])], readers.PROVIDERS["page_table_types"])
    got = {x.table_type: x.detected_table_id for x in readers.zip_types(types, boxes).collect()}
    assert got == {"a": "2025:20:0", "b": None}


def test_name_parts(spark):
    x = readers.name_parts(spark.createDataFrame([("/a/Acme_Steel-2019_2024.pdf",)], "path string")).first()
    assert (x.year, x.company, x.slug) == (2024, "Acme Steel", "acme-steel")


def test_sinks(spark, tmp_path):
    d = spark.createDataFrame([("revenue", 2024, 5)], "metric string, source_report_year int, value int")
    sinks.context_json({"metric_values": d}, f"file://{tmp_path}/ctx")
    assert spark.read.json(f"file://{tmp_path}/ctx/metric_values").count() == 1
    assert sinks.sheets({"Income: Statement": d, "Empty": d.limit(0)}, f"file://{tmp_path}/x") == ["Income Statement"]
    assert sinks.audit(d, f"file://{tmp_path}/audit") and not sinks.audit(d, "nosuch://x/y")
    t = spark.createDataFrame([("s", 1, 1, "=A1"), ("s", 1, 2, "4")], "sheet string, row int, col int, value string")
    v = spark.createDataFrame([("s", 1, 1, "9"), ("s", 1, 2, "5"), ("s", 1, 3, "6")], "sheet string, row int, col int, new string")
    assert {(x.col, x.action) for x in sinks.cell_plan(t, v).collect()} == {(1, "keep_formula"), (2, "replace"), (3, "create")}


def test_labels(spark):
    cells = spark.createDataFrame([(1, 0, 0, j, c) for j, c in enumerate(["Operating", "Profit", "Note 4", "100"])], "page_number int, table_index int, row_index int, col_index int, cell string")
    x = labels.reconstruct(cells).first()
    assert (x.label, x.parts, x.stop_reason) == ("Operating Profit", 2, "note")
    d = labels.deglue(spark.createDataFrame([("Operati ons a nd pro fit",)], "label string")).first()
    assert d.repaired == "Operations and profit"
    f = labels.fuzzy(spark.createDataFrame([("chairmans reviw of the year",)], "label string"), ("chairmans review",)).first()
    assert f.phrase == "chairmans review" and f.ratio >= 0.86
    a = spark.createDataFrame([("total_assets", "total assets", 0), ("assets", "assets", 1)], "metric string, alias string, ordinal int")
    got = {r.label: r.metric for r in labels.canonical(spark.createDataFrame([("Total Assets (net)",), ("Assets",), ("My assets",)], "label string"), a).collect()}
    assert got == {"Total Assets (net)": "total_assets", "Assets": "assets", "My assets": None}


def test_note_context(spark):
    rows = [(1, 0, 0, "5 Property", False, True, False), (1, 0, 1, "Cost", False, False, False), (1, 0, 2, "Opening", True, False, True), (1, 0, 3, "6 Debt", False, True, False), (1, 0, 4, "Opening", True, False, True), (1, 0, 5, "Total", True, False, False)]
    got = labels.note_context(spark.createDataFrame(rows, "page_number int, table_index int, row_index int, label string, has_value boolean, header boolean, dependent boolean"))
    assert [x.inherited for x in got.orderBy("row_index").collect()] == ["5 Property", "Cost", "Cost - Opening", "6 Debt", "6 Debt - Opening", "Total"]


def test_failed_layer_does_not_stop_the_rest(spark):
    out = run_layers(spark, [("a", lambda s, t: {"x": s.range(3)}), ("b", lambda s, t: 1 / 0), ("c", lambda s, t: {"y": t["x"]})], {})
    assert out["y"].count() == 3 and [x.layer for x in out["pipeline_errors"].collect()] == ["b"]


def test_stream_equals_batch(spark, tmp_path):
    from tallyloom.operators.consolidate import best_value

    m = fixture(spark, DATA, "fx_metric_values")
    for k in range(2):
        m.where(F.col("page_number") % 2 == k).coalesce(1).write.parquet(f"file://{tmp_path}/in/{k}")
    stream = spark.readStream.schema(m.schema).option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/in/*")
    consolidate_stream(stream, f"file://{tmp_path}/out", f"file://{tmp_path}/cp").awaitTermination()
    last = spark.read.parquet(f"file://{tmp_path}/out/v=1")
    want = best_value(m).select("metric", "value_year", "value")
    assert sorted(map(tuple, last.select("metric", "value_year", "value").collect())) == sorted(map(tuple, want.collect()))
