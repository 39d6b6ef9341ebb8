"""Boxes of crowded pages: the same rows as by pairs, without making them."""

import random

import pytest

from tallyloom.operators import matching

BOX = "page_number int, box_index int, x0 double, y0 double, x1 double, y1 double"


def _boxes(spark, seed, n=150):
    """Two pages; sizes from points to most of the page, copies, flat boxes, turned ones and a box without a place."""
    r = random.Random(seed)
    rows = []
    for i in range(n):
        x, y, w, h = r.randrange(0, 300, 5), r.randrange(0, 200, 9), r.choice([2, 20, 60, 66, 250]), r.choice([3, 40, 40, 150])
        rows.append((i % 2, i, float(x), float(y), float(x + w), float(y + h)))
    rows += [(0, n, 10.0, 10.0, 10.0, 50.0), (0, n + 1, 50.0, 10.0, 10.0, 50.0), (1, n + 2, None, 0.0, 5.0, 5.0), (2 + seed, n + 3, 0.0, 0.0, 1.0, 1.0)]
    return spark.createDataFrame(rows, BOX)


@pytest.mark.parametrize("least", [0.3, 0.8, 1.0])
def test_crowded_pages_have_the_same_pairs(spark, least):
    a, b = _boxes(spark, 1), _boxes(spark, 2)
    want = sorted(map(tuple, matching.overlaps(a, b, least, crowded=False).collect()))
    assert want and sorted(map(tuple, matching.overlaps(a, b, least).collect())) == want
    lonely = {(x.page_number, x.box_index) for x in a.collect()} - {x[:2] for x in want}
    assert sorted(map(tuple, matching.lonely(a, b, least).collect())) == sorted(lonely)


def test_cells_leave_few_pairs_to_try(spark):
    n = 400
    a, b = (spark.range(n).selectExpr("0 as page_number", f"cast(id as int) as {k}_box_index", f"id % 20 * 50.0D as {k}_x0", f"floor(id / 20) * 30.0D as {k}_y0", f"id % 20 * 50.0D + 60 as {k}_x1", f"floor(id / 20) * 30.0D + 40 as {k}_y1") for k in "lr")
    tried = sum(x.join(y, matching.CELL).count() for x, y, _ in matching._roles(a, b, 0.8))
    assert 2 * n <= tried < n * n / 20


def test_greedy_boxes_are_those_of_the_pairs(spark):
    from pyspark.sql import functions as F

    a, b = _boxes(spark, 3), _boxes(spark, 4)
    pairs = matching.overlaps(a, b, 0.3, crowded=False).withColumn("precedence", F.lit(2)).unionByName(matching.positional(a, b).withColumn("score", F.lit(0.0)).withColumn("precedence", F.lit(3)))
    order = ("page_number", "precedence", "raw", "cls", "score")
    want = sorted(map(tuple, matching.assign(pairs).select(*order).collect()))
    assert {x[1] for x in want} == {2, 3}
    assert sorted(map(tuple, matching.greedy_boxes(a, b, 0.3).select(*order).collect())) == want
    assert matching.greedy_boxes(a, b.where("page_number > 1"), 0.3).collect() == []
