"""Detected boxes, grids and classified types of a page, brought together."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Next best classes that a box keeps in greedy_boxes.
AHEAD = 64


def area(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    return F.greatest(F.lit(0.0), x1 - x0) * F.greatest(F.lit(0.0), y1 - y0)


SIDES = ("box_index", "x0", "y0", "x1", "y1")
#: Cells to a side of the mean region in which a smaller box's middle may lie.
CELLS = 2


def _named(boxes: DataFrame, k: str) -> DataFrame:
    """Boxes that cover something; no other ever matches."""
    covers = boxes.where("x1 > x0 and y1 > y0")
    return covers.select("page_number", *[F.col(c).alias(f"{k}_{c}") for c in SIDES])


def _size(k: str) -> Column:
    return area(*[F.col(f"{k}_{c}") for c in ("x0", "y0", "x1", "y1")])


def _score() -> Column:
    inter = area(F.greatest("l_x0", "r_x0"), F.greatest("l_y0", "r_y0"), F.least("l_x1", "r_x1"), F.least("l_y1", "r_y1"))
    return F.round(F.greatest(inter / (_size("l") + _size("r") - inter), inter / F.least(_size("l"), _size("r"))), 6)


def _placed(small: DataFrame, s: str, big: DataFrame, b: str, least: float) -> tuple[DataFrame, DataFrame]:
    """Both sides with a cell, cx and cy, such that a pair whose smaller box is of the first side shares one: the smaller box in the cell of its
    middle, the larger in all cells in which the middle of a box may lie that it covers by this share.

    A share of the area is no more than the share of each side. So the middle lies in the larger box, less (more, for shares below a half)
    the share beyond a half of the smaller box's side. Cells are half of a page's mean region (root mean square), so that a
    box has some 9 of them at the mean, whatever the sizes.
    """
    t = least - 1e-6  # scores are rounded
    out_small, out_big = small, big
    for d in "xy":
        out_small = out_small.withColumn(f"m{d}", (F.col(f"{s}_{d}0") + F.col(f"{s}_{d}1")) / 2).withColumn(f"g{d}", (0.5 - t) * (F.col(f"{s}_{d}1") - F.col(f"{s}_{d}0")))
    page = out_small.groupBy("page_number").agg(*[f(f"{c}{d}").alias(f"{n}{d}") for d in "xy" for f, c, n in ((F.max, "g", "grow"), (F.min, "m", "low"), (F.max, "m", "high"))])
    out_big = out_big.join(page, "page_number")
    for d in "xy":
        out_big = out_big.withColumn(f"from{d}", F.greatest(F.col(f"{b}_{d}0") - F.col(f"grow{d}"), F.col(f"low{d}"))).withColumn(f"to{d}", F.least(F.col(f"{b}_{d}1") + F.col(f"grow{d}"), F.col(f"high{d}")))
    out_big = out_big.where("fromx <= tox and fromy <= toy").select(*big.columns, "fromx", "tox", "fromy", "toy", "lowx", "lowy")
    edge = out_big.groupBy("page_number").agg(*[F.coalesce(F.nullif(F.sqrt(F.avg(F.pow(F.col(f"to{d}") - F.col(f"from{d}"), F.lit(2.0)))) / CELLS, F.lit(0.0)), F.lit(1.0)).alias(f"edge{d}") for d in "xy"], F.min("lowx").alias("lowx"), F.min("lowy").alias("lowy"))
    cell = lambda c, d: F.floor((c - F.col(f"low{d}")) / F.col(f"edge{d}"))
    out_small = out_small.join(edge, "page_number").select(*small.columns, *[cell(F.col(f"m{d}"), d).alias(f"c{d}") for d in "xy"])
    n = int(big.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    out_big = out_big.drop("lowx", "lowy").join(edge, "page_number").repartition(n)
    for d in "xy":
        out_big = out_big.withColumn(f"c{d}", F.explode(F.sequence(cell(F.col(f"from{d}"), d), cell(F.col(f"to{d}"), d))))
    return out_small, out_big.select(*big.columns, "cx", "cy")


CELL = ["page_number", "cx", "cy"]


def _roles(left: DataFrame, right: DataFrame, least: float) -> list[tuple[DataFrame, DataFrame, Column]]:
    """Pairs of which the left box is the smaller one (or as large), and those of which the right one is: (left, right, condition)."""
    l1, r1 = _placed(left, "l", right, "r", least)
    r2, l2 = _placed(right, "r", left, "l", least)
    # boxes are few bytes and many pairs: by their bytes Spark would join them in a few tasks
    n = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    l1, r1, r2, l2 = (d.repartition(n, *CELL) for d in (l1, r1, r2, l2))
    return [(l1, r1, _size("l") <= _size("r")), (l2, r2, _size("r") < _size("l"))]


def overlaps(left: DataFrame, right: DataFrame, least: float = 0.8, crowded: bool = True) -> DataFrame:
    """Boxes of one page with max(IoU, containment) of at least this (above 0). The keys are cells of a page, so that the pairs made are
    about in proportion to those that match, and a page with many boxes is no one task's. Where pages are not crowded the page is the key."""
    a, b = _named(left, "l"), _named(right, "r")
    if crowded:
        out = [x.join(y, CELL).where(smaller) for x, y, smaller in _roles(a, b, least)]
        both = out[0].unionByName(out[1])
    else:
        both = a.join(b, "page_number").where("l_x0 < r_x1 and r_x0 < l_x1 and l_y0 < r_y1 and r_y0 < l_y1")
    return both.withColumn("score", _score()).where(F.col("score") >= least).select("page_number", F.col("l_box_index").alias("raw"), F.col("r_box_index").alias("cls"), "score")


def lonely(left: DataFrame, right: DataFrame, least: float = 0.8) -> DataFrame:
    """(page_number, raw) of boxes that match none of the other side. Makes no pairs: equal boxes ask once, and a box is done at its first match."""
    place = ["page_number", "x0", "y0", "x1", "y1"]
    shapes = [d.select(*place).distinct().withColumn("box_index", F.lit(0)) for d in (left, right)]
    (l1, r1, smaller), (l2, r2, larger) = _roles(*(_named(d, k) for d, k in zip(shapes, "lr", strict=True)), least)
    key = ["page_number", *[f"l_{c}" for c in place[1:]]]
    found = []
    for a, b, which in ((l1, r1, smaller), (l2, r2, larger)):
        a, b = a.alias("a"), b.drop("r_box_index").alias("b")
        same = F.lit(True)
        for c in CELL:
            same = same & (F.col(f"a.{c}") == F.col(f"b.{c}"))
        found.append(a.join(b, same & which & (_score() >= least), "left_semi").select(*key))
    met = found[0].unionByName(found[1]).distinct().select("page_number", *[F.col(f"l_{c}").alias(c) for c in place[1:]])
    return left.join(met, place, "left_anti").select("page_number", F.col("box_index").alias("raw"))


def positional(left: DataFrame, right: DataFrame) -> DataFrame:
    """J4."""
    return left.select("page_number", F.col("box_index").alias("raw")).join(right.select("page_number", F.col("box_index").alias("raw"), F.col("box_index").alias("cls")), ["page_number", "raw"])


def assign(pairs: DataFrame) -> DataFrame:
    """Greedy 1:1 assignment on each page, by precedence, then score (descending), raw and class.

    pairs: page_number, precedence, score, raw, cls. A page's candidates are one array, folded with the sets of what is used.
    """
    c = F.sort_array(F.collect_list(F.struct("precedence", (-F.col("score")).alias("neg"), "raw", "cls")))
    pick = F.expr(
        "aggregate(c, cast(array() as array<struct<precedence: int, neg: double, raw: int, cls: int>>), (got, x) -> "
        "if(exists(got, g -> g.raw = x.raw or g.cls = x.cls), got, array_append(got, struct(x.precedence as precedence, x.neg as neg, x.raw as raw, x.cls as cls))))"
    )
    return pairs.groupBy("page_number").agg(c.alias("c")).select("page_number", F.explode(pick).alias("x")).select("page_number", "x.precedence", "x.raw", "x.cls", (-F.col("x.neg")).alias("score"))


def _greedy_page(raw: np.ndarray, a: np.ndarray, cls: np.ndarray, b: np.ndarray, least: float) -> Iterator[tuple[float, int, int]]:
    """The greedy assignment of a page's boxes (rows of a and b: x0, y0, x1, y1) in its order: (score, raw, class).

    A box's best score among the classes that are left only falls. So the heap holds a bound for each box, 1 at first, and a box looks at the
    classes only when its bound is the highest; it keeps its next best ones for when its best is taken. No pairs are held.
    """
    order = np.argsort(cls, kind="stable")
    cls, b = cls[order], b[order].T.copy()
    size = np.maximum(0.0, b[2] - b[0]) * np.maximum(0.0, b[3] - b[1])
    free, left = np.ones(len(cls), bool), len(cls)
    place: dict[int, list[int]] = {}
    for k, c in enumerate(cls.tolist()):
        place.setdefault(c, []).append(k)
    gone: set[int] = set()

    def best(x: np.ndarray) -> list[tuple[float, int]]:
        w = np.minimum(b[2], x[2]) - np.maximum(b[0], x[0])
        near = np.flatnonzero((w > 0) & free)
        h = np.minimum(b[3, near], x[3]) - np.maximum(b[1, near], x[1])
        near, inter = near[h > 0], (w[near] * h)[h > 0]
        own = max(0.0, x[2] - x[0]) * max(0.0, x[3] - x[1])
        score = np.floor(np.maximum(inter / (own + size[near] - inter), inter / np.minimum(own, size[near])) * 1e6 + 0.5) / 1e6
        good = score >= least
        near, score = near[good], score[good]
        if len(near) > AHEAD:
            # the score of the last kept one, and all above it; of those that have it the first classes
            last = np.partition(score, len(score) - AHEAD)[len(score) - AHEAD]
            above = score > last
            keep = np.union1d(np.flatnonzero(above), np.flatnonzero(score == last)[: AHEAD - int(above.sum())])
            near, score = near[keep], score[keep]
        top = np.lexsort((near, -score))
        return list(zip((-score[top]).tolist(), cls[near[top]].tolist(), strict=True))[::-1]

    heap = [(-1.0, r, -1, k) for k, r in enumerate(raw.tolist())]
    heapq.heapify(heap)
    ahead: dict[int, list[tuple[float, int]]] = {}
    used: set[int] = set()
    while heap:
        neg, r, c, k = heapq.heappop(heap)
        if r in used:
            ahead.pop(k, None)
            continue
        if c >= 0 and c not in gone:
            yield -neg, r, c
            used.add(r)
            gone.add(c)
            ahead.pop(k, None)
            free[place[c]] = False
            left -= len(place[c])
            if 2 * left < len(cls):  # what is taken needs no more looks
                cls, b, size = cls[free], b[:, free], size[free]
                free, place = np.ones(len(cls), bool), {}
                for j, x in enumerate(cls.tolist()):
                    place.setdefault(x, []).append(j)
            continue
        rest = ahead.get(k, [])
        while rest and rest[-1][1] in gone:
            rest.pop()
        if not rest:
            rest = best(a[k])
        if rest:
            ahead[k] = rest
            neg, c = rest.pop()
            heapq.heappush(heap, (neg, r, c, k))


def greedy_boxes(left: DataFrame, right: DataFrame, least: float) -> DataFrame:
    """J7 of boxes: what ``assign`` takes of ``overlaps`` by score (precedence 2) and then of equal indexes (precedence 3), without making the pairs.

    A page is a group, of which only the boxes are held. Order matters within a page only, and there each choice waits for those before.
    """

    schema = pa.schema([("page_number", pa.int32()), ("precedence", pa.int32()), ("score", pa.float64()), ("raw", pa.int32()), ("cls", pa.int32())])

    def page(key: tuple, boxes: pa.Table) -> pa.Table:
        both = []
        for side in (0, 1):
            t = boxes.filter((pa.compute.field("side") == side) & pa.compute.field("box_index").is_valid())
            every = t["box_index"].to_numpy()
            t = t.drop_null()
            box = np.column_stack([t[c].to_numpy() for c in SIDES[1:]]).astype(float)
            covers = (box[:, 2] > box[:, 0]) & (box[:, 3] > box[:, 1])
            both.append((every, t["box_index"].to_numpy()[covers], box[covers]))
        (every_raw, raw, a), (every_cls, cls, b) = both
        won = [(2, s, r, c) for s, r, c in _greedy_page(raw, a, cls, b, least)]
        free = set(every_raw.tolist()) - {x[2] for x in won}
        won += [(3, 0.0, i, i) for i in sorted(free & (set(every_cls.tolist()) - {x[3] for x in won}))]
        columns = list(zip(*won, strict=True)) or [[]] * 4
        return pa.table([[key[0].as_py()] * len(won), *columns], schema=schema)

    sides = [d.select("page_number", *SIDES, F.lit(k).alias("side")) for k, d in enumerate((left, right))]
    n = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # a page is long work of few bytes
    return sides[0].unionByName(sides[1]).repartition(n, "page_number").groupBy("page_number").applyInArrow(page, "page_number int, precedence int, score double, raw int, cls int")


def type_scores(pages: DataFrame, words: DataFrame) -> DataFrame:
    """How many of a type's words (word, table_type, weight) a page's text has. The words are a small dimension."""
    from ..functions.text import has_phrase, normalize_text

    p = pages.select("report_id", "page_number", normalize_text(F.col("text")).alias("t"))
    return p.join(F.broadcast(words), has_phrase(F.col("t"), F.col("word"))).groupBy("report_id", "page_number", "table_type").agg(F.sum("weight").cast("long").alias("score"))


def unmatched(left: DataFrame, found: DataFrame, key: list[str]) -> DataFrame:
    """J13."""
    return left.join(found, key, "left_anti")
