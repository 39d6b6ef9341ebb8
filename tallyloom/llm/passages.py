"""Fuzzy passages that repeat across documents, by collinear chaining of shared k-mer seeds.

Seeds are the k-word windows that winnowing picks: of every ``WINDOW`` windows in a row the one of the least hash, so
two documents that share ``K + WINDOW - 1`` words in a row share a seed. A seed's occurrences are joined to its first
one, in the least document, not to each other; so a passage in thousands of documents costs a row for each, and every
document but the first is linked to an earlier one. Where a document repeats a seed every few words, the first of these counts. Texts that are equal as a whole are one class and are seeded once.

For two documents, shared seeds on one diagonal are joined to segments, and segments are chained in
order in both texts: a chain's score is its words less ``GAP`` for each word that it leaves out in
either text. The best predecessor of each segment comes from a Fenwick tree of prefix maxima over the other
text's positions. Chains are then aligned on the texts, those of one seed only where no other chain has covered it: their ends are extended through edits
while enough words agree (x-drop, furthest-reaching paths), and the
gaps between segments are aligned word by word. A chain is kept if ``IDENTITY`` percent of its words agree; else it is cut
at its worst gap and its parts are tested, down to single segments.

A passage's seeds may have their first occurrences in different documents, so a chain may be a part of it: what
counts is the run of words that a document's chains cover together, ``LEAST`` words or more.

Results for odd input: null, empty and short texts have no passage; a null doc_id is left out; rows that repeat a doc_id with
the same text are one, with different texts they are told apart by the text and reported under their doc_id. Repeats
within one document are not passages across documents.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._util import SLICE_BYTES, Scratch, bounded_batches, slices, small
from ._words import SPACED, Words

K, WINDOW, LEAST, GAP, IDENTITY = 6, 3, 50, 0.1, 80
#: A seed that a document has again after so many words or fewer is left out.
APART = 50
#: Aligned chains of fewer words are left to chance: they don't count in runs. A chain of one seed is aligned like any other.
SHORTEST = 18
#: So many edits in a row, without a word that agrees, end the extension of a chain.
DROP = 6
#: Words of the texts that are first looked at before and after a chain; if its ends may lie further, the whole texts are.
AROUND = 24
#: Costs of an edit while extending, as parts of the one at which the identity breaks even: the widest ends that the identity allows are taken.
COSTS = (0.25, 0.5, 1.0)


def winnow(words: Words, k: int, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """hash, text and position (in words) of each seed."""
    hashes, at = words.windows(k)
    if not len(hashes):
        return hashes, at, at
    owner = np.searchsorted(words.first, at, side="right") - 1
    picked = []
    if len(hashes) >= window:
        view = np.lib.stride_tricks.sliding_window_view(hashes, window)
        inside = owner[: len(view)] == owner[window - 1 :]
        low = window - 1 - view[:, ::-1].argmin(axis=1) + np.arange(len(view))  # the last of equal ones
        picked.append(low[inside])
    first = np.searchsorted(owner, np.arange(len(words.first)))
    count = np.diff(first)
    for d in np.flatnonzero((count > 0) & (count < window)):
        picked.append(np.array([first[d] + int(hashes[first[d] : first[d + 1]].argmin())]))
    i = np.unique(np.concatenate(picked)) if picked else np.zeros(0, np.int64)
    return hashes[i], owner[i], at[i] - words.first[owner[i]]


def _seeds(k: int, window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            h, d, p = winnow(Words(batch.column(1), SPACED), k, window)
            yield pa.RecordBatch.from_arrays([pa.array((h >> np.uint64(16)).view(np.int64)), batch.column(0).take(pa.array(d)), pa.array(p.astype(np.int32))], names=["seed", "doc", "pos"])

    return run


def _anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From seeds in order of seed, doc and pos: each occurrence in another document than the first, with the first."""
    last = before = None  # the latest seed's first occurrence, and the row before
    for batch in batches:
        if not batch.num_rows:
            continue
        seed, doc, pos = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
        new = np.ones(len(seed), bool)
        new[1:] = seed[1:] != seed[:-1]
        first = np.maximum.accumulate(np.where(new, np.arange(len(seed)), 0))
        y, py = doc[first], pos[first]
        if last is not None and last[0] == seed[0]:
            head = first == 0
            y, py = np.where(head, last[1], y), np.where(head, last[2], py)
        last = seed[-1], y[-1], py[-1]
        # text that repeats itself is met once in a stretch, not at every turn
        again = np.zeros(len(seed), bool)
        again[1:] = (seed[1:] == seed[:-1]) & (doc[1:] == doc[:-1]) & (pos[1:] - pos[:-1] <= APART)
        again[0] = before is not None and before[:2] == (seed[0], doc[0]) and pos[0] - before[2] <= APART
        before = seed[-1], doc[-1], pos[-1]
        i = np.flatnonzero((doc != y) & ~again)
        yield pa.RecordBatch.from_arrays([pa.array(doc[i]), pa.array(y[i]), pa.array(pos[i]), pa.array(py[i])], names=["x", "y", "px", "py"])


def segments(px: np.ndarray, py: np.ndarray, k: int) -> list[tuple[int, int, int]]:
    """(start in x, start in y, words) of runs of seeds on a diagonal that leave no word out."""
    order = np.lexsort((px, px - py))
    px, py = px[order], py[order]
    new = np.ones(len(px), bool)
    new[1:] = (px[1:] - py[1:] != px[:-1] - py[:-1]) | (px[1:] - px[:-1] > k)
    start = np.flatnonzero(new)
    end = np.append(start[1:], len(px)) - 1
    return sorted(zip(px[start].tolist(), py[start].tolist(), (px[end] - px[start] + k).tolist(), strict=True))


class Fenwick:
    """Prefix maxima of (value, item)."""

    def __init__(self, n: int):
        self.tree: list[tuple[float, int]] = [(float("-inf"), -1)] * (n + 1)

    def raise_to(self, i: int, value: tuple[float, int]) -> None:
        i += 1
        while i < len(self.tree):
            if self.tree[i] < value:
                self.tree[i] = value
            i += i & -i

    def best(self, n: int) -> tuple[float, int]:
        """Of the first n."""
        out = (float("-inf"), -1)
        while n:
            out = max(out, self.tree[n])
            n -= n & -n
        return out


def chains(segs: list[tuple[int, int, int]], gap: float, k: int = K) -> list[list[tuple[int, int, int]]]:
    """Disjoint chains, best first. Segments may overlap by less than a seed where an edit moved the diagonal."""
    slack = k - 1
    ends = sorted({y + n for _, y, n in segs})
    tree, score, back = Fenwick(len(ends)), [0.0] * len(segs), [-1] * len(segs)
    by_end = sorted(range(len(segs)), key=lambda i: segs[i][0] + segs[i][2])
    done = 0
    for i, (x, y, n) in enumerate(segs):
        while done < len(by_end) and (j := by_end[done], segs[j][0] + segs[j][2] <= x + min(slack, n - 1))[1]:
            if j < i:
                xe, ye = segs[j][0] + segs[j][2], segs[j][1] + segs[j][2]
                tree.raise_to(bisect_left(ends, ye), (score[j] + gap * (xe + ye), j))
            done += 1
        value, j = tree.best(bisect_right(ends, y + min(slack, n - 1)))
        gain = value - gap * (x + y)
        score[i], back[i] = (n + gain, j) if j >= 0 and gain > 0 else (float(n), -1)
    used, out = set(), []
    for i in sorted(range(len(segs)), key=lambda i: (-score[i], i)):
        chain = []
        while i >= 0 and i not in used:
            used.add(i)
            chain.append(segs[i])
            i = back[i]
        if chain:
            out.append(chain[::-1])
    return out


def _chained(k: int, gap: float):
    def flush(x: int, y: int, px: np.ndarray, py: np.ndarray) -> list[tuple]:
        if len(px) == 1:
            return [(x, y, 0, [int(px[0]), int(py[0]), k])]
        return [(x, y, n, [a for s in chain for a in s]) for n, chain in enumerate(chains(segments(px, py, k), gap, k))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for batch in batches:
            cols = np.column_stack([batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(4)])
            rows = np.concatenate([*held, cols]) if held else cols
            if not len(rows):
                continue
            edges = np.flatnonzero((rows[1:, :2] != rows[:-1, :2]).any(axis=1)) + 1
            held = [rows[edges[-1] :]] if len(edges) else [rows]
            out = []
            for part in np.split(rows[: edges[-1]], edges[:-1]) if len(edges) else []:
                out += flush(int(part[0, 0]), int(part[0, 1]), part[:, 2], part[:, 3])
            yield _rows(out)
        if held and len(held[0]):
            last = held[0]
            yield _rows(flush(int(last[0, 0]), int(last[0, 1]), last[:, 2], last[:, 3]))

    def _rows(out: list[tuple]) -> pa.RecordBatch:
        cols = list(zip(*out, strict=True)) if out else [[]] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int32())), strict=True)], names=["x", "y", "n", "chain"])

    return run


def _common(a: list[int], b: list[int]) -> int:
    """Length of the longest common subsequence, a bit for each word of a, so that gaps of any size are aligned."""
    at: dict[int, int] = {}
    for i, u in enumerate(a):
        at[u] = at.get(u, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for v in b:
        if same := row & at.get(v, 0):
            row = (row + same | row - same) & full
    return len(a) - row.bit_count()


def _extended(wx: list[int], wy: list[int], edit: float) -> tuple[list[tuple[int, int, int]], bool, bool]:
    """Words of x and of y from their starts on, and how many agree, up to an end for each of ``COSTS``, from the widest on.

    Of each count of edits the furthest pair on each diagonal is kept while its score (words that agree, less
    the least cost of its edits) is within ``DROP`` edits of the best; an end has the best score at its cost.
    Also whether the end of x and of y was reached on the way.
    """
    best, nx, ny = [(0.0, 0, 0, 0)] * len(COSTS), len(wx), len(wy)
    reached_x = reached_y = False
    front, edits = {0: (0, 0)}, 0  # by diagonal x - y: words of x, how many agree
    while front:
        alive = {}
        for k, (i, agree) in front.items():
            j, start = i - k, i
            while i < nx and j < ny and wx[i] == wy[j]:
                i, j = i + 1, j + 1
            agree += i - start
            alive[k] = i, agree
            reached_x, reached_y = reached_x or i == nx, reached_y or j == ny
            if i > start:
                best = [max(z, (agree - edits * edit * c, -i, j, agree)) for z, c in zip(best, COSTS, strict=True)]
        front = {}
        for k, (i, agree) in alive.items():
            if agree - edits * edit * COSTS[0] < best[0][0] - DROP * edit * COSTS[0]:
                continue
            for d, n in ((0, 1), (1, 1), (-1, 0)):  # another word, one more in x, one more in y
                if i + n <= nx and i + n - k - d <= ny:
                    front[k + d] = max(front.get(k + d, (-1, 0)), (i + n, agree))
        edits += 1
    return [(-z[1], z[2], z[3]) for z in best], reached_x, reached_y


def align(chain: list[tuple[int, int, int]], wx: np.ndarray, wy: np.ndarray, identity: int, open_: tuple[bool, bool, bool, bool] = (False,) * 4) -> list[tuple[int, int, int, int, int]] | None:
    """Start and end in x and in y, and how many words agree, of the chain or of its parts.

    A chain of which too few words agree is cut at the gap where most differ, and its parts are tested again.
    None if the words are a part of their texts and an extension comes to its end: ``open_`` tells whether more lies
    before x and y and after them.
    """
    pieces: list[tuple[int, int, int, int]] = []  # x, y, words, how many agree
    gaps: list[tuple[int, int]] = []  # before each piece but the first: how many words differ and agree
    for sx, sy, n in chain:
        if pieces:
            px, py, pn, _ = pieces[-1]
            skip = max(px + pn - sx, py + pn - sy, 0)  # the part before is another segment's
            if skip >= n:
                continue
            sx, sy, n = sx + skip, sy + skip, n - skip
            common = _common(wx[px + pn : sx].tolist(), wy[py + pn : sy].tolist())
            gaps.append((max(sx - px - pn, sy - py - pn) - common, common))
        pieces.append((sx, sy, n, int((wx[sx : sx + n] == wy[sy : sy + n]).sum())))
    edit, lx, ly = identity / max(100 - identity, 0.01), wx.tolist(), wy.tolist()
    out, left = [], [(0, len(pieces))]
    while left:
        a, b = left.pop()
        (x, y, _, _), (xe, ye, n, _) = pieces[a], pieces[b - 1]
        xe, ye = xe + n, ye + n
        agree = sum(p[3] for p in pieces[a:b]) + sum(c for _, c in gaps[a : b - 1])
        # words agree beyond the identity in the narrow ends, so these lower no chain below it
        before, after = _extended(lx[:x][::-1], ly[:y][::-1], edit), _extended(lx[xe:], ly[ye:], edit)
        if any(o and r for o, r in zip(open_, (*before[1:], *after[1:]), strict=True)):
            return None
        for less, more in zip(before[0], after[0], strict=True):
            got = x - less[0], xe + more[0], y - less[1], ye + more[1], agree + less[2] + more[2]
            if passed := 100 * got[4] >= identity * max(got[1] - got[0], got[3] - got[2]):
                out.append(got)
                break
        if passed:
            continue
        if b - a > 1:
            cut = max(range(a, b - 1), key=lambda i: gaps[i][0]) + 1
            left += [(cut, b), (a, cut)]
    return out


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From texts, each followed by the word ranges asked of it: the ranges' texts, where they begin, and whether more lies before and after."""

    def rows(batch: pa.RecordBatch, out: list[tuple], keep: list[int]) -> pa.RecordBatch:
        got = list(zip(*out, strict=True)) if out else [[]] * 4
        rest = batch.select([1, 3, 4, 5, 6]).take(pa.array(keep, pa.int64()))
        return pa.RecordBatch.from_arrays([*rest.columns, *(pa.array(v, t) for v, t in zip(got, (pa.string(), pa.int32(), pa.bool_(), pa.bool_()), strict=True))], names=["kind", "x", "y", "n", "chain", "part", "at", "less", "more"])

    doc, held = None, []
    for batch in slices(batches, "text"):
        words, out, keep, size = Words(batch.column(2), SPACED), [], [], 0
        docs, kinds, low, high = (batch.column(i).to_pylist() for i in (0, 1, 7, 8))
        for i, kind in enumerate(kinds):
            if docs[i] != doc:
                doc, held = docs[i], []
            if not kind:
                held.append((words, int(words.first[i]), int(words.first[i + 1])))
                continue
            for w, first, last in held:
                a, b = max(first, first + low[i]), min(last, first + high[i])
                if a < b:
                    out.append((w.buf[w.starts[a] : w.ends[b - 1]].tobytes().decode(), a - first, a > first, b < last))
                    keep.append(i)
                    size += len(out[-1][0])
                    if size > SLICE_BYTES:
                        yield rows(batch, out, keep)
                        out, keep, size = [], [], 0
        yield rows(batch, out, keep)


def _aligned(k: int, identity: int):
    names = ["x", "y", "n", "start", "end", "other_start", "other_end", "agree"]
    # a chain of SHORTEST words has so many that agree, and so has a seed whose extension goes on for AROUND words
    cost = COSTS[0] * identity / max(100 - identity, 0.01)
    needed = min(identity * SHORTEST / 100, k + (AROUND - DROP) / (1 + 1 / cost))

    def flush(key: tuple, chain: list[int], xs: set, ys: set) -> list[tuple]:
        out = []
        for ta, at, al, am in sorted(xs):
            for tb, bt, bl, bm in sorted(ys):
                wx, wy = np.frombuffer(ta, np.uint64), np.frombuffer(tb, np.uint64)
                if len(chain) == 3 and sum(map(set(wy.tolist()).__contains__, wx.tolist())) < needed:
                    continue
                shifted = [(a - at, b - bt, n) for a, b, n in zip(chain[::3], chain[1::3], chain[2::3], strict=True)]
                # of a doc_id with several texts, the chain may be another's
                if any(a + n > len(wx) or b + n > len(wy) for a, b, n in shifted):
                    continue
                got = align(shifted, wx, wy, identity, (al, bl, am, bm))
                out += [(*key, 0, 0, 0, 0, -1)] if got is None else [(*key, a + at, b + at, c + bt, d + bt, e) for a, b, c, d, e in got]
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, chain, sides = None, [], {1: set(), 2: set()}
        for batch in slices(batches, "part"):
            out = []
            words = Words(batch.column(5), SPACED)
            hashes = [words.hashes[a:b].tobytes() for a, b in zip(words.first[:-1], words.first[1:], strict=True)]
            cols = [hashes if i == 5 else col.to_pylist() for i, col in enumerate(batch.columns)]
            for kind, x, y, n, c, *part in zip(*cols, strict=True):
                if (x, y, n) != key:
                    out += flush(key, chain, *sides.values()) if key else []
                    key, sides = (x, y, n), {1: set(), 2: set()}
                chain = c if kind == 1 else chain
                sides[kind].add(tuple(part))
            yield rows(out)
        yield rows(flush(key, chain, *sides.values()) if key else [])

    def rows(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], pa.int64()) for k in range(8)], names=names)

    return run


def _compared(chained: DataFrame, texts: DataFrame, around: int, k: int, identity: int) -> DataFrame:
    """Chains aligned on the texts' words from ``around`` before them to ``around`` after; agree is -1 if that doesn't reach.

    Texts and what is asked of them are dealt by doc together, so a text is sent once however many chains it has.
    """
    none = lambda t: F.lit(None).cast(t)
    asked = []
    for kind, c, at in ((1, "x", 1), (2, "y", 2)):
        low = F.element_at("chain", at) - around
        high = F.element_at("chain", -4 + at) + F.element_at("chain", -1) + around
        asked.append(chained.select(F.col(c).alias("doc"), F.lit(kind).alias("kind"), none("string").alias("text"), "x", "y", "n", (F.col("chain") if kind == 1 else none("array<int>")).alias("chain"), low.alias("low"), high.alias("high")))
    every = texts.select("doc", F.lit(0).alias("kind"), "text", none("long").alias("x"), none("long").alias("y"), none("int").alias("n"), none("array<int>").alias("chain"), none("int").alias("low"), none("int").alias("high"))
    parts = every.unionByName(asked[0]).unionByName(asked[1]).repartition("doc").sortWithinPartitions("doc", "kind")
    parts = parts.mapInArrow(_cut, "kind int, x long, y long, n int, chain array<int>, part string, at int, less boolean, more boolean")
    return parts.repartition("x", "y", "n").sortWithinPartitions("x", "y", "n", "kind").mapInArrow(_aligned(k, identity), "x long, y long, n long, start long, end long, other_start long, other_end long, agree long")


def _passages(chained: DataFrame, texts: DataFrame, k: int, identity: int, scratch: Scratch, name: str) -> DataFrame:
    """The chains aligned, on the words around them first, and on the whole texts where their ends may lie further."""
    near = scratch.keep(_compared(chained, texts.join(small(_ends(chained)), "doc", "left_semi"), AROUND, k, identity), name)
    further = near.where("agree < 0").select("x", "y", F.col("n").cast("int").alias("n")).distinct()
    more = scratch.keep(chained.join(small(further), ["x", "y", "n"], "left_semi"), f"{name}-open")
    more = scratch.keep(_compared(more, texts.join(small(_ends(more)), "doc", "left_semi"), 1 << 30, k, identity), f"{name}-more")
    return near.where("agree >= 0").unionByName(more).drop("n").where(f"end - start >= {SHORTEST}").distinct()


def _ends(chained: DataFrame) -> DataFrame:
    return chained.select(F.explode(F.array("x", "y")).alias("doc")).distinct()


def repeated_passages(documents: DataFrame, k: int = K, window: int = WINDOW, least: int = LEAST, gap: float = GAP, identity: int = IDENTITY) -> DataFrame:
    """doc_id, start_word, end_word, other_id, other_start, other_end and n_same of every passage that an earlier document has.

    A document that equals an earlier one as a whole has one row for that; what its class shares with
    others is reported for the class's first document.
    """
    spark = documents.sparkSession
    bounded_batches(spark)
    scratch = Scratch(spark, "passages")
    docs = documents.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc"), F.col("text").cast("string").alias("text"))
    lowered = F.lower("text")
    prints = docs.select("doc", F.xxhash64(lowered).alias("h1"), F.xxhash64(F.lit(1), lowered).alias("h2"), F.size(F.array_remove(F.split("text", "[ \\t-\\r]+"), "")).cast("long").alias("n"))
    prints = scratch.keep(prints, "prints")
    classes = prints.groupBy("h1", "h2").agg(F.min("doc").alias("rep"), F.count("*").alias("copies")).where("copies > 1").drop("copies")
    copies = scratch.keep(prints.join(small(classes), ["h1", "h2"]).where("doc <> rep").select("doc", "rep", "n").distinct(), "copies")

    reps = docs.join(small(copies.select("doc").distinct()), "doc", "left_anti")
    # dealt once, by seed; nothing of it is written besides that shuffle
    seeds = reps.mapInArrow(_seeds(k, window), "seed long, doc long, pos int").repartition("seed").sortWithinPartitions("seed", "doc", "pos")
    anchors = seeds.mapInArrow(_anchors, "x long, y long, px int, py int")
    chained = anchors.repartition("x", "y").sortWithinPartitions("x", "y").mapInArrow(_chained(k, gap), "x long, y long, n int, chain array<int>")
    chained = scratch.keep(chained, "chained")

    several = F.expr(f"size(chain) > 3 or chain[2] > {k}")
    found = _passages(chained.where(several), reps, k, identity, scratch, "found")
    # a passage that many documents have is mostly covered by chains of several seeds; of the lone seeds, those beyond are aligned
    lone = chained.where(~several).select("x", "y", "n", "chain", F.col("chain")[0].alias("start"), (F.col("chain")[0] + k).alias("end"))
    spans = found.select("x", F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end")).distinct()
    every = lone.unionByName(spans, allowMissingColumns=True)
    reach = F.max(F.when(F.col("y").isNull(), F.col("end"))).over(Window.partitionBy("x").orderBy("start", F.col("y").isNotNull()).rowsBetween(Window.unboundedPreceding, 0))
    beyond = every.withColumn("reach", reach).where("y is not null and (reach is null or reach < end)").select("x", "y", "n", "chain")
    found = found.unionByName(_passages(scratch.keep(beyond, "beyond"), reps, k, identity, scratch, "lone")).distinct()
    # runs of words that chains cover without a break
    w = Window.partitionBy("x").orderBy("start", "end")
    run = found.withColumn("before", F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1)))
    run = run.withColumn("run", F.sum(F.when(F.col("start") <= F.col("before"), 0).otherwise(1)).over(w))
    by = Window.partitionBy("x", "run")
    run = run.withColumn("long", F.max("end").over(by) - F.min("start").over(by)).where(F.col("long") >= least)
    out = run.select(F.col("x").alias("doc_id"), F.col("start").alias("start_word"), F.col("end").alias("end_word"), F.col("y").alias("other_id"), "other_start", "other_end", F.col("agree").alias("n_same"))
    zero = F.lit(0).cast("long")
    whole = copies.where(F.col("n") >= least).select(F.col("doc").alias("doc_id"), zero.alias("start_word"), F.col("n").alias("end_word"), F.col("rep").alias("other_id"), zero.alias("other_start"), F.col("n").alias("other_end"), F.col("n").alias("n_same"))
    return out.unionByName(whole)
