"""Benchmark passages in documents, by Wu-Manber multi-pattern search over words.

A pattern is a window of ``window`` consecutive words of a benchmark item; an item with fewer words
is one pattern of its own length. For each pattern length a shift table, indexed by the hash of a
block of two words (one, for patterns of one word), says how far the search may move on when a
text's block ends at a position: as far as no pattern can end there. Where the shift is 0, the bucket of patterns that
end in this block is taken, their words' hashes are compared, and what remains is compared byte by
byte. The search runs in lanes: each stretch of a text moves on at its own pace, all in one array.

Items are sent to the executors in blocks of at most ``block_bytes`` of text, one pass over the
documents for each block, so nothing of unbounded size is broadcast.

Results for odd input: null, empty or word-less texts have n_words = 0 and no hit; null, empty and
word-less items have no pattern, nor do items without item_id. Repeated rows are each returned.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._util import bounded_batches, claim, slices
from ._words import ALNUM, Words, mix

WINDOW, BLOCK_BYTES, LANE, TABLE_BITS = 10, 16 << 20, 128, 18
_C = np.array([0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)

STATE = "doc_id long, text string, spans array<int>, items array<string>"
RESULT = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"


class Patterns:
    """The tables for all windows of one length."""

    def __init__(self, length: int, windows: dict[tuple, set[str]], hashes: dict[bytes, int]):
        self.length, self.block = length, min(2, length)
        self.words = list(windows)
        self.items = [sorted(windows[w]) for w in self.words]
        self.hashes = np.array([[hashes[x] for x in w] for w in self.words], np.uint64)
        self.shift = np.full(1 << TABLE_BITS, length - self.block + 1, np.int32)
        for end in range(self.block - 1, length):
            np.minimum.at(self.shift, self.slot(self.blocks(self.hashes, end)), length - 1 - end)
        suffix = self.blocks(self.hashes, length - 1)
        self.order = np.argsort(suffix, kind="stable")
        self.suffix = suffix[self.order]

    def blocks(self, h: np.ndarray, end) -> np.ndarray:
        x = h[..., end] * _C[0]
        return mix(x + h[..., end - 1] * _C[1] if self.block == 2 else x)

    @staticmethod
    def slot(blocks: np.ndarray) -> np.ndarray:
        return (blocks >> np.uint64(64 - TABLE_BITS)).astype(np.int64)

    def search(self, words: Words) -> Iterator[tuple[int, int]]:
        """(index of the first word, pattern) of each occurrence."""
        h, first = words.hashes, words.first
        low, high = first[:-1] + self.length - 1, first[1:]
        lanes = np.maximum(0, -(-(high - low) // LANE))
        total = int(lanes.sum())
        if not total:
            return
        nth = np.arange(total) - np.repeat(np.cumsum(lanes) - lanes, lanes)
        at = np.repeat(low, lanes) + nth * LANE
        end = np.minimum(at + LANE, np.repeat(high, lanes))
        found = []
        while len(at):
            step = self.shift[self.slot(self.blocks(h, at))]
            found.append(at[step == 0])
            at = at + np.maximum(step, 1)
            go = at < end
            at, end = at[go], end[go]
        at = np.concatenate(found)
        blocks = self.blocks(h, at)
        low, high = np.searchsorted(self.suffix, blocks, "left"), np.searchsorted(self.suffix, blocks, "right")
        n = high - low
        at, which = np.repeat(at, n), self.order[np.repeat(low, n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)]
        for j in range(self.length):
            same = h[at - self.length + 1 + j] == self.hashes[which, j]
            at, which = at[same], which[same]
        for last, k in zip(at.tolist(), which.tolist(), strict=True):
            start = last - self.length + 1
            if all(words.word(start + j) == x for j, x in enumerate(self.words[k])):
                yield start, k


def patterns(items: list[tuple[str, str]], window: int = WINDOW) -> list[Patterns]:
    by_length: dict[int, dict[tuple, set[str]]] = defaultdict(lambda: defaultdict(set))
    hashes: dict[bytes, int] = {}
    for item, text in items:
        w = Words(pa.array([text]), ALNUM)
        words = [w.word(i) for i in range(len(w.hashes))]
        hashes |= zip(words, w.hashes.tolist(), strict=True)
        k = min(window, len(words))
        for i in range(len(words) - k + 1 if k else 0):
            by_length[k][tuple(words[i : i + k])].add(item)
    return [Patterns(k, w, hashes) for k, w in sorted(by_length.items())]


def _spans(flags: np.ndarray) -> list[int]:
    edges = np.flatnonzero(np.diff(np.concatenate([[0], flags.view(np.int8), [0]])))
    return edges.tolist()


def _scan(found: list[Patterns]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            words = Words(batch.column(1), ALNUM)
            spans, items = batch.column(2).to_pylist(), [set(x or ()) for x in batch.column(3).to_pylist()]
            hit, touched = np.zeros(len(words.hashes), bool), set()
            for p in found:
                for start, k in p.search(words):
                    hit[start : start + p.length] = True
                    d = int(np.searchsorted(words.first, start, side="right")) - 1
                    items[d].update(p.items[k])
                    touched.add(d)
            for d in touched:
                a, b = words.first[d], words.first[d + 1]
                mine = hit[a:b].copy()
                for s, e in zip(spans[d][::2], spans[d][1::2], strict=True):
                    mine[s:e] = True
                spans[d] = _spans(mine)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(spans, pa.list_(pa.int32())), pa.array([sorted(x) for x in items], pa.list_(pa.string()))], names=["doc_id", "text", "spans", "items"])

    return run


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text"):
        n = np.diff(Words(batch.column(1), ALNUM).first)
        spans, items = batch.column(2).to_pylist(), batch.column(3).to_pylist()
        n_hit = [sum(x[1::2]) - sum(x[::2]) for x in spans]
        digest = [hashlib.sha256(",".join(sorted(x)).encode()).hexdigest() for x in items]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n.astype(np.int64)), pa.array(n_hit, pa.int64()), pa.array([len(x) for x in items], pa.int64()), pa.array(digest, pa.string()), pa.array([x > 0 for x in n_hit], pa.bool_())], names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"])


def _keep(found: list[Patterns], at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("none", lambda: None)
        for batch in slices(batches, "text"):
            words = Words(batch.column(at), ALNUM)
            starts = [start for p in found for start, _ in p.search(words)]
            clean = np.ones(batch.num_rows, bool)
            clean[np.searchsorted(words.first, np.array(starts, np.int64), side="right") - 1] = False
            yield batch.filter(pa.array(clean))

    return run


def blocks(benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> Iterator[list[Patterns]]:
    """The benchmark's search tables, for so many bytes of items at a time."""
    known = benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text"))
    size = known.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-size // block_bytes)
    for k in range(n):
        yield patterns([tuple(r) for r in known.where(F.pmod(F.xxhash64("item_id"), F.lit(n)) == k).collect()], window)


def occurrences(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, text, spans (word numbers: start, end, start, end, ...) and items with occurring windows."""
    bounded_batches(documents.sparkSession)
    df = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.expr("cast(array() as array<int>)").alias("spans"), F.expr("cast(array() as array<string>)").alias("items"))
    for found in blocks(benchmark, window, block_bytes):
        df = df.mapInArrow(_scan(found), STATE)
    return df


def contamination(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated for every row."""
    return occurrences(documents, benchmark, window, block_bytes).mapInArrow(_finish, RESULT)


def clean(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows whose text has no benchmark window, with all their columns; one pass, no shuffle."""
    bounded_batches(documents.sparkSession)
    for found in blocks(benchmark, window, block_bytes):
        documents = documents.mapInArrow(_keep(found, documents.columns.index("text")), documents.schema)
    return documents


ORACLE = r"""
with d as (
  select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') as ws from documents),
b as (
  select item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') as ws from benchmark),
bw as (
  select distinct item_id, least(10, len(ws)) as k, unnest(list_transform(range(1, len(ws) - least(10, len(ws)) + 2), lambda i: array_to_string(ws[i:i + least(10, len(ws)) - 1], ' '))) as w
  from b where len(ws) > 0),
ks as (select distinct k from bw),
dw as (
  select doc_id, k, i, array_to_string(ws[i:i + k - 1], ' ') as w
  from (select doc_id, k, ws, unnest(range(1, len(ws) - k + 2)) as i from d, ks where len(ws) >= k)),
m as (select doc_id, item_id, i, dw.k from dw join bw on dw.w = bw.w and dw.k = bw.k),
h as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(i, i + k)) as p from m) group by 1),
it as (select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as items from (select distinct doc_id, cast(item_id as varchar) as item from m) group by 1)
select d.doc_id, cast(len(ws) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
  sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join h using (doc_id) left join it using (doc_id)
"""
