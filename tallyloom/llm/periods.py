"""Periodic runs of words by heavy/light lag counting.

A run of period q is a stretch of max(12, 2q) words or more in which words q apart are identical, q is
the smallest such distance and no neighbouring word goes on so. At lag q it has at least
max(12 - q, q) matches in a row, so a lag with fewer matches in the whole text has no run.

* Matches of every lag are counted exactly. A word that occurs often is heavy: the autocorrelation of
  its places, by FFT, all heavy words of a text added up before the one inverse. The others are light:
  the differences of their places, for all texts of a batch at once.
* Only lags with enough matches get an island scan. An island of m matches in a row holds a place whose
  number is a multiple of m, so only those are looked at, and only what still matches a few places on
  leads to a scan of the whole lag.
* Lags are taken upwards. What a run of a period that divides the lag has already explained is passed
  over, so a text that repeats one word costs no scan for each of its lags.

Texts are independent: nothing is shuffled, a task holds a few MB of text at a time. Results for odd
input: null, empty and blank texts have no words, no runs and the digests of nothing; repeated rows are
each returned; a null ``doc_id`` is a row like others; an empty table gives an empty table. Extra
columns are not read.
"""

from __future__ import annotations

import hashlib
import zlib
from collections import defaultdict
from collections.abc import Iterator, Sequence
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._util import bounded_batches, slices

#: Words that a run has at least, besides twice its period.
LEAST = 12
#: Places on which a sampled match must go on before its lag is scanned.
AHEAD = 5
RUNS = "array<struct<start: long, length: long, period: long>>"
RESULT = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"
_FLAT = np.zeros(0, np.int64)


def matches_needed(lag: np.ndarray | int) -> np.ndarray:
    """Matches in a row that a run of this period has at least."""
    return np.maximum(LEAST - lag, lag)


def heavy_from(n: int) -> int:
    """Occurrences from which a word of a text of n words is counted by FFT: there its pairs cost more than a transform."""
    return int(0.4 * np.sqrt(n * np.log2(n + 2))) + 48


def light_counts(codes: np.ndarray, places: np.ndarray, base: np.ndarray, most: np.ndarray, size: int) -> np.ndarray:
    """Matches by lag of words with the same code; base: where a word's text begins in the result, most: its largest lag."""
    out = np.zeros(size, np.int64)
    order = np.argsort(codes, kind="stable")
    codes, places, base, most = codes[order], places[order], base[order], most[order]
    at, step, waiting, held = np.arange(len(codes)), 1, [], 0
    while len(at):
        at = at[at < len(codes) - step]
        at = at[codes[at] == codes[at + step]]
        lag = places[at + step] - places[at]
        near = lag <= most[at]
        at, lag = at[near], lag[near]  # occurrences beyond the largest lag only get further away
        waiting.append(base[at] + lag)
        held += len(at)
        step += 1
        if held > size or not len(at):  # one count for as many pairs as there are lags
            out += np.bincount(np.concatenate(waiting), minlength=size)
            waiting, held = [], 0
    return out


def heavy_counts(places: Sequence[np.ndarray], n: int, most: int) -> np.ndarray:
    """Matches by lag, 0 to most, of words given by their places among n."""
    size = 1 << int(np.ceil(np.log2(n + most + 1)))
    power = np.zeros(size // 2 + 1)
    for at in places:
        x = np.zeros(size)
        x[at] = 1.0
        f = np.fft.rfft(x)
        power += f.real**2 + f.imag**2
    return np.rint(np.fft.irfft(power, size)[: most + 1]).astype(np.int64)


def lag_counts(texts: Sequence[np.ndarray]) -> list[np.ndarray]:
    """Of each text, given as codes from 0 for its words, the number of matches at lags 0 (left 0) to half its length."""
    ns = [len(t) for t in texts]
    most = [n // 2 for n in ns]
    first = np.concatenate([[0], np.cumsum([m + 1 for m in most])])
    codes, places, base, far, out_of = [], [], [], [], 0
    heavy: dict[int, list[np.ndarray]] = {}
    for k, t in enumerate(texts):
        if not len(t):
            continue
        counts = np.bincount(t)
        many = np.flatnonzero(counts >= heavy_from(ns[k]))
        light = np.flatnonzero((counts > 1) & (counts < heavy_from(ns[k])))
        if len(many):
            heavy[k] = [np.flatnonzero(t == w) for w in many]
        keep = np.zeros(len(counts), bool)
        keep[light] = True
        at = np.flatnonzero(keep[t])
        codes.append(t[at] + out_of)
        places.append(at)
        base.append(np.full(len(at), first[k]))
        far.append(np.full(len(at), most[k]))
        out_of += len(counts)
    join = lambda xs: np.concatenate(xs) if xs else _FLAT
    flat = light_counts(join(codes), join(places), join(base), join(far), int(first[-1]))
    out = [flat[first[k] : first[k + 1]] for k in range(len(texts))]
    for k, at in heavy.items():
        out[k] = out[k] + heavy_counts(at, ns[k], most[k])
        out[k][0] = 0
    return out


def _explained(hits: np.ndarray, lag: int, found: dict[int, list[tuple[int, int]]]) -> np.ndarray:
    """Whether a run of a period that divides the lag holds both words of a match."""
    inside = np.zeros(len(hits), bool)
    for period, runs in found.items():
        if lag % period == 0:
            starts, ends = np.array([r[0] for r in runs]), np.array([r[1] for r in runs])
            k = np.searchsorted(starts, hits, side="right") - 1
            inside |= (k >= 0) & (hits + lag < ends[np.maximum(k, 0)])
    return inside


def runs_of(text: np.ndarray, counts: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of a text given as codes, by start and then period."""
    n = len(text)
    lags = np.arange(len(counts))
    found: dict[int, list[tuple[int, int]]] = {}
    seen: set[tuple[int, int]] = set()
    for lag in map(int, np.flatnonzero((counts >= matches_needed(lags)) & (lags > 0))):
        need = max(LEAST - lag, lag)
        at = np.arange(0, n - lag, need)
        hits = at[text[at] == text[at + lag]]
        if len(hits) and found:
            hits = hits[~_explained(hits, lag, found)]
        if not len(hits):
            continue
        # the island of a hit has `need` places or more, so it goes on for AHEAD in one direction or, in both together, as far
        ahead, back = np.zeros(len(hits), np.int64), np.zeros(len(hits), np.int64)
        for reach, way in ((ahead, 1), (back, -1)):
            live = np.arange(len(hits))
            for step in range(1, AHEAD + 1):
                to = hits[live] + way * step
                live = live[(to >= 0) & (to < n - lag)]
                to = hits[live] + way * step
                live = live[text[to] == text[to + lag]]
                reach[live] = step
                if not len(live):
                    break
        if not (ahead + back + 1 >= min(need, AHEAD + 1)).any():
            continue
        same = text[: n - lag] == text[lag:]
        edges = np.flatnonzero(np.diff(np.concatenate([[False], same, [False]]).astype(np.int8)))
        starts, ends = edges[::2], edges[1::2]
        for s, e in zip(starts[ends - starts >= need].tolist(), ends[ends - starts >= need].tolist()):
            if (s, e + lag) not in seen:  # else a smaller period has the same stretch
                seen.add((s, e + lag))
                found.setdefault(lag, []).append((s, e + lag))
    return sorted((s, e - s, q) for q, runs in found.items() for s, e in runs)


def kept_words(n: int, runs: Sequence[tuple[int, int, int]]) -> np.ndarray:
    """False for words that any run holds after its first period."""
    change = np.zeros(n + 1, np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    return np.cumsum(change[:n]) == 0


def coded(words: Sequence[bytes]) -> np.ndarray:
    known: dict[bytes, int] = defaultdict(count().__next__)
    return np.fromiter(map(known.__getitem__, words), np.int64, len(words))


def find(texts: Sequence[Sequence[bytes]]) -> list[list[tuple[int, int, int]]]:
    """The runs of each text, given as its words."""
    codes = [coded(t) for t in texts]
    return [runs_of(c, m) if len(c) >= LEAST else [] for c, m in zip(codes, lag_counts(codes))]


def words(texts: pa.Array) -> list[list[bytes]]:
    """``[^\\x20\\x09-\\x0D]+`` of each text: bytes.split() parts at just these bytes."""
    return [(t or b"").split() for t in texts.cast(pa.binary()).to_pylist()]


def planted(own: list[bytes], doc_id: int | None) -> list[bytes]:
    """The contract's rewriting: of every tenth text the words from some place on repeat a stretch."""
    h = zlib.crc32(str(doc_id).encode())
    n, g = len(own), h // 10
    if doc_id is None or h % 10 or not n:
        return own
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return own[:a] + [own[a + i % p] for i in range(n - a)]


def runs(documents: DataFrame, text: Column | str = "text") -> DataFrame:
    """The rows with ``runs``, an array of (start, length, period) by start and then period."""
    own = documents.select(F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("row"), (F.col(text) if isinstance(text, str) else text).cast("string").alias("text"))
    kind = own.schema["row"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            found = [[{"start": s, "length": l, "period": q} for s, l, q in x] for x in find(words(batch.column(1)))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])))], names=["row", "runs"])

    bounded_batches(documents.sparkSession)
    return own.mapInArrow(run, f"row {kind}, runs {RUNS}")


def digests(documents: DataFrame) -> DataFrame:
    """doc_id, the number of runs of each rewritten text, the greatest run, and digests of all runs and of the text without repetitions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            ids = batch.column(0).to_pylist()
            texts = [planted(t, i) for i, t in zip(ids, words(batch.column(1)))]
            out = []
            for own, found in zip(texts, find(texts)):
                best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=None)
                said = "".join(f"{s},{l},{q}\n" for s, l, q in found)
                left = [own[i] for i in np.flatnonzero(kept_words(len(own), found))] if found else own
                out.append((len(found), *(best or (None,) * 3), best and 1000 * best[1] // best[2], hashlib.sha256(said.encode()).hexdigest(), hashlib.sha256(b" ".join(left)).hexdigest()))
            cols = list(zip(*out)) or [()] * 7
            kinds = [pa.int64()] * 5 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds))], names=[x.split()[0] for x in RESULT.split(", ")])

    bounded_batches(documents.sparkSession)
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, RESULT)
