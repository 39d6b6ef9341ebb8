"""Language identification, word first with back-off to character n-grams.

A word that the model knows is scored by its log frequency in each language. For a word that it
doesn't know, all its character n-grams of the greatest length are looked up (the word is padded by
a space at either end); if the model knows some of them, their mean log frequencies score the word,
else the next shorter length is tried. A text's score in a language is the sum over its words.

The model is fitted on at most about ``rows`` labelled texts of each language, taken by a hash of
doc_id, so its size is bounded by the number of languages; no word or language of these is left out. doc_id, lang and source
are no inputs of a prediction.

Results for odd input: null and letter-less texts are ``und`` with score 0; with nothing to learn
from, all texts are. Texts without lang are predicted, never learnt from; held_out is false for a
null doc_id. Repeated rows are each returned.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._util import Scratch, bounded_batches, claim, slices, small

ROWS, LONGEST = 500, 5
UNKNOWN = "und"
WORD = re.compile(r"[^\W\d_]+")
#: Scores (one for each word and language) kept by a worker; then it starts anew.
CACHE = 200_000
#: Tables of so many scores or fewer are held as a matrix; results are the same.
WHOLE = 4_000_000

RESULT = "doc_id long, held_out boolean, lang_pred string, score double"


def held_out() -> F.Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))


class Model:
    """Log frequencies of words and of n-grams of each size, sparse: of each, the languages that have it."""

    def __init__(self, counts: Iterable[tuple[str, str, int]]):
        """counts: language, word and how often it occurs."""
        counts = list(counts)
        self.languages = sorted({k for k, _, _ in counts})
        nth = {k: i for i, k in enumerate(self.languages)}
        tables: list[dict[tuple[str, int], int]] = [{} for _ in range(LONGEST + 1)]
        for lang, word, count in counts:
            k, padded = nth[lang], f" {word} "
            tables[0][word, k] = tables[0].get((word, k), 0) + count
            for size in range(1, LONGEST + 1):
                t = tables[size]
                for i in range(len(padded) - size + 1):
                    t[padded[i : i + size], k] = t.get((padded[i : i + size], k), 0) + count
        self.tables = [self._logs(t) for t in tables]
        self.cache: dict[str, np.ndarray] = {}
        self.most = CACHE // max(1, len(self.languages))
        self.whole: list[np.ndarray | None] | None = None

    def _logs(self, table: dict[tuple[str, int], int]) -> tuple[dict[str, int], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Row of each word; where each row's entries begin; their languages and what they add; what a language has for any word.

        A count of c is c + 1/2 of the language's total, so a word that a language has not adds nothing to the latter.
        """
        at = {w: i for i, w in enumerate(dict.fromkeys(w for w, _ in table))}
        rows = np.fromiter((at[w] for w, _ in table), np.int64, len(table))
        langs = np.fromiter((k for _, k in table), np.int32, len(table))
        n = np.fromiter(table.values(), float, len(table))
        order = np.argsort(rows, kind="stable")
        total = np.bincount(langs, n, len(self.languages)) + 0.5 * len(at)
        return at, np.searchsorted(rows[order], np.arange(len(at) + 1)), langs[order], np.log1p(2 * n[order]), np.log(0.5) - np.log(np.maximum(total, 0.5))

    def __getstate__(self) -> dict:
        return self.__dict__ | {"cache": {}, "whole": None}

    def forget(self) -> None:
        self.cache, self.whole = {}, None

    def _spread(self, size: int) -> np.ndarray | None:
        """A table's rows for all languages, if they are few numbers."""
        at, first, langs, more, base = self.tables[size]
        if len(at) * len(base) > WHOLE:
            return None
        out = np.tile(base, (len(at), 1))
        out[np.repeat(np.arange(len(at)), np.diff(first)), langs] += more
        return out

    def _rows(self, size: int, found: list[int]) -> np.ndarray:
        if (whole := self.whole[size]) is not None:
            return whole[found]
        _, first, langs, more, base = self.tables[size]
        out = np.tile(base, (len(found), 1))
        for k, i in enumerate(found):
            out[k, langs[first[i] : first[i + 1]]] += more[first[i] : first[i + 1]]
        return out

    def word(self, word: str) -> np.ndarray:
        if (i := self.tables[0][0].get(word)) is not None:
            return self.whole[0][i] if self.whole[0] is not None else self._rows(0, [i])[0]
        if (score := self.cache.get(word)) is not None:
            return score
        padded, score = f" {word} ", np.zeros(len(self.languages))
        for size in range(LONGEST, 0, -1):
            at = self.tables[size][0]
            found = [i for k in range(len(padded) - size + 1) if (i := at.get(padded[k : k + size])) is not None]
            if found and (size > 1 or len(found) > 2):  # of single characters, the two spaces say nothing
                score = self._rows(size, found).mean(axis=0)
                break
        if len(self.cache) >= self.most:
            self.cache.clear()
        self.cache[word] = score
        return score

    def predict(self, text: str | None) -> tuple[str, float]:
        counts = Counter(WORD.findall(text.lower())) if text else None
        if not counts or not self.languages or not any(any(map(str.isalpha, w)) for w in counts):
            return UNKNOWN, 0.0
        if self.whole is None:
            self.whole = [self._spread(size) for size in range(LONGEST + 1)]
        score = np.array(list(counts.values()), float) @ np.array([self.word(w) for w in counts])
        best = int(score.argmax())
        return self.languages[best], float(1 / np.exp(np.maximum(score - score[best], -700.0)).sum())


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    claim("words", lambda: None)
    for batch in slices(batches, "text"):
        found: dict[str, Counter] = {}
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            found.setdefault(lang, Counter()).update(WORD.findall(text.lower()))
        rows = [(k, w, n) for k, c in found.items() for w, n in c.items()]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.string(), pa.int64()))], names=["lang", "word", "n"])


def fit(documents: DataFrame, rows: int = ROWS) -> Model:
    """Learns from at most about ``rows`` texts of each language: all their words, and all languages."""
    bounded_batches(documents.sparkSession)
    scratch = Scratch(documents.sparkSession, "language")
    labelled = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).where("lang is not null and text is not null and doc_id is not null").where(~held_out())
    shares = labelled.groupBy("lang").agg((F.lit(rows) / F.count("*")).alias("share"))
    sample = labelled.join(small(shares), "lang").where((F.pmod(F.xxhash64("doc_id", F.lit(8)), F.lit(1 << 30)) / (1 << 30)) < F.col("share"))
    counts = sample.select("lang", "text").mapInArrow(_counted, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    table = scratch.keep(counts, "counts").toArrow().sort_by([("lang", "ascending"), ("word", "ascending")])
    scratch.drop("counts")
    return Model(zip(*(table.column(c).to_pylist() for c in ("lang", "word", "n")), strict=True))


def _shared(documents: DataFrame, model: Model):
    return documents.sparkSession.sparkContext.broadcast(model)


def predict(documents: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every row."""
    held = _shared(documents, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("language", held.value.forget)
        for batch in slices(batches, "text"):
            said = [held.value.predict(x) for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([x for x, _ in said], pa.string()), pa.array([x for _, x in said], pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])
        held.value.forget()

    bounded_batches(documents.sparkSession)
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), F.col("text").cast("string").alias("text")).mapInArrow(run, RESULT)


def identify(documents: DataFrame, rows: int = ROWS) -> DataFrame:
    return predict(documents, fit(documents, rows))


def recognised(documents: DataFrame, least: float = 0.5) -> DataFrame:
    """The rows whose text has a language with at least this score, with all their columns."""
    held, at = _shared(documents, fit(documents)), documents.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("language", held.value.forget)
        for batch in slices(batches, "text"):
            said = [held.value.predict(x) for x in batch.column(at).to_pylist()]
            yield batch.filter(pa.array([k != UNKNOWN and score >= least for k, score in said], pa.bool_()))
        held.value.forget()

    bounded_batches(documents.sparkSession)
    return documents.mapInArrow(run, documents.schema)
