"""Document fingerprints by SpotSigs: chains of content words that follow common words.

* Anchors are the words that make up at least one in COMMON of all words of the corpus (so at most COMMON
  words, whatever its size); they are counted over all texts, added up in tasks before the shuffle.
* Each anchor and the CHAIN content words after it, other anchors left out, are one signature of 48 bits.
  A text without any takes the words whose hash is a multiple of SPARSE as anchors; one without these is
  one signature as a whole. The fingerprint is the sorted set of signatures, 8 characters for each.
* Likeness is the sets' Jaccard similarity. ``matches`` finds all pairs of two tables from a similarity on:
  sets are partitioned by length so that similar ones are in the same or in neighbouring partitions, meet
  on their rarest signatures only, and are compared if lengths and places still allow the similarity.

``next_texts`` gives every document the one that follows it by falling doc_id, without a global sort in one
task: ids are dealt into ranges, each range's first row is also sent to the range before, and the very
first to the last; rows stream through a task in order.

Words are ``[0-9A-Za-z]`` and all beyond ASCII, with A-Z lower-cased. Results for odd input: null is the empty
text; a text without words has the empty fingerprint, and two empty ones have a likeness of 1; rows with
the same doc_id follow each other by text, null ids come last; repeated rows are each returned; an empty
table gives an empty table. Extra columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._util import Scratch, bounded_batches, slices
from ._words import _COMBINE, ALNUM, Words, mix

#: A word is an anchor if it is at least one in so many of all words.
COMMON = 400
#: Content words of a signature; anchors of texts without common words are one word in so many.
CHAIN, SPARSE = 3, 16
#: Counts that a task keeps before it hands them on.
HELD = 1_000_000
#: Likeness from which ``matches`` returns a pair.
LEAST = 0.8
RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, n_signatures long"
_EMPTY = np.zeros(0, np.uint64)


def common_words(documents: DataFrame, share: int = COMMON) -> np.ndarray:
    """The hashes, sorted, of the words that are at least one in ``share`` of all words: at most ``share`` of them."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def told(words: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(n)], names=["word", "n"])

        words, n = _EMPTY, np.zeros(0, np.int64)
        for batch in slices(batches, "text"):
            new, many = np.unique(Words(batch.column(0), ALNUM).hashes, return_counts=True)
            words, at = np.unique(np.concatenate([words, new]), return_inverse=True)
            n = np.bincount(at, weights=np.concatenate([n, many]), minlength=len(words)).astype(np.int64)
            if len(words) > HELD:
                yield told(words, n)
                words, n = _EMPTY, np.zeros(0, np.int64)
        yield told(words, n)

    counts = documents.select(F.col("text").cast("string").alias("text")).mapInArrow(count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    scratch = Scratch(documents.sparkSession, "spotsigs")
    counts = scratch.keep(counts, "counts")  # read for the total and again for the words
    total = counts.agg(F.sum("n")).first()[0] or 0
    found = counts.where(F.col("n") * share >= total).select("word").collect()
    scratch.drop("counts")
    return np.sort(np.array([r.word for r in found], np.int64).view(np.uint64))


def signature_sets(column: pa.Array, anchors: np.ndarray) -> list[np.ndarray]:
    """The sorted signatures of each text."""
    words = Words(column, ALNUM)
    h, first = words.hashes, words.first
    texts = len(first) - 1
    if not len(h):
        return [_EMPTY] * texts
    found = np.searchsorted(anchors, h)
    spot = (anchors[np.minimum(found, len(anchors) - 1)] == h) if len(anchors) else np.zeros(len(h), bool)
    sigs, owner = _chains(h, first, spot)
    none = np.setdiff1d(np.flatnonzero(np.diff(first)), owner)
    if len(none):  # texts without an anchor that a chain follows
        own = np.zeros(len(h) + 1, np.int64)
        np.add.at(own, first[none], 1)
        np.add.at(own, first[none + 1], -1)
        more, by = _chains(h, first, (np.cumsum(own[:-1]) > 0) & (h % np.uint64(SPARSE) == 0), plain=True)
        rest = np.setdiff1d(none, by)
        whole = np.array([mix(np.array([_whole(h[first[d] : first[d + 1]])], np.uint64))[0] for d in rest], np.uint64)
        sigs, owner = np.concatenate([sigs, more, whole]), np.concatenate([owner, by, rest])
    sigs >>= np.uint64(16)
    order = np.lexsort((sigs, owner))
    sigs, owner = sigs[order], owner[order]
    new = np.ones(len(sigs), bool)
    new[1:] = (sigs[1:] != sigs[:-1]) | (owner[1:] != owner[:-1])
    sigs, owner = sigs[new], owner[new]
    return np.split(sigs, np.searchsorted(owner, np.arange(1, texts))) if texts > 1 else [sigs]


def _chains(h: np.ndarray, first: np.ndarray, spot: np.ndarray, plain: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """A signature for each spot that CHAIN content words of its text follow, and the text; plain: spots are content too."""
    at = np.flatnonzero(spot)
    content = np.arange(len(h)) if plain else np.flatnonzero(~spot)
    owner = np.searchsorted(first, at, side="right") - 1
    k = np.searchsorted(content, at, side="right")
    last = k + CHAIN - 1
    whole = last < len(content)
    whole[whole] = content[last[whole]] < first[owner[whole] + 1]
    at, owner, k = at[whole], owner[whole], k[whole]
    x = h[at] * _COMBINE[0]
    for j in range(CHAIN):
        x += h[content[k + j]] * _COMBINE[j + 1]
    return mix(x), owner


def _whole(h: np.ndarray) -> int:
    x = len(h)
    for w in h.tolist():
        x = (x * 0x9E3779B97F4A7C15 + w) % 2**64
    return x


def written(signatures: np.ndarray) -> str:
    """A fingerprint: 8 characters for each signature, in their order."""
    return base64.urlsafe_b64encode(signatures.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 2:].tobytes()).decode()


def jaccard(a: np.ndarray, b: np.ndarray, least: float = 0.0) -> float:
    """The likeness of two sorted sets; 0 without a look at them if their lengths don't allow ``least``."""
    if not len(a) and not len(b):
        return 1.0
    if min(len(a), len(b)) < least * max(len(a), len(b)) or not len(a) or not len(b):
        return 0.0
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def _ranges(documents: DataFrame, n: int) -> tuple[np.ndarray, dict[int, int]]:
    """Bounds that deal the ids evenly, and of each range that has rows its greatest id. Null counts as the least id."""
    ids = documents.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("id"))
    shares = [k / n for k in range(1, n)] or [0.5]
    got = ids.agg(F.percentile_approx("id", shares, 10 * n).alias("b")).first().b
    bounds = np.unique(np.array(got or [], np.int64))

    def greatest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top: dict[int, int] = {}
        for batch in batches:
            x = batch.column(0).to_numpy()
            at = np.searchsorted(bounds, x, side="left")
            for r in np.unique(at).tolist():
                top[r] = max(top.get(r, -(2**63)), int(x[at == r].max()))
        yield pa.RecordBatch.from_arrays([pa.array(list(top), pa.int32()), pa.array(list(top.values()), pa.int64())], names=["r", "id"])

    tops = ids.mapInArrow(greatest, "r int, id long").groupBy("r").agg(F.max("id").alias("id"))
    return bounds, {x.r: x.id for x in tops.collect()}


def next_texts(documents: DataFrame) -> DataFrame:
    """(range, tail, id, doc_id, text), sorted in each partition so that every row with ``tail`` 0 is followed by its next document."""
    spark = documents.sparkSession
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    bounds, tops = _ranges(documents, n)
    order = sorted(tops, reverse=True)  # ranges by falling ids
    before = {r: order[k - 1] for k, r in enumerate(order)}  # of the first range: the last

    @F.pandas_udf("array<struct<range: int, tail: int>>")
    def places(ids: pd.Series) -> pd.Series:
        own = np.searchsorted(bounds, ids.to_numpy(np.int64), side="left")
        return pd.Series([[(int(r), 0), (before[r], 1)] if i == tops[r] else [(int(r), 0)] for i, r in zip(ids, own.tolist())])

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("id", F.coalesce("doc_id", F.lit(-(2**63))))
    rows = rows.select(F.explode(places("id")).alias("p"), "id", "doc_id", "text").select("p.range", "p.tail", "id", "doc_id", "text")
    return rows.repartitionById(len(bounds) + 1, F.col("range")).sortWithinPartitions("range", "tail", F.desc("id"), "text")


def fingerprints(documents: DataFrame) -> DataFrame:
    """The rows with ``fingerprint``."""
    bounded_batches(documents.sparkSession)
    anchors = common_words(documents)
    own = documents.select(F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("row"), F.col("text").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([written(s) for s in signature_sets(batch.column(1), anchors)], pa.string())], names=["row", "fingerprint"])

    return own.mapInArrow(run, f"row {own.schema['row'].dataType.simpleString()}, fingerprint string").select("row.*", "fingerprint")


def edited(text: str, following: str) -> str:
    """The last third of the code points replaced by the first as many of the following text."""
    n = len(text) // 3
    return text[: len(text) - n] + following[:n]


def digests(documents: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited text, and how like they are to each other and to the next document's."""
    bounded_batches(documents.sparkSession)
    anchors = common_words(documents)
    names = [x.split()[0] for x in RESULT.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple | None = None  # (range, tail, doc_id, text, signatures) of the row before
        for batch in slices(batches, "text"):
            rows = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3).to_pylist(), batch.column(4).to_pylist(), signature_sets(batch.column(4), anchors)))
            rows = rows if last is None else [last, *rows]
            if not rows:
                continue
            last = rows[-1]
            pairs = [(a, b) for a, b in zip(rows, rows[1:]) if not a[1] and a[0] == b[0]]
            texts = [edited(a[3], b[3]) for a, b in pairs]
            sets = signature_sets(pa.array(texts, pa.string()), anchors)
            cols = [
                [a[2] for a, _ in pairs], [len(a[3]) for a, _ in pairs], [hashlib.sha256(t.encode()).hexdigest() for t in texts], [written(a[4]) for a, _ in pairs], [written(e) for e in sets],
                [jaccard(a[4], e) for (a, _), e in zip(pairs, sets)], [jaccard(a[4], b[4]) for a, b in pairs], [len(a[4]) for a, _ in pairs],
            ]
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=names)

    return next_texts(documents).mapInArrow(run, RESULT)


def classes(prints: DataFrame, identifier: str = "doc_id") -> DataFrame:
    """(fingerprint, class_id, members, n): equal fingerprints are one class, named by its least id."""
    g = prints.where("fingerprint <> ''").groupBy("fingerprint").agg(F.min(F.col(f"`{identifier}`")).alias("class_id"), F.count("*").alias("members"))
    return g.withColumn("n", (F.length("fingerprint") / 8).cast("long"))


def matches(left: DataFrame, right: DataFrame, least: float = LEAST) -> DataFrame:
    """(left_class, right_class, likeness) of every pair of classes whose likeness is ``least`` or more.

    left, right: outputs of ``classes``. Sets whose lengths differ by a factor of more than 1/least can't be so alike; partitions
    are as wide as that factor, so a set of the left meets its own and the two partitions beside it. Of each set only the rarest
    n - ceil(least n) + 1 signatures are posted: without one in common the rest is too small. A meeting counts if the signatures
    from there on could still be enough.
    """

    def sets(side: DataFrame) -> DataFrame:
        part = F.floor(F.log(F.col("n") + F.lit(1e-9)) / float(-np.log(least)))
        return side.select("class_id", "n", part.alias("part"), F.regexp_extract_all("fingerprint", F.lit(".{8}"), F.lit(0)).alias("signatures"))

    def posts(side: DataFrame, many: DataFrame) -> DataFrame:
        each = side.select("class_id", "n", "part", F.explode("signatures").alias("signature")).join(many, "signature", "left")
        rare = each.groupBy("class_id", "n", "part").agg(F.sort_array(F.collect_list(F.struct(F.coalesce("many", F.lit(0)).alias("many"), "signature"))).alias("s"))
        prefix = F.slice("s", F.lit(1), (F.col("n") - F.ceil(F.col("n") * least - 1e-9) + 1).cast("int"))
        return rare.select("class_id", "n", "part", F.posexplode(prefix).alias("at", "x")).select("class_id", "n", "part", "at", F.col("x.signature").alias("signature"))

    a, b = sets(left), sets(right)
    many = b.select(F.explode("signatures").alias("signature")).groupBy("signature").agg(F.count("*").alias("many"))
    asked = posts(a, many).select(F.col("class_id").alias("left_class"), F.col("n").alias("ln"), F.col("at").alias("la"), "signature", F.explode(F.array(*[F.col("part") + k for k in (-1, 0, 1)])).alias("part"))
    met = asked.join(posts(b, many), ["part", "signature"])
    need = F.ceil((F.col("ln") + F.col("n")) * (least / (1 + least)) - 1e-9)
    met = met.where((F.least("ln", "n") >= least * F.greatest("ln", "n")) & (F.least(F.col("ln") - F.col("la"), F.col("n") - F.col("at")) >= need))
    pairs = met.select("left_class", F.col("class_id").alias("right_class")).distinct()
    pairs = pairs.join(a.select(F.col("class_id").alias("left_class"), F.col("signatures").alias("x")), "left_class").join(b.select(F.col("class_id").alias("right_class"), F.col("signatures").alias("y")), "right_class")
    both = F.size(F.array_intersect("x", "y"))
    return pairs.select("left_class", "right_class", (both / (F.size("x") + F.size("y") - both)).alias("likeness")).where(F.col("likeness") >= least)
