"""Near-duplicate documents by an inverted join over MinHash coordinates.

Each document posts its value under every coordinate. Two documents whose shingle sets have a
Jaccard similarity J agree in a coordinate with probability J, so a pair is a candidate if it
agrees in at least ``matches`` of ``coordinates``; at J = 0.85, 90 of 128 lose fewer than one link
in 100,000. Candidates are found by

* skip merging: values that one document alone has, and then documents that have fewer than
  ``matches`` shared values, can't be in a pair and leave, before any pair is made;
* prefix merging: with its values ordered by rarity, a document looks for partners only in the
  lists of its rarest ones, all but ``matches - 1``: two documents with so many in common share one
  of these;
* stars: in a list each document is paired with the list's least document, not with all. Lists
  whose documents are then in one component need no more pairs. In the others pairs across
  components are compared, but for pairs of
  one home (a document near many, see ``_homes``) that can't be similar enough by what each shares with it, unless they share shingles
  beside it: these are joined on the rarest of such shingles instead. That spares most pairs of near copies that are far from each
  other, but not all: of documents that change the same places of one text to a few variants each, the pairs that share such a change
  still grow with the square of the home.

Every candidate is confirmed on the two full sets. Equal sets are one class from the start, so
that groups of exact copies cost a row for each copy.

Results for odd input: null, empty and word-less texts have empty sets, component_id = doc_id and
kept = true. Rows that repeat a doc_id are each returned. A null doc_id is compared with nothing,
has a null component and is kept. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._util import Scratch, bounded_batches, claim, components, slices, small
from ._words import SPACED, Words, mix, sets

SHINGLE, PERCENT, COORDINATES, MATCHES = 5, 85, 128, 90
#: Rounds in which documents move to another home.
HOMES = 3

SIGNATURES = "doc_id long, n_shingles long, set_a long, set_b long, signature binary, bytes binary"


def signatures(documents: DataFrame, shingle: int = SHINGLE, coordinates: int = COORDINATES) -> DataFrame:
    """One row a document: size and 128-bit fingerprint of its shingle set, and its coordinates, four bytes each."""
    rng = np.random.Generator(np.random.PCG64(7))
    factor = rng.integers(1, 2**63, coordinates, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    shift = rng.integers(0, 2**63, coordinates, dtype=np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("none", lambda: None)
        for batch in slices(batches, "text"):
            values, first = sets(Words(batch.column(1), SPACED), shingle)
            n = np.diff(first)
            full = np.flatnonzero(n)
            out, a, b = np.zeros((len(n), coordinates), np.uint32), np.zeros(len(n), np.uint64), np.zeros(len(n), np.uint64)
            if len(full):
                at = first[full]
                a[full], b[full] = np.add.reduceat(mix(values), at), np.add.reduceat(mix(values ^ np.uint64(0x5851F42D4C957F2D)), at)
                for j in range(coordinates):
                    out[full, j] = np.minimum.reduceat((((values ^ shift[j]) * factor[j]) >> np.uint64(32)).astype(np.uint32), at)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n.astype(np.int64)), pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), pa.array([x.tobytes() for x in out], pa.binary()), pa.array([x.tobytes() for x in out.astype(np.uint8)], pa.binary())], names=["doc_id", "n_shingles", "set_a", "set_b", "signature", "bytes"])

    bounded_batches(documents.sparkSession)
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, SIGNATURES)


def _keys(signature: str, coordinates: int) -> F.Column:
    """The postings of a document: the coordinate's number in the upper half, its value in the lower."""
    return F.expr(f"transform(sequence(0, {coordinates - 1}), j -> shiftleft(cast(j as bigint), 32) + cast(conv(hex(substring({signature}, 4 * j + 1, 4)), 16, 10) as bigint))")


def _agreeing(pairs: DataFrame, reps: DataFrame, percent: int, coordinates: int, matches: int) -> DataFrame:
    """The pairs (a, b) whose sizes allow the similarity and that agree in enough coordinates, by a byte of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint8).reshape(-1, coordinates) for i in (2, 3))
            keep = pa.array((x == y).sum(axis=1) >= matches)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], names=["a", "b"])

    both = pairs.join(reps.select("rep", "n_shingles", "bytes").toDF("a", "na", "sa"), "a").join(reps.select("rep", "n_shingles", "bytes").toDF("b", "nb", "sb"), "b")
    return both.where(f"100 * least(na, nb) >= {percent} * greatest(na, nb)").select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long")


def _texts(documents: DataFrame, ids: DataFrame) -> DataFrame:
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(small(ids), "doc_id", "left_semi")


def compared(pairs: DataFrame, documents: DataFrame, shingle: int) -> DataFrame:
    """The pairs (a, b) of doc_ids with both sizes and the intersection's, of the full shingle sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(slices(batches, "ta"), "tb"):
            (va, fa), (vb, fb) = (sets(Words(batch.column(i), SPACED), shingle) for i in (2, 3))
            common = np.zeros(batch.num_rows, np.int64)
            for i in range(batch.num_rows):
                z = np.concatenate([va[fa[i] : fa[i + 1]], vb[fb[i] : fb[i + 1]]])
                z.sort()
                common[i] = (z[1:] == z[:-1]).sum()
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.diff(fa).astype(np.int64)), pa.array(np.diff(fb).astype(np.int64)), pa.array(common)], names=["a", "b", "na", "nb", "common"])

    bounded_batches(documents.sparkSession)
    texts = _texts(documents, pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct())
    both = pairs.join(texts.toDF("b", "tb"), "b").join(texts.toDF("a", "ta"), "a")
    return both.select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long, na long, nb long, common long").distinct()


def _alike(percent: int) -> str:
    return f"common > 0 and 100 * common >= {percent} * (na + nb - common)"


def gains(members: DataFrame, documents: DataFrame, shingle: int) -> DataFrame:
    """(home, value, rep): the shingles that each document (rep) has and its home, another document, has not."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(slices(batches, "ta"), "tb"):
            (va, fa), (vb, fb) = (sets(Words(batch.column(i), SPACED), shingle) for i in (2, 3))
            more = [np.setdiff1d(vb[fb[i] : fb[i + 1]], va[fa[i] : fa[i + 1]], assume_unique=True) for i in range(batch.num_rows)]
            at = pa.array(np.repeat(np.arange(len(more)), [len(x) for x in more]))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), pa.array(np.concatenate([*more, np.zeros(0, np.uint64)]).view(np.int64)), batch.column(1).take(at)], names=["home", "value", "rep"])

    texts = _texts(documents, members.select(F.explode(F.array("home", "rep")).alias("doc_id")).distinct())
    both = members.join(texts.toDF("rep", "tb"), "rep").join(texts.toDF("home", "ta"), "home")
    return both.select("home", "rep", "ta", "tb").mapInArrow(run, "home long, value long, rep long").distinct()


def _homes(live: DataFrame, tried: DataFrame, scratch: Scratch, rounds: int = HOMES) -> DataFrame:
    """(a, b): each document b that has one, with its home a, a document that many like it have.

    At first that is the centre, of those it met, that most documents met. Then all documents of a home move to the home of
    most documents among those that share a list with any of theirs; so what is near one text mostly has one home.
    """
    met = tried.groupBy("a").agg(F.count("*").alias("met"))
    chosen = tried.join(met, "a").groupBy("b").agg(F.max_by("a", F.struct("met", -F.col("a"))).alias("home")).select(F.col("b").alias("rep"), "home")
    homes = scratch.keep(live.select("rep").join(chosen, "rep", "left").select("rep", F.coalesce("home", "rep").alias("home")), "homes0")
    keys = scratch.keep(live.select("rep", F.explode("rarest.key").alias("key")), "keys")
    for k in range(1, rounds + 1):
        sizes = homes.groupBy("home").agg(F.count("*").alias("n"))
        listed = keys.join(homes, "rep").select("key", "home").distinct().join(sizes, "home")
        top = listed.groupBy("key").agg(F.max(F.struct("n", (-F.col("home")).alias("low"))).alias("top"))
        up = listed.join(top, "key").groupBy("home").agg((-F.max("top")["low"]).alias("up"))
        homes = scratch.keep(homes.join(up, "home").select("rep", F.col("up").alias("home")), f"homes{k}")
    return homes.where("home <> rep").select(F.col("home").alias("a"), F.col("rep").alias("b"))


def _sharing(g: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of one home, of other labels, that may share as many gained shingles as they lack for the similarity.

    With ``held`` shingles of its home, a document of ``size`` needs some more in common with another, at least those up to
    the overlap that the similarity asks of its size; so only its rarest gained shingles, all but one less than these, are joined.
    """
    lists = g.groupBy("home", "value").agg(F.count("*").alias("n"), F.min("label").alias("low"), F.max("label").alias("high")).where("low < high").select("home", "value", "n")
    mine = g.join(lists, ["home", "value"]).groupBy("home", "rep", "label", "size", "held").agg(F.sort_array(F.collect_list(F.struct("n", "value"))).alias("all"))
    many = lambda over, under: F.size("all") - F.greatest(F.lit(0), F.ceil(F.col("size") * over / under).cast("int") - F.col("held").cast("int") - 1)
    # the smaller document needs more of itself in common than the larger one
    posts = mine.select("home", "rep", "label", "size", many(2 * percent, 100 + percent).alias("index"), F.slice("all.value", F.lit(1), F.greatest(F.lit(0), many(percent, 100))).alias("values"))
    posts = posts.select("home", "rep", "label", "size", "index", F.posexplode("values").alias("at", "value"))
    x, y = (posts.select("home", "value", *(F.col(c).alias(f"{k}_{c}") for c in ("rep", "label", "size", "index", "at"))) for k in "xy")
    fits = f"(x_size < y_size or x_size = y_size and x_rep < y_rep) and x_label <> y_label and x_at < x_index and 100 * x_size >= {percent} * y_size"
    return x.join(y, ["home", "value"]).where(fits).select(F.least("x_rep", "y_rep").alias("a"), F.greatest("x_rep", "y_rep").alias("b"))


def near_duplicates(documents: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT, coordinates: int = COORDINATES, matches: int = MATCHES) -> DataFrame:
    """doc_id, n_shingles, component_id (the least doc_id that links reach), kept (doc_id = component_id)."""
    scratch = Scratch(documents.sparkSession, "near")
    sigs = scratch.keep(signatures(documents, shingle, coordinates), "signatures")
    known = sigs.where("doc_id is not null and n_shingles > 0")
    key = ["n_shingles", "set_a", "set_b"]
    reps = scratch.keep(known.groupBy(*key).agg(F.min("doc_id").alias("rep"), F.first("signature").alias("signature"), F.first("bytes").alias("bytes")), "reps")

    # sets of n and n + 1 shingles differ too much while 100 n < percent (n + 1)
    least = percent // (100 - percent) + bool(percent % (100 - percent)) if percent < 100 else 1 << 40
    posts = reps.where(F.col("n_shingles") >= least).select("rep", "n_shingles", F.explode(_keys("signature", coordinates)).alias("key"))
    lists = posts.groupBy("key").agg(F.count("*").alias("n"), F.min("rep").alias("centre")).where("n > 1")
    live = posts.join(lists, "key").groupBy("rep").agg(F.first("n_shingles").alias("size"), F.sort_array(F.collect_list(F.struct("n", "key", "centre"))).alias("all")).where(F.size("all") >= matches)
    rarest = F.slice("all", F.lit(1), F.size("all") - (matches - 1))
    live = scratch.keep(live.select("rep", "size", F.size("all").alias("shared"), rarest.alias("rarest")), "live")

    stars = live.select(F.explode(F.array_distinct(F.col("rarest.centre"))).alias("a"), F.col("rep").alias("b")).where("a <> b")
    tried = scratch.keep(stars, "tried")
    chosen = _homes(live, tried, scratch)
    first = scratch.keep(_agreeing(tried, reps, percent, coordinates, matches).unionByName(chosen).distinct(), "first")
    seen = scratch.keep(compared(first, documents, shingle), "seen")
    links = seen.where(_alike(percent)).select("a", "b")
    home = seen.join(chosen, ["a", "b"]).select(F.col("b").alias("rep"), F.col("a").alias("home"), F.col("common").alias("held"))
    alone = live.join(chosen.select(F.col("b").alias("rep")), "rep", "left_anti").select("rep", F.col("rep").alias("home"), F.col("size").alias("held"))
    home = home.unionByName(alone)
    lists = scratch.keep(live.join(home, "rep", "left").select("rep", "size", "shared", "home", "held", F.posexplode("rarest.key").alias("at", "key")), "lists")
    # a document's least partner so far, and that one's: documents of one label are in one component
    ends = F.explode(F.array(F.struct(F.col("a").alias("v"), F.col("b").alias("u")), F.struct(F.col("b").alias("v"), F.col("a").alias("u")))).alias("x")
    near = links.select(ends).groupBy("x.v").agg(F.min("x.u").alias("u")).select("v", F.least("v", "u").alias("u"))
    labels = scratch.keep(near.join(near.toDF("u", "w"), "u", "left").select(F.col("v").alias("rep"), F.coalesce("w", "u").alias("label")), "labels")
    posted = lists.join(labels, "rep", "left").withColumn("label", F.coalesce("label", "rep"))
    mixed = posted.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low < high").select("key")
    lists = scratch.keep(posted.join(mixed, "key"), "mixed")
    scratch.drop("lists")
    x, y = (lists.select("key", *(F.col(c).alias(f"{k}_{c}") for c in ("rep", "size", "shared", "home", "held", "at", "label"))) for k in "xy")
    fits = f"x_rep < y_rep and x_label <> y_label and 100 * least(x_size, y_size) >= {percent} * greatest(x_size, y_size) and least(x_shared - x_at, y_shared - y_at) >= {matches}"
    # two documents of one home that share no shingle beside it share no more than either does with it
    most = "least(x_held, y_held)"
    hopeless = F.coalesce(F.expr(f"x_home = y_home and 100 * {most} < {percent} * (x_size + y_size - {most})"), F.lit(False))
    pairs = x.join(y, "key").where(F.expr(fits) & ~hopeless).select(F.col("x_rep").alias("a"), F.col("y_rep").alias("b"))
    # those that do share one are found by it
    facts = lists.select("rep", "label", "size", "held").distinct()
    g = scratch.keep(gains(lists.where("home <> rep").select("home", "rep").distinct(), documents, shingle).join(facts, "rep"), "gains")
    fresh = pairs.unionByName(_sharing(g, percent)).distinct().join(tried, ["a", "b"], "left_anti")
    fresh = scratch.keep(_agreeing(fresh, reps, percent, coordinates, matches), "fresh")
    links = links.unionByName(scratch.keep(compared(fresh, documents, shingle).where(_alike(percent)).select("a", "b"), "links"))
    labels = components(links, scratch, "end")
    scratch.drop("live", "tried", "keys", *(f"homes{k}" for k in range(HOMES + 1)), "first", "labels", "mixed", "gains", "fresh", "seen", "links")
    joined = reps.join(labels, reps.rep == labels.node, "left").select(*key, F.coalesce("label", "rep").alias("component"))
    out = sigs.select("doc_id", *key).join(joined, key, "left")
    label = F.when(F.col("doc_id").isNull(), None).otherwise(F.coalesce("component", "doc_id"))
    return out.select("doc_id", "n_shingles", label.alias("component_id"), F.coalesce(F.col("doc_id") == label, F.lit(True)).alias("kept"))


ORACLE = r"""
with recursive w as (
  select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as ws from documents),
s as (
  select distinct doc_id, unnest(case when len(ws) = 0 then [] when len(ws) < 5 then [array_to_string(ws, ' ')]
    else list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i+4], ' ')) end) as sh from w),
n as (select w.doc_id, count(s.sh) as n from w left join s using (doc_id) group by 1),
inter as (
  select x.doc_id as a, y.doc_id as b, count(*) as i from s x join s y on x.sh = y.sh and x.doc_id < y.doc_id group by 1, 2),
links as (
  select a, b from inter join n na on na.doc_id = a join n nb on nb.doc_id = b where 100 * i >= 85 * (na.n + nb.n - i)),
e as (select a, b from links union all select b, a from links),
reach(doc_id, r) as (
  select doc_id, doc_id from n union select reach.doc_id, e.b from reach join e on e.a = reach.r)
select n.doc_id, cast(n.n as bigint) as n_shingles, min(r) as component_id, n.doc_id = min(r) as kept
from n join reach using (doc_id) group by n.doc_id, n.n
"""
