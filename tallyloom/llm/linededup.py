"""Lines whose words are nearly those of an earlier line, by an exact set-similarity join.

A line is the set of its lower-cased words. Its words are ordered by rarity in the corpus, rarest
first; two lines with a Jaccard similarity of ``percent`` / 100 must share a word among the first
few of both (the longer line's probing prefix and the shorter line's indexing prefix). Lines are
joined on these words. A pair stays a candidate if the sizes allow the similarity (length filter)
and if the words after the shared one are enough for it (positional filter) and the sets' parities, 128
bits each (64 of small sets), differ in no more bits than the sets may in words; candidates are
verified on the full sets. A line is removed if its set equals that of an earlier line or is as
similar as asked to one, "earlier" by doc_id and then line number.

A line goes for one earlier match, so not all of its matches are looked for. Before the join, lines that share two
neighbouring words of their prefixes are compared with a few of the earliest lines that have these two; a line that this
removes asks no more in the join, though others may still match it. Of n lines made from one template, nearly all
are compared with these alone. Lines of a small vocabulary that are not similar still meet in the lists of its words: their join rows
grow with the square of the lines before the parities drop them.

Rarity is the count of a word's bucket of ``BUCKETS``: it orders, so that a shared bucket costs time and
no match. Prefixes are joined on 32-bit hashes and verified on 64-bit ones. Only DataFrame functions are used. Equal
sets are one class before the join, so groups of copies of a line cost a row for each.

Results for odd input: null texts have no line and stay null; lines without a word are never
removed; a null doc_id sorts first, together with -2**63. Rows that repeat a doc_id count as one document, line by line, so lines
of the same number in both are not later than each other, and what is removed of one is of the other. Other columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._util import BROADCAST_ROWS, Scratch, small

PERCENT, BUCKETS, SPREAD = 80, 1 << 17, 24
#: Stands for a null doc_id.
LOWEST = -(1 << 63)
LINES = 1 << 31
#: White space but the space and the line feed.
SPACES = "\t\x0b\x0c\r"
#: Sets of at least so many words have 128 bits of parity, smaller ones have them folded into 64: all in the second half.
LONG = 64
KEY, PLACE, PARITY = ["id", "id2", "size"], ["doc", "line_no"], ["low", "high"]


def _spaced(rows: DataFrame, column: str) -> DataFrame:
    """The rows with a text in lower case, with spaces for other white space than line feeds."""
    low = rows.withColumn(column, F.lower(column))
    # each looks for one byte, which is cheaper than a pattern
    odd = reduce(Column.__or__, (F.contains(F.col(column), F.lit(c)) for c in SPACES))
    return low.withColumn(column, F.when(odd, F.translate(column, SPACES, " " * len(SPACES))).otherwise(F.col(column)))


def _texts(documents: DataFrame) -> DataFrame:
    return documents.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LOWEST)).alias("doc"), F.col("text").cast("string").alias("text"))


def _lines(documents: DataFrame) -> DataFrame:
    """doc, line_no and line, in lower case and with spaces only."""
    return _spaced(_texts(documents), "text").select("doc", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))


def _hashed(lines: DataFrame) -> DataFrame:
    """doc, line_no, size (distinct words), id and id2 (of the set), hashes (of the words, ascending); no lines without a word."""
    hashed = F.array_distinct(F.transform(F.split("line", " "), lambda w: F.xxhash64(w)))
    # a filter on the hashes would compute them twice
    sets = lines.where(F.trim("line") != "").select(*PLACE, F.sort_array(F.array_remove(hashed, F.xxhash64(F.lit("")))).alias("hashes"))
    return sets.select(*PLACE, F.size("hashes").alias("size"), F.xxhash64("hashes").alias("id"), F.xxhash64(F.lit(1), "hashes").alias("id2"), "hashes")


def _levels(lines: DataFrame, scratch: Scratch) -> DataFrame:
    """One row: for every bucket of words a level of frequency, 0 to 127, in the upper byte of a number."""
    counts = lines.select(F.explode("words").alias("word")).groupBy(F.col("word").bitwiseAND(F.lit(BUCKETS - 1)).alias("bucket")).agg(F.count("*").alias("n"))
    every = lines.sparkSession.range(0, BUCKETS, 1, 1).select(F.col("id").cast("int").alias("bucket"))
    level = F.shiftleft(F.least(F.lit(127), F.floor(4 * F.log2(1 + F.coalesce("n", F.lit(0))))).cast("int"), 24).alias("level")
    one = every.join(counts, "bucket", "left").select("bucket", level).agg(F.sort_array(F.collect_list(F.struct("bucket", "level"))).alias("x"))
    return scratch.keep(one.select(F.col("x.level").alias("levels")), "levels")


def _ceil(a: Column, b: int) -> Column:
    return F.floor((a + (b - 1)) / b).cast("int")


def _place(column: str, prefix: str = "") -> list[Column]:
    """doc and line_no of a place."""
    line_no = F.col(column) % F.lit(LINES).cast("decimal(10,0)")
    doc = ((F.col(column) - line_no) / F.lit(LINES).cast("decimal(10,0)")).cast("decimal(20,0)") + F.lit(LOWEST).cast("decimal(20,0)")
    return [doc.cast("long").alias(f"{prefix}doc"), line_no.cast("int").alias(f"{prefix}line_no")]


def _classes(lines: DataFrame, levels: DataFrame, percent: int) -> DataFrame:
    """A row for each set: its first place, n (lines that have it), parity (low, high), and prefix (probing; null if nothing else can be similar)."""
    n = F.col("size")
    probe = n - _ceil(n * percent, 100) + 1
    # the smallest sets that can have a similar, unequal one: n of n + 1
    least = -(-percent // (100 - percent)) if percent < 100 else 1 << 30
    # level of frequency in the upper byte, then the word's hash; words of the same number are as good as one word that occurs twice. Words and
    # levels are used here only, so that Spark puts both steps into one: as a column of a step of its own, the levels would be copied for every line
    ranked = F.expr(f"transform(words, w -> get(levels, w & {BUCKETS - 1}) | shiftrightunsigned(w, 8))")
    rows = lines.select(*PLACE, *KEY, "words", levels.scalar().alias("levels")).select(*PLACE, *KEY, F.sort_array(ranked).alias("ranked"))
    prefix = F.when(n >= least, F.slice("ranked", F.lit(1), probe)).alias("prefix")
    # a bit for each of 128 parts of the words: of all of them folded into 64, and of one half of them for large sets
    fold = F.expr("aggregate(ranked, 0L, (x, w) -> x ^ shiftleft(1L, w))")
    half = F.when(n >= LONG, F.expr("aggregate(ranked, 0L, (x, w) -> if(w & 64 = 0, x ^ shiftleft(1L, w), x))")).otherwise(F.lit(0).cast("long"))
    rows = rows.select("*", F.when(n >= least, fold).alias("fold"), F.when(n >= least, half).alias("low"))
    parity = [F.col("low"), F.col("fold").bitwiseXOR(F.col("low")).alias("high")]
    # places as one number: what is added up in a hash table has a fixed width
    place = ((F.col("doc").cast("decimal(20,0)") - F.lit(LOWEST).cast("decimal(20,0)")) * F.lit(LINES).cast("decimal(10,0)") + F.col("line_no")).cast("decimal(38,0)")
    sets = rows.select(*KEY, prefix, *parity, place.alias("place")).groupBy(*KEY, "prefix", *PARITY).agg(F.min("place").alias("place"), F.count("*").alias("n"))
    return sets.select("place", *_place("place"), *KEY, "n", *PARITY, "prefix")


def _need(percent: int) -> str:
    """Words that a and b must have in common."""
    return f"floor(({percent} * (a_size + b_size) + {99 + percent}) / {100 + percent})"


def _fits(percent: int) -> str:
    """Sizes a.size and b.size, and parities: words in one set only turn a bit of the parities each, so the sets differ by as many at least as bits do."""
    bits = f"if(least(a_size, b_size) >= {LONG}, bit_count(a_low ^ b_low) + bit_count(a_high ^ b_high), bit_count(a_low ^ a_high ^ b_low ^ b_high))"
    return f"100 * least(a_size, b_size) >= {percent} * greatest(a_size, b_size) and {bits} <= a_size + b_size - 2 * {_need(percent)}"


def _similar(pairs: DataFrame, documents: DataFrame, percent: int, scratch: Scratch, name: str) -> DataFrame:
    """Of pairs of places (a earlier than b), the b's that have a similar a: (doc, line_no). Sets are made anew from the lines' texts."""
    pairs = scratch.keep(pairs.distinct(), f"{name}-pairs")
    places = pairs.select(F.explode(F.array(*(F.struct(F.col(f"{k}_doc").alias("doc"), F.col(f"{k}_line_no").alias("line_no")) for k in "ab"))).alias("x")).select("x.*").distinct()
    places = scratch.keep(places, f"{name}-places")
    docs = places.select("doc").distinct()
    texts = _texts(documents)
    if docs.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        texts = texts.join(F.broadcast(docs), "doc", "left_semi")
    # the lines are chosen before anything else is done to them
    lines = texts.select("doc", F.posexplode(F.split("text", "\n")).alias("line_no", "line")).join(small(places), PLACE, "left_semi")
    sets = scratch.keep(_hashed(_spaced(lines, "line")).select(*PLACE, "hashes"), f"{name}-sets")
    for k in "ab":
        pairs = pairs.join(sets.toDF(f"{k}_doc", f"{k}_line_no", f"{k}_hashes"), [f"{k}_doc", f"{k}_line_no"])
    pairs = pairs.withColumn("both", F.size(F.array_intersect("a_hashes", "b_hashes"))).where(f"100 * both >= {percent} * (size(a_hashes) + size(b_hashes) - both)")
    out = scratch.keep(pairs.select(F.col("b_doc").alias("doc"), F.col("b_line_no").alias("line_no")).distinct(), name)
    scratch.drop(f"{name}-pairs", f"{name}-places", f"{name}-sets")
    return out


def _starred(classes: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """Pairs of each class and up to ``SPREAD`` earlier ones that have the same two neighbouring words at the start, the middle or the end of its prefix.

    These are the earliest of each hash class of places, so a class has more than one chance to meet a similar one.
    """
    m = F.size("prefix")
    ends = F.array_distinct(F.array(F.lit(0), F.floor((m - 2) / 2).cast("int"), m - 2))
    keys = F.transform(F.filter(ends, lambda i: i >= 0), lambda i: F.xxhash64(F.get("prefix", i), F.get("prefix", i + 1)))
    posts = classes.where("prefix is not null").select("place", "size", *PARITY, F.explode(F.when(m < 2, F.array(F.xxhash64(F.get("prefix", F.lit(0))))).otherwise(keys)).alias("key"))
    many = scratch.keep(posts.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key"), "many")
    shared = scratch.keep(posts.join(small(many), "key"), "shared")
    of = lambda k: [F.col(c).alias(f"{k}_{c}") for c in ("place", "size", *PARITY)]
    centres = shared.groupBy("key", F.pmod(F.xxhash64("place"), F.lit(SPREAD)).alias("part")).agg(F.min("place").alias("a_place"))
    met = shared.select("key", *of("b")).join(centres.select("key", "a_place"), "key").where("a_place < b_place").drop("key").distinct()
    met = met.join(shared.select(*of("a")).distinct(), "a_place").where(_fits(percent))
    return met.select(*_place("a_place", "a_"), *_place("b_place", "b_"))


def _joined(classes: DataFrame, resolved: DataFrame, percent: int) -> DataFrame:
    """Candidates (a earlier than b) for the classes that are not resolved, by their prefixes."""
    n = F.col("size")
    index = n - _ceil(n * (2 * percent), 100 + percent) + 1
    rows = classes.where("prefix is not null").join(small(resolved.withColumn("resolved", F.lit(True))), PLACE, "left")
    posts = rows.select(*PLACE, "size", *PARITY, F.col("resolved").isNull().cast("int").alias("asks"), index.alias("index"), F.posexplode("prefix").alias("pos", "token"))
    # at: the position, four times, 2 more if the class asks and 1 more if the word is in the indexing prefix
    at = (4 * F.col("pos") + 2 * F.col("asks") + (F.col("pos") < F.col("index")).cast("int"))
    # one exchange for both sides: what can't be null has no filter that is put below the exchange on one side only, nor has what compares with rand()
    columns = [*PLACE, "size", *PARITY, "at"]
    posts = posts.withColumn("at", at).select(*(F.coalesce(c, F.lit(0)).alias(c) for c in ("token", *columns))).repartition("token")
    # the smaller set of a pair, or the earlier of equal sizes, has the word in its indexing prefix
    a = posts.where("(at & 1) > rand()").select("token", *(F.col(c).alias(f"a_{c}") for c in columns))
    both = posts.select("token", *(F.col(c).alias(f"b_{c}") for c in columns)).join(a, "token")
    earlier = "(a_doc < b_doc or (a_doc = b_doc and a_line_no < b_line_no))"
    both = both.where(f"(a_size < b_size or (a_size = b_size and (b_at & 1) = 1 and {earlier})) and {_fits(percent)}")
    both = both.where(f"(if({earlier}, b_at, a_at) & 2) = 2 and least(a_size - shiftright(a_at, 2), b_size - shiftright(b_at, 2)) >= {_need(percent)}")
    swap = lambda x, y: [F.when(F.expr(earlier), F.col(f"{x}_{c}")).otherwise(F.col(f"{y}_{c}")).alias(f"{x}_{c}") for c in PLACE]
    return both.select(*swap("a", "b"), *swap("b", "a"))


def removed_lines(documents: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(doc_id, line_no) of every line that an earlier one makes superfluous."""
    scratch = Scratch(documents.sparkSession, "lines")
    words = F.transform("hashes", lambda h: F.shiftright(h, 32).cast("int")).alias("words")
    full = scratch.keep(_hashed(_lines(documents)).select(*PLACE, *KEY, words), "full")
    classes = scratch.keep(_classes(full, _levels(full, scratch), percent), "classes")
    lines = scratch.keep(full.select(*PLACE, *KEY), "lines")
    scratch.drop("full", "levels")
    scratch.release()

    first = _similar(_starred(classes, percent, scratch), documents, percent, scratch, "starred")
    scratch.drop("shared", "many")
    scratch.release()
    second = _similar(_joined(classes, first, percent), documents, percent, scratch, "joined")
    scratch.release()
    gone = first.unionByName(second).distinct().withColumn("gone", F.lit(True))
    # classes of several lines, and those that go; a place that several rows share goes in all of them
    marked = classes.select(*PLACE, *KEY, "n").join(small(gone), PLACE, "left").where("n > 1 or gone")
    marked = scratch.keep(marked.select(*KEY, F.col("doc").alias("first_doc"), F.col("line_no").alias("first_line"), F.coalesce("gone", F.lit(False)).alias("gone")), "marked")
    out = lines.join(small(marked), KEY).where("gone or not (doc = first_doc and line_no = first_line)")
    out = scratch.keep(out.select(F.when(F.col("doc") != LOWEST, F.col("doc")).alias("doc_id"), "line_no").distinct(), "removed")
    scratch.drop("classes", "lines", "starred", "joined", "marked")
    return out


def deduplicate(documents: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The documents with the text that is left and what was removed: all their columns, then line_numbers (array) and rest (string).

    A text of which every line goes is empty.
    """
    gone = removed_lines(documents, percent).groupBy("doc_id").agg(F.sort_array(F.collect_list("line_no")).alias("line_numbers"))
    mine = documents.select(F.struct(*documents.columns).alias("row"), F.col("doc_id").cast("long").alias("doc_id"))
    both = mine.join(small(gone.withColumnRenamed("doc_id", "id")), F.col("doc_id").eqNullSafe(F.col("id")), "left")
    lines = F.split(F.col("row.text").cast("string"), "\n")
    left = F.array_join(F.filter(lines, lambda x, i: ~F.coalesce(F.array_contains("line_numbers", i), F.lit(False))), "\n")
    return both.select("row", F.coalesce("line_numbers", F.array().cast("array<int>")).alias("line_numbers"), F.when(F.col("line_numbers").isNull(), F.col("row.text").cast("string")).otherwise(left).alias("rest"))


def digests(documents: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_lines, n_removed and removed (line numbers, comma-joined) of every row."""
    gone = removed_lines(documents, percent).groupBy("doc_id").agg(F.count("*").alias("n_removed"), F.array_join(F.sort_array(F.collect_list("line_no")), ",").alias("removed"))
    n_lines = F.coalesce(F.size(F.split(F.col("text").cast("string"), "\n")), F.lit(0)).cast("long").alias("n_lines")
    mine = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.when(F.col("text").isNull(), F.lit(0).cast("long")).otherwise(n_lines).alias("n_lines"))
    both = mine.join(gone.withColumnRenamed("doc_id", "id"), F.col("doc_id").eqNullSafe(F.col("id")), "left")
    return both.select("doc_id", "n_lines", F.coalesce("n_removed", F.lit(0).cast("long")).alias("n_removed"), F.coalesce("removed", F.lit("")).alias("removed"))


ORACLE = r"""
with l as (
  select doc_id, unnest(string_split(text, chr(10))) as line, unnest(range(len(string_split(text, chr(10))))) as line_no from documents where text is not null),
t as (
  select doc_id, line_no, list_sort(list_distinct(list_filter(regexp_split_to_array(lower(line), '[\x20\x09-\x0D]+'), lambda w: w <> ''))) as ws from l),
c as (select ws, len(ws) as n, min((doc_id, line_no)) as f from t where len(ws) > 0 group by ws),
g as (
  select distinct y.ws from c x join c y on x.f < y.f and 100 * least(x.n, y.n) >= 80 * greatest(x.n, y.n)
    and 180 * len(list_intersect(x.ws, y.ws)) >= 80 * (x.n + y.n)),
r as (
  select t.doc_id, t.line_no from t join c on t.ws = c.ws where (t.doc_id, t.line_no) <> c.f or t.ws in (select ws from g)),
k as (select doc_id, count(*) as n_removed, string_agg(cast(line_no as varchar), ',' order by line_no) as removed from r group by 1)
select d.doc_id, cast(case when text is null then 0 else len(string_split(text, chr(10))) end as bigint) as n_lines, coalesce(n_removed, 0) as n_removed, coalesce(removed, '') as removed
from documents d left join k on d.doc_id = k.doc_id
"""
