"""WARC archives: writing with revisit records, and reading by boundary-chain verification.

Writing. Equal payloads are found by their SHA-1; of each group the record with the least page_id is a
response, the others are revisits that refer to it. Each task writes one archive through Spark's text
writer, so archives can go to any file system, and a lost task is simply run again.

Reading. An archive is cut at every "WARC/1." with Spark's text reader, in splits, so archives of any size
are read in parallel; the pieces are kept, as a second reading may be split otherwise. A piece is a candidate record: its header gives the length of its block and
so its successor's offset. Payloads may hold the same characters, so not every candidate is a record. Records are what the
chain of successors reaches from the file's start; it is followed by pointer jumping: in each round every
reached offset also reaches its pointer's target, then all pointers double their reach, so a file of n
records takes log2(n) rounds. A record's bytes are then put together from its pieces.

Results for odd input: a null html is an empty payload; rows without page_id are written with an id of
"-" and are read back with a null page_id; they are revisits of an equal payload with an id. Rows that repeat a page_id are each
written; each that has the group's least page_id is a response. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._util import Scratch, small

MAGIC = "WARC/1."
END = "\r\n\r\n"
#: Payloads of fewer bytes are written again, not referred to.
LEAST = 0


def digest(payload: Column) -> Column:
    """Upper-case base32 of the payload's SHA-1: five hex digits are four of base 32."""
    hexed = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(hexed, 5 * k + 1, 5), 16, 32), 4, "0") for k in range(8)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def records(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """page_id, url, payload, digest, bytes and refers_to (null: a response) of every row."""
    payload = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumn("digest", digest(F.col("payload").cast("binary"))).withColumn("bytes", F.octet_length("payload").cast("long"))
    many = rows.where(F.col("bytes") >= least).groupBy("digest").agg(F.min("page_id").alias("first_id"), F.count("*").alias("n")).where("n > 1")
    out = rows.join(small(many.select(F.col("digest").alias("d"), "first_id")), rows.digest == F.col("d"), "left")
    first = F.col("d").isNull() | F.col("page_id").eqNullSafe(F.col("first_id"))
    return out.select("page_id", "url", "payload", "digest", "bytes", F.when(first, None).otherwise(F.coalesce(F.col("first_id").cast("string"), F.lit("-"))).alias("refers_to"))


def write(pages: DataFrame, path: str, least: int = LEAST) -> None:
    """Writes a record for each row into archives below path."""
    r = records(pages, least)
    name = F.coalesce(F.col("page_id").cast("string"), F.lit("-"))
    uri = F.regexp_replace(F.coalesce("url", F.lit("")), "[\\x00-\\x20]", "")
    revisit = F.col("refers_to").isNotNull()
    head = [
        F.lit("1"),
        F.concat(F.lit("WARC-Type: "), F.when(revisit, "revisit").otherwise("response")),
        F.concat(F.lit("WARC-Record-ID: <urn:page:"), name, F.lit(">")),
        F.concat(F.lit("WARC-Target-URI: "), uri),
        F.lit("WARC-Date: 2024-01-01T00:00:00Z"),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), "digest"),
        F.concat(F.lit("WARC-Payload-Length: "), F.col("bytes").cast("string")),
        F.when(revisit, F.concat(F.lit("WARC-Refers-To: <urn:page:"), "refers_to", F.lit(">"))),
        F.when(revisit, F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        F.lit("Content-Type: text/html; charset=utf-8"),
        F.concat(F.lit("Content-Length: "), F.when(revisit, F.lit("0")).otherwise(F.col("bytes").cast("string"))),
    ]
    text = F.concat(F.lit(MAGIC), F.concat_ws("\r\n", *head), F.lit(END), F.when(revisit, F.lit("")).otherwise(F.col("payload")))
    r.select(text.alias("value")).write.mode("overwrite").option("lineSep", END).text(path)


def pieces(spark: SparkSession, path: str) -> DataFrame:
    """file, split, nth (ascending in a split), size, whole (bytes of the record that begins here, if it does) and text: what
    stands behind each "WARC/1.", up to the next, in all archives below path.

    Another reading may cut the files into other splits, so nth holds for this one only: keep the table, don't compute it again.
    """
    read = spark.read.option("lineSep", MAGIC).option("pathGlobFilter", "*.txt").text(path)
    head = F.split("text", END, 2)
    length = F.regexp_extract(F.concat(F.lit("\r\n"), head[0], F.lit("\r\n")), r"(?i)\r\ncontent-length:[ \t]*(\d{1,18})[ \t]*\r\n", 1)
    sound = F.col("text").rlike(r"^\d\r\n") & (F.size(head) == 2) & (length != "")
    whole = len(MAGIC) + F.octet_length(head[0]) + len(END) + length.try_cast("long") + len(END)
    meta = [F.col(f"_metadata.{a}").alias(b) for a, b in (("file_path", "file"), ("file_block_start", "split"))]
    rows = read.select(*meta, F.monotonically_increasing_id().alias("nth"), F.col("value").alias("text"))
    return rows.select("file", "split", "nth", (F.octet_length("text").cast("long") + len(MAGIC)).alias("size"), F.when(sound, whole).alias("whole"), "text")


def candidates(cut: DataFrame) -> DataFrame:
    """file, split, nth, at (offset), next (the successor's offset; null if the piece is no sound record head) of pieces.

    Offsets are sums of lengths: of the pieces before it in its split, and of the splits before that.
    """
    cut = cut.select("file", "split", "nth", "size", "whole")
    till = F.sum("size").over(Window.partitionBy("file", "split").orderBy("nth"))
    totals = cut.groupBy("file", "split").agg(F.sum("size").alias("total"))
    bases = totals.select("file", "split", (F.sum("total").over(Window.partitionBy("file").orderBy("split")) - F.col("total")).alias("base"))
    # the lengths count a magic behind every piece; the file's first piece, which is empty in a sound archive, has none before it
    at = F.col("base") + F.col("till") - F.col("size") - len(MAGIC)
    placed = cut.withColumn("till", till).join(small(bases), ["file", "split"]).withColumn("at", at).where("at >= 0")
    return placed.select("file", "split", "nth", "at", (F.col("at") + F.col("whole")).alias("next"))


def true_offsets(candidates: DataFrame, scratch: Scratch) -> DataFrame:
    """(file, at) of the candidates (file, at, next) that the chain of successors from offset 0 reaches."""
    table = scratch.keep(candidates.withColumn("reached", F.col("at") == 0), "jumps0")
    had, step = -1, 0
    while True:
        known, every = table.agg(F.count_if("reached"), F.count("*")).first()
        if known in (had, every):
            return table.where("reached").select("file", "at")
        had, step = known, step + 1
        targets = table.where("reached").select("file", F.col("next").alias("at"), F.lit(True).alias("hit")).distinct()
        onward = table.select("file", F.col("at").alias("next"), F.col("next").alias("further"))
        # a pointer that leads to no candidate stays
        both = table.join(targets, ["file", "at"], "left").join(onward, ["file", "next"], "left")
        table = scratch.keep(both.select("file", "at", F.coalesce("further", "next").alias("next"), (F.col("reached") | F.coalesce("hit", F.lit(False))).alias("reached")), f"jumps{step}")
        scratch.drop(f"jumps{step - 1}")


def chain(spark: SparkSession, path: str, scratch: Scratch) -> DataFrame:
    """file and text of every true record of the archives below path, put together from its pieces.

    The archives are read once. Their pieces are kept; offsets alone are shuffled, and so are the texts of records of several pieces.
    """
    cut = scratch.keep(pieces(spark, path), "pieces", compression="zstd")
    placed = scratch.keep(candidates(cut), "placed")
    found = true_offsets(placed.where("next is not null").select("file", "at", "next"), scratch)
    marked = placed.select("file", "split", "nth", "at").join(found.withColumn("reached", F.lit(True)), ["file", "at"], "left")
    # other pieces belong to the last record before them, in their split or in an earlier one
    last = F.max(F.when(F.col("reached"), F.col("at")))
    earlier = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    carried = marked.groupBy("file", "split").agg(last.alias("last")).select("file", "split", F.max("last").over(earlier).alias("carried"))
    mine = last.over(Window.partitionBy("file", "split").orderBy("at"))
    owned = marked.withColumn("mine", mine).join(small(carried), ["file", "split"]).select("file", "nth", "at", F.coalesce("mine", "carried").alias("owner"))
    owned = scratch.keep(owned, "owned")
    # most pieces are a record each: only the others are looked up
    torn = scratch.keep(owned.where("at <> owner").select("file", "owner").distinct(), "torn")
    parts = scratch.keep(owned.join(small(torn), ["file", "owner"], "left_semi").select("nth", "owner", "at"), "parts")
    strange = parts.select("nth").unionByName(owned.where("owner is null").select("nth"))
    # what stands before a file's first magic is in no record
    whole = cut.join(small(strange.unionByName(cut.join(placed, "nth", "left_anti").select("nth"))), "nth", "left_anti").select("file", "text")
    joined = cut.join(small(parts), "nth").groupBy("file", "owner").agg(F.sort_array(F.collect_list(F.struct("at", "text"))).alias("parts"))
    return whole.unionByName(joined.select("file", F.array_join("parts.text", MAGIC).alias("text")))


def parse(found: DataFrame) -> DataFrame:
    """page_id, uri, record_type, payload_bytes, payload_digest, refers_to and the payload of every record."""
    head = F.concat(F.lit("\r\n"), F.split("text", END, 2)[0], F.lit("\r\n"))

    def field(name: str, value: str = r"([^\r\n]*)") -> Column:
        return F.regexp_extract(head, rf"(?i)\r\n{name}:[ \t]*{value}", 1)

    # the payload's length is in bytes
    payload = F.expr(f"substring(cast(text as binary), octet_length(split(text, '\\r\\n\\r\\n', 2)[0]) + {len(END)} + 1, coalesce(try_cast(n as int), 0))")
    rows = found.select("text", field("content-length", r"(\d+)").alias("n"), field("warc-type").alias("record_type"), field("warc-record-id", "<urn:page:([^>]*)>").alias("id"), field("warc-refers-to", "<urn:page:([^>]*)>").alias("to"), field("warc-payload-length", r"(\d+)").alias("said"), field("warc-payload-digest", "sha1:([A-Z2-7]*)").alias("said_digest"), field("warc-target-uri").alias("uri"))
    rows = rows.withColumn("payload", payload)
    response = F.col("record_type") == "response"
    return rows.select(F.expr("try_cast(id as bigint)").alias("page_id"), "uri", F.when(response, F.octet_length("payload").cast("long")).otherwise(F.expr("try_cast(said as bigint)")).alias("payload_bytes"), F.when(response, digest(F.col("payload"))).otherwise(F.col("said_digest")).alias("payload_digest"), "record_type", F.when(F.col("record_type") == "revisit", F.expr("try_cast(`to` as bigint)")).alias("refers_to"), "payload")


def round_trip(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """Writes the archives, reads them back: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    scratch = Scratch(pages.sparkSession, "warc")
    write(pages, scratch.path("archives"), least)
    return parse(chain(pages.sparkSession, scratch.path("archives"), scratch)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = r"""
with p as (select page_id, coalesce(html, '') as payload from pages),
h as (select page_id, payload, strlen(payload) as payload_bytes, sha1(payload) as hx from p),
d as (select *, (select string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + (v // cast(32 ** k as bigint)) % 32, 1), '' order by g, k desc)
    from (select g, k, cast(('0x' || substr(hx, 5 * g + 1, 5)) as bigint) as v from range(8) a(g), range(4) b(k))) as payload_digest from h),
f as (select payload_digest, min(page_id) as first from d group by 1)
select page_id, cast(payload_bytes as bigint) as payload_bytes, payload_digest,
  case when page_id = first then 'response' else 'revisit' end as record_type, case when page_id <> first then first end as refers_to
from d join f using (payload_digest)
"""
