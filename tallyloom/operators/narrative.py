"""Pages of prose: page types, sections, chunks, ranking; and the insights drawn from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import chunks, found_in, narrative_density, normalize_text, once, table_density
from ..plans import dims


def page_type(text: Column, prose: Column | None = None, table: Column | None = None) -> Column:
    """P10: page_type and confidence: what the heading says first, then how much of the page is prose or table (computed here, or given)."""
    prose, table = narrative_density(text) if prose is None else prose, table_density(text) if table is None else table
    page = F.struct(normalize_text(F.substr(text, F.lit(1), F.lit(1200))).alias("heading"), prose.alias("prose"), table.alias("table"), F.lower(text).rlike("[a-z0-9&]").alias("filled"))

    def kind_of(p: Column) -> Column:
        said = lambda phrases: p["heading"].rlike("|".join(phrases))
        ladder = [(said(phrases), kind, sure) for kind, sure, phrases in dims.PAGE_TYPES]
        ladder += by_density(said(dims.NARRATIVE_HEADINGS), p["prose"], p["table"])
        found = F.coalesce(*[F.when(test, F.struct(F.lit(kind).alias("page_type"), F.lit(sure).alias("confidence"))) for test, kind, sure in ladder], F.struct(F.lit("unknown").alias("page_type"), F.lit(0.35).alias("confidence")))
        return F.when(~F.coalesce(p["filled"], F.lit(False)), F.struct(F.lit("unknown").alias("page_type"), F.lit(0.0).alias("confidence"))).otherwise(found)

    return once(page, kind_of)


def by_density(narrative: Column, prose: Column, table: Column) -> list[tuple[Column, str, float]]:
    """P10: what a page is, and how sure that is, where its heading names no type; ``narrative`` is whether it is one of prose."""
    return [(narrative & (prose >= 0.35), "narrative", 0.8), ((table >= 0.55) & (prose < 0.45), "table_heavy", 0.8), ((prose >= 0.55) & (table < 0.45), "narrative", 0.65)]


def continued(pages: DataFrame, budget: int = 3, sure: float = 0.85) -> DataFrame:
    """A section goes on over later pages while none is blocked: islands that accepted starts open.

    pages: report_id, page_number, direct (section found on the page), accepted, confidence, terminal, fits.
    """
    w = Window.partitionBy("report_id").orderBy("page_number")
    start = F.col("direct").isNotNull() & F.col("accepted")
    p = pages.withColumn("start", start).withColumn("island", F.sum(start.cast("int")).over(w))
    i = Window.partitionBy("report_id", "island").orderBy("page_number")
    p = p.withColumn("idx", F.row_number().over(i) - 1)
    blocked = ~F.col("start") & (F.col("terminal") | ~F.col("fits") | F.col("direct").isNotNull() | ((F.col("idx") > budget) & (F.col("confidence") < sure)))
    p = p.withColumn("stopped", F.sum(blocked.cast("int")).over(i))
    section = F.when((F.col("island") > 0) & (F.col("stopped") == 0), F.first("direct").over(i))
    return p.select("report_id", "page_number", section.alias("section"))


def chunked(pages: DataFrame, most: int = dims.CHUNK_CHARACTERS, overlap: int = dims.CHUNK_OVERLAP) -> DataFrame:
    """A row for each chunk."""
    return pages.select(*[c for c in pages.columns if c != "text"], F.posexplode(chunks(F.col("text"), most, overlap)).alias("chunk_index", "text"))


def chunk_score(text: Column, section: Column, metrics: tuple[str, ...] = ()) -> Column:
    """T13."""
    weight = F.coalesce(*[F.when(section == k, v) for k, v in dims.SECTION_WEIGHTS.items()], F.lit(1.0))
    low = F.lower(text)
    score = weight + 2.0 * F.size(found_in(low, dims.KEYWORDS))
    for m in metrics:
        score = score + F.when(low.contains(m.replace("_", " ")) | low.contains(m), 1.5).otherwise(0.0)
    return score


def round_robin(rows: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """The best of each section, then the second best of each, and so on. rows: source_section, score and the order's columns."""
    rank = F.coalesce(*[F.when(F.col("source_section") == s, i) for i, s in enumerate(dims.SECTIONS)], F.lit(len(dims.SECTIONS)))
    turn = F.row_number().over(Window.partitionBy(*group, "source_section").orderBy(F.desc("score"), *order))
    r = rows.withColumn("turn", turn).withColumn("section_rank", rank)
    return r.withColumn("position", F.row_number().over(Window.partitionBy(*group).orderBy("turn", "section_rank", "source_section", *order)))


def quantified(text: Column) -> Column:
    """P15. Words of one piece stand in the lower-cased text as they do in the normalized one, which is made only if none is there."""
    words = [p for p in dims.QUANTITATIVE if " " not in p]
    phrases = [p for p in dims.QUANTITATIVE if " " in p]
    said = once(F.lower(text), lambda t: F.exists(F.array(*map(F.lit, words)), lambda p: F.contains(t, p)))
    amount = text.rlike(r"(?i)(?:rs\.?|pkr|usd|\$)\s*[0-9]") | text.rlike(r"[0-9][0-9,]*(?:\.[0-9]+)?\s*%")
    return text.rlike("[0-9]") & (said | amount | (F.size(found_in(normalize_text(text, "%$"), phrases)) > 0))


def generic_phrases(text: Column) -> Column:
    """What a text has of them, joined; only texts with the longest word of one are normalized."""
    norm = [" ".join("".join(x if x.isalnum() or x in "%$" else " " for x in p.replace("&", " and ")).split()) for p in dims.GENERIC]
    hints = sorted({max(p.split(), key=len) for p in norm})
    may = once(F.lower(text), lambda t: F.exists(F.array(*map(F.lit, hints)), lambda p: F.contains(t, p)))
    return F.when(F.coalesce(may, F.lit(False)), F.array_join(found_in(normalize_text(text, "%$"), norm), "|")).otherwise("")


def governed(insights: DataFrame) -> DataFrame:
    """Route, reason, and what they rest on."""
    text = F.concat_ws(" ", "area", "takeaway")
    c = F.col("confidence")
    i = insights.withColumn("quantified", quantified(text)).withColumn("patterns", generic_phrases(text))
    # the phrases decide few routes; they are looked for again there, so that who asks for the route alone has them only of those
    generic = ~F.col("quantified") & (c < dims.REVIEW_BELOW) & (generic_phrases(text) != "")
    low, q = c < dims.REJECT_BELOW, F.col("quantified")
    reason = F.when(generic, "generic_low_confidence_without_quantitative_evidence").when(low & q, "low_confidence_quantified_safety_review").when(low, "confidence_below_reject_threshold").when(c < dims.REVIEW_BELOW, "confidence_review_bucket").otherwise("confidence_export_threshold")
    route = F.when((low & ~q) | generic, "reject").when(c < dims.REVIEW_BELOW, "review").otherwise("export")
    return i.withColumn("route", route).withColumn("reason", reason)


def bucket(c: Column) -> Column:
    """Q15: what lies between 0 and 0.1 counts with what follows."""
    return F.when(c == 0, "0.0").when(c >= 0.9, "0.9+").when(c >= 0.7, "0.7-0.9").when(c >= 0.5, "0.5-0.7").otherwise("0.1-0.5")


def histogram(insights: DataFrame) -> DataFrame:
    """A5: counts of all five buckets, zeros too."""
    every = insights.sparkSession.createDataFrame([(b,) for b in ("0.0", "0.1-0.5", "0.5-0.7", "0.7-0.9", "0.9+")], "bucket string")
    counts = insights.groupBy(bucket(F.col("confidence")).alias("bucket")).count()
    return every.join(counts, "bucket", "left").select("bucket", F.coalesce("count", F.lit(0)).alias("n"))


def keep_first(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """Of rows with one key the first; dropDuplicates would keep any."""
    return rows.withColumn("rn", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("rn = 1").drop("rn")


def sourced(insights: DataFrame, ranked: DataFrame) -> DataFrame:
    """Insights whose page and section were among the chunks."""
    key = lambda c: F.trim(F.regexp_replace(F.lower(c), r"\s+", " "))
    r = ranked.select("page_number", key(F.col("source_section")).alias("k")).distinct()
    return insights.withColumn("k", key(F.col("source_section"))).join(r, ["page_number", "k"], "left_semi").drop("k")
