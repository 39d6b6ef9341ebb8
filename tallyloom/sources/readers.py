"""Sources. Models that read pixels are providers: tables that someone else has written."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Providers by name: what each table must have.
PROVIDERS = {
    "detected_tables": "year int, page_number int, detected_table_id string, page_table_index int, bbox array<double>, detection_confidence double, label string",
    "page_table_types": "year int, page_number int, table_types array<string>",
    "raw_tables": "strategy string, year int, page_number int, table_index int, rows array<array<string>>",
    "narrative_pages": "report_id string, page_number int, text string, ocr_text string",
    "template_cells": "sheet string, row int, col int, value string",
}


def provider(spark: SparkSession, name: str, path: str) -> DataFrame:
    """Reads a provider's Parquet by its schema; unknown columns are errors, as the models forbid extras."""
    df = spark.read.parquet(path)
    want = spark.createDataFrame([], PROVIDERS[name]).schema
    if extra := set(df.columns) - set(want.names):
        raise ValueError(f"{name}: unknown columns {sorted(extra)}")
    return df.select(*[F.col(f.name).cast(f.dataType) if f.name in df.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in want.fields])


def detections(df: DataFrame, threshold: float = 0.90) -> DataFrame:
    """Boxes that are sure enough, with their id."""
    return df.where(F.col("detection_confidence") >= threshold).withColumn("detected_table_id", F.concat_ws(":", "year", "page_number", "page_table_index"))


def zip_types(types: DataFrame, boxes: DataFrame) -> DataFrame:
    """S3: types without repeats, by position beside the page's boxes; surplus boxes are dropped."""
    t = types.select("year", "page_number", F.posexplode(F.array_distinct("table_types")).alias("page_table_index", "table_type"))
    return t.join(boxes.select("year", "page_number", "page_table_index", "detected_table_id", "bbox", "detection_confidence"), ["year", "page_number", "page_table_index"], "left")


def best_text(pages: DataFrame) -> DataFrame:
    """The page's own text, the scanned one where that is blank."""
    own = F.length(F.trim(F.coalesce("text", F.lit("")))) > 0
    return pages.withColumn("text_source", F.when(own, "native").when(F.length(F.trim(F.coalesce("ocr_text", F.lit("")))) > 0, "ocr").otherwise("none")).withColumn("text", F.when(own, F.col("text")).otherwise(F.coalesce("ocr_text", F.lit(""))))


def ocr_route(pages: DataFrame) -> DataFrame:
    """Why a scan is not good enough, and whether a second engine's is taken.

    pages: text, confidence, fragmentation, alias_matches and the same with second_ before them.
    """
    reasons = F.filter(F.array(F.when(F.length(F.trim("text")) == 0, "empty"), F.when(F.col("confidence") < 0.55, "low_confidence"), F.when(F.col("fragmentation") > 0.35, "fragmented"), F.when(F.col("alias_matches") == 0, "no_alias")), lambda x: x.isNotNull())
    p = pages.withColumn("reasons", F.array_join(reasons, ","))
    return p.withColumn("use_second", (F.col("reasons") != "") & (F.struct("second_confidence", "second_alias_matches") > F.struct("confidence", "alias_matches")))


def context_json(spark: SparkSession, path: str) -> DataFrame:
    """S9."""
    return spark.read.option("multiLine", "true").json(path)


def name_parts(paths: DataFrame) -> DataFrame:
    """Company, slug and year from a file's name (column path); the last year counts."""
    stem = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.[^.]*$", "")
    years = F.regexp_extract_all(stem, F.lit("(?:19|20)[0-9]{2}"), F.lit(0))
    company = F.trim(F.regexp_replace(F.regexp_replace(stem, "(19|20)[0-9]{2}", " "), r"[_\-\s]+", " "))
    return paths.select("path", F.when(F.size(years) > 0, F.element_at(years, -1).cast("int")).alias("year"), company.alias("company"), F.replace(F.lower(company), F.lit(" "), F.lit("-")).alias("slug"))


def registry(spark: SparkSession, entries: list[tuple[str, str, list[str]]]) -> DataFrame:
    """(key, kind, term); keys that repeat and terms of two metrics are errors."""
    import re

    norm = lambda x: re.sub("[^a-z0-9]+", " ", x.lower().replace("&", " and ")).strip()
    seen: dict[str, str] = {}
    rows = []
    if len({k for k, _, _ in entries}) < len(entries):
        raise ValueError("a key repeats")
    for key, display, aliases in entries:
        for kind, term in [(0, key.replace("_", " ")), (0, display), *((1, a) for a in aliases)]:
            t = norm(term)
            if seen.setdefault(t, key) != key:
                raise ValueError(f"{t!r} belongs to {seen[t]} and {key}")
            rows.append((key, kind, t))
    return spark.createDataFrame(sorted(set(rows)), "key string, kind int, term string")


class _Tables(HTMLParser):
    def __init__(self):
        super().__init__()
        self.tables, self.open, self.cell = [], [], None

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        if tag == "table":
            self.open.append([])
            self.tables.append(self.open[-1])
        elif tag == "tr" and self.open:
            self.open[-1].append([])
        elif tag in ("td", "th") and self.open:
            if not self.open[-1]:
                self.open[-1].append([])
            span = lambda k: max(1, int(a[k])) if (a.get(k) or "").isdigit() else 1
            self.cell = [[], min(span("rowspan"), 1000), min(span("colspan"), 1000)]
            self.open[-1][-1].append(self.cell)

    def handle_endtag(self, tag):
        if tag in ("td", "th"):
            self.cell = None
        elif tag == "table" and self.open:
            self.open.pop()

    def handle_data(self, data):
        if self.cell is not None:
            self.cell[0].append(data)


def table_grids(html: str) -> list[list[list[str]]]:
    """Grids with spans filled in, padded to rectangles, without empty rows."""
    p = _Tables()
    p.feed(html or "")
    out = []
    for rows in p.tables:
        grid: dict[tuple[int, int], str] = {}
        for i, row in enumerate(rows):
            j = 0
            for parts, down, across in row:
                while (i, j) in grid:
                    j += 1
                text = " ".join("".join(parts).split())
                for a in range(min(down, len(rows) - i)):
                    for b in range(across):
                        grid[i + a, j + b] = text
                j += across
        width = 1 + max((j for _, j in grid), default=-1)
        full = [[grid.get((i, j), "") for j in range(width)] for i in range(len(rows))]
        out.append([r for r in full if any(r)])
    return out


def html_cells(pages: DataFrame) -> DataFrame:
    """(page_id, table_index, row_index, col_index, cell) of all tables in html."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(p, t, i, j, c) for p, h in zip(pdf.page_id, pdf.html, strict=True) for t, g in enumerate(table_grids(h)) for i, r in enumerate(g) for j, c in enumerate(r)]
            yield pd.DataFrame(rows, columns=["page_id", "table_index", "row_index", "col_index", "cell"])

    return pages.select("page_id", "html").mapInPandas(run, "page_id long, table_index int, row_index int, col_index int, cell string")
