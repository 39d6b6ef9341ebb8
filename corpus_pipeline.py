"""The corpus pipeline: documents in, token digests of the clean ones out.

Each stage takes what its predecessor kept, reads the whole of it and returns the columns of
documents; the last returns the digests of op6. A stage's output is written as Parquet and read
again before the next begins.

* language: rows without a recognised language go.
* lines: lines that nearly repeat an earlier line go; n_chars is that of the rest. A document of
  which every line goes is a repetition as a whole and goes.
* near: one document of each group of near duplicates (similarity of 0.8 or more) stays, that with the least doc_id.
* benchmark: documents with a benchmark passage go.
* tokens: byte-level BPE.

A stage on an empty table returns an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.llm import bpe, decontaminate, language, linededup, minhash
from tallyloom.llm._util import Scratch, read

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: Similarity of five-word shingles from which documents are near duplicates here, and the coordinates of 128 that must agree: these lose
#: fewer than one link in 100,000 at that similarity.
PERCENT, MATCHES = 80, 82


def _language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language.recognised(docs).select(COLUMNS)


def _lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    left = linededup.deduplicate(docs).where("size(line_numbers) = 0 or rest <> ''")
    text = F.col("rest").alias("text")
    n_chars = F.when(F.size("line_numbers") > 0, F.length("rest").cast("long")).otherwise(F.col("row.n_chars").cast("long")).alias("n_chars")
    return left.select("row.doc_id", text, "row.lang", "row.source", n_chars)


def _near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = minhash.near_duplicates(docs, percent=PERCENT, matches=MATCHES).where("not kept").select("doc_id").distinct()
    return docs.join(out, "doc_id", "left_anti").select(COLUMNS)


def _benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, read(spark, sf_dir, "benchmark")).select(COLUMNS)


def _tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.digests(docs, public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN)


STAGES = [("language", _language), ("lines", _lines), ("near", _near), ("benchmark", _benchmark), ("tokens", _tokens)]
#: Language scores and byte-pair merges can't be expressed in SQL; tests/llm compares with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch, docs = Scratch(spark, "pipeline"), read(spark, sf_dir, "documents").select(COLUMNS)
    for k, (name, stage) in enumerate(STAGES):
        docs = scratch.keep(stage(spark, docs, sf_dir), name)
        if k:
            scratch.drop(STAGES[k - 1][0])
    return docs
