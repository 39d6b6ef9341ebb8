"""The registered queries against their SQL on a small table, and the pipeline against its stages in plain Python."""

import pytest
from conftest import DATA

from tallyloom.llm import queries

SQL = queries.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows_as_sql(spark, same, name):
    same(queries.queries()[name](spark, DATA), SQL[name])


@pytest.mark.parametrize("name", sorted(set(queries.queries()) - set(SQL)))
def test_whole_table(spark, name):
    df = queries.queries()[name](spark, DATA)
    table = "pages" if name == "op4_html" else "documents"
    if name not in ("op7_passages", "op13_whitening"):
        assert df.count() == spark.read.parquet(f"{DATA}/{table}.parquet").count()


def test_pipeline(spark):
    import hashlib

    import corpus_pipeline
    import public_tokenizers as P
    import tiktoken

    from tallyloom.llm import bpe

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        before = docs.count()
        docs = stage(spark, docs, DATA)
        assert docs.count() <= before
        if name == "benchmark":
            left = {x.doc_id: x.text for x in docs.collect()}
    tok = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(P.path(corpus_pipeline.VOCABULARY)), special_tokens={})
    got = {x.doc_id: x.ids_sha256 for x in corpus_pipeline.run(spark, DATA).collect()}
    assert got == {i: hashlib.sha256(",".join(map(str, tok.encode_ordinary(t))).encode()).hexdigest() for i, t in left.items()}
