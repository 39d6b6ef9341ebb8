"""Queries of registry normalization. Labels are terms, labels below a parent, vectors, and what nobody knows."""

from __future__ import annotations

from pyspark.sql import functions as F

from .operators import registry
from .plans import dims
from .plans.fixtures import fixture, table, with_fixture
from .registered import query

_TERMS = [(k, kind, term, i) for i, (k, kind, term) in enumerate([(k, 0, k.replace("_", " ")) for k, _, _ in dims.REGISTRY] + [(k, 1, a) for k, _, al in dims.REGISTRY for a in al])]
_LABEL = "CASE vec_id % 7 WHEN 0 THEN 'Revenue' WHEN 1 THEN 'Group - Net Sales' WHEN 2 THEN concat('vector ', CAST(vec_id AS VARCHAR(20))) WHEN 3 THEN concat('Parent company - vector ', CAST(vec_id - 1 AS VARCHAR(20))) WHEN 4 THEN 'Equity - Gross  Profit' WHEN 5 THEN concat('2024 - ', 'Turnover') ELSE 'Total assets - unknown thing' END"
_NEAR = "round(list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(r.embedding AS DOUBLE[])), 4)"


def _terms(s):
    return s.createDataFrame(_TERMS, "key string, kind int, term string, ordinal int")


@query(
    "m1_normalized_facts",
    f"""WITH f AS (SELECT vec_id, {_LABEL} AS label FROM embeddings WHERE vec_id >= 50 AND embedding IS NOT NULL),
n AS (SELECT label, key, score FROM (SELECT concat('vector ', CAST(q.vec_id AS VARCHAR)) AS label, 'metric_' || r.vec_id AS key, {_NEAR} AS score, row_number() OVER (PARTITION BY q.vec_id ORDER BY {_NEAR} DESC, r.vec_id) AS rn FROM embeddings q JOIN embeddings r ON r.vec_id < 50 WHERE q.vec_id >= 50 AND q.vec_id % 7 = 2) WHERE rn = 1),
x AS (SELECT f.*, k.score AS own, k.key AS own_key, c.score AS child, c.key AS child_key FROM f LEFT JOIN n k ON k.label = f.label LEFT JOIN n c ON f.vec_id % 7 = 3 AND 'Parent company - ' || c.label = f.label)
SELECT vec_id, label AS original_metric, CASE vec_id % 7 WHEN 0 THEN 'revenue' WHEN 1 THEN 'revenue' WHEN 2 THEN CASE WHEN own >= 0.8 THEN own_key END WHEN 3 THEN CASE WHEN child >= 0.9 THEN child_key END WHEN 4 THEN 'gross_profit' END AS normalized_metric,
  coalesce(CASE vec_id % 7 WHEN 0 THEN 1.0 WHEN 1 THEN 0.96 WHEN 2 THEN greatest(0.0, least(1.0, own)) WHEN 3 THEN CASE WHEN child >= 0.9 THEN least(1.0, child) END WHEN 4 THEN 1.0 END, 0.0)::DOUBLE AS confidence,
  coalesce(CASE vec_id % 7 WHEN 0 THEN false WHEN 1 THEN false WHEN 2 THEN NOT own >= 0.8 WHEN 3 THEN NOT child >= 0.9 WHEN 4 THEN false END, true) AS requires_review,
  CASE WHEN vec_id % 7 = 1 THEN 'Group' WHEN vec_id % 7 = 4 THEN 'Equity' WHEN child >= 0.9 THEN 'Parent company' END AS parent_metric_context, CASE WHEN vec_id % 7 IN (1, 4) OR child >= 0.9 THEN 'parent_prefix_stripping' END AS normalization_rule FROM x""",
)
def _(s, d):
    e = table(s, d, "embeddings").where("embedding is not null")
    facts = e.where("vec_id >= 50").select("vec_id", F.expr(_LABEL).alias("metric"))
    vectors = e.where("vec_id >= 50 and vec_id % 7 = 2").select(F.expr("concat('vector ', vec_id)").alias("label"), "embedding")
    known = e.where("vec_id < 50").select("vec_id", F.concat(F.lit("metric_"), "vec_id").alias("key"), "embedding")
    return registry.normalized(facts, _terms(s), vectors, known).select("vec_id", "original_metric", "normalized_metric", "confidence", "requires_review", "parent_metric_context", "normalization_rule")


@query("l8_relabelled_rows", with_fixture("fx_cells", " SELECT page_number, table_index, row_index, col_index, CASE WHEN col_index = 0 AND row_index > 0 THEN CASE row_index % 3 WHEN 0 THEN 'revenue' WHEN 1 THEN 'total_assets' ELSE cell END ELSE cell END AS cell FROM fx_cells"))
def _(s, d):
    said = F.when(F.col("row_index") % 3 == 0, " Net  SALES ").when(F.col("row_index") % 3 == 1, "Assets").otherwise(F.col("cell"))
    cells = fixture(s, d, "fx_cells").withColumn("cell", F.when((F.col("col_index") == 0) & (F.col("row_index") > 0), said).otherwise(F.col("cell")))
    return registry.relabelled(cells, _terms(s))
