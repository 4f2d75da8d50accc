"""The queries of this subpackage, one for each operator, and the SQL that checks those SQL can express."""

from __future__ import annotations

from collections.abc import Callable
from fractions import Fraction

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm.common import load, remainder
from textloom.llm.decontaminate import contamination
from textloom.llm.importance import fit, resample
from textloom.llm.jaccard_join import jaccard_components
from textloom.llm.language_id import identify_languages, learn_languages
from textloom.llm.near_vectors import near_vectors
from textloom.llm.packing import pack
from textloom.llm.pii import replace_pii
from textloom.llm.ppm import lm_scores
from textloom.llm.secrets import find_secrets, secret_digest
from textloom.llm.toxicity import learn_toxicity, score_toxicity


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    model = learn_toxicity(docs, load(spark, sf_dir, "labels"), remainder("doc_id", 5) != 0)
    return score_toxicity(docs, model).select("doc_id", (remainder("doc_id", 5) == 0).alias("held_out"), "score", "predicted")


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(load(spark, sf_dir, "documents"))


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_digest(find_secrets(load(spark, sf_dir, "documents")))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    found = identify_languages(docs, learn_languages(docs, remainder("doc_id", 5) != 0))
    return found.select("doc_id", (remainder("doc_id", 5) == 0).alias("held_out"), "lang_pred", "score", "reliable")


def op5_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    return resample(docs, fit(docs, load(spark, sf_dir, "labels")))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "similarity", "start", "end")


def op7_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    return lm_scores(docs, remainder("doc_id", 7) != 2)


def op9_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replace_pii(load(spark, sf_dir, "documents")).select("doc_id", "text", "n_entities")


def op10_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(load(spark, sf_dir, "embeddings"))


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(load(spark, sf_dir, "documents"), n=3, threshold=Fraction(9, 10))


_JACCARD_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(ws) >= 3 THEN list_distinct(list_transform(range(1, len(ws) - 1), lambda i: array_to_string(ws[i:i+2], ' ')))
    WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END AS g FROM w),
e AS (SELECT doc_id, len(g) AS n, unnest(g) AS x FROM s),
p AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.x = b.x AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))),
r(doc_id, place) AS (SELECT doc_id, doc_id FROM s UNION SELECT r.doc_id, p.b FROM r JOIN p ON r.place = p.a)
SELECT s.doc_id, CAST(len(s.g) AS BIGINT) AS n_shingles, min(r.place) AS component_id FROM s JOIN r USING (doc_id) GROUP BY s.doc_id, s.g
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_best_fit_packing": op2_best_fit_packing,
    "op3_secret_scan": op3_secret_scan,
    "op4_language_id": op4_language_id,
    "op5_importance_resampling": op5_importance_resampling,
    "op6_decontamination": op6_decontamination,
    "op7_lm_scores": op7_lm_scores,
    "op8_jaccard_join": op8_jaccard_join,
    "op9_pii_surrogates": op9_pii_surrogates,
    "op10_near_vectors": op10_near_vectors,
}

_VECTOR_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_sum(list_transform(embedding, lambda x: abs(x))) > 0),
p AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.9),
n AS (SELECT a, count(*) AS k FROM p GROUP BY a),
r(vec_id, place) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.vec_id, p.b FROM r JOIN p ON r.place = p.a),
c AS (SELECT vec_id, min(place) AS component_id FROM r GROUP BY vec_id)
SELECT vec_id, CAST(coalesce(k, 0) AS BIGINT) AS n_links, component_id, vec_id = component_id AS kept FROM c LEFT JOIN n ON a = vec_id
"""

ORACLE_SQL: dict[str, str] = {
    "op10_near_vectors": _VECTOR_SQL,
    "op8_jaccard_join": _JACCARD_SQL,
}
