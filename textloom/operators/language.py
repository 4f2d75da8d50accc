"""Summaries: words are counted inside a document and the counts joined back to its sentences."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions.dialect import Duck, Spark
from textloom.operators.analysis import T2, sentences
from textloom.operators.corpus import _STOP_SQL, STOP_WORDS

_S, _D = Spark(), Duck()


def summary(docs: DataFrame, want: int = 3) -> DataFrame:
    """The sentences of at least three words with the densest content words, with a bonus for the first two; in order.

    A document with no more than `want` such sentences keeps them all, with score 1."""
    s = docs.select("doc_id", F.expr(sentences(_S, "coalesce(text, '')")).alias("s"))
    s = s.select("doc_id", F.expr(_S.keep("s", "x", f"{_S.count('x', r'[^\x09-\x0D\x20]+')} >= 3")).alias("s")).select("doc_id", F.size("s").alias("n"), F.posexplode("s").alias("index", "sentence"))
    w = s.withColumn("w", F.expr(_S.extract("lower(sentence)", T2))).withColumn("nw", F.size("w"))
    stop = F.broadcast(docs.sparkSession.createDataFrame([(x,) for x in STOP_WORDS], "term string"))
    e = w.select("doc_id", "index", F.explode("w").alias("term")).where(F.length("term") >= 3).join(stop, "term", "left_anti")
    per = e.groupBy("doc_id", "term").agg(F.count(F.lit(1)).alias("c"))
    top = per.groupBy("doc_id").agg(F.max("c").alias("top"))
    here = e.groupBy("doc_id", "index", "term").agg(F.count(F.lit(1)).alias("k"))
    dense = here.join(per, ["doc_id", "term"]).join(top, "doc_id").groupBy("doc_id", "index").agg((F.sum(F.col("k") * F.col("c")) / F.first("top") / F.sum("k")).alias("density"))
    r = w.join(dense, ["doc_id", "index"], "left")
    score = F.coalesce("density", F.lit(0.0)) + F.when(F.col("index") == 0, 0.25).when(F.col("index") == 1, 0.12).otherwise(0.0) + F.when(F.col("nw") > 40, -0.15).when(F.col("nw") < 6, -0.1).otherwise(0.0)
    r = r.withColumn("score", F.when(F.col("n") <= want, 1.0).otherwise(F.floor(score * 10000 + 0.5) / 10000))
    rank = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("score"), "index"))
    return r.withColumn("rank", rank).where(F.col("rank") <= want).select("doc_id", F.col("index").cast("int").alias("index"), "sentence", "score")


SUMMARY_SQL = f"""
WITH a AS (SELECT doc_id, {sentences(_D, "coalesce(text, '')")} AS s FROM documents),
b AS (SELECT doc_id, {_D.keep("s", "x", f"{_D.count('x', r'[^\x09-\x0D\x20]+')} >= 3")} AS s FROM a),
s AS (SELECT doc_id, len(s) AS n, unnest(s) AS sentence, unnest(range(0, len(s))) AS index FROM b),
w AS (SELECT *, {_D.extract("lower(sentence)", T2)} AS w FROM s),
u AS (SELECT doc_id, index, unnest(w) AS term FROM w),
e AS (SELECT * FROM u WHERE length(term) >= 3 AND term NOT IN ({_STOP_SQL})),
p AS (SELECT doc_id, term, count(*) AS c FROM e GROUP BY ALL),
t AS (SELECT doc_id, max(c) AS top FROM p GROUP BY doc_id),
d AS (SELECT e.doc_id, e.index, sum(c) / any_value(top) / count(*) AS density FROM e JOIN p USING (doc_id, term) JOIN t USING (doc_id) GROUP BY ALL),
r AS (SELECT w.*, coalesce(density, 0) + CASE WHEN index = 0 THEN 0.25 WHEN index = 1 THEN 0.12 ELSE 0 END + CASE WHEN len(w) > 40 THEN -0.15 WHEN len(w) < 6 THEN -0.1 ELSE 0 END AS raw FROM w LEFT JOIN d USING (doc_id, index)),
k AS (SELECT *, CASE WHEN n <= 3 THEN CAST(1 AS DOUBLE) ELSE floor(CAST(raw AS DOUBLE) * 10000 + 0.5) / 10000 END AS score FROM r),
o AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, index) AS rank FROM k)
SELECT doc_id, CAST(index AS INT) AS index, sentence, score FROM o WHERE rank <= 3
"""
