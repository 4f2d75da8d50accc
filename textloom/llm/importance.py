"""Quality classifier by importance resampling.

Two generative models over hashed word unigrams and bigrams, of target text (labelled good) and of all raw text, give
each document a log importance weight; adding Gumbel noise, keyed by the document, and keeping the k largest draws k
documents without replacement in proportion to their weights. k itself comes from the labelled rows: the number of
documents whose weight is at least the cut that best parts good from bad ones there.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import WordHash, materialize, ngram_hashes, word_array, words_of

BINS = 1 << 14


def features(text: str | None, hashes: WordHash) -> np.ndarray:
    """Bins of all unigrams and bigrams of a whole text."""
    w = word_array(words_of(text), hashes)
    grams = np.r_[w, ngram_hashes(w, 2)] if len(w) > 1 else w
    return (grams % np.uint64(BINS)).astype(np.int64)


def _counts(batches):
    """Counts of each bin in raw text and in good and bad labelled text; one row for each bin a task has met."""
    hashes, total = WordHash(), np.zeros((3, BINS), np.int64)
    for batch in batches:
        for text, quality in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
            n = np.bincount(features(text.as_py(), hashes), minlength=BINS)
            total[0] += n
            if quality is not None:
                total[1 if quality else 2] += n
    at = np.flatnonzero(total[0])
    yield pa.RecordBatch.from_arrays([pa.array(at), *[pa.array(t[at]) for t in total]], names=["bin", "raw", "good", "bad"])


@dataclass
class Weights:
    """Log importance of each bin, and the cut that parts good from bad labelled documents."""

    bins: np.ndarray
    cut: float


def best_cut(weights: list[tuple[float, bool]]) -> float:
    """The cut with the best balanced accuracy on (weight, good): in the middle of its gap; without both kinds, none falls."""
    xs = sorted(weights)
    good, bad = sum(g for _, g in xs), sum(not g for _, g in xs)
    if not good or not bad:
        return -math.inf
    best, at, lost, caught = 0.5, -math.inf, 0, 0
    for k, (w, g) in enumerate(xs[:-1]):
        lost, caught = lost + g, caught + (not g)
        follows = xs[k + 1][0]
        if follows > w and (score := (caught / bad + 1 - lost / good) / 2) > best:
            best, at = score, (w + follows) / 2
    return at


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_rows: int = 20_000) -> Weights:
    """Raw counts cover all documents. Labelled text is a sample: about label_rows rows chosen by a hash of their id, which
    bounds what is broadcast and collected. The cut is learned from weights that leave out a text's own part."""
    spark = docs.sparkSession
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    share = min(1.0, label_rows / max(1, known.count()))
    known = known.where(F.pmod(F.xxhash64(F.lit("quality sample"), "doc_id"), F.lit(1 << 20)) < int(math.ceil(share * (1 << 20))))
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(known), "doc_id", "left")
    n = np.zeros((3, BINS))
    for r in texts.select("text", "quality").mapInArrow(_counts, "bin long, raw long, good long, bad long").groupBy("bin").agg(*[F.sum(c).alias(c) for c in ("raw", "good", "bad")]).collect():  # at most BINS rows
        n[:, r["bin"]] = r["raw"], r["good"], r["bad"]
    target = n[1] if n[1].sum() else n[0]
    p = [(x + 0.05) / (x.sum() + 0.05 * BINS) for x in (target, n[0])]
    bins = np.log(p[0] / p[1])
    model = spark.sparkContext.broadcast((target, np.log(p[1])))
    scored = texts.where("quality is not null").select("text", "quality").mapInArrow(_weigh_labelled(model), "weight double, quality int").collect()
    return Weights(bins, best_cut([(r["weight"], r["quality"] > 0) for r in scored]))


def _weigh(model):
    def run(batches):
        hashes = WordHash()
        for batch in batches:
            w = [float(model.value[features(t.as_py(), hashes)].sum()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(w, pa.float64())], names=["doc_id", "weight"])

    return run


def _weigh_labelled(model):
    """Weights of labelled texts, of good ones without what they themselves gave to the target: an unseen text's are no
    higher, so the cut must not be either."""

    def run(batches):
        hashes, (target, raw) = WordHash(), model.value
        for batch in batches:
            w = []
            for text, quality in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                at, own = np.unique(features(text.as_py(), hashes), return_counts=True)
                gave = own if quality else 0
                w.append(float((own * (np.log((target[at] - gave + 0.05) / (target.sum() - np.sum(gave) + 0.05 * BINS)) - raw[at])).sum()))
            yield pa.RecordBatch.from_arrays([pa.array(w, pa.float64()), batch.column(1)], names=["weight", "quality"])

    return run


def _gumbel(seed: int) -> Column:
    """Keyed noise: a function of the seed, the id and the weight, so that reruns and partitions agree."""
    u = (F.pmod(F.xxhash64(F.lit(seed), "doc_id", "weight"), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    return -F.log(-F.log(u))


def _kth_largest(drawn: DataFrame, k: int, ways: int = 4096) -> float:
    """The k-th largest score, by counting in ever narrower ranges; drawn is narrow and already written."""
    r = drawn.agg(F.min("score").alias("lo"), F.max("score").alias("hi")).first()
    lo, hi = r["lo"], r["hi"]
    for _ in range(12):
        width = (hi - lo) / ways
        if not width or lo + width == lo:
            break
        part = F.least(F.floor((F.col("score") - lo) / width).cast("int"), F.lit(ways - 1))
        inside = drawn.where((F.col("score") >= lo) & (F.col("score") <= hi)).groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("lo"), F.max("score").alias("hi"))
        for r in sorted(inside.collect(), key=lambda r: -r["part"]):  # at most `ways` rows
            if r["n"] >= k:
                lo, hi = r["lo"], r["hi"]
                break
            k -= r["n"]
    return lo


def resample(docs: DataFrame, weights: Weights, keep: int | None = None, seed: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: doc_id, weight, score (weight plus Gumbel noise), selected.

    selected: the score is among the `keep` largest; by default keep is the number of documents whose weight reaches the
    cut learned from labels. Scores equal to the last selected one are all selected. A null or empty text has weight 0.
    Repeated rows share their noise, so they stay or go together; null ids are rows like any other; no rows give no
    rows. Other columns are ignored."""
    model = docs.sparkSession.sparkContext.broadcast(weights.bins)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    drawn = materialize(texts.mapInArrow(_weigh(model), "doc_id long, weight double").withColumn("score", F.col("weight") + _gumbel(seed)), "drawn")
    if keep is None:
        keep = drawn.where(F.col("weight") >= F.lit(weights.cut)).count()
    n = drawn.count()
    least = math.inf if not keep or not n else -math.inf if keep >= n else _kth_largest(drawn, keep)
    return drawn.withColumn("selected", F.col("score") >= F.lit(least))
