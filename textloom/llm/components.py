"""Connected components of an edge table by alternating large-star and small-star rounds, all distributed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import materialize


def _with_min(pairs: DataFrame) -> DataFrame:
    """(u, v) with m, the least of u and its v: a partial aggregate and a join that can be split when u is hot."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m"))
    return pairs.join(least, "u").withColumn("m", F.least("u", "m"))


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """edges(a, b) of any orderable type -> (node, component), component the least node reachable.

    Self-loops and repeated edges are harmless; null ends are dropped; no edges give no rows."""
    now = materialize(edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "cc")
    state = None
    for _ in range(rounds):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _with_min(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        met = _with_min(large)
        small = met.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(met.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        now = materialize(small, "cc")
        new = now.agg(F.count(F.lit(1)), F.sum(F.hash("u", "v").cast("decimal(38,0)"))).first()
        if tuple(new) == state:
            break
        state = tuple(new)
    else:
        raise RuntimeError("components did not settle")
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
