"""Near-duplicate vectors by product quantisation over coarse inverted lists.

Unit vectors go to the inverted list of their nearest coarse centroid; what is left of a vector there is cut into
subspaces, each coded by the nearest of 256 subspace centroids. A query visits the lists of its nearest centroids; there
a table of distances from its own residual to the subspace centroids gives, by look-ups, the distance to every member,
and members within the radius that the cosine threshold sets, widened by what coding may lose, are compared exactly in
double precision. Lists are dealt in blocks of bounded size, members against queries, so that a long list is many tasks.

Equal vectors are one member with a multiplicity, so a hot group of copies costs one comparison. A block of comparisons
returns counts of links and a spanning forest of them, never the links themselves, so a group of near copies returns
rows in proportion to its members. A link that both sides find is counted by each for itself; a member that would not
visit the list of its finder has the link counted by the finder.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import materialize
from textloom.llm.components import connected_components

_PLACED = "role string, list long, fp string, unit binary, times long, home long, code binary, slack double, visits binary"


def _kmeans(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    """Lloyd's rounds from a random start; an empty cell keeps its centroid."""
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        near = _nearest(x, c, 1)[:, 0]
        n = np.bincount(near, minlength=len(c))
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        c[n > 0] = sums[n > 0] / n[n > 0, None]
    return c


def _nearest(x: np.ndarray, c: np.ndarray, k: int) -> np.ndarray:
    out = np.empty((len(x), min(k, len(c))), np.int64)
    half = (c * c).sum(1) / 2
    for a in range(0, len(x), 4096):
        d = half - x[a : a + 4096] @ c.T
        if k >= len(c):
            out[a : a + 4096] = np.argsort(d, axis=1, kind="stable")
        else:
            near = np.argpartition(d, k - 1, axis=1)[:, :k]
            out[a : a + 4096] = np.take_along_axis(near, np.argsort(np.take_along_axis(d, near, 1), axis=1, kind="stable"), 1)
    return out


class Quantiser:
    """Coarse centroids and, for each subspace, centroids of residuals; fit on a sample of unit vectors."""

    def __init__(self, sample: np.ndarray, lists: int, parts: int, rounds: int = 8, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.coarse = _kmeans(sample, lists, rounds, rng)
        rest = sample - self.coarse[_nearest(sample, self.coarse, 1)[:, 0]]
        dim = sample.shape[1]
        cuts = np.linspace(0, dim, min(parts, dim) + 1).astype(int)
        self.spans = list(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True))
        self.fine = [_kmeans(rest[:, a:b], 256, rounds, rng) for a, b in self.spans]

    def encode(self, rest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(codes, distance from each residual to what its code stands for)."""
        codes, lost = np.empty((len(rest), len(self.spans)), np.uint8), np.zeros(len(rest))
        for j, ((a, b), c) in enumerate(zip(self.spans, self.fine, strict=True)):
            codes[:, j] = _nearest(rest[:, a:b], c, 1)[:, 0]
            lost += ((rest[:, a:b] - c[codes[:, j]]) ** 2).sum(1)
        return codes, np.sqrt(lost)

    def table(self, rest: np.ndarray) -> np.ndarray:
        """Squared distances of one query's residual to all subspace centroids."""
        out = np.full((len(self.spans), 256), np.inf)
        for j, ((a, b), c) in enumerate(zip(self.spans, self.fine, strict=True)):
            out[j, : len(c)] = ((c - rest[a:b]) ** 2).sum(1)
        return out


def _clean(vectors: pa.Array) -> list[np.ndarray | None]:
    """Unit vectors in double precision; None for what links with nothing. Vectors of one length are taken together."""
    out: list[np.ndarray | None] = [None] * len(vectors)
    sizes = pc.fill_null(pc.list_value_length(vectors), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)  # a null component is NaN here
    starts = np.r_[0, np.cumsum(sizes)[:-1]] if len(sizes) else sizes
    for size in np.unique(sizes[sizes > 0]).tolist():
        rows = np.flatnonzero(sizes == size)
        x = flat[starts[rows][:, None] + np.arange(size)]
        with np.errstate(over="ignore", invalid="ignore"):
            norm = np.sqrt((x * x).sum(1))
        good = np.isfinite(x).all(1) & np.isfinite(norm) & (norm > 0)
        unit = x[good] / norm[good, None]
        for k, u in zip(rows[good].tolist(), unit, strict=True):
            out[k] = u
    return out


def _units(batches):
    for batch in batches:
        unit = _clean(batch.column(1))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([None if u is None else u.tobytes() for u in unit], pa.binary()), pa.array([0 if u is None else len(u) for u in unit], pa.int32())], names=["vec_id", "unit", "dim"])


def _place(model, probes: int):
    """Distinct unit vectors -> one member row in its own list, and a query row in each of its nearest lists."""

    def run(batches):
        q = model.value
        for batch in batches:
            for a in range(0, batch.num_rows, 512):  # a row becomes as many as it visits lists
                fps, units, times = (c.to_pylist() for c in batch.slice(a, 512).columns)
                x = np.frombuffer(b"".join(units), np.float64).reshape(len(fps), -1)
                near = _nearest(x, q.coarse, probes)
                codes, lost = q.encode(x - q.coarse[near[:, 0]])
                out = []
                for k, fp in enumerate(fps):
                    home = int(near[k, 0])
                    out.append(("m", home, fp, units[k], times[k], home, codes[k].tobytes(), float(lost[k]), near[k].astype(np.int32).tobytes()))
                    out.extend(("q", at, fp, units[k], times[k], home, None, None, None) for at in near[k].tolist())
                kinds = (pa.string(), pa.int64(), pa.string(), pa.binary(), pa.int64(), pa.int64(), pa.binary(), pa.float64(), pa.binary())
                columns = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays(columns, names=["role", "list", "fp", "unit", "times", "home", "code", "slack", "visits"])

    return run


def _compare(model, cosine: float):
    """One block of members against one block of queries of the same list -> (a, null, links of a) and forest edges (a, b, null).

    Cosines are summed row by row, so that a pair has the same one from either side."""
    radius = math.sqrt(2 - 2 * cosine)

    def run(members: pa.Table, queries: pa.Table) -> pa.Table:
        a, b, n = [], [], []
        if members.num_rows and queries.num_rows:
            q = model.value
            mine, asked = members.column("fp").to_pylist(), queries.column("fp").to_pylist()
            x = np.frombuffer(b"".join(members.column("unit").to_pylist()), np.float64).reshape(len(mine), -1)
            y = np.frombuffer(b"".join(queries.column("unit").to_pylist()), np.float64).reshape(len(asked), -1)
            codes = np.frombuffer(b"".join(members.column("code").to_pylist()), np.uint8).reshape(len(mine), -1)
            visits = np.frombuffer(b"".join(members.column("visits").to_pylist()), np.int32).reshape(len(mine), -1)
            reach = (radius + 1e-6 + members.column("slack").to_numpy()) ** 2
            m_times, q_times = members.column("times").to_numpy(), queries.column("times").to_numpy()
            homes = queries.column("home").to_numpy()
            centre, places = q.coarse[members.column("list_")[0].as_py()], np.arange(codes.shape[1])
            at = {fp: k for k, fp in enumerate(mine)}
            own = [at.setdefault(fp, len(at)) for fp in asked]
            names = list(at)
            tree = np.arange(len(names))
            links = np.zeros(len(names), np.int64)
            for k, me in enumerate(own):
                near = np.flatnonzero(q.table(y[k] - centre)[places, codes].sum(1) <= reach)
                near = near[((x[near] * y[k]).sum(1) >= cosine) & (near != me)]
                if not len(near):
                    continue
                links[me] += m_times[near].sum()
                links[near[~(visits[near] == homes[k]).any(1)]] += q_times[k]
                apart = near[tree[near] != tree[me]]
                if len(apart):
                    labels, first = np.unique(tree[apart], return_index=True)
                    for m in apart[first].tolist():
                        a.append(names[me])
                        b.append(names[m])
                        n.append(None)
                    tree[np.isin(tree, labels)] = tree[me]
            for k in np.flatnonzero(links).tolist():
                a.append(names[k])
                b.append(None)
                n.append(int(links[k]))
        return pa.table({"a": pa.array(a, pa.string()), "b": pa.array(b, pa.string()), "n": pa.array(n, pa.int64())})

    return run


def near_vectors(vectors: DataFrame, cosine: float = 0.9, id_col: str = "vec_id", vec_col: str = "embedding", sample_rows: int = 20_000, lists: int | None = None, probes: int | None = None, parts: int = 16, block: int = 4096) -> DataFrame:
    """One row for each row of vectors: vec_id, n_links, component_id, kept.

    A link joins two rows whose cosine is at least `cosine`; n_links counts the other rows linked directly, component_id
    is the least id reachable. Null, empty, zero vectors and those with null or non-finite components have no link. Only
    vectors of equal dimension are compared. Equal vectors (whatever their length) are linked with each other; a repeated
    id counts for each of its rows; rows with a null id have null results and link with nothing. The quantiser is fit on
    about sample_rows vectors chosen by a hash, or eight for each list where that is more; every vector is indexed and
    every vector is a query. lists is the square root of the number of distinct vectors unless given, 16384 at most; probes,
    the lists a query visits, 24 or one in 128 of them; block bounds members and queries of a task. Other columns are
    ignored, and no rows give no rows."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("vec"))
    units = materialize(rows.where("vec_id is not null").mapInArrow(_units, "vec_id long, unit binary, dim int").withColumn("fp", F.expr("md5(unit)")), "units")
    members = materialize(units.where("unit is not null").groupBy("dim", "fp").agg(F.first("unit").alias("unit"), F.count(F.lit(1)).alias("times"), F.min("vec_id").alias("least")), "classes")
    links = None
    for dim, n in sorted((r["dim"], r["n"]) for r in members.groupBy("dim").agg(F.count(F.lit(1)).alias("n")).collect()):  # one entry for each dimension
        found = _links(members.where(F.col("dim") == dim).select("fp", "unit", "times"), n, cosine, sample_rows, lists, probes, parts, block)
        links = found if links is None else links.unionByName(found)
    if links is None:
        links = spark.createDataFrame([], "a string, b string, n long")
    links = materialize(links, "links")
    joined = connected_components(links.where("b is not null").select("a", "b"))
    degree = links.where("b is null").groupBy(F.col("a").alias("fp")).agg(F.sum("n").alias("others"))
    sizes = members.select("fp", "times", "least").join(joined.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    label = sizes.groupBy("component").agg(F.min("least").alias("component_id"))
    facts = sizes.join(label, "component").join(degree, "fp", "left").select("fp", (F.coalesce("others", F.lit(0)) + F.col("times") - 1).alias("n_links"), "component_id")
    linked = units.join(facts, "fp", "left").select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    unnamed = rows.where("vec_id is null").select("vec_id", F.lit(None).cast("long").alias("n_links"), F.lit(None).cast("long").alias("component_id"))
    return linked.unionByName(unnamed).withColumn("kept", F.col("vec_id") == F.col("component_id"))


def _links(units: DataFrame, n: int, cosine: float, sample_rows: int, lists: int | None, probes: int | None, parts: int, block: int) -> DataFrame:
    """Partial counts of links (a, null, n) and edges (a, b, null) that connect what is linked, of distinct unit vectors."""
    sc = units.sparkSession.sparkContext
    lists = lists or max(1, min(16_384, int(math.sqrt(n))))
    probes = probes or max(24, lists // 128)
    share = min(1.0, max(sample_rows, 8 * lists) / max(n, 1))
    some = units.where(F.pmod(F.xxhash64(F.lit("sample"), "unit"), F.lit(1 << 20)) < int(math.ceil(share * (1 << 20)))).collect()
    some = some or units.limit(1).collect()  # a sample of few rows may be empty
    sample = np.array([np.frombuffer(r["unit"], np.float64) for r in sorted(some, key=lambda r: r["unit"])])
    model = sc.broadcast(Quantiser(sample, lists, parts))
    placed = materialize(units.mapInArrow(_place(model, probes), _PLACED), "placed")
    tally = placed.groupBy("list").agg(F.count(F.when(F.col("role") == "m", 1)).alias("m"), F.count(F.when(F.col("role") == "q", 1)).alias("q"))
    blocks = tally.select("list", F.expr(f"greatest(1, cast(ceil(m / {block}) as int))").alias("mb"), F.expr(f"greatest(1, cast(ceil(q / {block}) as int))").alias("qb"))
    dealt = placed.join(F.broadcast(blocks), "list")  # one row for each list, at most 16384
    at = F.pmod(F.xxhash64("fp"), F.when(F.col("role") == "m", F.col("mb")).otherwise(F.col("qb")))
    dealt = dealt.withColumn("at", at)
    mine = dealt.where("role = 'm'").select(F.col("list").alias("list_"), "fp", "unit", "times", "code", "slack", "visits", F.col("at").alias("mb_"), F.explode(F.expr("sequence(cast(0 as bigint), cast(qb as bigint) - 1)")).alias("qb_"))
    asked = dealt.where("role = 'q'").select("list", "fp", "unit", "times", "home", F.explode(F.expr("sequence(cast(0 as bigint), cast(mb as bigint) - 1)")).alias("mb_"), F.col("at").alias("qb_"))
    mine, asked = mine.toDF(*mine.columns), asked.toDF(*asked.columns[:-2], "mb", "qb")  # columns of their own on either side
    found = mine.groupBy("list_", "mb_", "qb_").cogroup(asked.groupBy("list", "mb", "qb")).applyInArrow(_compare(model, cosine), "a string, b string, n long")
    return found
