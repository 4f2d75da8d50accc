"""N-gram Jaccard join by grouped prefixes.

The sets are the distinct word n-grams of whole texts. One pass over the texts sends each gram, as a hash with its
document's place, to a bucket; buckets count in how many documents a gram lies (exactly, up to hash collisions that can
only raise a count, which keeps the filters safe) and send back only grams that at least two documents hold. The global
order of the prefix filter is (document frequency, hash): grams that no other document has fill the prefix first and join
with nothing, so most documents leave here.

Texts with equal sets are one member (hot groups of copies fold in a map-side aggregate). Members with identical prefixes
and size form one group; groups that share a prefix gram are filtered by size, position and the greatest overlap their
shared grams allow. Before groups are expanded, each bucket links its members to a few hubs, and what these verified links
connect already is not compared again: no bucket emits all of its pairs, and no link between unconnected texts is lost.
"""

from __future__ import annotations

from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import WordHash, materialize, ngram_hashes, total_bytes, word_array, words_of
from textloom.llm.components import connected_components

_GRAMS = "bucket long, chunk long, a binary, b binary, c binary"
_DOCS = "doc_id long, n long, fp binary, key long, pos int, shared long, sig long"


def gram_set(text: str | None, n: int, hashes: WordHash) -> np.ndarray:
    return np.unique(ngram_hashes(word_array(words_of(text), hashes), n))


def fingerprint(grams: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(grams.tobytes())


def _scatter(n: int, buckets: int, per_chunk: int):
    """Texts -> per chunk: a row of ids, sizes and fingerprints, and a row per bucket with (hash, place of document)."""

    def run(batches):
        from pyspark import TaskContext

        hashes, part, seq = WordHash(), TaskContext.get().partitionId(), 0
        ids, sets, held = [], [], 0

        def flush():
            nonlocal ids, sets, held, seq
            chunk = (part << 24) | seq
            seq += 1
            sizes = np.array([len(s) for s in sets], np.int64)
            rows = [(-1 - chunk, chunk, np.array(ids, np.int64).tobytes(), sizes.tobytes(), b"".join(fingerprint(s) for s in sets))]
            h = np.concatenate(sets)
            place = np.repeat(np.arange(len(sets), dtype=np.uint16), sizes)
            to = (h % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(to.astype(np.uint16) if buckets <= 1 << 16 else to, kind="stable")
            low, place, to = (h[order] >> np.uint64(32)).astype(np.uint32), place[order], to[order]
            cuts = np.flatnonzero(np.diff(to)) + 1
            for lo, hi in zip([0, *cuts], [*cuts, len(to)], strict=True):
                if hi > lo:
                    rows.append((int(to[lo]), chunk, low[lo:hi].tobytes(), place[lo:hi].tobytes(), None))
            ids, sets, held = [], [], 0
            for k in range(0, len(rows), 64):
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows[k : k + 64], strict=True), (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()), strict=True)], names=["bucket", "chunk", "a", "b", "c"])

        for batch in batches:
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                s = gram_set(text.as_py(), n, hashes)
                ids.append(i)
                sets.append(s)
                held += len(s)
                if held >= per_chunk or len(ids) == 1 << 16:
                    yield from flush()
        if ids:
            yield from flush()

    return run


def _count(table: pa.Table) -> pa.Table:
    """One bucket: keep grams of two or more documents, with that number, for each chunk. A chunk's own row passes."""
    buckets = table.column("bucket").to_pylist()
    if not buckets or buckets[0] < 0:
        return table
    bucket, chunks = buckets[0], table.column("chunk").to_pylist()
    a = [np.frombuffer(x, np.uint32) for x in table.column("a").to_pylist()]
    b = [np.frombuffer(x, np.uint16) for x in table.column("b").to_pylist()]
    h, src = np.concatenate(a), np.repeat(np.arange(len(a), dtype=np.int32), [len(x) for x in a])
    place = np.concatenate(b)
    order = np.argsort(h, kind="stable")
    h, src, place = h[order], src[order], place[order]
    starts = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
    runs = np.diff(np.r_[starts, len(h)])
    df = np.repeat(runs, runs)
    keep = df >= 2
    h, src, place, df = h[keep], src[keep], place[keep], df[keep].astype(np.int64)
    order = np.argsort(src, kind="stable")
    h, src, place, df = h[order], src[order], place[order], df[order]
    cuts = np.flatnonzero(np.diff(src)) + 1
    key = (np.int64(bucket) << np.int64(32)) | h.astype(np.int64)
    rows = [(bucket, chunks[src[lo]], place[lo:hi].tobytes(), key[lo:hi].tobytes(), df[lo:hi].astype(np.uint32).tobytes()) for lo, hi in zip([0, *cuts], [*cuts, len(src)], strict=True) if hi > lo]
    return pa.Table.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()))], names=["bucket", "chunk", "a", "b", "c"])


def _prefixes(threshold: Fraction):
    """One chunk: a row for each document (key null), and one for each shared gram of its prefix."""

    def run(table: pa.Table) -> pa.Table:
        buckets = np.array(table.column("bucket").to_pylist())
        a, b, c = (table.column(x).to_pylist() for x in "abc")
        me = int(np.flatnonzero(buckets < 0)[0])
        ids, sizes = np.frombuffer(a[me], np.int64), np.frombuffer(b[me], np.int64)
        fps = [c[me][16 * k : 16 * k + 16] for k in range(len(ids))]
        rest = [k for k in range(len(a)) if k != me]
        empty = np.empty(0, np.int64)
        place = np.concatenate([np.frombuffer(a[k], np.uint16) for k in rest]) if rest else empty
        key = np.concatenate([np.frombuffer(b[k], np.int64) for k in rest]) if rest else empty
        df = np.concatenate([np.frombuffer(c[k], np.uint32) for k in rest]) if rest else empty
        order = np.lexsort((key, df, place))
        place, key = place[order], key[order]
        shared = np.bincount(place.astype(np.int64), minlength=len(ids))
        first = np.r_[0, np.cumsum(shared)]
        out = [[], [], [], [], [], [], []]

        def put(*row):
            for column, x in zip(out, row, strict=True):
                column.append(x)

        for k, (i, n, s) in enumerate(zip(ids.tolist(), sizes.tolist(), shared.tolist(), strict=True)):
            put(i, n, fps[k], None, None, s, None)
            if not n:
                continue
            need = -(-threshold.numerator * n // threshold.denominator)
            p, alone = n - need + 1, n - s
            if p <= alone:
                continue
            keys = key[first[k] : first[k] + p - alone]
            sig = xxhash.xxh3_64_intdigest(keys.tobytes(), seed=n) - (1 << 63)
            for pos, x in enumerate(keys.tolist()):
                put(i, n, fps[k], x, alone + pos, s, sig)
        kinds = (pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int32(), pa.int64(), pa.int64())
        return pa.Table.from_arrays([pa.array(x, t) for x, t in zip(out, kinds, strict=True)], names=["doc_id", "n", "fp", "key", "pos", "shared", "sig"])

    return run


def _sets(n: int):
    """Texts of wanted members -> (fp, grams); a text whose id has another text's fingerprint is passed over."""

    def run(batches):
        hashes = WordHash()
        for batch in batches:
            fps, grams = [], []
            for want, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                s = gram_set(text.as_py(), n, hashes)
                if fingerprint(s) == want:
                    fps.append(want)
                    grams.append(s.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(fps, pa.binary()), pa.array(grams, pa.binary())], names=["fp", "grams"])

    return run


def _verify(threshold: Fraction):
    def run(batches):
        for batch in batches:
            a, b, keep = batch.column(0).to_pylist(), batch.column(1).to_pylist(), []
            for k, (x, y) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                if threshold.denominator * both >= threshold.numerator * (len(x) + len(y) - both):
                    keep.append(k)
            yield pa.RecordBatch.from_arrays([pa.array([a[k] for k in keep], pa.binary()), pa.array([b[k] for k in keep], pa.binary())], names=["a", "b"])

    return run


def _can_link(x: str, y: str, t: Fraction) -> str:
    """SQL: sizes and shared grams of two sides allow the threshold."""
    most = f"least({x}.shared, {y}.shared)"
    return f"{t.denominator} * {most} >= {t.numerator} * ({x}.n + {y}.n - {most})"


def jaccard_components(docs: DataFrame, n: int = 5, threshold: Fraction | float = Fraction(4, 5), id_col: str = "doc_id", text_col: str = "text", per_chunk: int = 2_000_000, broadcast_ids: int = 200_000) -> DataFrame:
    """One row for each row of docs: doc_id, n_shingles, component_id (least id reachable by links).

    Two texts link when the Jaccard index of their sets of distinct word n-grams is at least threshold. A text with fewer
    words is one gram; null and empty texts have no gram, link with nothing and are their own component. Rows that repeat
    an id count as several texts of that id. A row with a null id is returned with a null component. Other columns of
    docs are ignored. per_chunk bounds what a task holds; broadcast_ids is the number of ids up to which texts of
    candidates are fetched by a broadcast join, beyond it by a shuffled one."""
    t = Fraction(threshold).limit_denominator(10_000)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    _, size = total_bytes(docs, "text")
    buckets = max(64, -(-size // (14 << 20)))
    named = docs.where("doc_id is not null")
    grams = named.mapInArrow(_scatter(n, buckets, per_chunk), _GRAMS)
    counted = grams.groupBy("bucket").applyInArrow(_count, _GRAMS)
    rows = materialize(counted.groupBy("chunk").applyInArrow(_prefixes(t), _DOCS), "prefixes")

    members = rows.where("key is not null").groupBy("key", "fp").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.first("pos").alias("pos"), F.first("shared").alias("shared"), F.first("sig").alias("sig"))
    hubs = members.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.min(F.struct(F.expr("(n - shared) / n"), "fp")).getField("fp").alias("h1"), F.min(F.struct(F.xxhash64("fp"), "fp")).getField("fp").alias("h2"), F.max(F.struct("n", "fp")).getField("fp").alias("h3"))
    met = materialize(members.join(hubs.where("size > 1"), "key"), "members")

    wanted = met.groupBy("fp").agg(F.min("doc_id").alias("doc_id"))
    wanted = materialize(wanted, "wanted")
    asked = F.broadcast(wanted) if wanted.count() <= broadcast_ids else wanted
    sets = materialize(docs.join(asked, "doc_id").select("fp", "text").mapInArrow(_sets(n), "fp binary, grams binary").dropDuplicates(["fp"]), "sets")

    def verified(pairs: DataFrame) -> DataFrame:
        x, y = sets.select(F.col("fp").alias("a"), F.col("grams").alias("x")), sets.select(F.col("fp").alias("b"), F.col("grams").alias("y"))
        return pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInArrow(_verify(t), "a binary, b binary")

    facts = met.groupBy("fp").agg(F.first("n").alias("n"), F.first("shared").alias("shared"))
    star = met.select(F.explode(F.array("h1", "h2", "h3")).alias("a"), F.col("fp").alias("b")).where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    near = star.join(facts.alias("p"), F.expr("a = p.fp")).join(facts.alias("q"), F.expr(f"b = q.fp and {_can_link('p', 'q', t)}")).select("a", "b")
    links = materialize(verified(near), "links")
    joined = connected_components(links)

    placed = met.join(joined.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    placed = materialize(placed.select("key", "fp", "n", "pos", "shared", "sig", "component"), "placed")
    mixed = placed.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x <> y").select("key")
    groups = placed.join(mixed, "key", "left_semi").groupBy("key", "sig").agg(F.first("n").alias("n"), F.first("pos").alias("pos"), F.max("shared").alias("shared"), F.min("component").alias("lo"), F.max("component").alias("hi"))
    by_position = f"{t.denominator + t.numerator} * (1 + least(p.n - p.pos, q.n - q.pos) - 1) >= {t.numerator} * (p.n + q.n)"
    group_pairs = (
        groups.alias("p").join(groups.alias("q"), F.expr(f"p.key = q.key and p.sig <= q.sig and not (p.lo = p.hi and q.lo = q.hi and p.lo = q.lo) and {_can_link('p', 'q', t)} and {by_position}"))
        .select(F.col("p.sig").alias("s1"), F.col("q.sig").alias("s2")).distinct()
    )
    inside = placed.select("sig", "fp", "n", "shared", "component").distinct()
    pairs = (
        group_pairs.join(inside.alias("p"), F.expr("s1 = p.sig"))
        .join(inside.alias("q"), F.expr(f"s2 = q.sig and p.component <> q.component and (s1 <> s2 or p.fp < q.fp) and {_can_link('p', 'q', t)}"))
        .select(F.least("p.fp", "q.fp").alias("a"), F.greatest("p.fp", "q.fp").alias("b")).distinct()
    )
    more = materialize(verified(pairs), "more")
    joined = connected_components(links.unionByName(more)) if more.take(1) else joined

    own = rows.where("key is null")
    by_text = own.where("n > 0").groupBy("fp").agg(F.min("doc_id").alias("least_id"))
    by_text = by_text.join(joined.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    labels = by_text.groupBy("component").agg(F.min("least_id").alias("component_id"))
    labelled = by_text.join(labels, "component").select("fp", "component_id")
    out = own.join(labelled, "fp", "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))
    unnamed = docs.where("doc_id is null").mapInArrow(_sizes(n), "n_shingles long").select(F.lit(None).cast("long").alias("doc_id"), "n_shingles", F.lit(None).cast("long").alias("component_id"))
    return out.unionByName(unnamed)


def _sizes(n: int):
    def run(batches):
        hashes = WordHash()
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([len(gram_set(x.as_py(), n, hashes)) for x in batch.column(1)], pa.int64())], names=["n_shingles"])

    return run
