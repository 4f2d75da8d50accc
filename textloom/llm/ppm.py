"""Language-model scores: prediction by partial matching over bytes, and a token unigram as the base.

The pretrained model is a byte-context trie of order 4 with escape estimation C and full symbol exclusion. The
probability of a symbol in such a trie is a function of its last five symbols alone, so neither the trie nor the texts
are gathered: chunks of documents send their distinct five-grams (and words), with counts in the training documents, to
buckets; a bucket of contexts that share their last two symbols merges the counts, builds its part of the trie and
answers each chunk with log probabilities. When there are more chunks than `fan_in`, requests merge and answers return
through a tree, so a bucket never holds more than `fan_in` requests. Orders 1 and 0 need 257 x 257 counts, which are
broadcast: that size is fixed.

`AdaptivePPM` is the same model as a plain trie, one text at a time; it can also learn while it scores.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import WordHash, mix, total_bytes, word_array, words_of

ORDER = 4
SYMBOLS = 257  # bytes, and 256 for the start and the end of a text
_END_WORD = np.uint64(0x5EED0FE2D0C5)
_ROWS = "bucket int, node long, keys binary, counts binary, extra binary"


class AdaptivePPM:
    """A byte-context trie: counts of symbols after each context of at most `order` symbols."""

    def __init__(self, order: int = ORDER):
        self.order, self.after = order, {}

    @staticmethod
    def _symbols(text: str, order: int) -> list[int]:
        return [256] * order + list(text.encode("utf-8", "surrogatepass")) + [256]

    def learn_symbol(self, context: tuple[int, ...], x: int) -> None:
        for k in range(len(context) + 1):
            self.after.setdefault(context[k:], Counter())[x] += 1

    def log10(self, context: tuple[int, ...], x: int) -> float:
        out, p = set(), 0.0
        for k in range(len(context) + 1):
            seen = {y: c for y, c in self.after.get(context[k:], {}).items() if y not in out}
            if not seen:
                continue
            total = sum(seen.values()) + len(seen)
            if x in seen:
                return p + math.log10(seen[x] / total)
            p += math.log10(len(seen) / total)
            out |= seen.keys()
        return p - math.log10(SYMBOLS - len(out))

    def learn(self, text: str) -> None:
        s = self._symbols(text, self.order)
        for i in range(self.order, len(s)):
            self.learn_symbol(tuple(s[i - self.order : i]), s[i])

    def score(self, text: str, adapt: bool = False) -> float:
        s, total = self._symbols(text, self.order), 0.0
        for i in range(self.order, len(s)):
            context = tuple(s[i - self.order : i])
            total += self.log10(context, s[i])
            if adapt:
                self.learn_symbol(context, s[i])
        return total


def _five_grams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Codes of all five-grams of padded texts, 9 bits a symbol with the oldest first, and how many each text has."""
    pad, sizes = b"\0" * ORDER, np.array([len(t) + 1 for t in texts], np.int64)
    raw = np.frombuffer(b"".join(pad + t + b"\0" for t in texts), np.uint8).astype(np.int64)
    starts = np.r_[0, np.cumsum(sizes + ORDER)[:-1]]
    for j in range(ORDER):
        raw[starts + j] = 256
    raw[starts + sizes + ORDER - 1] = 256
    code = raw[:-ORDER].copy()
    for j in range(1, ORDER + 1):
        code = (code << 9) | raw[j : len(raw) - ORDER + j]
    keep = np.ones(len(code), bool)
    for j in range(ORDER):  # windows that begin inside a text and end in the next
        at = (starts + sizes + j)[:-1]
        keep[at] = False
    return code[keep], sizes


def _distinct(codes: np.ndarray, counted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes, and how often each comes among the counted."""
    if not len(codes):
        return codes, np.empty(0, np.int64)
    order = np.argsort(codes, kind="stable")
    codes, counted = codes[order], counted[order]
    starts = np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]])
    return codes[starts], np.add.reduceat(counted.astype(np.int64), starts)


def _table(rows: list[tuple]) -> pa.Table:
    kinds = (pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary())
    return pa.Table.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=["bucket", "node", "keys", "counts", "extra"])


def _merge_counted(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    return _distinct(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]))


def _words_and_marks(text: str | None, hashes: WordHash) -> np.ndarray:
    return np.r_[word_array(words_of(text), hashes), _END_WORD].view(np.int64)


def _bucket_of(codes: np.ndarray, kind: str, buckets: int) -> np.ndarray:
    part = codes.view(np.uint64) if kind == "w" else ((codes >> 9) & 0x3FFFF).astype(np.uint64)
    return (mix(part) % np.uint64(buckets)).astype(np.int64)


def _requests(buckets: int):
    """One chunk: for each bucket its distinct words and five-grams with training counts. Buckets of words are 0 .. B-1, those of grams B .. 2B-1."""

    def run(table: pa.Table) -> pa.Table:
        chunk, hashes = table.column("chunk")[0].as_py(), WordHash()
        texts, learns = table.column("text").to_pylist(), np.array(table.column("learn").to_pylist(), bool)
        found = {"w": [], "g": []}
        for k in range(0, len(texts), 500):
            some, train = [t or "" for t in texts[k : k + 500]], learns[k : k + 500]
            words = [_words_and_marks(t, hashes) for t in some]
            found["w"].append(_distinct(np.concatenate(words), np.repeat(train, [len(w) for w in words])))
            codes, sizes = _five_grams([t.encode("utf-8", "surrogatepass") for t in some])
            found["g"].append(_distinct(codes, np.repeat(train, sizes)))
        rows = []
        for kind, base in (("w", 0), ("g", buckets)):
            keys, counts = _merge_counted(found[kind])
            to = _bucket_of(keys, kind, buckets)
            order = np.argsort(to, kind="stable")
            keys, counts, to = keys[order], counts[order], to[order]
            ends = np.searchsorted(to, np.arange(buckets + 1))
            rows += [(base + b, chunk, keys[ends[b] : ends[b + 1]].tobytes(), counts[ends[b] : ends[b + 1]].tobytes(), None) for b in range(buckets)]
        return _table(rows)

    return run


def _unpack(table: pa.Table) -> tuple[int, list[int], list[np.ndarray], list[np.ndarray]]:
    return table.column("bucket")[0].as_py(), table.column("node").to_pylist(), [np.frombuffer(x, np.int64) for x in table.column("keys").to_pylist()], [np.frombuffer(x, np.int64) for x in table.column("counts").to_pylist()]


def _merge(fan_in: int):
    def run(table: pa.Table) -> pa.Table:
        bucket, nodes, keys, counts = _unpack(table)
        k, c = _merge_counted(list(zip(keys, counts, strict=True)))
        return _table([(bucket, nodes[0] // fan_in, k.tobytes(), c.tobytes(), None)])

    return run


def _trie_log10(codes: np.ndarray, counts: np.ndarray, one: np.ndarray) -> np.ndarray:
    """log10 P(symbol | context) of all five-grams of contexts that share their last two symbols with others here.

    codes: all five-grams asked for or seen, counts: how often in training (0: asked for only). one[c, x]: counts of x
    after c, of all training texts. Order by order from the longest: what a shorter context offers is taken without the
    symbols the next longer one has shown."""
    p, open_ = np.zeros(len(codes)), np.ones(len(codes), bool)
    seen_longer = None  # (contexts, symbols, D) of the next longer order
    for k in (4, 3, 2, 1, 0):
        if k >= 2:
            part = codes & ((1 << 9 * (k + 1)) - 1)
            grams, at = np.unique(part, return_inverse=True)
            n = np.bincount(at, counts, len(grams))
            grams, n = grams[n > 0], n[n > 0]
        else:
            tails = np.unique((codes >> 9) & 511)
            if k == 1:
                r, s = np.nonzero(one[tails])
                grams, n = (tails[r] << 9) | s, one[tails[r], s]
            else:
                zero = one.sum(axis=0)
                grams = np.flatnonzero(zero)
                n = zero[grams]
            part = codes & ((1 << 9 * (k + 1)) - 1)
        contexts, at = np.unique(grams >> 9, return_inverse=True)
        total, kinds = np.bincount(at, n, len(contexts)), np.bincount(at, minlength=len(contexts))

        def find(sorted_keys: np.ndarray, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            if not len(sorted_keys):
                return np.zeros(len(asked), np.int64), np.zeros(len(asked), bool)
            i = np.minimum(np.searchsorted(sorted_keys, asked), len(sorted_keys) - 1)
            return i, sorted_keys[i] == asked

        mine, known = find(contexts, part >> 9)
        t, d = np.where(known, total[mine] if len(total) else 0, 0.0), np.where(known, kinds[mine] if len(kinds) else 0, 0)
        if seen_longer is not None:
            longer, lx, lk = seen_longer  # contexts of order k + 1, their grams, how many symbols each has shown
            lower, ok = find(grams, lx & ((1 << 9 * (k + 1)) - 1))
            gone = np.bincount(np.searchsorted(longer, lx >> 9), np.where(ok, n[lower] if len(n) else 0, 0), len(longer))
            which, hit = find(longer, codes >> 9 & ((1 << 9 * (k + 1)) - 1))
            if len(longer):
                t, d = t - np.where(hit, gone[which], 0), d - np.where(hit, lk[which], 0)
        g, shown = find(grams, part)
        take = open_ & shown
        p[take] += np.log10(n[g[take]] / (t[take] + d[take]))
        open_ &= ~shown
        skip = open_ & (d > 0)
        p[skip] += np.log10(d[skip] / (t[skip] + d[skip]))
        seen_longer = (contexts, grams, kinds)
    p[open_] -= np.log10(SYMBOLS - len(seen_longer[1]))
    return p


def _answer_top(buckets: int, one):
    """The last bucket of a key range: merge what at most fan_in requests ask, and answer each."""

    def run(table: pa.Table) -> pa.Table:
        bucket, nodes, keys, counts = _unpack(table)
        k, c = _merge_counted(list(zip(keys, counts, strict=True)))
        if bucket < buckets:
            values, extra = c, np.array([c.sum(), (c > 0).sum()], np.int64).tobytes()
        else:
            values, extra = _trie_log10(k, c, one.value), None
        return _table([(bucket, node, asked.tobytes(), values[np.searchsorted(k, asked)].tobytes(), extra) for node, asked in zip(nodes, keys, strict=True)])

    return run


def _answer(asked: pa.Table, known: pa.Table) -> pa.Table:
    """Pass the answers of a merged request on to those it came from."""
    if not asked.num_rows:
        return _table([])
    bucket, nodes, keys, _ = _unpack(asked)
    k, values, extra = np.frombuffer(known.column("keys")[0].as_py(), np.int64), known.column("counts")[0].as_py(), known.column("extra")[0].as_py()
    values = np.frombuffer(values, np.int64)  # bits only: doubles pass unchanged
    return _table([(bucket, node, a.tobytes(), values[np.searchsorted(k, a)].tobytes(), extra) for node, a in zip(nodes, keys, strict=True)])


_SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _score(buckets: int):
    """One chunk with its answers: scores of its documents."""

    def run(docs: pa.Table, told: pa.Table) -> pa.Table:
        import pandas as pd

        hashes, known = WordHash(), {"w": ([], []), "g": ([], [])}
        total = kinds = 0
        for bucket, keys, values, extra in zip(*(told.column(c).to_pylist() for c in ("bucket", "keys", "counts", "extra")), strict=True):
            kind = "w" if bucket < buckets else "g"
            known[kind][0].append(np.frombuffer(keys, np.int64))
            known[kind][1].append(np.frombuffer(values, np.int64 if kind == "w" else np.float64))
            if kind == "w":
                n, v = np.frombuffer(extra, np.int64)
                total, kinds = total + int(n), kinds + int(v)
        index = {kind: (pd.Index(np.concatenate(a)), np.concatenate(b)) for kind, (a, b) in known.items()}
        out = []
        texts, learns, ids = docs.column("text").to_pylist(), docs.column("learn").to_pylist(), docs.column("doc_id").to_pylist()
        for k in range(0, len(texts), 200):
            some = [t or "" for t in texts[k : k + 200]]
            words = [_words_and_marks(t, hashes) for t in some]
            sizes = np.array([len(w) for w in words])
            c = index["w"][1][index["w"][0].get_indexer(np.concatenate(words))]
            ends = np.r_[0, np.cumsum(sizes)[:-1]]
            base = np.add.reduceat(np.log10((c + 1) / (total + kinds + 1)), ends)
            seen = np.add.reduceat((c > 0).astype(np.int64), ends)
            codes, n = _five_grams([t.encode("utf-8", "surrogatepass") for t in some])
            p = np.add.reduceat(index["g"][1][index["g"][0].get_indexer(codes)], np.r_[0, np.cumsum(n)[:-1]])
            out += zip(ids[k : k + 200], (not x for x in learns[k : k + 200]), sizes.tolist(), seen.tolist(), [total] * len(some), base.tolist(), p.tolist(), strict=True)
        kinds_ = (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64())
        return pa.Table.from_arrays([pa.array([r[j] for r in out], t) for j, t in enumerate(kinds_)], names=[x.split()[0] for x in _SCORES.split(", ")])

    return run


def _pairs(batches):
    """Counts of each symbol after each: what orders 1 and 0 need."""
    one = np.zeros(512 * 512, np.int64)
    for batch in batches:
        texts = [(t or "").encode("utf-8", "surrogatepass") for t in batch.column(0).to_pylist()]
        for k in range(0, len(texts), 500):
            if some := texts[k : k + 500]:
                codes, _ = _five_grams(some)
                one += np.bincount(codes & 0x3FFFF, minlength=512 * 512)
    at = np.flatnonzero(one)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(one[at])], names=["pair", "n"])


def lm_scores(docs: DataFrame, learn, id_col: str = "doc_id", text_col: str = "text", chunk_bytes: int = 16 << 20, fan_in: int = 256) -> DataFrame:
    """One row for each row of docs: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    learn: boolean Column over docs, the rows that both models learn from. score is the log10 probability of the text,
    its end included, under the pretrained trie; base_score that of its tokens under the add-one unigram. A null text is
    empty: one token, its end. Repeated ids and null ids are rows like any other; without training rows every symbol is
    equally likely. Columns of docs other than the id and the text are ignored (learn may use them). Words are told apart
    by 64-bit hashes."""
    spark = docs.sparkSession
    named = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.coalesce(learn, F.lit(False)).alias("learn"))
    _, size = total_bytes(named, "text")
    chunks = max(8, -(-size // chunk_bytes))
    buckets = max(32, int(32 * math.sqrt(size / 1e9)))
    one = np.zeros((512, 512), np.int64)
    for r in named.where("learn").select("text").mapInArrow(_pairs, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).collect():  # at most 257 x 257 rows
        one[r["pair"] >> 9, r["pair"] & 511] = r["n"]
    one = spark.sparkContext.broadcast(one)
    parts = named.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "text"), F.lit(chunks)))
    by_chunk = parts.groupBy("chunk")
    levels = [by_chunk.applyInArrow(_requests(buckets), _ROWS)]
    n = chunks
    while n > fan_in:
        levels.append(levels[-1].withColumn("up", F.expr(f"node div {fan_in}")).groupBy("bucket", "up").applyInArrow(_merge(fan_in), _ROWS))
        n = -(-n // fan_in)
    told = levels[-1].groupBy("bucket").applyInArrow(_answer_top(buckets, one), _ROWS)
    for asked in reversed(levels[:-1]):
        told = asked.withColumn("up", F.expr(f"node div {fan_in}")).groupBy("bucket", "up").cogroup(told.groupBy("bucket", "node")).applyInArrow(_answer, _ROWS)
    return by_chunk.cogroup(told.groupBy("node")).applyInArrow(_score(buckets), _SCORES)
