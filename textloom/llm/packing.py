"""Best-fit packing by exact-complement hashing.

Where a piece goes depends on its length alone, so the packing is worked out on the histogram of lengths (at most
seq_len - 1 numbers, whatever the corpus): for each longest length the gap it leaves is looked up among single, pair and
triple sums of lengths still available, and as many sequences as the counts allow are closed exactly; what remains is
packed best-fit decreasing, by counts. The plan says which ranks of each length go where; pieces get their rank within
their length from a count per task and a running sum, without sorting or gathering them anywhere.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textloom.llm.common import materialize

_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, rank long"
_SINGLE_SPACE = re.compile(r"(?<=\S) (?=\S)")


#: Fixed value: how byte-level tokenizers part a text before they merge bytes.
_PARTS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _same_as_ranks(path: str):
    """The file's vocabulary as a tiktoken encoding, if it is plain byte-level BPE whose ids are in the order of merges, so
    that both give the same ids; else None."""
    import json

    import tiktoken

    with open(path, encoding="utf-8") as f:
        t = json.load(f)
    pre, model = t.get("pre_tokenizer") or {}, t["model"]
    plain = pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True)
    if not plain or t.get("normalizer") or model.get("type") not in (None, "BPE") or model.get("byte_fallback") or model.get("dropout"):
        return None
    vocab, merges = model["vocab"], [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    if any(vocab.get(a + b) != 256 + k for k, (a, b) in enumerate(merges)):
        return None
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(x): x for x in shown} | {chr(256 + k): x for k, x in enumerate(x for x in range(256) if x not in set(shown))}
    special = {x["content"] for x in t.get("added_tokens", [])}
    return tiktoken.Encoding("file", pat_str=_PARTS, mergeable_ranks={bytes(byte[c] for c in w): i for w, i in vocab.items() if w not in special}, special_tokens={})


class Encoder:
    """ids of whole texts as little-endian uint32 bytes, by a byte-level BPE of `tokenizers`.

    Such a tokenizer never joins what a single space between two other characters parts, so the stretches between such
    spaces are encoded once and remembered. A text with other white space next to a space is cut only where that holds; one
    that spells out an added token of the file goes to the tokenizer as it is, which gives that token's own id."""

    def __init__(self, path: str, limit: int = 300_000):
        from tokenizers import Tokenizer

        self.tk = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tk.get_added_tokens_decoder().values()]
        self.limit, self.known, self.first = limit, {}, {}
        vocab = self.tk.get_vocab(with_added_tokens=True)
        self.fast = _same_as_ranks(path)
        self.opens = np.zeros(max(vocab.values()) + 1, bool)
        self.opens[[i for t, i in vocab.items() if t.startswith("Ġ")]] = True

    def _ids(self, text: str) -> bytes:
        return self._array(text).tobytes()

    def _array(self, text: str) -> np.ndarray:
        return np.array(self.fast.encode_ordinary(text) if self.fast else self.tk.encode(text, add_special_tokens=False).ids, "<u4")

    def _learn(self, new: list[str]) -> None:
        for k in range(0, len(new), 2000):
            some = new[k : k + 2000]
            ids = self._array(" " + " ".join(some))
            cuts = np.flatnonzero(self.opens[ids])
            if len(cuts) == len(some):
                raw = ids.tobytes()
                ends = [*(cuts[1:] * 4).tolist(), len(raw)]
                self.known.update((s, raw[a:b]) for s, a, b in zip(some, (cuts * 4).tolist(), ends, strict=True))
            else:
                self.known.update((s, self._ids(" " + s)) for s in some)

    def encode(self, texts: list[str]) -> list[bytes]:
        cut, seen = [], set()
        for text in texts:
            if any(t in text for t in self.added):
                cut.append(None)
                continue
            parts = text.split(" ")
            if any(not p or p[0].isspace() or p[-1].isspace() for p in set(parts).difference(self.known)):
                parts = _SINGLE_SPACE.split(text)
            cut.append(parts)
            seen.update(parts[1:])
        if len(self.known) > self.limit:
            self.known.clear()
            self.first.clear()
        self._learn([s for s in seen if s not in self.known])
        out = []
        for text, parts in zip(texts, cut, strict=True):
            if parts is None:
                out.append(np.array(self.tk.encode(text, add_special_tokens=False).ids, "<u4").tobytes())
                continue
            head = self.first.get(parts[0])
            if head is None:
                head = self.first[parts[0]] = self._ids(parts[0])
            out.append(head + b"".join(map(self.known.__getitem__, parts[1:])))
        return out


def _cut(path: str, end_id: int, seq_len: int):
    """Texts -> pieces, each with its number among the task's pieces of its length."""

    def run(batches):
        from pyspark import TaskContext

        encoder, part = Encoder(path), TaskContext.get().partitionId()
        end, seen = np.array([end_id], "<u4").tobytes(), defaultdict(int)
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1)
            for k in range(0, len(ids), 256):
                rows = []
                for i, raw in zip(ids[k : k + 256], encoder.encode([x or "" for x in texts[k : k + 256].to_pylist()]), strict=True):
                    raw += end
                    n, start, piece = len(raw) // 4, 0, 0
                    while start < n:
                        stop = start + ((n - start) % seq_len or seq_len)
                        rows.append((i, piece, start, stop - start, zlib.crc32(raw[4 * start : 4 * stop]), part, seen[stop - start]))
                        seen[stop - start] += 1
                        start, piece = stop, piece + 1
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()), strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32", "part", "rank"])

    return run


class Closer:
    """Combinations of lengths that fill a sequence exactly, found by the complement of the longest of them.

    What is available is indexed by length, and its pairs by their sum: sum -> larger members. The gap that a longest length
    leaves is looked up as it is (single), among the sums of pairs, and, less one further length, among them again (triple).
    Members as equal as can be come first: short lengths fit nearly everywhere and are worth keeping."""

    def __init__(self, available: np.ndarray, size: int):
        self.av, self.size = available, size
        have = np.flatnonzero(available)
        self.pairs: list[list[int]] = [[] for _ in range(size)]
        for a in have.tolist():
            for b in have[have <= min(a, size - 1 - a)].tolist():
                self.pairs[a + b].append(a)

    def _use(self, out: list, *lengths: int) -> None:
        need = Counter(lengths)
        times = min(int(self.av[x]) // k for x, k in need.items())
        if times > 0:
            for x, k in need.items():
                self.av[x] -= k * times
            out.append((lengths, times))

    def _two(self, out: list, held: tuple[int, ...], gap: int) -> None:
        for a in self.pairs[gap] if gap < self.size else ():
            if a > held[-1] or not all(self.av[x] for x in held):
                break
            if self.av[a] and self.av[gap - a]:
                self._use(out, *held, a, gap - a)

    def close(self, members: int) -> list[tuple[tuple[int, ...], int]]:
        """Longest first, what fits exactly with one, two or three further lengths, as often as the counts allow; lowers them."""
        out: list[tuple[tuple[int, ...], int]] = []
        for top in range(self.size - 1, 0, -1):
            gap = self.size - top
            if members == 1:
                if gap <= top and self.av[top] and self.av[gap]:
                    self._use(out, top, gap)
            elif members == 2:
                self._two(out, (top,), gap)
            else:
                for a in range(-(-gap // 3), min(top, gap - 2) + 1):
                    if not self.av[top]:
                        break
                    if self.av[a]:
                        self._two(out, (top, a), gap - a)
        return out


def _best_fit(av: np.ndarray, size: int) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing by counts: (lengths of a sequence, how many such sequences)."""
    open_: list[list[list]] = [[] for _ in range(size + 1)]
    for length in range(len(av) - 1, 0, -1):
        left = int(av[length])
        while left:
            gap = next((g for g in range(length, size) if open_[g]), size)
            held, count = open_[gap].pop() if gap < size else ((), left)
            each = gap // length
            full = min(count, left // each)
            if full:
                open_[gap - each * length].append([(*held, *[length] * each), full])
                left -= full * each
                count -= full
            if left and count:
                k = min(left, each)
                open_[gap - k * length].append([(*held, *[length] * k), 1])
                left -= k
                count -= 1
            if count and gap < size:
                open_[gap].append([held, count])
    return [(tuple(held), count) for held, count in (x for some in open_ for x in some)]


def _first(closed: list[tuple[tuple[int, ...], int]], keep: int, av: np.ndarray) -> list[tuple[tuple[int, ...], int]]:
    """The first `keep` sequences of what is closed; the lengths of the others become available again."""
    out = []
    for lengths, times in closed:
        k = min(times, keep)
        keep -= k
        if k:
            out.append((lengths, k))
        for x in lengths:
            av[x] += times - k
    return out


#: Fixed value: at how many evenly spaced points closing by pairs and triples may stop.
STOPS = 64


def plan_packing(counts: np.ndarray, size: int) -> list[tuple[tuple[int, ...], int]]:
    """counts[length] for lengths below size -> (lengths, times): exact complements, then best fit for what they leave.

    A sequence closed exactly wastes nothing, but closing by pairs and triples until nothing fits may leave too few short
    lengths for the residuals. So it stops where closed sequences and best-fit residuals together are fewest; of equal
    stops, the one that closes most. Single complements always stay."""
    closer = Closer(counts.copy(), size)
    single = closer.close(1)
    more = closer.close(2) + closer.close(3)
    total, best = sum(times for _, times in more), None
    for keep in sorted({total * k // STOPS for k in range(STOPS + 1)}, reverse=True):
        av = closer.av.copy()
        kept = _first(more, keep, av)
        plan = single + kept + _best_fit(av, size)
        used = sum(times for _, times in plan)
        if best is None or used < best[0]:
            best = used, plan
    return best[1]


def _places(plan: list[tuple[tuple[int, ...], int]]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """length -> (first rank, first sequence, offset) of each run of ranks, in order of rank."""
    runs, used, sequence = defaultdict(list), defaultdict(int), 0
    for lengths, times in plan:
        offset = 0
        for x in lengths:
            runs[x].append((used[x], sequence, offset))
            used[x] += times
            offset += x
        sequence += times
    return {x: tuple(np.array(c, np.int64) for c in zip(*r, strict=True)) for x, r in runs.items()}


def _put(places):
    def run(batches):
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            sequence, offset = np.empty(len(length), np.int64), np.empty(len(length), np.int64)
            for x in np.unique(length).tolist():
                at = np.flatnonzero(length == x)
                first, base, off = places.value[x]
                k = np.searchsorted(first, rank[at], side="right") - 1
                sequence[at] = base[k] + rank[at] - first[k]
                offset[at] = off[k]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")], pa.array(sequence), pa.array(offset)], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return run


def pack(docs: DataFrame, tokenizer_path: str | None = None, seq_len: int = 1024, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A text longer than seq_len tokens (its end id included) is cut into pieces of seq_len, the first one shorter if
    need be. A null text is empty and has the end id alone; rows that repeat an id or have a null one are packed like
    any other. Sequences are gapless from offset 0; full pieces have sequences of their own, with negative numbers. The
    plan has at most a few entries for each of the seq_len lengths, so what is broadcast does not grow with the corpus."""
    if tokenizer_path is None:
        import public_tokenizers

        tokenizer_path = public_tokenizers.path("byte_bpe_50k.json")
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    pieces = materialize(texts.mapInArrow(_cut(tokenizer_path, end_id, seq_len), _PIECES), "pieces")
    full = pieces.where(F.col("length") == seq_len).select("doc_id", "piece", "start", "length", "ids_crc32", (-1 - F.shiftleft(F.col("part").cast("long"), 40) - F.col("rank")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    short = pieces.where(F.col("length") < seq_len)
    tally = short.groupBy("length", "part").agg(F.count(F.lit(1)).alias("k"))
    counts = np.zeros(seq_len, np.int64)
    for r in tally.groupBy("length").agg(F.sum("k").alias("k")).collect():  # at most seq_len - 1 rows
        counts[r["length"]] = r["k"]
    places = spark.sparkContext.broadcast(_places(plan_packing(counts, seq_len)))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = tally.select("length", "part", F.coalesce(F.sum("k").over(before), F.lit(0)).alias("base"))
    ranked = short.join(base, ["length", "part"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("rank") + F.col("base")).alias("rank"))
    return ranked.mapInArrow(_put(places), full.schema).unionByName(full)
