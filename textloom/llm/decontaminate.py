"""Benchmark decontamination: n-gram seeds, then Smith-Waterman alignment.

Word n-grams of a test item are its seeds, all of them, however common in the corpus. They are as long as they can be
without losing anything: of so few words that no alignment which reaches the threshold can avoid all of them, whatever is
replaced, inserted or left out. One pass finds seeds in documents, sets aside what by the counts of seeds and words cannot
reach the threshold, and aligns the item with the passages left by local alignment of words: matches score, substitutions
and gaps cost, so edited and paraphrased copies still align over most of the item. The pass takes the items in blocks of
bounded size, one after the other, so neither what is broadcast nor what the driver holds grows with the benchmark.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import materialize

_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
MATCH, MISS, GAP = 2, -1, -1


def plain_words(text: str | None) -> list[bytes]:
    """Words of letters and digits, lower-cased; marks between them do not count."""
    return _WORD.findall(text.lower().encode("utf-8", "surrogatepass")) if text else []


#: Fixed value: most starts of passages aligned at once; bounds memory only.
STRETCH = 4096


class Items:
    """One block of test items: numbered words, and n-grams of each item as seeds.

    With a match worth 2 and a miss or gap -1, an alignment of m matches in r runs scores at most 2m - (r - 1), and all
    of an item's words score twice their number. So one that reaches `threshold` has at least that share of the words,
    at most `slack` misses and gaps, and a least number of seeds for its m; what fails these bounds needs no alignment.
    An item's seeds have the most words, n at most, for which that least number is one or more; an item of fewer than n
    words must be met whole, and is one seed."""

    def __init__(self, items: list[tuple[int, str]], n: int, threshold: float):
        kept = [(i, ws) for i, t in items if (ws := plain_words(t))]
        self.ids, words = [i for i, _ in kept], [ws for _, ws in kept]
        self.number = {w: k for k, w in enumerate(sorted({w for ws in words for w in ws}))}
        self.coded = [np.array([self.number[w] for w in ws], np.int64) for ws in words]
        self.least = [threshold * len(ws) if len(ws) >= n else float(len(ws)) for ws in words]
        self.slack = [int(2 * (len(ws) - x) + 1e-9) for ws, x in zip(words, self.least, strict=True)]
        self.prefixes: list[np.ndarray] = []  # by length less 2: sorted codes of the items' grams, whose places number them
        self.seeds: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}  # by length: grams, where their owners start, owners
        self.need = np.ones(len(kept), np.int64)
        lengths = []
        for k, ws in enumerate(words):
            sure = (g for g in range(min(n, len(ws)), 1, -1) if self.surely(k, g) >= 1)
            lengths.append(next(sure, 1))
        for g in range(2, max(lengths, default=1) + 1):
            self.prefixes.append(np.unique(np.concatenate([self.grams(ws, g) for ws in self.coded])))
        for g in sorted(set(lengths)):
            own = [k for k, x in enumerate(lengths) if x == g]
            grams = [self.grams(self.coded[k], g) for k in own]
            owner, code = np.repeat(own, [len(x) for x in grams]), np.concatenate(grams)
            order = np.argsort(code, kind="stable")
            seeds, start = np.unique(code[order], return_index=True)
            self.seeds[g] = seeds, np.append(start, len(code)), owner[order]
            for k in own:
                self.need[k] = max(1, math.ceil(self.surely(k, g) - 1e-9))

    def fewest(self, k: int, n: int, m):
        """Seeds in an accepted alignment of item k with m matches, at least: m less n - 1 for each run."""
        return m - (n - 1) * (2 * m - 2 * self.least[k] + 1)

    def surely(self, k: int, n: int) -> float:
        """Seeds in any accepted alignment of item k: `fewest` is linear in m, so least at one of the ends of its range."""
        return min(self.fewest(k, n, len(self.coded[k])), self.fewest(k, n, self.least[k]))

    def grams(self, ws: np.ndarray, n: int) -> np.ndarray:
        """Codes of n-grams, -1 where a gram's words, or its first ones together, are in no item. A gram is numbered among
        the items' grams of its length before a further word is added, so codes stay below grams times words."""
        if len(ws) < n:
            return np.empty(0, np.int64)
        m, base = len(ws) - n + 1, np.int64(len(self.number) + 1)
        code = ws[:m]
        for j in range(1, n):
            if j > 1:
                known = self.prefixes[j - 2]
                at = np.minimum(np.searchsorted(known, code), len(known) - 1)
                code = np.where(known[at] == code, at, -1)
            part = ws[j : m + j]
            code = np.where((code >= 0) & (part >= 0), code * base + part, -1)
        return code

    def code(self, ws: list[bytes]) -> np.ndarray:
        get = self.number.get
        return np.fromiter((get(w, -1) for w in ws), np.int64, len(ws))

    def candidates(self, ws: np.ndarray):
        """Items that may align, with the length of their seeds and the places of these."""
        for n, (seeds, start, owner) in self.seeds.items():
            g = self.grams(ws, n)
            if not len(g) or not len(seeds):
                continue
            at = np.minimum(np.searchsorted(seeds, g), len(seeds) - 1)
            places = np.flatnonzero(seeds[at] == g)
            at = at[places]
            met = np.unique(at)
            count = start[met + 1] - start[met]
            rows = np.repeat(start[met] - np.cumsum(count) + count, count) + np.arange(count.sum())
            enough = np.flatnonzero(np.bincount(owner[rows], minlength=len(self.ids)) >= self.need)
            for k in enough.tolist():
                own = places[np.isin(g[places], self.grams(self.coded[k], n))]
                within = np.searchsorted(own, own + len(self.coded[k]) + self.slack[k]) - np.arange(len(own))
                if within.max() >= self.need[k]:
                    yield k, n, own

    def passages(self, ws: np.ndarray, k: int, n: int, places: np.ndarray):
        """Stretches of the text, start and end, that hold every alignment of item k to be accepted: these start at one of
        its words and are no longer than its words and slack."""
        size, least = len(self.coded[k]), self.least[k]
        reach = size + self.slack[k]
        word = np.isin(ws, self.coded[k])
        before = np.append(0, np.cumsum(word))
        first = np.flatnonzero(word)
        m = np.minimum(before[np.minimum(first + reach, len(ws))] - before[first], size)
        seeds = np.searchsorted(places, first + reach - n + 1) - np.searchsorted(places, first)
        first = first[(m >= least - 1e-9) & (seeds >= np.maximum(1, self.fewest(k, n, m) - 1e-9))]
        for part in np.split(first, np.flatnonzero(np.diff(first) > reach) + 1) if len(first) else ():
            for low in range(int(part[0]), int(part[-1]) + 1, STRETCH):
                yield low, min(len(ws), min(low + STRETCH - 1, int(part[-1])) + reach)


def align(item: np.ndarray, passage: np.ndarray) -> tuple[int, int, int]:
    """Smith-Waterman over words: (best score, start, end of the passage aligned), end exclusive; of equal scores the first
    to end in the item, then in the passage.

    A row at a time, each with the place where its alignments start, so memory grows with the passage only; gaps along a
    row are a running maximum, as a gap costs the same for each word."""
    n = len(passage)
    places = np.arange(n + 1)
    steps = places * -GAP
    row, start, best = np.zeros(n + 1, np.int64), places, (0, 0, 0)
    for x in item.tolist():
        new, at = row + GAP, start.copy()
        diagonal = row[:-1] + np.where(passage == x, MATCH, MISS)
        better = diagonal >= new[1:]
        new[1:][better], at[1:][better] = diagonal[better], start[:-1][better]
        over = new <= 0
        new[over], at[over] = 0, places[over]
        lifted = new + steps
        top = np.maximum.accumulate(lifted)
        origin = np.maximum.accumulate(np.where(lifted == top, places, 0))
        row, start = top - steps, at[origin]
        over = row <= 0
        row[over], start[over] = 0, places[over]
        j = int(row.argmax())
        if row[j] > best[0]:
            best = int(row[j]), int(start[j]), j
    return best


_FOUND = "doc_id long, row long, item_id long, similarity double, start long, end long"


def _find(items, threshold: float):
    """Documents -> alignments of items, best passage for each document and item. Places are in words."""

    def run(batches):
        it = items.value
        for batch in batches:
            out = []
            for i, row, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                ws = it.code(plain_words(text.as_py()))
                for k, n, places in it.candidates(ws):
                    item, best = it.coded[k], (0.0, 0, 0)
                    for low, high in it.passages(ws, k, n, places):
                        score, s, e = align(item, ws[low:high])
                        best = max(best, (score / (MATCH * len(item)), low + s, low + e))
                    if 2 * best[0] * len(item) >= 2 * it.least[k] - 1e-9:
                        out.append((i, row, it.ids[k], *best))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], t) for c, t in enumerate(kinds)], names=[x.split()[0] for x in _FOUND.split(", ")])

    return run


def blocks_of(benchmark: DataFrame, n: int, threshold: float, block_bytes: int, item_col: str = "item_id", text_col: str = "text") -> Iterator[Items]:
    """The stated query set, in blocks of about block_bytes of text, one collected at a time. Null items are left out, and
    so are those without words."""
    own = benchmark.select(F.col(item_col).cast("long").alias("item_id"), F.col(text_col).cast("string").alias("text")).where("item_id is not null and text is not null").distinct()
    size = own.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    count = -(-size // block_bytes)
    for k in range(count):
        rows = own.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(count)) == k).collect()
        items = Items(sorted((r["item_id"], r["text"]) for r in rows), n, threshold)
        if items.ids:
            yield items


def contamination(docs: DataFrame, benchmark: DataFrame, n: int = 4, threshold: float = 0.6, block_bytes: int = 4 << 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document and test item whose alignment reaches `threshold` of the item's own score: doc_id, row,
    item_id, similarity (0 to 1), start and end in words of the passage (end exclusive), the best passage of the pair.

    n is the most words of a seed; shorter ones are used where the threshold asks for it, so that no alignment which
    reaches it goes unseen. An item of fewer than n words must be met whole, word by word. row tells rows of docs with
    equal or null ids apart (a hash of id and text). Null and empty texts match nothing; equal items are all reported;
    repeated rows are reported for each. Other columns are ignored. Each block of items is one pass over docs, written
    before the next block is collected."""
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), row_key(id_col, text_col).alias("row"), F.col(text_col).cast("string").alias("text"))
    found = None
    for items in blocks_of(benchmark, n, threshold, block_bytes):
        block = spark.sparkContext.broadcast(items)
        del items
        part = materialize(texts.mapInArrow(_find(block, threshold), _FOUND), "contamination")
        block.destroy()
        found = part if found is None else found.unionByName(part)
    return found if found is not None else spark.createDataFrame([], _FOUND)


def row_key(id_col: str, text_col: str):
    return F.xxhash64(F.col(id_col).cast("long"), F.col(text_col).cast("string"))
