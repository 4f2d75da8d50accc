"""The trigram measure over Arrow batches: counts of characters are sorted as numbers, many texts at a time.

Expressions would make a text of each character and each trigram of a document; here a trigram is one number of its text
and its three characters, and a run of equal ones in the sorted list is a count.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle

from textloom.functions import lexicon

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers need not have the library

#: Perplexity of ordinary text and how many trigrams are possible, English and Russian.
ORDINARY = {"en": (12.5, 17576), "ru": (14.2, 29791)}
TABLES = {"en": lexicon.TRIGRAMS_EN, "ru": lexicon.TRIGRAMS_RU}
RARE = {x: (1 - sum(table.values())) / ORDINARY[x][1] for x, table in TABLES.items()}
#: Characters of text that are sorted at a time; a longer text is a part of its own.
PART = 1 << 19
#: Texts of a part at most, so that their number and three characters fit a word.
MOST = 1 << 12


def _parts(lengths: np.ndarray) -> Iterator[tuple[int, int]]:
    begin, held = 0, 0
    for k, n in enumerate(lengths.tolist()):
        if k > begin and (held + n > PART or k - begin >= MOST):
            yield begin, k
            begin, held = k, 0
        held += n
    if begin < len(lengths):
        yield begin, len(lengths)


def _points(texts: pa.Array) -> np.ndarray:
    """Code points of all texts, one after the other."""
    return np.frombuffer("".join(texts.to_pylist()).encode("utf-32-le"), np.uint32)


def _grams(chars: np.ndarray, lengths: np.ndarray, kinds: int, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The number of each trigram inside a text, begun by the text's own number `first`, and the text that it is in."""
    if len(chars) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    inside = np.ones(len(chars), bool)
    ends = np.cumsum(lengths)
    inside[ends[lengths > 0] - 1] = False
    inside[ends[lengths > 1] - 2] = False
    inside = inside[:-2]
    of = np.repeat(np.arange(len(lengths)), lengths)[:-2][inside]
    c = chars.astype(np.int64)
    gram = ((c[:-2] * kinds + c[1:-1]) * kinds + c[2:])[inside]
    return first[of] * kinds**3 + gram, of


def _found(sorted_: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where x stands in a sorted list, and whether it does."""
    if not len(sorted_):
        return np.zeros(len(x), np.int64), np.zeros(len(x), bool)
    at = np.minimum(np.searchsorted(sorted_, x), len(sorted_) - 1)
    return at, sorted_[at] == x


def _part(low: pa.Array, said: pa.ListArray, east: np.ndarray) -> np.ndarray:
    n = len(low)
    lengths = pc.utf8_length(low).to_numpy(zero_copy_only=False).astype(np.int64)
    all_sizes = pc.list_value_length(said).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = said.flatten()
    long_ = pc.utf8_length(flat).to_numpy(zero_copy_only=False).astype(np.int64) if len(flat) else np.zeros(0, np.int64)
    owner = np.repeat(np.arange(n), all_sizes)[long_ >= 5]
    flat, long_ = flat.filter(pa.array(long_ >= 5)), long_[long_ >= 5]
    points, spoken = _points(low), _points(flat)
    alphabet = np.unique(np.concatenate([np.unique(points), np.unique(spoken)]))
    kinds = max(len(alphabet), 1)
    place = np.zeros(int(alphabet[-1]) + 1 if len(alphabet) else 1, np.int32)
    place[alphabet] = np.arange(len(alphabet))

    own, _ = _grams(place[points], lengths, kinds, np.arange(n))
    own.sort()
    starts = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]])) if len(own) else np.zeros(0, np.int64)
    grams, counts = own[starts], np.diff(np.append(starts, len(own))).astype(float)
    of = grams // kinds**3
    distinct = np.bincount(of, minlength=n).astype(float)
    heads = grams // kinds
    first = np.flatnonzero(np.concatenate([[True], heads[1:] != heads[:-1]])) if len(heads) else np.zeros(0, np.int64)
    before = np.add.reduceat(counts, first) if len(first) else np.zeros(0)
    beside = np.repeat(before, np.diff(np.append(first, len(heads))))

    log_rare = np.where(east, math.log(RARE["ru"]), math.log(RARE["en"]))
    known, bare = log_rare[of], grams % kinds**3
    for lang, table in TABLES.items():
        coded = {}
        for gram, f in table.items():
            letters = np.array([ord(x) for x in gram])
            if len(gram) == 3 and np.isin(letters, alphabet).all():
                a, b, c = place[letters].tolist()
                coded[(a * kinds + b) * kinds + c] = math.log(f)
        keys = np.array(sorted(coded), np.int64)
        at, hit = _found(keys, bare)
        hit &= east[of] == (lang == "ru")
        known[hit] = np.array([coded[k] for k in keys.tolist()])[at[hit]]
    total = np.maximum(lengths - 2, 0)
    usual = np.where(east, ORDINARY["ru"][0], ORDINARY["en"][0])
    crossed = np.bincount(of, counts * known, n)
    xp = np.where((lengths < 10) | (total == 0), usual, np.exp(-crossed / np.maximum(total, 1)))

    keys, sentence = _grams(place[spoken], long_, kinds, owner)
    at, hit = _found(grams, keys)
    times, context = np.zeros(len(keys)), np.zeros(len(keys))
    times[hit], context[hit] = counts[at[hit]], beside[at[hit]]
    lost = np.flatnonzero(~hit)
    at, hit = _found(heads[first], keys[lost] // kinds)
    context[lost[hit]] = before[at[hit]]
    kept = context > 0
    sentence = sentence[kept]
    logs = np.log((times[kept] + 1) / (context[kept] + distinct[owner[sentence]] + 1))
    held = np.bincount(sentence, minlength=len(owner))
    sums = np.bincount(sentence, logs, len(owner))
    some = held > 0
    x, who = np.exp(-sums[some] / held[some]), owner[some]
    k = np.bincount(who, minlength=n).astype(float)
    mean = np.bincount(who, x, n) / np.maximum(k, 1)
    apart = np.bincount(who, (x - mean[who]) ** 2, n)
    cv = np.where((k > 1) & (mean > 0), np.sqrt(apart / np.maximum(k - 1, 1)) / np.where(mean > 0, mean, 1), 0)
    raw = 0.35 * np.maximum(0, 1 - (mean - 3) / 15) + 0.35 * np.maximum(0, 1 - cv / 0.4) + 0.3 * np.maximum(0, 1 - np.abs(xp - usual) / usual / 0.5)
    return np.where((all_sizes < 4) | (k < 3), 0.5, np.floor(np.clip(raw, 0, 1) * 10000 + 0.5) / 10000)


def _coded(table: dict[str, float], rare: float) -> tuple[np.ndarray, np.ndarray]:
    """The trigrams of a table that are Latin-1, as rows of bytes, and what their logarithms have over the rare ones'."""
    found = {g: f for g, f in table.items() if len(g) == 3 and all(ord(x) < 256 for x in g)}
    return np.array([[ord(x) for x in g] for g in found], np.intp).reshape(-1, 3), np.array([math.log(f) - math.log(rare) for f in found.values()])


CODED = {x: _coded(table, RARE[x]) for x, table in TABLES.items()}
#: Kinds of characters that a text counted alone may have at most, as the table of its trigrams has their cube.
KINDS = 64


def alone(plain: bytes | None, said: list[str], east: bool) -> float | None:
    """The measure of one text in lower case, as Latin-1, and of its sentences, by a table of all trigrams that its
    characters can form. None where the characters are others or too many."""
    if len(said) < 4 or len(spoken := [x for x in said if len(x) >= 5]) < 3:
        return 0.5
    if plain is None:
        return None
    chars = np.frombuffer(plain, np.uint8)
    there = np.bincount(chars, minlength=256) > 0
    there[32] = True
    kinds = int(there.sum())
    if kinds > KINDS:
        return None
    place = np.maximum(np.cumsum(there) - 1, 0)
    n = len(chars)
    if n < 3:
        return 0.5
    c = place[chars]
    heads = c[:-2] * kinds + c[1:-1]
    counts = np.bincount(heads * kinds + c[2:], minlength=kinds**3)
    before, distinct = np.bincount(heads, minlength=kinds**2), np.count_nonzero(counts)
    lang = "ru" if east else "en"
    usual, (letters, over) = ORDINARY[lang][0], CODED[lang]
    xp = usual
    if n >= 10:
        known = there[letters].all(1)
        at = place[letters[known]]
        xp = math.exp(-math.log(RARE[lang]) - float((counts[(at[:, 0] * kinds + at[:, 1]) * kinds + at[:, 2]] * over[known]).sum()) / (n - 2))
    try:
        c = place[np.frombuffer("".join(spoken).encode("latin-1"), np.uint8)]
    except UnicodeEncodeError:
        return None
    ends = np.cumsum([len(x) for x in spoken])
    heads = c[:-2] * kinds + c[1:-1]
    context = before[heads]
    kept = context > 0
    kept[ends[:-1] - 1] = False
    kept[ends[:-1] - 2] = False
    logs = np.log((counts[heads * kinds + c[2:]] + 1) / (context + (distinct + 1)))
    logs[~kept] = 0
    starts = np.concatenate([[0], ends[:-1]])
    held = np.add.reduceat(kept.astype(np.intp), starts)
    some = held > 0
    x = np.exp(-np.add.reduceat(logs, starts)[some] / held[some])
    k = len(x)
    if k < 3:
        return 0.5
    mean = float(x.sum()) / k
    cv = math.sqrt(float(((x - mean) ** 2).sum()) / (k - 1)) / mean if mean > 0 else 0.0
    raw = 0.35 * max(0.0, 1 - (mean - 3) / 15) + 0.35 * max(0.0, 1 - cv / 0.4) + 0.3 * max(0.0, 1 - abs(xp - usual) / usual / 0.5)
    return math.floor(max(0.0, min(1.0, raw)) * 10000 + 0.5) / 10000


def perplexity(low: pa.Array, said: pa.Array, lang: pa.Array) -> pa.Array:
    """Texts in lower case, their sentences in lower case and their language -> the measure, rounded to four digits."""
    lengths = pc.utf8_length(low).to_numpy(zero_copy_only=False)
    east = pc.is_in(lang, pa.array(["ru", "uk"], lang.type)).to_numpy(zero_copy_only=False)
    out = [_part(low[a:b], said[a:b], east[a:b]) for a, b in _parts(lengths)]
    return pa.array(np.concatenate(out) if out else np.zeros(0), pa.float64())
