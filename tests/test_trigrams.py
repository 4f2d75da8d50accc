"""The trigram measure over batches against a plain walk over each text."""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa

from textloom.functions import trigrams


def plain(low: str, said: list[str], east: bool) -> float:
    grams = lambda x: [x[k : k + 3] for k in range(len(x) - 2)]
    own, heads, x = Counter(grams(low)), Counter(g[:2] for g in grams(low)), []
    for s in said:
        logs = [math.log((own[g] + 1) / (heads[g[:2]] + len(own) + 1)) for g in grams(s) if heads[g[:2]]] if len(s) >= 5 else []
        x += [math.exp(-sum(logs) / len(logs))] if logs else []
    if len(said) < 4 or len(x) < 3:
        return 0.5
    lang = "ru" if east else "en"
    usual, f = trigrams.ORDINARY[lang][0], {k: v for k, v in trigrams.TABLES[lang].items() if len(k) == 3}
    xp = math.exp(-sum(n * math.log(f.get(g, trigrams.RARE[lang])) for g, n in own.items()) / sum(own.values())) if len(low) >= 10 else usual
    raw = 0.35 * max(0, 1 - (np.mean(x) - 3) / 15) + 0.35 * max(0, 1 - np.std(x, ddof=1) / np.mean(x) / 0.4) + 0.3 * max(0, 1 - abs(xp - usual) / usual / 0.5)
    return math.floor(max(0, min(1, raw)) * 10000 + 0.5) / 10000


def test_batches_equal_a_plain_walk(monkeypatch):
    monkeypatch.setattr(trigrams, "PART", 400)  # several parts, and a text longer than one
    rng = np.random.default_rng(5)
    words = "the other thing and then рыба не на про что 魚 😀 of in with ß".split()
    texts, said = ["", "ab", "abc"], [[], ["ab"], ["abc", "abcde", "xyzzy", "abcab"]]
    for k in range(60):
        s = [" ".join(rng.choice(words, rng.integers(1, 12))) + "." for _ in range(rng.integers(0, 9) if k else 90)]
        texts.append(" ".join(s))
        said.append(s + ["qq≠qq"] * (k % 2))  # trigrams that the text has not
    lang = [("en", "ru", "uk", "de")[k % 4] for k in range(len(texts))]
    got = trigrams.perplexity(pa.array(texts), pa.array(said, pa.list_(pa.string())), pa.array(lang)).to_pylist()
    assert got == [plain(t, s, x in ("ru", "uk")) for t, s, x in zip(texts, said, lang, strict=True)]
    assert 0.5 in got and len(set(got)) > 20


def test_nothing_in_a_batch():
    assert trigrams.perplexity(pa.array([], pa.string()), pa.array([], pa.list_(pa.string())), pa.array([], pa.string())).to_pylist() == []
