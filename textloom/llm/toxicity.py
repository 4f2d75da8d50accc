"""Toxicity: Levenshtein automata over a lexicon trie, and scores of the windows around what they catch.

The lexicon is learned: words that labelled toxic texts hold far more often than other texts. It becomes a trie, and a
word is matched by the intersection of the trie with the automaton of all words within a few edits, made deterministic
as it is used: a state is a set of (node, edits so far), so most words leave after a few letters, and misspelled terms
are caught. A hit's window decides how it counts: quotation marks around it, words of reporting and negation near it and
other hits nearby part quotation from abuse. A logistic model over a few sums per document, fitted on labelled texts,
gives the score.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import materialize

_EDGES = re.compile(r"^[\W\d_]+|[\W\d_]+$")
_LEET = str.maketrans("013457@$!|", "oieastasii")
_OPEN, _CLOSE = set("\"“”„«»‘'"), set("\"“”„«»’'")
#: Words that report speech, and words that negate, in the four languages of the tables; tokens around a hit
#: that are looked at, and tokens before it in which a negation counts.
REPORTS = frozenset("said says wrote writes called quoted quote quotes cited according reported claims claimed word words term slur sagte schrieb nannte zitat wort dit écrit appelé cite mot dijo escribió llamó cita palabra".split())
NEGATIONS = frozenset("not no never nicht kein keine nie pas jamais nunca".split())
WINDOW, NEGATED = 6, 2
#: What a term counts where it is met with edits, and a rare one.
EDITED, EDITED_RARE = 0.8, 0.4


def plain(token: str) -> str:
    """A token as a word: lower case, look-alike digits and marks inside it read as letters, edges trimmed."""
    word = _EDGES.sub("", token).lower()
    return word if word.isalpha() else re.sub(r"[\W\d_]+", "", word.translate(_LEET))


class LexiconAutomaton:
    """Words within allowed edits of a lexicon term; deterministic states are made when first met and remembered."""

    def __init__(self, terms: dict[str, float], limit: int = 200_000):
        self.terms, self.limit = terms, limit
        self.child: list[dict[str, int]] = [{}]
        self.ends: list[tuple[str, int] | None] = [None]
        self.deep = [0]
        for term in sorted(terms):
            at = 0
            for c in term:
                if c not in self.child[at]:
                    self.child[at][c] = len(self.child)
                    self.child.append({})
                    self.ends.append(None)
                    self.deep.append(0)
                at = self.child[at][c]
            self.ends[at] = (term, self.allowed(term))
        for at in range(len(self.child) - 1, -1, -1):  # the most edits that any term below allows
            below = [self.deep[c] for c in self.child[at].values()]
            self.deep[at] = max([*below, self.ends[at][1] if self.ends[at] else 0])
        self._reset()

    @staticmethod
    def allowed(term: str) -> int:
        return 0 if len(term) < 4 else 1 if len(term) < 9 else 2

    def _reset(self) -> None:
        self.states = [self._closed({0: 0})]
        self.number = {self.states[0]: 0}
        self.moves: list[dict[str, int]] = [{}]

    def _closed(self, found: dict[int, int]) -> frozenset:
        """With terms' letters that the word leaves out; only states that can still end within their edits."""
        todo = list(found.items())
        while todo:
            at, e = todo.pop()
            if found.get(at, 9) < e:
                continue
            for to in self.child[at].values():
                if e < self.deep[to] and found.get(to, 9) > e + 1:
                    found[to] = e + 1
                    todo.append((to, e + 1))
        return frozenset((at, e) for at, e in found.items() if e <= self.deep[at])

    def _move(self, s: int, c: str) -> int:
        found: dict[int, int] = {}

        def put(at: int, e: int) -> None:
            if e <= self.deep[at] and found.get(at, 9) > e:
                found[at] = e

        for at, e in self.states[s]:
            put(at, e + 1)  # a letter too many
            for letter, to in self.child[at].items():
                put(to, e + (letter != c))
        state = self._closed(found)
        if state not in self.number:
            self.number[state] = len(self.states)
            self.states.append(state)
            self.moves.append({})
        t = self.moves[s][c] = self.number[state]
        return t

    def find(self, word: str) -> tuple[str, int] | None:
        """The term with the fewest edits, the first of equals; None if no term is near enough."""
        s = 0
        for c in word:
            t = self.moves[s].get(c)
            s = self._move(s, c) if t is None else t
            if not self.states[s]:
                return None
        ends = [(e, self.ends[at][0]) for at, e in self.states[s] if self.ends[at] and e <= self.ends[at][1]]
        if len(self.states) > self.limit:
            self._reset()
        return min(ends)[::-1] if ends else None


@dataclass
class Toxicity:
    """terms: log-odds of lexicon terms; weights and bias of the logistic model over `features`; rare: terms whose edits
    count for less; ordinary: words near a term that are known as words of their own and count only if they are a term."""

    terms: dict[str, float]
    weights: np.ndarray = field(default_factory=lambda: np.zeros(4))
    bias: float = -2.0
    rare: frozenset[str] = frozenset()
    ordinary: frozenset[str] = frozenset()
    limit: int = 400_000

    def __post_init__(self):
        self.automaton, self.known = None, {}

    def __getstate__(self):
        return self.__dict__ | {"automaton": None, "known": {}}

    def _look(self, token: str) -> float:
        """0 for most tokens; the term's weight if it is met exactly, less and negative if it is met with edits."""
        word = plain(token)
        hit = self.automaton.find(word) if word else None
        if hit is None or (hit[1] and word in self.ordinary):
            value = 0.0
        else:
            value = self.terms[hit[0]] * (1 if not hit[1] else -EDITED_RARE if hit[0] in self.rare else -EDITED)
        if len(self.known) >= self.limit:
            self.known.clear()
        self.known[token] = value
        return value

    def features(self, text: str | None) -> np.ndarray:
        """Sums over hits: in plain use (edited ones for less), quoted or reported, near other hits; and plain hits' share."""
        if self.automaton is None:
            self.automaton = LexiconAutomaton(self.terms)
        f = np.zeros(4)
        if not text:
            return f
        tokens, get, look = text.split(), self.known.get, self._look
        values = [look(t) if (v := get(t)) is None else v for t in tokens]
        hits, plain_hits = [k for k, v in enumerate(values) if v], 0
        for n, k in enumerate(hits):
            v = abs(values[k])
            if self._quoted(tokens, k):
                f[1] += v
                continue
            near = (n > 0 and k - hits[n - 1] <= WINDOW) or (n + 1 < len(hits) and hits[n + 1] - k <= WINDOW)
            f[0] += v
            f[2] += near
            plain_hits += 1
        f[:3] = np.log1p(f[:3])
        f[3] = plain_hits / max(20, len(tokens))
        return f

    @staticmethod
    def _quoted(tokens: list[str], k: int) -> bool:
        """Whether token k stands inside quotation marks that open and close within the window, after a word of reporting
        there, or right after a negation."""
        low, high = max(0, k - WINDOW), min(len(tokens), k + WINDOW + 1)
        ends = lambda t: t.rstrip(".,;:!?")[-1:] in _CLOSE
        inside = False
        for t in tokens[low:k]:
            inside = (inside or t[0] in _OPEN) and not (len(t) > 1 and ends(t))
        if inside or tokens[k][0] in _OPEN:
            for n, t in enumerate(tokens[k:high]):
                if n and t[0] in _OPEN and not ends(t):
                    break  # another quotation opens first
                if (n or len(t) > 1) and ends(t):
                    return True
        before = [t.strip(".,;:!?\"'“”„«»").lower() for t in tokens[low:k]]
        return any(t in REPORTS for t in before) or any(t in NEGATIONS for t in before[-NEGATED:])

    def hits(self, text: str | None) -> list[dict]:
        """What the automaton catches: the term, the token as it stands, its place among the tokens, whether it is quoted."""
        if self.automaton is None:
            self.automaton = LexiconAutomaton(self.terms)
        out = []
        for k, token in enumerate(tokens := (text or "").split()):
            if self.known.get(token, 1.0) and (value := self._look(token)):
                hit = self.automaton.find(plain(token))
                out.append({"term": hit[0], "found": token, "place": k, "edited": value < 0, "quoted": self._quoted(tokens, k)})
        return out

    def score(self, text: str | None) -> float:
        z = float(self.features(text) @ self.weights) + self.bias
        return 1 / (1 + math.exp(-max(-50.0, min(50.0, z))))


def _term_counts(batches):
    """Words of labelled texts, each once for a text."""
    total: dict[str, list[int]] = {}
    for batch in batches:
        for text, toxic in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
            for word in {plain(t) for t in (text.as_py() or "").split()}:
                if 2 < len(word) <= 40:
                    total.setdefault(word, [0, 0])[toxic] += 1
    yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), *[pa.array([n[k] for n in total.values()], pa.int64()) for k in (0, 1)]], names=["word", "clean", "toxic"])


def _edited(terms: dict[str, float]):
    """Words of labelled texts that are edits of a term."""

    def run(batches):
        a = LexiconAutomaton(terms)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([w for w in batch.column(0).to_pylist() if (hit := a.find(w)) and hit[1]], pa.string())], names=["word"])

    return run


def _logistic(x: np.ndarray, y: np.ndarray, rounds: int = 60, ridge: float = 0.05) -> tuple[np.ndarray, float]:
    """Newton's method with a ridge on the weights, not on the bias."""
    a = np.column_stack([x, np.ones(len(x))])
    w, hold = np.zeros(a.shape[1]), np.diag([*[ridge] * x.shape[1], 1e-6])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + hold, a.T @ (y - p) - hold @ w)
        w += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return w[:-1], float(w[-1])


def learn_toxicity(docs: DataFrame, labels: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", label_rows: int = 20_000, most_terms: int = 3_000, least_texts: int = 4, least_odds: float = 2.0, edit_share: float = 0.05) -> Toxicity:
    """Fit on a sample of labelled rows for which learn holds: about label_rows, chosen by a hash of the id, which bounds
    what is broadcast and collected. The lexicon has at most most_terms words of 3 to 40 letters, each in at least least_texts toxic texts
    with log-odds of at least least_odds, the strongest first. Edits of terms in fewer than edit_share of the toxic texts
    count for less: chance resemblance to a rare word says less. A word near a term that is met in texts not labelled toxic,
    with less than those odds, is no edit of it; the term's other edits stay."""
    spark = docs.sparkSession
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic is not null").where(learn).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    count = known.count()
    share = min(1.0, label_rows / max(1, count))
    known = known.where(F.pmod(F.xxhash64(F.lit("toxicity sample"), "doc_id"), F.lit(1 << 20)) < int(math.ceil(share * (1 << 20))))
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(known), "doc_id").select("text", "toxic")
    sizes = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    bad, good = max(1, sizes.get(1, 0)), max(1, sizes.get(0, 0))
    odds = F.log((F.col("toxic") + 0.5) / (bad + 1)) - F.log((F.col("clean") + 0.5) / (good + 1))
    counts = materialize(texts.mapInArrow(_term_counts, "word string, clean long, toxic long").groupBy("word").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")), "words")
    terms = counts.where(f"toxic >= {least_texts}").withColumn("odds", odds).where(f"odds >= {least_odds}")
    rows = terms.orderBy(F.desc(F.col("odds") * F.sqrt("toxic")), "word").limit(most_terms).collect()
    found = {r["word"]: float(r["odds"]) for r in rows}
    rare = frozenset(r["word"] for r in rows if r["toxic"] < edit_share * bad)
    ordinary = counts.where("clean > 0").withColumn("odds", odds).where(f"odds < {least_odds}").select("word").mapInArrow(_edited(found), "word string")
    model = Toxicity(found, rare=rare, ordinary=frozenset(r["word"] for r in ordinary.collect()))  # at most the words of the sample
    shared = spark.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            x = [shared.value.features(t.as_py()).tolist() for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64())), batch.column(1)], names=["x", "toxic"])

    got = texts.mapInArrow(run, "x array<double>, toxic int").collect()  # four numbers for each sampled row
    if len({r["toxic"] for r in got}) == 2:
        model.weights, model.bias = _logistic(np.array([r["x"] for r in got]), np.array([float(r["toxic"] > 0) for r in got]))
    return model


def score_toxicity(docs: DataFrame, model: Toxicity, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: doc_id, score (0 to 1), predicted (1 if score >= 0.5).

    Null and empty texts score what a text without hits scores. Repeated and null ids are rows like any other; without
    labelled rows there is no lexicon and every score is the bias's. Texts of any length are read whole; no rows give no
    rows. Other columns are ignored."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        for batch in batches:
            scores = [m.score(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64()), pa.array([int(s >= 0.5) for s in scores], pa.int32())], names=["doc_id", "score", "predicted"])

    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return texts.mapInArrow(run, "doc_id long, score double, predicted int")


def toxic_hits(docs: DataFrame, model: Toxicity, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each hit in each row of docs: doc_id, term, found (the token), place (its number), edited, quoted."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kinds = {"doc_id": pa.int64(), "term": pa.string(), "found": pa.string(), "place": pa.int64(), "edited": pa.bool_(), "quoted": pa.bool_()}

    def run(batches):
        m = shared.value
        for batch in batches:
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                rows = [{"doc_id": i, **hit} for hit in m.hits(text.as_py())]
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=pa.schema(list(kinds.items())))

    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return texts.mapInArrow(run, "doc_id long, term string, found string, place long, edited boolean, quoted boolean")
