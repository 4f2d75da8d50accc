"""Secret scans by one combined deterministic automaton.

Each rule's expression becomes an NFA, by subset construction and minimisation a DFA. A search state holds, for each rule,
the DFA states of attempts that began at different places, oldest first; an attempt whose future matches are all matches
of an older attempt is dropped, and a younger one ends when an older one matches: what remains is leftmost-longest and
non-overlapping per rule. The product over all rules is minimised again and laid out as transition arrays, so one pass
over the bytes of a text reports where matches of every rule end; a reversed DFA finds where each began.
"""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """pattern: classes, groups, |, ?, *, +, {m,n} over ASCII. A match counts if its group has at least `least` characters."""

    kind: str
    pattern: str
    ignore_case: bool = False
    group: int = 0
    least: int = 1


#: The base rules in the order in which kinds are listed, then those the method adds.
BASE_RULES = (
    Rule("assign", r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", True, 2, 12),
    Rule("access", r"AKIA[A-Z0-9]+", least=18),
    Rule("hex", r"[0-9a-f]{16,}"),
)
MORE_RULES = (
    Rule("github", r"gh[opsu]_[A-Za-z0-9]+", least=24),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]+", least=15),
    Rule("google", r"AIza[A-Za-z0-9_-]+", least=39),
    Rule("pem", r"-----BEGIN ((RSA|EC|DSA|OPENSSH|ENCRYPTED) )?PRIVATE KEY-----"),
)


class _Parser:
    """Expression -> NFA as lists: moves[state] = [(set of bytes, to)], skips[state] = [to]."""

    def __init__(self, rule: Rule):
        self.p, self.i, self.fold = rule.pattern, 0, rule.ignore_case
        self.moves, self.skips = [], []
        node = self.either()
        if self.i != len(self.p):
            raise ValueError(f"cannot read {self.p!r} at {self.i}")
        self.start, self.end = self.build(node)

    def state(self) -> int:
        self.moves.append([])
        self.skips.append([])
        return len(self.moves) - 1

    def peek(self) -> str:
        return self.p[self.i : self.i + 1]

    def take(self) -> str:
        self.i += 1
        return self.p[self.i - 1]

    def either(self):
        parts = [self.row()]
        while self.peek() == "|":
            self.take()
            parts.append(self.row())
        return ("or", parts) if len(parts) > 1 else parts[0]

    def row(self):
        parts = []
        while self.peek() not in ("", "|", ")"):
            parts.append(self.times(self.atom()))
        return ("row", parts)

    def times(self, node):
        c = self.peek()
        if c and c in "?*+":
            self.take()
            return ("times", node, 1 if c == "+" else 0, 1 if c == "?" else None)
        if c == "{":
            m = re.compile(r"\{(\d+)(,(\d*))?\}").match(self.p, self.i)
            self.i = m.end()
            low = int(m[1])
            return ("times", node, low, low if m[2] is None else int(m[3]) if m[3] else None)
        return node

    def one(self) -> int:
        c = self.take()
        if c != "\\":
            return ord(c)
        c = self.take()
        if c == "x":
            self.i += 2
            return int(self.p[self.i - 2 : self.i], 16)
        return ord({"n": "\n", "t": "\t"}.get(c, c))

    def cased(self, xs: set[int]) -> frozenset[int]:
        if self.fold:
            xs = xs | {ord(chr(x).swapcase()) for x in xs if chr(x).isalpha()}
        return frozenset(xs)

    def atom(self):
        c = self.peek()
        if c == "(":
            self.take()
            node = self.either()
            self.take()
            return node
        if c == "[":
            self.take()
            xs: set[int] = set()
            while self.peek() != "]":
                low = self.one()
                if self.peek() == "-" and self.p[self.i + 1] != "]":
                    self.take()
                    xs.update(range(low, self.one() + 1))
                else:
                    xs.add(low)
            self.take()
            return ("set", self.cased(xs))
        return ("set", self.cased({self.one()}))

    def build(self, node) -> tuple[int, int]:
        a, b = self.state(), self.state()
        if node[0] == "set":
            self.moves[a].append((node[1], b))
        elif node[0] == "or":
            for x in node[1]:
                s, e = self.build(x)
                self.skips[a].append(s)
                self.skips[e].append(b)
        else:
            at = a
            if node[0] == "row":
                for x in node[1]:
                    s, e = self.build(x)
                    self.skips[at].append(s)
                    at = e
            else:
                _, x, low, high = node
                for _ in range(low):
                    s, e = self.build(x)
                    self.skips[at].append(s)
                    at = e
                if high is None:
                    s, e = self.build(x)
                    self.skips[at].append(s)
                    self.skips[e].append(s)
                    self.skips[at].append(b)
                    at = e
                else:
                    for _ in range(high - low):
                        s, e = self.build(x)
                        self.skips[at].append(s)
                        self.skips[at].append(b)
                        at = e
            self.skips[at].append(b)
        return a, b


@dataclass
class Dfa:
    """State 0 is dead, 1 the start. to[state][byte]; final: states that match."""

    to: np.ndarray
    final: np.ndarray


def _minimised(to: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Partition refinement. label: what states must agree on, one row for each. -> (block of each state, a member of each block)."""
    _, block = np.unique(label, axis=0, return_inverse=True)
    block = block.ravel()
    while True:
        rows = np.column_stack([block, block[to]])
        _, member, new = np.unique(rows, axis=0, return_index=True, return_inverse=True)
        new = new.ravel()
        if new.max() == block.max():
            return new, member
        block = new


def _subset(starts: set[int], finals: set[int], moves: list, skips: list) -> Dfa:
    def close(xs) -> frozenset[int]:
        out, todo = set(xs), list(xs)
        while todo:
            for y in skips[todo.pop()]:
                if y not in out:
                    out.add(y)
                    todo.append(y)
        return frozenset(out)

    first = close(starts)
    seen, order, rows = {frozenset(): 0, first: 1}, [frozenset(), first], []
    for state in order:
        step = defaultdict(set)
        for s in state:
            for xs, to in moves[s]:
                for x in xs:
                    step[x].add(to)
        row = np.zeros(256, np.int64)
        known = {}
        for x, ys in step.items():
            ys = frozenset(ys)
            if ys not in known:
                t = close(ys)
                if t not in seen:
                    seen[t] = len(order)
                    order.append(t)
                known[ys] = seen[t]
            row[x] = known[ys]
        rows.append(row)
    to, final = np.array(rows), np.array([bool(s & finals) for s in order])
    block, member = _minimised(to, np.column_stack([final, np.arange(len(to)) == 0]))
    rest = [b for b in range(len(member)) if b not in (block[0], block[1])]
    rank = {b: k for k, b in enumerate(dict.fromkeys([block[0], block[1], *rest]))}
    names = np.array([rank[b] for b in range(len(member))])
    order = np.argsort(names)
    return Dfa(names[block[to[member[order]]]], final[member[order]])


def compile_rule(rule: Rule) -> tuple[Dfa, Dfa]:
    """The DFA of a rule, and that of its reversal."""
    n = _Parser(rule)
    back_moves, back_skips = [[] for _ in n.moves], [[] for _ in n.moves]
    for s, some in enumerate(n.moves):
        for xs, to in some:
            back_moves[to].append((xs, s))
    for s, some in enumerate(n.skips):
        for to in some:
            back_skips[to].append(s)
    return _subset({n.start}, {n.end}, n.moves, n.skips), _subset({n.end}, {n.start}, back_moves, back_skips)


def _included(d: Dfa) -> np.ndarray:
    """included[p, q]: every text that p still matches, q matches."""
    ok = ~d.final[:, None] | d.final[None, :]
    while True:
        new = ok.copy()
        for x in np.unique(d.to, axis=1).T:
            new &= ok[np.ix_(x, x)]
        if (new == ok).all():
            return ok
        ok = new


class _Search:
    """Leftmost-longest non-overlapping search of one rule, as a function of states: tuples of attempts, oldest first."""

    def __init__(self, kind: str, d: Dfa):
        if d.final[1]:
            raise ValueError(f"{kind}: matches the empty text")
        self.kind, self.d, self.inside = kind, d, _included(d)

    def ended(self, state: tuple[int, ...]) -> bool:
        return bool(state) and bool(self.d.final[state[0]])

    def step(self, state: tuple[int, ...], x: int) -> tuple[tuple[int, ...], bool]:
        """(next state, whether a match ended before this byte)."""
        if self.ended(state):
            t = int(self.d.to[state[0], x])
            if t:
                if not self.d.final[t]:
                    raise ValueError(f"{self.kind}: a match must stay one while it can grow")
                return (t,), False
            return self.step((), x)[0], True
        out: list[int] = []
        for s in (*state, 1):
            t = int(self.d.to[s, x])
            if t and not any(self.inside[t, o] for o in out):
                out.append(t)
                if self.d.final[t]:
                    if len(out) > 1:
                        raise ValueError(f"{self.kind}: an older attempt is open when a younger one matches")
                    break
        return tuple(out), False


class Scanner:
    """All rules in one pass. scan(bytes) -> [(start, end, kind's index)] by start, in bytes."""

    def __init__(self, rules: tuple[Rule, ...]):
        self.rules = rules
        pairs = [compile_rule(r) for r in rules]
        self.back = [b for _, b in pairs]
        parts = [_Search(r.kind, d) for r, (d, _) in zip(rules, pairs, strict=True)]
        columns = np.column_stack([d.to.T for d, _ in pairs])
        _, member, classes = np.unique(columns, axis=0, return_index=True, return_inverse=True)
        classes = classes.ravel()
        first = tuple(() for _ in parts)
        seen, order, to, events = {first: 0}, [first], [], []
        steps: dict = {}
        for state in order:
            if len(order) > 50_000:
                raise ValueError("the rules' product has too many states; give long repetitions as + with a least length")
            row, said = [], []
            for c, x in enumerate(member.tolist()):
                new, bits = [], 0
                for k, (p, s) in enumerate(zip(parts, state, strict=True)):
                    if (k, s, c) not in steps:
                        steps[k, s, c] = p.step(s, x)
                    t, ended = steps[k, s, c]
                    new.append(t)
                    bits |= ended << k
                t = tuple(new)
                if t not in seen:
                    seen[t] = len(order)
                    order.append(t)
                row.append(seen[t])
                said.append(bits)
            to.append(row)
            events.append(said)
        at_end = np.array([sum(p.ended(s) << k for k, (p, s) in enumerate(zip(parts, state, strict=True))) for state in order])
        to, events = np.array(to), np.array(events)
        block, member = _minimised(to, np.column_stack([events, at_end]))
        self.states = len(member)
        self.next, self.events, self.at_end = block[to[member]][:, classes], events[member][:, classes], at_end[member]
        self.start = int(block[0])
        self.rows = None

    def _layout(self) -> None:
        """Rows of shared ints; a move that reports something leads to a number of its own from `states` on."""
        moves = sorted(set(zip(self.next[self.events > 0].tolist(), self.events[self.events > 0].tolist(), strict=True)))
        number = {m: self.states + k for k, m in enumerate(moves)}
        ints = list(range(self.states + len(moves)))
        self.rows = [tuple(ints[t] if not e else ints[number[t, e]] for t, e in zip(a, b, strict=True)) for a, b in zip(self.next.tolist(), self.events.tolist(), strict=True)]
        self.told = moves

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "told"} | {"rows": None}

    def scan(self, data: bytes) -> list[tuple[int, int, int]]:
        if self.rows is None:
            self._layout()
        rows, limit, s, ends = self.rows, self.states, self.start, []
        row = rows[s]
        for at, x in enumerate(data):
            s = row[x]
            if s >= limit:
                s, bits = self.told[s - limit]
                ends.append((at, bits))
            row = rows[s]
        if last := int(self.at_end[s]):
            ends.append((len(data), last))
        free, out = [0] * len(self.rules), []
        for end, bits in ends:
            for k in range(len(self.rules)):
                if bits >> k & 1:
                    start = self._began(k, data, end, free[k])
                    free[k] = end
                    if self._counts(k, data[start:end]):
                        out.append((start, end, k))
        out.sort(key=lambda m: (m[0], m[2]))
        return out

    def _began(self, k: int, data: bytes, end: int, low: int) -> int:
        d, s, best, at = self.back[k], 1, end, end
        while at > low:
            at -= 1
            s = d.to[s, data[at]]
            if not s:
                break
            if d.final[s]:
                best = at
        return best

    def _counts(self, k: int, span: bytes) -> bool:
        rule = self.rules[k]
        if not rule.group:
            return len(span) >= rule.least
        m = re.compile(rule.pattern.encode(), re.I if rule.ignore_case else 0).fullmatch(span)
        return m is not None and len(m[rule.group]) >= rule.least


def _in_code_points(data: bytes, spans: list[tuple[int, int, int]], ascii_only: bool) -> list[tuple[int, int, int]]:
    if ascii_only or not spans:
        return spans
    marks = sorted({x for a, b, _ in spans for x in (a, b)})
    place, at, n = {}, 0, 0
    for x in marks:
        n += len(data[at:x].decode("utf-8", "surrogatepass"))
        place[x], at = n, x
    return [(place[a], place[b], k) for a, b, k in spans]


def find_secrets(docs: DataFrame, rules: tuple[Rule, ...] = BASE_RULES + MORE_RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: doc_id, found array<struct<kind, start, end>> in code points, end exclusive, by start
    and then in the order of rules.

    A null text is empty and has none; repeated and null ids are rows like any other; other columns are ignored."""
    scanner = docs.sparkSession.sparkContext.broadcast(Scanner(rules))

    def run(batches):
        scan, kinds = scanner.value, [r.kind for r in rules]
        struct = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            found = []
            for text in batch.column(1):
                text = text.as_py() or ""
                data = text.encode("utf-8", "surrogatepass")
                found.append([{"kind": kinds[k], "start": a, "end": b} for a, b, k in _in_code_points(data, scan.scan(data), len(data) == len(text))])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, struct)], names=["doc_id", "found"])

    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return texts.mapInArrow(run, "doc_id long, found array<struct<kind: string, start: long, end: long>>")


def spans_text(found) -> str:
    return f"array_join(transform({found}, x -> concat(x.kind, ':', x.start, ':', x.end)), ',')"


def secret_digest(found: DataFrame) -> DataFrame:
    """The counts and digests of the base kinds, and all spans as text."""
    base = "filter(found, x -> x.kind in ('assign', 'access', 'hex'))"
    counts = [F.expr(f"cast(size(filter(found, x -> x.kind = '{k}')) as bigint)").alias(f"n_{k}") for k in ("assign", "access", "hex")]
    return found.select("doc_id", *counts, F.sha2(F.expr(spans_text(base)), 256).alias("base_sha256"), F.expr(spans_text("found")).alias("spans"))


def brute_force(text: str | None, rules: tuple[Rule, ...] = BASE_RULES) -> tuple[str, str]:
    """(spans, sha256) by an ordinary regex engine, for tests."""
    out = []
    for k, r in enumerate(rules):
        for m in re.finditer(r.pattern, text or "", re.I | re.A if r.ignore_case else re.A):
            if len(m[r.group]) >= r.least:
                out.append((m.start(), k, f"{r.kind}:{m.start()}:{m.end()}"))
    joined = ",".join(x[2] for x in sorted(out))
    return joined, hashlib.sha256(joined.encode()).hexdigest()
