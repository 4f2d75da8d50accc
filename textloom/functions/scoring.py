"""The detector's sixteen measures of a text over Arrow batches: one split of the text, and plain counts over it.

The same measures are expressions in `textloom.operators`, for queries of one measure and for DuckDB. All of them together
are hundreds of passes over a text and lists of small texts that expressions copy for each step; here a pattern is looked
for only where words that it cannot do without are found.
"""

from __future__ import annotations

import gc
import math
import re
import sys
import unicodedata
from collections import Counter
from itertools import chain, compress, groupby, takewhile
from operator import eq, ne

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle

from textloom.functions.trigrams import alone, perplexity

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers need not have the library

MEASURES = "entropy burstiness vocabulary stylometry pattern punctuation grammar opening readability rhythm perplexity discourse semantic_rep entity voice structure".split()
TYPE = ", ".join(f"{m} double" for m in MEASURES) + ", domain string, lang string, n_words double, n_sents double, ok boolean"
AGENCIES = ["REUTERS", "AP", "AFP", "BBC", "CNN"]
LOUD = ["!!", "!?", "?!", "??", "..."]
OUT = pa.struct([*((m, pa.float64()) for m in MEASURES), ("domain", pa.string()), ("lang", pa.string()), ("n_words", pa.float64()), ("n_sents", pa.float64()), ("ok", pa.bool_())])
#: What may be counted in the same pass: components of a text's health, words of quick scores, sentences with theirs.
_HW = pa.struct([("s", pa.string()), ("n", pa.int32()), ("a", pa.float64()), ("h", pa.float64()), ("z", pa.float64())])
ALSO = {
    "": [], "health": [(x, pa.float64()) for x in ("mechanics", "unique_", "variety")], "quick": [(x, pa.float64()) for x in ("mw", "cw", "n_tok", "far")],
    "heat": [("hw", pa.list_(_HW))],
}
#: What takes the language of a text that names none from the whole text, not from its first 4,000 characters.
SNIFF_WHOLE = ("heat",)
_NAMED = {"heat": ", hw array<struct<s:string,n:int,a:double,h:double,z:double>>"}
#: Texts that are scored at a time.
ROWS = 256
#: Letters of words that count as long.
LONG = 7
EDGES = ".,;:!?\"'()[]{}"
OTHER_SPACES = "\x1c\x1d\x1e\x1f\x85\xa0"
_WS = "\t\n\x0b\x0c\r "
_S = r"[\t-\r ]"
_EDGE, _END = r"(?:^|\W)", r"(?:\W|\Z)"


def type_of(also: str) -> str:
    return TYPE + _NAMED.get(also, "".join(f", {x} double" for x, _ in ALSO[also]))


def _python(p: str) -> str:
    r"""A pattern of the library as Python's engine takes it: \w is [\p{L}\p{N}_] of Unicode."""
    return p.replace(r"[^\p{L}\p{N}_]", r"\W").replace(r"\p{L}\p{N}_", r"\w")


def _marks(kinds: str) -> str:
    """The characters of a category among the first 65,536, as ranges of a class."""
    return "".join(re.escape(chr(c)) for c in range(0x10000) if unicodedata.category(chr(c)) in kinds.split())


def _quick(p: str) -> str:
    """The edge before a pattern's first letters is looked at after them, so that the search is one for fixed letters."""
    m = re.match(r"\\b(\w+)([?*+{]?)", p)
    if not m:
        return p
    first = m[1][:-1] if m[2] else m[1]
    return f"{first}(?<!\\w{first}){p[2 + len(first):]}"


def needles(pattern: str) -> list[str]:
    """Texts of which any match of the pattern holds one: its longest fixed part, or the beginnings of its alternatives."""
    best, run = [], ""

    def weigh(found: list[str]) -> None:
        nonlocal best
        worth = lambda xs: min(map(len, xs)) / len(xs) ** 0.3 if xs else 0
        if found and all(found) and worth(found) > worth(best):
            best = found

    for op, arg in [*re._parser.parse(pattern), (None, None)]:
        if op is re._constants.LITERAL:
            run += chr(arg)
            continue
        if run:
            weigh([run])
        run = ""
        if op is re._constants.BRANCH:
            weigh(["".join(chr(a) for o, a in takewhile(lambda y: y[0] is re._constants.LITERAL, one)) for one in arg[1]])
    return list(dict.fromkeys(best))


def _noun(endings: tuple, x: str) -> int:
    return any(x.endswith(e) and len(x) - len(e) >= 4 for e in endings) + (x.endswith("isation") and len(x) >= 11)


def _edged_first(words: str) -> str:
    """Alternatives with an edge before them that is looked at after them, so that the search is one for first letters."""
    return "(?:" + "|".join(f"{w}(?<!\\w{w})" for w in words.split("|")) + ")"


def _spaced(p: str) -> bytes:
    """A table that leaves of Latin-1 text the characters of a class and makes all others spaces."""
    return bytes(k if re.match(p, chr(k)) else 32 for k in range(256))


class Rules:
    """Word lists and patterns, made ready once and sent to the workers."""

    def __init__(self, lexicon, style, analysis, alike: tuple[str, str], both: str, edged) -> None:
        lower = lambda ws: [w.lower() for w in ws]
        self.markers = {x: [[_ready(m) for m in lower(kinds.get(k, []))] for k in ("adverbs", "adjectives", "verbs", "connectors", "phrases")] for x, kinds in lexicon.MARKERS.items()}
        self.starters = tuple(lexicon.FORMAL_STARTERS)
        guarded = lambda p: (needles(p), re.compile(_quick(p.replace(r"\x01", r"\b").replace(r"\x02", r"\b"))))
        by_words = lambda found, p: (frozenset(re.findall("\x01(\\w+)\x02", found[0]) if len(found) == 1 else []), [re.sub("[\x01\x02]", "", x) for x in found], p)
        self.hedging = _by_word([by_words(*guarded(edged(p))) for p in lexicon.HEDGING if not p.startswith(r"\bboth ")])
        self.both = re.compile(_python(both))
        self.counting = _by_word([by_words(*guarded(edged(p))) for p in lexicon.COUNTING])
        self.abbreviations = frozenset(a.replace("\\", "") for a in analysis.ABBREVIATIONS.split("|"))
        self.subjects = frozenset(analysis.SUBJECTS)
        of = frozenset
        self.generic, self.personal, self.hedges, self.academic, self.legal, self.informal, self.diary = of(lexicon.GENERIC), of(lexicon.PERSONAL), of(lexicon.HEDGES), of(lexicon.ACADEMIC), of(lexicon.LEGAL), of(lexicon.INFORMAL), of(lexicon.DIARY)
        self.generic_phrases, self.hedge_phrases = lexicon.GENERIC_PHRASES, [h for h in lexicon.HEDGES if " " in h]
        self.opening, self.closing, self.passing, self.flat_closing, self.flat_opening = style.OPENING, style.CLOSING, tuple(style.PASSING), style.FLAT_CLOSING, style.FLAT_OPENING
        self.endings, self.tails = tuple(style.NOUN_ENDINGS), of(x[-2:] for x in style.NOUN_ENDINGS)
        self.only_words = _spaced(r"\w")
        self.active = [(of(who.split("|")), re.compile(rf"{_edged_first(who)}{_S}+{_python(verb)}(?!\w)")) for who, verb in style.ACTIVE]
        self.counted = of(style.COUNTED_EN.split("|")), re.compile(rf"(?m)(?:^|[.!?…][\"»']?{_S}+)(?:{style.COUNTED_EN}){_S}*,")
        self.counted_more = []
        for words in style.COUNTED:  # one of several words is never met where every space stands twice
            single = [w for w in words.split("|") if " " not in w]
            self.counted_more.append((single, re.compile(rf"(?m)(?:^|[.!?…]{_S}+)(?:{'|'.join(single)})(?!\w)")))
        self.openers = of(style.LIST_OPENERS[0].split("|")), [re.compile(rf"(?<!\w)(?:{_python(words)}){_S}*:") for words in style.LIST_OPENERS]
        self.participles = of(style.PARTICIPLES), re.compile(rf",{_S}+(?:{'|'.join(style.PARTICIPLES)})(?!\w)")
        self.turned = [
            ("not only", re.compile(rf"{_EDGE}not only[^.!?\w][^.!?]{{1,58}}[^.!?\w]but also{_END}")), ("s not ", re.compile(rf"{_EDGE}it'?s not (?:just |merely |simply )?[^.!?,]{{2,40}},?{_S}+it'?s{_END}")),
            ("не только", re.compile(rf"{_EDGE}не только[^.!?\w][^.!?]{{1,58}}[^.!?\w]но и{_END}")), ("не просто", re.compile(rf"{_EDGE}не просто[^.!?\w][^.!?]{{1,39}},?{_S}+а{_END}")),
        ]
        self.strip = re.compile(analysis.INVISIBLE.replace(r"\x{", r"\u").replace("}", ""))
        self.word, self.spaces, self.tokens = re.compile(r"\w+"), re.compile(f"({_S}+)"), re.compile(r"[^\t-\r ]+")
        self.stuck = re.compile("[\U00010000-\U0010ffff" + "".join(chr(c) for c in range(0x10000) if unicodedata.category(chr(c)) == "Lu" and chr(c).lower() == chr(c)) + "]")  # may have no small letters
        self.other_spaces = re.compile("[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
        self.breaks, self.apart = re.compile(rf"[.!?…]{_S}+|\n+|\x1f"), re.compile(r"[\t-\r \x1e(«\"']")
        self.letter = re.compile(rf"[^\W\d_{_marks('Nl No')}]")
        self.greek, self.cyrillic, self.latin, self.ukrainian = re.compile("[Ѐ-ӿͰ-Ͽ]"), re.compile("[Ѐ-ӿ]"), re.compile("[A-Za-z]"), re.compile("[іїєґІЇЄҐ]")
        self.loud, self.digit = re.compile(r"[!?]{2,}|\.{3,}"), re.compile("[0-9]")
        self.short, self.oxford = re.compile(r"\b'(?:t|s|re|ve|ll|d|m)\b"), re.compile(rf",{_S}+and\b")
        self.point = re.compile(r"[0-9]+[.)]")
        self.numbers = re.compile(r"[0-9$](?:(?<=\$)[0-9]+|(?<!\$)(?<!\w[0-9])(?:[0-9]?\b(?:\.[0-9]+\b)?|[0-9]{3}\b|[0-9]*\b%))")
        self.agency = re.compile(rf"(?<!\w)(?:{'|'.join(AGENCIES)})(?!\w)")
        letter = self.letter.pattern
        self.alnum, self.only_alnum, self.alnum_lines = re.compile(r"[^\W_]+"), _spaced(r"[^\W_]"), _spaced(r"[^\W_]|\n")
        self.before, self.again, self.gaps = re.compile(rf"[,.;:!?](?<={_S}.)"), re.compile(",,+|;;+|::+"), re.compile(" {2,}")
        self.i = re.compile(rf"i(?<![^\t-\r ]i)(?=[\t-\r ',.!?]|\Z)")
        self.named = re.compile(rf"{letter}[\w'’-]*"), re.compile(rf"{letter}(?:[^\W_]|['’-])*")
        self.only_named, self.lead = _spaced(r"[^\W_]|['-]"), re.compile(rf"^(?:(?!{letter}).)+")
        self.ends, self.three = re.compile(rf"[.!?…]{_S}+|\x1f"), re.compile(r"[^\t-\r ]+[\t-\r ]+[^\t-\r ]+[\t-\r ]+[^\t-\r ]")
        self.bare = of(chr(c) for c in range(256) if re.match(r"[^\W_]|['-]", chr(c)) and not chr(c).isalpha())  # a word may begin with them, and they are no letters
        self.machine, self.casual = of(lexicon.MACHINE_WORDS), of(lexicon.CASUAL_WORDS)
        letters = dict(reversed(list(zip(*alike, strict=True))))  # the first of two counts
        self.alike = frozenset(letters), str.maketrans(letters)


def _clamped(x: float) -> float:
    return math.floor(max(0.0, min(1.0, x)) * 10000 + 0.5) / 10000


def _mean(xs: list) -> float:
    return sum(xs) / len(xs) if xs else 0.0


def _squares(xs: list, mean: float) -> float:
    return sum([(x - mean) * (x - mean) for x in xs])


def _cv(xs: list, less: int = 1) -> float:
    """Standard deviation over the mean; 0 where there are too few or the mean is 0."""
    mean = _mean(xs)
    return math.sqrt(_squares(xs, mean) / (len(xs) - 1)) / mean if len(xs) > less and mean > 0 else 0.0


def _bits(counts, n: int) -> float:
    """Most counts are alike: one logarithm for each that differs."""
    return sum([-k * x / n * math.log(x / n) for x, k in Counter(counts).items()]) / math.log(2) if n else 0.0


def _letters(low: str, plain: bytes | None) -> float:
    if not low:
        return 0.0
    counts = np.bincount(np.frombuffer(plain, np.uint8)) if plain is not None else np.unique(np.frombuffer(low.encode("utf-32-le"), np.uint32), return_counts=True)[1]
    p = counts[counts > 0] / len(low)
    return float(-(p * np.log(p)).sum() / math.log(2))


def sentences(r: Rules, t: str) -> list[str]:
    """Breaks after . ! ? … before white space and at newlines, not after abbreviations and initials; letterless ones go."""
    parts, begin, held = [], 0, ""
    for m in r.breaks.finditer(t):
        at, end = m.span()
        if t[at] == ".":
            tail = r.apart.split(t[max(0, at - 7) : at])[-1]
            if tail and len(tail) < 7:
                if len(tail) == 1 and unicodedata.category(tail) in ("Lu", "Ll", "Lt"):
                    held, begin = held + t[begin : at + 1] + " ", end
                    continue
                if (tail.lower() if tail.isascii() else tail) in r.abbreviations:
                    held, begin = held + t[begin : at + 1] + " ", end
                    continue
        parts.append(held + t[begin : at + (t[at] in ".!?…")])
        held, begin = "", end
    parts.append(held + t[begin:])
    if "\x1e" in t:
        parts = [x.replace("\x1e", " ") for x in parts]
    parts = [x.strip(_WS) for x in parts]
    return [x for x in parts if len(x) >= 2 and (x[0].isalpha() or r.letter.search(x))]


def _latin(t: str) -> bytes | None:
    """The characters as bytes where each is one of the first 256."""
    try:
        return t.encode("latin-1")
    except UnicodeEncodeError:
        return None


def _folded(r: Rules, a: str) -> str:
    if a.isascii() or not r.greek.search(a):
        return a
    frm, table = r.alike
    out = []
    for x in r.spaces.sub("\x1f\\1\x1f", a).split("\x1f"):
        latin, alike = len(r.latin.findall(x)), sum(c in frm for c in x)
        out.append(x.translate(table) if latin > 0 and alike > 0 and latin >= alike else x)
    return "".join(out)


def _by_word(guarded: list) -> tuple[dict, list]:
    """Patterns by the longest word that a text must have for them, and those that need no certain word."""
    by, rest = {}, []
    for one in guarded:
        (by.setdefault(max(one[0], key=len), []) if one[0] else rest).append(one)
    return by, rest


def _count(guarded: tuple[dict, list], t: str, words: set) -> int:
    by, rest = guarded
    n = 0
    for w in by.keys() & words:
        for whole, found, pattern in by[w]:
            if whole <= words and any([x in t for x in found]):
                n += len(pattern.findall(t))
    for _, found, pattern in rest:
        for x in found:
            if x in t:
                n += len(pattern.findall(t))
                break
    return n


def _begun(r: Rules, lines: list[str]) -> tuple[int, int, int]:
    """Lines that begin with a bullet, with a number and a point, and with one of at most two digits."""
    bullets = points = few = 0
    last = len(lines) - 1
    for k, x in enumerate(lines):
        y = x.lstrip(_WS)
        if not y:
            continue
        if y[0] in "-*•":
            bullets += y[1] in _WS if len(y) > 1 else k < last
        elif "0" <= y[0] <= "9" and (m := r.point.match(y)):
            at = m.end()
            if y[at] in _WS if len(y) > at else k < last:
                points += 1
                few += at < 4
    return bullets, points, few


def _ready(m: str) -> tuple:
    """A marker with whether it is a long one of letters alone, and the words in its middle, which are words of the text."""
    return m, len(m) >= LONG and m.isalpha(), frozenset(m.split(" ")[1:-1])


def _occurrences(ms: list[tuple], low: str, words: set, long_: str) -> int:
    """Of all markers, each on its own; a long one of letters alone is inside a long word."""
    n = 0
    for m, alone, inner in ms:
        if alone:
            if m in long_:
                n += low.count(m)
        elif inner <= words and m:
            n += low.count(m)
    return n


def _health(r: Rules, text: str, lang: str | None, t: str, s: list[str], low: str, plain: bytes | None, words: list[str]) -> tuple:
    """Mechanics, uniqueness and variety of a text; t is what the measures took for it, and the rest is t's."""
    if t != text:
        s, low = sentences(r, text), text.lower()
        plain = _latin(low)
        words = r.word.findall(low)
    if plain is None:
        w = [x.lower() for x in r.alnum.findall(text)]
    else:
        w = plain.translate(r.only_alnum).decode("latin-1").split() if "_" in low else words
    bad = 0
    for x in s:
        first = x[0] if x[0].isalpha() else r.letter.search(x)[0]
        upper = first.upper()
        bad += first != upper and first.lower() != upper
    doubled = sum([a == b and len(a) > 1 for a, b in zip(w, w[1:])])
    space = len(r.gaps.findall(text)) if "  " in text else 0
    again = len(r.again.findall(text)) if ",," in text or ";;" in text or "::" in text else 0
    apart = abs(sum(map(text.count, "([{")) - sum(map(text.count, ")]}")))
    pen = (bad / len(s) * 25 if s else 0.0) + min(space * 2, 10) + min(len(r.before.findall(text)) * 2, 10) + min(again * 3, 12) + min(doubled * 3, 15) + min(apart * 3, 10) + (min(len(r.i.findall(text)) * 2, 10) if lang == "en" else 0)
    mechanics = math.floor(max(0.0, min(100.0, 100 - pen)) * 1000 + 0.5) / 1000 if text.strip(_WS) else 100.0

    n, unique = len(words), 1.0
    if n:
        ratios, once = [1.0, 1.0, 1.0], False
        for k in (2, 3, 4):
            if n >= k and not once:  # where none comes twice, no longer one does
                kinds = len(set(zip(*(words[j:] for j in range(k)))))
                ratios[k - 2], once = kinds / (n - k + 1), kinds == n - k + 1
        u2, u3, u4 = ratios
        v = len(set(words))
        unique = math.floor((0.15 * u2 + 0.25 * u3 + 0.25 * u4 + 0.2 * v / n + 0.15 * v / n) * 10000 + 0.5) / 10000

    variety = 100.0
    if w:
        joined = _latin("\n".join(s))
        lens = [len(r.alnum.findall(x)) for x in s] if joined is None else [len(x.split()) for x in joined.translate(r.alnum_lines).split(b"\n")] if s else []
        mean = _mean(lens)
        cv = math.sqrt(_squares(lens, mean) / len(lens)) / mean if len(lens) >= 2 and mean > 0 else 0.0
        variety = math.floor((min(len(set(w)) / len(w) / 0.7, 1.0) * 60 + min(cv / 0.5, 1.0) * 40) * 1000 + 0.5) / 1000
    return mechanics, unique, variety


def _named_words(r: Rules, low: str) -> list[str]:
    """Words that begin with a letter and go on with letters, numbers, apostrophes and hyphens."""
    plain = _latin(low)
    if plain is None:
        return r.named["_" in low].findall(low)
    found = plain.translate(r.only_named).decode("latin-1").split()
    return [y for x in found if (y := x if x[0].isalpha() else r.lead.sub("", x))]


def _quick_words(r: Rules, text: str) -> tuple:
    tk = _named_words(r, text.lower())
    return len([x for x in tk if x in r.machine]), len([x for x in tk if x in r.casual]), len(tk), len([x for x in tk if len(x) >= 9])


def _heat(r: Rules, text: str, t: str, low: str, plain: bytes | None) -> list[tuple]:
    """All sentences of three words and more, each with its words, those of a machine, those of casual prose, and what they are divided by.

    t is what the measures took for the text, and the rest is t's. Latin-1 text in lower case has its letters where the text has them."""
    if t != text:
        low = text.lower()
        plain = _latin(low)
    named = None if plain is None else plain.translate(r.only_named).decode("latin-1")
    out, known, begin = [], {}, 0
    for m in [*r.ends.finditer(text), None]:
        start, end = (begin, len(text)) if m is None else (begin, m.start() + (m[0] != "\x1f"))
        begin = m.end() if m else begin
        x = text[start:end]
        y = x.strip(_WS)
        if len(y) < 5:
            continue
        one = known.get(y)
        if one is None:
            if not r.three.match(y):
                known[y] = ()
                continue
            if named is None:
                small = y.lower()
                tk = _named_words(r, small)
            else:
                small = low[start:end]
                tk = named[start:end].split()
                if not r.bare.isdisjoint(small):
                    tk = [z for w in tk if (z := w if w[0].isalpha() else r.lead.sub("", w))]
            n = len(tk)
            more = (1.0 if "'" in small and any([w in small for w in ("n't", "'re", "'ll", "'m", "'ve")]) or "gonna" in small or "wanna" in small else 0.0) + (0.5 if y[-1] in "!?" else 0.0)
            a = 0 if r.machine.isdisjoint(tk) else len([w for w in tk if w in r.machine])
            h = 0 if r.casual.isdisjoint(tk) else len([w for w in tk if w in r.casual])
            known[y] = one = (y, n, float(a), h + more, float(max(5, n)))
        if one:
            out.append(one)
    return out


def _score(r: Rules, text: str, lang: str | None, pack: tuple | None, also: str = "") -> tuple:
    """(measures by name, the trigram one None where texts are to be counted together, domain, language, words, sentences, long enough, low, lower sentences, what else is counted)."""
    told = lang
    a = text if text.isascii() else r.strip.sub("", text)
    t = _folded(r, a)
    if lang in (None, "", "auto"):
        first = t if also in SNIFF_WHOLE else t[:4000]
        east = 0 if first.isascii() else len(r.cyrillic.findall(first))
        lang = ("uk" if r.ukrainian.search(first) else "ru") if east > len(r.latin.findall(first)) else "en"
    else:
        lang = lang.lower()[:2]
    low = t.lower()
    ascii_ = low.isascii()
    s = sentences(r, t)
    ls = [x.lower() for x in s]
    plain = _latin(low)
    other = any([x in t for x in OTHER_SPACES]) if plain is not None else r.other_spaces.search(t)
    parted = r.tokens.findall if other else str.split  # the same where there is no white space of other kinds
    lines = t.split("\n")
    by_line = [parted(x) for x in lines]
    w1, wl = by_line[0] if len(lines) == 1 else list(chain.from_iterable(by_line)), parted(low)
    nw, ns = len(w1), len(s)
    seen = Counter(wl)
    among = lambda ws: sum([seen[x] for x in ws & seen.keys()])
    z = max(nw, 1)
    mt = low.replace("\x01", " ").replace("\x02", " ") if "\x01" in low or "\x02" in low else low
    words = r.word.findall(low) if plain is None else plain.translate(r.only_words).decode("latin-1").split()
    wordset = set(words)
    split = [parted(x) for x in ls]
    sizes = [len(x) for x in split]
    full = [n for n in map(len, by_line) if n]
    paragraphs = [x for x in (x.strip(_WS) for x in t.split("\n\n")) if x]
    out = {}

    bare = {x: x.strip(EDGES) for x in seen}
    w0 = list(map(bare.__getitem__, wl))
    stripped = Counter(w0)
    if nw < 10:
        out["entropy"] = 0.5
    else:
        said = [x for x in w0 if x] if "" in stripped else w0
        hw, hc = _bits(stripped.values(), nw), _letters(low, plain)
        pairs = len(said) - 1
        h2 = _bits(Counter(zip(said, said[1:])).values(), pairs) - hw if pairs > 0 else hw
        base = lambda x, a, b: max(0.0, 1 - (x - a) / b)
        out["entropy"] = _clamped(0.2 * base(hc, 4, 1.5) + 0.5 * base(hw, 5, 3) + 0.3 * base(h2, 0, 4) if lang in ("ru", "uk") else 0.2 * base(hc, 3, 2) + 0.5 * base(hw, 5, 5) + 0.3 * base(h2, 0, 3))

    mean = _mean(sizes)
    if ns < 4 or mean == 0:
        out["burstiness"] = 0.5
    else:
        far = len([x for x in sizes if x <= 5 or x >= 30]) / ns
        b = max(0.0, 1 - (_cv(sizes) - 0.1) / 0.7) * (0.7 if mean < 10 else 1.0)
        out["burstiness"] = _clamped(min(b + 0.07, 1.0) if far < 0.05 else max(b - 0.1, 0.0) if far > 0.2 else b)

    out["vocabulary"] = out["stylometry"] = 0.5
    stop, connectors, bureaucratic, bureaucratic_phrases, starters, _ = pack or (frozenset(), [], [], [], [], [])
    if pack is not None and nw >= 20:
        cw = [x for x in w0 if len(x) > 2 and x not in stop]
        n = len(cw)
        if n >= 10:
            counts = Counter(cw)
            k = len(counts)
            ttr = k / n
            mattr = ttr
            if n >= 25:
                before, total = {}, 0
                for j, x in enumerate(cw):  # the windows in which it is the first of its kind
                    a, b = max(j - 24, before.get(x, -1) + 1, 0), min(j, n - 25)
                    total += b - a + 1 if b >= a else 0
                    before[x] = j
                mattr = total / 25 / (n - 24)
            yule = 10000 * (sum(x * x for x in counts.values()) - n) / (n * n)
            hapax = sum(x == 1 for x in counts.values()) / k
            raw = 0.2 * max(0.0, 1 - (ttr - 0.3) / 0.4) + 0.3 * max(0.0, 1 - (mattr - 0.6) / 0.3) + 0.25 * min(yule / 150, 1.0) + 0.25 * max(0.0, 1 - hapax / 0.5)
            out["vocabulary"] = _clamped(0.5 + (raw - 0.5) * min(n / 150, 1.0))
        lens = [n for n in map(len, w0 if plain is not None else [x.strip(EDGES) for x in w1]) if n]  # in lower case a letter may become two
        far = len([x for x in lens if x > 8]) / len(lens) if lens else 0.0
        asl = sum(sizes) / ns if ns else 0.0
        stops = sum([n for x, n in stripped.items() if x in stop]) / z
        out["stylometry"] = _clamped(0.2 * max(0.0, (_mean(lens) - 4) / 3) + 0.15 * (max(0.0, 1 - _cv(lens) / 0.7) if len(lens) > 5 else 0.5) + 0.2 * min(far / 0.15, 1.0) + 0.25 * max(0.0, (asl - 10) / 15) + 0.2 * max(0.0, 1 - (stops - 0.25) / 0.3))

    if nw < 20:
        out["pattern"] = out["entity"] = 0.5
    else:
        adv, adj, verb, conn, phr = r.markers.get(lang, r.markers["en"])
        conn = list(dict.fromkeys([*conn, *map(_ready, connectors)]))
        others = {x[0] for x in (*adv, *adj, *verb, *conn)} if bureaucratic else ()
        bur = [_ready(x) for x in bureaucratic if " " not in x and len(x) >= 5 and x not in others]
        phr = list(dict.fromkeys([*phr, *map(_ready, [x for x in bureaucratic if " " in x]), *map(_ready, bureaucratic_phrases)]))
        long_ = "\n".join([x for x in wordset if len(x) >= LONG])
        times = lambda ms: _occurrences(ms, low, wordset, long_)
        dens = (1.5 * times(adv) + 1.3 * times(adj) + 1.5 * times(verb) + 2.0 * times(conn) + 1.5 * times(bur) + 3.0 * times(phr)) / z
        present = sum([m in (long_ if alone else low) for m, alone, _ in conn])
        begun = r.starters + tuple(connectors) + tuple(m for m in starters if " " in m)
        formal = sum([" ".join(x[:3]).rstrip(".,;:").startswith(begun) for x in split])
        hedges = _count(r.hedging, mt, wordset) + (len(r.both.findall(low)) if "both " in low else 0)
        enums = _count(r.counting, mt, wordset)
        lens = full
        middle = _mean(lens)
        sym = max(0.0, 1 - math.sqrt(_squares(lens, middle) / len(lens)) / middle * 2) if len(lens) >= 3 and middle > 0 else 0.0
        n = max(ns, 1)
        out["pattern"] = _clamped(0.2 * min(dens / 0.05, 1.0) + 0.12 * min(present / n / 0.15, 1.0) + 0.15 * min(formal / n / 0.2, 1.0) + 0.3 * min(hedges / max(n * 0.15, 1.0), 1.0) + 0.1 * min(enums / 3, 1.0) + 0.13 * sym)
        generic = among(r.generic) + sum(low.count(m) for m in r.generic_phrases)
        numbers = len(r.numbers.findall(mt)) if r.digit.search(mt) else 0
        capital = [k for k in (range(nw) if not ascii_ and r.stuck.search(t) else compress(range(nw), map(ne, w1, wl))) if w1[k][0].isupper()]
        names = sum([k > 0 and len(w1[k]) > 1 and w1[k].isalpha() and w1[k - 1][-1] not in ".!?:\"" for k in capital])
        mine, hedged = among(r.personal), among(r.hedges) + sum(low.count(m) for m in r.hedge_phrases)
        out["entity"] = _clamped((min(generic / z / 0.03, 1.0) + max(0.0, 1 - (numbers + names) / z / 0.08) + max(0.0, 1 - mine / z / 0.04) + min(hedged / z / 0.02, 1.0)) / 4)

    out["punctuation"] = 0.5 if len(t) < 50 else _clamped(0.42 + 0.16 * max(0.0, 1 - (t.count("!") + t.count("...") + t.count("…")) * 1000 / len(t) / 2))

    lens = full[:1] if len(lines) == 1 else [n for n in (sum([len(x) for _, x in some]) for empty, some in groupby(zip(lines, by_line), lambda x: not x[0]) if not empty) if n]
    bullets, points, few = _begun(r, lines)
    if ns < 3:
        out["grammar"] = 0.5
    else:
        rated = lambda x, least, by: 1.0 if x == 1 else max(0.0, x - least) * by
        opens, ands = t.count("("), words.count("and")
        listed = bullets + points
        g = [rated(sum([unicodedata.category(x[0]) == "Lu" for x in s]) / ns, 0.9, 10), rated(sum([x[-1] in ".!?…" for x in s]) / ns, 0.85, 6.7), 1.0 if opens == t.count(")") and opens > 0 else 0.0]
        if r.latin.search(t):
            g.append(max(0.0, 1 - (len(r.short.findall(mt)) if "'" in mt else 0) / z / 0.03))
        if len(lens) > 2 and _mean(lens) > 0:
            g.append(max(0.0, 1 - _cv(lens) / 0.5))
        if ands > 2:
            g.append(min(len(r.oxford.findall(mt)) / ands / 0.3, 1.0))
        g.append(max(0.0, 1 - len([x for x in sizes if x < 4]) / ns / 0.15))
        if ns > 5:
            g.append(max(0.0, 1 - (len(r.loud.findall(t)) if any(x in t for x in LOUD) else 0) / ns / 0.1))
        if listed >= 3:
            g.append(0.8)
        out["grammar"] = _clamped(0.5 + (sum(g) / len(g) - 0.5) * 0.5)

    first = [x[0].rstrip(".,;:") for x in split]
    if ns < 5:
        out["opening"] = out["rhythm"] = 0.5
    else:
        counts = Counter(first)
        same, subj = sum(map(eq, first, first[1:])), len([x for x in first if x in r.subjects])
        out["opening"] = _clamped(0.3 * max(0.0, 1 - (len(counts) / ns - 0.2) / 0.6) + 0.25 * min(1.0, max(counts.values()) / ns / 0.3) + 0.2 * min(1.0, subj / ns / 0.5) + 0.25 * min(1.0, same / (ns - 1) / 0.15))
        v = _squares(sizes, mean) / (ns - 1)
        follow = list(zip(sizes, sizes[1:]))
        bands = [1 if x <= 8 else 2 if x <= 20 else 3 for x in sizes]
        ac = 1.0 if v == 0 else sum([(x - mean) * (y - mean) for x, y in follow]) / (ns - 1) / v
        turns, close = sum(map(ne, bands, bands[1:])), len([1 for x, y in follow if -3 <= y - x <= 3])
        out["rhythm"] = _clamped(0.4 * max(0.0, (ac + 0.1) / 0.7) + 0.3 * max(0.0, 1 - (1 + turns) / ns / 0.8) + 0.3 * min(close / (ns - 1) / 0.5, 1.0))

    tiles = []
    if ns >= 9:
        marks = [len("".join(x)) for x in (split if ascii_ else map(parted, s))]  # in lower case a letter may become two
        for k in range(0, ns - ns % 3, 3):
            c3, n3 = sum(marks[k : k + 3]), sum(sizes[k : k + 3])
            tiles.append(0.5 * c3 / n3 + 0.5 * n3 / 3)
    out["readability"] = 0.5 if len(tiles) < 3 else _clamped(max(0.0, 1 - _cv(tiles) / 0.2))

    if len(paragraphs) >= 3:
        np_, lp = len(paragraphs), [x.lower() for x in paragraphs]
        say = lambda x, phrases: any(m in x for m in phrases)
        body = max(0.0, 1 - _cv(lens[1:-1]) / 0.5) if len(lens) >= 4 and _mean(lens[1:-1]) > 0 else None
        most = max(Counter(r.tokens.search(x)[0].rstrip(".,;:") for x in lp).values())
        passed = sum(r.spaces.sub(" ", x, 4).startswith(r.passing) for x in lp[1:])  # no phrase has more spaces
        many = (0.9 if say(lp[0], r.opening) else 0.1) + (1.0 if say(lp[-1], r.closing) else 0.0) + min(passed / (np_ - 1) / 0.4, 1.0) + (body or 0.0) + (min(1.0, most / np_ / 0.3) if np_ >= 4 else 0.0)
        out["discourse"] = _clamped(many / (3 + (body is not None) + (np_ >= 4)))
    elif ns < 5:
        out["discourse"] = 0.5
    else:
        out["discourse"] = _clamped(((0.8 if any(m in ls[-1] for m in r.flat_closing) else 0.2) + (0.7 if any(m in ls[0] for m in r.flat_opening) else 0.3)) / 2)

    if "\x1e" in t or "\x1f" in t:  # words that only sentences part
        bare |= {x: x.strip(EDGES) for words_ in split for x in words_}
    big = {x: y for x, y in bare.items() if len(y) > 3}
    sets = [set(map(big.get, words_)) for words_ in split]
    for y in sets:
        y.discard(None)
    sets = [y for y in sets if y]
    n, total, high = 0, 0.0, 0
    for o in (2, 3, 4, 5):
        for x, y in zip(sets, sets[o:]):
            common = len(x & y)
            if common:
                share = common / (len(x) + len(y) - common)
                total += share
                high += share > 0.35
        n += max(len(sets) - o, 0)
    out["semantic_rep"] = 0.5 if ns < 5 or len(sets) < 4 or not n else _clamped(0.5 * min(total / n / 0.2, 1.0) + 0.5 * min(high / n / 0.15, 1.0))

    if ns < 4:
        out["voice"] = 0.5
    else:
        noun = sum([_noun(r.endings, x) for x in words if x[-2:] in r.tails and x.endswith(r.endings)])
        act = sum(len(p.findall(low)) for who, p in r.active if not who.isdisjoint(wordset))
        out["voice"] = _clamped(0.62 * min(noun / nw / 0.07, 1.0) + 0.38 * max(0.0, 1 - act / ns / 0.3))

    n = max(ns, 1)
    counted = bullets + few + (0 if r.counted[0].isdisjoint(wordset) else len(r.counted[1].findall(low)))
    for some, p in r.counted_more:
        if any(x in low for x in some):
            counted += len(p.findall(low))
    lists = 0
    if ":" in low:
        lists += 0 if r.openers[0].isdisjoint(wordset) else len(r.openers[1][0].findall(low))
        lists += 0 if ascii_ else sum(len(p.findall(low)) for p in r.openers[1][1:])
    tail = 0 if r.participles[0].isdisjoint(wordset) else len(r.participles[1].findall(low))
    turn = sum(len(p.findall(low)) for x, p in r.turned if x in low)
    part = lambda x, full: min(x / n / full, 1.0)
    out["structure"] = _clamped(0.34 + 0.62 * (0.42 * part(counted, 0.5) + 0.28 * part(tail, 0.4) + 0.18 * part(lists, 0.25) + 0.12 * part(turn, 0.2)))

    if any(x in stripped for x in r.academic) and sum(n for x, n in seen.items() if x.strip(".,;:") in r.academic) / z > 0.02:
        domain = "academic"
    elif among(r.legal) >= 2:
        domain = "legal"
    elif t.count("```") >= 2 or t.count("`") > 5 or ("function" in low and "return" in low) or ("class " in low and "def " in low):
        domain = "code_docs"
    elif among(r.informal) >= 1 or t.count("!") > 3 or "😂" in t or "🤣" in t:
        domain = "social"
    elif (any([x in t for x in AGENCIES]) and r.agency.search(t)) or ((t.count('"') >= 4 or t.count("«") >= 2) and (nw / len(full) if full else 50) < 30 and len(full) > 3):
        domain = "news"
    else:
        domain = "blog" if among(r.diary) / z > 0.03 else "general"
    out["perplexity"] = alone(plain, ls, lang in ("ru", "uk"))
    more = _health(r, text, told, t, s, low, plain, words) if also == "health" else _quick_words(r, text) if also == "quick" else _heat(r, text, t, low, plain) if also == "heat" else ()
    return out, domain, lang, nw, ns, len(t.strip(_WS)) >= 50, low, ls, more


def _heats(rows: list[list[tuple]]) -> pa.Array:
    flat = [x for xs in rows for x in xs]
    inner = pa.StructArray.from_arrays([pa.array([x[k] for x in flat], f.type) for k, f in enumerate(_HW)], fields=list(_HW))
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(xs) for xs in rows])]), pa.int32()), inner)


def score(r: Rules, text: pa.Array, lang: pa.Array, known: pa.Array | None = None, *lists: pa.Array, also: str = "") -> pa.Array:
    """Texts and their languages, with the lists of their packs where there are some -> the measures as one structure,
    and what else is asked for (a name of ALSO)."""
    fields = [*OUT, *(pa.field(*x) for x in ALSO[also])]
    packs = [None] * len(text)
    collecting = gc.isenabled()
    gc.disable()  # nothing here refers to itself, and looking for it takes a tenth of the time
    try:
        return _batch(r, text, lang, packs, known, lists, also, fields)
    finally:
        if collecting:
            gc.enable()


def _batch(r: Rules, text: pa.Array, lang: pa.Array, packs: list, known: pa.Array | None, lists: tuple, also: str, fields: list) -> pa.Array:
    if known is not None:
        columns, last, made = [x.to_pylist() for x in lists], None, None
        for k, is_known in enumerate(known.to_pylist()):
            if is_known:
                now = [c[k] for c in columns]
                if now != last:
                    last, made = now, (frozenset(now[0]), *now[1:])
                packs[k] = made
    text, lang, out = text.to_pylist(), lang.to_pylist(), []
    for k in range(0, len(text), ROWS):
        rows = [_score(r, t or "", x, p, also) for t, x, p in zip(text[k : k + ROWS], lang[k : k + ROWS], packs[k : k + ROWS], strict=True)]
        column = lambda n, kind: pa.array([x[n] for x in rows], kind)  # noqa: B023, E731
        measures = {m: pa.array([x[0].get(m) for x in rows], pa.float64()) for m in MEASURES}
        if left := [x for x in rows if x[0]["perplexity"] is None]:
            of = lambda n, kind: pa.array([x[n] for x in left], kind)  # noqa: B023, E731
            for x, y in zip(left, perplexity(of(6, pa.string()), of(7, pa.list_(pa.string())), of(2, pa.string())).to_pylist(), strict=True):
                x[0]["perplexity"] = y
            measures["perplexity"] = pa.array([x[0]["perplexity"] for x in rows], pa.float64())
        rest = [column(n, kind) for n, kind in ((1, pa.string()), (2, pa.string()), (3, pa.float64()), (4, pa.float64()), (5, pa.bool_()))]
        more = [_heats([x[8] for x in rows])] if also == "heat" else [pa.array([x[8][j] for x in rows], kind) for j, (_, kind) in enumerate(ALSO[also])]
        out.append(pa.StructArray.from_arrays([*(measures[m] for m in MEASURES), *rest, *more], fields=fields))
    return pa.concat_arrays(out) if out else pa.array([], pa.struct(fields))
