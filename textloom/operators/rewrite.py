"""Rewriting: typography, swaps of stock words and connectors, sentence rhythm, tone, and what a rewrite changed.

`typography` is expressions. The seeded rewriters are plain functions of one text, run over Arrow batches: their steps
depend on each other's edits. Chance is a hash of seed, row, rule and occurrence, so a text is rewritten alike under any
partitioning. What must not change (code, addresses, links) is cut out first and put back. Terms come from a lexicon: the
small one here, or packs.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions.dialect import Operator, indexed
from textloom.operators.analysis import text as _text

#: By profile the dash, the quotes and the ellipsis.
PROFILES = {
    "chat": ("-", '"', "..."), "web": ("–", '"', "..."), "seo": ("–", '"', "..."), "docs": ("—", '"', "…"), "formal": ("—", "«»", "…"), "academic": ("—", "«»", "…"),
    "marketing": ("–", '"', "..."), "social": ("-", '"', "..."), "email": ("–", '"', "..."),
}
ADDRESS = r"[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}|https?://[^\s<>\"']+|www\.[^\s<>\"']+"
KEPT = ADDRESS + r"|[A-Za-z0-9\-]+(?:\.[A-Za-z0-9\-]+)+"
PROTECTED = re.compile(r"```.*?```|`[^`\n]+`|" + ADDRESS, re.S)

#: Stock words and phrases of ours with plainer ones; an empty alternative leaves the term out.
LEXICON = {
    "en": {
        "bureaucratic_phrases": {
            "in order to": ["to"], "due to the fact that": ["because"], "at this point in time": ["now"], "it is important to note that": [""], "it should be noted that": [""], "with regard to": ["about"], "in the event that": ["if"],
            "a wide range of": ["many"], "plays a crucial role in": ["matters for"], "prior to": ["before"], "in light of": ["given"], "for the purpose of": ["for"], "a number of": ["several"], "in the modern era": ["today"],
        },
        "bureaucratic": {
            "utilize": ["use"], "utilizes": ["uses"], "utilization": ["use"], "facilitate": ["help", "ease"], "facilitates": ["helps", "eases"], "implement": ["set up", "put in place"], "implementation": ["rollout", "setup"], "leverage": ["use", "draw on"], "comprehensive": ["full", "thorough"], "crucial": ["key", "vital"],
            "significant": ["big", "major"], "substantial": ["large", "solid"], "innovative": ["new", "fresh"], "methodologies": ["methods"], "methodology": ["method"], "optimization": ["tuning"], "demonstrate": ["show"], "demonstrates": ["shows"], "numerous": ["many"], "commence": ["start"], "terminate": ["end"],
            "endeavor": ["try"], "obtain": ["get"], "sufficient": ["enough"], "fundamental": ["basic"], "robust": ["solid", "sturdy"], "enhance": ["improve", "lift"], "foster": ["build", "grow"],
        },
        "ai_connectors": {"Furthermore": ["Also", "Plus"], "Moreover": ["Besides", "And"], "Additionally": ["Also", "On top of that"], "Consequently": ["So"], "However": ["But", "Still"], "Therefore": ["So"], "Nevertheless": ["Even so"], "In conclusion": ["All told"], "Thus": ["So"]},
        "nominal": {"the implementation of": ["implementing"], "the utilization of": ["using"], "the optimization of": ["optimizing"], "the integration of": ["integrating"], "the development of": ["developing"], "the creation of": ["creating"], "the improvement of": ["improving"], "the achievement of": ["achieving"]},
        "sentence_starters": {"This": ["That"], "It": ["That"], "These": ["Those"]},
        "synonyms": {"important": ["weighty"], "problem": ["trouble"], "people": ["folks"], "result": ["outcome"], "change": ["shift"], "method": ["approach"], "system": ["setup"], "organizations": ["groups"], "development": ["growth"]},
        "hedges": {"it is clear that": [""], "it is worth mentioning that": [""], "needless to say": [""], "as a matter of fact": ["in fact"]},
        "formal": {"get": "obtain", "buy": "purchase", "help": "assist", "need": "require", "start": "commence", "end": "conclude", "show": "demonstrate", "use": "employ", "ask": "inquire", "think": "consider", "enough": "sufficient", "about": "regarding"},
    },
}
SPLITTERS = {"en": " and | but | so | because | while | which "}


def _typography(profile: str):
    dash, quotes, dots = PROFILES[profile]

    def layers(d) -> list[dict]:
        ws, letter = r"[\x09-\x0D\x20]", "[A-Za-zА-Яа-яёЁіІїЇєЄґҐ]"
        out = [_text(d)]
        step = lambda x: out.append({"t": x})
        if dash != "—":
            for _ in range(2):
                step(d.replace("t", rf"([^\x09-\x0D\x20]){ws}*—{ws}*([^\x09-\x0D\x20])", f"$1 {dash} $2"))
        else:
            step(d.replace("t", r"([A-Za-z0-9_])—([A-Za-z0-9_])", f"$1 {dash} $2"))
        if quotes == '"':
            step(d.replace(d.replace("t", "[«»„‟“”]", '"'), "[‹›]", "'"))
        else:
            step("translate(t, '„“”', '««»')")
            out.append({"q": d.split("t", '"')})
            step(d.join(indexed(d, "q", "case when <k> = 0 then <w> when <k> % 2 = 1 then concat('«', <w>) else concat('»', <w>) end"), ""))
        if dots == "...":
            step(d.replace("t", "…", "..."))
        else:
            step(d.replace(d.replace(d.replace("t", r"\.{4,}", "\x01$0\x01") if d.name == "spark" else d.replace("t", r"(\.{4,})", "\x01$1\x01"), r"(^|[^.\x01])\.{3}($|[^.])", "$1…$2"), r"\x01", ""))
        if profile != "formal":
            step(d.replace("t", r"[\x{00A0}\x{2007}\x{2009}\x{200A}\x{202F}]", " "))
        piece = d.replace(d.replace("x", rf"{ws}+([,:;!?])", "$1"), rf"({ws})(\.{{4,}})", "$1\x01$2")
        piece = d.replace(d.replace(d.replace(piece, rf"{ws}+\.", "."), r"\x01", ""), rf"([,.:;!?])({letter})", "$1 $2")
        out.append({"free": d.split("t", KEPT), "kept": d.extract("t", KEPT)})
        out.append({"free": d.map("free", "x", piece)})
        step(d.join(indexed(d, "free", f"concat(<w>, coalesce({d.at('kept', '<k>')}, ''))"), ""))
        step(d.replace("t", r"([^ \t\n]) {2,}", "$1 "))
        out.append({"typeset": "t", "typeset_md5": "md5(t)", "changed": "t <> coalesce(text, '')"})
        return out

    return layers


def typography(profile: str = "web") -> Operator:
    """Dashes, quotes, ellipses and spaces as a profile has them; addresses, links and dotted names stay as they are."""
    return Operator(_typography(profile), ["typeset_md5", "changed"], extra=["text"])


def typeset(docs: DataFrame, profile: str = "web") -> DataFrame:
    return Operator(_typography(profile), ["typeset", "changed"], extra=["text"]).apply(docs)


class Chance:
    """Numbers in [0, 1) that a seed, a text's key, a rule and an occurrence decide."""

    def __init__(self, seed: int, key: object):
        self.seed, self.key, self.seen = seed, str(key), Counter()

    def of(self, rule: str) -> float:
        import hashlib

        self.seen[rule] += 1
        digest = hashlib.blake2b(f"{self.seed}|{self.key}|{rule}|{self.seen[rule]}".encode(), digest_size=8).digest()
        return (int.from_bytes(digest, "little") >> 11) / (1 << 53)

    def pick(self, rule: str, options: list[str]) -> str:
        return options[int(self.of(rule) * len(options))]


def match_case(source: str, word: str) -> str:
    """word in the case of source: all capitals, a first capital, or as it is."""
    if len(source) > 1 and source.isupper():
        return word.upper()
    return word[:1].upper() + word[1:] if source[:1].isupper() else word


def masked(text: str) -> tuple[str, list[str]]:
    """Code, links and addresses replaced by marks, and what they were."""
    held: list[str] = []

    def put(m: re.Match) -> str:
        held.append(m[0])
        return f"\uE000{len(held) - 1}\uE001"

    return PROTECTED.sub(put, text), held


def unmasked(text: str, held: list[str]) -> str:
    return re.sub("\uE000(\\d+)\uE001", lambda m: held[int(m[1])] if int(m[1]) < len(held) else m[0], text)


def _common_rows(a: list[str], b: list[str]) -> list[int]:
    """Bit rows of a longest common subsequence: in row i a zero bit j says that b's word j raises it. Linear in len(a) with
    words of len(b) bits."""
    at: dict[str, int] = {}
    for j, x in enumerate(b):
        at[x] = at.get(x, 0) | 1 << j
    full = (1 << len(b)) - 1
    rows, v = [], full
    for x in a:
        u = v & at.get(x, 0)
        v = ((v + u) | (v - u)) & full
        rows.append(v)
    return rows


def change_ratio(a: str, b: str) -> float:
    """1 less twice the common subsequence over both lengths, in words: 0 for equal texts, 1 for texts without a common word."""
    x, y = a.split(), b.split()
    if not x and not y:
        return 0.0
    rows = _common_rows(x, y)
    common = len(y) - bin(rows[-1]).count("1") if rows and y else 0
    return 1 - 2 * common / (len(x) + len(y))


def word_diff(a: str, b: str) -> str:
    """Both texts as one, what only the first has in <del>, what only the second has in <ins>; white space counts as words."""
    x, y = (re.findall(r"\s+|\S+", t) for t in (a, b))
    rows = _common_rows(x, y)
    length = lambda i, j: j - bin(rows[i - 1] & ((1 << j) - 1)).count("1") if i and j else 0
    out: list[tuple[str, str]] = []
    i, j = len(x), len(y)
    while i or j:
        if i and j and x[i - 1] == y[j - 1]:
            i, j = i - 1, j - 1
            out.append(("", x[i]))
        elif j and (not i or length(i, j - 1) >= length(i - 1, j)):
            j -= 1
            out.append(("ins", y[j]))
        else:
            i -= 1
            out.append(("del", x[i]))
    parts: list[str] = []
    for tag, w in reversed(out):
        w = html.escape(w, quote=False)
        parts.append(f"<{tag}>{w}</{tag}>" if tag else w)
    return "".join(parts).replace("</del><del>", "").replace("</ins><ins>", "")


_BEFORE, _AFTER = r"(?:(?<=^)|(?<=[\s(«\"']))", r"(?=$|[\s).,;:!?»\"'…])"


def _closed_up(text: str, start: int, end: int) -> str:
    """text without [start, end): commas and spaces after it go too, and a sentence that begins there takes a capital."""
    head, tail = text[:start].rstrip(" \t"), re.sub(r"^[\s,;:]+", "", text[end:])
    if not tail:
        return text
    if not head or re.search(r"[.!?…][\"»']?$", head):
        tail = tail[0].upper() + tail[1:]
    return f"{head} {tail}" if head and not head.endswith("\n") else head + tail


def swap_terms(text: str, table: dict[str, list[str]], chance: Chance, rule: str, p: float, budget: list[int], log: list) -> str:
    """Terms of a table, longest first, each occurrence with probability p, from the end of the text to its start."""
    for term in sorted(table, key=lambda t: (-len(t), t)):
        if budget[0] <= 0 or not table[term] or term.lower() not in text.lower():
            continue
        for m in reversed(list(re.finditer(_BEFORE + re.escape(term) + _AFTER, text, re.I))):
            if budget[0] <= 0 or chance.of(rule) > p:
                continue
            if re.search(r"\b(?:a|an|the|this|that|these|those)\s+$", text[: m.start()], re.I) and "" in table[term]:
                continue
            new = chance.pick(rule + ":which", table[term])
            text = _closed_up(text, *m.span()) if not new else text[: m.start()] + match_case(m[0], new) + text[m.end() :]
            budget[0] -= 1
            log.append((rule, m[0], new))
    return text


def vary_connectors(text: str, table: dict[str, list[str]], chance: Chance, p: float, log: list) -> str:
    """Connectors that open a sentence: another one, or none where a comma follows; the first of a kind is a little safer."""
    for word in sorted(table, key=lambda t: (-len(t), t)):
        found = list(re.finditer(r"(?:(?<=^)|(?<=[.!?…]\s)|(?<=\n))" + re.escape(word) + r"(?=[,\s])", text))
        for k, m in reversed(list(enumerate(found))):
            if chance.of("connector") > (p if k else 0.85 * p):
                continue
            if text[m.end() : m.end() + 1] == "," and chance.of("connector:drop") < 0.45:
                text = _closed_up(text, *m.span())
                log.append(("connector_drop", m[0], ""))
            else:
                new = match_case(m[0], chance.pick("connector:which", table[word]))
                text = text[: m.start()] + new + text[m.end() :]
                log.append(("connector", m[0], new))
    return text


def vary_starters(text: str, table: dict[str, list[str]], chance: Chance, p: float, log: list) -> str:
    """First words that several sentences share: from the second sentence on another one."""
    seen: Counter = Counter()

    def put(m: re.Match) -> str:
        word = m[2]
        seen[word] += 1
        if seen[word] < 2 or word not in table or chance.of("starter") > 0.8 * p:
            return m[0]
        new = match_case(word, chance.pick("starter:which", table[word]))
        log.append(("starter", word, new))
        return m[1] + new

    return re.sub(r"(^|[.!?…]\s+|\n)([^\W\d_]+)\b", put, text)


def light_synonyms(text: str, table: dict[str, list[str]], chance: Chance, p: float, log: list) -> str:
    """The second occurrence of a word that is used three times and more (twice, if it is long), a few in a text."""
    budget = max(2, len(text.split()) // 60)
    for word in sorted(table):
        found = list(re.finditer(rf"\b{re.escape(word)}\b", text, re.I))
        if budget and len(found) >= (2 if len(word) >= 8 else 3) and chance.of("synonym") < 0.7 * p:
            m = found[1]
            new = match_case(m[0], chance.pick("synonym:which", table[word]))
            text = text[: m.start()] + new + text[m.end() :]
            log.append(("synonym", m[0], new))
            budget -= 1
    return text


def vary_rhythm(text: str, lang: str, chance: Chance, p: float, log: list) -> str:
    """Long sentences split at a conjunction near their middle, where lengths of sentences hardly differ; else two short
    ones joined once. Fewer than four sentences, or lengths that vary already, stay."""
    parts = re.split(r"((?<=[.!?…])\s+)", text)
    body, gaps = parts[::2], parts[1::2] + [""]
    sizes = [len(s.split()) for s in body if s]
    if len(sizes) < 4 or lang not in SPLITTERS:
        return text
    mean = sum(sizes) / len(sizes)
    if sum((n - mean) ** 2 for n in sizes) / len(sizes) > 30:
        return text
    limit = max(11, mean * (1.35 - 0.5 * p))
    out, changed = [], False
    for s, gap in zip(body, gaps, strict=True):
        cuts = [m for m in re.finditer(SPLITTERS[lang].strip("|"), s) if len(s[: m.start()].split()) >= 4 and len(s[m.end() :].split()) >= 4 and "which" not in m[0]]
        if len(s.split()) > limit and cuts and s[-1:] in ".!?…" and chance.of("split") < p:
            m = min(cuts, key=lambda c: abs(len(s) / 2 - c.start()))
            word = m[0].strip()
            tail = s[m.end() :] if word == "and" else f"{word} {s[m.end() :]}"
            s = s[: m.start()].rstrip(",") + ". " + tail[0].upper() + tail[1:]
            log.append(("split", m[0].strip(), "."))
            changed = True
        out += [s, gap]
    if not changed:
        for k in range(len(body) - 1):
            a, b = body[k], body[k + 1]
            if a.endswith(".") and 0 < len(a.split()) + len(b.split()) <= 24 and b[:1].isupper() and b[1:2].islower() and chance.of("join") < 0.5 * p:
                out[2 * k], out[2 * k + 1], out[2 * k + 2] = a[:-1] + ",", " ", "and " + b[0].lower() + b[1:]
                log.append(("join", ".", ", and"))
                break
    return "".join(out)


def adjust_tone(text: str, target: str, lang: str = "en", seed: int = 0, intensity: float = 0.5, lexicon: dict | None = None, key: object = "") -> tuple[str, list]:
    """Words swapped toward a formal or an informal tone: one for each term, at most a tenth of the words times intensity
    (0 to 1). Any other target changes nothing."""
    pairs = (lexicon or LEXICON).get(lang, {}).get("formal", {})
    table = {"formal": pairs, "informal": {v: k for k, v in pairs.items()}}.get(target, {})
    chance, log = Chance(seed, key), []
    left = max(1, int(len(text.split()) * intensity * 0.1)) if intensity > 0 else 0
    inner, held = masked(text)
    for word in sorted(table):
        m = re.search(rf"(?<!\w){re.escape(word)}(?!\w)", inner, re.I)
        if left and m and chance.of("tone") < intensity:
            new = match_case(m[0], table[word])
            inner = inner[: m.start()] + new + inner[m.end() :]
            log.append(("tone", m[0], new))
            left -= 1
    return unmasked(inner, held), log


def paraphrase(text: str, lang: str = "en", intensity: float = 0.5, seed: int = 0, lexicon: dict | None = None, key: object = "") -> tuple[str, list]:
    """Phrases by plainer ones, hedges and opening connectors left out; white space, code, links and addresses stay."""
    if intensity <= 0:
        return text, []
    words, chance, log = (lexicon or LEXICON).get(lang, {}), Chance(seed, key), []
    inner, held = masked(text)
    budget = [10**6]
    inner = swap_terms(inner, words.get("bureaucratic_phrases", {}), chance, "phrase", min(1.5 * intensity, 0.95), budget, log)
    inner = swap_terms(inner, words.get("hedges", {}), chance, "hedge", 0.7 * intensity, budget, log)
    inner = vary_connectors(inner, words.get("ai_connectors", {}), chance, min(1.0, 1.2 * intensity), log)
    return unmasked(inner, held), log


def rewrite(text: str, lang: str = "en", intensity: int = 60, seed: int = 0, lexicon: dict | None = None, key: object = "") -> tuple[str, list]:
    """One pass: connectors, nominal phrases, stock phrases and words within a budget, starters, synonyms, rhythm, articles."""
    p, words = intensity / 100, (lexicon or LEXICON).get(lang, {})
    if p < 0.05 or not words or not text.strip():
        return text, []
    chance, log = Chance(seed, key), []
    inner, held = masked(text)
    inner = vary_connectors(inner, words.get("ai_connectors", {}), chance, p, log)
    budget = [max(2, int(len(inner.split()) * (0.15 + 0.25 * p)))]
    inner = swap_terms(inner, words.get("nominal", {}), chance, "nominal", max(p, 0.7), budget, log)
    inner = swap_terms(inner, words.get("bureaucratic_phrases", {}), chance, "phrase", max(p, 0.92), budget, log)
    inner = swap_terms(inner, words.get("bureaucratic", {}), chance, "word", p, budget, log)
    inner = vary_starters(inner, words.get("sentence_starters", {}), chance, p, log)
    inner = light_synonyms(inner, words.get("synonyms", {}), chance, p, log)
    inner = vary_rhythm(inner, lang, chance, p, log)
    if lang == "en":
        inner = re.sub(r"\b([Aa]) (?=[aeio][a-z])", r"\1n ", inner)
        inner = re.sub(r"\b([Aa])n (?=[bcdfgjklmnpqrstvwxz][a-z])", r"\1 ", inner)
    return unmasked(inner, held), log


def packed_lexicon(rows: list) -> dict:
    """Rows (lang, category, term, alternatives) of packs, a bounded table, as the rewriters take them."""
    out: dict = {}
    for r in rows:
        out.setdefault(r["lang"], {}).setdefault(r["category"], {})[r["term"]] = list(r["alternatives"])
    return out


def _mapped(docs: DataFrame, f: Callable[[str, str, object], tuple[str, list]]) -> DataFrame:
    """doc_id, text and lang through a function of text, language and key -> doc_id, text, rewritten, changes, change_ratio."""

    def run(batches):
        for batch in batches:
            ids, texts, langs = (c.to_pylist() for c in batch.columns)
            got = [f(t or "", (x or "en").lower()[:2], i) for i, t, x in zip(ids, texts, langs, strict=True)]
            logs = [[f"{a}: {b} -> {c}" for a, b, c in log] for _, log in got]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([g[0] for g in got], pa.string()), pa.array(logs, pa.list_(pa.string())), pa.array([change_ratio(t or "", g[0]) for t, g in zip(texts, got, strict=True)], pa.float64())], names=["doc_id", "text", "rewritten", "changes", "change_ratio"])

    return docs.select("doc_id", "text", "lang").mapInArrow(run, "doc_id long, text string, rewritten string, changes array<string>, change_ratio double")


def paraphrased(docs: DataFrame, intensity: float = 0.5, seed: int = 0, lexicon: dict | None = None) -> DataFrame:
    return _mapped(docs, lambda t, lang, key: paraphrase(t, lang, intensity, seed, lexicon, key))


def toned(docs: DataFrame, target: str, intensity: float = 0.5, seed: int = 0, lexicon: dict | None = None) -> DataFrame:
    return _mapped(docs, lambda t, lang, key: adjust_tone(t, target, lang, seed, intensity, lexicon, key))


def adaptive(intensity: int, score: float) -> int:
    """How hard to rewrite a text whose score is 0 to 100: little where it reads human already, more where it does not."""
    if score <= 5:
        return 0
    if score <= 15:
        return max(8, int(0.35 * intensity))
    if score <= 25:
        return max(10, int(0.5 * intensity))
    return min(100, int(1.3 * intensity)) if score >= 70 else intensity


def humanize(docs: DataFrame, intensity: int = 60, seed: int = 0, max_change: float = 0.4, passes: int = 4, profile: str = "web", lexicon: dict | None = None) -> DataFrame:
    """The rewrite of each text that the detector takes least for a machine's: doc_id, rewritten, changes, change_ratio,
    before, after, level.

    A text becomes several variants: its typography alone, one pass at its adaptive intensity, and up to `passes` more, each
    on the one before; all are scored by the same expressions in one plan. A variant that changes more than max_change of
    the words is out; so is one that scores higher than the text by over 0.02 (the typography alone always stays). Of
    equal scores the least changed wins. An empty text stays as it is."""
    from textloom.operators.detector import OPERATORS

    base = typeset(docs.select("doc_id", "text"), profile).join(docs.select("doc_id", F.col("text").alias("before_text"), "lang"), "doc_id")
    scores = OPERATORS["detect"].apply(docs.select("doc_id", "text", "lang")).select("doc_id", F.when(F.col("verdict") == "unknown", F.lit(0.5)).otherwise(F.col("ai_probability")).alias("before"))
    whole = base.join(scores, "doc_id").select("doc_id", "before_text", "typeset", "lang", "before")

    def run(batches):
        for batch in batches:
            rows = []
            for i, text, clean, lang, before in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                level, now, log = adaptive(intensity, 100 * before), clean or "", []
                rows.append((i, 0, now, [], change_ratio(text or "", now), lang, before, level))
                for k in range(1, passes + 2 if level else 1):
                    now, more = rewrite(now, (lang or "en").lower()[:2], level, seed + k - 1, lexicon, i)
                    log = log + [f"{a}: {b} -> {c}" for a, b, c in more]
                    if not more:
                        break
                    rows.append((i, k, now, log, change_ratio(text or "", now), lang, before, level))
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.list_(pa.string()), pa.float64(), pa.string(), pa.float64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in enumerate(kinds)], names=["doc_id", "k", "text", "changes", "change_ratio", "lang", "before", "level"])

    variants = whole.mapInArrow(run, "doc_id long, k long, text string, changes array<string>, change_ratio double, lang string, before double, level long")
    keyed = variants.withColumn("id", F.struct("doc_id", "k"))
    told = OPERATORS["detect"]
    scored = Operator(told.layers, ["verdict", "ai_probability"], key="id", extra=["text", "lang"]).apply(keyed).select("id", F.when(F.col("verdict") == "unknown", F.lit(0.5)).otherwise(F.col("ai_probability")).alias("after"))
    both = keyed.join(scored, "id").where(f"k = 0 or (change_ratio <= {max_change} and after <= before + 0.02)")
    best = F.row_number().over(Window.partitionBy("doc_id").orderBy("after", "change_ratio", "k"))
    return both.withColumn("n", best).where("n = 1").select("doc_id", F.col("text").alias("rewritten"), "changes", "change_ratio", "before", "after", "level")


OPERATORS = {"typography_web": typography("web"), "typography_formal": typography("formal")}
