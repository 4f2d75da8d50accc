"""The style detector: sixteen measures of a text, weighed by its domain into a probability, a confidence and a verdict.

Everything is worked out of one row, by expressions or, all measures together, over Arrow batches: no text is shuffled, and
streams take it as tables do. Measures enter the sum rounded to four digits, so that two engines agree on verdicts. Without a language pack the two measures that need stop
words are neutral (0.5); `with_packs` adds the lists of a pack to a text by its language, where there is one.
"""

from __future__ import annotations

import functools
import re
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.functions import lexicon, scoring, trigrams
from textloom.functions.dialect import WS, Arrow, Keep, Operator, Spark, column, indexed, rounded
from textloom.operators import analysis, style
from textloom.operators.analysis import INVISIBLE, clamp, lengths, moments, sentences, squares, tokens, trimmed
from textloom.operators.style import MEASURE_MARKS, bare, runs

#: The measures in order with their weights, what domains add to them, and how far none may fall.
WEIGHTS = {
    "entropy": 0.04, "burstiness": 0.14, "vocabulary": 0.02, "stylometry": 0.10, "pattern": 0.19, "punctuation": 0.005, "grammar": 0.03, "opening": 0.03,
    "readability": 0.005, "rhythm": 0.05, "perplexity": 0.02, "discourse": 0.06, "semantic_rep": 0.02, "entity": 0.08, "voice": 0.11, "structure": 0.08,
}
DOMAINS = {
    "academic": {"grammar": 0.02, "voice": 0.01, "pattern": -0.04, "entity": -0.02, "burstiness": 0.03},
    "news": {"entity": 0.03, "discourse": -0.02, "voice": 0.02},
    "blog": {"entity": 0.02, "grammar": 0.03, "pattern": 0.03},
    "legal": {"grammar": 0.01, "voice": 0.01, "pattern": -0.06, "vocabulary": -0.03},
    "social": {"grammar": 0.04, "pattern": 0.04, "burstiness": 0.03, "discourse": 0.03},
    "code_docs": {"voice": 0.01, "pattern": -0.05, "readability": -0.02},
}
LEAST_WEIGHT = 0.005
STRONG = ["pattern", "burstiness", "stylometry", "discourse", "voice", "structure"]
TELLING = ["pattern", "burstiness", "stylometry", "voice", "entity", "grammar", "opening", "discourse"]
HUMAN_KEYS = ["entropy", "burstiness", "vocabulary", "pattern", "opening", "rhythm"]
#: Look-alike letters of other scripts and the Latin ones they stand for.
ALIKE = ("аеорсухіјѕһкмтвнёАЕОРСУХІВНКМТЅЈαορεvκΑΒΕΖΗΙΚΜΝΟΡΤΥΧ".replace("v", "ν"), "aeopcyxijshkmtbheAEOPCYXIBHKMTSJaopevkABEZHIKMNOPTYX")

#: The lists of a pack that the detector takes, as columns of a text.
PACK_LISTS = ["stop_words", "ai_connectors", "bureaucratic", "bureaucratic_phrases", "sentence_starters", "colloquial_markers"]
_NONE = "cast(array() as array<string>)"
BOTH = r"(?:^|[^\p{L}\p{N}_])both [^\n]{5,40} and [^\n]{5,40}(?: alike)?[.]"
OPEN, SHUT = r"\x01", r"\x02"


def edged(pattern: str) -> str:
    r"""A pattern with \b over text whose words stand between marks, so that edges need no look-around."""
    starts, pattern = pattern.startswith(r"\b"), pattern.removeprefix(r"\b")
    tail = ""
    for end, becomes in ((r",?\s", rf"{SHUT},?{WS}"), (r"\b", SHUT), (" ", rf"{SHUT} ")):
        if pattern.endswith(end):
            pattern, tail = pattern.removesuffix(end), becomes
            break
    inner = re.sub(r"[ '-]", lambda m: f"{SHUT}{m[0]}{OPEN}", pattern)
    return (OPEN if starts else "") + inner + tail


def _counted(d, text_name: str, pattern: str) -> str:
    if pattern.startswith(r"\bboth "):  # counts characters between its words, so it is for text without marks
        return d.count("lt", BOTH)
    return d.count(text_name, edged(pattern))


def folded(d, t: str) -> str:
    """Look-alike letters read as Latin in words that are mainly Latin."""
    frm, to = ALIKE
    n = lambda p: d.count("x", p)
    fold = f"case when {n('[A-Za-z]')} > 0 and {n(f'[{frm}]')} > 0 and {n('[A-Za-z]')} >= {n(f'[{frm}]')} then translate(x, '{frm}', '{to}') else x end"
    parts = d.split(d.replace(t, f"({WS}+)", "\x1f$1\x1f"), r"\x1F")
    return f"case when {d.matches(t, '[Ѐ-ӿͰ-Ͽ]')} then {d.join(d.map(parts, 'x', fold), '')} else {t} end"


def sniffed(d, t: str, whole: bool = False) -> str:
    first = t if whole else f"substring({t}, 1, 4000)"
    return f"case when {d.count(first, '[Ѐ-ӿ]')} > {d.count(first, '[A-Za-z]')} then case when {d.matches(first, '[іїєґІЇЄҐ]')} then 'uk' else 'ru' end else 'en' end"


def _base(d, also: str = "") -> list[dict]:
    return [
        {"a": d.replace("coalesce(text, '')", INVISIBLE, "")},
        {"t": folded(d, "a")},
        {"lang": f"case when coalesce(lang, '') in ('', 'auto') then {sniffed(d, 't', also in scoring.SNIFF_WHOLE)} else substring(lower(lang), 1, 2) end", "lt": "lower(t)", "s": sentences(d, "t"), "w1": tokens(d, "t")},
        {"mt": d.replace(d.replace("lt", r"[\x01\x02]", " "), r"([\p{L}\p{N}_]+)", "\x01$1\x02"), "n_words": f"1D * {d.size('w1')}", "n_sents": f"1D * {d.size('s')}", "wl": d.map("w1", "x", "lower(x)")},
    ]


def _vocabulary(d) -> list[dict]:
    return [
        {"cw": d.keep(d.map("wl", "x", bare(d, "x", MEASURE_MARKS)), "x", f"length(x) > 2 and not {d.has('stop_words', 'x')}")},
        *runs(d, "vf", "cw"),
        {"n": f"1D * {d.size('cw')}", "k": f"1D * {d.size('vf')}", "win": d.map(d.seq(f"{d.size('cw')} - 24"), "i_", f"{d.size(d.uniq(d.part('cw', 'i_', 25)))} / 25D")},
        {"ttr": "k / greatest(n, 1D)", "yule": f"case when n > 1 then 10000D * ({d.total(d.map('vf', 'x', '1D * x * x'))} - n) / (n * n) else 0D end", "hapax": f"{d.size(d.keep('vf', 'x', 'x = 1'))} / greatest(k, 1D)"},
        {"mattr": f"case when n >= 25 then {d.total('win')} / {d.size('win')} else ttr end"},
        {"raw": "0.2D * greatest(0D, 1D - (ttr - 0.3D) / 0.4D) + 0.3D * greatest(0D, 1D - (mattr - 0.6D) / 0.3D) + 0.25D * least(yule / 150D, 1D) + 0.25D * greatest(0D, 1D - hapax / 0.5D)"},
        {"vocabulary": f"case when not pack_known or n_words < 20 or n < 10 then 0.5D else {rounded(clamp('0.5D + (raw - 0.5D) * least(n / 150D, 1D)'), 4)} end"},
    ]


def _stylometry(d) -> list[dict]:
    return [
        {"len": d.keep(d.map("w1", "x", f"length({bare(d, 'x', MEASURE_MARKS)})"), "x", "x > 0"), "slen": lengths(d, "s")}, moments(d, "len"),
        {"cv": f"case when n_ > 1 and mean_ > 0 then sqrt({squares(d, 'len')} / (n_ - 1)) / mean_ else 0D end", "far": f"case when n_ > 0 then 1D * {d.size(d.keep('len', 'x', 'x > 8'))} / n_ else 0D end",
         "asl": f"case when n_sents > 0 then {d.total('slen')} / n_sents else 0D end", "stops": f"1D * {d.size(d.keep(d.map('wl', 'x', bare(d, 'x', MEASURE_MARKS)), 'x', d.has('stop_words', 'x')))} / greatest(n_words, 1D)"},
        {"raw": "0.2D * greatest(0D, (mean_ - 4D) / 3D) + 0.15D * case when n_ > 5 then greatest(0D, 1D - cv / 0.7D) else 0.5D end + 0.2D * least(far / 0.15D, 1D) + 0.25D * greatest(0D, (asl - 10D) / 15D) + 0.2D * greatest(0D, 1D - (stops - 0.25D) / 0.3D)"},
        {"stylometry": f"case when not pack_known or n_words < 20 then 0.5D else {rounded(clamp('raw'), 4)} end"},
    ]


def _by_lang(d, kind: str) -> str:
    of = lambda lang: d.words([m.lower() for m in lexicon.MARKERS[lang].get(kind, [])]) if lexicon.MARKERS[lang].get(kind) else _empty(d)
    return "case " + " ".join(f"when lang = '{x}' then {of(x)}" for x in lexicon.MARKERS if x != "en") + f" else {of('en')} end"


def _empty(d) -> str:
    return _NONE if d.name == "spark" else "CAST([] AS VARCHAR[])"


def _occurrences(d, markers: str) -> str:
    return d.total(d.map(markers, "m", "(length(lt) - length(replace(lt, m, ''))) / length(m)"))


def _any_hedge(d) -> str:
    """One search for all patterns: most texts hold none, and are spared a search for each."""
    both = next(p for p in lexicon.HEDGING if p.startswith(r"\bboth "))
    return d.matches("mt", "|".join(f"(?:{edged(p)})" for p in lexicon.HEDGING if p != both)) + f" or {_counted(d, 'mt', both)} > 0"


def _pattern(d) -> list[dict]:
    starters = rf"^(?:{'|'.join(lexicon.FORMAL_STARTERS)})"
    first = d.replace(f"lower({d.join(d.part(tokens(d, 'y'), 0, 3), ' ')})", "[.,;:]+$", "")
    more = d.union("ai_connectors", d.keep("sentence_starters", "m", "contains(m, ' ')"))
    return [
        {"adv": _by_lang(d, "adverbs"), "adj": _by_lang(d, "adjectives"), "verb": _by_lang(d, "verbs"), "conn": d.union(_by_lang(d, "connectors"), "ai_connectors"), "phr0": _by_lang(d, "phrases")},
        {"bur": d.keep("bureaucratic", "x", f"not contains(x, ' ') and length(x) >= 5 and not {d.has('adv', 'x')} and not {d.has('adj', 'x')} and not {d.has('verb', 'x')} and not {d.has('conn', 'x')}"),
         "phr": d.union("phr0", d.union(d.keep("bureaucratic", "x", "contains(x, ' ')"), "bureaucratic_phrases"))},
        {"dens": f"(1.5D * {_occurrences(d, 'adv')} + 1.3D * {_occurrences(d, 'adj')} + 1.5D * {_occurrences(d, 'verb')} + 2D * {_occurrences(d, 'conn')} + 1.5D * {_occurrences(d, 'bur')} + 3D * {_occurrences(d, 'phr')}) / greatest(n_words, 1D)",
         "present": f"1D * {d.size(d.keep('conn', 'm', 'contains(lt, m)'))}", "f3": d.map("s", "y", first),
         "hedges": f"case when {_any_hedge(d)} then 1D * ({' + '.join(_counted(d, 'mt', p) for p in lexicon.HEDGING)}) else 0D end", "enums": "1D * (" + " + ".join(_counted(d, "mt", p) for p in lexicon.COUNTING) + ")",
         "len": d.map(d.keep(d.map(d.split("t", r"\n"), "x", trimmed(d, "x")), "x", "x <> ''"), "x", d.count("x", r"[^\x09-\x0D\x20]+"))},
        moments(d, "len"),
        {"formal": f"1D * {d.size(d.keep('f3', 'x', f'{d.matches('x', starters)} or {d.size(d.keep(more, 'm', d.begins('x', 'm')))} > 0'))}",
         "sym": f"case when n_ >= 3 and mean_ > 0 then greatest(0D, 1D - sqrt({squares(d, 'len')} / n_) / mean_ * 2D) else 0D end", "ns": "greatest(n_sents, 1D)"},
        {"raw": "0.2D * least(dens / 0.05D, 1D) + 0.12D * least(present / ns / 0.15D, 1D) + 0.15D * least(formal / ns / 0.2D, 1D) + 0.3D * least(hedges / greatest(ns * 0.15D, 1D), 1D) + 0.1D * least(enums / 3D, 1D) + 0.13D * sym"},
        {"pattern": f"case when n_words < 20 then 0.5D else {rounded(clamp('raw'), 4)} end", "marker_density": rounded("dens", 4), "hedge_count": d.long("hedges"), "enum_count": d.long("enums")},
    ]


def _grammar(d) -> list[dict]:
    share = lambda c: f"1D * {d.size(d.keep('s', 'x', c))} / ns"
    rated = lambda x, low, by: f"case when {x} = 1 then 1D else greatest(0D, {x} - {low}D) * {by}D end"
    paragraphs = d.map(d.keep(d.map(d.split("t", r"\n\n"), "x", trimmed(d, "x")), "x", "x <> ''"), "x", d.count("x", r"[^\x09-\x0D\x20]+"))
    last = d.replace("x", f"{WS}+$", "")
    marks = [
        rated("caps", 0.9, 10), rated("ends", 0.85, 6.7), "case when opens = shuts and opens > 0 then 1D else 0D end",
        f"case when {d.matches('t', '[A-Za-z]')} then greatest(0D, 1D - short / greatest(n_words, 1D) / 0.03D) end",
        f"case when n_ > 2 and mean_ > 0 then greatest(0D, 1D - sqrt({squares(d, 'len')} / (n_ - 1)) / mean_ / 0.5D) end",
        "case when ands > 2 then least(oxford / ands / 0.3D, 1D) end", "greatest(0D, 1D - frag / 0.15D)",
        "case when n_sents > 5 then greatest(0D, 1D - loud / n_sents / 0.1D) end", "case when listed >= 3 then 0.8D end",
    ]
    return [
        {"ns": "greatest(n_sents, 1D)", "len": paragraphs}, moments(d, "len"),
        {"caps": share(d.matches("x", r"^\p{Lu}")), "ends": share(d.matches(last, "[.!?…]$")), "frag": share(f"{d.count('x', r'[^\x09-\x0D\x20]+')} < 4"),
         "opens": d.count("t", r"\("), "shuts": d.count("t", r"\)"), "short": f"1D * {d.count('mt', rf"{SHUT}'{OPEN}(?:t|s|re|ve|ll|d|m){SHUT}")}", "oxford": f"1D * {d.count('mt', rf',{WS}+{OPEN}and{SHUT}')}",
         "ands": f"1D * {d.count('mt', rf'{OPEN}and{SHUT}')}", "loud": f"1D * {d.count('t', r'[!?]{2,}|\.{3,}')}", "listed": f"{d.count('t', rf'(?m)^{WS}*[-•*]{WS}')} + {d.count('t', rf'(?m)^{WS}*[0-9]+[.)]{WS}')}"},
        {f"g{k}": x for k, x in enumerate(marks)},
        {"raw": "(" + " + ".join(f"coalesce(g{k}, 0D)" for k in range(9)) + ") / (" + " + ".join(f"case when g{k} is null then 0D else 1D end" for k in range(9)) + ")"},
        {"grammar": f"case when n_sents < 3 then 0.5D else {rounded(clamp('0.5D + (raw - 0.5D) * 0.5D'), 4)} end"},
    ]


def _trigrams(d) -> list[dict]:
    """How well the text's own character trigrams foretell its sentences, and the frequencies of ordinary text the whole."""
    return [{"s2": d.map("s", "x", "lower(x)")}, {"perplexity": Arrow(trigrams.perplexity, ["lt", "s2", "lang"])}]


def _member(d, words: list[str], x: str = "x") -> str:
    return d.among(x, words)


def _entity(d) -> list[dict]:
    of = lambda words: f"{d.size(d.keep('wl', 'x', _member(d, words)))}"
    phrase = lambda ms: " + ".join(f"(length(lt) - length(replace(lt, {d.lit(m)}, ''))) / {len(m)}D" for m in ms)
    digit = "[0-9]"
    nums = rf"{OPEN}{digit}{{1,2}}{SHUT}(?:\.{OPEN}{digit}+{SHUT})?|\${OPEN}{digit}+|{OPEN}{digit}{{4}}{SHUT}|{OPEN}{digit}+{SHUT}%"
    named = f"<k> > 0 and {d.matches('<w>', r'^\p{Lu}\p{L}+$')} and not {d.matches(d.at('w1', '<k> - 1'), r'[.!?:\"]$')}"
    return [
        {"generic": f"1D * {of(lexicon.GENERIC)} + {phrase(lexicon.GENERIC_PHRASES)}", "numbers": f"1D * {d.count('mt', nums)}", "names": d.total(indexed(d, "w1", f"case when {named} then 1 else 0 end")),
         "mine": f"1D * {of(lexicon.PERSONAL)}", "hedged": f"1D * {of(lexicon.HEDGES)} + {phrase([h for h in lexicon.HEDGES if ' ' in h])}", "z": "greatest(n_words, 1D)"},
        {"raw": "(least(generic / z / 0.03D, 1D) + greatest(0D, 1D - (numbers + names) / z / 0.08D) + greatest(0D, 1D - mine / z / 0.04D) + least(hedged / z / 0.02D, 1D)) / 4D"},
        {"entity": f"case when n_words < 20 then 0.5D else {rounded(clamp('raw'), 4)} end"},
    ]


def _domain(d) -> list[dict]:
    n = lambda words, x="x": d.size(d.keep("wl", "x", _member(d, words, x)))
    times = lambda m: f"(length(t) - length(replace(t, {d.lit(m)}, ''))) / {len(m)}D"
    lines = d.keep(d.split("t", r"\n"), "x", f"{trimmed(d, 'x')} <> ''")
    agency = d.matches("t", r"(?:^|[^\p{L}\p{N}_])(?:REUTERS|AP|AFP|BBC|CNN)(?:[^\p{L}\p{N}_]|$)")
    return [
        {"lines": lines, "academic": n(lexicon.ACADEMIC, d.replace("x", "^[.,;:]+|[.,;:]+$", "")), "legal": n(lexicon.LEGAL), "chatty": n(lexicon.INFORMAL), "diary": n(lexicon.DIARY)},
        {"per_line": f"case when {d.size('lines')} > 0 then {d.total(d.map('lines', 'x', d.count('x', r'[^\x09-\x0D\x20]+')))} / {d.size('lines')} else 50D end", "z": "greatest(n_words, 1D)"},
        {"domain": f"""case when academic / z > 0.02D then 'academic' when legal >= 2 then 'legal'
          when {times('```')} >= 2 or {times('`')} > 5 or (contains(lt, 'function') and contains(lt, 'return')) or (contains(lt, 'class ') and contains(lt, 'def ')) then 'code_docs'
          when chatty >= 1 or {times('!')} > 3 or contains(t, '😂') or contains(t, '🤣') then 'social'
          when {agency} or (({times('"')} >= 4 or {times('«')} >= 2) and per_line < 30 and {d.size('lines')} > 3) then 'news'
          when diary / z > 0.03D then 'blog' else 'general' end"""},
    ]


def weights_of(domain: str) -> dict[str, float]:
    """Weights of the measures in a domain, that sum to 1."""
    raw = {m: max(LEAST_WEIGHT, w + DOMAINS[domain][m]) if m in DOMAINS.get(domain, {}) else w for m, w in WEIGHTS.items()}
    return {m: w / sum(raw.values()) for m, w in raw.items()}


def _ensemble(d) -> list[dict]:
    weighed = lambda domain: " + ".join(f"{w!r}D * {m}" for m, w in weights_of(domain).items())
    count = lambda ms, c: "(" + " + ".join(f"case when {m} {c} then 1 else 0 end" for m in ms) + ")"
    squared = " + ".join(f"({m} - mid) * ({m} - mid)" for m in WEIGHTS)
    every = "array(" if d.name == "spark" else "["
    shut = ")" if d.name == "spark" else "]"
    named = every + ", ".join(d.struct(low=f"-1D * {m}", at=str(k), m=f"'{m}'") for k, m in enumerate(WEIGHTS)) + shut
    return [
        {"weighted": "case " + " ".join(f"when domain = '{x}' then {weighed(x)}" for x in DOMAINS) + f" else {weighed('general')} end",
         "strong": "(" + " + ".join(STRONG) + f") / {len(STRONG)}D", "votes": f"{count(WEIGHTS, '>= 0.55')} / {len(WEIGHTS)}D", "mid": "(" + " + ".join(WEIGHTS) + f") / {len(WEIGHTS)}D",
         "agree_high": count(WEIGHTS, ">= 0.55"), "leaning": count(TELLING, "> 0.55"), "sorted_": d.sort(named)},
        {"strong": clamp("case when strong > 0.55 then 0.5D + (strong - 0.5D) * 1.8D when strong < 0.35 then 0.5D + (strong - 0.5D) * 1.5D else strong end"),
         "votes": clamp("case when votes > 0.6 or votes < 0.4 then 0.5D + (votes - 0.5D) * 1.5D else votes end"), "spread": f"sqrt(({squared}) / {len(WEIGHTS) - 1}D)",
         "high": d.keep("sorted_", "x", "x.low <= -0.6"), "low": d.part(d.keep("sorted_", "x", "x.low > -0.3"), 0, 3)},
        {"raw": clamp("0.4D * weighted + 0.4D * strong + 0.2D * votes")},
        {"prob": "1D / (1D + exp(-5D * (raw - 0.45D)))"},
        {"prob": rounded("case when n_words < 50 then 0.5D + (prob - 0.5D) * n_words / 50D else prob end", 4)},
        {"sure": rounded(f"least(1D, least(n_words / 100D, 1D) * 0.35D + (1D - spread) * 0.2D + abs(prob - 0.5D) * 0.6D + case when prob > 0.5 then agree_high else {len(WEIGHTS)} - agree_high end / {len(WEIGHTS)}D * 0.25D)", 4), "ok": "ok_" if d.name == "spark" else f"length({trimmed(d, 't')}) >= 50", "many": "n_sents >= 2"},
        {
            "verdict": "case when not ok or not many then 'unknown' when prob > 0.6 or (prob > 0.42 and leaning >= 4) or (prob > 0.38 and leaning >= 5) then 'ai' when prob > 0.32 then 'mixed' else 'human' end",
            "ai_probability": "case when ok and many then prob else 0D end", "confidence": "case when not ok then 0D when not many then 0.1D else sure end",
            "domain": "case when ok and many then domain else 'general' end", "word_count": d.long("case when ok then n_words else 0 end"), "sentence_count": d.long("case when ok then n_sents else 0 end"),
            "explanations": f"case when not ok then 'meta.too_short' when not many then 'meta.too_few_sentences' else {d.join(d.chain(d.map('high', 'x', "concat('ai.', x.m)"), d.map(d.keep('low', 'x', _member(d, HUMAN_KEYS, 'x.m')), 'x', "concat('human.', x.m)")), ' ')} end",
        },
    ]


_MEASURES = [
    (style._entropy, "entropy"), (analysis._burstiness, "burstiness"), (_vocabulary, "vocabulary"), (_stylometry, "stylometry"), (_pattern, "pattern"), (analysis._punctuation, "punctuation"), (_grammar, "grammar"), (analysis._opening, "opening"),
    (analysis._tiles, "readability"), (analysis._rhythm, "rhythm"), (_trigrams, "perplexity"), (style._discourse, "discourse"), (style._repetition, "semantic_rep"), (_entity, "entity"), (style._voice, "voice"), (style._structure, "structure"), (_domain, "domain"),
]
_SHARED = ["lang", "t", "lt", "mt", "s", "w1", "wl", "n_words", "n_sents", "pack_known", *PACK_LISTS]


def _no_pack(d) -> dict:
    return {"pack_known": "false"} | {c: _empty(d) for c in PACK_LISTS}


@functools.cache
def rules() -> scoring.Rules:
    return scoring.Rules(lexicon, style, analysis, ALIKE, BOTH, edged)


def _scored(packs: bool, kept: list[str], also: str = "") -> list[dict]:
    """All measures, the domain and what the ensemble looks at, from one pass over the texts; with them what `also` names."""
    given = ["text", "lang", *(["pack_known", *PACK_LISTS] if packs else [])]
    names = [*WEIGHTS, "domain", "lang", "n_words", "n_sents", *(x for x, _ in scoring.ALSO[also])]
    return [{"scores_": Arrow(functools.partial(scoring.score, rules(), also=also), given, scoring.type_of(also))}, {c: f"scores_.{c}" for c in names} | {"ok_": "scores_.ok"}, Keep([*names, "ok_", *kept])]


def layered(measures: list, packs: bool = False, kept: list[str] = (), more=None, also: str = ""):
    """Layers that share one split of the text, drop what a measure leaves behind, and end in the measures' columns.

    Spark takes all measures together from Arrow batches, and with them what `also` names. For DuckDB, which copies a list for each element that looks into
    it, the trigram measure is a column of the source."""

    def layers(d) -> list[dict]:
        if d.name == "spark" and measures is _MEASURES:
            return [*_scored(packs, kept, also), *(more(d) if more else [])]
        out, held = [*([] if packs else [_no_pack(d)]), *_base(d, also)], []
        given = ["perplexity"] if d.name == "duckdb" and any(m is _trigrams for m, _ in measures) else []
        for measure, name in measures:
            for layer in [] if given and measure is _trigrams else measure(d):
                if left := {k: v for k, v in layer.items() if k not in ("t", "s", "lt")}:
                    out.append({name if k == "readability_consistency" else k: v for k, v in left.items()})
            if name not in given:
                held += [name, *(("marker_density", "hedge_count", "enum_count") if name == "pattern" else ())]
            out.append(Keep([*_SHARED, *given, *held, *kept]))
        return out + (more(d) if more else [])

    return layers


def trigram_sql(source: str = "documents", also: str = "") -> str:
    """The trigram measure as joins of counts: doc_id, perplexity."""
    base = Operator(lambda d: _base(d, also), ["lt", "s", "lang"], extra=["text", "lang"]).sql(source)
    table = lambda t: "VALUES " + ", ".join(f"('{k}', CAST({v} AS DOUBLE))" for k, v in t.items())
    rare = trigrams.RARE
    grams = "ch || lead(ch) OVER w || lead(ch, 2) OVER w"
    return f"""
WITH b AS ({base}),
en(g, f) AS ({table(lexicon.TRIGRAMS_EN)}), ru(g, f) AS ({table(lexicon.TRIGRAMS_RU)}),
c AS (SELECT doc_id, unnest(string_split(lt, '')) AS ch, unnest(range(0, len(string_split(lt, '')))) AS k FROM b),
t AS (SELECT doc_id, g, count(*) AS n FROM (SELECT doc_id, {grams} AS g FROM c WINDOW w AS (PARTITION BY doc_id ORDER BY k)) WHERE g IS NOT NULL GROUP BY ALL),
p AS (SELECT doc_id, substr(g, 1, 2) AS h, sum(n) AS m FROM t GROUP BY ALL),
v AS (SELECT doc_id, count(*) AS v FROM t GROUP BY ALL),
s AS (SELECT doc_id, unnest(s) AS s, unnest(range(0, len(s))) AS i FROM b),
sc AS (SELECT doc_id, i, unnest(string_split(lower(s), '')) AS ch, unnest(range(0, len(string_split(lower(s), '')))) AS k FROM s WHERE length(s) >= 5),
sg AS (SELECT doc_id, i, g, substr(g, 1, 2) AS h FROM (SELECT doc_id, i, {grams} AS g FROM sc WINDOW w AS (PARTITION BY doc_id, i ORDER BY k)) WHERE g IS NOT NULL),
e AS (SELECT sg.doc_id, i, exp(-avg(ln((coalesce(n, 0) + 1) / (m + v + 1)))) AS x FROM sg JOIN p USING (doc_id, h) JOIN v ON v.doc_id = sg.doc_id LEFT JOIN t ON t.doc_id = sg.doc_id AND t.g = sg.g GROUP BY sg.doc_id, i),
a AS (SELECT doc_id, count(*) AS k, avg(x) AS mid, stddev_samp(x) / avg(x) AS cv FROM e GROUP BY doc_id),
x AS (SELECT t.doc_id, exp(-sum(n * ln(CASE WHEN lang IN ('ru', 'uk') THEN coalesce(ru.f, {rare['ru']:.20f}) ELSE coalesce(en.f, {rare['en']:.20f}) END)) / sum(n)) AS xp
  FROM t JOIN b USING (doc_id) LEFT JOIN en ON en.g = t.g LEFT JOIN ru ON ru.g = t.g GROUP BY t.doc_id),
u AS (SELECT b.doc_id, len(b.s) AS sentences, k, mid, cv, CASE WHEN lang IN ('ru', 'uk') THEN 14.2 ELSE 12.5 END AS usual, CASE WHEN length(lt) >= 10 THEN xp END AS xp FROM b LEFT JOIN a USING (doc_id) LEFT JOIN x USING (doc_id))
SELECT doc_id, CASE WHEN sentences < 4 OR coalesce(k, 0) < 3 THEN CAST(0.5 AS DOUBLE) ELSE floor(CAST(greatest(0, least(1, 0.35 * greatest(0, 1 - (mid - 3) / 15)
  + 0.35 * greatest(0, 1 - cv / 0.4) + 0.3 * greatest(0, 1 - abs(coalesce(xp, usual) - usual) / usual / 0.5))) AS DOUBLE) * 10000 + 0.5) / 10000 END AS perplexity FROM u
"""


@dataclass
class _Detector(Operator):
    """Its SQL takes the trigram measure from a query of its own."""

    also: str = ""

    def sql(self, source: str | None = None) -> str:
        inner = Operator(self.layers, self.out, key=self.key, extra=[*self.extra, "perplexity"])
        return inner.sql(f"(SELECT d.*, p.perplexity FROM {source or self.source} d JOIN ({trigram_sql(source or self.source, self.also)}) p USING (doc_id))")


_VERDICT = ["verdict", "ai_probability", "confidence", "domain", "word_count", "sentence_count", "lang", "explanations"]
_PACKED = ["text", "lang", "pack_known", *PACK_LISTS]


def _single(measure, name: str, *more: str) -> Operator:
    return Operator(layered([(measure, name)]), [name, *more], extra=["text", "lang"])


def _markers(d) -> list[dict]:
    """Occurrences of the stock words and phrases of a text's language, each counted on its own, by kind."""
    kinds = ["adverbs", "adjectives", "verbs", "connectors", "phrases"]
    weights = {"adverbs": 1.5, "adjectives": 1.3, "verbs": 1.5, "connectors": 2, "phrases": 3}
    return [
        *_base(d), {f"m_{k}": _by_lang(d, k) for k in kinds}, {f"n_{k}": _occurrences(d, f"m_{k}") for k in kinds},
        {k: d.long(f"n_{k}") for k in kinds} | {"density": rounded(f"case when n_words > 0 then ({' + '.join(f'{w}D * n_{k}' for k, w in weights.items())}) / n_words else 0D end", 4)},
    ]


def _fold(d) -> list[dict]:
    """Look-alike letters in mainly Latin words read as Latin, invisible marks gone."""
    return [
        {"raw": "coalesce(text, '')"}, {"a": d.replace("raw", INVISIBLE, "")}, {"t": folded(d, "a")},
        {"folded_md5": "md5(t)", "changed": "t <> raw", "lang_sniff": sniffed(d, "t")},
    ]


OPERATORS = {
    "anti_evasion_fold": Operator(_fold, ["folded_md5", "changed", "lang_sniff"], extra=["text"]),
    "marker_counts": Operator(_markers, ["adverbs", "adjectives", "verbs", "connectors", "phrases", "density"], extra=["text", "lang"]),
    "metric_pattern": _single(_pattern, "pattern", "marker_density", "hedge_count", "enum_count"),
    "metric_grammar": _single(_grammar, "grammar"),
    "metric_perplexity": _Detector(layered([(_trigrams, "perplexity")]), ["perplexity"], extra=["text", "lang"]),
    "metric_entity": _single(_entity, "entity"),
    "text_domain": _single(_domain, "domain"),
    "detect": _Detector(layered(_MEASURES, more=_ensemble), [*_VERDICT, *WEIGHTS], extra=["text", "lang"]),
}
WITH_PACKS = {
    "metric_vocabulary": Operator(layered([(_vocabulary, "vocabulary")], packs=True), ["vocabulary"], extra=_PACKED),
    "metric_stylometry": Operator(layered([(_stylometry, "stylometry")], packs=True), ["stylometry"], extra=_PACKED),
    "detect_with_packs": _Detector(layered(_MEASURES, packs=True, more=_ensemble), [*_VERDICT, *WEIGHTS], extra=_PACKED),
}


def block_probability(docs: DataFrame) -> DataFrame:
    """ai_probability beside the columns doc_id (of any type), text and lang; 0 where the verdict is unknown."""
    out = docs.withColumn("text_", F.col("text"))
    for layer in layered(_MEASURES, kept=["text_"], more=_ensemble)(Spark()):
        out = out.select("doc_id", *layer) if isinstance(layer, Keep) else out.withColumns({c: column(x) for c, x in layer.items()})
    return out.select("doc_id", F.col("text_").alias("text"), "ai_probability")
