"""Per-document analysis: statistics, readability, uniqueness, sentiment, mechanics, style metrics, hidden characters.

Every operator takes null text as empty and gives finite numbers for empty text.
"""

from __future__ import annotations

from textloom.functions.dialect import WS, Operator, indexed, rounded

T2 = r"\p{L}[\p{L}\p{N}'’-]*"
T3 = r"[\p{L}\p{N}][\p{L}\p{N}'’\-]*"
T4U = r"[\p{L}\p{N}_]+"
T4 = r"[\p{L}\p{N}]+"
T5A = r"\p{L}[\p{L}\p{N}_]*"
T5B = r"\p{L}[\p{L}\p{N}_]*|\p{N}+"
T6 = r"[\p{L}']+"

#: Abbreviations that do not end a sentence.
ABBREVIATIONS = "mr|mrs|ms|dr|prof|sr|jr|inc|ltd|corp|etc|vs|approx|no|vol|fig|e\\.g|i\\.e|см|напр|т\\.д|т\\.п|т\\.е"
#: Vowels by language.
VOWELS = {"en": "aeiouy", "de": "aeiouyäöü", "fr": "aeiouyàâéèêëïîôùûüÿæœ", "es": "aeiouáéíóúü"}
LATIN_VOWELS, CYRILLIC_VOWELS = "aeiouyàâäéèêëïîôöùûüÿãõáíóúæœ", "аеёиоуыэюяіїєґ"
#: Words that open a sentence with its subject.
SUBJECTS = "i he she it they we you the this я он она оно они мы вы это эти він вона воно вони ми ви це ці".split()
#: Opinion words; the Cyrillic ones of four letters and more are stems.
POSITIVE = """good great excellent amazing wonderful fantastic love loved like liked best happy awesome perfect nice beautiful brilliant
enjoy enjoyed pleased delighted superb positive success successful win winning gain benefit helpful recommend recommended impressive
outstanding favorite glad grateful thanks thank easy fast clear strong reliable smooth fun cool incredible remarkable joy
хорош отличн прекрасн замечательн люблю нравится лучш счастл супер идеальн красив радост спасибо благодар успех удобн быстр полезн
рекоменд восхитительн приятн позитивн выгодн надёжн надежн классн крут великолепн достойн""".split()
NEGATIVE = """bad terrible awful horrible hate hated worst sad poor ugly disappointing disappointed fail failure failed wrong broken bug
buggy slow hard difficult confusing annoying useless waste problem problems issue issues error errors negative weak boring nasty pain
painful angry frustrating frustrated lousy mediocre inferior unreliable crash crashes dislike regret scam garbage trash
плох ужасн отвратительн ненавиж худш груст слаб некрасив разочарова провал ошибк сломан медленн сложн запутан раздража бесполезн
проблем скучн боль зл ужас отстой мусор кошмар жаль негативн ненадёжн ненадежн бесит""".split()
NEGATIONS = "not no never without don't doesn't didn't isn't aren't wasn't won't can't cannot не нет ни без нельзя".split()
INTENSIFIERS = "very really so extremely absolutely totally incredibly super очень реально крайне абсолютно совершенно ужасно супер слишком".split()
#: Characters without width, and other marks that hide in text.
ZERO_WIDTH = r"[\x{200B}-\x{200F}\x{2060}-\x{2064}\x{FEFF}\x{00AD}\x{034F}\x{061C}\x{180E}]"
INVISIBLE = r"[\x{00AD}\x{200B}-\x{200F}\x{202A}-\x{202E}\x{2060}-\x{2064}\x{2066}-\x{206F}\x{FEFF}]"
OTHER_FORMAT = r"[\x{0600}-\x{0605}\x{06DD}\x{070F}\x{202A}-\x{202E}\x{2066}-\x{206F}\x{FFF9}-\x{FFFB}]"
#: Word endings that are common anyway.
COMMON_ENDINGS = "ed ly ng er on al le es ts ть ий ый ет на".split()


def text(d) -> dict:
    return {"t": "coalesce(text, '')"}


def trimmed(d, x: str) -> str:
    return d.replace(x, rf"^{WS}+|{WS}+$", "")


def tokens(d, t: str) -> str:
    """T1: what white space parts."""
    return d.keep(d.split(t, rf"{WS}+"), "x", "x <> ''")


def sentences(d, t: str) -> str:
    """Breaks after . ! ? … before white space and at newlines, not after abbreviations and initials; letterless ones go."""
    for _ in range(2):  # the second time for initials that follow each other
        t = d.replace(t, rf"(?i)(^|[\x09-\x0D\x20\x1E(«\"'])({ABBREVIATIONS}|[\p{{Lu}}\p{{Ll}}\p{{Lt}}])\.{WS}+", "$1$2.\x1e")
    t = d.replace(t, rf"([.!?…]){WS}+", "$1\x1f")
    t = d.replace(t, r"\n+", "\x1f")
    parts = d.map(d.split(t, r"\x1F"), "x", trimmed(d, "replace(x, '\x1e', ' ')"))
    return d.keep(parts, "x", f"length(x) >= 2 and {d.matches('x', r'[\p{L}]')}")


def lengths(d, s: str) -> str:
    return d.map(s, "x", d.count("x", rf"[^\x09-\x0D\x20]+"))


def moments(d, a: str) -> dict:
    """Number, mean and sums of squares about the mean of a list."""
    return {"n_": d.size(a), "mean_": f"case when {d.size(a)} > 0 then {d.total(a)} / {d.size(a)} else 0D end"}


def squares(d, a: str) -> str:
    return d.total(d.map(a, "x", "(x - mean_) * (x - mean_)"))


def clamp(x: str) -> str:
    return f"greatest(0D, least(1D, {x}))"


def _statistics(d):
    return [
        text(d),
        {"w": d.map(d.extract("t", T2), "x", "lower(x)"), "s": sentences(d, "t"), "p": d.size(d.keep(d.map(d.split("t", rf"\n{WS}*\n"), "x", trimmed(d, "x")), "x", "x <> ''"))},
        {"words": d.long(d.size("w")), "lens": d.map("s", "x", d.count("x", T2)), "chars": d.long("length(t)"), "chars_no_spaces": d.long(d.count("t", r"[^\x09-\x0D\x20]"))},
        {"unique_words": d.long(d.size(d.uniq("w"))), "sentences": d.long(f"case when {d.size('s')} > 0 then {d.size('s')} when words > 0 then 1 else 0 end"), "paragraphs": d.long("p"), "longest_sentence_words": d.long(f"coalesce({d.most('lens')}, 0)"), "letters": d.total(d.map("w", "x", "length(x)"))},
        {
            "avg_word_length": rounded("case when words > 0 then letters / words else 0D end", 2),
            "avg_sentence_length": rounded("case when sentences > 0 then 1D * words / sentences else 0D end", 2),
            "lexical_diversity": rounded("case when words > 0 then 1D * unique_words / words else 0D end", 2),
            "long_word_ratio": rounded(f"case when words > 0 then 1D * {d.size(d.keep('w', 'x', 'length(x) >= 7'))} / words else 0D end", 2),
            "reading_time_sec": d.long(rounded("words / 200D * 60D", 0)),
            "speaking_time_sec": d.long(rounded("words / 130D * 60D", 0)),
        },
    ]


def syllables(d, w: str, lang: str) -> str:
    """Of one lower-case word of letters: groups of vowels, at least one; an English final e is silent."""
    if lang == "cyrillic":
        return f"greatest({d.count(w, f'[{CYRILLIC_VOWELS}]')}, 1)"
    n = d.count(w, f"[{VOWELS.get(lang, LATIN_VOWELS)}]+")
    if lang == "en":
        n = f"({n} - case when {w} like '%e' and {n} > 1 then 1 else 0 end)"
    return f"greatest({n}, 1)"


def _readability(d):
    of = lambda lang: d.map("bare", "x", f"case when x = '' then 0 else {syllables(d, 'x', lang)} end")
    by_lang = " ".join(f"when lang = '{x}' then {of(x)}" for x in VOWELS)
    first = "substring(x, 1, 1)"
    fog = f"({first} <> upper({first}) or {first} = lower({first}))"
    per_word = lambda x: f"({x} / nw)"
    return [
        text(d),
        {"w": d.extract("t", T3), "ns": f"greatest({d.size(sentences(d, 't'))}, 1)"},
        {"bare": d.map("w", "x", d.replace("lower(x)", r"^[^\p{L}]+|[^\p{L}]+$", "")), "nw": f"1D * {d.size('w')}"},
        {"syl": f"case {by_lang} when lang in ('ru', 'uk', 'be', 'bg', 'mk', 'sr') then {of('cyrillic')} else {of('latin')} end"},
        {
            "letters": d.total(d.map("w", "x", d.count("x", r"\p{L}"))), "alnum": d.total(d.map("w", "x", d.count("x", r"[\p{L}\p{N}]"))),
            "n_syl": d.total("syl"), "hard": f"1D * {d.size(d.keep('syl', 'x', 'x >= 3'))}",
            "fog_hard": d.total(indexed(d, "w", f"case when {d.at('syl', '<k>')} >= 3 and {fog.replace('x,', '<w>,').replace('(x', '(<w>')} then 1 else 0 end")),
            "kinds": f"1D * {d.size(d.uniq(d.map('w', 'x', 'lower(x)')))}",
        },
        {"ok": "nw > 0", "asl": "nw / ns", "asw": "case when nw > 0 then n_syl / nw else 0D end", "z": "case when nw > 0 then nw else 1D end"},
        {
            "fre": "206.835D - 1.015D * asl - 84.6D * asw", "fk": "0.39D * asl + 11.8D * asw - 15.59D",
            "cl": "0.0588D * (letters / z * 100D) - 0.296D * (ns / z * 100D) - 15.8D", "ari_": "4.71D * (alnum / z) + 0.5D * asl - 21.43D",
            "gf": "0.4D * (asl + fog_hard / z * 100D)", "sm": "1.043D * sqrt(hard * (30D / ns)) + 3.1291D",
        },
        {
            "flesch_reading_ease": f"case when ok then {rounded('fre', 2)} else 0D end", "flesch_kincaid_grade": f"case when ok then {rounded('fk', 2)} else 0D end",
            "coleman_liau": f"case when ok then {rounded('cl', 2)} else 0D end", "ari": f"case when ok then {rounded('ari_', 2)} else 0D end",
            "gunning_fog": f"case when ok then {rounded('gf', 2)} else 0D end", "smog": f"case when ok then {rounded('sm', 2)} else 0D end",
            "avg_syllables": f"case when ok then {rounded('asw', 3)} else 0D end", "complex_word_ratio": f"case when ok then {rounded('hard / z', 3)} else 0D end",
            "grade_level": f"case when ok then {rounded('greatest(0D, (fk + cl + ari_ + gf + sm) / 5)', 2)} else 0D end",
            "reading_level": "case when not ok then 'very difficult' when fre >= 90 then 'very easy' when fre >= 70 then 'easy' when fre >= 50 then 'medium' when fre >= 30 then 'difficult' else 'very difficult' end",
        },
    ]


def _uniqueness(d):
    ratio = lambda g: f"case when {d.size(g)} > 0 then 1D * {d.size(d.uniq(g))} / {d.size(g)} else 1D end"
    return [
        text(d),
        {"w": d.extract("lower(t)", T4U)},
        {"g2": d.grams("w", 2), "g3": d.grams("w", 3), "g4": d.grams("w", 4), "n": d.size("w"), "v": d.size(d.uniq("w"))},
        {"u2": ratio("g2"), "u3": ratio("g3"), "u4": ratio("g4"), "total_ngrams": d.long(d.size("g3"))},
        {"score": f"case when n = 0 then 1D else {rounded('0.15D * u2 + 0.25D * u3 + 0.25D * u4 + 0.2D * v / n + 0.15D * v / n', 4)} end", "ngram_diversity": rounded("u3", 4)},
    ]


def _opinion(d, x: str, words: list[str]) -> str:
    """Whether x is an opinion word or, in Cyrillic, begins with one of four letters and more."""
    stems = [w for w in words if len(w) >= 4 and any("а" <= c <= "я" or c == "ё" for c in w)]
    return f"({d.among(x, words)} or ({d.matches(x, '^[а-яё]')} and {d.matches(x, '^(?:' + '|'.join(stems) + ')')}))"


def _sentiment(d):
    before = lambda k, xs: f"coalesce({d.among(d.at('w', f'<k> - {k}'), xs)}, false)"
    weight = f"case when <k> >= 1 and {before(1, INTENSIFIERS)} then 1.5D else 1D end"
    turned = f"((<k> >= 1 and {before(1, NEGATIONS)}) or (<k> >= 2 and {before(2, NEGATIONS)}))"
    good, bad = _opinion(d, "<w>", POSITIVE), _opinion(d, "<w>", NEGATIVE)
    signed = f"case when {good} then {weight} * case when {turned} then -1D else 1D end when {bad} then {weight} * case when {turned} then 1D else -1D end else 0D end"
    return [
        text(d),
        {"w": d.extract("lower(t)", T6)},
        {"x_": indexed(d, "w", signed)},
        {"p": d.total(d.keep("x_", "x", "x > 0")), "m": f"-1D * {d.total(d.keep('x_', 'x', 'x < 0'))}", "hits": d.size(d.keep("x_", "x", "x <> 0"))},
        {"polarity": rounded("(p - m) / (p + m + 1)", 3), "positive": d.long(rounded("p", 0)), "negative": d.long(rounded("m", 0)), "subjectivity": rounded(f"least(1D, hits / greatest(8D, {d.size('w')} / 8D))", 3)},
        {"label": "case when polarity > 0.15D then 'positive' when polarity < -0.15D then 'negative' else 'neutral' end"},
    ]


def _burstiness(d):
    return [
        text(d), {"s": sentences(d, "t")}, {"len": lengths(d, "s")}, moments(d, "len"),
        {"cv": f"case when n_ > 1 and mean_ > 0 then sqrt({squares(d, 'len')} / (n_ - 1)) / mean_ else 0D end", "ext": f"case when n_ > 0 then 1D * {d.size(d.keep('len', 'x', 'x <= 5 or x >= 30'))} / n_ else 0D end"},
        {"b": "greatest(0D, 1D - (cv - 0.1D) / 0.7D) * case when mean_ < 10 then 0.7D else 1D end"},
        {"burstiness": f"case when n_ < 4 or mean_ = 0 then 0.5D else {rounded(clamp('case when ext < 0.05D then least(b + 0.07D, 1D) when ext > 0.2D then greatest(b - 0.1D, 0D) else b end'), 4)} end", "sentence_count": d.long("n_")},
    ]


def _punctuation(d):
    n = f"({d.count('t', '!')} + {d.integer_part("(length(t) - length(replace(t, '...', '')))", 3)} + {d.count('t', '…')})"
    return [text(d), {"punctuation": f"case when length(t) < 50 then 0.5D else {rounded(clamp(f'0.42D + 0.16D * greatest(0D, 1D - {n} * 1000D / length(t) / 2D)'), 4)} end"}]


def _opening(d):
    return [
        text(d), {"s": sentences(d, "t")},
        {"f": d.map("s", "x", d.replace(f"lower({d.at(tokens(d, 'x'), 0)})", r"[.,;:]+$", ""))},
        {"n": d.size("f"), "u": d.uniq("f"), "sorted_": ("sort_array(f)" if d.name == "spark" else "list_sort(f)"), "same": d.size(d.keep(indexed(d, "f", f"<k> > 0 and <w> = {d.at('f', '<k> - 1')}"), "x", "x"))},
        {"marks": d.keep(indexed(d, "sorted_", f"case when <k> = 0 or <w> <> {d.at('sorted_', '<k> - 1')} then <k> else -1 end"), "x", "x >= 0")},
        {"top": d.most(indexed(d, "marks", f"coalesce({d.at('marks', '<k> + 1')}, n) - <w>")), "subj": d.size(d.keep("f", "x", d.among("x", SUBJECTS)))},
        {"opening": f"case when n < 5 then 0.5D else {rounded(clamp(f'0.3D * greatest(0D, 1D - (1D * {d.size('u')} / n - 0.2D) / 0.6D) + 0.25D * least(1D * top / n / 0.3D, 1D) + 0.2D * least(1D * subj / n / 0.5D, 1D) + 0.25D * least(1D * same / (n - 1) / 0.15D, 1D)'), 4)} end"},
    ]


def _rhythm(d):
    band = lambda x: f"case when {x} <= 8 then 1 when {x} <= 20 then 2 else 3 end"
    nxt = d.at("len", "<k> + 1")
    return [
        text(d), {"s": sentences(d, "t")}, {"len": lengths(d, "s")}, moments(d, "len"),
        {"v": f"case when n_ > 1 then {squares(d, 'len')} / (n_ - 1) else 1D end", "lag": d.total(indexed(d, "len", f"coalesce((<w> - mean_) * ({nxt} - mean_), 0D)")), "turns": d.total(indexed(d, "len", f"case when {nxt} is not null and {band(nxt)} <> {band('<w>')} then 1 else 0 end")), "close": d.total(indexed(d, "len", f"case when abs({nxt} - <w>) <= 3 then 1 else 0 end"))},
        {"ac": "case when v = 0 then 1D when n_ > 1 then lag / (n_ - 1) / v else 0D end"},
        {"rhythm": f"case when n_ < 5 then 0.5D else {rounded(clamp('0.4D * greatest(0D, (ac + 0.1D) / 0.7D) + 0.3D * greatest(0D, 1D - (1D + turns) / n_ / 0.8D) + 0.3D * least(close / (n_ - 1) / 0.5D, 1D)'), 4)} end"},
    ]


def _tiles(d):
    """Consistency of length over tiles of three sentences."""
    letters = d.map("s", "x", d.count("x", r"[^\x09-\x0D\x20]"))
    three = lambda a: f"({d.at(a, '3 * x')} + {d.at(a, '3 * x + 1')} + {d.at(a, '3 * x + 2')})"
    return [
        text(d), {"s": sentences(d, "t")}, {"len": lengths(d, "s"), "chr": letters},
        {"tile": d.map(d.seq(d.integer_part(d.size("s"), 3)), "x", f"0.5D * {three('chr')} / {three('len')} + 0.5D * {three('len')} / 3D")},
        moments(d, "tile"),
        {"readability_consistency": f"case when {d.size('s')} < 6 or n_ < 3 then 0.5D else {rounded(clamp(f'greatest(0D, 1D - sqrt({squares(d, 'tile')} / (n_ - 1)) / mean_ / 0.2D)'), 4)} end"},
    ]


def _mechanics(d):
    first = d.at(d.extract("x", r"\p{L}"), 0)
    return [
        text(d),
        {"s": sentences(d, "t"), "w": d.map(d.extract("t", T4), "x", "lower(x)")},
        {
            "bad": f"1D * {d.size(d.keep('s', 'x', f'lower({first}) <> upper({first}) and {first} <> upper({first})'))}",
            "doubled": d.total(indexed(d, "w", f"case when <k> > 0 and length(<w>) > 1 and <w> = {d.at('w', '<k> - 1')} then 1 else 0 end")),
            "space": d.count("t", r" {2,}"), "before": d.count("t", r"[\x09-\x0D\x20][,.;:!?]"), "again": d.count("t", r",,+|;;+|::+"),
            "open_": d.count("t", r"[(\[{]"), "close_": d.count("t", r"[)\]}]"),
            "alone": d.count(d.replace(d.replace("t", rf"({WS})", "$1$1"), rf"$", " "), rf"(?:^|{WS})i(?:{WS}|[',.!?])"),
        },
        {"pen": f"case when {d.size('s')} > 0 then bad / {d.size('s')} * 25D else 0D end + least(space * 2, 10) + least(before * 2, 10) + least(again * 3, 12) + least(doubled * 3, 15) + least(abs(open_ - close_) * 3, 10) + case when lang = 'en' then least(alone * 2, 10) else 0 end"},
        {"mechanics": f"case when {trimmed(d, 't')} = '' then 100D else {rounded('greatest(0D, least(100D, 100D - pen))', 3)} end", "doubled_words": d.long("doubled"), "unbalanced": d.long("abs(open_ - close_)")},
    ]


def _diversity(d):
    return [
        text(d), {"w": d.map(d.extract("t", T4), "x", "lower(x)"), "len": d.map(sentences(d, "t"), "x", d.count("x", T4))}, moments(d, "len"),
        {"cv": f"case when n_ >= 2 and mean_ > 0 then sqrt({squares(d, 'len')} / n_) / mean_ else 0D end", "ttr": f"case when {d.size('w')} > 0 then 1D * {d.size(d.uniq('w'))} / {d.size('w')} else 0D end"},
        {"diversity": f"case when {d.size('w')} = 0 then 100D else {rounded('least(ttr / 0.7D, 1D) * 60D + least(cv / 0.5D, 1D) * 40D', 3)} end"},
        {"grade": "case when diversity >= 95 then 'A+' when diversity >= 85 then 'A' when diversity >= 75 then 'B' when diversity >= 60 then 'C' when diversity >= 40 then 'D' else 'F' end"},
    ]


def _hidden(d):
    return [
        text(d),
        {"zero_width_count": d.long(d.count("t", ZERO_WIDTH)), "a": d.replace("t", ZERO_WIDTH, "")},
        {"format_count": d.long(d.count("a", OTHER_FORMAT)), "b": d.replace("a", OTHER_FORMAT, "")},
        {"multi_space": d.long(d.count("b", r"[^\x09-\x0D\x20] {2,}[^\x09-\x0D\x20]"))},
        {"cleaned": f"case when multi_space > 5 then {d.replace('b', r' {2,}', ' ')} else b end"},
        {"types": d.long("case when zero_width_count > 0 then 1 else 0 end + case when format_count > 0 then 1 else 0 end + case when multi_space > 5 then 1 else 0 end"), "cleaned_length": d.long("length(cleaned)"), "cleaned_md5": "md5(cleaned)"},
        {"confidence": f"case when types = 0 then 0D else {rounded('least(0.3D + 0.15D * types + 0.01D * (zero_width_count + format_count), 1D)', 4)} end"},
    ]


def _green_list(d):
    word, seed = d.at("w", "<k> + 1"), d.sha32("<w>")
    step = f"case when {word} is not null and {d.sha32(f"concat(cast({seed} as varchar(20)), ':', {word})")} % 10000 < 2500 then 1 else 0 end"
    poly = "0.17087277D"
    for c in ("-0.82215223D", "1.48851587D", "-1.13520398D", "0.27886807D", "-0.18628806D", "0.09678418D", "0.37409196D", "1.00002368D"):
        poly = f"({c} + u * {poly})"
    return [
        text(d), {"w": d.extract("lower(t)", T5B)},
        {"n": d.size("w"), "green": d.long(d.total(indexed(d, "w", step)))},
        {"z": "case when n >= 30 then (green - 0.25D * (n - 1)) / sqrt(0.1875D * (n - 1)) else 0D end"},
        {"q": "abs(z / sqrt(2D))"}, {"u": "1D / (1D + q / 2D)"}, {"r": f"u * exp(-1D * q * q - 1.26551223D + u * {poly})"},
        {"green_count": "case when n >= 30 then green else 0 end", "z_score": rounded("z", 3), "p_value": f"case when n >= 30 then {rounded('0.5D * (case when z >= 0 then r else 2D - r end)', 6)} else 1D end", "flagged": "n >= 30 and z >= 4"},
    ]


def _article(d):
    """a and an before the wrong kind of sound, and what the repair changes."""
    t = d.replace("t", r"(^|[^\p{L}\p{N}_])([Aa]) ([aeioAEIO]\p{L}*)", "$1$2n $3")
    fixed = d.replace(t, r"(^|[^\p{L}\p{N}_])([Aa])n ([bcdfgjklmnpqrstvwxzBCDFGJKLMNPQRSTVWXZ]\p{L}*)", "$1$2 $3")
    return [text(d), {"fixed": fixed}, {"fixed_md5": "md5(fixed)", "changed": "fixed <> t"}]


OPERATORS = {
    "text_statistics": Operator(_statistics, "chars chars_no_spaces words unique_words sentences paragraphs avg_word_length avg_sentence_length lexical_diversity long_word_ratio reading_time_sec speaking_time_sec longest_sentence_words".split(), extra=["text"]),
    "readability": Operator(_readability, "flesch_reading_ease flesch_kincaid_grade coleman_liau ari gunning_fog smog avg_syllables complex_word_ratio grade_level reading_level".split(), extra=["text", "lang"]),
    "uniqueness": Operator(_uniqueness, "score ngram_diversity total_ngrams".split(), extra=["text"]),
    "sentiment": Operator(_sentiment, "polarity label positive negative subjectivity".split(), extra=["text"]),
    "metric_burstiness": Operator(_burstiness, "burstiness sentence_count".split(), extra=["text"]),
    "metric_punctuation": Operator(_punctuation, ["punctuation"], extra=["text"]),
    "metric_opening": Operator(_opening, ["opening"], extra=["text"]),
    "metric_rhythm": Operator(_rhythm, ["rhythm"], extra=["text"]),
    "metric_readability_consistency": Operator(_tiles, ["readability_consistency"], extra=["text"]),
    "grammar_mechanics": Operator(_mechanics, "mechanics doubled_words unbalanced".split(), extra=["text", "lang"]),
    "diversity_grade": Operator(_diversity, "diversity grade".split(), extra=["text"]),
    "watermark_hidden_characters": Operator(_hidden, "zero_width_count format_count multi_space types cleaned_length cleaned_md5 confidence".split(), extra=["text"]),
    "watermark_green_list": Operator(_green_list, "green_count z_score p_value flagged".split(), extra=["text"]),
    "article_fix": Operator(_article, "fixed_md5 changed".split(), extra=["text"]),
}
