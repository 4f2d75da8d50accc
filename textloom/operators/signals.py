"""Language, tone, kind of content, health, hidden marks with their repair, scores of sentences and of short blocks.

All but `key_phrases` and `sentence_scores` are expressions over one row. Null text is empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions import lexicon
from textloom.functions.dialect import WS, Duck, Keep, Operator, Spark, _duck_numbers, indexed, rounded
from textloom.operators import analysis, detector
from textloom.operators.analysis import COMMON_ENDINGS, OTHER_FORMAT, T2, T3, T5A, ZERO_WIDTH, clamp, sentences, text, tokens, trimmed
from textloom.operators.corpus import _STOP_SQL, STOP_WORDS

#: Letters that tell a language, with what each counts, in the order in which equal scores are decided.
LETTERS = {
    "de": {"[äöü]": 1, "ß": 3}, "fr": {"[éèêëçàùîô]": 1}, "es": {"ñ": 3, "¿": 3, "¡": 3}, "pl": {"[ąęśźżłńć]": 2},
    "pt": {"[ãõ]": 2, "ç": 1}, "it": {}, "en": {}, "tr": {"[şğı]": 3, "[çöü]": 1},
}
#: Ranges of characters of scripts.
ARABIC = r"[\x{0600}-\x{06FF}\x{0750}-\x{077F}\x{FB50}-\x{FDFF}\x{FE70}-\x{FEFF}]"
HAN = r"[\x{4E00}-\x{9FFF}\x{3400}-\x{4DBF}\x{F900}-\x{FAFF}]"
KANA = r"[\x{3040}-\x{30FF}]"
HANGUL = r"[\x{AC00}-\x{D7AF}\x{1100}-\x{11FF}\x{3130}-\x{318F}]"
CYRILLIC = r"[\x{0400}-\x{04FF}]"


def _present(d, words: list[str], t: str = "low") -> str:
    return d.size(d.keep(d.words(words), "m", f"contains({t}, m)"))


def _language(d):
    """Shares of scripts, then letters and words. Where these say too little, English; in Cyrillic, Russian."""
    best = "[{}]" if d.name == "duckdb" else "array({})"
    score = {x: " + ".join([*(f"{n} * {d.count('low', c)}" for c, n in cs.items()), f"2 * {_present(d, lexicon.LANGUAGE_WORDS[x])}"]) for x, cs in LETTERS.items()}
    ranked = best.format(", ".join(d.struct(n=f"-1 * ({score[x]})", k=str(k), c=f"'{x}'") for k, x in enumerate(LETTERS)))
    uk = f"({d.count('low', '[іїєґ]')} > 2 or {_present(d, lexicon.UKRAINIAN_WORDS)} >= 3)"
    return [
        text(d), {"p": "concat(' ', t, ' ')"},
        {"low": "lower(p)", "alpha": f"greatest(1D * {d.count('p', r'\p{L}')}, 1D)", "arabic": d.count("p", ARABIC), "han": d.count("p", HAN), "kana": d.count("p", KANA), "hangul": d.count("p", HANGUL), "cyr": d.count("p", CYRILLIC)},
        {"ukrainian": uk, "first_": d.at(d.sort(ranked), 0)},
        {"detected": f"""case when length({trimmed(d, 't')}) < 10 then 'en' when arabic / alpha > 0.3D then 'ar' when hangul / alpha > 0.3D then 'ko' when kana / alpha > 0.15D then 'ja' when han / alpha > 0.3D then 'zh'
          when cyr / alpha > 0.1D then case when ukrainian then 'uk' else 'ru' end when first_.n <= -6 then first_.c else 'en' end""", "latin_score": d.long("-1 * first_.n")},
    ]


#: Words after a form of "to be" that make a passive.
BEING = "am|is|are|was|were|be|been|being"
DONE = "done|made|built|held|kept|sent|shown|known|found|given|taken|written|paid|put|set|seen|used|based|considered"
#: Ranges of pictographs.
PICTOGRAPHS = r"[\x{00A9}\x{00AE}\x{203C}\x{2049}\x{2122}\x{2139}\x{2194}-\x{2199}\x{21A9}\x{21AA}\x{231A}\x{231B}\x{23E9}-\x{23F3}\x{25AA}\x{25AB}\x{25B6}\x{25C0}\x{2600}-\x{27BF}\x{2934}\x{2935}\x{2B05}-\x{2B07}\x{2B1B}\x{2B1C}\x{2B50}\x{2B55}\x{3030}\x{303D}\x{3297}\x{3299}\x{1F000}-\x{1FAFF}]"
KINDS = ["very_formal", "formal", "informal", "subjective", "academic", "marketing"]


def _tone_count(d, lang: str, kind: str) -> str:
    words = lexicon.TONE[lang].get(kind, [])
    plain = [w for w in words if all(c.isalnum() or c in "'’-" for c in w)]
    phrases = [w for w in words if w not in plain]
    parts = [d.size(d.keep("w", "x", d.among("x", plain)))] if plain else []
    if phrases:
        parts.append(d.total(d.map(d.words(phrases), "m", "(length(low) - length(replace(low, m, ''))) / length(m)")))
    return " + ".join(parts) or "0"


def _tone(d):
    by = lambda f: "case " + " ".join(f"when lang = '{x}' then {f(x)}" for x in lexicon.TONE if x != "en") + f" else {f('en')} end"
    person = lambda x: d.size(d.keep("w", "x", d.among("x", lexicon.PRONOUNS[x])))
    passive = d.count("edges_", rf"\x01(?:{BEING})\x02{WS}+\x01(?:[a-z0-9_]+ed|{DONE})\x02")
    scores = ["formality", "least(n_academic / greatest(words / 100D, 1D), 1D)", "least(n_marketing / greatest(words / 80D, 1D), 1D)", "1D - formality", "greatest(0D, least(0.7D - formality + subjectivity * 0.3D, 1D))", "1D - greatest(formality, subjectivity, marketing)", "greatest(0D, formality * 0.7D + (1D - subjectivity) * 0.3D)"]
    names = ["formal", "academic", "marketing", "casual", "friendly", "neutral", "professional"]
    array = "[{}]" if d.name == "duckdb" else "array({})"
    steps = [
        {"f": "formal_score / (formal_score + informal_score + 1D)"},
        {"f": "case when letters > 6 then least(f + 0.1D, 1D) when letters < 4.5 then greatest(f - 0.1D, 0D) else f end"},
        {"f": "case when contractions / words > 0.02 then greatest(f - 0.15D, 0D) else f end"},
        {"f": "case when loud / ns > 0.3 then greatest(f - 0.05D, 0D) else f end"}, {"f": "case when emoji > 0 then greatest(f - 0.1D, 0D) else f end"},
        {"f": "case when person / words > 0.05 then greatest(f - least(0.1D, person / words * 0.5D), 0D) else f end"},
        {"formality": clamp("case when passive > 0 then least(f + least(0.1D, passive / ns * 0.2D), 1D) else f end"), "subjectivity": "least(n_subjective / greatest(words / 50D, 1D), 1D)"},
    ]
    return [
        text(d), {"low": "lower(t)"},
        {"w": d.extract("low", T3), "edges_": d.replace(d.replace("low", r"[\x01\x02]", " "), "([a-z0-9_]+)", "\x01$1\x02"), "ns": f"greatest(1D * {d.size(sentences(d, 't'))}, 1D)"},
        {f"n_{k}": f"1D * ({by(lambda x, k=k: _tone_count(d, x, k))})" for k in KINDS}
        | {"nw": f"1D * {d.size('w')}", "person": f"1D * ({by(person)})", "passive": f"case when lang in ('ru', 'uk') then 0D else 1D * {passive} end", "contractions": f"1D * {d.count('t', r"\p{L}+['’]\p{L}+")}", "loud": f"1D * {d.count('t', '!')}", "emoji": f"1D * {d.count('t', PICTOGRAPHS)}"},
        {"words": "greatest(nw, 1D)", "formal_score": "3D * n_very_formal + 2D * n_formal + 2D * n_academic", "informal_score": "2D * n_informal", "letters": f"{d.total(d.map('w', 'x', 'length(x)'))} / greatest(nw, 1D)"},
        *steps, {"marketing": scores[2]},
        {"ranked": d.sort(array.format(", ".join(d.struct(v=f"-1D * ({x})", k=str(k), n=f"'{n}'") for k, (x, n) in enumerate(zip(scores, names, strict=True)))))},
        {"top_": d.at("ranked", 0), "next_": d.at("ranked", 1)},
        {
            "tone": "case when nw < 5 then 'neutral' else top_.n end", "tone_score": f"case when nw < 5 then 0D else {rounded('-1D * top_.v', 4)} end", "tone_confidence": f"case when nw < 5 then 0D else {rounded('least((next_.v - top_.v) * 2D + 0.3D, 1D)', 4)} end",
            "formality_score": f"case when nw < 5 then 0.5D else {rounded('formality', 4)} end", "subjectivity_score": f"case when nw < 5 then 0D else {rounded('subjectivity', 4)} end", "first_second_person": d.long("person"), "passive_count": d.long("passive"), "formal_marker_score": d.long("formal_score"), "informal_marker_score": d.long("informal_score"),
        },
    ]


#: Patterns of content, as the reference of their kinds states them.
CONTENT = {
    "block": r"(?s)```.*?```|~~~.*?~~~",
    "indented": r"(?m)^(?: {4}|\t).+$",
    "heading": r"(?m)^#{1,6}\s+.+$",
    "html_heading": r"(?i)<h[1-6][^>]*>.*?</h[1-6]>",
    "bullet": r"(?m)^\s*[-*•▸►]\s+.+$",
    "numbered": r"(?m)^\s*[0-9]+[.)]\s+.+$",
    "dateline": r"(?i)(?:^|\n)\s*(?:[A-Z]{2,}[\s,]+)?(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec|Январ|Феврал|Март|Апрел|Ма[йя]|Июн|Июл|Август|Сентябр|Октябр|Ноябр|Декабр)[\p{L}0-9,.\s]+[0-9]{4}",
    "quoted": r"(?i)[«\"“”']\s*[^«\"“”']{10,}[«\"“”']\s*[,—–-]\s*(?:сказал|заявил|said|told|according)",
    "step": r"(?im)(?:^|\n)\s*(?:шаг|step|этап)\s*[0-9]+|(?:^|\n)\s*(?:во-первых|во-вторых|в-третьих|firstly|secondly|thirdly)|(?:^|\n)\s*[0-9]+\.\s+(?:Install|Set up|Create|Open|Run|Configure|Add|Установ|Создай|Откр|Запуст|Настро|Добав)",
    "citation": r"\[[0-9]+\]|\([A-ZА-Я][a-zа-яёA-Za-z]+\s+et\s+al\.?\s*,?\s*[0-9]{4}\)|[A-ZА-Я][a-zа-яёA-Za-z]+\s+et\s+al\.\s*\([0-9]{4}\)|\([A-ZА-Я][a-zа-яёA-Za-z]+(?:\s*(?:&|и|,|and)\s*[A-ZА-Я][a-zа-яёA-Za-z]+)*\s*,?\s*[0-9]{4}\)|\((?:и\s*др|и\s+другие)[.,]?\s*,?\s*[0-9]{4}\)",
    "abstract": r"(?i)(?:^|\n)\s*(?:abstract|аннотация|анотація|резюме)\s*[:.]",
    "api": r"(?i)(?:Parameters|Returns|Raises|Args|Kwargs|Attributes|Параметры|Возвращает|Аргументы)\s*[:\n]",
    "signature": r"(?:def|function|func|fn|class|struct|interface|type)\s+[A-Za-z0-9_]+\s*\(",
    "keyword": r"\x01(?:def|class|import|from|return|if|elif|else|for|while|try|except|function|const|let|var|async|await|export|require|public|private|protected|static|void|int|string|bool|func|struct|impl|trait|match|enum|SELECT|FROM|WHERE|INSERT|UPDATE|DELETE|JOIN)\x02",
    "inline": r"`[^`\n]+`",
    "emoji": r"[\x{1F300}-\x{1FAFF}\x{2600}-\x{27BF}\x{2B00}-\x{2BFF}\x{FE00}-\x{FE0F}\x{1F1E6}-\x{1F1FF}\x{2190}-\x{21FF}\x{2300}-\x{23FF}]",
    "greeting": r"(?i)(?:^|\n)\s*(?:dear|hi|hello|hey|greetings)(?:[^\nA-Za-z0-9_][^\n]{0,39})?[,:]",
    "signoff": r"(?i)(?:^|[^A-Za-z0-9_])(?:best regards|kind regards|warm regards|best wishes|kind wishes|sincerely(?:\s+yours)?|yours (?:truly|sincerely|faithfully)|best,[A-Za-z0-9_]|cheers|many thanks|thanks(?:,[A-Za-z0-9_]| again| in advance)|thank you|talk soon|looking forward to hearing)(?:[^A-Za-z0-9_]|$)",
    "subject": r"(?i)(?:^|\n)\s*(?:subject|re|fwd|тема)\s*:",
    "hashtag": r"(?:^|\s)#[\p{L}0-9_]+",
    "mention": r"(?:^|\s)@[A-Za-z0-9_.]+",
    "call": r"(?i)\x01(?:buy\x02 \x01now|shop\x02 \x01now|sign(?:\x02[- ]\x01)?up|order\x02 \x01(?:now|today)|get\x02 \x01started(?:\x02 \x01today)?|limited\x02[- ]\x01time|act\x02 \x01now|don(?:\x02'\x01)?t\x02 \x01miss|free\x02 \x01trial|start(?:ing)?\x02 \x01(?:free|today)|subscribe|save\x02 \x01[0-9]+\x02%\x01|[0-9]+\x02% \x01off|exclusive\x02 \x01offer|special\x02 \x01offer|claim\x02 \x01your|register\x02 \x01now|book\x02 \x01(?:now|a\x02 \x01demo)|try\x02 \x01it\x02 \x01free)(?:\x02|\x01)?",
    "hype": r"(?i)\x01(?:amazing|incredible|revolutionary|game\x02[- ]\x01chang[A-Za-z0-9_]+|best\x02[- ]\x01in\x02[- ]\x01class|unbeatable|ultimate|exclusive|unlock|supercharge|skyrocket|transform\x02 \x01your)\x02",
}
IMPERATIVES = "install create open run add set click type select copy paste go установите создайте откройте запустите добавьте настройте выберите скопируйте нажмите введите перейдите".split()
FORMAL = "furthermore|moreover|consequently|thus|hence|hereby|notwithstanding|aforementioned|кроме того|более того|следовательно|таким образом|вышеизложенное|нижеследующий".split("|")
#: How texts of a kind may be treated: keep structure, keep white space, paraphrase, rewrite syntax, most intensity, profile.
HINTS = {
    "code": (True, True, False, False, 20, "docs"), "mixed_code": (True, True, True, True, 60, "docs"), "article": (True, False, True, True, 80, "web"), "news": (True, False, True, True, 70, "web"),
    "tutorial": (True, False, True, False, 65, "docs"), "academic": (True, False, True, False, 55, "academic"), "chat": (False, False, True, True, 80, "chat"), "technical_doc": (True, True, True, False, 50, "docs"),
    "list_heavy": (True, False, True, False, 65, "web"), "email": (True, False, True, True, 75, "email"), "social": (False, False, True, True, 80, "social"), "marketing": (False, False, True, True, 75, "marketing"), "general": (False, False, True, True, 80, "web"),
}


def _steps(x: str, *marks: tuple[str, float]) -> str:
    return "case " + " ".join(f"when {x} {c} then {v}D" for c, v in marks) + " else 0D end"


def _if(c: str, v: float) -> str:
    return f"case when {c} then {v}D else 0D end"


def _content(d):
    n = lambda name, t="t": d.count(t, CONTENT[name])
    is_ = lambda name: d.matches("t", CONTENT[name])
    kinds = {
        "code": [_steps("blocks", ("> 0.6", 0.7), ("> 0.3", 0.4)), _if("indented / lines > 0.4", 0.3), _steps("keywords / words", ("> 0.08", 0.3), ("> 0.04", 0.15)), _if("braces / chars > 0.02", 0.2)],
        "mixed_code": [_if("blocks > 0.05 and blocks < 0.6", 0.4), _if("inline / words > 0.02", 0.2), _if("headings >= 1 and blocks > 0.05", 0.2), _if("items > 0 and blocks > 0.05", 0.1)],
        "article": [_steps("headings", (">= 2", 0.3), ("= 1", 0.15)), _if("paragraphs >= 3 and para_words > 30", 0.3), _if("words / ns >= 12 and words / ns <= 30", 0.2), _if("items > 0 and items / lines < 0.3", 0.1)],
        "news": [_if(is_("dateline"), 0.35), _if(f"{n('quoted')} > 0", 0.25), _if("para_words < 40 and paragraphs >= 3", 0.15), _if("headings <= 1", 0.1)],
        "tutorial": [_if(f"{n('step')} > 0", 0.4), _if("numbered >= 3", 0.2), _if("headings >= 2", 0.15), _if(f"{_present(d, IMPERATIVES)} >= 3", 0.2)],
        "academic": [_steps("citations", (">= 2", 0.4), ("= 1", 0.2)), _if(is_("abstract"), 0.3), _if("words / ns > 20", 0.15), _if(f"{_present(d, FORMAL)} >= 3", 0.15)],
        "chat": [_steps("emoji", (">= 2", 0.3), ("= 1", 0.15)), _if("short / ns > 0.6", 0.25), _if("words / ns < 10", 0.2), _if("loud / chars > 0.005 or asked / chars > 0.005", 0.15), _if("words < 100", 0.1)],
        "technical_doc": [_if(is_("api"), 0.35), _if(f"{n('signature', 'bare_')} >= 2", 0.25), _if("inline / words > 0.03", 0.15), _if("headings >= 3", 0.1)],
        "list_heavy": [_steps("items / lines", ("> 0.4", 0.5), ("> 0.25", 0.3)), _if("items >= 5", 0.2)],
        "email": [_if(is_("greeting"), 0.4), _if(is_("signoff"), 0.4), _if(is_("subject"), 0.15)],
        "social": [_steps("hashtags", (">= 2", 0.45), ("= 1", 0.25)), _if("mentions >= 1", 0.25), _if("emoji >= 1", 0.2), _if("words < 60", 0.15), _if("hashtags >= 1 and (mentions >= 1 or emoji >= 1)", 0.15)],
        "marketing": [_steps(n("call", "edges_"), (">= 2", 0.4), ("= 1", 0.2)), f"case when hype >= 2 and loud / chars > 0.003 then 0.2D when hype >= 1 then 0.1D else 0D end"],
        "general": ["0.15D"],
    }
    array = "[{}]" if d.name == "duckdb" else "array({})"
    total = {k: f"least(1D, {' + '.join(v)})" for k, v in kinds.items()}
    total["chat"] = f"case when hashtags >= 2 then least(0.5D, {total['chat']}) else {total['chat']} end"
    score = {k: rounded(v, 4) for k, v in total.items()}
    parts = d.keep(d.map(d.split("t", r"\n\s*\n"), "x", trimmed(d, "x")), "x", "x <> ''")
    words = lambda x: d.count(x, r"[^\x09-\x0D\x20]+")
    hint = lambda k, show: "case " + " ".join(f"when content_type = '{x}' then {show(h[k])}" for x, h in HINTS.items()) + " end"
    return [
        text(d), {"low": "lower(t)", "bare_": d.replace("t", CONTENT["block"], ""), "s": sentences(d, "t"), "ps": parts},
        {"edges_": d.replace(d.replace("t", r"[\x01\x02]", " "), "([A-Za-z0-9_]+)", "\x01$1\x02"), "kw": d.replace(d.replace("bare_", r"[\x01\x02]", " "), "([A-Za-z0-9_]+)", "\x01$1\x02"), "chars": "greatest(1D * length(t), 1D)", "lines": f"1D * {d.size(d.split('t', r'\n'))}", "words": f"greatest(1D * {words('t')}, 1D)"},
        {
            "blocks": "(length(t) - length(bare_)) / chars", "indented": f"1D * {n('indented', 'bare_')}", "keywords": f"1D * {n('keyword', 'kw')}", "braces": f"1D * {d.count('t', '[{};]')}", "inline": f"1D * {n('inline')}",
            "headings": f"{n('heading')} + {n('html_heading')}", "numbered": n("numbered"), "items": f"1D * ({n('bullet')} + {n('numbered')})", "paragraphs": f"greatest({d.size('ps')}, 1)", "para_words": f"{d.total(d.map('ps', 'x', words('x')))} / greatest(1D * {d.size('ps')}, 1D)",
            "ns": f"greatest(1D * {d.size('s')}, 1D)", "short": f"1D * {d.size(d.keep('s', 'x', f'{words("x")} < 8'))}", "emoji": n("emoji"), "hashtags": n("hashtag"), "mentions": n("mention"), "citations": n("citation"), "loud": f"1D * {d.count('t', '!')}", "asked": f"1D * {d.count('t', r'\?')}", "hype": n("hype", "edges_"),
        },
        {"ranked": d.sort(array.format(", ".join(d.struct(v=f"-1D * ({x})", k=str(k), n=f"'{c}'") for k, (c, x) in enumerate(score.items()))))},
        {"top_": d.at("ranked", 0), "next_": d.at("ranked", 1), "ok": f"length({trimmed(d, 't')}) >= 20"},
        {"content_type": "case when ok then top_.n else 'general' end", "type_confidence": f"case when ok then {rounded('least(1D, -0.6D * top_.v + 0.4D * (next_.v - top_.v) + 0.1D)', 4)} else 0.5D end", "heading_count": d.long("headings"), "list_items": d.long("items"), "emoji_count": d.long("emoji"), "citation_count": d.long("citations")},
        {c: hint(k, (lambda v: f"'{v}'") if k == 5 else lambda v: str(v).lower()) for k, c in enumerate(("protect_structure", "protect_whitespace", "allow_paraphrase", "allow_syntax_rewrite", "max_intensity", "profile"))},
    ]


#: Cyrillic letters and the Latin ones they look like, other look-alikes, and marks of typesetting.
CYRILLIC_ALIKE = ("асеорхуАВСЕНКМОРТХ", "aceopxyABCEHKMOPTX")
SPECIAL_ALIKE = ("ａｂｃｄｅｆｇ∂αο²³¹⁰ⁱ", "abcdefgdao23" + "1" + "0i")
TYPESET = ("‘’“”‒–—−      　", "''\"\"----" + " " * 7)


def _swapped(d, t: str, letters: tuple[str, str], beside: str, left: str) -> list[dict]:
    """Layers that end in sw_: look-alikes that touch the other script stand between marks. A run of them after a letter
    of that script is repaired whole, as each repaired one is the left neighbour of the next; before one, only the last."""
    run = f"[{letters[0]}]"
    return [
        {"sw_": d.replace(t, rf"({left})({run}+)", "$1\x01$2\x02")},
        {"sw_": d.replace("sw_", rf"({run})({beside})", "\x01$1\x02$2")},
    ]


def _marks(d):
    latin, cyrillic = (r"\p{IsLatin}", r"\p{IsCyrillic}") if d.name == "spark" else (r"\p{Latin}", r"\p{Cyrillic}")
    q = lambda s: d.lit(s)
    east = "lang in ('ru', 'uk')"
    fixed = lambda pair: d.join(indexed(d, "pieces", f"case when <k> % 2 = 1 then translate(<w>, {q(pair[0])}, {q(pair[1])}) else <w> end"), "")
    back = (CYRILLIC_ALIKE[1], CYRILLIC_ALIKE[0])
    (w1, w2), (e1, e2) = _swapped(d, "a", CYRILLIC_ALIKE, latin, rf"[{latin}αο∂]"), _swapped(d, "a", back, cyrillic, cyrillic)
    dense = d.count(d.replace("c", r"([^\x09-\x0D\x20])", "$1$1"), r"[^\x09-\x0D\x20] {2,}[^\x09-\x0D\x20]")
    ends = d.map(d.keep("w", "x", "length(x) > 3"), "x", "substring(x, length(x) - 1, 2)")
    times = d.struct(n=f"-1 * {d.size(d.keep('ends', 'y', 'y = e_'))}", p="array_position(ends, e_)" if d.name == "spark" else "list_position(ends, e_)", e="e_")
    return [
        text(d),
        {"zero_width_count": d.long(d.count("t", ZERO_WIDTH)), "a": d.replace(d.replace("t", ZERO_WIDTH, ""), r"[\x01\x02]", "")},
        {"sw_": f"case when {east} then {e1['sw_']} else {w1['sw_']} end"}, {"sw_": f"case when {east} then {e2['sw_']} else {w2['sw_']} end"},
        {"pieces": d.split("sw_", r"[\x01\x02]"), "special": d.count("a", f"[{SPECIAL_ALIKE[0]}]")},
        {"b": f"translate(translate(case when {east} then {fixed(back)} else {fixed(CYRILLIC_ALIKE)} end, {q(SPECIAL_ALIKE[0])}, {q(SPECIAL_ALIKE[1])}), {q(TYPESET[0])}, {q(TYPESET[1])})",
         "homoglyph_count": d.long(f"{d.total(indexed(d, 'pieces', 'case when <k> % 2 = 1 then length(<w>) else 0 end'))} + special")},
        {"format_count": d.long(d.count("b", OTHER_FORMAT)), "c": d.replace("b", OTHER_FORMAT, "")},
        {"multi_space": d.long(dense)},
        {"c": f"case when multi_space > 5 then {d.replace('c', r'([^ \n]) {2,}', '$1 ')} else c end"},
        {"trailing_lines": d.long(d.count("c", r" +(?:\n|\z)")), "w": d.extract("lower(t)", T5A)},
        {"cleaned": f"case when trailing_lines > 3 then {d.replace('c', r' +(\n|\z)', '$1')} else c end", "ends": ends},
        {"top_": d.part(d.sort(d.map(d.uniq("ends"), "e_", times)), 0, 3)},
        {"biased": f"{d.size(d.keep('top_', 'x', f'-1D * x.n / {d.size("ends")} > 0.15 and not {d.among("x.e", COMMON_ENDINGS)}'))} > 0 and {d.size('w')} >= 50"},
        {"n_types": d.long(" + ".join(f"case when {c} then 1 else 0 end" for c in ("zero_width_count > 0", "homoglyph_count > 0", "format_count > 0", "multi_space > 5", "trailing_lines > 3", "biased"))), "characters_removed": "zero_width_count + homoglyph_count + format_count"},
        {"has_marks": "n_types > 0", "mark_confidence": f"case when n_types = 0 then 0D else {rounded('least(0.3D + 0.15D * n_types + 0.01D * characters_removed + 0.05D * homoglyph_count, 1D)', 4)} end", "cleaned_md5": "md5(cleaned)", "ending_bias": "biased"},
    ]


def _health(d):
    """Five components and their weighted mean; an unknown verdict counts as an even chance. Spark counts them in the pass of
    the detector's measures, whose own `readability` stands in the place of the grade in either engine."""
    raw = [("readability", "grade_level", analysis._readability), ("mechanics", "mechanics", analysis._mechanics), ("unique_", "score", analysis._uniqueness), ("variety", "diversity", analysis._diversity)]
    out, held = [], []
    for name, column, part in [] if d.name == "spark" else raw:
        out += part(d)
        held.append(name)
        out += [{name: column}] if name != column else []
        out.append(Keep(["text", "lang", *(["perplexity"] if d.name == "duckdb" else []), *held]))
    ease = "case when readability between 8 and 12 then 100D when readability < 8 then greatest(50D, 100D - (8D - readability) * 10D) else greatest(30D, 100D - (readability - 12D) * 8D) end"
    body = detector.layered(detector._MEASURES, kept=held, more=detector._ensemble, also="health")(d)
    parts = {"health_readability": rounded(ease, 1), "health_grammar": rounded("mechanics", 1), "health_uniqueness": rounded("unique_ * 100D", 1), "health_naturalness": rounded("(1D - case when verdict = 'unknown' then 0.5D else ai_probability end) * 100D", 1), "health_diversity": rounded("greatest(0D, least(100D, variety))", 1)}
    whole = "0.2D * health_readability + 0.25D * health_grammar + 0.2D * health_uniqueness + 0.2D * health_naturalness + 0.15D * health_diversity"
    return [*out, *body, parts, {"health": rounded(whole, 1)}, {"health_grade": "case when health >= 95 then 'A+' when health >= 85 then 'A' when health >= 75 then 'B' when health >= 60 then 'C' when health >= 40 then 'D' else 'F' end"}]


def _short_marks(d, t: str) -> list[dict]:
    """Layers that end in mw, cw, n_tok: words of a machine's and of casual prose among the words of t."""
    member = lambda ws: d.size(d.keep("tk", "x", d.among("x", ws)))
    return [{"tk": d.extract(f"lower({t})", T2)}, {"mw": f"1D * {member(lexicon.MACHINE_WORDS)}", "cw": f"1D * {member(lexicon.CASUAL_WORDS)}", "n_tok": f"1D * {d.size('tk')}"}]


def _long_words(d) -> dict:
    return {"z": "greatest(6D, n_tok)", "far": f"1D * {d.size(d.keep('tk', 'x', 'length(x) >= 9'))}"}


def _quick(d):
    body = detector.layered(detector._MEASURES, kept=["text"], more=detector._ensemble, also="quick")(d)
    words = [{"z": "greatest(6D, n_tok)"}] if d.name == "spark" else [*_short_marks(d, "coalesce(text, '')"), _long_words(d)]
    hint = d.matches("lower(coalesce(text, ''))", r"\bit is important to note|as an ai|furthermore|in conclusion\b")
    return [
        *body, *words,
        {"quick_probability": f"case when verdict <> 'unknown' then ai_probability else {rounded(clamp(f'0.42D + (mw + case when {hint} then 2D else 0D end) / z * 1.7D - cw / z * 1.5D + far / z * 0.4D'), 4)} end", "words": d.long("n_tok")},
        {"quick_verdict": "case when quick_probability >= 0.6 then 'ai' when quick_probability >= 0.4 then 'mixed' else 'human' end"},
    ]


_OVERALL = "case when verdict = 'unknown' then 0.5D else ai_probability end"


def _heat(d):
    """Layers that end in overall and hw: all sentences of three words and more, each with what it counts."""
    cut = d.replace("coalesce(text, '')", rf"([.!?…]){WS}+", "$1\x1f")
    kept = d.keep(d.map(d.split(cut, r"\x1F"), "x", trimmed(d, "x")), "x", f"{d.count('x', r'[^\x09-\x0D\x20]+')} >= 3")
    words = lambda ws, x: d.size(d.keep(x, "v", d.among("v", ws)))
    tk = d.extract("lower(y)", T2)
    more = f"case when {d.matches('lower(y)', "n't|'re|'ll|'m|'ve|gonna|wanna")} then 1D else 0D end + case when {d.matches('y', '[!?]+$')} then 0.5D else 0D end"
    return [
        {"overall": _OVERALL, "hs": kept},
        {"hw": d.map("hs", "y", d.struct(s="y", n=d.size(tk), a=f"1D * {words(lexicon.MACHINE_WORDS, tk)}", h=f"{words(lexicon.CASUAL_WORDS, tk)} + {more}", z=f"greatest(5D, 1D * {d.size(tk)})"))},
    ]


def _heat_layers(d) -> list[dict]:
    if d.name == "spark":
        return [*detector.layered(detector._MEASURES, more=detector._ensemble, also="heat")(d), {"overall": _OVERALL}]
    return detector.layered(detector._MEASURES, kept=["text"], more=detector._ensemble, also="heat")(d) + _heat(d)


_HEAT = detector._Detector(_heat_layers, ["overall", "hw"], extra=["text", "lang"], also="heat")
_SIGNAL = clamp("0.5D + x.a / x.z * 1.6D - x.h / x.z * 1.5D + case when x.n > 28 then 0.12D when x.n < 8 then -0.12D else 0D end")
_HEATED = rounded(clamp(f"0.45D * {_SIGNAL} + 0.55D * overall + case when x.a / x.z > 0.12 then 0.08D else 0D end - case when x.h / x.z > 0.12 then 0.12D else 0D end"), 4)


def sentence_scores(docs: DataFrame) -> DataFrame:
    """One row for each sentence of three words and more of a whole text: doc_id, index, sentence, probability.

    The plain explode would first ask which texts have sentences, for which the pass would run a second time."""
    each = _HEAT.apply(docs).select("doc_id", "overall", F.posexplode_outer("hw").alias("index", "x")).where("x is not null")
    return each.select("doc_id", "index", F.col("x.s").alias("sentence"), F.expr(_HEATED).alias("probability"))


def sentence_sql() -> str:
    return f"SELECT doc_id, index, x.s AS sentence, {_duck_numbers(_HEATED)} AS probability FROM (SELECT doc_id, overall, unnest(hw) AS x, CAST(unnest(range(0, len(hw))) AS INT) AS index FROM ({_HEAT.sql()}))"


def key_phrases(docs: DataFrame, top: int = 10) -> DataFrame:
    """Runs of two to four content words between stop words and marks; score: the sum of their words' counts (1 for a word
    that occurs only inside a longer one); rank by score, then by the place of the first."""
    d = Spark()
    low = docs.select("doc_id", F.lower(F.coalesce("text", F.lit(""))).alias("low"))
    piece = d.join(d.map(d.extract("y", T2), "x", f"case when length(x) < 3 or {d.among('x', STOP_WORDS)} then '\x1f' else x end"), " ")
    runs = F.expr(d.map(d.split(d.join(d.map(d.split("low", _CUTS), "y", piece), " \x1f "), r"\x1F"), "x", "trim(x)"))
    each = low.select("doc_id", F.posexplode(runs).alias("place", "phrase")).withColumn("ws", F.split("phrase", " ")).where("phrase <> '' and size(ws) between 2 and 4")
    each = each.groupBy("doc_id", "phrase").agg(F.min("place").alias("place"))
    counts = low.select("doc_id", F.explode(F.expr(d.extract("low", T2))).alias("w")).where(F.length("w") >= 3).groupBy("doc_id", "w").agg(F.count(F.lit(1)).alias("c"))
    parts = each.select("doc_id", "phrase", "place", F.explode(F.split("phrase", " ")).alias("w")).join(counts, ["doc_id", "w"], "left")
    scored = parts.groupBy("doc_id", "phrase", "place").agg(F.sum(F.coalesce("c", F.lit(1))).alias("score"))
    rank = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("score"), "place"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= top).select("doc_id", "rank", "phrase", "score")


_CUTS = "[.,;:!?()\"“”«»\\n\\-—/]+"


def phrases_sql() -> str:
    d = Duck()
    piece = d.join(d.map(d.extract("y", T2), "x", f"case when length(x) < 3 or x IN ({_STOP_SQL}) then '\x1f' else x end"), " ")
    runs = d.map(d.split(d.join(d.map(d.split("low", _CUTS), "y", piece), " \x1f "), r"\x1F"), "x", "trim(x)")
    return f"""
WITH l AS (SELECT doc_id, lower(coalesce(text, '')) AS low FROM documents),
r AS (SELECT doc_id, {runs} AS rs FROM l),
e AS (SELECT doc_id, unnest(rs) AS phrase, unnest(range(0, len(rs))) AS place FROM r),
g AS (SELECT doc_id, phrase, min(place) AS place FROM e WHERE phrase <> '' AND len(string_split(phrase, ' ')) BETWEEN 2 AND 4 GROUP BY ALL),
w AS (SELECT doc_id, w, count(*) AS c FROM (SELECT doc_id, unnest({d.extract('low', T2)}) AS w FROM l) WHERE length(w) >= 3 GROUP BY ALL),
p AS (SELECT doc_id, phrase, place, unnest(string_split(phrase, ' ')) AS w FROM g),
s AS (SELECT p.doc_id, phrase, place, CAST(sum(coalesce(c, 1)) AS BIGINT) AS score FROM p LEFT JOIN w ON w.doc_id = p.doc_id AND w.w = p.w GROUP BY ALL),
k AS (SELECT *, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, place) AS INT) AS rank FROM s)
SELECT doc_id, rank, phrase, score FROM k WHERE rank <= 10
"""


_HINT_COLUMNS = ["protect_structure", "protect_whitespace", "allow_paraphrase", "allow_syntax_rewrite", "max_intensity", "profile"]
OPERATORS = {
    "language_detect": Operator(_language, ["detected", "latin_score"], extra=["text"]),
    "tone": Operator(_tone, ["tone", "tone_score", "tone_confidence", "formality_score", "subjectivity_score", "first_second_person", "passive_count", "formal_marker_score", "informal_marker_score"], extra=["text", "lang"]),
    "content_type": Operator(_content, ["content_type", "type_confidence", "heading_count", "list_items", "emoji_count", "citation_count", *_HINT_COLUMNS], extra=["text"]),
    "hidden_marks": Operator(_marks, ["zero_width_count", "homoglyph_count", "format_count", "multi_space", "trailing_lines", "ending_bias", "n_types", "has_marks", "characters_removed", "mark_confidence", "cleaned_md5"], extra=["text", "lang"]),
    "content_health": detector._Detector(_health, ["health", "health_grade", "health_readability", "health_grammar", "health_uniqueness", "health_naturalness", "health_diversity"], extra=["text", "lang"]),
    "quick_score": detector._Detector(_quick, ["quick_probability", "quick_verdict", "words"], extra=["text", "lang"]),
}
