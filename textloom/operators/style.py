"""Style: features of one text, profiles of several, comparison with a profile, and measures of how a text is built.

Null text is empty; an empty text has a profile of zeros and the neutral value of each measure. Frequencies inside a text
come from runs of a sorted list, so a long text costs n log n.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.functions.dialect import WS, Operator, _duck_numbers, held, indexed, rounded
from textloom.operators.analysis import T4, T4U, clamp, lengths, moments, sentences, squares, text, tokens, trimmed

WORD = r"\p{L}\p{N}_"
EDGE, END = rf"(?:^|[^{WORD}])", rf"(?:[^{WORD}]|$)"

#: Marks that are taken from both ends of a word, in profiles and in measures.
EDGE_MARKS = r"[.,;:!?\"'()\-–—«»]+"
MEASURE_MARKS = r"[.,;:!?\"'()\[\]{}]+"
#: Words of function by language; other languages take the English ones.
FUNCTION_WORDS = {
    "en": """the a an is are was were be been being have has had do does did will would shall should may might can could must i me my mine we
us our ours you your yours he him his she her hers it its they them their theirs this that these those in on at to for with by from of about
into through during before after above below between under over up down out off and but or nor so yet if then else when while as since
because although though not no very too also just only""".split(),
    "ru": """и в на с он она они мы вы я не но а что это как за к по из от до у о об при для же ли бы ещё еще так уже все его ее её то только
ну тоже также где когда если чтобы потому хотя были был была будет есть нет да""".split(),
    "uk": """і в на з він вона вони ми ви я не але а що це як за к по із від до у о об при для ж чи б ще так вже всі його її їх то тільки ну
теж також де коли якщо щоб тому хоча були був була буде є ні або та""".split(),
}
#: Kinds of first words.
PRONOUNS = "i we you he she it they who this that my our your his her its their".split()
ARTICLES = "the a an".split()
CONJUNCTIONS = "and but or yet so for nor however moreover furthermore nevertheless although because since while when if".split()
#: Features in the order of a profile, with their weights in a comparison.
FEATURES = {
    "avg_word_length": 2.5, "word_length_std": 1.0, "ttr": 1.5, "hapax_ratio": 1.0, "avg_syllables": 1.0, "avg_sentence_length": 1.5,
    "sentence_length_cv": 2.0, "sentence_length_variance": 1.0, "avg_clause_depth": 1.0, "comma_rate": 2.0, "semicolon_rate": 1.0,
    "dash_rate": 1.0, "exclamation_rate": 1.0, "question_rate": 1.0, "parenthesis_rate": 1.0, "function_word_ratio": 3.0,
    "pronoun_start_ratio": 1.5, "article_start_ratio": 1.0, "conjunction_start_ratio": 1.0, "avg_paragraph_length": 0.8,
}
#: Endings of nouns made from verbs and adjectives.
NOUN_ENDINGS = """tion ment ness ity ence ance ация ение ование ung heit keit schaft ité isation ción miento dad zione mento ità ość acja
ção dade""".split()
#: Subject pronouns and what the verb after them ends in, by language.
ACTIVE = [
    ("i|we|you|he|she|they", rf"[{WORD}]+(?:ed|s)"), ("я|мы|ты|вы|он|она|они|він|вона|вони", rf"[{WORD}]+"),
    ("ich|wir|du|er|sie", rf"[{WORD}]+(?:e|st|t|en)"), ("je|nous|tu|vous|il|elle|ils|elles", rf"[{WORD}]+"),
    ("yo|nosotros|tú|usted|él|ella|ellos", rf"[{WORD}]+"),
]
#: Words that count off points, by language.
COUNTED_EN = "first|second|third|fourth|fifth|firstly|secondly|thirdly|finally|lastly|next|then|moreover|furthermore"
COUNTED = [
    "во-первых|во-вторых|в-третьих|в-четвёртых|наконец|далее|затем", "по-перше|по-друге|по-третє|нарешті|далі|потім",
    "erstens|zweitens|drittens|schließlich|außerdem", "primero|segundo|tercero|finalmente|por último|además",
]
#: Words before the colon that opens a list.
LIST_OPENERS = [
    "following|these|key|main|several|important|below|steps|components|reasons|benefits|factors|ways|points|aspects|elements",
    rf"следующ[{WORD}]+|ключев[{WORD}]+|основн[{WORD}]+|несколько|важн[{WORD}]+|причин[{WORD}]+|преимуществ[{WORD}]+|факторов|шаг[{WORD}]+|компонент[{WORD}]+",
]
#: Participles of appended clauses.
PARTICIPLES = """enabling providing allowing ensuring highlighting making creating offering leveraging fostering driving improving reducing
increasing helping leading resulting reflecting showcasing emphasizing underscoring empowering streamlining enhancing delivering""".split()
#: Phrases of closing, opening and passing on.
CLOSING = ["in conclusion", "to summarize", "in summary", "overall", "to conclude", "in short", "ultimately", "all in all", "в заключение", "подводя итог", "таким образом", "итого", "резюмируя", "в итоге", "підсумовуючи", "на завершення"]
OPENING = ["in today's", "in the modern", "in recent years", "the importance of", "it is widely", "has become", "plays a crucial", "is one of", "has emerged", "в современном", "на сегодняшний день", "в последние годы", "является одним из", "играет ключевую роль", "у сучасному", "на сьогоднішній"]
PASSING = ["however", "furthermore", "moreover", "additionally", "in addition", "consequently", "first", "second", "third", "finally", "однако", "кроме того", "более того", "во-первых", "во-вторых", "в-третьих", "наконец"]
FLAT_CLOSING = ["conclusion", "summarize", "summary", "overall", "заключение", "итог", "таким образом", "підсумовуючи"]
FLAT_OPENING = ["today's", "modern", "importance", "crucial", "современном", "сьогоднішній", "ключевую"]


def runs(d, name: str, a: str) -> list[dict]:
    """Layers that end in <name>: how often each distinct element of list a occurs, in order of the elements."""
    s, m = f"{name}_sorted", f"{name}_starts"
    return [
        {s: f"sort_array({a})" if d.name == "spark" else f"list_sort({a})"},
        {m: d.keep(indexed(d, s, f"case when <k> = 0 or <w> <> {d.at(s, '<k> - 1')} then <k> else -1 end"), "x", "x >= 0")},
        {name: indexed(d, m, f"coalesce({d.at(m, '<k> + 1')}, {d.size(s)}) - <w>")},
    ]


def bits(d, counts: str, n: str) -> str:
    return d.total(d.map(counts, "x", f"-1D * x / {n} * ln(1D * x / {n}) / ln(2D)"))


def bare(d, x: str, marks: str = EDGE_MARKS) -> str:
    return d.replace(x, f"^{marks}|{marks}$", "")


def _occurs(s: str, x: str) -> str:
    return f"((length({x}) - length(replace({x}, '{s}', ''))) / {len(s)}D)"


def _profile(d) -> list[dict]:
    vowels = "[aeiouyаеёиоуыэюяіїє]+"
    rate = lambda *marks: f"({' + '.join(_occurs(m, 't') for m in marks)}) / (nw / 100D)"
    share = lambda a, words: f"1D * {d.size(d.keep(a, 'x', d.among('x', words)))}"
    of_lang = " ".join(f"when lang = '{c}' then {share('w', FUNCTION_WORDS[c])}" for c in ("ru", "uk"))
    return [
        text(d),
        {"raw": tokens(d, "t"), "s": sentences(d, "t"), "lines": d.keep(d.split("t", r"\n"), "x", f"{trimmed(d, 'x')} <> ''")},
        {"ok": f"{d.size('raw')} > 0 and {d.size('s')} > 0", "nw": f"greatest(1D, 1D * {d.size('raw')})", "ns": f"greatest(1D, 1D * {d.size('s')})"},
        {"w": d.keep(d.map("raw", "x", f"lower({bare(d, 'x')})"), "x", "x <> ''"), "first": d.map("s", "x", bare(d, f"lower({d.at(tokens(d, 'x'), 0)})"))},
        *runs(d, "freq", "w"),
        {"len": d.map("w", "x", "length(x)"), "syl": d.map("w", "x", f"case when {d.count('x', vowels)} > 0 then {d.count('x', vowels)} when {d.matches('x', '[a-z]')} then 1 else 0 end"), "k": f"greatest(1D, 1D * {d.size('w')})", "types": f"greatest(1D, 1D * {d.size('freq')})"},
        moments(d, "len"),
        {"f_avg_word_length": "mean_", "f_word_length_std": f"case when n_ > 1 then sqrt({squares(d, 'len')} / (n_ - 1)) else 0D end"},
        {"slen": lengths(d, "s")},
        {"n2": d.size("slen"), "mean2": f"{d.total('slen')} / ns"},
        {"f_avg_sentence_length": "mean2", "f_sentence_length_variance": f"case when n2 > 1 then {d.total(d.map('slen', 'x', '(x - mean2) * (x - mean2)'))} / (n2 - 1) else 0D end"},
        {
            "f_sentence_length_cv": "case when n2 > 1 and mean2 > 0 then sqrt(f_sentence_length_variance) / mean2 else 0D end",
            "f_ttr": f"{d.size('freq')} / k", "f_hapax_ratio": f"{d.size(d.keep('freq', 'x', 'x = 1'))} / types", "f_avg_syllables": f"{d.total('syl')} / k",
            "f_avg_clause_depth": f"{d.total(d.map('s', 'x', f'{_occurs(",", "x")} + {_occurs(" and ", "x")} + {_occurs(" but ", "x")}'))} / ns",
            "f_comma_rate": rate(","), "f_semicolon_rate": rate(";"), "f_dash_rate": rate("—", "–", " - "), "f_exclamation_rate": rate("!"),
            "f_question_rate": rate("?"), "f_parenthesis_rate": rate("(", "["),
            "f_function_word_ratio": f"(case {of_lang} else {share('w', FUNCTION_WORDS['en'])} end) / k",
            "f_pronoun_start_ratio": f"{share('first', PRONOUNS)} / ns", "f_article_start_ratio": f"{share('first', ARTICLES)} / ns", "f_conjunction_start_ratio": f"{share('first', CONJUNCTIONS)} / ns",
            "f_avg_paragraph_length": f"case when {d.size('lines')} > 0 then {d.total(d.map('lines', 'l_', d.size(sentences(d, 'l_'))))} / {d.size('lines')} else 0D end",
        },
        {f"g_{f}": f"case when ok then f_{f} else 0D end" for f in FEATURES},
        {"words": d.long(f"case when ok then {d.size('raw')} else 0 end"), "sentences_": d.long(f"case when ok then {d.size('s')} else 0 end")},
    ]


def _style(d):
    return [*_profile(d), {f: rounded(f"g_{f}", 4) for f in FEATURES} | {"sample_words": "words", "sample_sentences": "sentences_"}]


_RAW = Operator(_profile, ["source", *(f"g_{f}" for f in FEATURES), "words", "sentences_"], extra=["text", "lang", "source"])


def style_by_source(documents: DataFrame) -> DataFrame:
    """One profile for each source: the mean of each feature over its texts, and the sums of words and sentences."""
    g = _RAW.apply(documents).groupBy("source").agg(*(F.avg(f"g_{f}").alias(f) for f in FEATURES), F.sum("words").alias("sample_words"), F.sum("sentences_").alias("sample_sentences"))
    return g.select("source", *(F.expr(rounded(f, 4)).alias(f) for f in FEATURES), "sample_words", "sample_sentences")


_COMPARED = {
    "similarity": "(" + " + ".join(f"{w}D * exp(-0.5D * ((g_{f} - r_{f}) / greatest(abs(r_{f}), 0.01D)) * ((g_{f} - r_{f}) / greatest(abs(r_{f}), 0.01D)))" for f, w in FEATURES.items()) + f") / {sum(FEATURES.values())}D",
    "confidence": "least(r_words / 500D, 1D) * least(words / 100D, 1D) * 0.9D",
}
_KNOWN = "t_ and r_words > 0"
_OUT = {
    "similarity": f"case when {_KNOWN} then {rounded('sim', 4)} else 0D end",
    "same_author_likelihood": f"case when {_KNOWN} then {rounded(clamp('(sim - 0.4D) / 0.3D'), 4)} else 0D end",
    "verdict": f"case when not ({_KNOWN}) then 'unknown' when sim >= 0.7D then 'same_author' when sim <= 0.4D then 'different_author' else 'uncertain' end",
    "confidence": f"case when {_KNOWN} then {rounded('conf', 4)} else 0D end",
}


def style_compare(documents: DataFrame) -> DataFrame:
    """Each text against the profile of its own source; a null source has no profile and is unknown.

    The profiles are an aggregate of one row a source: the join is left to the optimiser, which sees their size."""
    each = _RAW.apply(documents)
    profiles = each.where("source is not null").groupBy("source").agg(*(F.avg(f"g_{f}").alias(f"r_{f}") for f in FEATURES), F.sum("words").cast("double").alias("r_words"))
    both = each.withColumn("t_", F.col("words") > 0).join(profiles, "source", "left").withColumn("r_words", F.coalesce("r_words", F.lit(0.0)))
    both = both.withColumns({"sim": F.expr(_COMPARED["similarity"]), "conf": F.expr(_COMPARED["confidence"])})
    return both.select("doc_id", *(F.expr(x).alias(c) for c, x in _OUT.items()))


def by_source_sql() -> str:
    means = ", ".join(f"{rounded(f'avg(g_{f})', 4)} AS {f}" for f in FEATURES)
    return _duck_numbers(f"SELECT source, {means}, CAST(sum(words) AS BIGINT) AS sample_words, CAST(sum(sentences_) AS BIGINT) AS sample_sentences FROM (") + _RAW.sql() + ") GROUP BY source"


def compare_sql() -> str:
    means = ", ".join(f"avg(g_{f}) AS r_{f}" for f in FEATURES)
    inner = f"SELECT e.*, e.words > 0 AS t_, coalesce(p.r_w, 0.0) AS r_words, {', '.join(f'r_{f}' for f in FEATURES)} FROM e LEFT JOIN p USING (source)"
    scored = f"SELECT *, {_COMPARED['similarity']} AS sim, {_COMPARED['confidence']} AS conf FROM ({inner})"
    out = f"SELECT doc_id, {', '.join(f'{x} AS {c}' for c, x in _OUT.items())} FROM ({scored})"
    return f"WITH e AS ({_RAW.sql()}), p AS (SELECT source, {means}, CAST(sum(words) AS DOUBLE) AS r_w FROM e WHERE source IS NOT NULL GROUP BY source) " + _duck_numbers(out)


def _twice(d, t: str) -> str:
    """Every mark and space twice, so that neighbours can each use one as their boundary."""
    return d.replace(t, rf"([^{WORD}])", "$1$1")


def _voice(d):
    nouns = d.size(d.keep("w", "x", d.matches("x", rf"^[{WORD}]{{4,}}(?:{'|'.join(NOUN_ENDINGS)})$")))
    twice = d.size(d.keep("w", "x", d.matches("x", rf"^[{WORD}]{{4,}}isation$")))  # two endings at once
    acts = " + ".join(d.count("tt", rf"{EDGE}(?:{who}){WS}+{verb}{END}") for who, verb in ACTIVE)
    return [
        text(d), {"s": sentences(d, "t"), "tt": _twice(d, "lower(t)"), "w": d.extract("lower(t)", T4U)},
        {"ns": d.size("s"), "n": f"1D * {d.count('t', rf'[^\x09-\x0D\x20]+')}", "noun": f"({nouns} + {twice})", "act": f"1D * ({acts})"},
        {"voice": f"case when ns < 4 then 0.5D else {rounded(clamp('0.62D * least(noun / n / 0.07D, 1D) + 0.38D * greatest(0D, 1D - act / ns / 0.3D)'), 4)} end"},
    ]


def _structure(d):
    counted = [d.count("lt", rf"(?m)(?:^|[.!?…][\"»']?{WS}+)(?:{COUNTED_EN}){WS}*,"), d.count("t", rf"(?m)(?:^|\n){WS}*(?:[0-9]{{1,2}}[.)]{WS}|[-*•]{WS})")]
    counted += [d.count("tt", rf"(?m)(?:^|[.!?…]{WS}+)(?:{words}){END}") for words in COUNTED[2:]]
    counted += [d.count("tt", rf"(?m)(?:^|[.!?…]{WS}+)(?:{words.replace('-', '--')}){END}") for words in COUNTED[:2]]
    lists = [d.count("tt", rf"{EDGE}(?:{words}){WS}*:") for words in LIST_OPENERS]
    turned = [
        d.count("lt", rf"{EDGE}not only[^.!?{WORD}][^.!?]{{1,58}}[^.!?{WORD}]but also{END}"),
        d.count("lt", rf"{EDGE}it'?s not (?:just |merely |simply )?[^.!?,]{{2,40}},?{WS}+it'?s{END}"),
        d.count("lt", rf"{EDGE}не только[^.!?{WORD}][^.!?]{{1,58}}[^.!?{WORD}]но и{END}"),
        d.count("lt", rf"{EDGE}не просто[^.!?{WORD}][^.!?]{{1,39}},?{WS}+а{END}"),
    ]
    part = lambda x, full: f"least(({' + '.join(x)}) / ns / {full}D, 1D)"
    return [
        text(d), {"lt": "lower(t)", "s": sentences(d, "t")}, {"tt": _twice(d, "lt"), "ns": f"greatest(1D, 1D * {d.size('s')})"},
        {"enum_": part(counted, 0.5), "list_": part(lists, 0.25), "tail": part([d.count("tt", rf",{WS}+(?:{'|'.join(PARTICIPLES)}){END}")], 0.4), "turn": part(turned, 0.2)},
        {"structure": rounded(clamp("0.34D + 0.62D * (0.42D * enum_ + 0.28D * tail + 0.18D * list_ + 0.12D * turn)"), 4)},
    ]


def _discourse(d):
    say = lambda x, phrases: d.matches(f"lower({x})", "|".join(phrases))
    some = lambda x, phrases, yes, no: f"case when {say(x, phrases)} then {yes}D else {no}D end"
    last = lambda a: d.at(a, f"{d.size(a)} - 1")
    return [
        text(d), {"s": sentences(d, "t"), "p": d.keep(d.map(d.split("t", r"\n\n"), "x", trimmed(d, "x")), "x", "x <> ''")},
        {"np": d.size("p"), "ns": d.size("s"), "len": d.keep(indexed(d, "p", f"case when <k> > 0 and <k> < {d.size('p')} - 1 then {d.count('<w>', rf'[^\x09-\x0D\x20]+')} else -1 end"), "x", "x >= 0"), "f": d.map("p", "x", d.replace(f"lower({d.at(tokens(d, 'x'), 0)})", r"[.,;:]+$", ""))},
        *runs(d, "same", "f"), moments(d, "len"),
        {
            "body": f"case when n_ >= 2 and mean_ > 0 then greatest(0D, 1D - sqrt({squares(d, 'len')} / (n_ - 1)) / mean_ / 0.5D) end",
            "pass_": d.total(indexed(d, "p", f"case when <k> > 0 and {d.matches(d.replace('lower(<w>)', f'{WS}+', ' '), f'^(?:{"|".join(PASSING)})')} then 1 else 0 end")),
            "most": d.most("same"),
        },
        {
            "many": f"({some(d.at('p', 0), OPENING, 0.9, 0.1)} + {some(last('p'), CLOSING, 1.0, 0.0)} + least(pass_ / (np - 1) / 0.4D, 1D) + coalesce(body, 0D) + case when np >= 4 then least(1D * most / np / 0.3D, 1D) else 0D end) / (3D + case when body is null then 0 else 1 end + case when np >= 4 then 1 else 0 end)",
            "flat": f"({some(last('s'), FLAT_CLOSING, 0.8, 0.2)} + {some(d.at('s', 0), FLAT_OPENING, 0.7, 0.3)}) / 2D",
        },
        {"discourse": f"case when np >= 3 then {rounded(clamp('many'), 4)} when ns < 5 then 0.5D else {rounded(clamp('flat'), 4)} end"},
    ]


def _repetition(d):
    """Overlap of the longer words of sentences two to five apart."""
    words = d.uniq(d.keep(d.map(tokens(d, "y"), "x", f"lower({bare(d, 'x', MEASURE_MARKS)})"), "x", "length(x) > 3"))
    layers = [text(d), {"s": sentences(d, "t")}, {"sets": d.keep(d.map("s", "y", words), "y", f"{d.size('y')} > 0")}]
    for o in (2, 3, 4, 5):
        other = d.at("sets", f"<k> + {o}")
        common = d.size(d.both("<w>", other))
        layers.append({f"o{o}": d.keep(indexed(d, "sets", f"case when {other} is null then -1D else 1D * {common} / ({d.size('<w>')} + {d.size(other)} - {common}) end"), "x", "x >= 0")})
    add = lambda f: "(" + " + ".join(f(f"o{o}") for o in (2, 3, 4, 5)) + ")"
    return [
        *layers, {"n": f"1D * {add(d.size)}", "all_": add(d.total), "high": add(lambda a: d.size(d.keep(a, "x", "x > 0.35D")))},
        {"semantic_rep": f"case when {d.size('s')} < 5 or {d.size('sets')} < 4 or n = 0 then 0.5D else {rounded(clamp('0.5D * least(all_ / n / 0.2D, 1D) + 0.5D * least(high / n / 0.15D, 1D)'), 4)} end"},
    ]


def _summary(d):
    """A profile in a few lines for people to read."""
    show = lambda f, n: f"cast(cast({rounded(f'g_{f}', n)} as decimal(20, {n})) as varchar(40))"
    lines = [
        ["lang=", "coalesce(lang, 'en')", "  words=", "cast(words as varchar(20))", "  sentences=", "cast(sentences_ as varchar(20))"],
        ["avg word length: ", show("avg_word_length", 2), "  (±", show("word_length_std", 2), ")"],
        ["avg sentence length: ", show("avg_sentence_length", 1), " words  (CV ", show("sentence_length_cv", 2), ")"],
        ["avg syllables/word: ", show("avg_syllables", 2)], ["TTR: ", show("ttr", 3), "  hapax: ", show("hapax_ratio", 3)], ["function-word ratio: ", show("function_word_ratio", 3)],
        ["punctuation /100w — comma ", show("comma_rate", 2), ", semicolon ", show("semicolon_rate", 2), ", dash ", show("dash_rate", 2), ', "!" ', show("exclamation_rate", 2), ', "?" ', show("question_rate", 2)],
        ["sentence starts — pronoun ", show("pronoun_start_ratio", 2), ", article ", show("article_start_ratio", 2), ", conjunction ", show("conjunction_start_ratio", 2)],
    ]
    parts = [x if x.startswith(("cast(", "coalesce(")) else d.lit(x) for k, line in enumerate(lines) for x in ([*line] if not k else [chr(10), *line])]
    return [*_profile(d), {"fingerprint": f"concat({', '.join(parts)})"}]


def _entropy(d):
    base = lambda x, a, b: f"greatest(0D, 1D - ({x} - {a}D) / {b}D)"
    east = "lang in ('ru', 'uk')"
    return [
        text(d), {"c": d.extract("lower(t)", "(?s)."), "w0": d.map(tokens(d, "t"), "x", f"lower({bare(d, 'x', MEASURE_MARKS)})")},
        {"w": d.keep("w0", "x", "x <> ''")}, {"g": d.grams("w", 2)},
        *runs(d, "cf", "c"), *runs(d, "wf", "w0"), *runs(d, "gf", "g"),
        {"hc": bits(d, "cf", d.size("c")), "hw": bits(d, "wf", d.size("w0")), "hg": bits(d, "gf", d.size("g"))},
        {"h2": f"case when {d.size('g')} > 0 then hg - hw else hw end"},
        {"score_": f"case when {east} then 0.2D * {base('hc', 4, 1.5)} + 0.5D * {base('hw', 5, 3)} + 0.3D * {base('h2', 0, 4)} else 0.2D * {base('hc', 3, 2)} + 0.5D * {base('hw', 5, 5)} + 0.3D * {base('h2', 0, 3)} end"},
        {"entropy": f"case when {d.size('w0')} < 10 then 0.5D else {rounded(clamp('score_'), 4)} end"},
    ]


def _perplexity(d):
    """How well a text's own character 4-grams, with one added to each count, foretell it; and what its words repeat.

    Logarithms of grams and of their contexts are summed apart: a gram's context count is shared by all grams after it."""
    parted = lambda x: f"trim({d.replace(f'lower({x})', f'{WS}+', ' ')})"
    steps = lambda x, *marks: "case " + " ".join(f"when {x} < {at} then {points}D" for at, points in marks) + " else 0D end"
    logs = lambda a, more: d.total(d.map(a, "x", f"x * ln(1D * x + {more})"))
    return [
        text(d), {"c": d.extract(parted("t"), "(?s)."), "w": d.extract("lower(t)", T4)},
        {"g": d.grams("c", 4)}, {"ctx": d.map("g", "x", "substring(x, 1, 5)"), "pairs": d.grams("w", 2)},
        *runs(d, "gf", "g"), *runs(d, "cf", "ctx"), *runs(d, "wf", "w"),
        {"v": f"1D * {d.size(d.uniq('c'))}", "n": f"1D * {d.size('w')}", "ng": f"1D * {d.size('g')}", "len": d.keep(d.map(sentences(d, "t"), "x", d.count("lower(x)", T4)), "x", "x > 0")},
        {
            "cpp": f"case when {d.size('c')} < 5 then 0D else pow(2D, ({logs('cf', held('v'))} - {logs('gf', '1D')}) / ng / ln(2D)) end",
            "hw": bits(d, "wf", "n"), "again": f"case when n < 3 then 0D else 1D - 1D * {d.size(d.uniq('pairs'))} / {d.size('pairs')} end",
            "ttr": f"case when n < 100 then 1D * {d.size('wf')} / greatest(n, 1D) else {d.total(d.map(d.seq(d.integer_part(d.size('w'), 100)), 'i_', f'{d.size(d.uniq(d.part("w", "i_ * 100", 100)))} / 100D'))} / {d.integer_part(d.size('w'), 100)} end",
            "hapax": f"1D * {d.size(d.keep('wf', 'x', 'x = 1'))} / greatest(1D, 1D * {d.size('wf')})",
        },
        moments(d, "len"),
        {"points": f"case when cpp > 0 then {steps('cpp', (4, 25), (7, 15), (12, 5))} else 0D end + {steps('hw', (5, 20), (7, 10), (8, 5))} + 25D * again + {steps('ttr', (0.4, 15), (0.55, 8), (0.65, 3))} + {steps('hapax', (0.4, 15), (0.55, 8), (0.65, 3))}"},
        {
            "perplexity": f"case when n = 0 then 0D else {rounded('cpp', 4)} end", "predictability": f"case when n < 10 then 0D else {rounded(clamp('points / 100D'), 4)} end",
            "length_variation": f"case when n_ >= 2 and mean_ > 0 then {rounded(f'sqrt({squares(d, "len")} / n_) / mean_', 4)} else 0D end",
        },
    ]


OPERATORS = {
    "perplexity": Operator(_perplexity, "perplexity predictability length_variation".split(), extra=["text"]),
    "style_profile": Operator(_style, [*FEATURES, "sample_words", "sample_sentences"], extra=["text", "lang"]),
    "style_fingerprint": Operator(_summary, ["fingerprint"], extra=["text", "lang"]),
    "metric_voice": Operator(_voice, ["voice"], extra=["text"]),
    "metric_structure": Operator(_structure, ["structure"], extra=["text"]),
    "metric_discourse": Operator(_discourse, ["discourse"], extra=["text"]),
    "metric_semantic_rep": Operator(_repetition, ["semantic_rep"], extra=["text"]),
    "metric_entropy": Operator(_entropy, ["entropy"], extra=["text", "lang"]),
}
