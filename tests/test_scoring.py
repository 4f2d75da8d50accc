"""All measures from one pass over Arrow batches against the expressions of each."""

from __future__ import annotations

import re

import pyarrow as pa
import pytest

from textloom.functions import lexicon, scoring, trigrams
from textloom.operators import analysis, corpus, detector, pages, signals
from textloom.sources import packs

FIRST = "Furthermore, it is important to note that Dr. A. B. Smith plays a crucial role in the modern era. "
ODD = [
    None, "", "Too short.", "\x1f\x1e", "No end", "İstanbul. ΣΑΣ ΟΔΟΣ. Ǆ x. ① ② Ⅷ B. ½ of it.",
    FIRST * 4 + "\n\n- one\n- two\n- three\n\n1. In addition, we don't know; I'm sure they walked, and, and it's not just fast, it's good!!\n\nIn conclusion: both of these things and the others alike.",
    "Первое. Во-первых, мы пошли домой и т.д. и т.п. и см. рисунок. Наконец, следует отметить важность данного подхода… Я думаю, что это так. Однако ряд причин: не только рост, но и влияние! " * 3,
    "Hеllо wоrld оf mixed lеttеrs\x1fin cоde, раypal аnd Σigma. " * 6, "Ich denke, wir gehen. Zusammenfassend lässt sich sagen: es ist wichtig. Außerdem, por último, enabling growth. Sie kam.\r\nEr ging. Du auch. Ja\x85so." * 4,
    "日本語の文章です。これはテストです。 " * 20, "first, second, third\nfirst and foremost, the following steps: 12.5 $40 1999 30% O'Brien said (yes). \"Quoted\" text. REUTERS\n" * 5,
    "i we you walked. He walks; she runs! They jumped? " * 8, "```code``` function return class def `x` lol " * 6, "word " * 300 + ".\n\n" + "e.g. i.e. approx. Mr. X. Y. Z. end. " * 9, "plaintiff pursuant (a) (b] hypothesis: framework, et al. " * 9, "zero​width­soft. " * 12 + "\x01marks\x02 and\x01and\x02. ",
]
LANGS = ["en", None, "", "auto", "RU", "uk-UA", "de", "fr"]


def test_one_pass_equals_the_expressions(spark):
    docs = spark.createDataFrame([(k * len(LANGS) + j, t, x) for k, t in enumerate(ODD) for j, x in enumerate(LANGS)], "doc_id long, text string, lang string")
    docs = packs.with_packs(docs, packs.own_packs(spark)).repartition(8).cache()
    taken = [m for m in detector._MEASURES if m[1] not in ("perplexity",)]
    names = [n for _, n in taken]
    slow = detector.Operator(detector.layered(taken, packs=True), [*names, "lang"], extra=detector._PACKED).apply(docs).collect()
    fast = detector.Operator(lambda d: detector._scored(True, []), [*names, "lang"], extra=detector._PACKED).apply(docs).collect()
    assert {r.doc_id: r.asDict() for r in fast} == {r.doc_id: r.asDict() for r in slow}
    assert len({r.pattern for r in fast}) > 5 and len({r.domain for r in fast}) > 4


def test_a_match_holds_what_it_is_looked_for_by():
    for p in [*lexicon.HEDGING, *lexicon.COUNTING]:
        found = scoring.needles(detector.edged(p))
        assert found and all(found), p
    assert scoring.needles("ab(?:cd|ef)?gh") == ["ab"] and scoring.needles("(?:cat|dog)s?") == ["cat", "dog"] and scoring.needles("(?:cat|)") == []


@pytest.mark.parametrize("rows", [1, 3])
def test_parts_of_a_batch(monkeypatch, rows):
    texts, langs = pa.array(ODD), pa.array([None] * len(ODD), pa.string())
    whole = scoring.score(detector.rules(), texts, langs).to_pylist()
    monkeypatch.setattr(scoring, "ROWS", rows)
    assert scoring.score(detector.rules(), texts, langs).to_pylist() == whole
    assert len(scoring.score(detector.rules(), texts[:0], langs[:0])) == 0


def documents(spark):
    return spark.createDataFrame([(1, FIRST * 5, "en")], "doc_id long, text string, lang string")


def passes(df, capsys) -> int:
    """How often the plan scores texts."""
    df.explain()
    return len(re.findall("ArrowEvalPython", capsys.readouterr().out))


def test_detect_is_one_pass(spark, capsys):
    assert passes(detector.OPERATORS["detect"].apply(documents(spark)), capsys) == 1


def test_content_health_is_one_pass(spark, capsys):
    assert passes(signals.OPERATORS["content_health"].apply(documents(spark)), capsys) == 1


def test_detect_with_packs_is_one_pass(spark, capsys):
    assert passes(detector.WITH_PACKS["detect_with_packs"].apply(packs.with_packs(documents(spark), packs.own_packs(spark))), capsys) == 1


def test_metric_separation_is_one_pass(spark, capsys):
    assert passes(corpus.metric_separation(documents(spark), spark.createDataFrame([(1, 1)], "doc_id long, quality int")), capsys) == 1


def test_quick_score_is_one_pass(spark, capsys):
    assert passes(signals.OPERATORS["quick_score"].apply(documents(spark)), capsys) == 1


def test_sentence_scores_is_one_pass(spark, capsys):
    assert passes(signals.sentence_scores(documents(spark)), capsys) == 1


def test_scan_page_scores_in_batches(spark, capsys):
    assert passes(pages.scan_page(spark.createDataFrame([(1, "https://a.example", "<p>" + FIRST * 3 + "</p>")], "page_id long, url string, html string")), capsys) >= 1


MORE = [*ODD, "A  b ,c ;; d :: i i i. I, i! i't (x] [y) {z the the The. ÿes Ÿes. " * 3, "well I gonna go. don't you know?  So it is really!! Two words. \x1f thus furthermore moreover, we're 3d-print -abc 'tis x_y_z ½a. " * 40, "Σίσυφος ΟΔΟΣ. i̇ İ x. Straße ǆ ǅ. it’s we’re ok… " * 4]


def both_ways(spark, also: str, layers, names: list[str]):
    """What the pass counts besides the measures, and what the expressions say."""
    docs = spark.createDataFrame([(k * 3 + j, t, x) for k, t in enumerate(MORE) for j, x in enumerate(["en", None, "ru"])], "doc_id long, text string, lang string").repartition(4).cache()
    fast = detector.Operator(lambda d: detector._scored(False, [], also), names, extra=["text", "lang"]).apply(docs)
    slow = detector.Operator(layers, names, extra=["text", "lang"]).apply(docs)
    return ({r.doc_id: r.asDict(True) for r in df.collect()} for df in (fast, slow))


def test_health_counts_equal_the_expressions(spark):
    layers = lambda d: [*analysis._mechanics(d), *analysis._uniqueness(d), {"unique_": "score"}, *analysis._diversity(d), {"variety": "diversity"}]
    fast, slow = both_ways(spark, "health", layers, ["mechanics", "unique_", "variety"])
    assert fast == slow and len({r["mechanics"] for r in fast.values()}) > 5


def test_content_health_has_no_lists_in_expressions(spark, capsys):
    signals.OPERATORS["content_health"].apply(documents(spark)).explain()
    assert "regexp_extract_all" not in capsys.readouterr().out


@pytest.mark.parametrize("east", [False, True])
def test_trigrams_of_a_text_alone(east):
    texts = [(t or "").lower() for t in MORE]
    said = [[x.lower() for x in scoring.sentences(detector.rules(), t or "")] for t in MORE]
    whole = trigrams.perplexity(pa.array(texts), pa.array(said, pa.list_(pa.string())), pa.array(["ru" if east else "en"] * len(texts))).to_pylist()
    own = [trigrams.alone(scoring._latin(t), s, east) for t, s in zip(texts, said, strict=True)]
    assert [x for x, y in zip(whole, own, strict=True) if y is not None] == [y for y in own if y is not None]
    assert sum(y not in (None, 0.5) for y in own) > 5 and None in own


def test_lines_that_begin_with_marks():
    lists = "- a\n -\n\n•\tb\n*c\n1. x\n12) y\n123. z\n9.\n- \n7)"
    whole = [len(re.findall(p, lists)) for p in (r"(?m)^\s*[-•*]\s", r"(?m)^\s*[0-9]+[.)]\s", r"(?m)(?:^|\n)\s*(?:[0-9]{1,2}[.)]\s|[-*•]\s)")]
    assert scoring._begun(detector.rules(), lists.split("\n")) == (whole[0], whole[1], whole[2] - whole[0])


def test_quick_words_equal_the_expressions(spark):
    layers = lambda d: [*signals._short_marks(d, "coalesce(text, '')"), signals._long_words(d)]
    fast, slow = both_ways(spark, "quick", layers, ["mw", "cw", "n_tok", "far"])
    assert fast == slow and len({r["cw"] for r in fast.values()}) > 3


def test_heat_equals_the_expressions(spark):
    layers = lambda d: [{"verdict": "'unknown'", "ai_probability": "0D"}, *signals._heat(d)]
    fast, slow = both_ways(spark, "heat", layers, ["hw"])
    assert fast == slow and max(len(r["hw"]) for r in fast.values()) == 120


def test_metric_separation_scores_labelled_texts_only(spark, capsys):
    labels = spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    corpus.metric_separation(documents(spark), labels).explain()
    plan = capsys.readouterr().out
    assert 0 < plan.index("ArrowEvalPython") < plan.index("LeftSemi")


def test_packs_come_to_the_texts(spark, capsys):
    packs.with_packs(documents(spark), packs.own_packs(spark)).explain()
    plan = capsys.readouterr().out
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_lines_and_paragraphs_are_counted_from_one_split():
    text = "one two.\n\n\nthree four five. \n \nsix seven eight nine ten.\n\n\n\n- eleven\n\n" * 9
    doubled = scoring._score(detector.rules(), text, "en", None)[0]
    assert doubled["grammar"] == scoring._score(detector.rules(), text.replace("\n\n\n\n", "\n\n").replace("\n\n\n", "\n\n"), "en", None)[0]["grammar"] != 0.5


def test_sentence_scores_take_the_whole_text(spark):
    import duckdb

    said = [f"Sentence number {k} goes on." for k in range(300)]
    late = [f"Late words {k}, furthermore and moreover!" for k in range(200)]
    texts = [" ".join(said), " ".join(["The same three words."] * 150 + late), "Three words here. " * 119 + "Last of all.", "ok. " * 500 + "But this counts.", None, ""]
    rows = [(k, t, "en") for k, t in enumerate(texts)] + [(9, "Latin words stand here. " * 200 + "Это русский текст, и его больше. " * 300, None)]
    got = signals.sentence_scores(spark.createDataFrame(rows, "doc_id long, text string, lang string")).orderBy("doc_id", "index").collect()
    assert [r.sentence for r in got if r.doc_id == 0] == said and [r.sentence for r in got if r.doc_id == 1][150:] == late
    assert [(r["index"], r.sentence) for r in got if r.doc_id in (2, 3)][-2:] == [(119, "Last of all."), (0, "But this counts.")]
    documents = pa.table({"doc_id": [r[0] for r in rows], "text": [r[1] for r in rows], "lang": [r[2] for r in rows]})  # noqa: F841
    assert [tuple(r) for r in got] == duckdb.sql(f"SELECT * FROM ({signals.sentence_sql()}) ORDER BY doc_id, index").fetchall()
    assert len([r for r in got if r.doc_id == 9]) == 500


def test_all_sentences_of_the_pass_equal_the_expressions(spark):
    layers = lambda d: [{"verdict": "'unknown'", "ai_probability": "0D"}, *signals._heat(d)]
    fast, slow = both_ways(spark, "heat", layers, ["hw"])
    assert fast == slow and max(len(r["hw"]) for r in fast.values()) > 120


def test_sentence_scores_take_the_language_of_the_whole_text():
    text = "Latin words stand here. " * 200 + "Это русский текст, и его больше. " * 300
    read = lambda also: scoring._score(detector.rules(), text, None, None, also)[2]
    assert (read(""), read("heat")) == ("en", "ru")
    assert "4000" not in signals.sentence_sql() and "4000" in detector.OPERATORS["detect"].sql()
