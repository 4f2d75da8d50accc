"""The detector, language packs, signals and pages: properties on texts of our own, and values worked out by hand."""

import json
import math

import pytest

from textloom.functions.dialect import Duck, Spark
from textloom.operators import detector, pages, signals
from textloom.sources import packs

MACHINE = """Furthermore, it is important to note that the implementation of comprehensive frameworks plays a crucial role in the optimization of organizational performance. Moreover, the utilization of innovative methodologies enables stakeholders to facilitate significant improvement across multiple operational dimensions. Additionally, a wide range of robust solutions represents a significant advancement in the modern era, ensuring sustainable development. Consequently, organizations must leverage these capabilities in order to foster a culture of innovation. In conclusion, it is essential that the integration of holistic approaches remains a fundamental consideration for the achievement of strategic objectives."""
CASUAL = """So I tried that new ramen place on 5th yesterday with Dana. Honestly? Not great! The broth was kinda bland and my egg came out cold... We waited 40 minutes. I don't think I'll go back, tbh. Dana liked her dumplings, though she's easy to please. Anyway, we ended up at Joe's bar after, and I won $20 at pool. My brother called at 11 and told me his car got towed again, lol."""


def detect(spark, *texts, lang="en"):
    df = spark.createDataFrame([(k, t, lang) for k, t in enumerate(texts)], "doc_id long, text string, lang string")
    return {r.doc_id: r for r in detector.OPERATORS["detect"].apply(df).collect()}


def test_machine_prose_casual_prose_and_short_texts(spark):
    got = detect(spark, MACHINE, CASUAL, "Too short.", "", None, "One sentence only that is longer than fifty characters in all, no more")
    assert got[0].verdict == "ai" and got[0].ai_probability > 0.55 and "ai.pattern" in got[0].explanations
    assert got[1].verdict == "human" and got[1].ai_probability < 0.4
    assert [got[k].verdict for k in (2, 3, 4, 5)] == ["unknown"] * 4
    assert [got[k].explanations for k in (2, 5)] == ["meta.too_short", "meta.too_few_sentences"] and got[5].confidence == 0.1
    for r in got.values():
        assert all(0 <= r[m] <= 1 for m in detector.WEIGHTS) and 0 <= r.confidence <= 1


def test_ensemble_by_hand(spark):
    r = detect(spark, MACHINE)[0]
    m = {k: r[k] for k in detector.WEIGHTS}
    w = detector.weights_of(r.domain)
    assert math.isclose(sum(w.values()), 1)
    strong = sum(m[k] for k in detector.STRONG) / 6
    strong = 0.5 + (strong - 0.5) * 1.8 if strong > 0.55 else 0.5 + (strong - 0.5) * 1.5 if strong < 0.35 else strong
    votes = sum(v >= 0.55 for v in m.values()) / 16
    votes = 0.5 + (votes - 0.5) * 1.5 if votes > 0.6 or votes < 0.4 else votes
    clamp = lambda x: max(0.0, min(1.0, x))
    raw = clamp(0.4 * sum(w[k] * m[k] for k in m) + 0.4 * clamp(strong) + 0.2 * clamp(votes))
    assert r.ai_probability == pytest.approx(1 / (1 + math.exp(-5 * (raw - 0.45))), abs=1e-4)


def test_look_alikes_and_invisible_marks_do_not_hide_a_text(spark):
    hidden = MACHINE.replace("o", "о").replace(" ", " ​", 40)
    got = detect(spark, MACHINE, hidden)
    assert abs(got[0].ai_probability - got[1].ai_probability) < 0.08 and got[1].pattern == got[0].pattern


def test_domains(spark):
    df = spark.createDataFrame([(1, "The plaintiff and the defendant agree pursuant to law."), (2, "def function return class ```x``` ```y```"), (3, "lol that was fun"), (4, "LONDON (REUTERS) - Shares fell today."), (5, "I like my dog and my cat, me too"), (6, "The hypothesis and the methodology"), (7, "Nothing special here.")], "doc_id long, text string")
    got = {r.doc_id: r.domain for r in detector.OPERATORS["text_domain"].apply(df.selectExpr("*", "'en' as lang")).collect()}
    assert got == {1: "legal", 2: "code_docs", 3: "social", 4: "news", 5: "blog", 6: "academic", 7: "general"}


def test_edges_and_counts_of_patterns(spark):
    df = spark.createDataFrame([(1, "It is important. It is important to note it. In conclusion, both cats are here and dogs run there too. First, second, thirdly.", "en")], "doc_id long, text string, lang string")
    r = detector.OPERATORS["metric_pattern"].apply(df).first()
    assert (r.hedge_count, r.enum_count) == (4, 2)


def test_packs_are_read_joined_and_written(spark, tmp_path):
    folder = tmp_path / "langs"
    folder.mkdir()
    (folder / "xx.json").write_text(json.dumps({"stop_words": ["and", "the"], "bureaucratic": {"Utilization": ["use"], "prior to": ["before"]}, "trigrams": ["abc"]}))
    (folder / "index.json").write_text(json.dumps({"libraryVersion": "1", "languages": {"xx": {"name": "X", "tier": 1, "bytes": 9}}}))
    (folder / "broken.json").write_text("not json")
    lexicon = packs.read_packs(spark, str(folder / "*.json"))
    assert {(r.lang, r.category, r.term) for r in lexicon.collect()} == {("xx", "stop_words", "and"), ("xx", "stop_words", "the"), ("xx", "bureaucratic", "Utilization"), ("xx", "bureaucratic", "prior to"), ("xx", "trigrams", "abc")}
    assert [tuple(r) for r in packs.pack_index(spark, str(folder / "index.json")).collect()] == [("xx", "X", 1, 9)]
    docs = spark.createDataFrame([(1, "a", "XX-yy"), (2, "b", "zz"), (3, "c", None)], "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in packs.with_packs(docs, lexicon).collect()}
    assert got[1].pack_known and sorted(got[1].bureaucratic) == ["prior to", "utilization"] and not got[2].pack_known and got[3].stop_words == []
    packs.write_packs(lexicon, str(tmp_path / "out"))
    written = {r.lang: json.loads(r.value) for r in spark.read.text(str(tmp_path / "out")).collect()}
    assert written["xx"] == {"bureaucratic": ["Utilization", "prior to"], "stop_words": ["and", "the"], "trigrams": ["abc"]}


def test_a_pack_wakes_the_measures_that_need_one(spark):
    docs = spark.createDataFrame([(1, MACHINE, "en"), (2, MACHINE, "qq")], "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in detector.WITH_PACKS["detect_with_packs"].apply(packs.with_packs(docs, packs.own_packs(spark))).collect()}
    assert got[2].stylometry == got[2].vocabulary == 0.5 and got[1].stylometry > 0.6 and got[1].vocabulary != 0.5


@pytest.mark.parametrize(("text", "want"), [
    ("The cat and the dog were there with their friends from the town.", "en"), ("Der Hund und die Katze sind nicht mit dem Auto auf der Straße.", "de"),
    ("Les enfants sont dans la maison avec une amie pour être ensemble.", "fr"), ("El niño está en la casa con los amigos, pero también hay más.", "es"),
    ("Это очень хороший день, и мы все идём в парк, потому что тепло.", "ru"), ("Це дуже гарний день, і ми всі йдемо до парку, тому що тепло, їхній.", "uk"),
    ("这是一个非常好的日子，我们都去公园。", "zh"), ("これはとても良い日です。公園に行きます。", "ja"), ("오늘은 아주 좋은 날입니다 공원에 갑니다", "ko"), ("هذا يوم جيد جدا ونحن نذهب إلى الحديقة", "ar"), ("short", "en"),
])
def test_languages(spark, text, want):
    assert signals.OPERATORS["language_detect"].apply(spark.createDataFrame([(1, text)], "doc_id long, text string")).first().detected == want


def signal(spark, name, text, lang="en"):
    return signals.OPERATORS[name].apply(spark.createDataFrame([(1, text, lang)], "doc_id long, text string, lang string")).first()


def test_tone(spark):
    formal = signal(spark, "tone", "Pursuant to the aforementioned agreement, the parties shall consequently establish procedures in accordance with applicable regulations, notwithstanding prior correspondence.")
    chatty = signal(spark, "tone", "Hey, yeah I'm gonna grab some stuff, wanna come? It's kinda cool, dunno, lol!! We're like so happy!")
    assert formal.formality_score > 0.6 and formal.tone in ("formal", "professional", "academic") and formal.formal_marker_score > 0
    assert chatty.formality_score < 0.4 and chatty.tone in ("casual", "friendly") and chatty.first_second_person >= 2
    short = signal(spark, "tone", "Hi there you")
    assert (short.tone, short.formality_score, short.tone_score) == ("neutral", 0.5, 0)


@pytest.mark.parametrize(("kind", "text"), [
    ("email", "Dear John,\n\nThank you for the note about the meeting. I will join you there on Monday.\n\nBest regards\nAnn"),
    ("social", "Loving this sunny day #summer #beach @ann 🌞"), ("code", "```\ndef f(x):\n    return x;\nfor i in y: { pass; }\n```"),
    ("marketing", "Buy now and save 20%! Limited-time exclusive offer. This amazing, incredible deal is unbeatable, so act now and get started today! It is the ultimate choice for every home, and it works from the first day on, which is why so many people who have tried it would never give it back to us again."),
    ("general", "hi"),
])
def test_kinds_of_content(spark, kind, text):
    assert signal(spark, "content_type", text).content_type == kind


def test_hidden_marks_are_found_and_repaired(spark):
    import hashlib

    md5 = lambda s: hashlib.md5(s.encode()).hexdigest()
    r = signal(spark, "hidden_marks", "he​llo cоmроund “q” x² и мир")
    assert (r.zero_width_count, r.homoglyph_count, r.n_types) == (1, 4, 2) and r.cleaned_md5 == md5('hello compound "q" x2 и мир')
    r = signal(spark, "hidden_marks", "привет cвет и пoле", "ru")  # Latin c and o in Cyrillic words
    assert r.homoglyph_count == 2 and r.cleaned_md5 == md5("привет свет и поле")
    clean = signal(spark, "hidden_marks", "Plain text, nothing to see.")
    assert not clean.has_marks and clean.mark_confidence == 0 and clean.cleaned_md5 == md5("Plain text, nothing to see.")
    r = signal(spark, "hidden_marks", "one  two  three  four  five  six  seven\n  kept  x \ny \nz \nw \n")
    assert r.multi_space > 5 and r.trailing_lines == 4 and r.cleaned_md5 == md5("one two three four five six seven\n  kept x\ny\nz\nw\n")
    assert signal(spark, "hidden_marks", "blomox gramox " * 40).ending_bias and not signal(spark, "hidden_marks", "walked talked " * 40).ending_bias


def test_health_quick_scores_and_heat(spark):
    human, machine = signal(spark, "content_health", CASUAL), signal(spark, "content_health", MACHINE)
    assert human.health_naturalness > machine.health_naturalness and 0 <= machine.health <= 100
    assert human.health == pytest.approx(0.2 * human.health_readability + 0.25 * human.health_grammar + 0.2 * human.health_uniqueness + 0.2 * human.health_naturalness + 0.15 * human.health_diversity, abs=0.051)
    assert signal(spark, "content_health", None).health_grade in "A+ A B C D F".split()
    assert signal(spark, "quick_score", "Furthermore, as an AI").quick_verdict == "ai" and signal(spark, "quick_score", "lol yeah ok").quick_verdict == "human"
    df = spark.createDataFrame([(1, MACHINE + " Honestly, I just don't know, yeah!", "en")], "doc_id long, text string, lang string")
    heat = signals.sentence_scores(df).orderBy("index").collect()
    assert len(heat) == 6 and heat[0].probability > heat[-1].probability


def test_key_phrases(spark):
    df = spark.createDataFrame([(1, "Solar panel costs fell. Solar panel makers cut prices; the solar panel costs fell again."), (2, None)], "doc_id long, text string")
    got = [(r.phrase, r.score) for r in signals.key_phrases(df).orderBy("doc_id", "rank").collect()]
    assert got == [("solar panel costs fell", 10)] and len(got) == 1


HTML = """<html data-wf-page="1"><head><meta name="generator" content="{gen}"></head><body class="{cls}"><div id="{id}" {attr} style="{style}">x</div><footer>{foot}</footer></body></html>"""


def page(k, url="https://www.nasa.gov/x", gen="", cls="", id="", attr="", style="", foot=""):
    return (k, url, HTML.replace(' data-wf-page="1"', "").format(gen=gen, cls=cls, id=id, attr=attr, style=style, foot=foot))


def test_sites(spark):
    violet = "background: linear-gradient(90deg, rgb(139, 92, 246), rgb(6, 182, 212))"
    rows = [
        page(1, "https://x.lovable.app/p"), page(2, "https://evil-lovable.app"), page(3, "https://v0-abc.vercel.app"), page(4, "https://abc.vercel.app"), page(5), (6, None, None),
        page(7, gen="WordPress 6.1"), page(8, gen="WordPress 6.1", foot="Powered by Webflow"), page(9, cls="bg-background text-foreground lucide-x", attr='data-radix-collection-item=""'), page(10, style=violet), page(11, style="background: linear-gradient(red, rgb(120, 121, 122))"), page(12, id="__next"), page(13, id="__nextdoor"),
    ]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r for r in pages.site_platform(df).collect()}
    assert [got[k].platform_id for k in range(1, 14)] == ["lovable", "none", "v0", "none", "none", "none", "wordpress", "webflow", "none", "none", "none", "next", "none"]
    assert (got[1].ai_built, got[1].verdict, got[1].evidence) == (0.9, "ai", 5) and got[5].ai_built == 0.06 and got[5].verdict == "human"
    assert got[4].ai_built == pytest.approx(1 - 0.94 * 0.84, abs=1e-4) and got[8].candidates == "webflow wordpress"
    assert got[9].ai_built == pytest.approx(1 - 0.94 * 0.66 * 0.8 * 0.9, abs=1e-4) and got[10].ai_built == pytest.approx(1 - 0.94 * 0.82, abs=1e-4) and got[11].ai_built == 0.06
    content = spark.createDataFrame([(5, 0.5, 4, 2)], "page_id long, ai_text_share double, images long, ai_images long")
    words = spark.createDataFrame([("X.lovable.app", "human"), ("abc.vercel.app", "ai")], "host string, label string")
    got = {r.page_id: r for r in pages.site_forensics(pages.page_hints(df), content, words).collect()}
    assert got[5].ai_built == pytest.approx(0.5 * 0.85 + 0.12 * 0.5 + 0.08 * 0.5) and got[5].verdict == "mixed"
    assert (got[1].verdict, got[1].ai_built, got[1].overridden) == ("human", 0.22, True) and (got[4].verdict, got[4].ai_built) == ("ai", 0.72)


def test_page_report_counts_the_whole_page(spark):
    long = "word " * 400
    html = f"<html><head><title>t</title></head><body><nav>menu a b</nav><p>{long}</p><p>{MACHINE}</p><p>tiny</p><img src='a.png'><img src='a.png'><img src='data:x'><script>var x = 1</script></body></html>"
    r = pages.scan_page(spark.createDataFrame([(1, "https://x.org", html), (2, "https://y.org", None)], "page_id long, url string, html string")).orderBy("page_id").collect()
    assert r[0].words == 3 + 400 + len(MACHINE.split()) + 1 and r[0].images == 1 and r[0].text_blocks == 2 and r[0].ai_blocks == 1 and r[0].top_blocks.startswith("2")
    assert (r[1].words, r[1].text_blocks, r[1].top_blocks) == (0, 0, "")


def test_dialects_name_the_same_columns():
    for op in (*detector.OPERATORS.values(), *signals.OPERATORS.values()):
        for d in (Spark(), Duck()):
            assert all(op.layers(d))
