"""Rewriters and media: exact results where they are fixed, properties where chance decides, damaged and empty input."""

import re
import struct
import zlib

import pytest

from textloom.operators import media, rewrite
from textloom.operators.detector import OPERATORS as DETECTOR

MACHINE = """Furthermore, it is important to note that the implementation of comprehensive frameworks plays a crucial role in the optimization of organizational performance. Moreover, the utilization of innovative methodologies enables groups to facilitate significant improvement across numerous dimensions, see `pip install x` and https://example.com/a.b.c for more. Additionally, a wide range of robust solutions represents a significant advancement in the modern era. Consequently, organizations must leverage these capabilities in order to foster a culture of innovation, mail admin@test.co today."""
KEPT = ["`pip install x`", "https://example.com/a.b.c", "admin@test.co"]


def typeset(spark, text, profile="web"):
    return rewrite.typeset(spark.createDataFrame([(1, text)], "doc_id long, text string"), profile).first().typeset


def test_typography(spark):
    assert typeset(spark, "Hello ,  world .This is  a test.") == "Hello, world. This is a test."
    assert typeset(spark, "Yes—no … «q» a,b c") == 'Yes – no... "q" a, b c'
    assert typeset(spark, 'He said "a" and "b"... ok .... end', "formal") == "He said «a» and «b»… ok .... end"
    out = typeset(spark, "See https://example.com/a.b.c and mail admin@test.co , file v1.2.x .")
    assert all(x in out for x in ("https://example.com/a.b.c", "admin@test.co,", "v1.2.x."))
    assert typeset(spark, None) == "" and typeset(spark, "  indented  text\n  more") == "  indented text\n  more"


def test_case_ratio_and_diff():
    assert [rewrite.match_case(a, b) for a, b in (("Hello", "world"), ("HELLO", "world"), ("hello", "World"))] == ["World", "WORLD", "World"]
    assert rewrite.change_ratio("a b c", "a b c") == 0 and rewrite.change_ratio("a b c", "x y z") == 1 and rewrite.change_ratio("", "") == 0
    assert rewrite.change_ratio("a b c d", "a x c d") == pytest.approx(0.25)
    assert rewrite.word_diff("a b c", "a x c") == "a <del>b</del><ins>x</ins> c" and rewrite.word_diff("<a>", "<a>") == "&lt;a&gt;"
    assert rewrite.word_diff("", "n") == "<ins>n</ins>" and rewrite.word_diff("n", "") == "<del>n</del>"


def test_diff_gives_back_both_texts():
    import html
    import random

    rng = random.Random(3)
    for _ in range(200):
        a, b = (" ".join(rng.choice("a b c d".split()) for _ in range(rng.randint(0, 9))) for _ in range(2))
        d = rewrite.word_diff(a, b)
        assert html.unescape(re.sub(r"<ins>.*?</ins>|</?del>", "", d)) == a and html.unescape(re.sub(r"<del>.*?</del>|</?ins>", "", d)) == b


def test_masks_come_off():
    inner, held = rewrite.masked(MACHINE)
    assert not any(x in inner for x in KEPT) and rewrite.unmasked(inner, held) == MACHINE


def test_rewriters_are_seeded_keep_code_and_links_and_do_nothing_at_zero():
    for f in (lambda seed, p: rewrite.rewrite(MACHINE, "en", int(100 * p), seed), lambda seed, p: rewrite.paraphrase(MACHINE, "en", p, seed)):
        assert f(1, 0.6) == f(1, 0.6) and len({f(seed, 0.6)[0] for seed in range(6)}) > 1
        for seed in range(12):
            out, log = f(seed, 0.6)
            assert all(x in out for x in KEPT) and log and "" not in out
            assert not re.search(r" {2}| [,.;:!?](?!\S)|[,;:]{2}|\.\s+[a-z]|^\s|\s$|\b(\w+) \1\b", out), out
        assert f(1, 0) == (MACHINE, [])
    assert rewrite.rewrite("", "en") == ("", []) and rewrite.rewrite("Ein Text.", "de") == ("Ein Text.", [])


def test_steps_of_a_rewrite():
    c = lambda: rewrite.Chance(1, "k")
    log = []
    assert rewrite.swap_terms("We utilize it. UTILIZE!", {"utilize": ["use"]}, c(), "w", 1.0, [9], log) == "We use it. USE!" and len(log) == 2
    assert rewrite.swap_terms("It is clear that we won.", {"it is clear that": [""]}, c(), "w", 1.0, [9], []) == "We won."
    assert rewrite.swap_terms("We use a utilize b utilize", {"utilize": ["x"]}, c(), "w", 1.0, [1], []).count("utilize") == 1
    assert rewrite.swap_terms("reutilized", {"utilize": ["use"]}, c(), "w", 1.0, [9], []) == "reutilized"
    out = rewrite.vary_connectors("Moreover, a. Moreover b.", {"Moreover": ["Besides"]}, c(), 1.2, [])
    assert "Moreover" not in out
    assert rewrite.vary_starters("This is. This was. This will.", {"This": ["That"]}, c(), 9.0, []) == "This is. That was. That will."
    assert rewrite.adjust_tone("I need help now", "formal", intensity=1.0)[0].split()[0] == "I" and rewrite.adjust_tone("I need help", "neutral")[0] == "I need help"
    formal = rewrite.adjust_tone("We need to buy food and get help to start", "formal", intensity=1.0)[0]
    assert formal != "We need to buy food and get help to start" and rewrite.adjust_tone(formal, "informal", intensity=1.0)[0] != formal
    assert [rewrite.adaptive(60, s) for s in (3, 10, 20, 50, 90)] == [0, 21, 30, 60, 78]


def test_humanize_lowers_the_score_and_does_not_depend_on_partitions(spark):
    casual = "So I tried that new ramen place yesterday with Dana. Honestly? Not great! The broth was kinda bland... We waited 40 minutes. I don't think I'll go back, tbh. Dana liked her dumplings, though she's easy to please."
    docs = spark.createDataFrame([(1, MACHINE, "en"), (2, casual, "en"), (3, "", "en"), (4, None, None)], "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in rewrite.humanize(docs, seed=1).collect()}
    again = {r.doc_id: r for r in rewrite.humanize(docs.repartition(3), seed=1).collect()}
    assert got == again
    assert got[1].after < got[1].before and got[1].change_ratio <= 0.4 and all(x in got[1].rewritten for x in KEPT) and got[1].changes
    assert got[2].change_ratio < 0.12 and got[2].after <= got[2].before + 0.02 and got[3].rewritten == got[4].rewritten == ""
    assert got[1].before == DETECTOR["detect"].apply(docs.where("doc_id = 1")).first().ai_probability
    para = {r.doc_id: r for r in rewrite.paraphrased(docs, 0.8).collect()}
    assert para[1].change_ratio > 0 and para[4].rewritten == ""
    assert rewrite.toned(docs, "informal", 1.0).where("doc_id = 3").first().rewritten == ""


def test_lexicons_of_packs_drive_the_rewriters(spark):
    rows = spark.createDataFrame([("de", "bureaucratic", "nutzbar machen", ["nutzen"])], "lang string, category string, term string, alternatives array<string>").collect()
    out, log = rewrite.rewrite("Wir wollen es nutzbar machen, ja.", "de", 100, 1, rewrite.packed_lexicon(rows))
    assert out == "Wir wollen es nutzen, ja." and log


def chunk(name, body):
    return struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body))


def png(*texts, kind=b"tEXt"):
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 1, 1, 8, 6, 0, 0, 0)) + b"".join(chunk(kind, t) for t in texts) + chunk(b"IDAT", zlib.compress(b"\0" * 5)) + chunk(b"IEND", b"")


def jpeg(body):
    return b"\xff\xd8\xff\xe0\x00\x04ab\xff\xe1" + struct.pack(">H", len(body) + 2) + body + b"\xff\xda\x00\x03\x01\x11\x22\x33\xff\xd9"


XMP = b'http://ns.adobe.com/xap/1.0/\0<x DigitalSourceType="http://cv.iptc.org/newscodes/digitalsourcetype/trainedAlgorithmicMedia"/>'
MADE = [
    png(b"parameters\0Stable Diffusion, steps: 20, sampler: Euler"), png(b'workflow\0{"nodes":[{"class_type":"KSampler"}]}'), png(b'prompt\0{"3":{"class_type":"KSampler"}}'), png(b'invokeai_metadata\0{"model":"sdxl"}'),
    png(b'sui_image_params\0{"prompt":"x"}'), png(b"Comment\0a cat, steps: 30, sampler: Euler a, cfg scale: 7"), jpeg(XMP), png(b"parameters\0\0" + zlib.compress(b"steps: 1"), kind=b"zTXt"),
]
NOT_SAID = [png(), png(b"Description\0Family photo from our trip to the lake, summer 2019"), png(b"Title\0Sunset"), png(b"Comment\0Shot on a camera, edited later"), png(b"Software\0An editor 26.0"), png(b"prompt\0What did you see?"), jpeg(b"Exif\0\0x"), b"", None, b"\x89PNG", png()[:20] + b"\xff" * 9, b"garbage" * 9]


def test_origin_of_media(spark):
    files = [(f"a{k}", x) for k, x in enumerate(MADE)] + [(f"b{k}", x) for k, x in enumerate(NOT_SAID)]
    got = {r.path: r for r in media.media_scan(spark.createDataFrame([(p, None if x is None else bytearray(x)) for p, x in files], "path string, content binary")).collect()}
    assert all(r.is_ai is True and r.provenance == "ai" and r.confidence >= 0.9 and r.signals for p, r in got.items() if p[0] == "a")
    assert all(r.is_ai is None and r.provenance == "none" and r.confidence == 0 and not r.signals for p, r in got.items() if p[0] == "b")
    assert got["a0"].generator == "Stable Diffusion" and got["a6"].kind == "jpeg" and got["b7"].kind == "other"


def test_media_without_metadata(spark):
    made = [(f"{k}", bytearray(x)) for k, x in enumerate(MADE)]
    clean = media.media_clean(spark.createDataFrame(made, "path string, content binary"))
    assert clean.where("removed = 0").count() == 0 and media.media_scan(clean).where("is_ai").count() == 0
    out, n = media.cleaned(MADE[0])
    assert n == 1 and out == png()
    assert media.cleaned(png()) == (png(), 0) and media.cleaned(None) == (b"", 0) and media.cleaned(b"\x89PNG\r\n\x1a\n\0\0") == (b"\x89PNG\r\n\x1a\n\0\0", 0)
    out, n = media.cleaned(MADE[6])
    assert n == 1 and out == b"\xff\xd8\xff\xe0\x00\x04ab\xff\xda\x00\x03\x01\x11\x22\x33\xff\xd9"
    webp = b"RIFF" + struct.pack("<I", 4 + 8 + 4 + 8 + 4) + b"WEBP" + b"VP8 " + struct.pack("<I", 4) + b"abcd" + b"XMP " + struct.pack("<I", 4) + b"meta"
    out, n = media.cleaned(webp)
    assert n == 1 and struct.unpack("<I", out[4:8])[0] == len(out) - 8 and b"meta" not in out
