"""Operators of the subpackage against brute force, on small tables with nulls, empty and long texts, ties and repeats."""

import math
import random
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from textloom.llm import decontaminate, importance, jaccard_join, language_id, packing, pii, ppm, secrets, toxicity
from textloom.llm.common import remainder, words_of

VOCABULARY = [a + b for a in "ka lo mi ne pu ra si to vu we".split() for b in "ba ce di fo gu".split()]


def sentence(rng, n):
    return " ".join(rng.choice(VOCABULARY) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    out = [sentence(rng, rng.randint(1, 60)) for _ in range(60)]
    base = sentence(rng, 80).split()
    for k in range(15):  # near copies: a word or two changed
        copy = list(base)
        copy[5 * k % 80] = "changed"
        out.append(" ".join(copy))
    out += [out[0]] * 4 + [None, "", "   ", "one", "one two", "One TWO", "é ü", sentence(rng, 4000)]
    return out


@pytest.fixture(scope="module")
def docs(spark, texts):
    """With columns whose names the operators use inside."""
    return spark.createDataFrame([(k, t, "x", 1, "y") for k, t in enumerate(texts)], "doc_id long, text string, fp string, chunk int, component_id string").repartition(5)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string")


def components(sets, num, den):
    parent = {k: k for k in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i in ids:
        for j in ids:
            if i < j and sets[i] and sets[j]:
                both = len(sets[i] & sets[j])
                if den * both >= num * (len(sets[i]) + len(sets[j]) - both):
                    a, b = sorted((find(i), find(j)))
                    parent[b] = a
    return {k: find(k) for k in ids}


@pytest.mark.parametrize("n, num, den", [(3, 9, 10), (5, 4, 5)])
def test_jaccard_join(docs, texts, n, num, den):
    got = {r.doc_id: r for r in jaccard_join.jaccard_components(docs, n, Fraction(num, den), per_chunk=500).collect()}
    sets = {}
    for k, t in enumerate(texts):
        w = words_of(t)
        sets[k] = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()
    want = components(sets, num, den)
    assert {k: r.n_shingles for k, r in got.items()} == {k: len(s) for k, s in sets.items()}
    assert {k: r.component_id for k, r in got.items()} == want


def test_jaccard_join_of_null_ids_and_no_rows(spark, empty):
    rows = spark.createDataFrame([(None, "a b c d"), (1, "a b c d"), (1, "a b c d"), (2, "a b c d")], "doc_id long, text string")
    got = sorted((str(r.doc_id), str(r.component_id)) for r in jaccard_join.jaccard_components(rows, 3, 0.9).collect())
    assert got == [("1", "1"), ("1", "1"), ("2", "1"), ("None", "None")]
    assert jaccard_join.jaccard_components(empty, 3, 0.9).count() == 0


def test_packing_round_trip(docs, texts, empty):
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    tk = Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    rows = packing.pack(docs).collect()
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    total = 0
    for k, t in enumerate(texts):
        ids = np.array([*tk.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        total += len(ids)
        own = sorted(pieces[k], key=lambda r: r.piece)
        assert [r.piece for r in own] == list(range(len(own)))
        assert [r.start for r in own] == [0, *np.cumsum([r.length for r in own])[:-1].tolist()]
        assert sum(r.length for r in own) == len(ids) and all(r.length == 1024 for r in own[1:])
        assert all(zlib.crc32(ids[r.start : r.start + r.length].tobytes()) == r.ids_crc32 for r in own)
    for own in sequences.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 1024
    assert len(sequences) <= math.ceil(total / 1024) + 2
    assert packing.pack(empty).count() == 0


def test_encoder_agrees_with_its_tokenizer():
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = public.path("byte_bpe_50k.json")
    e, tk = packing.Encoder(path), Tokenizer.from_file(path)
    rng = random.Random(23)
    bits = ["a", " ", "  ", "\n", "\t", "it's", "'ll", "'LL", "x1", "12", "é", "ß", "日本", "😀", "\u00a0", "\u2003", "\u200b", "_", "--", "<|endoftext|>", "<|endoftext", "|>", "İ", "½", "\u0301", "Ω", "#", "\x00", "\r\n", "word", " the", "…"]
    odd = ["a  b", " a b ", "a \n b\n\nc", "x y z", "it's  'tis <|endoftext|> ok", "", " ", "\n", "tab\t b", "日本 語 😀 x", "<|endoftext|>", "a <|endoftext|> b"]
    odd += ["".join(rng.choice(bits) for _ in range(rng.randint(0, 24))) for _ in range(4000)]
    want = [np.array(tk.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in odd]
    assert e.encode(odd) == want
    assert 50256 in np.frombuffer(e.encode(["a <|endoftext|> b"])[0], "<u4")


def test_plans_use_each_piece_once_and_are_no_worse_than_best_fit():
    rng = np.random.default_rng(1)
    for size, n in [(64, 400), (64, 40), (256, 1000), (1024, 2000), (64, 1), (64, 0)] * 3:
        counts = np.bincount(np.minimum(rng.integers(1, size, n), rng.integers(1, size, n)), minlength=size)[:size]
        plan = packing.plan_packing(counts, size)
        used = np.zeros(size, np.int64)
        for lengths, times in plan:
            assert sum(lengths) <= size
            for x in lengths:
                used[x] += times
        assert (used == counts).all()
        assert sum(k for _, k in plan) <= sum(k for _, k in packing._best_fit(counts.copy(), size))
        if n >= 400:  # most sequences come from the complements, not from the residuals
            assert sum(k for lengths, k in plan if sum(lengths) == size) > 0.5 * sum(k for _, k in plan)


def test_complements_of_one_two_and_three_lengths():
    for lengths in ((50, 14), (40, 14, 10), (30, 15, 12, 7)):
        counts = np.bincount(lengths, minlength=64)[:64] * 5
        assert packing.plan_packing(counts, 64) == [(lengths, 5)]


def test_secrets_against_an_ordinary_engine(spark):
    rng = random.Random(2)
    bits = ["token", "TOKEN", "passwd", "secret", "api_key", "ApiKey", " ", "=", ":", '"', "'", "AKIA", "A1B2C3D4E5F6G7", "deadbeef", "0123456789abcdef", "é", "x", "-", "\n", "abcdefghijklmnop", "ſ", "K"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 30))) for _ in range(500)] + [None, "", "f" * 50_000, "ghp_" + "a1" * 18]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in secrets.secret_digest(secrets.find_secrets(rows)).collect():
        spans, digest = secrets.brute_force(texts[r.doc_id])
        assert r.base_sha256 == digest
        assert [r.n_assign, r.n_access, r.n_hex] == [spans.count(k) for k in ("assign:", "access:", "hex:")]
        assert r.spans == secrets.brute_force(texts[r.doc_id], secrets.BASE_RULES + secrets.MORE_RULES)[0]


def test_language_identification(spark):
    rng = random.Random(4)
    words = {"aa": VOCABULARY[:25], "bb": VOCABULARY[25:]}
    rows = [(k, " ".join(rng.choice(words[x]) for _ in range(rng.randint(3, 60))), x) for k in range(200) for x in ["aa" if k % 2 else "bb"]]
    docs = spark.createDataFrame([*rows, (900, None, "aa"), (901, "123 !!", None), (902, "", None)], "doc_id long, text string, lang string")
    model = language_id.learn_languages(docs, remainder("doc_id", 5) != 0)
    got = {r.doc_id: r for r in language_id.identify_languages(docs, model).collect()}
    assert [got[k].lang_pred for k in (900, 901, 902)] == ["und"] * 3
    assert sum(got[k].lang_pred == x for k, _, x in rows) >= 196
    assert all(0 <= r.score <= 1 for r in got.values())
    assert language_id.identify_languages(docs, language_id.Languages({})).where("lang_pred <> 'und'").count() == 0


def test_scores_of_both_language_models(docs, texts, empty):
    got = {r.doc_id: r for r in ppm.lm_scores(docs, remainder("doc_id", 7) != 2, chunk_bytes=4000, fan_in=3).collect()}
    train = [k for k in range(len(texts)) if zlib.crc32(str(k).encode()) % 7 != 2]
    counts, model = Counter(), ppm.AdaptivePPM()
    for k in train:
        counts.update([*words_of(texts[k]), None])
        model.learn(texts[k] or "")
    total, kinds = sum(counts.values()), len(counts)
    for k, t in enumerate(texts):
        tokens = [*words_of(t), None]
        assert got[k].n_tokens == len(tokens) and got[k].train_tokens == total
        assert got[k].n_known == sum(counts[w] > 0 for w in tokens)
        assert got[k].base_score == pytest.approx(sum(math.log10((counts[w] + 1) / (total + kinds + 1)) for w in tokens))
        if len(t or "") < 2000:
            assert got[k].score == pytest.approx(model.score(t or ""), rel=1e-9)
    assert ppm.lm_scores(empty, F.lit(True)).count() == 0


def test_adaptive_model_is_a_distribution():
    m = ppm.AdaptivePPM(2)
    m.learn("abracadabra")
    assert sum(10 ** m.log10((97, 98), x) for x in range(ppm.SYMBOLS)) <= 1 + 1e-9
    assert m.score("abracadabra") > m.score("zzzzzzzzzzz")
    assert ppm.AdaptivePPM(2).score("abababababab", adapt=True) > ppm.AdaptivePPM(2).score("abababababab")


def test_importance_resampling(spark):
    rng = random.Random(5)
    good = [sentence(rng, 40) for _ in range(120)]
    bad = [" ".join(rng.choice(["###", "$$$", "%%%"]) for _ in range(40)) for _ in range(30)]
    texts = [*good, *bad, None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k < 120), 0) for k in range(0, 150, 2)], "doc_id long, quality int, toxic int")
    chosen = {r.doc_id: r for r in importance.resample(docs, importance.fit(docs, labels)).collect()}
    assert all(chosen[k].selected for k in range(120)) and not any(chosen[k].selected for k in range(120, 150))
    assert chosen[150].weight == chosen[151].weight == 0
    w = importance.Weights(np.zeros(importance.BINS), -math.inf)
    top = importance.resample(docs, w, keep=40)
    rows = sorted((r.score for r in top.collect()), reverse=True)
    assert sorted((r.score for r in top.where("selected").collect()), reverse=True) == rows[:40]
    assert importance.resample(docs.where("false"), w).count() == 0


def brute_align(a, b):
    h = np.zeros((len(a) + 1, len(b) + 1), int)
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            h[i, j] = max(0, h[i - 1, j - 1] + (2 if a[i - 1] == b[j - 1] else -1), h[i - 1, j] - 1, h[i, j - 1] - 1)
    return int(h.max())


def test_alignment_against_the_full_table():
    rng = np.random.default_rng(6)
    for _ in range(40):
        a, b = rng.integers(0, 4, rng.integers(1, 12)), rng.integers(0, 4, rng.integers(1, 20))
        score, start, end = decontaminate.align(a, b)
        assert score == brute_align(a, b) and 0 <= start <= end <= len(b)


def test_decontamination(spark):
    rng = random.Random(7)
    items = [(k, sentence(rng, 30)) for k in range(6)]
    edited = items[1][1].split()
    edited[7:9] = ["edited"]
    edited.insert(15, "more")
    docs = [(0, "Before. " + items[0][1].upper() + " after"), (1, sentence(rng, 20) + " " + " ".join(edited)), (2, sentence(rng, 200)), (3, None), (4, ""), (5, items[2][1]), (5, items[2][1])]
    docs = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame([*items, (9, None), (10, "short")], "item_id long, text string")
    want = [(0, 0), (1, 1), (5, 2), (5, 2)]
    assert decontaminate.contamination(docs.where("false"), bench).count() == 0
    for size in (4 << 20, 300):  # one block, and several
        got = decontaminate.contamination(docs, bench, block_bytes=size).collect()
        assert sorted((r.doc_id, r.item_id) for r in got) == want
        assert all(0.6 <= r.similarity <= 1 for r in got)
    assert decontaminate.contamination(docs, bench.where("false")).count() == 0


def test_alignment_says_where_it_starts_and_ends():
    item = np.arange(10)
    assert decontaminate.align(item, np.r_[50, 51, item, 52]) == (20, 2, 12)
    assert decontaminate.align(item, np.r_[50, item[:5], 60, item[5:], 52]) == (19, 1, 12)
    long = np.arange(6000)
    assert decontaminate.align(long, np.r_[long[:3000], 9999, long[3000:]]) == (11999, 0, 6001)


def test_decontamination_against_all_alignments(spark):
    rng = random.Random(27)
    few = VOCABULARY[:14]  # so few words that chance matches are many
    items = [(k, " ".join(rng.choice(few) for _ in range(n))) for k, n in enumerate([1, 2, 3, 4, 5, 7, 9, 10, 12, 20, 33])]

    def damaged(words, kind, every):
        out = []
        for k, w in enumerate(words):
            hit = k % every == every - 1
            if not (kind == "drop" and hit):
                out.append("new" if kind == "swap" and hit else w)
            if kind == "add" and hit:
                out.append("new")
        return out

    texts = [sentence(rng, 30), None, "", " ".join(rng.choice(few) for _ in range(120))]
    for _, t in items:
        for kind in ("swap", "add", "drop"):
            for every in (2, 3, 4, 6):
                texts.append(" ".join(["before", *damaged(t.split(), kind, every), "after"]))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {(r.doc_id, r.item_id): r.similarity for r in decontaminate.contamination(docs, spark.createDataFrame(items, "item_id long, text string")).collect()}
    want = {}
    for d, t in enumerate(texts):
        for i, item in items:
            a, b = decontaminate.plain_words(item), decontaminate.plain_words(t)
            number = {w: k for k, w in enumerate({*a, *b})}
            share = brute_align([number[w] for w in a], [number[w] for w in b]) / (2 * len(a))
            if share >= (0.6 if len(a) >= 4 else 1):
                want[d, i] = share
    assert got == pytest.approx(want)


def test_a_very_long_item_and_text(spark):
    rng = random.Random(28)
    words = sentence(rng, 6000).split()
    copy = [*words[:2500], "new", *words[2600:]]
    docs = spark.createDataFrame([(1, sentence(rng, 500) + " " + " ".join(copy)), (2, sentence(rng, 9000))], "doc_id long, text string")
    got = decontaminate.contamination(docs, spark.createDataFrame([(1, " ".join(words))], "item_id long, text string")).collect()
    assert [(r.doc_id, r.item_id) for r in got] == [(1, 1)] and got[0].similarity > 0.95


def test_an_item_in_many_documents_is_still_found_where_edited(spark):
    item = sentence(random.Random(17), 30)
    edited = item.split()
    edited[7] = edited[20] = "edited"  # breaks eight 4-grams, which 1500 exact copies make the rarest
    docs = spark.createDataFrame([*((k, item) for k in range(1500)), (5000, " ".join(edited))], "doc_id long, text string")
    got = decontaminate.contamination(docs, spark.createDataFrame([(1, item)], "item_id long, text string"))
    assert {r.doc_id for r in got.collect()} == {*range(1500), 5000}


def test_surrogates(spark):
    rows = [
        (1, "Mail bob.x@mail7.example.com or Bob.X@mail7.example.com, 97.51.17.173, +1 (017) 555-7713, 4929348385146306 and 4929-3483-8514-6306."),
        (2, "Mr. Smith met Mary Jones; ask ann@mail7.example.com, Herr Smith or Dr. Иван Петров."), (3, None), (4, ""),
        (5, "Clean text, 3 words. token24be64439e3e49cf46b2d7c90f3602a3"), (6, "again bob.x@mail7.example.com"), (6, "again bob.x@mail7.example.com"),
    ]
    docs = spark.createDataFrame([(*r, 1, "z") for r in rows], "doc_id long, text string, pos int, mention string")
    out = pii.replace_pii(docs)
    assert out.columns == [*docs.columns, "n_entities"]
    got = {r.doc_id: r for r in out.collect()}
    assert [got[k].text for k in (3, 4, 5)] == [rows[2][1], rows[3][1], rows[4][1]] and got[5].n_entities == 0
    joined = " ".join(got[k].text for k in (1, 2, 6))
    assert not any(x in joined for x in ("bob", "Bob", "ann@", "97.51", "555-7713", "4929348", "4929-3483", "Smith", "Mary", "Jones", "Иван", "Петров"))
    one = got[1].text.replace(",", "").split()
    assert one[1] == one[3] == got[6].text.split()[1]  # coreference
    assert got[2].text.split("ask ")[1].split(",")[0].split("@")[1] == one[1].split("@")[1]  # same domain
    card = [w for w in one if w.isdigit() and len(w) == 16][0]
    assert one[-1].rstrip(".").replace("-", "") == card and card[0] == "4" and one[-1].count("-") == 3
    assert got[1].text.count("(") == 1 and pii.replace_pii(docs, key="other").where("doc_id = 6").first().text != got[6].text
    assert got[2].text.startswith("Mr. ") and got[2].text.split()[1].rstrip(";") == got[2].text.split("Herr ")[1].split()[0]
    assert any(n in got[2].text for n in pii.GIVEN["latin", "f"])


def test_people_are_replaced_wherever_the_text_names_them(spark):
    rows = [
        (1, "John Smith wrote. Later John said hello to Alice Brown and John left. SMITH stayed, Smithson too."),
        (2, "My name is Zorba Greekson. Zorba is here; then Kwame Mensah said no."),
        (3, "Mr. O'Brien met John F. Kennedy and Mary-Ann Jones."), (4, "Иван Петров пришёл. Петров ушёл."), (5, "Smith and John alone are no names here"),
    ]
    docs = spark.createDataFrame([(*r, 1, "a", "b", "c") for r in rows], "doc_id long, text string, __key int, new string, same_text string, pieces string")
    out = pii.replace_pii(docs)
    assert out.columns == [*docs.columns, "n_entities"] and out.select("__key", "new", "same_text", "pieces").distinct().collect() == [(1, "a", "b", "c")]
    got = {r.doc_id: r for r in out.collect()}
    for k, names in ((1, "John Smith Alice Brown SMITH"), (2, "Zorba Greekson Kwame Mensah"), (3, "O'Brien John Kennedy Mary Ann Jones"), (4, "Иван Петров Петров")):
        words = set(got[k].text.replace(".", "").replace(";", "").replace(",", "").replace("-", " ").split())
        assert not words & set(names.split()), (k, got[k].text)
    first = got[1].text.split()
    assert first[0] == first[4] == first[11] and first[1].upper() == first[13] and "Smithson" in got[1].text
    assert got[1].text.split()[0] in pii.GIVEN["latin", "m"] and got[5].text == rows[4][1] and got[5].n_entities == 0
    assert got[1].n_entities == 7 and len(got[4].text.split()) == 5


def test_surrogates_of_very_long_texts_of_no_rows_and_of_marks(spark):
    long = "word " * 20_000 + "ask a.b@c.org now " + "word " * 20_000 + "10.1.2.3"
    mark = pii._MARK
    docs = spark.createDataFrame([(1, long), (2, f"x {mark} a.b@c.org {mark}y 10.1.2.3"), (3, "a.b@c.org")], "doc_id long, text string")
    got = {r.doc_id: r for r in pii.replace_pii(docs).collect()}
    assert got[1].n_entities == got[2].n_entities == 2 and len(got[1].text.split()) == len(long.split())
    assert got[2].text.startswith(f"x {mark} {got[3].text} {mark}y 2")
    assert pii.replace_pii(docs.where("false")).count() == 0


def test_given_names_are_permuted_by_the_key(spark):
    names = [n for group in pii.GIVEN.values() for n in group]
    docs = spark.createDataFrame([(k, f"{n} Smith") for k, n in enumerate(names)], "doc_id long, text string")
    got = [{r.doc_id: r.text.split()[0] for r in pii.replace_pii(docs, key=key).collect()} for key in ("one", "two")]
    for told in got:
        assert sorted(told.values()) == sorted(names) and all(told[k] != n for k, n in enumerate(names))
    assert sum(got[0][k] != got[1][k] for k in got[0]) > len(names) // 2


def test_distinct_entities_stay_distinct(spark):
    rows = [(k, f"Mr. X{chr(97 + k // 26)}{chr(97 + k % 26)} {k % 200}.{k}.7.{k % 91}".replace(f".{k}.", f".{k % 256}.")) for k in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.text for r in pii.replace_pii(docs).collect()}
    names, addresses = {}, {}
    for k, t in rows:
        names.setdefault(t.split()[1], set()).add(got[k].split()[1])
        addresses.setdefault(t.split()[2], set()).add(got[k].split()[2])
    for table in (names, addresses):
        assert all(len(x) == 1 for x in table.values())
        assert len({next(iter(x)) for x in table.values()}) == len(table)


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_levenshtein_automaton_against_edit_distance():
    rng = random.Random(8)
    terms = {w: 1.0 for w in ("idiot", "idle", "moron", "worthless", "disgusting", "bad")}
    a = toxicity.LexiconAutomaton(terms)
    for _ in range(3000):
        w = list(rng.choice(list(terms)))
        for _ in range(rng.randint(0, 4)):
            k = rng.randrange(len(w) + 1)
            w[k : k + rng.randint(0, 1)] = rng.choice(["", "a", "o", "z"])
        w = "".join(w)
        near = [(edits(w, t), t) for t in terms if edits(w, t) <= a.allowed(t)]
        assert a.find(w) == (min(near)[::-1] if near else None)


def test_toxicity(spark):
    rng = random.Random(9)
    bad = ["vileword", "uglyterm"]
    rows = []
    for k in range(300):
        w = sentence(rng, 30).split()
        if k % 3 == 0:
            w[10], w[20] = rng.choice(bad), rng.choice(bad)
        rows.append((k, " ".join(w)))
    rows += [(900, "kaba uglytern vi1eword loce"), (901, None), (902, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(k, 1, int(k % 3 == 0)) for k in range(300)], "doc_id long, quality int, toxic int")
    model = toxicity.learn_toxicity(docs, labels, remainder("doc_id", 5) != 0)
    got = {r.doc_id: r for r in toxicity.score_toxicity(docs, model).collect()}
    assert all(got[k].predicted == int(k % 3 == 0) for k in range(300))
    assert got[900].predicted == 1 and got[901].score == got[902].score < 0.5
    spoken, quoted = "kaba vileword loce miba", 'she said the word "vileword" loce miba'
    assert model.features(spoken)[0] > 0 and model.features(quoted)[0] == 0 < model.features(quoted)[1]


def test_an_ordinary_word_near_a_term_does_not_veto_its_misspellings(spark):
    rng = random.Random(19)
    rows = []
    for k in range(400):
        w = sentence(rng, 30).split()
        if k % 4 == 0:
            w[10] = w[20] = "vileword"
            if k % 40 == 0:
                w[15] = "uglyterm"  # in 10 of 100 toxic texts
        else:
            w[12] = "vilewor"
        rows.append((k, " ".join(w)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(k, 1, int(k % 4 == 0)) for k in range(400)], "doc_id long, quality int, toxic int")
    model = toxicity.learn_toxicity(docs, labels, remainder("doc_id", 1) == 0, edit_share=0.3)
    hit = lambda word: model.features(f"kaba {word} loce miba")[0]
    assert hit("vilewor") == 0
    assert hit("vileword") > hit("vilewword") > 0 and hit("vilewerd") > 0
    assert hit("uglyterm") > hit("uglytterm") > 0
    assert hit("vilewword") / hit("vileword") > hit("uglytterm") / hit("uglyterm")


def test_windows_part_quotation_reporting_and_negation_from_abuse(spark):
    m = toxicity.Toxicity({"vileword": 3.0}, np.array([1.0, -1.0, 0.0, 0.0]), -1.0)
    plain_use = ["you vileword there", "you are vileword now", '"hello there" vileword "bye now"', "he is vileword 'tis so"]
    mentioned = ["you are not vileword", "never vileword", 'she wrote "vileword" there', "il a dit vileword", "“some vileword here” is", "the word vileword", '"vileword"', "nie vileword", "pas vileword"]
    for t in plain_use:
        assert m.features(t)[0] > 0 == m.features(t)[1], t
    for t in mentioned:
        assert m.features(t)[1] > 0 == m.features(t)[0], t
    docs = spark.createDataFrame([(1, "a vilewird b"), (2, None), (3, ""), (1, "a vilewird b"), (None, "not vileword")], "doc_id long, text string")
    got = sorted((str(r.doc_id), r.found, r.place, r.edited, r.quoted) for r in toxicity.toxic_hits(docs, m).collect())
    assert got == [("1", "vilewird", 1, True, False)] * 2 + [("None", "vileword", 1, False, True)]


def test_toxicity_of_no_rows_long_texts_repeats_and_clashing_columns(spark, empty):
    m = toxicity.Toxicity({"vileword": 3.0}, np.array([2.0, 0.0, 0.0, 0.0]), -1.0)
    assert toxicity.score_toxicity(empty, m).count() == toxicity.toxic_hits(empty, m).count() == 0
    long = "kaba " * 60_000 + "vileword"
    docs = spark.createDataFrame([(1, long, 5.0, "x"), (1, long, 5.0, "x"), (2, "kaba", 5.0, "x")], "doc_id long, text string, score double, word string")
    got = sorted((r.doc_id, r.predicted) for r in toxicity.score_toxicity(docs, m).collect())
    assert got == [(1, 1), (1, 1), (2, 0)]
    nothing = toxicity.learn_toxicity(empty, spark.createDataFrame([], "doc_id long, quality int, toxic int"), F.lit(True))
    assert toxicity.score_toxicity(docs, nothing).agg(F.max("predicted")).first()[0] == 0


def test_languages_of_numbers_long_texts_ties_and_no_rows(spark, empty):
    rng = random.Random(14)
    long = " ".join(rng.choice(VOCABULARY[:25]) for _ in range(20_000))
    rows = [(1, long, "aa", 0.5), (2, " ".join(rng.choice(VOCABULARY[25:]) for _ in range(400)), "bb", 0.5), (3, "½ ²", None, 0.5), (4, "Ⅷ", None, 0.5), (5, long[:90_000], None, 0.5), (5, long[:90_000], None, 0.5), (None, "vuba weba tofo toce sidi vugu webe tora", None, 0.5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score double")
    model = language_id.learn_languages(docs, F.lit(True), longest=1000)
    assert set(model.samples) == {"aa", "bb"}
    got = sorted((str(r.doc_id), r.lang_pred) for r in language_id.identify_languages(docs, model).collect())
    assert got == [("1", "aa"), ("2", "bb"), ("3", "und"), ("4", "und"), ("5", "aa"), ("5", "aa"), ("None", "bb")]
    tie = language_id.Languages({"b": b"same words here", "a": b"same words here"})
    assert tie.predict("same", 0.01)[0] == "a"
    assert language_id.identify_languages(empty, model).count() == 0


def test_secrets_of_no_rows_repeats_and_clashing_columns(spark, empty):
    assert secrets.secret_digest(secrets.find_secrets(empty)).count() == 0
    docs = spark.createDataFrame([(1, "token = abcdefghijklmnop", "x")] * 2 + [(None, "AKIA" + "A1" * 8, "x")], "doc_id long, text string, spans string")
    got = sorted((str(r.doc_id), r.n_assign, r.n_access) for r in secrets.secret_digest(secrets.find_secrets(docs)).collect())
    assert got == [("1", 1, 0), ("1", 1, 0), ("None", 0, 1)]


def test_resampling_parts_held_out_good_from_bad_and_takes_odd_rows(spark):
    rng = random.Random(15)
    rows = [(k, sentence(rng, 30) if k % 3 else " ".join(rng.choice(["###", "$$$", "%%%"]) for _ in range(30))) for k in range(300)]
    docs = spark.createDataFrame([(*r, 1.0, 2) for r in [*rows, (1, rows[1][1]), (None, rows[2][1]), (900, sentence(rng, 30_000))]], "doc_id long, text string, weight double, bin int")
    labels = spark.createDataFrame([(k, int(k % 3 > 0), 0) for k in range(0, 300, 2)], "doc_id long, quality int, toxic int")
    w = importance.fit(docs, labels)
    got = importance.resample(docs, w).collect()
    held_out = [r for r in got if r.doc_id is not None and r.doc_id % 2 and r.doc_id < 300]
    assert all(r.selected == bool(r.doc_id % 3) for r in held_out)
    twice = [r for r in got if r.doc_id == 1]
    assert len(twice) == 2 and twice[0] == twice[1] and next(r for r in got if r.doc_id is None).selected and all(math.isfinite(r.weight) for r in got)
    raw, good = Counter(), Counter()  # the weights by hand
    for k, t in [*rows, (1, rows[1][1]), (None, rows[2][1])]:
        n = Counter(importance.features(t, importance.WordHash()).tolist())
        raw += n
        good += n if k is not None and k % 2 == 0 and k % 3 else Counter()
    at = rows[2][1]
    by_hand = sum(math.log((good[b] + 0.05) / (good.total() + 0.05 * importance.BINS)) for b in importance.features(at, importance.WordHash()).tolist())
    raw_all = importance.features(docs.where("doc_id = 900").first().text, importance.WordHash())
    raw += Counter(raw_all.tolist())
    by_hand -= sum(math.log((raw[b] + 0.05) / (raw.total() + 0.05 * importance.BINS)) for b in importance.features(at, importance.WordHash()).tolist())
    assert next(r.weight for r in got if r.doc_id == 2) == pytest.approx(by_hand)
