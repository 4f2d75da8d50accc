"""Surrogates for personal data, with DataFrame functions only.

One expression finds mentions; each has a kind and a canonical form (case, spaces and marks do not matter). A keyed digest of the
canonical form gives the surrogate: an e-mail address in example.org whose domain follows the domain, an address of a
block that is never routed, digits that keep issuer, country and check digit, a coined name of the same script, a given
name of the same gender. The dictionary of distinct entities is checked as a whole: where two would share a surrogate, or
a surrogate is an original, the later one draws again. Each mention then takes its entity's surrogate in its own format,
and so does every later mention of a part of a person's name in the same text.

People are found by a given name before a surname, by a title, by words of introduction ("my name is") and by verbs of
speech after two capitalised words inside a sentence; a name that none of these announces is not found.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.llm.common import free_names, materialize

#: Given names by script and gender, titles, words around names, and syllables for coined names.
GIVEN = {
    ("latin", "m"): """James John Robert Michael William David Richard Thomas Daniel Peter Hans Karl Klaus Jean Pierre Louis Carlos Juan Miguel
Antonio Charles Joseph Matthew Anthony Steven Paul Andrew Joshua Kenneth Kevin Brian George Edward Ronald Timothy Jason Jeffrey Ryan
Jacob Stefan Jürgen Wolfgang Dieter Matthias François Philippe Nicolas Olivier José Pedro Javier Fernando""".split(),
    ("latin", "f"): """Mary Patricia Jennifer Linda Elizabeth Susan Jessica Sarah Karen Emma Anna Ursula Heike Marie Claire Sophie Carmen Lucia
Isabel Rosa Alice Nancy Lisa Margaret Betty Sandra Ashley Kimberly Emily Donna Michelle Carol Amanda Melissa Deborah Stephanie Rebecca
Laura Helen Julia Sabine Petra Monika Renate Nathalie Isabelle Françoise María Ana Elena Pilar""".split(),
    ("cyrillic", "m"): "Иван Пётр Сергей Алексей Дмитрий Николай Андрей Михаил Владимир Александр Юрий Олег".split(),
    ("cyrillic", "f"): "Анна Мария Елена Ольга Наталья Татьяна Ирина Светлана Екатерина Людмила Галина Юлия".split(),
}
TITLES = "Mr Mrs Ms Miss Dr Prof Herr Frau Monsieur Madame Mme Señor Señora Sra".split()
INTRODUCED = ["my name is", "My name is", "Sincerely,", "Best regards,", "Kind regards,", "je m'appelle", "Je m'appelle", "ich heiße", "Ich heiße", "me llamo", "Me llamo", "меня зовут", "Меня зовут"]
SPEECH = "said says wrote writes asked replied told sagte schrieb dijo escribió".split()
SYLLABLES = {
    "latin": "ba be bo da de do fa fe fo ga ge go ka ke ko la le lo ma me mo na ne no pa pe po ra re ro".split(),
    "cyrillic": "ба бе бо да де до га ге го ка ке ко ла ле ло ма ме мо на не но па пе по ра ре ро та те".split(),
}

_GIVEN = "|".join(n for names in GIVEN.values() for n in names)
_TITLE = "|".join(TITLES)
_INTRO = "|".join(x.replace("'", r"\x27") for x in INTRODUCED)
_WORD = r"(?:\p{Lu}\p{Ll}{1,30}(?:-\p{Lu}\p{Ll}{1,30})?|\p{Lu}[\x27’]\p{Lu}\p{Ll}{1,30})"
_JOINED = r"(?:-\p{Lu}\p{Ll}{1,30})?"
_WITHIN = r"[\p{Ll},] "
_INITIAL = r"(?:\p{Lu}\. )?"
_EDGE = r"(?<![\p{L}\p{N}_])"
_STOP = r"(?![\p{L}\p{N}_])"
_UPPER = r"(?=\p{Lu})"
_DIGIT = r"(?=\d)"
_SPOKE = rf"(?= (?:{'|'.join(SPEECH)}){_STOP})"
_IP = r"(?:\d{1,3}\.){3}\d{1,3}"
PARTS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}@(?:[A-Za-z0-9-]{1,63}\.){1,8}[A-Za-z]{2,24}",
    "ip": rf"{_DIGIT}(?<![\d.]){_IP}(?!\.?\d)",
    "phone": rf"(?=[+\d(])(?:(?<![\d+])\+\d{{1,3}}[ .-]?(?:\(\d{{2,4}}\)|\d{{2,4}})(?:[ .-]?\d{{2,4}}){{2,3}}(?!\d)|(?<![\p{{L}}\p{{N}}])(?:\(\d{{3}}\) ?|\d{{3}}[ .-])\d{{3}}[ .-]\d{{4}}(?!\d))",
    "ssn": rf"{_DIGIT}{_EDGE}\d{{3}}-\d{{2}}-\d{{4}}{_STOP}",
    "iban": rf"(?=[A-Z]{{2}}\d){_EDGE}[A-Z]{{2}}\d{{2}}(?: ?[A-Z0-9]{{4}}){{2,7}}(?: ?[A-Z0-9]{{1,4}})?{_STOP}",
    "card": rf"{_DIGIT}{_EDGE}\d(?:[ -]?\d){{12,18}}{_STOP}",
    "given": rf"{_UPPER}(?:{_EDGE}(?:{_GIVEN}){_JOINED}(?= {_INITIAL}{_WORD})|(?<={_EDGE}(?:{_TITLE})\.? )(?:{_GIVEN}){_JOINED}{_STOP})",
    "name": rf"{_UPPER}(?:(?<={_EDGE}(?:{_TITLE})\.? ){_WORD}|(?<={_EDGE}(?:{_TITLE})\.? {_WORD} ){_WORD}|(?<={_EDGE}(?:{_GIVEN}){_JOINED} {_INITIAL}){_WORD}|(?<={_EDGE}(?:{_INTRO})\s){_WORD}|(?<={_EDGE}(?:{_INTRO})\s{_WORD} ){_WORD}|(?<={_WITHIN}){_WORD}(?= {_WORD}{_SPOKE})|(?<={_WITHIN}{_WORD} ){_WORD}{_SPOKE})",
}
ENTITY = "|".join(PARTS.values())
#: A text without any of these has no entity.
_HINT = rf"[@\d]|{_UPPER}{_EDGE}(?:{_TITLE}|{_GIVEN}){_STOP}|{_UPPER}(?<={_WITHIN}){_WORD} {_WORD}{_SPOKE}|{_EDGE}(?:{_INTRO})\s"


def kind_of(m: Column) -> Column:
    digits = F.length(F.regexp_replace(m, r"\D", ""))
    return (
        F.when(F.contains(m, F.lit("@")), "email")
        .when(m.rlike(rf"^{_IP}$"), "ip")
        .when(m.rlike(r"^\d{3}-\d{2}-\d{4}$"), "ssn")
        .when(m.rlike(r"^[A-Z]{2}\d{2}"), "iban")
        .when(m.rlike(rf"^(?:{_GIVEN})$"), "given")
        .when(m.rlike(r"^\p{L}"), "name")
        .when(m.rlike(r"^\+|^\(") | (digits < 13), "phone")
        .otherwise("card")
    )


def canonical(m: Column, kind: Column) -> Column:
    return F.when(kind.isin("phone", "card", "ssn"), F.regexp_replace(m, r"\D", "")).when(kind == "ip", m).when(kind == "iban", F.regexp_replace(m, " ", "")).otherwise(F.lower(m))


def _pick(names: list[str], h: Column) -> Column:
    return F.element_at(F.array(*[F.lit(n) for n in names]), (F.pmod(h, F.lit(len(names))) + 1).cast("int"))


def _given_names(key: str) -> Column:
    """Given name -> another of its gender and script: the next in an order that the key's digests decide, so different
    names stay different, none stays itself, and without the key the order is not known."""
    pairs = []
    for names in GIVEN.values():
        order = sorted(names, key=lambda n: hashlib.sha256(f"{key}|given|{n}".encode()).digest())
        for n, other in zip(order, order[1:] + order[:1], strict=True):
            pairs += [F.lit(n.lower()), F.lit(other)]
    return F.create_map(*pairs)


def _luhn_sum(digits: str) -> str:
    """SQL: Luhn sum of a digit string to whose right one check digit stands."""
    d = f"try_cast(x as int) * (1 + pmod(length({digits}) - i, 2))"
    return f"aggregate(transform(split({digits}, ''), (x, i) -> {d} - case when {d} > 9 then 9 else 0 end), 0, (a, b) -> a + b)"


def _with_surrogate(entities: DataFrame, key: str) -> DataFrame:
    """kind, canon, attempt -> surrogate: digits, a name, or an address, before it takes a mention's format."""
    e = entities.withColumn("sha", F.sha2(F.concat_ws("|", F.lit(key), "kind", "canon", "attempt"), 256))
    e = e.withColumn("digits", F.translate("sha", "abcdef", "274906")).withColumn("h", F.conv(F.substring("sha", 1, 12), 16, 10).cast("long"))
    e = e.withColumn("n", F.length("canon"))
    domain = F.expr("substring_index(canon, '@', -1)")
    e = e.withColumn("email", F.concat(_pick([n.lower() for n in GIVEN["latin", "m"] + GIVEN["latin", "f"]], F.col("h")), F.lit("."), F.substring("sha", 13, 8), F.lit("@d"), F.substring(F.sha2(F.concat_ws("|", F.lit(key), domain), 256), 1, 6), F.lit(".example.org")))
    part = [F.pmod(F.conv(F.substring("sha", a, 4), 16, 10).cast("long"), F.lit(m)) for a, m in ((20, 15), (24, 256), (28, 256), (32, 254))]
    e = e.withColumn("ip", F.concat_ws(".", (part[0] + 240).cast("string"), part[1].cast("string"), part[2].cast("string"), (part[3] + 1).cast("string")))
    e = e.withColumn("phone", F.concat(F.expr("substring(canon, 1, greatest(n - 10, 0))"), F.expr("substring(digits, 1, least(n, 10))")))
    e = e.withColumn("body", F.concat(F.substring("canon", 1, 1), F.expr("substring(digits, 1, n - 2)")))
    e = e.withColumn("valid", F.expr(f"n > 1 and pmod({_luhn_sum('substring(canon, 1, n - 1)')} + try_cast(right(canon, 1) as int), 10) = 0") & (F.col("kind") == "card"))
    check = F.expr(f"cast(pmod(10 - pmod({_luhn_sum('body')}, 10), 10) as string)")
    e = e.withColumn("card", F.concat("body", F.when(F.col("valid"), check).otherwise(F.expr("substring(digits, n, 1)"))))
    e = e.withColumn("iban", F.concat(F.substring("canon", 1, 2), F.expr("array_join(transform(split(substring(canon, 3), ''), (x, i) -> case when x rlike '[0-9]' then substring(digits, i + 1, 1) else substring('ABCDEFGHJKLMNPQRSTUVWXYZ', 1 + pmod(ascii(substring(sha, i + 1, 1)) * 7 + i, 24), 1) end), '')")))
    coined = []
    for script in ("cyrillic", "latin"):
        array = "array(" + ", ".join(f"'{s}'" for s in SYLLABLES[script]) + ")"
        coined.append(F.expr(f"initcap(array_join(transform(sequence(0, 2 + attempt), i -> element_at({array}, cast(1 + pmod(conv(substring(sha, 1 + 4 * i, 4), 16, 10), {len(SYLLABLES[script])}) as int))), ''))"))
    e = e.withColumn("name", F.when(F.col("canon").rlike(r"\p{IsCyrillic}"), coined[0]).otherwise(coined[1]))
    e = e.withColumn("given", F.element_at(_given_names(key), F.col("canon")))
    pick = F.when(F.lit(False), F.lit(""))
    for k in ("email", "ip", "phone", "card", "iban", "name", "given"):
        pick = pick.when(F.col("kind") == k, F.col(k))
    pick = pick.when(F.col("kind") == "ssn", F.concat(F.lit("9"), F.expr("substring(digits, 1, 8)")))
    return e.select("kind", "canon", "attempt", pick.alias("surrogate"))


def dictionary(entities: DataFrame, key: str, rounds: int = 12) -> DataFrame:
    """Distinct kind and canon -> surrogate, different for different entities of a kind and never one of the originals."""
    originals = entities.select(F.col("kind").alias("o_kind"), F.lower("canon").alias("taken"), F.lit(1).alias("is_original")).distinct()
    now = entities.withColumn("attempt", F.lit(0))
    for _ in range(rounds):
        drawn = _with_surrogate(now, key).join(originals, F.expr("kind = o_kind and taken = lower(surrogate)"), "left").drop("o_kind", "taken")
        place = F.row_number().over(Window.partitionBy("kind", "surrogate").orderBy("attempt", "canon"))
        clash = (F.col("kind") != "given") & ((place > 1) | F.col("is_original").isNotNull())  # given names are a permutation
        checked = materialize(drawn.withColumn("clash", clash).drop("is_original"), "entities")
        if not checked.where("clash").take(1):
            return checked.select("kind", "canon", "surrogate")
        now = checked.select("kind", "canon", (F.col("attempt") + F.col("clash").cast("int")).alias("attempt"))
    raise RuntimeError("no free surrogates are left for some kind of entity")


def _formatted(mention: str, surrogate: str) -> str:
    """SQL: the surrogate in the format of a mention: its marks between digits, its case."""
    fill = f"""aggregate(split({mention}, ''), struct('' as t, 1 as i), (a, c) -> case when c rlike '[0-9A-Za-z]' then struct(concat(a.t, substring({surrogate}, a.i, 1)) as t, a.i + 1 as i) else struct(concat(a.t, c) as t, a.i as i) end, a -> a.t)"""
    return f"""case when kind in ('phone', 'card', 'ssn', 'iban') then {fill}
      when {mention} = upper({mention}) and kind in ('email', 'name') and {mention} <> lower({mention}) then upper({surrogate}) else {surrogate} end"""


#: Fixed value: what stands around mentions once they are found. Texts that hold it are cut by a second search instead.
_MARK = "\uE000\u0001\uE000"


def _later(piece: str, parts: str) -> str:
    """SQL: a stretch between mentions, with the words that are parts of found names replaced; capitals stay capitals."""
    edge, stop = _EDGE.replace("\\", "\\\\"), _STOP.replace("\\", "\\\\")
    once = lambda x, old, new: f"regexp_replace({x}, concat('{edge}', {old}, '{stop}'), {new})"
    return f"aggregate({parts}, {piece}, (t, p) -> {once(once('t', 'p.old', 'p.new'), 'upper(p.old)', 'upper(p.new)')})"


def replace_pii(docs: DataFrame, key: str = "textloom", text_col: str = "text") -> DataFrame:
    """docs with surrogates in its text column, and n_entities (bigint) added or replaced; other columns stay.

    Equal entities get equal surrogates in all rows, different ones different surrogates. n_entities counts mentions, and
    later mentions of parts of names in the same text. A null text stays null and an empty one empty, with 0 entities;
    repeated rows get equal results; the length of a text is not limited. Texts without entities are unchanged, no rows
    give no rows, and columns of any name are kept. The key decides the surrogates; without it they do not lead back."""
    names = [c for c in docs.columns if c.lower() != "n_entities"]
    base = docs.select(*[F.col(f"`{c}`") for c in names])
    same, pieces, new, parts = free_names([*names, "n_entities"], "same_text", "pieces", "new", "parts")
    text = F.col(f"`{text_col}`")
    hint = F.coalesce(text.rlike(_HINT), F.lit(False))
    plain = base.where(~hint).withColumn("n_entities", F.lit(0).cast("long"))
    #: mentions are the pieces at odd places
    cut = f"""case when contains(`{text_col}`, '{_MARK}')
      then flatten(zip_with(split(`{text_col}`, {_sql_text(ENTITY)}, -1), regexp_extract_all(`{text_col}`, {_sql_text(ENTITY)}, 0), (a, b) -> case when b is null then array(a) else array(a, b) end))
      else split(regexp_replace(`{text_col}`, {_sql_text(ENTITY)}, '{_MARK}$0{_MARK}'), '{_MARK}', -1) end"""
    marked = materialize(base.where(hint).withColumn(same, F.sha2(text, 256)).withColumn(pieces, F.expr(cut)).drop(text_col), "marked")
    odd = F.expr(f"transform(filter(sequence(0, greatest(size({pieces}) - 1, 0)), i -> i % 2 = 1), i -> {pieces}[i])")
    mentions = marked.where(F.size(pieces) > 1).select(F.col(same).alias("same"), F.posexplode(odd).alias("pos", "mention")).distinct()
    mentions = mentions.withColumn("kind", kind_of(F.col("mention"))).withColumn("canon", canonical(F.col("mention"), F.col("kind")))
    mentions = materialize(mentions, "mentions")
    known = dictionary(mentions.select("kind", "canon").distinct(), key)
    told = mentions.join(known, ["kind", "canon"]).select("same", "pos", "kind", "mention", "surrogate", F.expr(_formatted("mention", "surrogate")).alias("new"))
    of_name = F.when(F.col("kind").isin("name", "given") & F.col("mention").rlike(r"\p{Ll}"), F.struct(F.col("mention").alias("old"), F.col("surrogate").alias("new")))
    by_text = told.groupBy("same").agg(F.array_sort(F.collect_list(F.struct("pos", "new"))).alias("n"), F.array_sort(F.collect_set(of_name)).alias("p"))
    by_text = by_text.select(F.col("same").alias(same), F.col("n.new").alias(new), F.col("p").alias(parts))
    joined = marked.join(by_text, same, "left")
    even = f"transform(filter(sequence(0, greatest(size({pieces}) - 1, 0)), i -> i % 2 = 0), i -> {pieces}[i])"
    later = F.expr(f"case when size({parts}) > 0 then aggregate({parts}, 0L, (n, p) -> n + aggregate({even}, 0L, (m, t) -> m + regexp_count(t, concat('{_EDGE.replace(chr(92), chr(92) * 2)}(?:', p.old, '|', upper(p.old), '){_STOP.replace(chr(92), chr(92) * 2)}')))) else 0L end")
    rebuilt = F.expr(f"array_join(flatten(zip_with({even}, coalesce({new}, cast(array() as array<string>)), (s, r) -> array(case when size({parts}) > 0 then {_later('s', parts)} else s end, coalesce(r, '')))), '')")
    done = joined.withColumn(text_col, rebuilt).withColumn("n_entities", (F.coalesce(F.size(new), F.lit(0)) + later).cast("long"))
    return done.select(*[F.col(f"`{c}`") for c in names], "n_entities").unionByName(plain)


def _sql_text(pattern: str) -> str:
    return "r'" + pattern.replace("'", "\\x27") + "'"
