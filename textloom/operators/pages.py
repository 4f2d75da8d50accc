"""Pages: what their code shows, the platform that made them, and the report of a page.

Hints are read from the markup with expressions. A fingerprint is one row for each text that shows a platform, so the
rules meet the hints in joins on short lists that are broadcast: their size is fixed in the code. Everything about a page
is small; texts of blocks are scored in place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textloom.functions import sites
from textloom.functions.dialect import Spark, rounded
from textloom.operators import analysis, detector, signals
from textloom.operators.corpus import BLOCKS_SQL, page_blocks

_D = Spark()
#: Where the probability of a kind starts, how kinds rank, and what other evidence adds.
KIND_BASE = {"ai-builder": 0.9, "builder": 0.5, "ecommerce": 0.25, "cms": 0.16, "docs": 0.08, "framework": 0.1}
KIND_RANK = {"ai-builder": 4, "builder": 3, "ecommerce": 2, "cms": 1, "docs": 0, "framework": 0}
HANDCODED, IMAGES, TEXT_NUDGE, IMAGE_NUDGE, DEPLOY = 0.06, 0.85, 0.12, 0.08, 0.16
STACKS = {"shadcn": 0.34, "lucideGeist": 0.24, "shadcnTokens": 0.2, "aiGradient": 0.18, "radix": 0.1, "geist": 0.1}
TOKENS = ["bg-background", "text-foreground", "text-muted-foreground", "bg-card", "bg-muted"]
#: Ids of elements that are looked for.
KNOWN_IDS = "__next __nuxt ___gatsby __docusaurus gatsby-focus-wrapper __framer-badge-container lovable-badge base44-badge swup root app __astro".split()
#: The order in which the fields of a page are looked at, and whether a field is evidence enough alone.
FIELDS = {"generator": True, "hosts": False, "dataAttrs": True, "attrs": True, "classes": True, "paths": False, "fonts": True, "ids": True, "powered": True}
HINTS = "generator string, hosts array<string>, paths array<string>, attrs array<string>, dataAttrs array<string>, classes array<string>, ids array<string>, fonts string, aiGradient boolean, powered string, hostname string"


def fingerprints() -> list[tuple[int, str, str, str, str, str]]:
    """(order, id, name, kind, field, text) of all rules."""
    out = []
    for k, line in enumerate(sites.FINGERPRINTS.strip().split("\n")):
        id_, name, kind, fields = line.split(" | ")
        for part in fields.split("; "):
            field, texts = part.split(": ")
            out += [(k, id_, name, kind, field, t) for t in texts.split(", ")]
    return out


def subdomains() -> list[tuple[int, str, str, str]]:
    """(order, id, suffix, how the label before it begins)."""
    out = []
    for line in sites.SUBDOMAINS.strip().split("\n"):
        id_, suffixes, *prefix = line.split(" | ")
        out += [(id_, s, prefix[0] if prefix else "") for s in suffixes.split(", ")]
    return [(k, *row) for k, row in enumerate(out)]


def _rules(spark: SparkSession) -> DataFrame:
    return F.broadcast(spark.createDataFrame(fingerprints(), "ord int, id string, name string, kind string, field string, shows string"))


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/:?#]*)", 1))


def _tags(html: str, names: str, attribute: str) -> str:
    """SQL: values of an attribute of tags, in order, without quotes."""
    return f"regexp_extract_all({html}, r'(?is)<(?:{names})\\b[^>]*?\\s{attribute}\\s*=\\s*[\"\\x27]([^\"\\x27]*)[\"\\x27]', 1)"


def _hue(channels: str) -> str:
    """SQL: the hue in degrees of an array of red, green and blue (0 to 255), -1 for near greys."""
    r, g, b = (f"({channels}[{k}] / 255D)" for k in range(3))
    top, low = f"greatest({r}, {g}, {b})", f"least({r}, {g}, {b})"
    turn = f"case when {top} = {r} then ({g} - {b}) / ({top} - {low}) when {top} = {g} then ({b} - {r}) / ({top} - {low}) + 2 else ({r} - {g}) / ({top} - {low}) + 4 end"
    return f"case when {top} - {low} < 0.06 then -1D else pmod(60D * ({turn}), 360D) end"


def page_hints(pages: DataFrame) -> DataFrame:
    """What the markup of each page shows: page_id and the columns of HINTS.

    Of scripts and links the first 61 count, of images 25, of elements 1201; hosts and paths keep 60 each, attribute names
    80, class tokens 160; the footer's last 600 characters are its text (the page's where it has none). Colours are those
    of gradients written in the page; styles in files of their own are not read. Null markup shows nothing."""
    h = "html_"
    p = pages.select("page_id", F.coalesce("html", F.lit("")).alias(h), host_of(F.col("url")).alias("hostname"), F.coalesce("url", F.lit("")).alias("url_"))
    names = f"slice({_tags(h, 'script', 'src')}, 1, 61)", f"slice({_tags(h, 'link', 'href')}, 1, 61)", f"slice({_tags(h, 'img', 'src')}, 1, 25)"
    p = p.withColumn("urls", F.expr(f"concat({', '.join(names)})"))
    p = p.withColumn("urls", F.expr(r"transform(urls, u -> case when u rlike r'^[a-zA-Z][a-zA-Z0-9+.-]*:' then u when u like '//%' then concat('https:', u) when hostname = '' then '' when u like '/%' then concat('https://', hostname, u) else concat('https://', hostname, '/', u) end)"))
    p = p.withColumn("hosts", F.expr(r"slice(array_distinct(filter(transform(urls, u -> lower(regexp_extract(u, r'^https?://([^/:?#]+)', 1))), x -> x <> '')), 1, 60)"))
    p = p.withColumn("paths", F.expr(r"slice(array_distinct(filter(transform(urls, u -> substring(lower(regexp_extract(u, r'^https?://[^/?#]+(/[^?#]*)', 1)), 1, 48)), x -> x not in ('', '/'))), 1, 60)"))
    p = p.withColumn("tags", F.expr(f"slice(regexp_extract_all({h}, r'(?s)<[a-zA-Z][^>]*>', 0), 1, 1201)"))
    names_of = r"regexp_extract_all(regexp_replace(t, r'\x22[^\x22]*\x22|\x27[^\x27]*\x27', 'v'), r'\s([a-zA-Z_:][-a-zA-Z0-9_:.]*)\s*(?:=|\s|/?>)', 1)"
    p = p.withColumn("attrs", F.expr(f"array_distinct(transform(flatten(transform(filter(tags, t -> t rlike r'(?i)^<(?:html|body)[\\s>]'), t -> {names_of})), x -> lower(x)))"))
    p = p.withColumn("dataAttrs", F.expr(r"slice(array_distinct(transform(flatten(transform(tags, t -> regexp_extract_all(t, r'(?i)\s(data-[-a-z0-9_:.]*)', 1))), x -> lower(x))), 1, 80)"))
    p = p.withColumn("classes", F.expr(r"slice(array_distinct(filter(flatten(transform(tags, t -> split(lower(regexp_extract(t, r'(?is)\sclass\s*=\s*[\x22\x27]([^\x22\x27]*)', 1)), r'\s+'))), x -> x <> '')), 1, 160)"))
    known = "array(" + ", ".join(f"'{x}'" for x in KNOWN_IDS) + ")"
    p = p.withColumn("ids", F.expr(f"array_intersect({known}, {_tags(h, '[a-zA-Z][a-zA-Z0-9]*', 'id')})"))
    strip = r"trim(regexp_replace(regexp_replace(regexp_replace({0}, r'(?is)<script\b.*?</script>|<style\b.*?</style>', ' '), r'<[^>]*>', ' '), r'\s+', ' '))"
    foot = r"case when html_ rlike r'(?is)<footer\b' then regexp_extract(html_, r'(?is)<footer\b[^>]*>(.*?)</footer>', 1) else html_ end"
    p = p.withColumn("powered", F.expr(f"lower(right({strip.format(foot)}, 600))"))
    p = p.withColumn("fonts", F.expr(r"lower(regexp_extract(html_, r'(?is)font-family\s*:\s*([^;}\x22]*)', 1))"))
    p = p.withColumn("generator", F.expr(r"lower(coalesce(nullif(regexp_extract(html_, r'(?is)<meta\b[^>]*name\s*=\s*[\x22\x27]generator[\x22\x27][^>]*content\s*=\s*[\x22\x27]([^\x22\x27]*)', 1), ''), regexp_extract(html_, r'(?is)<meta\b[^>]*content\s*=\s*[\x22\x27]([^\x22\x27]*)[\x22\x27][^>]*name\s*=\s*[\x22\x27]generator', 1)))"))
    colours = r"flatten(transform(regexp_extract_all(html_, r'(?is)gradient\(((?:[^()]|\([^()]*\))*)\)', 1), g -> regexp_extract_all(g, r'(?i)rgba?\(\s*([0-9]+[,\s]+[0-9]+[,\s]+[0-9]+)', 1)))"
    p = p.withColumn("rgb", F.expr(f"transform({colours}, c -> transform(split(c, r'[,\\s]+'), x -> cast(x as double)))"))
    p = p.withColumn("hues", F.expr(f"transform(rgb, c -> {_hue('c')})"))
    p = p.withColumn("aiGradient", F.expr("exists(hues, x -> x between 250 and 295) and exists(hues, x -> x between 170 and 235)"))
    return p.select("page_id", "generator", "hosts", "paths", "attrs", "dataAttrs", "classes", "ids", "fonts", "aiGradient", "powered", "hostname")


def site_forensics(hints: DataFrame, content: DataFrame | None = None, overrides: DataFrame | None = None) -> DataFrame:
    """The platform of each page and the probability that an AI built it, from its hints.

    content: page_id, ai_text_share, images, ai_images. overrides: host, label ('ai' or 'human'), a user's word on a site,
    which wins. Rules rank by kind, then by weight: one for each field that shows the platform, two more where a field is
    evidence alone, two more for a host that the platform gives away. A page without hits is coded by hand."""
    spark = hints.sparkSession
    lower = lambda c: F.expr(f"transform(coalesce({c}, cast(array() as array<string>)), x -> lower(x))")
    h = hints.select("page_id", *(F.lower(F.coalesce(c, F.lit(""))).alias(c) for c in ("generator", "fonts", "powered", "hostname")), *(lower(c).alias(c) for c in ("hosts", "paths", "attrs", "dataAttrs", "classes")), F.coalesce("ids", F.expr("cast(array() as array<string>)")).alias("ids"), F.coalesce("aiGradient", F.lit(False)).alias("aiGradient"))
    shown = h.select("page_id", F.explode(F.array(*(F.struct(F.lit(f).alias("field"), (F.array(F.col(f)) if f in ("generator", "fonts", "powered") else F.col(f)).alias("vs")) for f in FIELDS))).alias("x")).select("page_id", "x.field", F.explode("x.vs").alias("v")).where("v <> ''").distinct()
    same = F.when(F.col("a.field") == "ids", F.col("v") == F.col("shows")).otherwise(F.contains("v", "shows"))
    found = shown.alias("a").join(_rules(spark).alias("r"), (F.col("a.field") == F.col("r.field")) & same).select("page_id", "ord", "id", "name", "kind", "a.field")
    own = own_subdomain(h.select("page_id", "hostname"))
    names = F.broadcast(spark.createDataFrame(sorted({(i, o, n, k) for o, i, n, k, _, _ in fingerprints()}), "id string, ord int, name string, kind string"))
    given = own.join(names, "id").select("page_id", "ord", "id", "name", "kind", F.lit("subdomain").alias("field"))
    hits = found.unionByName(given).groupBy("page_id", "ord", "id", "name", "kind").agg(F.count_distinct("field").alias("n"), F.array_sort(F.collect_set("field")).alias("fields"))
    strong = "exists(fields, f -> f in (" + ", ".join(f"'{f}'" for f in ("subdomain", *(f for f, alone in FIELDS.items() if alone))) + "))"
    hits = hits.withColumn("weight", F.expr(f"n + case when {strong} then 2 else 0 end + case when array_contains(fields, 'subdomain') then 2 else 0 end"))
    rank = F.element_at(F.create_map(*[F.lit(x) for kv in KIND_RANK.items() for x in kv]), F.col("kind"))
    base = F.element_at(F.create_map(*[F.lit(x) for kv in KIND_BASE.items() for x in kv]), F.col("kind"))
    ranked = hits.select("page_id", F.struct((-rank).alias("r"), (-F.col("weight")).alias("w"), (-base).alias("b"), "ord", "id", "name", "kind", "weight").alias("x")).groupBy("page_id").agg(F.array_sort(F.collect_list("x")).alias("xs"))  # at most one for each platform
    r = h.join(ranked, "page_id", "left")
    r = r.select("page_id", "hostname", "classes", "dataAttrs", "fonts", "aiGradient", F.expr("get(xs, 0)").alias("x"), F.coalesce(F.array_join(F.slice("xs.id", 1, 5), " "), F.lit("")).alias("candidates"))
    if content is not None:
        r = r.join(content.select("page_id", "ai_text_share", "images", "ai_images"), "page_id", "left")
    else:
        r = r.withColumns({"ai_text_share": F.lit(0.0), "images": F.lit(0), "ai_images": F.lit(0)})
    if overrides is not None:
        r = r.join(overrides.select(F.lower("host").alias("hostname"), "label").dropDuplicates(["hostname"]), "hostname", "left")
    else:
        r = r.withColumn("label", F.lit(None).cast("string"))
    return r.select("page_id", F.col("hostname").alias("host"), *[F.expr(x).alias(c) for c, x in _verdict_columns().items()], "candidates").drop("ai_built_")


def _verdict_columns() -> dict[str, str]:
    radix, lucide, geist = "exists(dataAttrs, a -> contains(a, 'data-radix'))", "exists(classes, c -> startswith(c, 'lucide'))", "contains(fonts, 'geist')"
    has = lambda c: f"array_contains(classes, '{c}')"
    tests = {"shadcn": f"{radix} and ({lucide} or {geist} or {has('bg-background')} or {has('text-foreground')})", "lucideGeist": f"{lucide} and {geist}", "shadcnTokens": f"size(array_intersect(classes, array({', '.join(repr(t) for t in TOKENS)}))) >= 2", "aiGradient": "aiGradient", "radix": radix, "geist": geist}
    p = f"coalesce(-x.b, {HANDCODED}D)"
    for name, test in tests.items():
        p = f"(1D - (1D - {p}) * (case when {test} then {1 - STACKS[name]!r}D else 1D end))"
    deploy = " or ".join(f"hostname = '{s}' or hostname like '%.{s}'" for s in sites.DEPLOY_HOSTS)
    p = f"(1D - (1D - {p}) * (case when coalesce(x.kind, '') not in ('ai-builder', 'builder') and ({deploy}) then {1 - DEPLOY}D else 1D end))"
    share = "case when coalesce(images, 0) > 0 then coalesce(ai_images, 0) / images else 0D end"
    p = f"least(1D, greatest(0D, greatest({p}, {IMAGES}D * {share}) + {TEXT_NUDGE}D * least(1D, greatest(0D, coalesce(ai_text_share, 0D))) + {IMAGE_NUDGE}D * {share}))"
    final = rounded(f"case when label = 'ai' then greatest({p}, 0.72D) when label = 'human' then least({p}, 0.22D) else {p} end", 4)
    return {
        "platform": "coalesce(x.name, 'none')", "platform_id": "coalesce(x.id, 'none')", "kind": "coalesce(x.kind, 'unknown')", "evidence": "coalesce(x.weight, 0)", "ai_builder": "coalesce(x.kind, '') = 'ai-builder'", "ai_built": final,
        "verdict": f"case when label in ('ai', 'human') then label when {final} >= 0.6 then 'ai' when {final} >= 0.35 then 'mixed' else 'human' end", "overridden": "coalesce(label in ('ai', 'human'), false)",
    }


def own_subdomain(hosts: DataFrame) -> DataFrame:
    """page_id and hostname -> page_id and the id of the platform that gave the host away: the first rule in order. A join
    of the host's suffixes at dots with the rules, not a scan of rules."""
    rules = F.broadcast(hosts.sparkSession.createDataFrame(subdomains(), "ord int, id string, suffix string, starts string"))
    parts = r"split(hostname, r'\.')"
    s = hosts.where("hostname <> ''").select("page_id", F.explode(F.expr(f"transform(sequence(1, size({parts})), k -> struct(array_join(slice({parts}, k, size({parts})), '.') as suffix, get({parts}, k - 2) as label))")).alias("s")).select("page_id", "s.suffix", F.coalesce("s.label", F.lit("")).alias("label"))
    return s.join(rules, "suffix").where("startswith(label, starts)").groupBy("page_id").agg(F.min(F.struct("ord", "id")).alias("x")).select("page_id", "x.id")


def site_platform(pages: DataFrame) -> DataFrame:
    """Hints of pages and their forensics in one."""
    return site_forensics(page_hints(pages))


_PAGE_TEXT = "(?is)" + "|".join(rf"<{t}\b[^>]*>.*?</{t}>" for t in ("script", "style", "head", "noscript", "template"))


def page_words(pages: DataFrame) -> DataFrame:
    """Words of the whole page as it reads, whatever its blocks, and its images (distinct, no data: addresses, the first 12)."""
    body = F.regexp_replace(F.regexp_replace(F.coalesce("html", F.lit("")), _PAGE_TEXT, " "), "<[^>]*>", " ")
    sources = _tags("coalesce(html, '')", "img", "src")
    images = F.expr(f"slice(filter(array_distinct({sources}), x -> x <> '' and not startswith(x, 'data:')), 1, 12)")
    return pages.select("page_id", F.size(F.regexp_extract_all(body, F.lit(r"[^\x09-\x0D\x20]+"), 0)).cast("long").alias("words"), F.size(images).cast("long").alias("images"))


def scored_blocks(pages: DataFrame) -> DataFrame:
    """Blocks of pages with the language that they show and the probability that a machine wrote them (0 where unknown)."""
    b = page_blocks(pages).withColumn("doc_id", F.struct("page_id", "rank")).withColumnRenamed("block", "text")
    told = signals._language(_D)
    for layer in told:
        b = b.withColumns({c: F.expr(x) for c, x in layer.items()})
    b = b.select("doc_id", "text", F.col("detected").alias("lang"))
    scored = detector.block_probability(b)
    return scored.select("doc_id.page_id", "doc_id.rank", "text", "ai_probability")


def scan_page(pages: DataFrame, overrides: DataFrame | None = None) -> DataFrame:
    """The report of each page: blocks, how many a machine may have written (0.55 and more), the six most likely (those of
    0.4 and more, by rank), readability of the first 4000 characters of its blocks, words, images, platform and verdict."""
    b = scored_blocks(pages)
    order = F.row_number().over(Window.partitionBy("page_id").orderBy(F.desc("ai_probability"), "rank"))
    per = b.withColumn("k", order).groupBy("page_id").agg(
        F.count(F.lit(1)).alias("text_blocks"), F.count_if(F.col("ai_probability") >= 0.55).alias("ai_blocks"),
        F.array_sort(F.collect_list(F.when((F.col("k") <= 6) & (F.col("ai_probability") >= 0.4), F.struct("k", "rank")))).alias("top_"),
        F.array_sort(F.collect_list(F.struct("rank", "text"))).alias("all_"),
    )
    per = per.select("page_id", "text_blocks", "ai_blocks", F.array_join(F.transform("top_.rank", lambda x: x.cast("string")), " ").alias("top_blocks"), F.substring(F.array_join("all_.text", " "), 1, 4000).alias("text"))
    sample = per.select(F.col("page_id").alias("doc_id"), "text")
    for layer in signals._language(_D):
        sample = sample.withColumns({c: F.expr(x) for c, x in layer.items()})
    ease = analysis.OPERATORS["readability"].apply(sample.select("doc_id", "text", F.col("detected").alias("lang"))).select(F.col("doc_id").alias("page_id"), F.col("flesch_reading_ease").alias("readability"))
    counts = page_words(pages).join(per.drop("text"), "page_id", "left").join(ease, "page_id", "left")
    content = counts.select("page_id", F.expr("case when text_blocks > 0 then ai_blocks / text_blocks else 0D end").alias("ai_text_share"), "images", F.lit(0).alias("ai_images"))
    site = site_forensics(page_hints(pages), content, overrides)
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return site.join(counts, "page_id").select("page_id", "host", "platform", "kind", "ai_built", "verdict", "overridden", zero("text_blocks"), zero("ai_blocks"), F.coalesce("top_blocks", F.lit("")).alias("top_blocks"), "readability", "words", "images")


def _sql_list(xs: list[str]) -> str:
    return "[" + ", ".join("'" + x.replace("'", "''") + "'" for x in xs) + "]"


def site_sql(content: str | None = None) -> str:
    """Forensics of pages as they lie, in DuckDB's words; content: a query of page_id, ai_text_share and images."""
    rules = ", ".join(f"({k}, '{i}', '{n}', '{c}', '{f}', '{t}')" for k, i, n, c, f, t in fingerprints())
    given = ", ".join(f"({k}, '{i}', '{x}', '{p}')" for k, i, x, p in subdomains())
    tag = lambda names, attribute: f"regexp_extract_all(h, '(?is)<(?:{names})\\b[^>]*?\\s{attribute}\\s*=\\s*[\"\\x27]([^\"\\x27]*)[\"\\x27]', 1)"
    alone = ", ".join(f"'{f}'" for f in ("subdomain", *(f for f, x in FIELDS.items() if x)))
    chain = "p0"
    tests = {"shadcn": "radix AND (lucide OR geist OR bg OR fg)", "lucideGeist": "lucide AND geist", "shadcnTokens": "tokens >= 2", "aiGradient": "gradient", "radix": "radix", "geist": "geist"}
    for name, test in tests.items():
        chain = f"(1 - (1 - {chain}) * CASE WHEN {test} THEN {1 - STACKS[name]!r} ELSE 1 END)"
    deploy = " OR ".join(f"host = '{x}' OR host LIKE '%.{x}'" for x in sites.DEPLOY_HOSTS)
    chain = f"(1 - (1 - {chain}) * CASE WHEN coalesce(kind, '') NOT IN ('ai-builder', 'builder') AND ({deploy}) THEN {1 - DEPLOY} ELSE 1 END)"
    joined = f"LEFT JOIN ({content}) c ON c.page_id = h.page_id" if content else "LEFT JOIN (SELECT NULL AS page_id, 0 AS ai_text_share) c ON c.page_id = h.page_id"
    ranks = " ".join(f"WHEN '{k}' THEN {v}" for k, v in KIND_RANK.items())
    bases = " ".join(f"WHEN '{k}' THEN {v}" for k, v in KIND_BASE.items())
    return rf"""
WITH rules(ord, id, name, kind, field, shows) AS (VALUES {rules}), given(ord, id, suffix, starts) AS (VALUES {given}),
r AS (SELECT page_id, coalesce(html, '') AS h, lower(regexp_extract(coalesce(url, ''), '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/:?#]*)', 1)) AS host FROM pages),
u AS (SELECT *, list_concat(list_concat(({tag('script', 'src')})[1:61], ({tag('link', 'href')})[1:61]), ({tag('img', 'src')})[1:25]) AS us, (regexp_extract_all(h, '(?s)<[a-zA-Z][^>]*>'))[1:1201] AS tags FROM r),
v AS (SELECT *, list_transform(us, lambda x: CASE WHEN regexp_matches(x, '^[a-zA-Z][a-zA-Z0-9+.-]*:') THEN x WHEN x LIKE '//%' THEN 'https:' || x WHEN host = '' THEN '' WHEN x LIKE '/%' THEN 'https://' || host || x ELSE 'https://' || host || '/' || x END) AS full_,
  list_transform(list_filter(tags, lambda t: regexp_matches(t, '(?i)^<(?:html|body)[\s>]')), lambda t: regexp_replace(t, '"[^"]*"|\x27[^\x27]*\x27', 'v', 'g')) AS roots,
  CASE WHEN regexp_matches(h, '(?is)<footer\b') THEN regexp_extract(h, '(?is)<footer\b[^>]*>(.*?)</footer>', 1) ELSE h END AS foot FROM u),
h AS (SELECT page_id, host,
  list_filter(list_transform(full_, lambda x: lower(regexp_extract(x, '^https?://([^/:?#]+)', 1))), lambda x: x <> '') AS hosts,
  list_filter(list_transform(full_, lambda x: substr(lower(regexp_extract(x, '^https?://[^/?#]+(/[^?#]*)', 1)), 1, 48)), lambda x: x NOT IN ('', '/')) AS paths,
  list_transform(flatten(list_transform(roots, lambda t: regexp_extract_all(t, '\s([a-zA-Z_:][-a-zA-Z0-9_:.]*)\s*(?:=|\s|/?>)', 1))), lambda x: lower(x)) AS attrs,
  list_transform(flatten(list_transform(tags, lambda t: regexp_extract_all(t, '(?i)\s(data-[-a-z0-9_:.]*)', 1))), lambda x: lower(x)) AS data_,
  list_distinct(list_filter(flatten(list_transform(tags, lambda t: regexp_split_to_array(lower(regexp_extract(t, '(?is)\sclass\s*=\s*[\x22\x27]([^\x22\x27]*)', 1)), '\s+'))), lambda x: x <> '')) AS classes,
  list_intersect({_sql_list(KNOWN_IDS)}, {tag('[a-zA-Z][a-zA-Z0-9]*', 'id')}) AS ids,
  lower(right(trim(regexp_replace(regexp_replace(regexp_replace(foot, '(?is)<script\b.*?</script>|<style\b.*?</style>', ' ', 'g'), '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g')), 600)) AS powered,
  lower(regexp_extract(h, '(?is)font-family\s*:\s*([^;}}\x22]*)', 1)) AS fonts, regexp_matches(h, '(?i)gradient\(') AND false AS gradient,
  lower(regexp_extract(h, '(?is)<meta\b[^>]*name\s*=\s*[\x22\x27]generator[\x22\x27][^>]*content\s*=\s*[\x22\x27]([^\x22\x27]*)', 1)) AS generator FROM v),
f AS (SELECT page_id, 'generator' AS field, generator AS v FROM h UNION ALL SELECT page_id, 'fonts', fonts FROM h UNION ALL SELECT page_id, 'powered', powered FROM h UNION ALL SELECT page_id, 'hosts', unnest(hosts) FROM h UNION ALL SELECT page_id, 'paths', unnest(paths) FROM h
  UNION ALL SELECT page_id, 'attrs', unnest(attrs) FROM h UNION ALL SELECT page_id, 'dataAttrs', unnest(data_) FROM h UNION ALL SELECT page_id, 'classes', unnest(classes) FROM h UNION ALL SELECT page_id, 'ids', unnest(ids) FROM h),
s AS (SELECT page_id, arg_min(given.id, given.ord) AS id FROM h JOIN given ON (host = suffix OR host LIKE '%.' || suffix) AND (starts = '' OR starts_with(string_split(rtrim(left(host, length(host) - length(suffix)), '.'), '.')[-1], starts)) GROUP BY page_id),
m AS (SELECT DISTINCT page_id, ord, id, name, kind, f.field FROM f JOIN rules USING (field) WHERE v <> '' AND CASE WHEN f.field = 'ids' THEN v = shows ELSE contains(v, shows) END
  UNION SELECT page_id, ord, s.id, name, kind, 'subdomain' FROM s JOIN (SELECT DISTINCT ord, id, name, kind FROM rules) q ON q.id = s.id),
w AS (SELECT page_id, ord, id, name, kind, count(*) + CASE WHEN bool_or(field IN ({alone})) THEN 2 ELSE 0 END + CASE WHEN bool_or(field = 'subdomain') THEN 2 ELSE 0 END AS weight FROM m GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY CASE kind {ranks} END DESC, weight DESC, ord) AS k FROM w),
b AS (SELECT page_id, string_agg(id, ' ' ORDER BY k) AS candidates FROM k WHERE k <= 5 GROUP BY page_id),
x AS (SELECT h.page_id, host, name, id, kind, coalesce(weight, 0) AS weight, coalesce(candidates, '') AS candidates, coalesce(ai_text_share, 0) AS share, CAST(coalesce(CASE kind {bases} END, {HANDCODED}) AS DOUBLE) AS p0, gradient, len(list_filter(data_, lambda a: contains(a, 'data-radix'))) > 0 AS radix,
  len(list_filter(classes, lambda c: starts_with(c, 'lucide'))) > 0 AS lucide, contains(fonts, 'geist') AS geist, list_contains(classes, 'bg-background') AS bg, list_contains(classes, 'text-foreground') AS fg, len(list_intersect(classes, {_sql_list(TOKENS)})) AS tokens
  FROM h LEFT JOIN (SELECT * FROM k WHERE k = 1) k ON k.page_id = h.page_id LEFT JOIN b ON b.page_id = h.page_id {joined}),
z AS (SELECT *, floor(CAST(least(1, {chain} + {TEXT_NUDGE} * share) AS DOUBLE) * 10000 + 0.5) / 10000 AS built FROM x)
SELECT page_id, host, coalesce(name, 'none') AS platform, coalesce(id, 'none') AS platform_id, coalesce(kind, 'unknown') AS kind, weight AS evidence, coalesce(kind, '') = 'ai-builder' AS ai_builder, built AS ai_built,
  CASE WHEN built >= 0.6 THEN 'ai' WHEN built >= 0.35 THEN 'mixed' ELSE 'human' END AS verdict, false AS overridden, candidates FROM z
""".replace("\\\\", "\\")


def scan_sql() -> str:
    """The report in DuckDB's words: blocks, their language and probability, the sample's readability, words and platform."""
    blocks = f"(SELECT page_id * 1000 + rank AS doc_id, page_id, rank, block AS text FROM ({BLOCKS_SQL}))"
    told = lambda source: f"(SELECT s.doc_id, s.text, l.detected AS lang FROM {source} s JOIN ({signals.OPERATORS['language_detect'].sql(source)}) l USING (doc_id))"
    prob = detector.OPERATORS["detect"].sql(told(blocks))
    sample = f"(SELECT page_id AS doc_id, substr(string_agg(text, ' ' ORDER BY rank), 1, 4000) AS text FROM {blocks} GROUP BY page_id)"
    content = "SELECT page_id, ai_blocks / text_blocks AS ai_text_share FROM per"
    page_text = _PAGE_TEXT.replace("'", "''")
    return f"""
WITH blk AS (SELECT b.page_id, b.rank, p.ai_probability AS prob FROM {blocks} b JOIN ({prob}) p USING (doc_id)),
ord_ AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY prob DESC, rank) AS k FROM blk),
per AS (SELECT page_id, count(*) AS text_blocks, count(*) FILTER (prob >= 0.55) AS ai_blocks, coalesce(string_agg(CAST(rank AS VARCHAR), ' ' ORDER BY k) FILTER (k <= 6 AND prob >= 0.4), '') AS top_blocks FROM ord_ GROUP BY page_id),
ease AS (SELECT doc_id AS page_id, flesch_reading_ease AS readability FROM ({analysis.OPERATORS['readability'].sql(told(sample))})),
site AS ({site_sql(content)}),
seen AS (SELECT page_id, CAST(len(regexp_extract_all(regexp_replace(regexp_replace(coalesce(html, ''), '{page_text}', ' ', 'g'), '<[^>]*>', ' ', 'g'), '[^\x09-\x0D\x20]+')) AS BIGINT) AS words FROM pages)
SELECT site.page_id, host, platform, kind, ai_built, verdict, overridden, CAST(coalesce(text_blocks, 0) AS BIGINT) AS text_blocks, CAST(coalesce(ai_blocks, 0) AS BIGINT) AS ai_blocks, coalesce(top_blocks, '') AS top_blocks, readability, words, CAST(0 AS BIGINT) AS images
FROM site JOIN seen USING (page_id) LEFT JOIN per USING (page_id) LEFT JOIN ease USING (page_id)
"""
