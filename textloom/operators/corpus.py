"""Operators over many rows: counts, entropy, keywords, pair similarity, usage counters, blocks of pages.

Counts are aggregated in the map stage before they are shuffled; small rule tables are broadcast, their size is fixed by
the code. Streams take the same functions where their aggregates allow it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions.dialect import Spark
from textloom.operators.analysis import T2, T4, T4U
from textloom.operators.detector import OPERATORS as _DETECTOR
from textloom.operators.detector import WEIGHTS

DETECT = _DETECTOR["detect"]

_D = Spark()

#: English and Russian words without content, used where a language has no list of its own.
STOP_WORDS = sorted(set("""a an the and or but if then else of to in on at by for with without from into over under again further this that these
those is are was were be been being have has had do does did will would could should may might shall can not no nor only own same so than
too very just because as until while about against between during before after above below up down out off through it its it's they them
their there here what which who whom whose when where why how all any both each few more most other some such i you he she we me my your
his her our mine yours ours also one two get got make made like really actually thing things
и в во не что он на я с со как а то все она так его но да ты к у же вы за бы по только ее мне было вот от меня еще нет о из ему теперь когда
даже ну вдруг ли если уже или ни быть был него до вас нибудь опять уж вам ведь там потом себя ничего ей может они тут где есть надо ней для
мы тебя их чем была сам чтобы без будто чего раз тоже себе под будет ж тогда кто этот того потому этого какой совсем ним здесь этом один
почти мой тем чтоб нее сейчас были куда зачем всех никогда можно при наконец два об другой хоть после над больше тот через эти нас про всего
них какая много разве три эту моя впрочем хорошо свою этой перед иногда лучше чуть том нельзя такой им более всегда конечно всю между это
её очень""".split()))  # fmt: skip


def words(pattern: str, text: str = "coalesce(text, '')") -> Column:
    return F.expr(_D.extract(f"lower({text})", pattern))


def term_frequency(docs: DataFrame) -> DataFrame:
    """Corpus counts of words: occurrences and documents."""
    per_doc = docs.select("doc_id", F.explode(words(T4)).alias("term")).groupBy("doc_id", "term").agg(F.count(F.lit(1)).alias("n"))
    return per_doc.groupBy("term").agg(F.sum("n").alias("occurrences"), F.count(F.lit(1)).alias("documents"))


TERM_SQL = f"""
WITH e AS (SELECT doc_id, unnest(regexp_extract_all(lower(coalesce(text, '')), '{T4}')) AS term FROM documents),
p AS (SELECT doc_id, term, count(*) AS n FROM e GROUP BY ALL)
SELECT term, CAST(sum(n) AS BIGINT) AS occurrences, count(*) AS documents FROM p GROUP BY term
"""


def lexical_richness(docs: DataFrame) -> DataFrame:
    """Of each document: tokens, kinds, words met once, Yule's K and word entropy; without words, zeros."""
    counts = docs.select("doc_id", F.explode(words(T4)).alias("w")).groupBy("doc_id", "w").agg(F.count(F.lit(1)).alias("c"))
    n = F.sum("c")
    got = counts.groupBy("doc_id").agg(
        n.alias("tokens"), F.count(F.lit(1)).alias("kinds"), F.count_if(F.col("c") == 1).alias("hapax"),
        F.sum(F.col("c") * F.col("c")).alias("m"), F.sum(F.col("c") * F.log2("c")).alias("clog"),
    )
    r = docs.select("doc_id").join(got, "doc_id", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    k = F.expr("coalesce(floor(10000D * (m - tokens) / (tokens * tokens) * 10000 + 0.5D) / 10000, 0D)")
    h = F.expr("coalesce(floor((log2(tokens) - clog / tokens) * 10000 + 0.5D) / 10000, 0D)")
    return r.select("doc_id", zero("tokens"), zero("kinds"), zero("hapax"), k.alias("yule_k"), h.alias("word_entropy"))


RICHNESS_SQL = f"""
WITH e AS (SELECT doc_id, unnest(regexp_extract_all(lower(coalesce(text, '')), '{T4}')) AS w FROM documents),
c AS (SELECT doc_id, w, count(*) AS c FROM e GROUP BY ALL),
g AS (SELECT doc_id, CAST(sum(c) AS BIGINT) AS tokens, count(*) AS kinds, count(*) FILTER (c = 1) AS hapax, CAST(sum(c * c) AS BIGINT) AS m, sum(c * log2(c)) AS clog FROM c GROUP BY doc_id)
SELECT d.doc_id, coalesce(tokens, 0) AS tokens, coalesce(kinds, 0) AS kinds, coalesce(hapax, 0) AS hapax,
  coalesce(floor(CAST(10000 AS DOUBLE) * (m - tokens) / (tokens * tokens) * 10000 + 0.5) / 10000, 0) AS yule_k,
  coalesce(floor((log2(tokens) - clog / tokens) * 10000 + 0.5) / 10000, 0) AS word_entropy
FROM documents d LEFT JOIN g USING (doc_id)
"""


def char_entropy(docs: DataFrame) -> DataFrame:
    """Bits per character of the lower-case text."""
    c = docs.select("doc_id", F.explode(F.split(F.lower("text"), "")).alias("c")).where("c <> ''").groupBy("doc_id", "c").agg(F.count(F.lit(1)).alias("n"))
    g = c.groupBy("doc_id").agg(F.sum("n").alias("t"), F.sum(F.col("n") * F.log2("n")).alias("l"))
    return docs.select("doc_id").join(g, "doc_id", "left").select("doc_id", F.expr("coalesce(floor((log2(t) - l / t) * 10000 + 0.5D) / 10000, 0D)").alias("char_entropy"))


CHAR_SQL = """
WITH e AS (SELECT doc_id, unnest(string_split(lower(text), '')) AS c FROM documents),
c AS (SELECT doc_id, c, count(*) AS n FROM e WHERE c <> '' GROUP BY ALL),
g AS (SELECT doc_id, sum(n) AS t, sum(n * log2(n)) AS l FROM c GROUP BY doc_id)
SELECT d.doc_id, coalesce(floor((log2(t) - l / t) * 10000 + 0.5) / 10000, 0) AS char_entropy FROM documents d LEFT JOIN g USING (doc_id)
"""


def keywords(docs: DataFrame, top: int = 10) -> DataFrame:
    """The most frequent content words of each document: count, then score, then the place of the first."""
    e = docs.select("doc_id", F.posexplode(words(T2)).alias("pos", "term")).where(F.length("term") >= 3)
    g = e.groupBy("doc_id", "term").agg(F.count(F.lit(1)).alias("count"), F.min("pos").alias("first"))
    total = g.groupBy("doc_id").agg(F.sum("count").alias("total"))
    stop = F.broadcast(docs.sparkSession.createDataFrame([(w,) for w in STOP_WORDS], "term string"))
    s = g.join(stop, "term", "left_anti").join(total, "doc_id").withColumn("score", F.expr("floor(count / total * log2(1 + length(term)) * 1000 + 0.5D) / 1000"))
    rank = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("count"), F.desc("score"), "first"))
    return s.withColumn("rank", rank).where(F.col("rank") <= top).select("doc_id", "rank", "term", "count", "score")


_STOP_SQL = ", ".join("'" + w.replace("'", "''") + "'" for w in STOP_WORDS)
KEYWORDS_SQL = f"""
WITH l AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '{T2.replace("'", "''")}') AS ws FROM documents),
e AS (SELECT doc_id, unnest(ws) AS term, unnest(range(0, len(ws))) AS pos FROM l),
g AS (SELECT doc_id, term, count(*) AS count, min(pos) AS first FROM e WHERE length(term) >= 3 GROUP BY ALL),
t AS (SELECT doc_id, sum(count) AS total FROM g GROUP BY doc_id),
s AS (SELECT g.*, floor(count / total * log2(1 + length(term)) * 1000 + 0.5) / 1000 AS score FROM g JOIN t USING (doc_id) WHERE term NOT IN ({_STOP_SQL})),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY count DESC, score DESC, first) AS INT) AS rank FROM s)
SELECT doc_id, rank, term, count, score FROM r WHERE rank <= 10
"""


def repeated_ngrams(docs: DataFrame, n: int = 3, top: int = 25) -> DataFrame:
    g = docs.select("doc_id", words(T4U).alias("w")).select("doc_id", F.explode(F.expr(_D.grams("w", n))).alias("ngram"))
    c = g.groupBy("doc_id", "ngram").agg(F.count(F.lit(1)).alias("count")).where("count > 1")
    rank = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("count"), "ngram"))
    return c.withColumn("rank", rank).where(F.col("rank") <= top).select("doc_id", "rank", "ngram", "count")


REPEATED_SQL = f"""
WITH l AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '{T4U}') AS w FROM documents),
e AS (SELECT doc_id, unnest(list_transform(range(1, greatest(len(w) - 1, 1)), lambda i: w[i] || ' ' || w[i+1] || ' ' || w[i+2])) AS ngram FROM l),
c AS (SELECT doc_id, ngram, count(*) AS count FROM e GROUP BY ALL HAVING count(*) > 1),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY count DESC, ngram) AS INT) AS rank FROM c)
SELECT doc_id, rank, ngram, count FROM r WHERE rank <= 25
"""


def pair_similarity(docs: DataFrame, items: DataFrame, n: int = 3) -> DataFrame:
    """Jaccard index of word n-gram sets, for pairs of a document and an item that share one; pairs come from the grams.

    Words are a column of their own before they are paired, so a text is searched once; the join is on hashes of grams,
    and a pair's shared grams are counted by the grams themselves."""
    def grams(df: DataFrame, key: str, size: str) -> DataFrame:
        w = df.select(key, F.expr(_D.extract("lower(coalesce(text, ''))", T4U)).alias("w"))
        g = w.select(key, F.array_distinct(F.expr(_D.grams("w", n))).alias("g"))
        return g.select(key, F.size("g").alias(size), F.explode("g").alias("x")).withColumn("h", F.xxhash64("x"))

    a, b = grams(docs, "doc_id", "na"), grams(items, "item_id", "nb")
    met = a.join(b.withColumnRenamed("x", "y"), "h").where("x = y")
    c = met.groupBy("doc_id", "item_id", "na", "nb").agg(F.count(F.lit(1)).alias("shared"))
    return c.select("doc_id", "item_id", F.col("shared").alias("shared_ngrams"), F.expr("floor(shared / (na + nb - shared) * 10000 + 0.5D) / 10000").alias("similarity"))


PAIR_SQL = f"""
WITH l AS (SELECT 0 AS side, doc_id AS id, regexp_extract_all(lower(coalesce(text, '')), '{T4U}') AS w FROM documents
  UNION ALL SELECT 1, item_id, regexp_extract_all(lower(coalesce(text, '')), '{T4U}') FROM benchmark),
g AS (SELECT side, id, list_distinct(list_transform(range(1, greatest(len(w) - 1, 1)), lambda i: w[i] || ' ' || w[i+1] || ' ' || w[i+2])) AS g FROM l),
e AS (SELECT side, id, len(g) AS n, unnest(g) AS x FROM g)
SELECT a.id AS doc_id, b.id AS item_id, count(*) AS shared_ngrams, floor(count(*) / (a.n + b.n - count(*)) * 10000 + 0.5) / 10000 AS similarity
FROM e a JOIN e b ON a.x = b.x AND a.side = 0 AND b.side = 1 GROUP BY a.id, b.id, a.n, b.n
"""


def usage_counters(events: DataFrame) -> DataFrame:
    """Counts with first and last time for each kind of event; complete-mode streams take it too."""
    return events.groupBy("event_type").agg(F.count(F.lit(1)).alias("events"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"), F.count("user_id").alias("with_user"))


USAGE_SQL = "SELECT event_type, count(*) AS events, min(ts) AS first_seen, max(ts) AS last_seen, count(user_id) AS with_user FROM events GROUP BY event_type"


def usage_by_tool(events: DataFrame) -> DataFrame:
    """Counts with first and last time for each kind of event and tool, the tool a text in the event's parameters; events
    without one count under the empty tool."""
    tool = F.coalesce(F.get_json_object("props", "$.tool"), F.lit(""))
    return events.groupBy("event_type", tool.alias("tool")).agg(F.count(F.lit(1)).alias("events"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"))


TOOL_SQL = "SELECT event_type, coalesce(props::JSON ->> '$.tool', '') AS tool, count(*) AS events, min(ts) AS first_seen, max(ts) AS last_seen FROM events GROUP BY ALL"


def feedback_log(events: DataFrame, keep: int = 800) -> DataFrame:
    """The latest events, newest first by time and id: a top-k of partial top-ks, not a sort of all."""
    return events.orderBy(F.desc("ts"), F.desc("event_id")).limit(keep).select("event_id", "user_id", "event_type", "value")


FEEDBACK_LOG_SQL = "SELECT event_id, user_id, event_type, value FROM events ORDER BY ts DESC, event_id DESC LIMIT 800"


def compare_texts(pairs: DataFrame, n: int = 3) -> DataFrame:
    """Jaccard index of the word n-gram sets of two texts, a and b; of their word sets where neither has an n-gram; two
    texts without words are equal. Null texts are empty."""
    w = pairs.withColumns({f"w_{x}": F.expr(_D.extract(f"lower(coalesce({x}, ''))", T4U)) for x in "ab"})
    g = w.withColumns({f"g_{x}": F.expr(f"array_distinct({_D.grams(f'w_{x}', n)})") for x in "ab"})
    g = g.withColumns({f"s_{x}": F.expr(f"case when size(g_a) = 0 and size(g_b) = 0 then array_distinct(w_{x}) else g_{x} end") for x in "ab"})
    both = "size(array_intersect(s_a, s_b))"
    score = F.expr(f"case when size(s_a) = 0 and size(s_b) = 0 then 1D else floor({both} / (size(s_a) + size(s_b) - {both}) * 10000 + 0.5D) / 10000 end")
    return g.select(*[c for c in pairs.columns if c not in ("a", "b")], score.alias("similarity"))


def turn_similarity(conversations: DataFrame) -> DataFrame:
    """Each turn against the one before it in its conversation; the first against nothing."""
    before = F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    return compare_texts(conversations.select("conv_id", "turn", F.col("text").alias("a"), before.alias("b")))


TURN_SQL = f"""
WITH p AS (SELECT conv_id, turn, regexp_extract_all(lower(coalesce(text, '')), '{T4U}') AS a, regexp_extract_all(lower(coalesce(lag(text) OVER (PARTITION BY conv_id ORDER BY turn), '')), '{T4U}') AS b FROM conversations),
g AS (SELECT *, list_distinct(list_transform(range(1, greatest(len(a) - 1, 1)), lambda i: a[i] || ' ' || a[i+1] || ' ' || a[i+2])) AS ga, list_distinct(list_transform(range(1, greatest(len(b) - 1, 1)), lambda i: b[i] || ' ' || b[i+1] || ' ' || b[i+2])) AS gb FROM p),
s AS (SELECT conv_id, turn, CASE WHEN len(ga) = 0 AND len(gb) = 0 THEN list_distinct(a) ELSE ga END AS x, CASE WHEN len(ga) = 0 AND len(gb) = 0 THEN list_distinct(b) ELSE gb END AS y FROM g)
SELECT conv_id, turn, CASE WHEN len(x) = 0 AND len(y) = 0 THEN CAST(1 AS DOUBLE) ELSE floor(len(list_intersect(x, y)) / (len(x) + len(y) - len(list_intersect(x, y))) * 10000 + 0.5) / 10000 END AS similarity FROM s
"""


def latest_feedback(events: DataFrame) -> DataFrame:
    """The last word of each user: the type and value of the event with the greatest time, then the greatest id."""
    last = events.groupBy("user_id").agg(F.max(F.struct("ts", "event_id", "event_type", "value")).alias("x"), F.count(F.lit(1)).alias("given"))
    return last.select("user_id", "x.event_id", "x.event_type", "x.value", "given")


FEEDBACK_SQL = """
SELECT user_id, event_id, event_type, value, given FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k, count(*) OVER (PARTITION BY user_id) AS given FROM events) WHERE k = 1
"""


def metric_separation(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Mean of each of the detector's measures over rows of either label, and their difference: one pass over the texts that
    have a label, as others have no part in it. Texts meet labels in a merge join at any size, so that what moves grows with the input."""
    labelled = docs.join(labels.select("doc_id").hint("merge"), "doc_id", "left_semi")
    scored = DETECT.apply(labelled).select("doc_id", *WEIGHTS).join(labels.select("doc_id", "quality"), "doc_id")
    pairs = ", ".join(f"'{m}', {m}" for m in WEIGHTS)
    long = scored.select("quality", F.expr(f"stack({len(WEIGHTS)}, {pairs}) as (metric, v)"))
    mean = lambda q: F.avg(F.when(F.col("quality") == q, F.col("v")))
    r = long.groupBy("metric").agg(F.count(F.lit(1)).alias("labelled"), mean(1).alias("a"), mean(0).alias("b"))
    return r.select("metric", "labelled", *[F.expr(f"floor({x} * 1000 + 0.5D) / 1000").alias(n) for n, x in (("mean_good", "a"), ("mean_bad", "b"), ("separation", "(a - b)"))])


def separation_sql() -> str:
    parts = " UNION ALL ".join(f"SELECT doc_id, '{m}' AS metric, {m} AS v FROM d" for m in WEIGHTS)
    return f"""WITH d AS ({DETECT.sql()}), m AS ({parts}), r AS (SELECT metric, count(*) AS labelled, avg(v) FILTER (quality = 1) AS a, avg(v) FILTER (quality = 0) AS b FROM m JOIN labels USING (doc_id) GROUP BY metric)
    SELECT metric, labelled, floor(a * 1000 + 0.5) / 1000 AS mean_good, floor(b * 1000 + 0.5) / 1000 AS mean_bad, floor((a - b) * 1000 + 0.5) / 1000 AS separation FROM r"""


_CHROME = r"(?is)<(nav|footer|header|aside|script|style)\b[^>]*>.*?</(?:nav|footer|header|aside|script|style)>"
_BLOCK = r"(?is)<(?:p|li|h1|h2|h3|blockquote|td|dd|figcaption)\b[^>]*>(.*?)</(?:p|li|h1|h2|h3|blockquote|td|dd|figcaption)>"


def page_blocks(pages: DataFrame, least: int = 60, longest: int = 600, most: int = 40) -> DataFrame:
    """Blocks of running text of each page, outside of its chrome: at least `least` characters, repeats (by their first 80)
    gone, cut to `longest`, the first `most` of a page."""
    html = F.regexp_replace(F.coalesce("html", F.lit("")), _CHROME, " ")
    raw = pages.select("page_id", F.posexplode(F.regexp_extract_all(html, F.lit(_BLOCK), 1)).alias("place", "raw"))
    block = F.trim(F.regexp_replace(F.regexp_replace("raw", "<[^>]*>", " "), r"[\x09-\x0D\x20]+", " "))
    b = raw.select("page_id", "place", block.alias("block")).where(F.length("block") >= least)
    b = b.withColumn("twin", F.row_number().over(Window.partitionBy("page_id", F.substring("block", 1, 80)).orderBy("place"))).where("twin = 1")
    b = b.withColumn("rank", F.row_number().over(Window.partitionBy("page_id").orderBy("place"))).where(F.col("rank") <= most)
    return b.select("page_id", "rank", F.substring("block", 1, longest).alias("block"))


BLOCKS_SQL = r"""
WITH h AS (SELECT page_id, regexp_replace(coalesce(html, ''), '(?is)<(nav|footer|header|aside|script|style)\b[^>]*>.*?</(?:nav|footer|header|aside|script|style)>', ' ', 'g') AS h FROM pages),
x AS (SELECT page_id, regexp_extract_all(h, '(?is)<(?:p|li|h1|h2|h3|blockquote|td|dd|figcaption)\b[^>]*>(.*?)</(?:p|li|h1|h2|h3|blockquote|td|dd|figcaption)>', 1) AS bs FROM h),
r AS (SELECT page_id, unnest(bs) AS raw, unnest(range(0, len(bs))) AS place FROM x),
b AS (SELECT page_id, place, trim(regexp_replace(regexp_replace(raw, '<[^>]*>', ' ', 'g'), '[\x09-\x0D\x20]+', ' ', 'g')) AS block FROM r),
t AS (SELECT *, row_number() OVER (PARTITION BY page_id, substr(block, 1, 80) ORDER BY place) AS twin FROM b WHERE length(block) >= 60),
k AS (SELECT *, CAST(row_number() OVER (PARTITION BY page_id ORDER BY place) AS INT) AS rank FROM t WHERE twin = 1)
SELECT page_id, rank, substr(block, 1, 600) AS block FROM k WHERE rank <= 40
"""


def similar_turns(conversations: DataFrame) -> DataFrame:
    """Turns and words of each role, and words a turn."""
    n = F.expr(_D.count("coalesce(text, '')", r"[^\x09-\x0D\x20]+"))
    g = conversations.groupBy("role").agg(F.count(F.lit(1)).alias("turns"), F.sum(n).alias("words"), F.avg(n).alias("m"))
    return g.select("role", "turns", "words", F.expr("floor(m * 1000 + 0.5D) / 1000").alias("mean_words"))


TURNS_SQL = r"""
WITH t AS (SELECT role, len(regexp_extract_all(coalesce(text, ''), '[^\x09-\x0D\x20]+')) AS n FROM conversations)
SELECT role, count(*) AS turns, CAST(sum(n) AS BIGINT) AS words, floor(avg(n) * 1000 + 0.5) / 1000 AS mean_words FROM t GROUP BY role
"""
