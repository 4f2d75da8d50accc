"""Language packs: lists of words by language, read where they lie, joined to texts by language, and written.

A pack is one JSON object in a file named after its language. A field is a list of terms, or an object whose keys are the
terms and whose values their alternatives. A missing pack is simply absent: a text keeps empty lists and pack_known false.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.operators.detector import PACK_LISTS
from textloom.operators.style import FUNCTION_WORDS

#: Stop words of our own, for languages whose packs are not at hand.
OWN = {
    "en": FUNCTION_WORDS["en"],
    "de": """der die das und oder aber in im an am auf zu zum zur mit von vom bei aus nach für um durch ist sind war waren sein wird werden hat haben ein
eine einer eines einem einen nicht kein auch nur noch so wie als dass wenn weil er sie es wir ihr ich du sich den dem des""".split(),
    "fr": """le la les un une des du de et ou mais dans en sur sous à au aux pour par avec sans est sont était être a ont avoir ne pas plus que qui quoi
ce cet cette ces il elle ils elles nous vous je tu se sa son ses leur leurs y""".split(),
    "es": """el la los las un una unos unas de del y o pero en a al por para con sin sobre es son era ser fue ha han haber no más que quien como cuando
donde este esta estos estas ese esa su sus lo le les se me te nos yo tú él ella""".split(),
}


def read_packs(spark: SparkSession, path: str) -> DataFrame:
    """JSON packs under path -> lexicon(lang, category, term, alternatives, ord). A file that is no JSON object has no rows."""
    raw = spark.read.option("wholetext", True).text(path).select(F.regexp_extract(F.input_file_name(), r"([^/]+)\.json$", 1).alias("lang"), F.from_json("value", "map<string,string>").alias("p"))
    f = raw.where("lang <> 'index' and p is not null").select("lang", F.explode("p").alias("category", "body"))
    lists = f.where(F.col("body").startswith("[")).select("lang", "category", F.posexplode(F.from_json("body", "array<string>")).alias("ord", "term")).select("lang", "category", "term", F.expr("cast(array() as array<string>)").alias("alternatives"), "ord")
    maps = f.where(F.col("body").startswith("{")).select("lang", "category", F.posexplode(F.map_entries(F.from_json("body", "map<string,string>"))).alias("ord", "e"))
    told = F.when(F.col("e.value").startswith("["), F.from_json("e.value", "array<string>")).when(F.col("e.value").isNotNull(), F.array("e.value")).otherwise(F.expr("cast(array() as array<string>)"))
    return lists.unionByName(maps.select("lang", "category", F.col("e.key").alias("term"), told.alias("alternatives"), "ord")).where("term is not null and term <> ''")


def pack_index(spark: SparkSession, path: str) -> DataFrame:
    """The index of packs -> languages(code, name, tier, bytes)."""
    raw = spark.read.option("wholetext", True).text(path).select(F.from_json("value", "languages map<string,struct<name:string,tier:int,bytes:long>>").alias("p"))
    return raw.select(F.explode("p.languages").alias("code", "x")).select("code", "x.name", "x.tier", "x.bytes")


def write_packs(lexicon: DataFrame, path: str) -> None:
    """lexicon(lang, category, term) -> one folder for each language with one JSON object of sorted lists without repeats."""
    lists = lexicon.groupBy("lang", "category").agg(F.sort_array(F.collect_set("term")).alias("terms"))
    packs = lists.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("category", "terms"))).alias("e"))
    packs.select("lang", F.to_json(F.map_from_entries("e")).alias("value")).write.mode("overwrite").partitionBy("lang").text(path)


def own_packs(spark: SparkSession) -> DataFrame:
    """The stop words above as a lexicon."""
    return spark.createDataFrame([(lang, "stop_words", w, k) for lang, ws in OWN.items() for k, w in enumerate(ws)], "lang string, category string, term string, ord int")


def with_packs(docs: DataFrame, lexicon: DataFrame) -> DataFrame:
    """docs with the lists of the pack of their language (its first two letters) as columns, and pack_known. One row for each
    language is joined from the right and is broadcast: the optimiser does not see its size, and a shuffle would send all
    texts to as many tasks as there are languages."""
    column = lambda c: F.array_distinct(F.transform(F.coalesce(F.element_at("m", c), F.expr("cast(array() as array<string>)")), F.lower)).alias(c)
    lists = lexicon.where(F.col("category").isin(PACK_LISTS)).groupBy("lang", "category").agg(F.sort_array(F.collect_set("term")).alias("terms"))
    packs = lists.groupBy("lang").agg(F.map_from_entries(F.collect_list(F.struct("category", "terms"))).alias("m")).select(F.col("lang").alias("pack_lang"), *(column(c) for c in PACK_LISTS))
    r = docs.join(F.broadcast(packs), F.substring(F.lower("lang"), 1, 2) == F.col("pack_lang"), "left")
    empty = F.expr("cast(array() as array<string>)")
    return r.withColumns({c: F.coalesce(c, empty) for c in PACK_LISTS} | {"pack_known": F.col("pack_lang").isNotNull()}).drop("pack_lang")


def own_packs_sql(source: str = "documents") -> str:
    """The same join with the lists above, in DuckDB's words."""
    lists = " ".join(f"WHEN '{lang}' THEN [" + ", ".join("'" + w.replace("'", "''") + "'" for w in sorted(set(ws))) + "]" for lang, ws in OWN.items())
    empty = ", ".join(f"CAST([] AS VARCHAR[]) AS {c}" for c in PACK_LISTS[1:])
    key = "substr(lower(lang), 1, 2)"
    return f"(SELECT doc_id, text, lang, coalesce({key} IN ({', '.join(repr(x) for x in OWN)}), false) AS pack_known, coalesce(CASE {key} {lists} END, CAST([] AS VARCHAR[])) AS stop_words, {empty} FROM {source})"
