"""The corpus pipeline: quality, near duplicates, benchmark passages, personal data, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written and read again as the next one's docs. All
but the last return the columns of docs. Decisions fall on rows, told apart by a hash of id and text, so rows with null or
repeated ids are judged by their own texts; rows equal in both share their fate.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm.common import free_names, load, materialize
from textloom.llm.decontaminate import contamination, row_key
from textloom.llm.importance import fit, resample
from textloom.llm.jaccard_join import jaccard_components
from textloom.llm.packing import pack
from textloom.llm.pii import replace_pii


def _keyed(docs: DataFrame) -> tuple[DataFrame, str]:
    """docs with the key of each row, and the name of its column."""
    (row,) = free_names(docs.columns, "row")
    return docs.withColumn(row, row_key("doc_id", "text")), row


def _without(keyed: DataFrame, row: str, gone: DataFrame, columns: list[str]) -> DataFrame:
    return keyed.join(gone.toDF(row), row, "left_anti").select(*[F.col(f"`{c}`") for c in columns])


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Importance resampling toward texts labelled good; what is not selected goes."""
    keyed, row = _keyed(docs)
    chosen = resample(keyed, fit(docs, load(spark, sf_dir, "labels")), id_col=row)
    return _without(keyed, row, chosen.where("not selected").select("doc_id").distinct(), docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Five-word shingles at a Jaccard index of 0.8; of each group the document with the least id stays, once (a null id
    only where no other has one). Texts without words are no duplicates of anything."""
    keyed, row = _keyed(docs)
    found = materialize(jaccard_components(keyed, id_col=row).select(F.col("doc_id").alias("row"), F.col("component_id").alias("class"), "n_shingles"), "found")
    several = found.where("n_shingles > 0").groupBy("class").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("class")
    members = found.join(several, "class").groupBy("row", "class").agg(F.count(F.lit(1)).alias("times"))
    members = members.join(keyed.select(F.col(row).alias("row"), F.col("doc_id").alias("id")), "row").groupBy("row", "class", "id").agg(F.first("times").alias("times"))
    stays = members.groupBy("class").agg(F.min(F.struct(F.col("id").isNull().alias("unnamed"), "id", "row")).alias("x")).select("class", F.col("x.row").alias("stays"))
    marks = members.join(stays, "class").select("row", F.when(F.col("row") != F.col("stays"), "gone").when(F.col("times") > 1, "again").alias("mark")).where("mark is not null")
    (mark,) = free_names(keyed.columns, "mark")
    left = keyed.join(materialize(marks.toDF(row, mark), "marks"), row, "left")
    out = left.where(F.col(mark).isNull()).unionByName(left.where(F.col(mark) == "again").dropDuplicates([row]))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which most of a benchmark item aligns go."""
    keyed, row = _keyed(docs)
    return _without(keyed, row, contamination(docs, load(spark, sf_dir, "benchmark")).select("row").distinct(), docs.columns)


def surrogates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced; n_chars follows the text."""
    out = replace_pii(docs)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("n_entities") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return out.select(docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 1024 tokens."""
    return pack(docs)


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontaminated),
    ("surrogates", surrogates),
    ("packing", packed),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = materialize(docs, name)
    return docs
