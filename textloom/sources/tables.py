"""Where tables come from: Parquet folders and files as bytes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def media(spark: SparkSession, path: str, largest: int = 25 << 20) -> DataFrame:
    """Files as bytes, up to a size, with the format that their first bytes show."""
    files = spark.read.format("binaryFile").load(path).where(F.col("length") <= largest)
    return files.select("path", "length", media_format(F.col("content")).alias("format"), "content")


def media_format(content):
    """Column: the format that the first bytes show; under 16 bytes, or none of these, unknown."""
    h = F.hex(F.substring(content, 1, 16))
    brand = F.substring(h, 17, 8)
    return (
        F.when(F.length(content) < 16, "unknown")
        .when(h.startswith("89504E470D0A1A0A"), "png").when(h.startswith("FFD8FF"), "jpeg").when(h.startswith("47494638"), "gif")
        .when(h.startswith("424D"), "bmp").when(h.startswith("664C6143"), "flac").when(h.startswith("4F676753"), "ogg")
        .when(h.startswith("49492A00") | h.startswith("4D4D002A"), "tiff")
        .when(h.startswith("52494646") & (brand == "57454250"), "webp").when(h.startswith("52494646") & (brand == "57415645"), "wav")
        .when((F.substring(h, 9, 8) == "66747970") & (brand == "71742020"), "mov").when(F.substring(h, 9, 8) == "66747970", "mp4")
        .when(h.startswith("1A45DFA3"), "webm").otherwise("unknown")
    )


def data_urls(rows: DataFrame, url_col: str = "url", largest: int = 25 << 20) -> DataFrame:
    """Rows with a data: address -> content (bytes) and error: null, 'unsupported' for other addresses, 'undecodable', or
    'too large'. A row that fails is a row with its error, never a failed job."""
    head = F.regexp_extract(url_col, r"(?s)^data:([^,]*),", 1)
    body = F.regexp_extract(url_col, r"(?s)^data:[^,]*,(.*)$", 1)
    read = F.when(head.contains(";base64"), F.try_to_binary(body, F.lit("base64"))).otherwise(F.encode(F.try_url_decode(F.regexp_replace(body, r"\+", "%2B")), "UTF-8"))
    is_data = F.coalesce(F.col(url_col).rlike(r"(?s)^data:[^,]*,"), F.lit(False))
    out = rows.withColumn("content", F.when(is_data, read))
    error = F.when(~is_data, "unsupported").when(F.col("content").isNull(), "undecodable").when(F.octet_length("content") > largest, "too large")
    return out.withColumn("error", error).withColumn("content", F.when(error.isNull(), F.col("content")))


def write_replies(rows: DataFrame, path: str, error_col: str = "error") -> None:
    """Parquet with ok beside the columns given: whether a row has no error."""
    rows.withColumn("ok", F.col(error_col).isNull()).write.mode("overwrite").parquet(path)
