"""Streams: usage counters, windows over events, and documents scored as they arrive.

Per-document operators have no state and take a stream as they take a table. Windows are an addition of this library.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.operators.analysis import OPERATORS
from textloom.operators.corpus import usage_counters


def counters(events: DataFrame, name: str, checkpoint: str):
    """Monotone counters with first and last time, into a table in memory; complete mode, a few rows."""
    return usage_counters(events).writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", checkpoint)


def windowed(events: DataFrame, every: str = "10 minutes", late: str = "30 minutes") -> DataFrame:
    """Events and their values for each window and type; rows later than `late` no longer count."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(F.window("ts", every), "event_type").agg(F.count(F.lit(1)).alias("events"), F.sum("value").alias("total"))


def scored(docs: DataFrame, operator: str) -> DataFrame:
    """A per-document operator over arriving documents."""
    return OPERATORS[operator].apply(docs)


def sanitized(events: DataFrame, longest: int = 40) -> DataFrame:
    """params: the numbers, booleans and texts of an event's parameters, texts cut to `longest`; lists and objects go."""
    raw = F.from_json("props", "map<string,string>")
    nested = lambda k, v: v.isNotNull() & ~v.rlike(r"(?s)^\s*[\[{]")
    return events.withColumn("params", F.transform_values(F.map_filter(F.coalesce(raw, F.create_map().cast("map<string,string>")), nested), lambda k, v: F.substring(v, 1, longest)))


def flushed(events: DataFrame, send, checkpoint: str, every: str = "15 seconds"):
    """Sanitised events handed to send(DataFrame) a batch at a time; a batch whose sending fails is dropped."""

    def batch(df: DataFrame, _: int) -> None:
        try:
            send(df)
        except Exception:  # noqa: BLE001  # what is sent is counters: losing a batch is better than stopping
            return

    return sanitized(events).writeStream.trigger(processingTime=every).foreachBatch(batch).option("checkpointLocation", checkpoint)


def overrides(feedback: DataFrame) -> DataFrame:
    """host, label and ts -> the last label of each host, by time and then by label; update- and complete-mode streams take it."""
    return feedback.where("host is not null and label in ('ai', 'human')").groupBy("host").agg(F.max(F.struct("ts", "label")).alias("x")).select("host", "x.label")
