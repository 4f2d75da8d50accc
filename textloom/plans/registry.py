"""Registered queries of the library itself and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from textloom.operators import analysis, corpus, detector, language, pages, rewrite, signals, style
from textloom.sources import packs
from textloom.sources.tables import table

OPERATORS = analysis.OPERATORS | style.OPERATORS | detector.OPERATORS | signals.OPERATORS | rewrite.OPERATORS
Query = Callable[[SparkSession, str], DataFrame]


def _over(f: Callable[..., DataFrame], *tables: str) -> Query:
    return lambda spark, sf_dir: f(*(table(spark, sf_dir, t) for t in tables))


def _packed(op) -> Query:
    """Over documents with the library's own small packs."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return op.apply(packs.with_packs(table(spark, sf_dir, "documents"), packs.own_packs(spark)))

    return run


QUERIES: dict[str, Query] = {name: _over(op.apply, op.source) for name, op in OPERATORS.items()}
ORACLE_SQL: dict[str, str] = {name: op.sql() for name, op in OPERATORS.items()}
QUERIES |= {name: _packed(op) for name, op in detector.WITH_PACKS.items()}
ORACLE_SQL |= {name: op.sql(packs.own_packs_sql()) for name, op in detector.WITH_PACKS.items()}

for _name, _f, _tables, _sql in (
    ("term_frequency", corpus.term_frequency, ["documents"], corpus.TERM_SQL),
    ("lexical_richness", corpus.lexical_richness, ["documents"], corpus.RICHNESS_SQL),
    ("char_entropy", corpus.char_entropy, ["documents"], corpus.CHAR_SQL),
    ("keywords", corpus.keywords, ["documents"], corpus.KEYWORDS_SQL),
    ("key_phrases", signals.key_phrases, ["documents"], signals.phrases_sql()),
    ("repeated_ngrams", corpus.repeated_ngrams, ["documents"], corpus.REPEATED_SQL),
    ("pair_similarity", corpus.pair_similarity, ["documents", "benchmark"], corpus.PAIR_SQL),
    ("usage_counters", corpus.usage_counters, ["events"], corpus.USAGE_SQL),
    ("latest_feedback", corpus.latest_feedback, ["events"], corpus.FEEDBACK_SQL),
    ("metric_separation", corpus.metric_separation, ["documents", "labels"], corpus.separation_sql()),
    ("sentence_scores", signals.sentence_scores, ["documents"], signals.sentence_sql()),
    ("page_blocks", corpus.page_blocks, ["pages"], corpus.BLOCKS_SQL),
    ("site_platform", pages.site_platform, ["pages"], pages.site_sql()),
    ("scan_page", pages.scan_page, ["pages"], pages.scan_sql()),
    ("usage_by_tool", corpus.usage_by_tool, ["events"], corpus.TOOL_SQL),
    ("feedback_log", corpus.feedback_log, ["events"], corpus.FEEDBACK_LOG_SQL),
    ("turn_similarity", corpus.turn_similarity, ["conversations"], corpus.TURN_SQL),
    ("summary", language.summary, ["documents"], language.SUMMARY_SQL),
    ("turns_by_role", corpus.similar_turns, ["conversations"], corpus.TURNS_SQL),
    ("style_by_source", style.style_by_source, ["documents"], style.by_source_sql()),
    ("style_compare", style.style_compare, ["documents"], style.compare_sql()),
):
    QUERIES[_name] = _over(_f, *_tables)
    ORACLE_SQL[_name] = _sql


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The page scan: blocks and who may have written them, readability, how the site was built."""
    return QUERIES["scan_page"](spark, sf_dir)
