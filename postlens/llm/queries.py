"""The registered queries of the subpackage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from postlens.llm import (
    alignment,
    chat_formatting,
    decontamination,
    language_id,
    lexical_search,
    lm_scoring,
    near_dup,
    packing,
    quality_cascade,
    token_binary,
    token_counts,
    toxicity,
    warc,
)
from postlens.llm.common import table
from postlens.session import ship_package

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def register(name: str, fn: Callable[..., DataFrame], *sources: str, sql: str | None = None) -> None:
    """A query that gives `fn` the named tables, documents if none is named."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship_package(spark)
        return fn(*(table(spark, sf_dir, t) for t in sources or ("documents",)))

    QUERIES[name] = run
    if sql:
        ORACLES[name] = sql


register("op1_chat_formatting", chat_formatting.formatted_conversations, "conversations", sql=chat_formatting.SQL)
register("op2_packing", packing.pack)
register("op3_warc", warc.archived_pages, "pages", sql=warc.SQL)
register("op4_token_counts", token_counts.count_tokens)
register("op5_token_binary", token_binary.encode_documents)
register("op6_decontamination", decontamination.leaks, "documents", "benchmark")
register("op7_quality_cascade", quality_cascade.measure_documents, sql=quality_cascade.SQL)
register("op8_near_dup", lambda docs: near_dup.near_duplicates(docs, near_dup.Setting(width=2)), sql=near_dup.SQL)
register("op9_lm_scoring", lm_scoring.scored_documents)
register("op10_language_id", language_id.language_of_documents)
register("op11_alignment", alignment.align_documents)
register("op12_lexical_search", lexical_search.rank_documents, "documents", "benchmark", sql=lexical_search.SQL)
register("op13_toxicity", toxicity.toxicity_of_documents, "documents", "labels")
