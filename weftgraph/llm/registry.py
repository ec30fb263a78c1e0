"""The queries of the training-data operators, and DuckDB SQL where SQL can express them on whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from weftgraph.llm import bpe, chat, embedding_dedup, exact_dedup, html_text, lexical_search, near_dedup, packing, quality, sharding, suffix_dedup, toxicity, vector_codes
from weftgraph.session import table


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(table(spark, sf_dir, "documents"))


def op6_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_pages(table(spark, sf_dir, "pages"))


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = chat.format_chats(table(spark, sf_dir, "conversations"))
    return events.withColumn("errors", F.array_join("errors", "; "))


def chat_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``op9`` on conversations whose turns call tools and answer."""
    events = chat.format_chats(chat.with_tools(table(spark, sf_dir, "conversations")))
    return events.withColumn("errors", F.array_join("errors", "; "))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"))


def op11_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.suffix_dedup(table(spark, sf_dir, "documents"))


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.rank_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.compress(table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_exact_dedup": op1_exact_dedup,
        "op2_toxicity": op2_toxicity,
        "op3_packing": op3_packing,
        "op4_quality": op4_quality,
        "op5_bpe": op5_bpe,
        "op6_embedding_dedup": op6_embedding_dedup,
        "op7_html_text": op7_html_text,
        "op8_near_dedup": op8_near_dedup,
        "op9_chat_format": op9_chat_format,
        "chat_tool_calls": chat_tool_calls,
        "op10_sharding": op10_sharding,
        "op11_suffix_dedup": op11_suffix_dedup,
        "op12_lexical_search": op12_lexical_search,
        "op13_vector_codes": op13_vector_codes,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_exact_dedup": exact_dedup.ORACLE_SQL,
        "op9_chat_format": chat.ORACLE_SQL,
        "chat_tool_calls": chat.TOOLS_SQL,
        "op12_lexical_search": lexical_search.ORACLE_SQL,
        "op13_vector_codes": vector_codes.ORACLE_SQL,
    }
