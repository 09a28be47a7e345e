"""The dealt operators over the given tables, one query each."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from threadlens.llm.alignment import align_tokenizers
from threadlens.llm.conversations import damaged, repair_conversations
from threadlens.llm.decontamination import contamination
from threadlens.llm.exact_dedup import dedup_exact_files
from threadlens.llm.jaccard import near_duplicates
from threadlens.llm.language import identify_languages
from threadlens.llm.line_dedup import dedup_lines
from threadlens.llm.packing import pack_documents
from threadlens.llm.quality_classifier import score_quality
from threadlens.llm.quality_rules import judge_rules
from threadlens.llm.sql import OP4_SQL, OP10_SQL, OP11_SQL, OP12_SQL
from threadlens.llm.token_counts import count_tokens
from threadlens.llm.token_files import read_token_shards, write_token_shards
from threadlens.llm.url_filter import judge_urls
from threadlens.storage import new_folder


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without later copies of repeated passages."""
    found = dedup_lines(_table(spark, sf_dir, "documents"), report=True)
    return found.select("doc_id", "n_lines", "n_removed", "text")


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of 4096 ids."""
    return pack_documents(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality of all documents."""
    return score_quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents by the rule table."""
    return judge_rules(_table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def op5_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A verdict on all page URLs."""
    return judge_urls(_table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as id shards, read back by key."""
    folder = new_folder(spark, "tokens")
    manifest = write_token_shards(
        _table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), folder
    )
    return read_token_shards(manifest, folder)


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of all documents."""
    return count_tokens(_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of all documents."""
    return identify_languages(_table(spark, sf_dir, "documents"))


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents."""
    return near_duplicates(_table(spark, sf_dir, "documents"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark passages in all documents."""
    found = contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations with planted faults, repaired."""
    return repair_conversations(damaged(_table(spark, sf_dir, "conversations")))


def op12_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact copies in all documents."""
    return dedup_exact_files(spark, f"{sf_dir}/documents.parquet")


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two tokenizers aligned over all documents."""
    return align_tokenizers(
        _table(spark, sf_dir, "documents"),
        public_tokenizers.path("byte_bpe_50k.json"),
        public_tokenizers.path("piece_bpe_32k.model"),
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_line_dedup": op1_line_dedup,
    "op2_packing": op2_packing,
    "op3_quality_classifier": op3_quality_classifier,
    "op4_quality_rules": op4_quality_rules,
    "op5_url_filters": op5_url_filters,
    "op6_token_files": op6_token_files,
    "op7_token_counts": op7_token_counts,
    "op8_language_id": op8_language_id,
    "op9_jaccard_join": op9_jaccard_join,
    "op10_decontamination": op10_decontamination,
    "op11_conversation_repair": op11_conversation_repair,
    "op12_exact_dedup": op12_exact_dedup,
    "op13_token_alignment": op13_token_alignment,
}
ORACLE_SQL: dict[str, str] = {
    "op4_quality_rules": OP4_SQL,
    "op10_decontamination": OP10_SQL,
    "op11_conversation_repair": OP11_SQL,
    "op12_exact_dedup": OP12_SQL,
}
