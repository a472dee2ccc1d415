"""The registered queries of this package, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from doclake.llm import bpe, chat, collocations, exact_dedup, jaccard_join, lexical, line_dedup, lm_score, mixing, quality, token_rollup, warc, winnow
from doclake.llm.common import public_vocabulary, table


def op1_subword_lattice(spark: SparkSession, sf_dir: str, vocab_path: str | None = None) -> DataFrame:
    return lm_score.score_documents(table(spark, sf_dir, "documents"), vocab_path or public_vocabulary("byte_bpe_multi_50k.tiktoken"))


def op2_hash_threshold_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_report(table(spark, sf_dir, "documents"))


def op3_cotraining(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")
    scored = quality.score(docs, quality.train(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", "text_score", "meta_score", "quality_score", "keep")


def op4_block_naming(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op5_line_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.digest(line_dedup.line_dedup(table(spark, sf_dir, "documents").select("doc_id", "text")))


def op6_parity_sketch_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.near_components(table(spark, sf_dir, "documents"))


def op7_token_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_rollup.history(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_vector_bpe(spark: SparkSession, sf_dir: str, vocab_path: str | None = None) -> DataFrame:
    path = vocab_path or public_vocabulary("byte_bpe_multi_50k.tiktoken")
    return bpe.digest(table(spark, sf_dir, "documents"), path)


def op9_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winnow.with_edits(table(spark, sf_dir, "documents"))


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return chat.digest(chat.format_chats(rows.unionByName(chat.control_conversation(rows))))


def op11_multikey_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


def op12_stratified_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_sequential_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_subword_lattice": op1_subword_lattice,
        "op2_hash_threshold_mix": op2_hash_threshold_mix,
        "op3_cotraining": op3_cotraining,
        "op4_block_naming": op4_block_naming,
        "op5_line_runs": op5_line_runs,
        "op6_parity_sketch_join": op6_parity_sketch_join,
        "op7_token_rollup": op7_token_rollup,
        "op8_vector_bpe": op8_vector_bpe,
        "op9_winnowing": op9_winnowing,
        "op10_chat_format": op10_chat_format,
        "op11_multikey_phrases": op11_multikey_phrases,
        "op12_stratified_search": op12_stratified_search,
        "op13_sequential_warc": op13_sequential_warc,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op4_block_naming": exact_dedup.ORACLE,
        "op5_line_runs": line_dedup.ORACLE,
        "op7_token_rollup": token_rollup.ORACLE,
        "op10_chat_format": chat.ORACLE,
        "op11_multikey_phrases": collocations.ORACLE,
        "op12_stratified_search": lexical.ORACLE,
        "op13_sequential_warc": warc.ORACLE,
    }
