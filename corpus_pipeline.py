"""A corpus pipeline: five stages from raw documents to token ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each one's rows as Parquet below the
shared checkpoint folder and gives them to the next. docs has doc_id, text, lang, source and n_chars; any other columns,
whatever their names, go through the first four stages as they are and are left out by the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from doclake.llm import bpe, jaccard_join, line_dedup, mixing, quality
from doclake.llm.common import columns, public_vocabulary, scratch, stored, table

VOCABULARY = "byte_bpe_multi_50k.tiktoken"


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go.

    A null text counts as empty; null ids have no labels, null sources and languages are values of their own; rows are
    judged one by one, so ties and repeated rows are judged alike; very long texts are read whole; without labels of both
    kinds, and of an empty table, nothing is rejected.
    """
    return quality.kept(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def drop_shared_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that ten documents share go; n_chars is that of the new text.

    Null and empty texts are one empty line, which stays, so a null text comes out empty; a document that loses all its
    lines stays with an empty text; rows are documents, so ten repeated rows lose all their lines; very long texts and
    lines are read whole; an empty table gives no rows.
    """
    out = line_dedup.line_dedup(docs, counts=())
    return out.withColumn("n_chars", F.char_length("text").cast("long")).select(*columns(docs))


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near copies stays: that of the smallest id, of equal ids by a hash of all columns.

    Null and empty texts, and texts without words, are alike to nothing and stay; null ids come last; rows that repeat in
    all columns stay once; very long texts are read whole; an empty table gives no rows.
    """
    return jaccard_join.near_dedup(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document is taken as often as the mix takes it: not at all, once or twice.

    A null text has no words and is taken or not like others; a null source is the last one; rows of one id, null ids too,
    are taken alike; very long texts count whole, so a source of few of them ends less near to its target; an empty table
    gives no rows.
    """
    return mixing.mix(docs)


def to_token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_chars, n_tokens, ids and the text that the ids decode to.

    A null text counts as empty and has no ids; rows are encoded one by one, so ties and repeated rows need no rule; very
    long texts and words are encoded whole; an empty table gives no rows.
    """
    out = bpe.round_trip(docs.select("doc_id", "lang", "source", "n_chars", "text"), public_vocabulary(VOCABULARY))
    return out.select("doc_id", "lang", "source", "n_chars", "n_tokens", "ids", F.col("decoded").cast("string").alias("decoded"))


STAGES = [
    ("quality classifier", keep_good),
    ("line dedup", drop_shared_lines),
    ("n-gram Jaccard join", keep_one_of_near_copies),
    ("mixing sources", mix_sources),
    ("byte-level BPE", to_token_ids),
]

#: The classifier, the mix's hashes and the merges are beyond SQL; the tests hold the stages against plain code.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, path = table(spark, sf_dir, "documents"), scratch(spark)
    for i, (_, stage) in enumerate(STAGES):
        docs = stored(stage(spark, docs, sf_dir), f"{path}/stage{i}")
    return docs
