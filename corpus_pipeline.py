"""A training corpus from documents: quality rules, near-duplicates, repeated passages, benchmark leaks, tokens.

Every stage takes what the one before kept (columns of documents) and its decisions take effect there.
Verdicts are on rows: a row is known by its doc_id (which may be null) and its text. Nulls in lang, source and
n_chars pass through; a null text counts as empty, which the quality rules reject; rows that are equal in doc_id
and text are one document and share its fate; further columns are left out; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from redpen.llm import bpe, decontaminate, quality, simhash, suffixes
from redpen.llm.base import table, written
from redpen.llm.queries import tokenizer_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: A passage that repeats across documents: 50 words of three letters, each with a space. Longer words only make a passage
#: longer, so every passage of over 50 such words is found as a whole. GRAM is the part of it that windows are dealt by.
PASSAGE_BYTES, GRAM = 200, 80


def _name() -> Column:
    """What a row is known by: its doc_id and a hash of its text."""
    return F.struct("doc_id", F.xxhash64("text").alias("of"))


def _named(docs: DataFrame) -> DataFrame:
    return docs.select(_name().alias("doc_id"), "text")


def _rows(docs: DataFrame, names: DataFrame, how: str) -> DataFrame:
    """Rows of docs by their names (column doc_id), by a semi or an anti join."""
    wanted = names.select(F.col("doc_id").alias("name")).distinct()
    return docs.select(*COLUMNS, _name().alias("name")).join(wanted, "name", how).select(*COLUMNS)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality.quality(docs.select(*COLUMNS), table(spark, sf_dir, "labels"), carry=tuple(COLUMNS[1:])).filter("kept").select(*COLUMNS)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the one with the least doc_id."""
    firsts = simhash.near_duplicates(_named(docs)).select(F.col("component_id").alias("doc_id"))
    return _rows(docs, firsts, "left_semi")


def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the bytes that repeated passages cover; n_chars follows. A text may end up empty."""
    kept = suffixes.dedup(docs, PASSAGE_BYTES, GRAM, keep=True, carry=("lang", "source"))
    return kept.select("doc_id", F.col("kept_text").alias("text"), "lang", "source", F.length("kept_text").cast("long").alias("n_chars"))


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item."""
    return _rows(docs, decontaminate.contaminated(_named(docs), table(spark, sf_dir, "benchmark")), "left_anti")


def bpe_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of every document that is left."""
    return bpe.encode_decode(docs, tokenizer_path("word_bpe_49k.json"))


STAGES = [
    ("quality rules", quality_rules),
    ("SimHash near-dedup", simhash_near_dedup),
    ("suffix-array dedup", suffix_array_dedup),
    ("benchmark decontamination", benchmark_decontamination),
    ("BPE encoding and decoding", bpe_encoding),
]

#: The stages can't be stated in SQL; tests/llm holds them against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, f"stage{k}")
    return docs
