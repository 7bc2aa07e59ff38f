"""The corpus pipeline: documents in, packed sequences out. Each stage calls one operator of pagemill.llm.

Stages take and, but for the last, return the columns of documents (doc_id, text, lang, source, n_chars; any further
columns are kept); where a stage changes a text, n_chars becomes its number of characters. Null texts don't survive the
quality rules. Rows with tied doc_id are told apart by their texts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.llm.catalog import vocabulary
from pagemill.llm.linededup import dedup_lines
from pagemill.llm.packing import pack
from pagemill.llm.quality import keep_good
from pagemill.llm.simhash import keep_one
from pagemill.llm.suffixdedup import strip_documents


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules' posterior rejects, or the base rules fail, go."""
    return keep_good(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later occurrences of three-line windows are cut out of the texts."""
    return with_text(dedup_lines(docs), docs.columns)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest doc_id stays."""
    return keep_one(docs, length=3, distance=2)


def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings of 50 bytes that also start in a document with a smaller doc_id are cut out of the texts.

    A cut may fall inside a character; what is left of such a character becomes U+FFFD.
    """
    return with_text(strip_documents(docs, length=50), docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 1024 ids."""
    return pack(docs, vocabulary("byte_bpe_50k.json"), end_id=0, length=1024)


def with_text(changed: DataFrame, columns: list[str]) -> DataFrame:
    """The documents in `row` with `text` in place of theirs, and n_chars of it where the text differs."""
    same = F.col("row.text").eqNullSafe(F.col("text"))
    n_chars = F.when(same, F.col("row.n_chars")).otherwise(F.char_length("text").cast("long"))
    new = {"text": F.col("text"), "n_chars": n_chars}
    return changed.select(*((new[c] if c in new else F.col(f"row.`{c}`")).alias(c) for c in columns))


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("SimHash near-dedup", simhash_near_dedup),
    ("suffix-array dedup", suffix_array_dedup),
    ("packing", packing),
]

#: Fingerprints, components and token ids are beyond plain SQL; tests/llm compares run() with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage, each stage applied to what the one before it kept."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs
