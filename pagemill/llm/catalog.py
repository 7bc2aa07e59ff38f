"""Registered queries of this package and their DuckDB twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .collocations import SQL as COLLOCATIONS
from .conversations import SQL as CONVERSATION_REPAIR
from .jaccard import SQL as JACCARD_JOIN
from .linededup import SQL as LINE_DEDUP


def documents(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/documents.parquet")


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_quality_rules(spark: SparkSession, d: str) -> DataFrame:
    from .quality import judge

    return judge(documents(spark, d))


def op2_byte_bpe(spark: SparkSession, d: str) -> DataFrame:
    import public_tokenizers

    from .bpe import round_trip

    return round_trip(documents(spark, d), vocabulary("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op3_token_files(spark: SparkSession, d: str) -> DataFrame:
    from .rangecoder import write_and_read

    return write_and_read(documents(spark, d), vocabulary("byte_bpe_50k.json"), end_id=2)


def op4_token_counts(spark: SparkSession, d: str) -> DataFrame:
    from .tokencounts import count_tokens

    return count_tokens(documents(spark, d), vocabulary("piece_bpe_32k.model"), limit=4096)


def op5_toxicity(spark: SparkSession, d: str) -> DataFrame:
    from .toxicity import fit, score

    labels = spark.read.parquet(f"{d}/labels.parquet")
    return score(documents(spark, d), fit(documents(spark, d), labels), threshold=0.3)


def op6_line_dedup(spark: SparkSession, d: str) -> DataFrame:
    from .linededup import dedup_lines

    return dedup_lines(documents(spark, d)).select("row.doc_id", "text", "n_lines", "n_removed")


def op7_simhash_near_dedup(spark: SparkSession, d: str) -> DataFrame:
    from .simhash import near_duplicates

    return near_duplicates(documents(spark, d), length=3, distance=2)


def op8_suffix_array_dedup(spark: SparkSession, d: str) -> DataFrame:
    from .suffixdedup import strip_repeats

    return strip_repeats(documents(spark, d), length=50).drop("kept")


def op9_packing(spark: SparkSession, d: str) -> DataFrame:
    from .packing import pack

    return pack(documents(spark, d), vocabulary("byte_bpe_50k.json"), end_id=0, length=1024)


def op10_nearest_neighbours(spark: SparkSession, d: str) -> DataFrame:
    from .forest import nearest

    return nearest(spark.read.parquet(f"{d}/embeddings.parquet"), k=10, every=100)


def op11_ngram_jaccard_join(spark: SparkSession, d: str) -> DataFrame:
    from .jaccard import similar_documents

    return similar_documents(documents(spark, d), length=3, num=9, den=10)


def op12_conversation_repair(spark: SparkSession, d: str) -> DataFrame:
    from .conversations import audit, damaged

    conversations = spark.read.parquet(f"{d}/conversations.parquet")
    return audit(damaged(conversations), conversations)


def op13_phrase_collocations(spark: SparkSession, d: str) -> DataFrame:
    from .collocations import collocations

    return collocations(documents(spark, d), least=10, first=2000, cover=50)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_rules": op1_quality_rules,
    "op2_byte_bpe": op2_byte_bpe,
    "op3_token_files": op3_token_files,
    "op4_token_counts": op4_token_counts,
    "op5_toxicity": op5_toxicity,
    "op6_line_dedup": op6_line_dedup,
    "op7_simhash_near_dedup": op7_simhash_near_dedup,
    "op8_suffix_array_dedup": op8_suffix_array_dedup,
    "op9_packing": op9_packing,
    "op10_nearest_neighbours": op10_nearest_neighbours,
    "op11_ngram_jaccard_join": op11_ngram_jaccard_join,
    "op12_conversation_repair": op12_conversation_repair,
    "op13_phrase_collocations": op13_phrase_collocations,
}

#: Operators that plain SQL can't express have none; tests/llm compares them with brute force.
ORACLES: dict[str, str] = {
    "op6_line_dedup": LINE_DEDUP,
    "op11_ngram_jaccard_join": JACCARD_JOIN,
    "op12_conversation_repair": CONVERSATION_REPAIR,
    "op13_phrase_collocations": COLLOCATIONS,
}
