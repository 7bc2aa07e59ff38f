"""Packing of documents into sequences of a fixed length: concatenate and cut.

All ids stand in one long row, document after document, and sequence k holds the ids from k * length on. Where a
document begins in that row is a prefix sum in two passes: each partition's total goes to the driver (one number a
partition), and each partition then adds up its own documents behind the totals of those before it. Documents are cut
wherever a sequence ends; every cut is a boundary record, a piece. Nothing is sorted or shuffled, and only the very
last sequence is not full.

Tokens are written once to the shared checkpoint folder before the first pass. Both passes read that copy, so the
order of rows is the same for both, and after an executor is lost too.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, map_batches, pieces
from .vocab import ChunkEncoder

PIECES = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, "
    "padded_length long"
)


def tokenise(documents: DataFrame, vocabulary: str, end_id: int) -> DataFrame:
    """doc_id, the ids (`ids`, little-endian unsigned 16-bit, zlib at its fastest) of each row with end_id behind, and how
    many they are (`n`)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = ChunkEncoder.of(vocabulary, 2), end_id.to_bytes(2, "little")
        for batch in pieces(batches, "text"):
            ids = encoder.encode(batch.column(1))
            n = pa.array([len(x) // 2 + 1 for x in ids], pa.int64())
            packed = pa.array([zlib.compress(x + end, 1) for x in ids], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), packed, n], ["doc_id", "ids", "n"])

    return map_batches(documents.select(F.col("doc_id").cast("long"), "text"), work, "doc_id long, ids binary, n long")


def concatenate_and_cut(tokens: DataFrame, length: int = 1024) -> DataFrame:
    """Pieces of `tokens` (doc_id, ids and n as of tokenise) in sequences of `length` ids.

    One row per piece: start and length count ids within the document, offset within the sequence, doc_tokens is the
    document's total, ids_crc32 is over the piece's ids as little-endian unsigned 32-bit integers. padded_length is
    what the sequence is padded to: `length`, but a last sequence whose ids are a power of two in number stays as it is.

    Rows without ids give no piece; rows with equal doc_id are packed each on its own; a null doc_id stays null; an
    empty table gives an empty result.
    """
    tokens = checkpointed(tokens.select("doc_id", "ids", "n"))
    part = F.spark_partition_id()
    totals = {r.part: r.n for r in tokens.groupBy(part.alias("part")).agg(F.sum("n").alias("n")).collect()}
    begins: dict[int, int] = {}
    total = 0
    for p in sorted(totals):
        begins[p] = total
        total += totals[p]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = None
        for batch in batches:
            if batch.num_rows == 0:
                continue
            if at is None:
                at = begins[batch.column(0)[0].as_py()]
            out: list[tuple] = []
            for doc_id, packed in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                ids = wide(zlib.decompress(packed))
                n, start = len(ids) // 4, 0
                while start < n:
                    sequence, offset = divmod(at, length)
                    took = min(n - start, length - offset)
                    out.append((
                        doc_id, start, took, zlib.crc32(ids[4 * start : 4 * (start + took)]), n, sequence, offset,
                        padded(min(length, total - sequence * length), length),
                    ))
                    start += took
                    at += took
            columns = [*zip(*out, strict=True)] or [[]] * len(NAMES)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], NAMES)

    return map_batches(tokens.select(part.alias("part"), "doc_id", "ids"), cut, PIECES)


NAMES = [x.split()[0] for x in PIECES.split(", ")]


def padded(ids: int, length: int) -> int:
    return ids if ids & (ids - 1) == 0 else length


def wide(ids: bytes) -> bytes:
    """16-bit ids as 32-bit ids."""
    import numpy as np

    return np.frombuffer(ids, "<u2").astype("<u4").tobytes()


def pack(documents: DataFrame, vocabulary: str, end_id: int = 0, length: int = 1024) -> DataFrame:
    """Pieces of all documents (doc_id, text; other columns don't matter). A null or empty text is the end id alone."""
    return concatenate_and_cut(tokenise(documents, vocabulary, end_id), length)
