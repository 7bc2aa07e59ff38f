"""Near-duplicates by SimHash and meet-in-the-middle ball hashing.

Fingerprints that differ in at most r bits share a value that differs from one in at most r // 2 bits and from the
other in at most r - r // 2. So every distinct fingerprint emits all values within r - r // 2 bits of itself, and
rows meet on those values in one exchange. Values come from distinct fingerprints only, so copies, however many, emit
one set, and the number of fingerprints around a value is bounded by the geometry of the ball.

Two fingerprints of which one lies within r // 2 of a value and the other within r - r // 2 differ in at most r bits.
Linking everything at a value to the smallest fingerprint within r // 2 therefore loses no connection, and pairs at a
value need not be formed. Links are made distinct and verified, then components grow by hooking to the smallest
neighbour and pointer jumping.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, map_batches, pieces


def fingerprint(text: str | None, length: int = 3) -> int:
    """64 bits, each set if it is set in over half of the hashes of the text's shingles; no word: 0."""
    import numpy as np
    from xxhash import xxh64_intdigest

    words = (text or "").encode().lower().split()  # of bytes, lower() and split() know ASCII only
    if not words:
        return 0
    n = max(1, len(words) - length + 1)
    bits, joined, ends, at = np.zeros(64, np.int64), b" ".join(words), [], -1
    for w in words:
        at += len(w) + 1
        ends.append(at)
    begins = [0, *(e + 1 for e in ends[: n - 1])]
    last = ends[length - 1 :] or ends[-1:]
    for i in range(0, n, 1 << 16):
        h = [xxh64_intdigest(joined[a:b], 42) for a, b in zip(begins[i : i + (1 << 16)], last[i : i + (1 << 16)], strict=True)]
        bits += np.unpackbits(np.array(h, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * bits > n, bitorder="little").view("<u8")[0])


def fingerprints(documents: DataFrame, length: int = 3, with_hash: bool = False) -> DataFrame:
    """doc_id and the fingerprint of each row as a long with the same bits; text_hash too if asked for."""

    extra = ["text_hash"] if with_hash else []

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for batch in pieces(batches, "text"):
            values = np.array([fingerprint(t, length) for t in batch.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values), *batch.columns[2:]], ["doc_id", "fp", *extra])

    rows = documents.select(F.col("doc_id").cast("long"), "text", *(F.xxhash64("text").alias(x) for x in extra))
    return map_batches(rows, work, ", ".join(["doc_id long", "fp long", *(f"{x} long" for x in extra)]))


def masks(radius: int) -> list[tuple[int, int]]:
    """(mask, bits set) of all 64-bit values with at most `radius` bits set, as signed longs."""
    out = []
    for k in range(radius + 1):
        for places in combinations(range(64), k):
            value = sum(1 << p for p in places)
            out.append((value - (1 << 64) if value >> 63 else value, k))
    return out


def links(prints: DataFrame, distance: int) -> DataFrame:
    """Distinct pairs a < b of the distinct fingerprints `fp`, all within `distance` bits and with the same components
    as all pairs within that distance."""
    near, far = distance // 2, distance - distance // 2
    ball = F.array(*(F.struct(F.lit(m).alias("mask"), F.lit(k <= near).alias("near")) for m, k in masks(far)))
    values = prints.select("fp", F.explode(ball).alias("m")).select(
        F.col("fp").bitwiseXOR(F.col("m.mask")).alias("value"), F.when(F.col("m.near"), F.col("fp")).alias("centre"), "fp"
    )
    met = values.groupBy("value").agg(F.min("centre").alias("centre"), F.collect_list("fp").alias("fps")).where(
        (F.size("fps") > 1) & F.col("centre").isNotNull()
    )
    pairs = met.select("centre", F.explode("fps").alias("fp")).where("fp != centre")
    return (
        pairs.select(F.least("centre", "fp").alias("a"), F.greatest("centre", "fp").alias("b")).distinct()
        .where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance)
    )


def components(edges: DataFrame) -> DataFrame:
    """node and label, the smallest node reachable, of every node in `edges` (a, b).

    Each round gives a node the smallest label among its own and its neighbours' and then that label's own label, so
    the distance to the smallest node about halves. State is written to the shared checkpoint folder in each round.
    """
    both = checkpointed(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))))
    labels = checkpointed(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("label")))
    while True:
        around = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("m"))
        hooked = labels.join(around, "node").select("node", F.least("label", "m").alias("label"), F.col("label").alias("was"))
        onward = hooked.select(F.col("node").alias("label"), F.col("label").alias("next"))
        after = checkpointed(
            hooked.join(onward, "label").select("node", F.least("label", "next").alias("label"), "was")
        )
        if after.where("label != was").isEmpty():
            return after.drop("was")
        labels = after.drop("was")


def near_duplicates(documents: DataFrame, length: int = 3, distance: int = 2) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits) and component_id of each row of `documents` (doc_id, text).

    component_id is the smallest doc_id reachable over links of at most `distance` bits; rows with equal fingerprints
    are linked. Null, empty and blank texts have fingerprint zero and link like any other. A null doc_id takes part as
    a row but is never a component's id, unless the component holds no other: then that is null. Repeated rows and
    rows with tied ids give a row each. Other columns don't matter; an empty table gives an empty result.
    """
    rows = checkpointed(fingerprints(documents, length))
    prints = checkpointed(rows.groupBy("fp").agg(F.min("doc_id").alias("least")))
    labels = components(links(prints.select("fp"), distance)).toDF("fp", "label")
    classes = prints.join(labels, "fp", "left").select("fp", "least", F.coalesce("label", "fp").alias("label"))
    smallest = classes.groupBy("label").agg(F.min("least").alias("component_id"))
    of_print = classes.join(smallest, "label").select("fp", "component_id")
    return rows.join(of_print, "fp").select("doc_id", hexadecimal(F.col("fp")).alias("fingerprint"), "component_id")


def hexadecimal(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def keep_one(documents: DataFrame, length: int = 3, distance: int = 2) -> DataFrame:
    """The rows of `documents` that stand for their component, all columns as they were.

    That is the row with the smallest doc_id; of rows tied in it the one with the smallest hash of its text, and of rows
    equal in both one. A component without any doc_id keeps one row by the same rule. What decides are narrow rows; of
    the documents only one exchange is needed, for a left semi join on (doc_id, hash of the text), and where the table
    repeats rows another for those that are left.
    """
    rows = checkpointed(fingerprints(documents.select("doc_id", "text"), length, with_hash=True))
    prints = checkpointed(rows.select("fp").distinct())
    labels = components(links(prints, distance)).toDF("fp", "label")
    classes = prints.join(labels, "fp", "left").select("fp", F.coalesce("label", "fp").alias("label"))
    # the least row of each fingerprint first, then of each component
    place = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash")
    least = rows.groupBy("fp").agg(F.min(place).alias("place")).join(classes, "fp").groupBy("label").agg(F.min("place").alias("place"))
    stay = least.select(F.col("place.doc_id").alias("k1"), F.col("place.text_hash").alias("k2"))
    one = documents.select(F.struct(*(documents[f"`{c}`"].alias(c) for c in documents.columns)).alias("row"))
    kept = one.join(
        stay, F.col("row.doc_id").cast("long").eqNullSafe(F.col("k1")) & (F.xxhash64("row.text") == F.col("k2")), "left_semi"
    ).select("row.*")
    repeats = rows.groupBy("doc_id", "text_hash").count().where("count > 1")
    return kept if repeats.isEmpty() else kept.dropDuplicates(["doc_id", "text"])
