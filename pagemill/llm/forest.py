"""Approximate nearest neighbours with a hash-prefix forest.

Each tree gives a vector a long string of digits: a random rotation's largest coordinate, by number and sign, is one
digit. A tree is the sorted array of those strings. A query descends in every tree to its longest match and ascends in
all trees together, prefix by prefix, until the prefixes that match hold `candidates` rows, and ranks what it met by
exact distance.

On Spark a tree's sorted array is cut at short prefixes: rows and queries meet by (tree, first digits), where each
group sorts its strings and finds every query's matches of each length. For each length the group returns how many rows
match and the nearest of them, so the common ascent is decided afterwards from sums of counts, in one exchange. How
many first digits groups share follows from the number of rows; where the largest group is still too large, all groups
are dealt out again by vec_id. Of equal vectors only as many as a query can return, those with the smallest vec_id,
go on, which changes no result, so a vector that fills a third of the table is no hot group.

The first digits that groups share are no floor of the ascent. Queries whose matches down to there hold too few rows
ascend on, digit by digit, in blocks of rows dealt out by vec_id. At no digits the prefix matches all rows: what is left
then is compared with all rows, as are queries that met fewer rows than they should return. Small tables are searched
that way from the start. So group_rows and the size of the table change no result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed, map_batches

DIGITS = 4
_turns: dict[tuple[int, int, int], list] = {}

ROWS = "dims int, vec_id long, is_query boolean, vector binary"
FOUND = "query_id long, vec_id long, score double, depth int, matches long"


def usable(vector: Column) -> Column:
    """Not null, with finite components only, not all of them zero."""
    good = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce(good & F.exists(vector, lambda x: x != 0), F.lit(False))


def prepared(embeddings: DataFrame, k: int, every: int) -> DataFrame:
    """Rows that take part, vectors as doubles in bytes. Queries and, of equal vectors, the k + 1 smallest ids."""
    rows = embeddings.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>").alias("v")).where(
        F.col("vec_id").isNotNull() & usable(F.col("v"))
    )

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for batch in batches:
            packed = [(np.asarray(v, "<f8") + 0.0).tobytes() for v in batch.column(1).to_pylist()]  # 0.0: no minus zero
            columns = [pa.array([len(x) // 8 for x in packed], pa.int32()), batch.column(0), pa.array(packed, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["dims", "vec_id", "vector"])

    rows = map_batches(rows, pack, "dims int, vec_id long, vector binary").distinct()
    rank = F.row_number().over(Window.partitionBy("vector").orderBy("vec_id"))
    near = rows.withColumn("rank", rank).where(F.col("rank") <= k + 1).select("dims", "vec_id", F.lit(False).alias("is_query"), "vector")
    asked = rows.where(F.col("vec_id") % every == 0).select("dims", "vec_id", F.lit(True).alias("is_query"), "vector")
    return near.unionByName(asked)


def strings(vectors, dims: int, trees: int, seed: int):
    """Digits of each vector in each tree, as one number each of base 2 * dims, most significant first."""
    import numpy as np

    if (dims, trees, seed) not in _turns:
        rng = np.random.default_rng([seed, dims])
        _turns[dims, trees, seed] = [np.linalg.qr(rng.normal(size=(dims, dims)))[0] for _ in range(trees * DIGITS)]
    out = np.zeros((len(vectors), trees), np.int64)
    for t in range(trees):
        for turn in _turns[dims, trees, seed][t * DIGITS : (t + 1) * DIGITS]:
            y = vectors @ turn
            best = np.abs(y).argmax(1)
            out[:, t] = out[:, t] * (2 * dims) + 2 * best + (y[np.arange(len(y)), best] > 0)
    return out


def dealt(rows: DataFrame, trees: int, first: int, seed: int) -> DataFrame:
    """Every row once for each tree: its group (tree and first digits) and its string."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for batch in batches:
            of = batch.column(0).to_numpy(zero_copy_only=False)
            for dims in np.unique(of):
                part = batch.filter(pa.array(of == dims))
                v = np.frombuffer(b"".join(part.column(3).to_pylist()), "<f8").reshape(-1, int(dims))
                codes = strings(v, int(dims), trees, seed)
                for t in range(trees):
                    head = codes[:, t] // (2 * int(dims)) ** (DIGITS - first)
                    columns = [pa.array(np.full(len(v), t, np.int32)), pa.array(head), pa.array(codes[:, t])]
                    yield pa.RecordBatch.from_arrays([*columns, *part.columns], ["tree", "head", "code", *part.schema.names])

    return map_batches(rows, work, f"tree int, head long, code long, {ROWS}")


def group_search(k: int, first: int) -> Callable[[pa.Table], pa.Table]:
    """For each query of a group and each length of match: how many rows match and the k nearest of them."""

    def work(table: pa.Table) -> pa.Table:
        import numpy as np

        is_query = table["is_query"].to_numpy()
        found: list[tuple] = []
        if len(table) and is_query.any():
            dims = int(table["dims"][0].as_py())
            ids, codes = table["vec_id"].to_numpy(), table["code"].to_numpy()
            v = np.frombuffer(b"".join(table["vector"].to_pylist()), "<f8").reshape(-1, dims)
            points = np.flatnonzero(~is_query)
            points = points[np.lexsort((ids[points], codes[points]))]  # the tree's sorted array
            ordered = codes[points]
            for q in np.flatnonzero(is_query):
                low, high = len(points), len(points)  # what longer prefixes have matched already: none
                for depth in range(DIGITS, first - 1, -1):
                    base = (2 * dims) ** (DIGITS - depth)
                    start = codes[q] // base * base
                    a, b = np.searchsorted(ordered, [start, start + base])
                    new = np.concatenate([points[a : min(b, low)], points[max(a, high) : b]]) if low < high else points[a:b]
                    low, high = (int(a), int(b)) if a < b else (low, high)
                    new = new[ids[new] != ids[q]]
                    if len(new):
                        score = np.sqrt(((v[new] - v[q]) ** 2).sum(1))
                        for n, best in enumerate(np.lexsort((ids[new], score))[:k]):
                            found.append((ids[q], ids[new[best]], score[best], depth, len(new) if n == 0 else 0))
        columns = [*zip(*found, strict=True)] or [[]] * 5
        kinds = [pa.int64(), pa.int64(), pa.float64(), pa.int32(), pa.int64()]
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], [x.split()[0] for x in FOUND.split(", ")])

    return work


def block_search(k: int, depth: int, trees: int, seed: int) -> Callable[[pa.Table], pa.Table]:
    """For each query of a block of rows: how many rows match in `depth` digits and no more, and the k nearest of them."""

    def work(table: pa.Table) -> pa.Table:
        import numpy as np

        is_query = table["is_query"].to_numpy()
        found: list[tuple] = []
        if len(table) and is_query.any():
            dims = int(table["dims"][0].as_py())
            ids = table["vec_id"].to_numpy()
            v = np.frombuffer(b"".join(table["vector"].to_pylist()), "<f8").reshape(-1, dims)
            codes = strings(v, dims, trees, seed)
            points = np.flatnonzero(~is_query)
            turns = [points[np.argsort(codes[points, t], kind="stable")] for t in range(trees)]
            ordered = [codes[turn, t] for t, turn in enumerate(turns)]
            low, high = (2 * dims) ** (DIGITS - depth - 1), (2 * dims) ** (DIGITS - depth)
            for q in np.flatnonzero(is_query):
                met, count = np.zeros(len(ids), bool), 0
                for t, turn in enumerate(turns):
                    near, far = codes[q, t] // low * low, codes[q, t] // high * high
                    a, x, y, b = np.searchsorted(ordered[t], [far, near, near + low, far + high])
                    for new in (turn[a:x], turn[y:b]):
                        met[new] = True
                        count += int((ids[new] != ids[q]).sum())
                new = np.flatnonzero(met & (ids != ids[q]))
                score = np.sqrt(((v[new] - v[q]) ** 2).sum(1))
                for n, best in enumerate(np.lexsort((ids[new], score))[:k]):
                    found.append((ids[q], ids[new[best]], score[best], depth, count if n == 0 else 0))
        columns = [*zip(*found, strict=True)] or [[]] * 5
        kinds = [pa.int64(), pa.int64(), pa.float64(), pa.int32(), pa.int64()]
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], [x.split()[0] for x in FOUND.split(", ")])

    return work


def in_blocks(rows: DataFrame, asked: DataFrame, shards: int, search: Callable[[pa.Table], pa.Table]) -> DataFrame:
    """Every query of `asked` against all rows: rows in blocks by vec_id, queries to each block."""
    shard = F.pmod(F.xxhash64("vec_id"), F.lit(shards))
    points = rows.where("not is_query").withColumn("shard", shard)
    queries = asked.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)).cast("array<long>")))
    both = points.unionByName(queries).withColumn("code", F.lit(0).cast("long"))
    return both.groupBy("dims", "shard").applyInArrow(search, FOUND)


def ranked(found: DataFrame, k: int) -> DataFrame:
    best = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def nearest(
    embeddings: DataFrame, k: int = 10, every: int = 100, trees: int = 48, candidates: int = 32_768, group_rows: int = 8192, seed: int = 1
) -> DataFrame:
    """query_id, rank (from 1), vec_id and score, the Euclidean distance, of the k nearest found of each query.

    Queries are the rows of `embeddings` (vec_id, embedding) whose vec_id is divisible by `every`, candidates all rows
    but the query's own. group_rows is the number of rows that groups are planned for.

    Vectors that are null, zero, or hold null or non-finite components take no part, nor do rows without vec_id.
    Vectors are compared with those of the same number of components. Rows equal in vec_id and vector count once; rows
    with equal vec_id but other vectors each take part and are no candidates of each other, and as queries share one list.
    Ties go to the smaller vec_id. Other columns don't matter; an empty table gives an empty result.
    """
    rows = checkpointed(prepared(embeddings, k, every))
    sizes = {r.dims: r.n for r in rows.where("not is_query").groupBy("dims").agg(F.count(F.lit(1)).alias("n")).collect()}
    n, dims = max(sizes.values(), default=0), max(sizes, key=sizes.get, default=1)
    shards = max(1, -(-sum(sizes.values()) // group_rows))
    queries = rows.where("is_query")
    if n <= group_rows:
        return ranked(in_blocks(rows, queries, shards, group_search(k, DIGITS)), k)
    first = next(f for f in range(1, DIGITS + 1) if n / (2 * dims) ** f <= group_rows or f == DIGITS)
    points = dealt(rows, trees, first, seed)
    largest = points.where("not is_query").groupBy("tree", "head", "dims").count().agg(F.max("count")).collect()[0][0]
    salts = -(-largest // group_rows)
    salt = F.when(
        F.col("is_query"), F.sequence(F.lit(0), F.lit(salts - 1)).cast("array<long>")
    ).otherwise(F.array(F.pmod(F.xxhash64("vec_id"), F.lit(salts))))
    salted = points.withColumn("salt", F.explode(salt))
    found = checkpointed(salted.groupBy("dims", "tree", "head", "salt").applyInArrow(group_search(k, first), FOUND))
    # the common ascent: the longest matches that hold enough rows in all trees together
    levels = found.groupBy("query_id", "depth").agg(F.sum("matches").alias("matches"))
    reached = F.sum("matches").over(Window.partitionBy("query_id").orderBy(F.desc("depth")))
    stop = levels.withColumn("before", reached - F.col("matches")).where(F.col("before") < candidates)
    stop = stop.groupBy("query_id").agg(F.min("depth").alias("stop"))
    met = found.join(stop, "query_id").where("depth >= stop")
    # queries that still hold too few rows ascend past the groups' digits
    held = found.groupBy("query_id").agg(F.sum("matches").alias("held"))
    for depth in range(first - 1, -1, -1):
        enough = held.where(F.col("held") >= candidates).select(F.col("query_id").alias("vec_id"))
        lacking = checkpointed(queries.join(enough, "vec_id", "left_anti").select(*queries.columns))
        if lacking.isEmpty() or depth == 0:
            break
        more = checkpointed(in_blocks(rows, lacking, shards, block_search(k, depth, trees, seed)))
        met = met.drop("stop").unionByName(more)
        more = more.groupBy("query_id").agg(F.sum("matches").alias("held"))
        held = held.unionByName(more).groupBy("query_id").agg(F.sum("held").alias("held"))
    best = checkpointed(ranked(met, k))
    enough = best.groupBy("query_id").count().where(F.col("count") >= k).withColumnRenamed("query_id", "vec_id")
    rest = queries.join(enough, "vec_id", "left_anti").select(*queries.columns)
    rest = checkpointed(rest.unionByName(lacking).distinct())
    if rest.isEmpty():
        return best
    again = ranked(in_blocks(rows, rest, shards, group_search(k, DIGITS)), k)
    return best.join(rest.select(F.col("vec_id").alias("query_id")).distinct(), "query_id", "left_anti").unionByName(again)
