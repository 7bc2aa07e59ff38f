"""Documents whose sets of word shingles overlap, joined exactly by Jaccard similarity, and the components they form.

A set is an array of sorted 64-bit hashes. Equal sets are one class, so copies are compared once. Candidates meet
without loss: sets with a similarity of t differ in few shingles, D say, for given sizes. If every set of a size band
deals its shingles to D + 1 + m bins by hash, linked sets agree in m + 1 bins at least, and a bin's whole content is the
key they meet on. (Of those bins one holds a shingle, unless more than m are empty; sets with so many empty bins send
the empty ones too.) A band's upper neighbours join its bins where they can still link, so no pair falls between bands.

What shares a key is chained to the first of its kind, and chained classes are a group; only there do sets travel. A
group is cut into tiles: pairs of blocks of the same or neighbouring size bands, each of bounded rows and shingles. In a
tile every set has a hashed bitmap, each shingle turning one bit. The bits in which two bitmaps differ bound the overlap
from above; pairs that may reach it are settled by exact intersection of the sorted arrays. Pairs that links have
already brought into one component are passed over, so a group of near copies costs little more than its rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import log

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, map_batches, parallelism, pieces

#: Rows and shingles of a block; they bound a tile's memory, results don't depend on them.
BLOCK_ROWS, BLOCK_SHINGLES = 2048, 1 << 20
_MIX1, _MIX2, _STEP = 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0x9E3779B97F4A7C15


class Threshold:
    """Similarity of at least `num` / `den`, in whole numbers."""

    def __init__(self, num: int, den: int) -> None:
        if not den <= 2 * num <= 2 * den:
            raise ValueError("the similarity must be between a half and one")
        self.num, self.den = num, den

    def largest(self, size: int) -> int:
        """Size of the largest set that may link with one of `size`."""
        return size * self.den // self.num

    def apart(self, sizes: int) -> int:
        """In how many shingles linked sets differ at most, given both sizes added up."""
        return sizes * (self.den - self.num) // (self.den + self.num)


class Bands:
    """Bands of sizes, each half as wide again as its lower end, and the bins of each."""

    def __init__(self, least: Threshold) -> None:
        self.least, self.begins = least, [1]

    def begin(self, band: int) -> int:
        while len(self.begins) <= band:
            self.begins.append(self.begins[-1] * 3 // 2 + 1)
        return self.begins[band]

    def of(self, size: int) -> int:
        band = 0
        while self.begin(band + 1) <= size:
            band += 1
        return band

    def bins(self, band: int) -> tuple[int, int]:
        """How many bins, and how many of them may be empty without being sent."""
        last = self.begin(band + 1) - 1
        apart = self.least.apart(last + self.least.largest(last))
        spare = 0 if apart == 0 else 1 if apart < 4 else 2
        return apart + 1 + spare, spare

    def joined(self, size: int) -> list[int]:
        """The bands in whose bins a set of this size takes part: its own, and the one below if it may link into it."""
        band = self.of(size)
        below = band > 0 and self.least.largest(self.begin(band) - 1) >= size
        return [band - 1, band] if below else [band]


def mixed(x):
    """A bijection of 64 bits in which each bit of the input turns about half of the output (splitmix)."""
    import numpy as np

    x = (x ^ (x >> np.uint64(30))) * np.uint64(_MIX1)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(_MIX2)
    return x ^ (x >> np.uint64(31))


class Words:
    """Hashes of words, remembered by a worker; starting anew bounds memory and changes no hash."""

    def __init__(self, held: int = 300_000) -> None:
        self.known: dict[bytes, int] = {}
        self.held = held

    def hashes(self, words: list[bytes]):
        import numpy as np
        from xxhash import xxh3_64_intdigest

        if len(self.known) > self.held:
            self.known.clear()
        known = self.known
        for w in set(words).difference(known):
            known[w] = xxh3_64_intdigest(w)
        return np.fromiter((known[w] for w in words), np.uint64, len(words))


def shingles(text: str | None, length: int, words: Words):
    """The sorted distinct hashes of a text's shingles; with fewer words that of the whole sequence, without any none."""
    import numpy as np

    found = (text or "").encode().lower().split()  # of bytes, lower() and split() know ASCII only
    if not found:
        return np.empty(0, np.uint64)
    h, width = words.hashes(found), min(length, len(found))
    n = len(found) - width + 1
    out = np.full(n, width, np.uint64)
    for k in range(width):
        out = mixed(out * np.uint64(_STEP) + h[k : k + n])
    return np.unique(out)


def set_hash(values) -> tuple[int, int]:
    """128 bits of a set as two signed longs; c1 is also what candidates are known by."""
    from xxhash import xxh3_128_digest

    d = xxh3_128_digest(values.tobytes())
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


def keys(values, bands: Bands) -> list[int]:
    """What a set meets others on: a signed long for each bin that it sends, none where only equal sets link."""
    import numpy as np

    out = []
    for band in bands.joined(len(values)):
        bins, spare = bands.bins(band)
        if bins == 1:
            continue
        # a bin is taken from the upper half of a hash; what it holds is known by the sum of its hashes, mixed once more
        at = ((values >> np.uint64(32)) * np.uint64(bins)) >> np.uint64(32)
        at = at.astype(np.int64)
        order = np.argsort(at, kind="stable")
        held = np.bincount(at, minlength=bins)
        begins = np.concatenate(([0], np.cumsum(held)[:-1]))
        full = held > 0
        content = np.zeros(bins, np.uint64)
        content[full] = np.add.reduceat(mixed(values[order] + np.uint64(_STEP)), begins[full])
        sent = np.flatnonzero(full) if bins - full.sum() <= spare else np.arange(bins)
        place = mixed(sent.astype(np.uint64) * np.uint64(_STEP) + np.uint64(band + 1))
        out += mixed(content[sent] ^ place).view(np.int64).tolist()
    return out


def sets(documents: DataFrame, length: int, bands: Bands) -> DataFrame:
    """doc_id, text_hash, n, c1, c2 of each row and its keys; of equal sets of one task only the first has keys, as far
    as the task remembers."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, told = Words(), set()
        for batch in pieces(batches, "text"):
            n, c1, c2, sent = [], [], [], []
            for text in batch.column(2).to_pylist():
                values = shingles(text, length, words)
                a, b = set_hash(values)
                n.append(len(values))
                c1.append(a)
                c2.append(b)
                sent.append(None if (a, b) in told else keys(values, bands) if len(values) else None)
                if len(told) > 500_000:
                    told.clear()
                told.add((a, b))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(c1, pa.int64()), pa.array(c2, pa.int64()),
                 pa.array(sent, pa.list_(pa.int64()))],
                ["doc_id", "text_hash", "n", "c1", "c2", "keys"],
            )

    rows = documents.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_hash"), "text")
    return map_batches(rows, work, "doc_id long, text_hash long, n long, c1 long, c2 long, keys array<long>")


def chains(rows: DataFrame) -> DataFrame:
    """Pairs a < b of c1: each candidate and the first of those that share a key with it."""
    from pyspark.sql import Window

    met = rows.where("keys is not null").select(F.explode("keys").alias("key"), "c1")
    first = F.min("c1").over(Window.partitionBy("key").orderBy("c1").rowsBetween(Window.unboundedPreceding, 0))
    return met.select(first.alias("a"), F.col("c1").alias("b")).where("a != b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """node and label, the least node reachable, of every node in `edges` (a, b).

    Labels sink along edges and jump to their label's label, so the distance to the least node about halves in a round.
    Edges are replaced by those between labels, so the neighbours of a hub soon are one; a node with many neighbours is
    added up within tasks first. State is written to the shared checkpoint folder in each round.
    """
    edges = checkpointed(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a != b").distinct())
    nodes = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct()
    labels = checkpointed(nodes.select("node", F.col("node").alias("label")))
    while not edges.isEmpty():
        # the least neighbour of each label that is still joined to a smaller one
        hook = edges.groupBy(F.col("b").alias("label")).agg(F.min("a").alias("up"))
        jump = hook.select(F.col("label").alias("up"), F.col("up").alias("top"))
        up = checkpointed(hook.join(jump, "up", "left").select("label", F.coalesce("top", "up").alias("up")))
        labels = checkpointed(labels.join(up, "label", "left").select("node", F.coalesce("up", "label").alias("label")))
        a = up.toDF("a", "a2")
        b = up.toDF("b", "b2")
        moved = edges.join(a, "a", "left").join(b, "b").select(F.coalesce("a2", "a").alias("x"), F.col("b2").alias("y"))
        # what b was hooked to stays joined to b's other neighbours through b's new label
        edges = checkpointed(moved.where("x != y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
    return labels


def tiles(rows: DataFrame, labels: DataFrame, least: Threshold) -> DataFrame:
    """doc_id, text_hash, tile (and side within it) of one document of each class of a group, once for each tile.

    Small groups are one tile. Larger ones are dealt to blocks by size band and hash; tiles are pairs of blocks.
    """
    width = log(least.den / least.num) * 1.001 + 1e-9  # sets that link are in the same band or in neighbours
    place = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash")
    classes = rows.groupBy("c1", "c2").agg(F.min(place).alias("place"), F.first("n").alias("n"))
    band = F.floor(F.log(F.col("n").cast("double")) / F.lit(width))
    member = checkpointed(classes.join(labels.toDF("c1", "label"), "c1").select("label", "place", "n", band.alias("band"), F.xxhash64("c1", "c2").alias("h")))
    size = member.groupBy("label", "band").agg(F.count("*").alias("rows"), F.sum("n").alias("weight"))
    blocks = F.ceil(F.greatest(F.col("rows") / BLOCK_ROWS, F.col("weight") / BLOCK_SHINGLES)).cast("int")
    small = size.groupBy("label").agg(F.sum("rows").alias("rows"), F.sum("weight").alias("weight")).where(
        f"rows > 1 and rows <= {BLOCK_ROWS} and weight <= {BLOCK_SHINGLES}"
    ).select("label")
    one = member.join(small, "label", "left_semi").select("place", F.struct(
        "label", F.lit(0).cast("long").alias("band"), F.lit(0).alias("i"), F.lit(0).cast("long").alias("other"), F.lit(0).alias("j")
    ).alias("tile"), F.lit(0).alias("side"))

    large = size.join(small, "label", "left_anti").select("label", "band", blocks.alias("blocks"))
    above = large.select("label", (F.col("band") - 1).alias("band"), F.col("blocks").alias("above"))
    below = large.select("label", (F.col("band") + 1).alias("band"), F.col("blocks").alias("below"))
    dealt = member.join(large, ["label", "band"]).join(above, ["label", "band"], "left").join(below, ["label", "band"], "left")
    dealt = dealt.withColumn("i", F.pmod("h", "blocks").cast("int"))

    def at(band: Column, i: Column, other: Column, j: Column, side: int | Column) -> Column:
        return F.struct(
            F.struct("label", band.alias("band"), i.cast("int").alias("i"), other.alias("other"), j.cast("int").alias("j")).alias("tile"),
            (F.lit(side) if isinstance(side, int) else side).alias("side"),
        )

    def numbers(n: Column) -> Column:
        return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))

    b, i = F.col("band"), F.col("i")
    own = F.transform(numbers(F.col("blocks")), lambda j: at(b, F.least(i, j), b, F.greatest(i, j), (i > j).cast("int")))
    up = F.transform(numbers(F.coalesce("above", F.lit(0))), lambda j: at(b, i, b + 1, j, 0))
    down = F.transform(numbers(F.coalesce("below", F.lit(0))), lambda j: at(b - 1, j, b, i, 1))
    many = dealt.select("place", F.explode(F.concat(own, up, down)).alias("t")).select("place", "t.tile", "t.side")
    return one.unionByName(many).select(
        F.col("place.doc_id").alias("k1"), F.col("place.text_hash").alias("k2"), F.xxhash64("tile").alias("deal"), "tile", "side"
    )


class Tile:
    """The sets of a tile; `links` gives a forest of verified links between its sides, or within it if there is one."""

    def __init__(self, least: Threshold) -> None:
        self.least = least
        self.values, self.names, self.sides = [], [], []
        self.has: set[bytes] = set()

    def add(self, values, name: bytes, side: int) -> None:
        if name not in self.has:
            self.has.add(name)
            self.values.append(values)
            self.names.append(name)
            self.sides.append(side)

    def bitmaps(self, sizes, flat, begins):
        """For each set as many 64-bit words as the largest needs, each shingle turning one bit."""
        import numpy as np

        words = 4
        while words * 64 < sizes[-1] // 2 and words < 64:
            words *= 2
        row = np.repeat(np.arange(len(sizes)), sizes)
        odd = np.zeros((len(sizes), words * 64), np.uint8)
        step = 1 << 21
        for k in range(0, len(flat), step):
            np.bitwise_xor.at(odd, (row[k : k + step], (flat[k : k + step] & np.uint64(words * 64 - 1)).astype(np.int64)), 1)
        return np.packbits(odd, axis=1).view(np.uint64)

    def links(self) -> list[tuple[bytes, bytes]]:
        import numpy as np

        count = len(self.values)
        if count < 2:
            return []
        sizes = np.array([len(v) for v in self.values])
        order = np.argsort(sizes, kind="stable")
        sizes, sides = sizes[order], np.array(self.sides)[order]
        flat = np.concatenate([self.values[k] for k in order])
        begins = np.concatenate(([0], np.cumsum(sizes)))
        bits = self.bitmaps(sizes, flat, begins)
        num, den = self.least.num, self.least.den
        component, found, both = np.arange(count), [], sides.any() and not sides.all()

        def overlaps(one: int, others):
            """Exact sizes of the intersections of set `one` with the `others`."""
            mine, lengths = flat[begins[one] : begins[one + 1]], sizes[others]
            ends = np.cumsum(lengths)
            pick = np.repeat(begins[others] - (ends - lengths), lengths) + np.arange(ends[-1])
            theirs = flat[pick]
            there = np.minimum(np.searchsorted(mine, theirs), len(mine) - 1)
            return np.add.reduceat((mine[there] == theirs).astype(np.int64), ends - lengths)

        def settle(one: int, others) -> None:
            step = max(1, (1 << 21) // int(sizes[others].max()))
            for k in range(0, len(others), step):
                part = others[k : k + step]
                part = part[component[part] != component[one]]
                if not len(part):
                    continue
                common = overlaps(one, part)
                for other in part[common * (num + den) >= num * (sizes[one] + sizes[part])].tolist():
                    if component[other] != component[one]:
                        component[component == component[other]] = component[one]
                        found.append((one, other))

        for one in range(count - 1):
            last = np.searchsorted(sizes, self.least.largest(int(sizes[one])), "right")
            others = np.arange(one + 1, last)
            others = others[component[others] != component[one]]
            if both:
                others = others[sides[others] != sides[one]]
            if not len(others):
                continue
            differ = np.bitwise_count(bits[others] ^ bits[one]).sum(1, dtype=np.int64)
            # overlap <= (sizes - differ) / 2, and a link needs overlap >= sizes * num / (num + den)
            others = others[(sizes[one] + sizes[others] - differ) * (num + den) >= 2 * num * (sizes[one] + sizes[others])]
            if not len(others):
                continue
            # one of each component first: where it links the rest of its component need not be looked at
            settle(one, others[np.unique(component[others], return_index=True)[1]])
            others = others[component[others] != component[one]]
            if len(others):
                settle(one, others)
        names = [self.names[k] for k in order]
        return [(names[a], names[b]) for a, b in found]


def verified(documents: DataFrame, dealt: DataFrame, length: int, least: Threshold) -> DataFrame:
    """Links (a, b: 16 bytes of set hash) found in the tiles."""
    spark = documents.sparkSession
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")
    needed = dealt.groupBy("k1", "k2").agg(F.collect_set(F.struct("deal", "tile", "side")).alias("at"))
    # rows repeated whole meet in the task below as equal sets
    there = rows.join(needed, F.col("doc_id").eqNullSafe(F.col("k1")) & (F.col("text_hash") == F.col("k2"))).select("text", "at")

    def arrays(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for batch in pieces(batches, "text"):
            found = [shingles(t, length, words) for t in batch.column(0).to_pylist()]
            names = [a.to_bytes(8, "big", signed=True) + b.to_bytes(8, "big", signed=True) for a, b in map(set_hash, found)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([v.tobytes() for v in found], pa.binary()), pa.array(names, pa.binary()), batch.column(1)], ["shingles", "name", "at"]
            )

    at = needed.schema["at"].dataType.simpleString()
    found = map_batches(there, arrays, f"shingles binary, name binary, at {at}")
    spread = found.select("name", "shingles", F.explode("at").alias("t")).select("name", "shingles", "t.deal", F.col("t.tile").cast("string").alias("tile"), "t.side")
    sorted_tiles = spread.repartition(parallelism(spark), "deal").sortWithinPartitions("deal", "tile")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        def out(links: list[tuple[bytes, bytes]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([x[i] for x in links], pa.binary()) for i in (0, 1)], ["a", "b"])

        now, tile = None, Tile(least)
        for batch in pieces(batches, "shingles"):
            for name, values, where, side in zip(*(batch.column(c).to_pylist() for c in (0, 1, 3, 4)), strict=True):
                if where != now:
                    yield out(tile.links())
                    now, tile = where, Tile(least)
                tile.add(np.frombuffer(values, np.uint64), name, side)
        yield out(tile.links())

    return map_batches(sorted_tiles, compare, "a binary, b binary")


def similar_documents(documents: DataFrame, length: int = 3, num: int = 9, den: int = 10) -> DataFrame:
    """doc_id, n_shingles and component_id of each row of `documents` (doc_id, text).

    Rows link where their sets of `length`-word shingles have a Jaccard similarity of `num` / `den` or more; words are
    in lower case (A to Z). Texts with fewer words have their whole sequence as the one shingle. Null, empty and blank
    texts have an empty set and link with nothing. component_id is the smallest doc_id reachable over links, the row's
    own included; a null doc_id takes part but is an id only where a component has no other. Repeated rows and rows with
    tied ids give a row each. Other columns don't matter; an empty table gives an empty result.
    """
    least = Threshold(num, den)
    rows = checkpointed(sets(documents, length, Bands(least)))
    labels = components(chains(rows))
    dealt = checkpointed(tiles(rows.where("n > 0"), labels, least))
    linked = components(checkpointed(verified(documents, dealt, length, least)))
    name = F.unhex(F.concat(*(F.lpad(F.hex(c), 16, "0") for c in ("c1", "c2"))))
    smallest = rows.where("n > 0").groupBy("c1", "c2").agg(F.min("doc_id").alias("least")).select("c1", "c2", "least", name.alias("node"))
    classes = smallest.join(linked, "node", "left").select("c1", "c2", "least", F.coalesce("label", "node").alias("label"))
    of_label = classes.groupBy("label").agg(F.min("least").alias("component_id"))
    of_class = classes.join(of_label, "label").select("c1", "c2", "component_id")
    known = rows.where("n > 0").join(of_class, ["c1", "c2"]).select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    return known.unionByName(rows.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))



#: The same in plain SQL, pair by pair.
SQL = r"""
WITH RECURSIVE d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ 	-]+') AS ws
       FROM documents),
s AS MATERIALIZED (SELECT r, doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
         ELSE list_distinct(list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])) END AS shingles FROM d),
e AS (SELECT r, len(shingles) AS n, unnest(shingles) AS x FROM s),
l AS MATERIALIZED (SELECT a.r AS a, b.r AS b FROM e a JOIN e b ON a.x = b.x AND a.r <> b.r AND 10 * a.n >= 9 * b.n AND 10 * b.n >= 9 * a.n
      GROUP BY a.r, b.r, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))),
reach AS (SELECT r, r AS other FROM s UNION SELECT reach.r, l.b FROM reach JOIN l ON l.a = reach.other)
SELECT any_value(s.doc_id) AS doc_id, any_value(len(s.shingles))::BIGINT AS n_shingles, min(o.doc_id) AS component_id
FROM reach JOIN s ON s.r = reach.r JOIN s o ON o.r = reach.other GROUP BY s.r
"""
