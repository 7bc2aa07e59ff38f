"""Token files: ids in independently reset, checksummed blocks under an adaptive range coder that mixes contexts.

The model of a block. Three predictions are mixed for each id: the id that last followed the same two ids (order 2),
the one that last followed the same id (order 1), and how often ids have occurred in the block (order 0). The first two
get a share of the coder's interval each, as large as they have been right so far with so many hits in a row of both;
order 0 divides the rest among all ids. Guesses are learnt from each id. Shares and order-0 counts are made anew after EPOCH
steps and whenever the steps have doubled. Every block begins with an empty model and ends with a checksum of its ids, so it
can be read, checked and lost on its own.

The coder. 64-bit low and range; whenever the range falls below 2 ** 32, one 32-bit word leaves (a range that straddles
a word's border is cut at the border first, so no carry is ever needed).

A block is cut into runs, which are coded side by side and share the block's model, each with words of its own: a step
codes an id of every run of every block of a segment in numpy. A segment holds whole
documents, about SEGMENT_IDS ids of them, with their ids and lengths, and is one row of the written table. Spark's own
writer commits the files, so a lost or repeated task leaves none behind, and any store that Spark knows will do.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator
from typing import TYPE_CHECKING
from uuid import uuid4

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpoint_folder, map_batches, parallelism, pieces
from .vocab import ChunkEncoder

if TYPE_CHECKING:
    import numpy as np

MAGIC = b"TOK3"
BLOCK_IDS, LANES = 1 << 14, 448
SEGMENT_IDS = BLOCK_IDS * LANES
#: Runs that a block is cut into at most, and so many ids for each.
RUNS, RUN_IDS = 16, 512
#: Each run is longer than the one before by twice this, so copies at any one distance are not all coded at the same step.
SLANT = 2
#: Steps before the model is first made anew; slots of the order-1 and order-2 tables; the coder's resolution in bits.
EPOCH, SLOTS_1, SLOTS_2, TOTAL_BITS = 32, 1 << 11, 1 << 12, 28
#: Units of the interval that order 0 always has.
LEAST_ROOM = 1 << (TOTAL_BITS - 8)
#: What one occurrence adds to an id's count of one; hits in a row that are told apart, as many as a few bits hold.
WEIGHT, LEVELS = 24, 8
#: Chances of a hit in sixteenths that a block begins with, by hits in a row, and how many outcomes they weigh.
CHANCES, PRIOR = (2, 6, 9, 11, 12, 13, 14, 15), 24
#: Contexts of the mixing: hits in a row of both guesses, once where they differ and once where they agree.
MIXED = 2 * LEVELS * LEVELS
#: Sums are looked up by what is left of them without these bits; WEIGHT is larger, so there one id with a count begins at most.
FINE = 4


class Model:
    """Side by side the models of several blocks. A lane is a run of a block, and lanes of one block share its tables.
    Tables of all blocks are flat, block after block.

    block_of: the block of each lane, by default one of its own. among: the ids that
    occur, in order, by default all.
    """

    def __init__(self, lanes: int, symbols: int, block_of: np.ndarray | None = None, among: np.ndarray | None = None) -> None:
        import numpy as np

        if symbols + WEIGHT * BLOCK_IDS > LEAST_ROOM:
            raise ValueError("too many symbols for blocks of this length")
        self.block = np.arange(lanes) if block_of is None else block_of
        self.symbols, self.blocks = symbols, int(self.block.max()) + 1
        self.among = np.arange(symbols, dtype=np.int32) if among is None else among.astype(np.int32)
        # the place of each id there; ids between one of `among` and the next
        self.place = np.zeros(symbols, np.int32)
        self.place[self.among] = np.arange(len(self.among))
        self.between = np.diff(self.among, append=np.int32(symbols)) - 1
        self.at_sums, self.at_mixed = self.block * (len(self.among) + 1), self.block * MIXED
        self.at_1, self.at_2 = self.block * SLOTS_1, self.block * SLOTS_2
        # an id and the hits in a row of guessing it, as id * LEVELS + hits
        self.table_1, self.table_2 = np.zeros(self.blocks * SLOTS_1, np.int32), np.zeros(self.blocks * SLOTS_2, np.int32)
        # how often order 0, the guess of order 1 and that of order 2 were right, by context
        right = np.array(CHANCES) / 16
        both = np.stack(np.broadcast_arrays((1 - right[:, None]) * (1 - right), right[:, None] * (1 - right), right), axis=-1)
        agreed = np.stack(np.broadcast_arrays(1 - right, 0, np.maximum(right[:, None], right)), axis=-1)
        agreed[..., 0] = 1 - agreed[..., 2]
        self.right = np.tile((PRIOR * np.stack([both, agreed])).reshape(1, MIXED, 3), (self.blocks, 1, 1))
        self.last, self.before = np.zeros(lanes, np.uint32), np.zeros(lanes, np.uint32)
        self.step = 0
        # ids that the sums hold, as block * symbols + id, in order; ids and outcomes that came since
        self.keys = np.zeros(0, np.int32)
        self.recent: list[np.ndarray] = []
        self.outcomes: list[np.ndarray] = []
        self._rebuild()

    def _rebuild(self) -> None:
        """Adds the recent ids and outcomes to the model. Sums are kept as entries: for each block one for what comes before
        all ids, and one for each id with a count, with the sums where it begins and ends."""
        import numpy as np

        first = (np.arange(self.blocks + 1) * self.symbols).astype(np.int32)
        at = first[self.block]
        self.keys = np.sort(np.concatenate([self.keys, *(ids + at[: len(ids)] for ids in self.recent)]))
        begins = np.flatnonzero(np.append(True, self.keys[1:] != self.keys[:-1])[: len(self.keys)])
        counts, distinct = np.diff(begins, append=len(self.keys)), self.keys[begins]
        block = distinct // self.symbols
        of_block = np.searchsorted(self.keys, first)
        self.totals = self.symbols + WEIGHT * np.diff(of_block)
        self.first = np.searchsorted(distinct, first) + np.arange(self.blocks + 1)
        place = np.arange(len(distinct)) + block + 1
        self.ids, self.begins = np.full(self.first[-1], -1, np.int32), np.zeros(self.first[-1], np.int32)
        self.ends = np.zeros(self.first[-1], np.int32)
        self.ids[place] = distinct - block * self.symbols
        self.begins[place] = self.ids[place] + WEIGHT * (begins - of_block[block])
        self.ends[place] = self.begins[place] + WEIGHT * counts + 1
        self._sums = self._entry = None

        if self.outcomes:
            seen = np.bincount(np.concatenate(self.outcomes), minlength=self.blocks * MIXED * 4)
            seen = seen.reshape(self.blocks, MIXED, 4)
            self.right += np.stack([seen[..., 0], seen[..., 1], seen[..., 2] + seen[..., 3]], axis=-1)
        # a guess's share is below 15 / 16 of what it is taken from, so what two leave is 1 / 256 at least, LEAST_ROOM
        # units; order 0's sums stay below that, so every id has a part of it
        whole = 1 << TOTAL_BITS
        chance = np.minimum(self.right[..., 2] / self.right.sum(axis=-1), 15 / 16)
        wide_2 = np.maximum(chance * whole, 1 << 12).astype(np.int64)
        chance = np.minimum(self.right[..., 1] / (self.right[..., 0] + self.right[..., 1]), 15 / 16)
        wide_1 = np.maximum(chance * (whole - wide_2), 1 << 12).astype(np.int64)
        wide_1[:, MIXED // 2 :] = 0
        self.wide_1, self.wide_2 = wide_1.astype(np.int32).reshape(-1), wide_2.astype(np.int32).reshape(-1)
        self.units = ((whole - wide_1 - wide_2 << 24) // self.totals[:, None]).reshape(-1)
        self.recent, self.outcomes, self.due = [], [], False

    @property
    def flat_sums(self) -> np.ndarray:
        """The running sums before each of `among` and behind the last, block after block."""
        import numpy as np

        if self.due:
            self._rebuild()
        if self._sums is None:
            self._sums = np.empty((self.blocks, len(self.among) + 1), np.int32)
            plain = np.append(self.among, np.int32(self.symbols))
            for block in range(self.blocks):
                some = slice(self.first[block], self.first[block + 1])
                more = self.ends[some] - self.ids[some] - 1
                until = np.append(self.place.take(self.ids[some][1:]) + 1, len(plain))
                np.add(plain, np.repeat(more, np.diff(until, prepend=0)), out=self._sums[block])
        return self._sums.reshape(-1)

    @property
    def sums(self) -> np.ndarray:
        return self.flat_sums.reshape(self.blocks, -1)

    def predict(self, n: int) -> None:
        """For the first n lanes: the guesses of orders 1 and 2 (g1, g2), the widths of their shares of the interval
        (w1, w2) and where order 0's share begins. Order 1 has none where it guesses the same."""
        if self.due:
            self._rebuild()
        mixed = self.last[:n] * 40503
        self.slot_1 = self.at_1[:n] + ((mixed >> 3) & (SLOTS_1 - 1))
        mixed += self.before[:n] * 2654435761
        self.slot_2 = self.at_2[:n] + ((mixed >> 7) & (SLOTS_2 - 1))
        t1, t2 = self.table_1.take(self.slot_1), self.table_2.take(self.slot_2)
        self.g1, self.g2 = t1 >> 3, t2 >> 3
        self.c1, self.c2 = t1 & 7, t2 & 7
        self.context = self.at_mixed[:n] + ((self.c1 << 3) + self.c2 + (self.g1 == self.g2) * (MIXED // 2))
        self.w1, self.w2 = self.wide_1.take(self.context), self.wide_2.take(self.context)
        self.begin = self.w1 + self.w2

    def unit(self, lanes: np.ndarray) -> np.ndarray:
        """The width of one unit of order 0's sums, times 1 << 24."""
        return self.units.take(self.context[lanes])

    def share(self, lanes: np.ndarray, low: np.ndarray, high: np.ndarray, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Begin and width of the part of the interval between two sums."""
        begin = low * unit >> 24
        return begin + self.begin[lanes], (high * unit >> 24) - begin

    def guessed(self, is_2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Begin and width of the part of the interval for guesses of order 2, and of order 1 elsewhere."""
        import numpy as np

        other = ~is_2
        a = self.w2 * other
        return a.astype(np.uint64), (self.w1 * other + (self.w2 - a)).astype(np.uint64)

    def interval(self, n: int, ids: np.ndarray, is_1: np.ndarray, is_2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Begin and width of the part of the interval that stands for `ids`."""
        import numpy as np

        a, w = self.guessed(is_2)
        rest = np.flatnonzero(~(is_1 | is_2))
        at, sums = self.place.take(ids[rest]), self.flat_sums
        place = self.at_sums[rest] + at
        a[rest], w[rest] = self.share(rest, sums.take(place), sums.take(place + 1) - self.between.take(at), self.unit(rest))
        return a, w

    def learn(self, n: int, ids: np.ndarray) -> None:
        import numpy as np

        hit_1, hit_2 = ids == self.g1, ids == self.g2
        entry = ids << 3
        # lanes of one block may meet in a slot; the last of them stays
        self.table_1[self.slot_1] = entry + np.minimum(self.c1 + 1, LEVELS - 1) * hit_1
        self.table_2[self.slot_2] = entry + np.minimum(self.c2 + 1, LEVELS - 1) * hit_2
        self.outcomes.append((self.context << 2) + (hit_1 + 2 * hit_2.view(np.int8)))
        self.recent.append(ids)
        self.before, self.last = self.last, ids.view(np.uint32)
        self.step += 1
        self.due = self.step >= EPOCH and self.step & (self.step - 1) == 0

    def find(self, lanes: int | np.ndarray, value: np.ndarray, unit: np.ndarray | None = None) -> np.ndarray:
        """The ids whose part of order 0's share holds `value`, for some lanes, or so many first ones, where it lies there;
        `low` and `high` are their sums."""
        import numpy as np

        lanes = np.arange(lanes) if isinstance(lanes, int) else lanes
        unit = self.unit(lanes) if unit is None else unit
        if self._entry is None:
            self._look_up()
        bound = ((value - self.begin[lanes] + 1 << 24) - 1) // unit  # the largest sum that may begin there
        bound = np.minimum(bound, self.top[lanes])
        x = self._entry.take(self.at_entry[lanes] + (bound >> FINE))
        x -= (self.both.take(x) >> 32) > bound
        both = self.both.take(x)
        begin, end = both >> 32, both & 0xFFFFFFFF
        # behind an entry follow ids that have not come yet, each one unit wide
        beyond = np.maximum(bound - end + 1, 0)
        self.low = begin + (bound - begin) * (beyond > 0)
        self.high = end + beyond
        return self.ids.take(x) + beyond

    def _look_up(self) -> None:
        """For each block and sum without its FINE bits: the last entry that begins there or before."""
        import numpy as np

        row = (int(self.totals.max()) >> FINE) + 1
        more = np.zeros(self.blocks * row, np.int32)
        block = np.repeat(np.arange(self.blocks), np.diff(self.first))
        known = np.flatnonzero(self.ids >= 0)
        more[block[known] * row + (self.begins[known] >> FINE)] = 1
        more[::row] += 1
        more[0] -= 1  # entries are counted from 0
        self._entry = np.cumsum(more, out=more)
        self.both = (self.begins.astype(np.int64) << 32) + self.ends
        self.at_entry, self.top = self.block * row, self.totals[self.block] - 1


def _runs(sizes_of: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The runs of blocks, longest first: the block of each, where it begins there, how many ids it has; and at each step
    how many runs are longer."""
    import numpy as np

    block, begin, size = [], [], []
    for k, n in enumerate(sizes_of):
        runs = max(1, min(RUNS, n // RUN_IDS))
        ends = [n * r // runs - SLANT * r * (runs - r) for r in range(runs + 1)]
        block += [k] * runs
        begin += ends[:-1]
        size += [b - a for a, b in zip(ends, ends[1:], strict=False)]
    turn = np.argsort(-np.array(size), kind="stable")
    sizes = np.array(size)[turn]
    return np.array(block)[turn], np.array(begin)[turn], sizes, np.searchsorted(-sizes, -np.arange(int(sizes[0])))


def encode_blocks(blocks: list[np.ndarray], symbols: int) -> list[bytes]:
    """Payloads of blocks of ids below `symbols`: the number of words of each run but the last, and the words of all runs."""
    return [x for i in range(0, len(blocks), LANES) for x in _encode(blocks[i : i + LANES], symbols)]


def _encode(blocks: list[np.ndarray], symbols: int) -> list[bytes]:
    import numpy as np

    block, begin, sizes, active = _runs([len(b) for b in blocks])
    lanes = len(sizes)
    ids = np.zeros((lanes, int(sizes[0])), np.int32)
    for lane in range(lanes):
        ids[lane, : sizes[lane]] = blocks[block[lane]][begin[lane] : begin[lane] + sizes[lane]]
    ids = _turned(ids)
    present = np.zeros(symbols, bool)
    present[ids.reshape(-1)] = True
    model = Model(lanes, symbols, block, np.flatnonzero(present))
    low, width = np.zeros(lanes, np.uint64), np.full(lanes, (1 << 64) - 1, np.uint64)
    words = np.zeros((lanes, int(sizes[0]) + 1), np.uint32)
    used = np.zeros(lanes, np.int64)
    for step, n in enumerate(active.tolist()):
        x = ids[step, :n]
        model.predict(n)
        a, w = model.interval(n, x, x == model.g1, x == model.g2)
        part = width[:n] >> np.uint64(TOTAL_BITS)
        a *= part
        low[:n] += a
        np.multiply(part, w, out=width[:n])
        short = _short(width[:n])
        if len(short):
            words[short, used[short]] = low[short] >> np.uint64(32)
            used[short] += 1
            _shift(low, width, short)
        model.learn(n, x)
    out: list[list[bytes]] = [[] for _ in blocks]
    for lane in np.lexsort((begin, block)).tolist():
        words[lane, used[lane]] = -(-int(low[lane]) >> 32)  # with zeros behind it still inside: no interval is narrower
        out[block[lane]].append(words[lane, : used[lane] + 1].astype("<u4").tobytes())
    return [struct.pack(f"<{len(runs) - 1}I", *(len(r) // 4 for r in runs[:-1])) + b"".join(runs) for runs in out]


def _turned(table: np.ndarray) -> np.ndarray:
    """Columns as rows, some columns at a time."""
    import numpy as np

    out = np.empty(table.shape[::-1], table.dtype)
    for i in range(0, table.shape[1], 64):
        out[i : i + 64] = table[:, i : i + 64].T
    return out


def _short(width: np.ndarray) -> np.ndarray:
    """Lanes that are due to part with a word."""
    import numpy as np

    return np.flatnonzero(width < np.uint64(1 << 32))


def _shift(low: np.ndarray, width: np.ndarray, lanes: np.ndarray) -> None:
    import numpy as np

    a = low[lanes]
    border = np.uint64(1 << 32) - (a & np.uint64(0xFFFFFFFF))  # beyond it the leading word would change
    low[lanes], width[lanes] = a << np.uint64(32), np.minimum(width[lanes], border) << np.uint64(32)


def decode_blocks(payloads: list[bytes], sizes_of: list[int], symbols: int) -> list[np.ndarray]:
    """The ids of each payload of encode_blocks(), given how many there are."""
    return [x for i in range(0, len(payloads), LANES) for x in _decode(payloads[i : i + LANES], sizes_of[i : i + LANES], symbols)]


def _decode(payloads: list[bytes], sizes_of: list[int], symbols: int) -> list[np.ndarray]:
    import numpy as np

    block, begin, sizes, active = _runs(sizes_of)
    lanes = len(sizes)
    words = np.zeros((lanes, int(sizes[0]) + 3), np.uint32)
    order = np.lexsort((begin, block))
    for k, some in enumerate(np.split(order, np.flatnonzero(np.diff(block[order])) + 1)):
        given = np.frombuffer(payloads[k], "<u4")
        runs = len(some)
        ends = np.append(np.cumsum(given[: runs - 1], dtype=np.int64), len(given) - runs + 1) + runs - 1
        for lane, a, b in zip(some.tolist(), [runs - 1, *ends.tolist()], ends.tolist(), strict=False):
            words[lane, : b - a] = given[a:b]
    ids = np.zeros((int(sizes[0]), lanes), np.int32)
    model = Model(lanes, symbols, block)
    low, width = np.zeros(lanes, np.uint64), np.full(lanes, (1 << 64) - 1, np.uint64)
    code = words[:, 0].astype(np.uint64) << np.uint64(32) | words[:, 1]
    at = np.full(lanes, 2)
    for step, n in enumerate(active.tolist()):
        model.predict(n)
        part = width[:n] >> np.uint64(TOTAL_BITS)
        value = code[:n] - low[:n]
        is_2 = value < part * model.w2.astype(np.uint64)
        a, w = model.guessed(is_2)
        x = model.g1 + (model.g2 - model.g1) * is_2
        rest = np.flatnonzero(value >= part * model.begin.astype(np.uint64))
        if len(rest):
            unit = model.unit(rest)
            inside = np.minimum(value[rest] // part[rest], np.uint64((1 << TOTAL_BITS) - 1)).astype(np.int64)
            x[rest] = model.find(rest, inside, unit)
            a[rest], w[rest] = model.share(rest, model.low, model.high, unit)
        a *= part
        low[:n] += a
        np.multiply(part, w, out=width[:n])
        short = _short(width[:n])
        if len(short):
            code[short] = code[short] << np.uint64(32) | words[short, at[short]]
            at[short] += 1
            _shift(low, width, short)
        ids[step, :n] = x
        model.learn(n, ids[step, :n])
    by_lane = _turned(ids)
    out = [np.zeros(n, "<u4") for n in sizes_of]
    for lane in range(lanes):
        out[block[lane]][begin[lane] : begin[lane] + sizes[lane]] = by_lane[lane, : sizes[lane]]
    return out


def write_segment(ids: np.ndarray, symbols: int) -> bytes:
    """MAGIC, number of symbols and of blocks; for each block its ids, its payload's bytes and the crc32 of both; payloads."""
    blocks = [ids[i : i + BLOCK_IDS] for i in range(0, len(ids), BLOCK_IDS)]
    payloads = encode_blocks(blocks, symbols)
    heads = [
        struct.pack("<4I", len(b), len(p), zlib.crc32(b.astype("<u4").tobytes()), zlib.crc32(p)) for b, p in zip(blocks, payloads, strict=True)
    ]
    return b"".join([MAGIC, struct.pack("<2I", symbols, len(blocks)), *heads, *payloads])


def read_segment(data: bytes) -> np.ndarray:
    """The ids of write_segment(); ValueError where a block is damaged."""
    import numpy as np

    if data[:4] != MAGIC:
        raise ValueError("not a token segment")
    symbols, n = struct.unpack_from("<2I", data, 4)
    heads = [struct.unpack_from("<4I", data, 12 + 16 * k) for k in range(n)]
    at, payloads = 12 + 16 * n, []
    for k, (_, size, _, check) in enumerate(heads):
        payloads.append(data[at : at + size])
        at += size
        if zlib.crc32(payloads[-1]) != check:
            raise ValueError(f"block {k} is damaged")
    blocks = decode_blocks(payloads, [h[0] for h in heads], symbols)
    for k, (block, head) in enumerate(zip(blocks, heads, strict=True)):
        if zlib.crc32(block.tobytes()) != head[2]:
            raise ValueError(f"block {k} does not match its checksum")
    return np.concatenate([*blocks, np.array([], "<u4")])


SEGMENTS = "part int, segment int, first_start long, doc_ids binary, nulls binary, lengths binary, data binary"


def write_tokens(documents: DataFrame, path: str, vocabulary: str, end_id: int) -> None:
    """Writes the ids of `documents` (doc_id, text), each with end_id behind, in ascending order of doc_id (null first).

    Texts are put in order before they become ids, by one exchange over ranges; rows tied in doc_id follow each other in
    the order of a hash of their texts. Starts within a part are written with it; read_tokens() adds what earlier parts hold.
    """
    symbols_of = ChunkEncoder.symbols(vocabulary)
    if not 0 <= end_id < symbols_of:
        raise ValueError("end_id is not in the vocabulary")
    rows = documents.select(F.col("doc_id").cast("long"), "text")
    parts = parallelism(documents.sparkSession)
    ordered = rows.repartitionByRange(parts, "doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"), "text")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        encoder, end = ChunkEncoder.of(vocabulary, 4), end_id.to_bytes(4, "little")
        held: list[tuple[int | None, bytes]] = []
        total, start, segment = 0, 0, 0
        part = None

        def segment_of() -> pa.RecordBatch:
            ids = np.frombuffer(b"".join(x for _, x in held), "<u4")
            row = (
                part, segment, start, np.array([i or 0 for i, _ in held], "<i8").tobytes(), bytes(i is None for i, _ in held),
                np.array([len(x) // 4 for _, x in held], "<i8").tobytes(), write_segment(ids, symbols_of),
            )
            kinds = [pa.int32(), pa.int32(), pa.int64(), *[pa.binary()] * 4]
            return pa.RecordBatch.from_arrays([pa.array([c], k) for c, k in zip(row, kinds, strict=True)], [x.split()[0] for x in SEGMENTS.split(", ")])

        for batch in pieces(batches, "text"):
            part = batch.column(0)[0].as_py()
            for doc_id, ids in zip(batch.column(1).to_pylist(), encoder.encode(batch.column(2)), strict=True):
                held.append((doc_id, ids + end))
                total += len(ids) // 4 + 1
                if total >= SEGMENT_IDS:
                    yield segment_of()
                    start, segment, held, total = start + total, segment + 1, [], 0
        if held:
            yield segment_of()

    map_batches(ordered.select(F.spark_partition_id().alias("part"), "doc_id", "text"), work, SEGMENTS).write.parquet(path)


READ = "doc_id long, start long, ids binary"


def read_tokens(spark: SparkSession, path: str, then: Callable[[pa.RecordBatch], pa.RecordBatch] | None = None, schema: str = READ) -> DataFrame:
    """doc_id, start (ids of all documents before it), and `ids` (little-endian unsigned 32-bit) of each document written.

    then: what is made of each batch of these in the task that reads it, with columns as in `schema`; a step of its own
    would have a second Python worker for each task.
    """
    segments = spark.read.schema(SEGMENTS).parquet(path)
    lengths: dict[int, int] = {}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for batch in batches:
            n = [int(np.frombuffer(x, "<i8").sum()) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64())], ["part", "n"])

    totals = map_batches(segments.select("part", "lengths"), count, "part int, n long").groupBy("part").agg(F.sum("n").alias("n")).collect()
    total = 0
    for r in sorted(totals, key=lambda r: r.part):  # one number for each part
        lengths[r.part] = total
        total += r.n

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for batch in batches:
            for part, _, first, doc_ids, nulls, sizes, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                ids, n = read_segment(data).tobytes(), np.frombuffer(sizes, "<i8")
                ends = np.cumsum(n)
                columns = [
                    pa.array([None if x else int(i) for i, x in zip(np.frombuffer(doc_ids, "<i8"), nulls, strict=True)], pa.int64()),
                    pa.array(lengths[part] + first + ends - n), pa.array([ids[4 * a : 4 * b] for a, b in zip(ends - n, ends, strict=True)], pa.binary()),
                ]
                made = pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "ids"])
                yield then(made) if then else made

    return map_batches(segments, work, schema)


DIGESTS = "doc_id long, start long, n_tokens long, ids_crc32 long"


def digest(batch: pa.RecordBatch) -> pa.RecordBatch:
    """doc_id, start, n_tokens and ids_crc32 of a batch of read_tokens()."""
    ids = batch.column(2).to_pylist()
    columns = [batch.column(0), batch.column(1), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array([zlib.crc32(x) for x in ids], pa.int64())]
    return pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "n_tokens", "ids_crc32"])


def write_and_read(documents: DataFrame, vocabulary: str, end_id: int) -> DataFrame:
    """digest() of `documents` after a round through files in the shared checkpoint folder.

    A null or empty text is the end id alone; repeated rows and tied ids are documents of their own; a null doc_id comes
    first; other columns don't matter; an empty table gives an empty result.
    """
    spark = documents.sparkSession
    path = f"{checkpoint_folder(spark)}/tokens-{uuid4().hex}"
    write_tokens(documents, path, vocabulary, end_id)
    return read_tokens(spark, path, digest, DIGESTS)
