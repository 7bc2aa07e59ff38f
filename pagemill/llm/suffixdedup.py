"""Removal of byte strings of a fixed length that also start in a document with a smaller doc_id.

Where equal strings meet. Every window of `length` bytes has a least k-byte part, by a fixed order of hashes. Windows
that follow each other and share it form a segment, so each window of a text lies in one segment, and equal windows
have equal least parts. Segments are dealt out by that part: equal strings meet in one task, and a text moves about
three times in one exchange, whatever it holds. A segment repeated inside a task of the first step leaves it once.
A part that very many different segments share, as next to a passage in many documents, would fill one task: such parts
are counted first, in slots of their hashes, and their windows are dealt out one by one, by the hash of the whole window.

What is decided there. Equal segments are found by their bytes as they arrive: those in documents with a larger doc_id
are removed, and one stays to stand for its strings, so memory follows the distinct segments of a task. Different
segments may still share strings, at the ends of what documents have in common. Segments that hold a window whose hash
occurs again are clipped to such windows, settled by their bytes once more and put into a suffix array (suffixes.py);
suffixes that agree in `length` bytes, compared byte by
byte, stand side by side in it, and of each run of them only those with the smallest doc_id stay.

Spans go back to the documents by one join on (doc_id, hash of the text). Rows equal in both are one document. Rows
with equal doc_id but other texts are different documents of which neither is smaller. A null doc_id counts as smaller
than any other. Null and empty texts, and texts shorter than `length`, lose nothing. Matches never cross documents.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import TYPE_CHECKING

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, parallelism, pieces
from .suffixes import suffix_array
from .vocab import forget_all

if TYPE_CHECKING:
    import numpy as np

#: Bytes of the parts that segments are dealt by.
PART = 10
#: Bytes worked on at once when texts are cut into segments, and bytes of one suffix array where segments allow it.
CUT_BYTES, ARRAY_BYTES = 3 << 20, 128 << 10
#: Odd, so that powers of it can be inverted: the base of the hashes.
BASE = 0x9E3779B97F4A7C15
#: Slots that segments are counted in by their part. A part is hot if its slot holds HOT times the mean and HOT_SHARE of
#: what a task gets on average; smaller ones can't make a task uneven, and dealing out their windows would move more.
SLOTS, HOT, HOT_SHARE = 1 << 16, 8, 0.5
LEAST = -(1 << 63)  # stands for a null doc_id
#: Segments that a task is to hold, about, and rows of a batch of spans.
TASK_SEGMENTS, SPAN_ROWS = 400_000, 100_000

SEGMENTS = "target int, doc_ids binary, text_hashes binary, places binary, payload binary, kind int"
NAMES = [x.split()[0] for x in SEGMENTS.split(", ")]
#: A span is one number: its begin in the upper half, its end in the lower; texts are shorter than 2^31 bytes.
SPANS = "doc_id long, text_hash long, span long"
HALF = 32


def rolling(data: np.ndarray, length: int) -> np.ndarray:
    """A 64-bit hash of the `length` bytes from each place on; none where fewer are left."""
    import numpy as np

    with np.errstate(over="ignore"):
        out, done, power = None, 0, data.astype(np.uint64) + np.uint64(1)
        width, factor, n = 1, np.uint64(BASE), length
        while n:
            if n & 1:
                if out is None:
                    out = power
                else:
                    m = min(len(out), max(0, len(power) - done))
                    out = out[:m] * factor + power[done : done + m]
                done += width
            n >>= 1
            if n:
                m = max(0, len(power) - width)
                power = power[:m] * factor + power[width : width + m]
                width *= 2
                factor = factor * factor
        return out[: max(0, len(data) - length + 1)]


def mixed(h: np.ndarray) -> np.ndarray:
    import numpy as np

    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return h ^ (h >> np.uint64(29))


def least_parts(data: np.ndarray, length: int) -> np.ndarray:
    """The least mixed hash of a part in each window of `length` bytes."""
    import numpy as np

    h = mixed(rolling(data, PART))
    want, width = length - PART + 1, 1
    while width * 2 <= want:
        h, width = np.minimum(h[: len(h) - width], h[width:]), width * 2
    rest = want - width
    return np.minimum(h[: len(h) - rest], h[rest:]) if rest else h


def slots(parts: np.ndarray) -> np.ndarray:
    """The slot of each part. Least parts are small numbers, so they are mixed first."""
    import numpy as np

    with np.errstate(over="ignore"):
        return (mixed(parts * np.uint64(BASE)) >> np.uint64(20)).astype(np.int64) % SLOTS


def cut(texts: list[tuple[int, bytes]], length: int, hot: frozenset[int] = frozenset()) -> tuple[np.ndarray, ...]:
    """Segments of numbered texts: data, and for each segment its text's number, its start there and in data, its size
    and what it is dealt by: its least part; each window of a part in a hot slot is a segment dealt by its own hash. A text longer than CUT_BYTES comes in several, each with its own offset, see blocks()."""
    import numpy as np

    data = np.frombuffer(b"".join(t for _, t in texts), np.uint8)
    sizes = np.array([len(t) for _, t in texts])
    begins = np.cumsum(sizes) - sizes
    if len(data) < length:
        return data, *(np.array([], np.int64),) * 4, np.array([], np.uint64)
    parts = least_parts(data, length)
    inside = np.ones(len(parts), bool)
    for b, n in zip(begins, sizes, strict=True):  # windows that would cross into the next text
        inside[max(b, b + n - length + 1) : b + n] = False
    fresh = np.ones(len(parts), bool)
    fresh[1:] = (parts[1:] != parts[:-1]) | ~inside[:-1]
    fresh[begins[begins < len(parts)]] = True
    if hot:
        is_hot = np.zeros(SLOTS, bool)
        is_hot[[*hot]] = True
        single = is_hot[slots(parts)]
        fresh |= single
        fresh[1:] |= single[:-1]
        parts = np.where(single, mixed(rolling(data, length)), parts)
    at = np.flatnonzero(fresh & inside)
    stops = np.append(np.flatnonzero(fresh | ~inside), len(parts))
    ends = stops[np.searchsorted(stops, at, "right")]
    text = np.searchsorted(begins, at, "right") - 1
    return data, text, at - begins[text], at, ends - at + length - 1, parts[at]


def blocks(batch_texts: list[bytes], length: int) -> Iterator[list[tuple[int, int, bytes]]]:
    """(number, offset, bytes) of texts or of overlapping pieces of long ones, about CUT_BYTES at a time."""
    block: list[tuple[int, int, bytes]] = []
    total = 0
    for k, t in enumerate(batch_texts):
        for offset in range(0, max(1, len(t) - length + 1), CUT_BYTES):
            piece = t[offset : offset + CUT_BYTES + length - 1]
            if block and total + len(piece) > CUT_BYTES:
                yield block
                block, total = [], 0
            block.append((k, offset, piece))
            total += len(piece)
    if block:
        yield block


class Segments:
    """Distinct segments by their bytes with the occurrences of the smallest doc_id; the other occurrences are `gone`."""

    def __init__(self) -> None:
        self.ids: list[int] = []  # doc_id of each occurrence
        self.stands: dict[bytes, int] = {}
        self.ties: dict[int, list[int]] = {}  # further occurrences under the same smallest doc_id
        self.gone: list[int] = []

    def add(self, keys: list[bytes], ids: list[int]) -> None:
        base, stands, mine, ties, gone = len(self.ids), self.stands, self.ids, self.ties, self.gone
        mine.extend(ids)
        for k, key in enumerate(keys, base):
            o = stands.setdefault(key, k)
            if o != k:
                if mine[k] > mine[o]:
                    gone.append(k)
                elif mine[k] < mine[o]:
                    gone.append(o)
                    gone.extend(ties.pop(o, ()))
                    stands[key] = k
                else:
                    ties.setdefault(o, []).append(k)


def shared_windows(keys: list[bytes], ids: list[int], length: int) -> list[tuple[int, np.ndarray]]:
    """(number of a segment, starts of its windows that also occur in a segment with a smaller id), for distinct segments."""
    import numpy as np

    if not keys:
        return []
    # hashes of all windows, segment after segment
    counts = np.array([len(k) - length + 1 for k in keys], np.int64)
    h = np.empty(int(counts.sum()), np.uint64)
    begins, done, begin, total = np.cumsum(counts) - counts, 0, 0, 0
    for i, k in enumerate(keys):
        total += len(k)
        if total >= CUT_BYTES or i + 1 == len(keys):
            sizes = counts[begin : i + 1] + length - 1
            inside = np.ones(total, bool)
            for back in range(1, length):
                inside[np.cumsum(sizes) - back] = False
            some = rolling(np.frombuffer(b"".join(keys[begin : i + 1]), np.uint8), length)
            some = some[inside[: len(some)]]
            h[done : done + len(some)] = some
            done, begin, total = done + len(some), i + 1, 0
    ordered = np.sort(h)
    again = ordered[1:][ordered[1:] == ordered[:-1]]
    del ordered
    # a table of the hashes' last bits passes few others, which the exact look at equal hashes then drops
    bits = np.uint64((1 << max(16, len(again).bit_length() + 4)) - 1)
    table = np.zeros(int(bits) + 1, bool)
    table[again & bits] = True
    hits = np.flatnonzero(table[h & bits])
    hits = hits[np.argsort(h[hits], kind="stable")]
    owner = np.searchsorted(begins, hits, "right") - 1
    equal, of = h[hits], np.array(ids, np.int64)[owner]
    del h, table
    edges = np.array([a for a, _ in _runs(equal)], np.int64)
    if not len(edges):
        return []
    several = np.minimum.reduceat(of, edges) < np.maximum.reduceat(of, edges)
    several = np.repeat(several, np.diff(np.append(edges, len(equal))))
    hits, owner = (hits - begins[owner])[several], owner[several]
    if not len(hits):
        return []
    # of each segment, the bytes from its first to its last window in question
    chosen, which = np.unique(owner, return_inverse=True)
    first, last = counts[chosen], np.zeros(len(chosen), np.int64)
    np.minimum.at(first, which, hits)
    np.maximum.at(last, which, hits)
    # equal windows have equal least parts: segments of one least part must be in one array, others need not
    windows = np.frombuffer(b"".join([keys[i][a : a + length] for i, a in zip(chosen.tolist(), first.tolist(), strict=True)]), np.uint8)
    parts = least_parts(windows, length)[::length]
    out: list[tuple[int, np.ndarray]] = []
    turn = np.argsort(parts, kind="stable")
    cut_at: list[tuple[int, int, int]] = []
    total = 0
    # pieces equal as bytes are settled first: one of the smallest id goes into an array for all of that id
    clipped = Segments()
    clipped.add([keys[i][a : b + length] for i, a, b in zip(chosen.tolist(), first.tolist(), last.tolist(), strict=True)], [ids[i] for i in chosen.tolist()])
    for t in clipped.gone:
        out.append((int(chosen[t]), np.arange(first[t], last[t] + 1)))
    stays = np.zeros(len(chosen), bool)
    stays[[*clipped.stands.values()]] = True
    turn = turn[stays[turn]]
    tied = {int(chosen[o]): [(int(chosen[t]), int(first[t] - first[o])) for t in ts] for o, ts in clipped.ties.items()}
    del clipped
    for n, t in enumerate(turn):
        cut_at.append((int(chosen[t]), int(first[t]), int(last[t]) + length))
        total += cut_at[-1][2] - cut_at[-1][1] + 1
        if n + 1 == len(turn) or total >= ARRAY_BYTES and parts[turn[n + 1]] != parts[t]:
            texts = [np.frombuffer(keys[i], np.uint8, b - a, a) for i, a, b in cut_at]
            for k, found in _in_array(texts, [ids[i] for i, _, _ in cut_at], length):
                windows = found + cut_at[k][1]
                out.append((cut_at[k][0], windows))
                out.extend((i, windows + shift) for i, shift in tied.get(cut_at[k][0], ()))
            cut_at, total = [], 0
    return out


def _in_array(texts: list[np.ndarray], ids: list[int], length: int) -> list[tuple[int, np.ndarray]]:
    """shared_windows() of some texts, from the suffix array of them all."""
    import numpy as np

    sizes = np.array([len(t) + 1 for t in texts])
    begins = np.cumsum(sizes) - sizes
    data = np.zeros(int(sizes.sum()), np.int16)  # texts end in 0, below every byte
    for t, b in zip(texts, begins, strict=True):
        data[b : b + len(t)] = t.astype(np.int16) + 1
    order = np.array(suffix_array(data.tolist()), np.int64)
    owner = np.searchsorted(begins, order, "right") - 1
    whole = order + length <= begins[owner] + sizes[owner] - 1  # `length` bytes are left in the text
    order, owner = order[whole], owner[whole]
    same = np.ones(max(0, len(order) - 1), bool)
    for k in range(length):
        live = np.flatnonzero(same)
        same[live] = data[order[live] + k] == data[order[live + 1] + k]
    run = np.append(0, np.cumsum(~same))[: len(order)]
    of = np.array(ids, np.int64)[owner]
    least = np.full(int(run[-1]) + 1 if len(run) else 0, np.iinfo(np.int64).max)
    np.minimum.at(least, run, of)
    found = of > least[run]
    order, owner = order[found], owner[found]
    turn = np.lexsort((order, owner))
    order, owner = order[turn], owner[turn]
    return [(int(owner[a]), order[a:b] - begins[owner[a]]) for a, b in _runs(owner)]


def _merged(docs: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans of numbered documents in ascending order without overlaps; spans of a document that touch become one."""
    import numpy as np

    base = docs.astype(np.int64) << HALF
    begins, ends = base + begins, base + ends
    turn = np.argsort(begins, kind="stable")
    begins, ends = begins[turn], np.maximum.accumulate(ends[turn])
    fresh = np.append(True, begins[1:] > ends[:-1])[: len(begins)]
    begins, ends = begins[fresh], ends[np.append(fresh[1:], True)[: len(ends)]]
    docs = begins >> HALF
    return docs, begins - (docs << HALF), ends - (docs << HALF)


def _runs(values: np.ndarray) -> list[tuple[int, int]]:
    """Begin and end of each run of equal values."""
    import numpy as np

    edges = (np.flatnonzero(values[1:] != values[:-1]) + 1).tolist()
    return [*zip([0, *edges], [*edges, len(values)], strict=True)] if len(values) else []


def _bytes_of(batch: pa.RecordBatch, column: int) -> list[bytes]:
    return [x or b"" for x in batch.column(column).cast(pa.binary()).to_pylist()]


def planes(values: np.ndarray) -> bytes:
    """Numbers byte by byte: the lowest bytes of all, then the next; small numbers leave planes of zeros, which pack well."""
    import numpy as np

    return np.ascontiguousarray(values.view(np.uint8).reshape(len(values), -1).T).tobytes()


def from_planes(data: np.ndarray, kind: str) -> np.ndarray:
    import numpy as np

    return np.ascontiguousarray(data.reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def packed(packer, docs: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> bytes:
    """Three columns of one row, as differences where they ascend."""
    import numpy as np

    fresh = np.append(True, docs[1:] != docs[:-1])
    steps = np.where(fresh, starts, starts - np.append(0, starts[:-1]))
    return packer.compress(b"".join(planes(x.astype(k)) for x, k in ((np.diff(docs, prepend=0), "<i4"), (steps, "<i8"), (sizes, "<i4"))))


def unpacked(opener, data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    import numpy as np

    raw = np.frombuffer(opener.decompress(data), np.uint8)
    n = len(raw) // 16
    docs = np.cumsum(from_planes(raw[: 4 * n], "<i4"))
    steps, sizes = from_planes(raw[4 * n : 12 * n], "<i8"), from_planes(raw[12 * n :], "<i4").astype(np.int64)
    total = np.cumsum(steps)
    first = np.flatnonzero(np.append(True, docs[1:] != docs[:-1]))
    before = np.repeat(total[first] - steps[first], np.diff(np.append(first, n)))
    return docs, total - before, sizes


def hot_slots(documents: DataFrame, length: int, targets: int | None = None) -> tuple[frozenset[int], int]:
    """Slots of parts that too many different segments share, and the number of targets, so many that a task holds about
    TASK_SEGMENTS however large the table, where it isn't given. Neither changes a result.

    A task passes on only counts above its own mean, so little moves, and what is not passed on is below the mean too.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        forget_all()  # segments need the memory
        counts = np.zeros(SLOTS, np.int64)
        for batch in pieces(batches, "text"):
            for block in blocks(_bytes_of(batch, 0), length):
                data, _, _, at, size, part = cut([(0, t) for _, _, t in block], length)
                if len(at):
                    # different segments of the block, told apart by their first and last window
                    with np.errstate(over="ignore"):
                        h = rolling(data, length)
                        whole = mixed(h[at] * np.uint64(BASE) + h[at + size - length]) ^ part
                    _, one = np.unique(whole, return_index=True)
                    counts += np.bincount(slots(part[one]), minlength=SLOTS)
        big = np.flatnonzero(counts > 2 * counts.mean() + 16)
        yield pa.RecordBatch.from_arrays([pa.array([-1, *big.tolist()], pa.int32()), pa.array([int(counts.sum()), *counts[big].tolist()], pa.int64())], ["slot", "n"])

    texts = documents.select("text").where(F.octet_length("text") >= length)
    total = map_batches(texts, work, "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n"))
    of = {r.slot: r.n for r in total.collect()}  # SLOTS + 1 rows at most
    segments = of.pop(-1, None) or 0
    targets = targets or max(2 * parallelism(documents.sparkSession), segments // TASK_SEGMENTS)
    least = max(HOT_SHARE * segments / targets, HOT * segments / SLOTS)
    return frozenset(slot for slot, n in of.items() if n > least), targets


def to_segments(documents: DataFrame, length: int, targets: int, hot: frozenset[int] = frozenset()) -> DataFrame:
    """Segments of all documents, one row for each task's batch and target; of segments repeated in a batch, spans instead."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        import zstandard

        packer = zstandard.ZstdCompressor(level=3)
        for batch in pieces(batches, "text"):
            ids = [LEAST if x is None else x for x in batch.column(0).to_pylist()]
            hashes = np.array(batch.column(1).to_pylist(), np.int64)
            all_ids = np.array(ids, np.int64)
            for block in blocks(_bytes_of(batch, 2), length):
                data, text, start, at, size, part = cut([(0, t) for _, _, t in block], length, hot)
                if not len(at):
                    continue
                number = np.array([k for k, _, _ in block])[text]
                start = start + np.array([o for _, o, _ in block])[text]
                raw = data.tobytes()
                keys = [raw[a : a + n] for a, n in zip(at.tolist(), size.tolist(), strict=True)]
                seen = Segments()
                seen.add(keys, all_ids[number].tolist())
                gone = np.array(seen.gone, np.int64)
                stay = np.ones(len(keys), bool)
                stay[gone] = False
                rows: list[tuple] = []
                if len(gone):
                    docs, b, e = _merged(number[gone], start[gone], start[gone] + size[gone])
                    for x, y in _runs(docs):
                        k = docs[x]
                        rows.append((int(hashes[k] ^ all_ids[k]) % targets, all_ids[k : k + 1].tobytes(), hashes[k : k + 1].tobytes(), b[x:y].tobytes(), e[x:y].tobytes(), 1))
                left = np.flatnonzero(stay)
                target = (part[left] % np.uint64(targets)).astype(np.int64)
                turn = np.argsort(target, kind="stable")
                left, target = left[turn], target[turn]
                for a, b in _runs(target):
                    some = left[a:b]
                    docs, which = np.unique(number[some], return_inverse=True)
                    rows.append((
                        int(target[a]), packer.compress(planes(np.diff(all_ids[docs], prepend=0))), hashes[docs].tobytes(),
                        packed(packer, which, start[some], size[some]),
                        packer.compress(b"".join([keys[i] for i in some])), 0,
                    ))
                kinds = [pa.int32(), *[pa.binary()] * 4, pa.int32()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], NAMES)

    rows = documents.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_hash"), "text").where(F.octet_length("text") >= length)
    return map_batches(rows, work, SEGMENTS)


def repeated_spans(segments: DataFrame, length: int, targets: int) -> DataFrame:
    """Spans to remove, a row each, merged within each task and document: rows follow what repeats, not the number of tasks."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        import zstandard

        opener = zstandard.ZstdDecompressor()
        seen, known = Segments(), {}
        doc_keys: list[tuple[int, int]] = []
        doc_of: list[np.ndarray] = []
        starts: list[np.ndarray] = []
        sizes: list[np.ndarray] = []
        spans: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                _, ids, hashes, places, payload, kind = row
                ids = np.frombuffer(ids, "<i8") if kind else np.cumsum(from_planes(np.frombuffer(opener.decompress(ids), np.uint8), "<i8"))
                keys = [*zip(ids.tolist(), np.frombuffer(hashes, "<i8").tolist(), strict=True)]
                for key in keys:
                    if key not in known:
                        known[key] = len(doc_keys)
                        doc_keys.append(key)
                if kind:
                    begins = np.frombuffer(places, "<i8")
                    spans.append((np.full(len(begins), known[keys[0]]), begins, np.frombuffer(payload, "<i8")))
                    continue
                which, start, size = unpacked(opener, places)
                starts.append(start)
                sizes.append(size)
                doc_of.append(np.array([known[k] for k in keys], np.int32)[which])
                raw, ends = opener.decompress(payload), np.cumsum(size)
                seen.add(
                    [raw[a:b] for a, b in zip((ends - size).tolist(), ends.tolist(), strict=True)],
                    ids[which].tolist(),
                )
        none = np.array([], np.int64)
        of, start, size = np.concatenate([*doc_of, none]), np.concatenate([*starts, none]), np.concatenate([*sizes, none])
        gone = np.array(seen.gone, np.int64)
        found = [(of[gone], start[gone], start[gone] + size[gone])]
        keys, stands = [*seen.stands], [*seen.stands.values()]
        for i, windows in shared_windows(keys, [seen.ids[o] for o in stands], length):
            for o in (stands[i], *seen.ties.get(stands[i], ())):
                found.append((np.full(len(windows), of[o]), start[o] + windows, start[o] + windows + length))
        docs, begins, ends = _merged(*(np.concatenate(x) for x in zip(*found, *spans, strict=True)))
        ids, hashes = np.array(doc_keys, np.int64).reshape(-1, 2).T
        for a in range(0, len(docs), SPAN_ROWS):
            b = a + SPAN_ROWS
            columns = [ids[docs[a:b]], hashes[docs[a:b]], begins[a:b] << HALF | ends[a:b]]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], [x.split()[0] for x in SPANS.split(", ")])

    return map_batches(segments.repartitionById(targets, F.col("target")), work, SPANS)


def squeezed(documents: DataFrame) -> DataFrame:
    """doc_id, the hash of the text and the text in compressed form, for an exchange of whole texts; a null text is empty."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        packer = zstandard.ZstdCompressor(level=3)
        for batch in pieces(batches, "text"):
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([packer.compress(t) for t in _bytes_of(batch, 2)], pa.binary())], ["doc_id", "text_hash", "packed"])

    rows = documents.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_hash"), "text")
    return map_batches(rows, work, "doc_id long, text_hash long, packed binary")


def spans_to_remove(documents: DataFrame, length: int, targets: int | None) -> DataFrame:
    """k1 and k2 (doc_id, null as LEAST, and hash of the text) with the `spans` of each document that loses bytes."""
    if length < PART:
        raise ValueError(f"length must be {PART} at least")
    hot, targets = hot_slots(documents, length, targets)
    found = repeated_spans(to_segments(documents, length, targets, hot), length, targets)
    return found.groupBy(F.col("doc_id").alias("k1"), F.col("text_hash").alias("k2")).agg(F.collect_list("span").alias("spans"))


def spans_of(column: pa.ListArray) -> Iterator[np.ndarray]:
    """The spans of each row; none where the row has no list."""
    import numpy as np

    # a filter for nulls is not needed: their lists are empty
    values, offsets = column.values.to_numpy(zero_copy_only=False), np.asarray(column.offsets)
    return (values[a:b] for a, b in zip(offsets[:-1], offsets[1:], strict=True))


def without(text: bytes, spans: np.ndarray) -> tuple[bytes, int, int]:
    """What is left of a text, the bytes removed and the spans they form."""
    import numpy as np

    if not len(spans):
        return text, 0, 0
    _, b, e = _merged(np.zeros(len(spans), np.int64), spans >> HALF, spans & ((1 << HALF) - 1))
    edges = [0, *np.stack([b, e], 1).ravel().tolist(), len(text)]
    return b"".join([text[x:y] for x, y in zip(edges[::2], edges[1::2], strict=True)]), int((e - b).sum()), len(b)


def strip_repeats(documents: DataFrame, length: int = 50, targets: int | None = None) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and kept (the bytes left) of each row of `documents` (doc_id, text).

    targets: tasks that segments are dealt to; more for larger tables, results don't depend on it. Repeated rows give
    a row each; other columns don't matter; an empty table gives an empty result.
    """
    spans = spans_to_remove(documents, length, targets)
    rows = squeezed(documents).withColumn("key", F.coalesce("doc_id", F.lit(LEAST)))
    joined = rows.join(spans, (F.col("key") == F.col("k1")) & (F.col("text_hash") == F.col("k2")), "left").select("doc_id", "packed", "spans")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        opener = zstandard.ZstdDecompressor()
        for batch in pieces(batches, "packed"):
            out = []
            for doc_id, text, spans in zip(batch.column(0).to_pylist(), _bytes_of(batch, 1), spans_of(batch.column(2)), strict=True):
                text = opener.decompress(text)
                kept, removed, count = without(text, spans)
                out.append((doc_id, len(text), removed, count, hashlib.sha256(kept).hexdigest(), kept))
            kinds = [pa.int64()] * 4 + [pa.string(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], RESULT)

    return map_batches(joined, work, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")


RESULT = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]


def strip_documents(documents: DataFrame, length: int = 50, targets: int | None = None) -> DataFrame:
    """`row` (all columns of `documents`, as a struct) and `text` without what strip_repeats() removes; null stays null.

    What is left of a character that a cut goes through becomes U+FFFD.
    """
    spans = spans_to_remove(documents.select("doc_id", "text"), length, targets)
    rows = documents.select(F.struct(*(documents[f"`{c}`"].alias(c) for c in documents.columns)).alias("row"))
    key = F.coalesce(F.col("row.doc_id").cast("long"), F.lit(LEAST))
    joined = rows.join(spans, (key == F.col("k1")) & (F.xxhash64("row.text") == F.col("k2")), "left").select("row", F.col("row.text").alias("text"), "spans")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            texts = [
                t if t is None or not len(s) else without(t.encode(), s)[0].decode(errors="replace")
                for t, s in zip(batch.column(1).to_pylist(), spans_of(batch.column(2)), strict=True)
            ]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["row", "text"])

    return joined.mapInArrow(work, joined.drop("spans").schema)
