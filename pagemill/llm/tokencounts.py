"""Exact token counts at every prefix, by dynamic programming over pieces.

With merges by rank, the tokens of a prefix end in exactly one piece t for which the tokens of the prefix before t end
in a piece s such that s + t, merged on their own, stay s, t. So a table over the positions of a text holds for each
prefix its last piece and its number of tokens, each from one earlier entry; the whole table costs one pass and
answers any question about truncation or budgets without encoding again.

The vocabulary is a sentencepiece BPE model with byte fallback. No piece has its blank mark behind another character
(this is checked), so tables of chunks that begin at a run of blanks simply add up, and recurring chunks are
remembered. What the library's own rules do before merging (blank mark in front, normalisation) is asked of the
library: texts that its normaliser would change are normalised by it first.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, pieces

MARK = "▁"
#: Chunks and pairs remembered by a Python worker before it starts anew: bounds memory, not results.
REMEMBERED = 400_000
_CHUNK = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+$")
_loaded: dict[str, "PrefixCounter"] = {}


class PrefixCounter:
    def __init__(self, path: str) -> None:
        from sentencepiece import SentencePieceProcessor

        library = SentencePieceProcessor(model_file=path)
        n = library.get_piece_size()
        plain = [i for i in range(n) if not (library.is_byte(i) or library.is_control(i) or library.is_unknown(i) or library.is_unused(i))]
        self.ranks = {library.id_to_piece(i): -library.get_score(i) for i in plain}
        if any(re.search(f"[^{MARK}]{MARK}", p) for p in self.ranks):
            raise ValueError("a piece holds a blank behind another character")
        self._begins = {p[:k]: False for p in self.ranks for k in range(1, len(p))} | dict.fromkeys(self.ranks, True)
        self._together = {p[k : k + 2] for p in self.ranks for k in range(len(p) - 1)}
        self._normalise = library.normalize
        self._single = {p for p in self.ranks if len(p) == 1}
        self._pairs: dict[tuple[str, str], bool] = {}
        self._proper: dict[str, bool] = {}
        self._chunks: dict[str, int] = {}
        self._parts: dict[str, int] = {}

    @classmethod
    def of(cls, path: str) -> "PrefixCounter":
        if path not in _loaded:
            _loaded[path] = cls(path)
        return _loaded[path]

    def merge(self, text: str) -> list[str]:
        """The pieces of a short text by repeated merging of the best pair, leftmost first; bytes count as one piece here."""
        parts = list(text)
        while len(parts) > 1:
            best = min(range(len(parts) - 1), key=lambda i: self.ranks.get(parts[i] + parts[i + 1], float("inf")))
            if parts[best] + parts[best + 1] not in self.ranks:
                break
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        return parts

    def _stays(self, s: str, t: str) -> bool:
        known = self._pairs.get((s, t))
        if known is None:
            if len(self._pairs) > REMEMBERED:
                self._pairs.clear()
            known = self._pairs[s, t] = self.merge(s + t) == [s, t]
        return known

    def table(self, chunk: str) -> list[int]:
        """Tokens of chunk[:i] at each i from 0 to its length. A character outside the vocabulary counts its UTF-8 bytes."""
        n, begins = len(chunk), self._begins
        last: list[str] = [""] * (n + 1)
        counts = [0] * (n + 1)
        for i in range(n):
            before = last[i]
            if chunk[i] not in self._single:
                last[i + 1], counts[i + 1] = chunk[i], counts[i] + len(chunk[i].encode())
                continue
            for k in range(i + 1, n + 1):
                t = chunk[i:k]
                whole = begins.get(t)
                if whole is None:
                    break
                if whole and self._is_piece(t) and (not before or self._stays(before, t)):
                    last[k], counts[k] = t, counts[i] + 1
        return counts

    def _is_piece(self, t: str) -> bool:
        """In the vocabulary, and what its own characters merge to."""
        if t not in self.ranks:
            return False
        known = self._proper.get(t)
        if known is None:
            known = self._proper[t] = self.merge(t) == [t]
        return known

    def chunks(self, text: str) -> list[str]:
        """The text as the library marks it, cut before each run of blanks."""
        return _CHUNK.findall(self._normalise(text)) if text else []

    def _count_new(self, chunk: str) -> int:
        """Tokens of a chunk, cut once more between characters that stand together in no piece."""
        together, known, total, begin = self._together, self._parts, 0, 0
        for i in range(1, len(chunk) + 1):
            if i == len(chunk) or chunk[i - 1 : i + 1] not in together:
                part, begin = chunk[begin:i], i
                n = known.get(part)
                if n is None:
                    if len(known) > REMEMBERED:
                        known.clear()
                    n = known[part] = self.table(part)[-1]
                total += n
        return total

    def count(self, text: str) -> int:
        known, total = self._chunks, 0
        for chunk in self.chunks(text):
            n = known.get(chunk)
            if n is None:
                if len(known) > REMEMBERED:
                    known.clear()
                n = known[chunk] = self._count_new(chunk)
            total += n
        return total

    def prefix_table(self, text: str) -> list[int]:
        """Tokens of each prefix of the marked text, from none to all of it."""
        out = [0]
        for chunk in self.chunks(text):
            base = out[-1]
            out.extend(base + n for n in self.table(chunk)[1:])
        return out

    def truncate(self, text: str, budget: int) -> str:
        """The longest prefix with at most `budget` tokens; the blank mark that the library puts in front is taken off."""
        marked, table = "".join(self.chunks(text)), self.prefix_table(text)
        keep = len(table) - 1
        while keep and table[keep] > budget:
            # counts can fall by one as a piece is completed, so look for the last prefix within the budget
            keep -= 1
        return marked[:keep].replace(MARK, " ")[1:]


def count_tokens(documents: DataFrame, model: str, limit: int = 4096) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (n_tokens > limit) of each row of `documents` (doc_id, text).

    A null or empty text has no tokens. Repeated rows and tied or null ids give a row each; other columns don't
    matter; an empty table gives an empty result. Every row is counted on its own, in place: nothing is shuffled.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = PrefixCounter.of(model)
        for batch in pieces(batches, "text"):
            texts = [t or "" for t in batch.column(1).to_pylist()]
            n = [counter.count(t) for t in texts]
            columns = [batch.column(0), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    rows = documents.select(F.col("doc_id").cast("long"), "text")
    return map_batches(rows, work, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
