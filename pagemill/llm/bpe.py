"""Byte-level BPE as a transducer over bytes, and a streaming decoder.

Encoding. With merges by rank, the tokens of any prefix end in exactly one token t, such that the token before it and
t, merged on their own, stay two tokens. Reading left to right, every place where a token that is still being read may
have begun is therefore kept with the tokens before it. That set is a state; tokens that all places agree on are final
and are emitted. A place dies once no token of the vocabulary begins with the bytes since, so a token is emitted after
a lookahead of less than the longest token. States and their transitions are made when first needed and then looked
up: the machine is the lazily determinised transducer of the merges.

Decoding. Tokens may end inside a character. A machine over bytes with one state for each way a UTF-8 sequence may go
on passes on whole characters as they are completed; what can't become a character is replaced by U+FFFD.
"""

from __future__ import annotations

import base64
import gc
import hashlib
from collections.abc import Iterable, Iterator
from typing import TYPE_CHECKING

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, pieces
from .vocab import ChunkEncoder

if TYPE_CHECKING:
    import numpy as np

#: States, pairs and pieces remembered by a Python worker before it starts anew: bounds memory, not results.
STATES, PAIRS, PIECES = 200_000, 400_000, 800_000
_loaded: dict[tuple[str, str], "Codec"] = {}

#: Where a token that is still being read may have begun: the node of the tree that its bytes lead to, the rank of the token
#: before it (-1: none), and a bit for each place up to there, counted from the last that all agree on, where a token ends.
Place = tuple[int, int, int]
#: The token before the last place that all agree on (-1: none) and the bytes since, which tell states apart; the places.
State = tuple[int, bytes, tuple[Place, ...]]


class MergeTransducer:
    """Tokens of byte strings. `ranks`: the rank of each token; every single byte must be one."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        self._made_of: dict[bytes, list[bytes]] = {}
        #: The tokens as a tree: the node that a node << 8 | byte leads to. Of each node, the token that merging can give
        #: at all and that ends there, as its rank or -1, and whether longer tokens begin so.
        self._tree: dict[int, int] = {}
        self._token_at, self._goes_on = [-1], [bool(ranks)]
        self._of_rank = {i: t for t, i in ranks.items()}
        for token, rank in ranks.items():
            node = 0
            for byte in token:
                self._goes_on[node] = True
                if (k := node << 8 | byte) not in self._tree:
                    self._tree[k] = len(self._token_at)
                    self._token_at.append(-1)
                    self._goes_on.append(False)
                node = self._tree[k]
            if self.merge(token) == [token]:
                self._token_at[node] = rank
        #: Whether two tokens stay, by rank << 32 | rank.
        self._pairs: dict[int, bool] = {}
        self._forget()

    def _forget(self) -> None:
        self._ids: dict[tuple[int, bytes], int] = {}
        self._states: list[State] = []
        #: What a state << 8 | byte leads to: the next state and the tokens that are emitted.
        self._steps: dict[int, tuple[int, tuple[bytes, ...]]] = {}
        self._start = self._state((-1, b"", ((0, -1, 1),)))

    def _state(self, state: State) -> int:
        key = state[:2]
        k = self._ids.get(key)
        if k is None:
            k = self._ids[key] = len(self._states)
            self._states.append(state)
        return k

    def merge(self, data: bytes, down_to: int = 1) -> list[bytes]:
        """The tokens of a few bytes, by repeatedly merging the pair of lowest rank, leftmost first."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > down_to:
            best = min(range(len(parts) - 1), key=lambda i: self.ranks.get(parts[i] + parts[i + 1], 1 << 60))
            if parts[best] + parts[best + 1] not in self.ranks:
                break
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        return parts

    def _stays(self, s: int, t: int) -> bool:
        """Whether two tokens, given by rank, stay when merged as one string. Their merges are undone, the latest first;
        the two stay if no merge across the border comes before the one undone last."""
        known = self._pairs.get(s << 32 | t)
        if known is None:
            if len(self._pairs) > PAIRS:
                self._pairs.clear()
            known, limit, ranks, a, b = True, 1 << 60, self.ranks, self._of_rank[s], self._of_rank[t]
            while True:
                across = ranks.get(a + b)
                if across is not None and across < limit:
                    known = False
                    break
                made_a, made_b = ranks[a] if len(a) > 1 else -1, ranks[b] if len(b) > 1 else -1
                if made_a == made_b == -1:
                    break
                if made_a > made_b:
                    limit, a = made_a, self._halves(a)[1]
                else:  # what stands further left is merged first among equals
                    limit, b = made_b + 1, self._halves(b)[0]
            self._pairs[s << 32 | t] = known
        return known

    def _halves(self, token: bytes) -> list[bytes]:
        """The two tokens whose merge makes this one."""
        known = self._made_of.get(token)
        if known is None:
            known = self._made_of[token] = self.merge(token, 2)
        return known

    def _make(self, k: int, byte: int) -> tuple[int, tuple[bytes, ...]]:
        """The transition of state k on a byte: each place reads it, one of them ends a token there."""
        before, rest, places = self._states[k]
        tree, token_at, goes_on, pairs = self._tree, self._token_at, self._goes_on, self._pairs
        rest += bytes((byte,))
        now: list[Place] = []
        ended, agreed = -1, -1
        for node, last, cuts in places:
            node = tree.get(node << 8 | byte)
            if node is None:
                continue
            if ended < 0 and (token := token_at[node]) >= 0:
                stays = last < 0 or pairs.get(last << 32 | token)
                if stays or stays is None and self._stays(last, token):
                    ended, ended_cuts = token, cuts | 1 << len(rest)
            if goes_on[node]:
                now.append((node, last, cuts))
                agreed &= cuts
        agreed &= ended_cuts
        now.append((0, ended, ended_cuts))
        if agreed == 1:
            return self._state((before, rest, tuple(now))), ()
        base = agreed.bit_length() - 1
        emitted = _between(rest, agreed)
        state = (self.ranks[emitted[-1]], rest[base:], tuple([(node, last, cuts >> base) for node, last, cuts in now]))
        return self._state(state), tuple(emitted)

    def encode(self, data: bytes) -> list[bytes]:
        if len(self._states) > STATES:
            self._forget()
        out: list[bytes] = []
        k, steps = self._start, self._steps
        for byte in data:
            step = steps.get(k << 8 | byte)
            if step is None:
                if len(self._states) > 2 * STATES:  # one very long piece
                    state = self._states[k]
                    self._forget()
                    k, steps = self._state(state), self._steps
                step = steps[k << 8 | byte] = self._make(k, byte)
            k, emitted = step
            if emitted:
                out += emitted
        _, rest, places = self._states[k]
        out += _between(rest, places[-1][2])
        return out


def _between(data: bytes, cuts: int) -> list[bytes]:
    """The parts of data between the places whose bits are set in `cuts`, 0 among them, up to the last of them."""
    at = [i for i in range(cuts.bit_length()) if cuts >> i & 1]
    return [data[a:b] for a, b in zip(at, at[1:])]  # noqa: B905 (of different length)


def _ranges() -> dict[int, tuple[int, list[tuple[int, int]]]]:
    """First byte of a sequence: the ranges of the bytes that must follow."""
    tail, out = (0x80, 0xBF), {}
    for b in range(0xC2, 0xF5):
        n = 1 if b < 0xE0 else 2 if b < 0xF0 else 3
        first = {0xE0: (0xA0, 0xBF), 0xED: (0x80, 0x9F), 0xF0: (0x90, 0xBF), 0xF4: (0x80, 0x8F)}.get(b, tail)
        out[b] = (n, [first] + [tail] * (n - 1))
    return out


FOLLOW = _ranges()
REPLACEMENT = b"\xef\xbf\xbd"


def feed(pending: bytes, data: bytes) -> tuple[bytes, bytes]:
    """(whole characters as bytes, what is still pending) after `data`. pending: a begun, well-formed sequence."""
    out = bytearray()
    for b in data:
        if pending:
            low, high = FOLLOW[pending[0]][1][len(pending) - 1]
            if low <= b <= high:
                pending += bytes((b,))
                if len(pending) > FOLLOW[pending[0]][0]:
                    out += pending
                    pending = b""
                continue
            out += REPLACEMENT
            pending = b""
        if b < 0x80:
            out.append(b)
        elif b in FOLLOW:
            pending = bytes((b,))
        else:
            out += REPLACEMENT
    return bytes(out), pending


class StreamDecoder:
    """Bytes of whole characters from token ids, as they come. What a token does in a state is remembered."""

    def __init__(self, tokens: list[bytes]) -> None:
        import numpy as np

        self.tokens = tokens
        self._steps: dict[tuple[bytes, int], tuple[bytes, bytes]] = {}
        self._closed = np.array([feed(b"", t) == (t, b"") for t in tokens])

    def stream(self, ids: Iterable[int], pending: bytes = b"") -> Iterator[bytes]:
        steps = self._steps
        for i in ids:
            step = steps.get((pending, i))
            if step is None:
                if len(steps) > PAIRS:
                    steps.clear()
                step = steps[pending, i] = feed(pending, self.tokens[i])
            out, pending = step
            if out:
                yield out
        if pending:
            yield REPLACEMENT

    def decode(self, ids: bytes) -> bytes:
        """All of it; ids are little-endian unsigned 32-bit. Runs of tokens that are whole characters need no state."""
        import numpy as np

        numbers = np.frombuffer(ids, "<u4")
        if self._closed[numbers].all():
            return b"".join(map(self.tokens.__getitem__, numbers.tolist()))
        return b"".join(self.stream(numbers.tolist()))


class Codec:
    """A rank file and the pattern that splits texts before merging. Every match of the pattern is encoded on its own;
    the pattern must be of the byte-level kind that vocab.py describes."""

    def __init__(self, path: str, pattern: str) -> None:
        import regex

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        tokens = [b""] * (max(ranks.values()) + 1)
        for t, i in ranks.items():
            tokens[i] = t
        self.transducer, self.decoder = MergeTransducer(ranks), StreamDecoder(tokens)
        # the pattern's \s is the Unicode property, as in the tokenizer libraries
        self._find = regex.compile(pattern.replace(r"[^\s", r"[^\p{White_Space}").replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}")).findall
        self._known: dict[str, list[int]] = {}
        self._numbers = ranks
        self._chunks = ChunkEncoder(self._encode_chunks)

    @classmethod
    def of(cls, path: str, pattern: str) -> "Codec":
        if (path, pattern) not in _loaded:
            _loaded[path, pattern] = cls(path, pattern)
        return _loaded[path, pattern]

    def _encode_chunks(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        import numpy as np

        known, numbers, encode = self._known, self._numbers, self.transducer.encode
        ids: list[int] = []
        ends: list[int] = []
        for chunk in chunks:
            found = self._find(chunk)
            for piece in found:
                got = known.get(piece)
                if got is None:
                    got = [numbers[t] for t in encode(piece.encode())]
                    if len(found) > 1:  # chunks of one piece are remembered as such
                        if len(known) > PIECES:
                            known.clear()
                        known[piece] = got
                ids += got
            ends.append(len(ids))
        lengths = np.diff(np.array(ends), prepend=0)
        return np.array(ids, np.int64), np.array(ends) - lengths, lengths

    def encode(self, texts: list[str | None] | pa.Array) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers; a null text counts as empty."""
        collects = gc.isenabled()
        gc.disable()  # states hold no cycles, and looking for some goes through all of them again and again
        try:
            return self._chunks.encode(texts)
        finally:
            if collects:
                gc.enable()

    def decode(self, ids: bytes) -> bytes:
        return self.decoder.decode(ids)


def encode(documents: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id and `ids` (little-endian unsigned 32-bit integers) of each row; a null text is empty, a null doc_id stays."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec.of(path, pattern)
        for batch in pieces(batches, "text"):
            ids = codec.encode(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary())], ["doc_id", "ids"])

    return map_batches(documents.select(F.col("doc_id").cast("long"), "text"), work, "doc_id long, ids binary")


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id and `text` of each row of encode()."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec.of(path, pattern)
        for batch in pieces(batches, "ids"):
            texts = [codec.decode(x or b"").decode() for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return map_batches(encoded.select("doc_id", "ids"), work, "doc_id long, text string")


def round_trip(documents: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of each row of `documents` (doc_id, text).

    Null and empty texts have no tokens; repeated rows and tied ids give a row each; other columns don't matter; an
    empty table gives an empty result.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec.of(path, pattern)
        for batch in pieces(batches, "text"):
            ids = codec.encode(batch.column(1))
            columns = [
                batch.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()),
                pa.array([hashlib.sha256(x).hexdigest() for x in ids], pa.string()),
                pa.array([hashlib.sha256(codec.decode(x)).hexdigest() for x in ids], pa.string()),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = documents.select(F.col("doc_id").cast("long"), "text")
    return map_batches(rows, work, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
