"""Token ids of whole texts from the tokenizers library, with the ids of recurring chunks remembered.

The byte-level pattern always begins a new piece at a white-space character that follows a character other than
white space. Where a single blank or line feed stands between two such characters, the text may therefore be cut
before it, and the chunks encoded one by one give the ids of the whole. Added tokens of the vocabulary must hold no
white space, which is checked, so a cut is never inside one. Nor does the pattern ever leave a stop, comma or the like
in one piece with a letter or digit before it.

A batch of texts is cut at once, as one column of bytes: its chunks are told apart by Arrow, each different one is looked
up or encoded once, and the ids of all are gathered. Not to cut is always right, so what may be a white-space character
of several bytes beside a blank prevents a cut there.
"""

from __future__ import annotations

import ctypes
import gc
import os
import re
from collections.abc import Callable, Iterable
from typing import TYPE_CHECKING

import pyarrow as pa

if TYPE_CHECKING:
    import numpy as np
    from tokenizers import Tokenizer

#: Chunks, and bytes of them and their ids, remembered by a Python worker before it starts anew: bounds memory, not results.
REMEMBERED, REMEMBERED_BYTES = 800_000, 64 << 20
#: New chunks that the library is given as one text: each text has a cost of its own.
TOGETHER = 50

# Signs that never stand in one piece with a letter or digit before them.
SIGNS = (",", ".", ";", ":", "!", "?")

_CUT = re.compile(r"(?<=\S)(?=[ \n]\S)")
_PLAIN = re.compile(r"[ \n]\S+").fullmatch
#: ASCII white space, as Python or a tokenizer library sees it; how wider white space begins (U+0085, U+00A0, U+1680,
#: U+2000 to U+205F, U+3000); what it ends with.
WHITE = (*range(9, 14), *range(28, 33))
WIDE = ((0xC2, 0x85), (0xC2, 0xA0), (0xE1, 0x9A), (0xE2, 0x80), (0xE2, 0x81), (0xE3, 0x80))
WIDE_LAST = (*range(0x80, 0x8B), 0x9F, 0xA0, 0xA8, 0xA9, 0xAF)
ALNUM = (*range(48, 58), *range(65, 91), *range(97, 123))
_loaded: dict[tuple[str, int], "ChunkEncoder"] = {}

EncodeMany = Callable[[list[str]], "tuple[np.ndarray, np.ndarray, np.ndarray]"]


def chunks_of(text: str) -> list[str]:
    """text, cut before each single blank or line feed that stands between characters other than white space."""
    return _CUT.split(text)


class ChunkEncoder:
    """Ids of texts as little-endian unsigned integers of `width` bytes; `encode_many` gives those of chunks in a row,
    where those of each chunk begin there, and how many they are."""

    def __init__(self, encode_many: EncodeMany, width: int = 4) -> None:
        self._encode_many, self.kind = encode_many, f"<u{width}"
        self.forget()

    @classmethod
    def of(cls, path: str, width: int = 4) -> "ChunkEncoder":
        """The encoder of a tokenizers file, ids of `width` bytes; a Python worker loads each file once."""
        if (path, width) not in _loaded:
            # a task has one core: the library's threads would take those of other tasks, and wait for each other
            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            from tokenizers import Tokenizer

            library = Tokenizer.from_file(path)
            if any(re.search(r"\s", token.content) for token in library.get_added_tokens_decoder().values()):
                raise ValueError("an added token holds white space")
            if library.get_vocab_size() > 1 << (8 * width):
                raise ValueError(f"ids do not fit {width} bytes")
            _loaded[path, width] = cls(_library_ids(library), width)
        return _loaded[path, width]

    @staticmethod
    def symbols(path: str) -> int:
        """One more than the largest id of a tokenizers file."""
        from tokenizers import Tokenizer

        return max(Tokenizer.from_file(path).get_vocab().values()) + 1

    def forget(self) -> None:
        """Drops what is remembered; results don't depend on it."""
        import numpy as np

        self._known: dict[bytes, int] = {}
        self._bytes = 0
        # the ids of all known chunks, and where those of each begin and how many they are
        self._ids, self._used = np.zeros(0, self.kind), 0
        self._begins, self._lengths = np.zeros(0, np.int32), np.zeros(0, np.int32)

    def encode(self, texts: list[str | None] | pa.Array) -> list[bytes]:
        """The ids of each text; a null text counts as empty."""
        ids, ends = self.encode_column(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string()))
        packed, ends = ids.tobytes(), (ends * ids.itemsize).tolist()
        return [packed[a:b] for a, b in zip([0, *ends], ends, strict=False)]

    def encode_column(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts of a column, one text after another, and where those of each end."""
        import numpy as np

        data, bounds = _bytes_of(texts)
        begins = _chunk_begins(data, bounds)
        words = pa.Array.from_buffers(
            pa.binary(), len(begins), [None, pa.py_buffer(np.append(begins, len(data)).astype(np.int32)), pa.py_buffer(data)]
        ).dictionary_encode()
        _, bounds_of, distinct = words.dictionary.buffers()
        raw, at = distinct.to_pybytes() if distinct else b"", np.frombuffer(bounds_of, np.int32)[: len(words.dictionary) + 1].tolist()
        slots = self._slots([raw[a:b] for a, b in zip(at, at[1:], strict=False)])[words.indices.to_numpy()]
        lengths = self._lengths[slots]
        ends = np.cumsum(lengths, dtype=np.int64)
        # a chunk's ids stand together: the place of each is that of the first and how far on it is
        shift = (self._begins[slots] - ends + lengths).astype(np.int32)
        places = np.arange(ends[-1] if len(ends) else 0, dtype=np.int32)
        places += np.repeat(shift, lengths)
        return self._ids[places], np.append(0, ends)[np.searchsorted(begins, bounds[1:])]

    def _slots(self, chunks: list[bytes]) -> np.ndarray:
        """The numbers under which the chunks, all different, are remembered."""
        import numpy as np

        if len(self._known) > REMEMBERED or self._bytes > REMEMBERED_BYTES:
            self.forget()
        known = self._known
        slots = np.fromiter([known.get(x, -1) for x in chunks], np.int64, len(chunks))
        if len(missing := np.flatnonzero(slots < 0)):
            new = [chunks[k] for k in missing.tolist()]
            ids, begins, lengths = self._encode_many([x.decode() for x in new])
            first, used = len(known), self._used
            slots[missing] = np.arange(first, first + len(new))
            known.update(zip(new, range(first, first + len(new)), strict=True))
            self._ids = _put(self._ids, used, ids)
            self._begins = _put(self._begins, first, used + begins)
            self._lengths = _put(self._lengths, first, lengths)
            self._used += len(ids)
            self._bytes += sum(map(len, new)) + len(ids) * self._ids.itemsize
        return slots


def _put(kept: np.ndarray, at: int, new: np.ndarray) -> np.ndarray:
    """kept with `new` from place `at` on, in an array twice as long where there is no room."""
    import numpy as np

    if at + len(new) > len(kept):
        kept, old = np.zeros(2 * (at + len(new)), kept.dtype), kept[:at]
        kept[:at] = old
    kept[at : at + len(new)] = new
    return kept


def _library_ids(library: Tokenizer) -> EncodeMany:
    """Ids of chunks. Chunks of one blank or line feed and no other white space are given to the library one behind
    another, as they might stand in a text; an id whose bytes begin with the blank or line feed begins a chunk."""
    import numpy as np

    vocabulary = library.get_vocab()
    leads = np.zeros(max(vocabulary.values()) + 1, bool)
    leads[[i for token, i in vocabulary.items() if token[:1] in ("Ġ", "Ċ")]] = True

    def ids_of(texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.int64) for e in library.encode_batch_fast(texts, add_special_tokens=False)]

    def encode_many(chunks: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        plain = [k for k, x in enumerate(chunks) if _PLAIN(x)]
        alone = sorted(set(range(len(chunks))).difference(plain))
        groups = [plain[k : k + TOGETHER] for k in range(0, len(plain), TOGETHER)]
        order: list[int] = []
        rows, lengths = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for group, ids in zip(groups, ids_of(["".join([chunks[k] for k in g]) for g in groups]), strict=True):
            begins = np.flatnonzero(leads[ids])
            if len(begins) == len(group) and begins[0] == 0:
                order += group
                rows.append(ids)
                lengths.append(np.diff(begins, append=len(ids)))
            else:  # an added token took a blank, say
                alone += group
        each = ids_of([chunks[k] for k in alone])
        ends = np.cumsum(np.concatenate([*lengths, [len(x) for x in each]]).astype(np.int64))
        begin, n = np.zeros(len(chunks), np.int64), np.zeros(len(chunks), np.int64)
        begin[order + alone], n[order + alone] = np.append(0, ends[:-1]), np.diff(ends, prepend=0)
        return np.concatenate([*rows, *each]), begin, n

    return encode_many


def _bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts of a column and their bounds; a null text counts as empty."""
    import numpy as np

    texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = texts.fill_null("")
    _, offsets, data = texts.buffers()
    bounds = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    return np.frombuffer(data or b"", np.uint8)[bounds[0] : bounds[-1]], bounds - bounds[0]


def _table(values: Iterable[int]) -> np.ndarray:
    import numpy as np

    out = np.zeros(256, bool)
    out[list(values)] = True
    return out


def _chunk_begins(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Where chunks begin: at each text, before a single blank or line feed between other characters, and before a sign
    that ends such a chunk behind a letter or digit. With bytes that may be a longer white-space character, there is no cut."""
    import numpy as np

    size = len(data)
    begins, edge = np.zeros(size + 1, bool), np.zeros(size + 2, bool)
    edge[bounds] = True
    data = np.append(data, np.zeros(2, np.uint8))
    at = np.flatnonzero(_table(b" \n")[data[:size]])
    before, after = data[at - 1], data[at + 1]
    whole = ~(_table(WHITE)[before] | _table(WHITE)[after] | edge[at + 1])
    # white space of two or three bytes ends with one of the first, begins with one of the second
    unsure = np.flatnonzero(whole & (_table(WIDE_LAST)[before] | _table(x[0] for x in WIDE)[after]))
    place = at[unsure]
    for x, y in WIDE:
        behind = (data[place + 1] == x) & (data[place + 2] == y)
        if x == 0xC2:
            behind |= (data[place - 2] == x) & (data[place - 1] == y)
        else:
            behind |= (data[place - 3] == x) & (data[place - 2] == y)
        whole[unsure[behind]] = False
    begins[at[whole]] = True
    begins[bounds] = True
    # a sign ends a chunk, and before it stands an ASCII or Latin-1 letter or digit of the same chunk
    ends = np.flatnonzero(begins)[1:]
    sign = ends[_table("".join(SIGNS).encode())[data[ends - 1]]] - 1
    sign = sign[~begins[sign]]
    last, lead = data[sign - 1], data[sign - 2]
    latin = (lead == 0xC3) & (last >= 0x80) & (last != 0x97) & (last != 0xB7)
    begins[sign[_table(ALNUM)[last] | latin]] = True
    begins[size] = False
    return np.flatnonzero(begins)


def forget_all() -> None:
    """Drops all encoders of this Python worker, which may have served another operator before, and gives their memory back."""
    if _loaded:
        _loaded.clear()
        gc.collect()
        if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
            libc.malloc_trim(0)
