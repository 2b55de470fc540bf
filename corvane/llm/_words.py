"""Word rules that several operators share, as byte translations."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from ._shared import string_buffers

#: Lower-case A-Z; every byte outside 0-9, A-Z, a-z and 0x80-0xFF becomes a space.
#: After it, ``bytes.split()`` yields the words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``.
ALNUM = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256)
)

#: Lower-case A-Z only; ``bytes.split()`` then yields the words ``[^\\x20\\x09-\\x0D]+``.
LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))


def words(text: bytes) -> list[bytes]:
    return text.translate(ALNUM).split()


def spaced_words(text: bytes) -> list[bytes]:
    return text.translate(LOWER).split()


def _table(keep_punctuation: bool) -> np.ndarray:
    table = np.frombuffer(LOWER if keep_punctuation else ALNUM, np.uint8).copy()
    table[list(b"\t\n\x0b\x0c\r")] = 0x20
    return table


_TABLES = {False: _table(False), True: _table(True)}


class WordColumn:
    """All words of a string column in a row: bytes, bounds, and how many each text has."""

    def __init__(self, column: pa.Array, keep_punctuation: bool = False):
        self.offsets, raw = string_buffers(column)
        low = _TABLES[keep_punctuation][raw]
        word = low != 0x20
        start = word.copy()
        start[1:] &= ~word[:-1]
        heads = self.offsets[:-1][self.offsets[:-1] < len(raw)]
        start[heads] |= word[heads]
        self.first = np.flatnonzero(start)
        self.bytes = low[word]
        bounds = np.empty(len(self.first) + 1, np.int32)
        bounds[:-1], bounds[-1] = np.cumsum(word)[self.first] - 1, len(self.bytes)
        self.bounds = bounds
        self.edges = np.searchsorted(self.first, self.offsets)
        self.counts = np.diff(self.edges)

    def array(self) -> pa.Array:
        return pa.Array.from_buffers(pa.binary(), len(self.first), [None, pa.py_buffer(self.bounds), pa.py_buffer(self.bytes)])

    def numbered(self) -> tuple[list[bytes], np.ndarray]:
        """(distinct words, number of each word)."""
        coded = self.array().dictionary_encode()
        return coded.dictionary.to_pylist(), coded.indices.to_numpy().astype(np.int64)
