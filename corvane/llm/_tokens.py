"""Whole-text encoding with the ``tokenizers`` library, at the speed of its distinct pieces.

Both public BPE vocabularies pre-tokenise text by a pattern whose matches never
cross certain boundaries.  A column is therefore cut at those boundaries (with
array operations on the UTF-8 bytes), each distinct piece is encoded by the
library once per worker, and the ids of a text are the ids of its pieces in
order.  Texts for which the cuts could matter (special-token marks, Unicode
white space) are encoded whole.
"""

from __future__ import annotations


import numpy as np
import pyarrow as pa

from ._shared import ranges, string_buffers

#: Byte classes: 0 ASCII letter or digit, 1 ASCII white space, 2 ASCII punctuation, 3 any other byte, 4 apostrophe.
_CLASS = np.full(256, 3, np.uint8)
for _b in range(0x21, 0x7F):
    _CLASS[_b] = 2
for _b in b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz":
    _CLASS[_b] = 0
for _b in b"\t\n\x0b\x0c\r ":
    _CLASS[_b] = 1
_CLASS[0x27] = 4
#: A piece starts between these classes: before white space, between a letter and punctuation, after punctuation but an apostrophe.
_CUT = np.zeros(64, bool)
for _p, _c in ((0, 1), (2, 1), (3, 1), (4, 1), (0, 2), (0, 4), (2, 0)):
    _CUT[_p * 8 + _c] = True

#: Words of one text that the library encodes in a row.
_ROW = 2_000
#: Pieces that a worker remembers; later ones are encoded anew in each batch that has them.
_MAX_PIECES = 600_000
_ENCODERS: dict[str, "PieceEncoder"] = {}


def encoder(path: str) -> "PieceEncoder":
    """One encoder per worker process and vocabulary file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = PieceEncoder(path)
    return _ENCODERS[path]


def _widths(tokenizer) -> np.ndarray | None:
    """Bytes that each id of a byte-level vocabulary stands for; None where the text is changed before or pieces are left out."""
    from tokenizers.pre_tokenizers import ByteLevel

    if tokenizer.normalizer is not None or not isinstance(tokenizer.pre_tokenizer, ByteLevel):
        return None
    vocabulary = tokenizer.get_vocab()
    out = np.zeros(max(vocabulary.values(), default=0) + 1, np.int64)
    for token, number in vocabulary.items():
        out[number] = len(token)  # a byte is a character
    return out


class PieceEncoder:
    def __init__(self, path: str):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.widths = _widths(self.tokenizer)
        self.known: dict[bytes, int] = {}
        self.starts, self.lengths, self.pool = np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(0, np.uint16 if self.tokenizer.get_vocab_size() <= 65_536 else np.uint32)

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)

    def _numbers(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Numbers of distinct pieces in the pool (starts, lengths, ids); new ones are encoded by the library."""
        known, starts, lengths, pool = self.known, self.starts, self.lengths, self.pool
        fresh = [p for p in pieces if p not in known]
        if not fresh:
            return np.fromiter(map(known.__getitem__, pieces), np.int64, len(pieces)), starts, lengths, pool
        ids, sizes = self._encode(fresh)
        numbers = dict(zip(fresh, range(len(starts), len(starts) + len(fresh))))
        starts = np.concatenate([starts, (len(pool) + np.cumsum(sizes) - sizes).astype(np.int32)])
        lengths, pool = np.concatenate([lengths, sizes]), np.concatenate([pool, ids])
        if len(known) < _MAX_PIECES:
            known.update(numbers)
            self.starts, self.lengths, self.pool = starts, lengths, pool
            return np.fromiter(map(known.__getitem__, pieces), np.int64, len(pieces)), starts, lengths, pool
        return np.fromiter((numbers[p] if p in numbers else known[p] for p in pieces), np.int64, len(pieces)), starts, lengths, pool

    def _encode(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces in a row, and how many each has.

        A word behind white space never shares an id with what stands before it.  Such words are
        encoded as one text, and the bytes that each id stands for tell which are whose.
        """
        texts = [p.decode() for p in pieces]
        if self.widths is None:
            return self._singly(texts)
        word = np.fromiter((t[0] in " \t\n\r" and t[1:].isalnum() for t in texts), bool, len(texts))
        words, others = np.flatnonzero(word), np.flatnonzero(~word)
        ids, sizes = self._in_rows([texts[k] for k in words.tolist()], np.fromiter(map(len, pieces), np.int64, len(pieces))[words])
        if not len(others):
            return ids, sizes
        more, counts = self._singly([texts[k] for k in others.tolist()])
        order = np.argsort(np.concatenate([words, others]), kind="stable")
        both, lengths = np.concatenate([ids, more]), np.concatenate([sizes, counts])
        starts = (np.cumsum(lengths) - lengths)[order]
        return both[ranges(starts, lengths[order])], lengths[order]

    def _in_rows(self, words: list[str], sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``_singly`` of words behind white space, of ``sizes`` bytes each, many to a text."""
        if not words:
            return self._singly(words)
        rows = ["".join(words[k : k + _ROW]) for k in range(0, len(words), _ROW)]
        ids = np.concatenate([np.array(e.ids, self.pool.dtype) for e in self.tokenizer.encode_batch_fast(rows, add_special_tokens=False)])
        ends, wanted = np.cumsum(self.widths[ids]), np.cumsum(sizes)
        last = np.searchsorted(ends, wanted)
        if not len(ids) or ends[-1] != wanted[-1] or (ends[last] != wanted).any():
            return self._singly(words)
        return ids, np.diff(last, prepend=-1).astype(np.int32)

    def _singly(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids: list[np.ndarray] = [np.zeros(0, self.pool.dtype)]
        for low in range(0, len(texts), 20_000):
            got = self.tokenizer.encode_batch_fast(texts[low : low + 20_000], add_special_tokens=False)
            ids += [np.array(e.ids, self.pool.dtype) for e in got]
        return np.concatenate(ids), np.fromiter(map(len, ids[1:]), np.int32, len(ids) - 1)

    def encode_column(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row, number of ids of each text); a null is an empty text."""
        offsets, raw = string_buffers(column)
        n = len(offsets) - 1
        if not len(raw):
            return np.zeros(0, np.uint32), np.zeros(n, np.int64)
        kind = _CLASS[raw]
        cut = np.empty(len(raw), bool)
        np.take(_CUT, kind[:-1] * np.uint8(8) + kind[1:], out=cut[1:])
        cut[offsets[:-1][offsets[:-1] < len(raw)]] = True
        first = np.flatnonzero(cut)
        bounds = np.empty(len(first) + 1, np.int32)
        bounds[:-1], bounds[-1] = first, len(raw)
        pieces = pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(raw))])
        coded = pieces.dictionary_encode()
        numbers, starts, sizes, pool = self._numbers(coded.dictionary.to_pylist())
        numbers = numbers[coded.indices.to_numpy()]
        lengths = sizes[numbers].astype(np.int64)
        flat = pool[ranges(starts[numbers], lengths)].astype(np.uint32)
        edges = np.concatenate([[0], np.cumsum(lengths)])[np.searchsorted(first, offsets)]
        counts = np.diff(edges)
        odd = self._odd(column, raw)
        if len(odd):
            parts, last = [], 0
            values = column.take(pa.array(odd)).to_pylist()
            for k, text in zip(odd, values):
                ids = self.whole(text)
                parts += [flat[last : edges[k]], ids]
                last, counts[k] = edges[k + 1], len(ids)
            flat = np.concatenate([*parts, flat[last:]])
        return flat, counts

    def _odd(self, column: pa.Array, raw: np.ndarray) -> list[int]:
        """Texts to encode whole."""
        import pyarrow.compute as pc

        if not ((raw == 0x7C).any() or (raw >= 0xC2).any() or ((raw >= 0x1C) & (raw <= 0x1F)).any()):
            return []
        hit = pc.match_substring_regex(column, "<\\||[\\x1c-\\x1f\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]")
        return np.flatnonzero(np.asarray(pc.fill_null(hit, False))).tolist()


def file_of(name: str, path: str | None = None) -> str:
    """A public vocabulary's file: ``path`` if given, else by name."""
    if path:
        return path
    import public_tokenizers

    return public_tokenizers.path(name)
