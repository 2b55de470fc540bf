"""Token counts of a unigram tokenizer, without making the tokens.

An Aho-Corasick automaton enumerates every vocabulary piece that ends at each
character; dynamic programming carries the best score and the number of pieces
of that best path.  Ties follow the tokenizer's rule: matches are tried by start
position and a later one replaces an earlier one only if its score is greater.
A character that no piece covers costs the lowest piece score less 10; with byte
fallback it counts one piece per UTF-8 byte, else a run of such characters is one.

The pieces are those of a public piece file, read once per worker.  That file is of a
BPE model and has merge ranks where a unigram model has log probabilities, so a piece's
probability is taken from its rank by Zipf's law: it is proportional to 1 / rank.
The counts are those of this unigram model (as the ``tokenizers`` library's Unigram
gives them), not of the file's own BPE merges.  Control, unknown and byte pieces are
no text: ``<s>`` or ``<0x41>`` written in a text is counted by its characters.

Text is prepared as the tokenizer does: spaces become the mark U+2581 and one mark is
prepended.  No piece has a mark behind another character, so a text is solved in
words that start where a mark follows a non-mark (a run of marks stays whole), and
each distinct short word is solved once per worker.  A word needs memory for its text
and for as many positions as the longest piece has characters.

Null texts are empty and count 0; repeated rows are counted each.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ._shared import slices, string_buffers
from ._tokens import file_of

VOCABULARY = "piece_bpe_32k.model"
MARK = "▁"
#: Words that a worker remembers, of at most so many bytes; others are solved anew in each batch that has them.
_MOST_WORDS, _LONGEST_WORD = 400_000, 100
_COUNTERS: dict[str, "Counter"] = {}


def vocabulary(path: str) -> list[tuple[str, float]]:
    """(piece, log probability) of the text pieces, in id order, which is that of their ranks, from a sentencepiece model file."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [sp.id_to_piece(k) for k in range(sp.get_piece_size()) if not (sp.is_control(k) or sp.is_unknown(k) or sp.is_byte(k) or sp.is_unused(k))]
    scores = -np.log(np.arange(1, len(pieces) + 1))
    return list(zip(pieces, (scores - np.log(np.exp(scores).sum())).tolist()))


class Counter:
    def __init__(self, pieces: list[tuple[str, float]], byte_fallback: bool = True):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for piece, score in pieces:
            if piece:
                if MARK in piece.lstrip(MARK):
                    raise ValueError(f"the piece {piece!r} has a mark inside")
                self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.longest = max(len(p) for p, _ in pieces)
        self.unknown = min(s for _, s in pieces) - 10.0
        self.singles = {p for p, _ in pieces if len(p) == 1}
        self.byte_fallback = byte_fallback
        self.known: dict[bytes, tuple[int, float]] = {}

    def word(self, text: str) -> tuple[int, float]:
        """(pieces, score) of the best path over one word."""
        ring = self.longest + 1
        best, count, run = [0.0] * ring, [0] * ring, [False] * ring
        matches = iter(self.automaton.iter(text))
        end, piece = next(matches, (-1, None))
        for last, character in enumerate(text):
            here = []
            while end == last:
                here.append(piece)
                end, piece = next(matches, (-1, None))
            if character not in self.singles:
                here.append((1, None))
            top, pieces, was_run = None, 0, False
            # Longest first: the tokenizer meets the matches by start position.
            for size, score in sorted(here, key=lambda m: -m[0]):
                at = (last + 1 - size) % ring
                total = best[at] + (self.unknown if score is None else score)
                if top is None or total > top:
                    top, was_run = total, score is None
                    pieces = count[at] + (1 if score is not None else len(character.encode()) if self.byte_fallback else not run[at])
            at = (last + 1) % ring
            best[at], count[at], run[at] = top, int(pieces), was_run
        at = len(text) % ring
        return count[at], best[at]

    def column(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(pieces, score) of each text."""
        offsets, raw = string_buffers(texts)
        n = len(offsets) - 1
        if not len(raw):
            return np.zeros(n, np.int64), np.zeros(n)
        # A word starts at a space, or at a mark that the text itself holds, behind anything else.
        mark = raw == 0x20
        own = np.flatnonzero((raw[:-2] == 0xE2) & (raw[1:-1] == 0x96) & (raw[2:] == 0x81)) if len(raw) > 2 else np.zeros(0, int)
        mark[own] = True
        behind = np.zeros(len(raw), bool)  # is the character before a mark
        behind[1:] = raw[:-1] == 0x20
        behind[own[own + 3 < len(raw)] + 3] = True
        heads = offsets[:-1][np.diff(offsets) > 0]
        head = np.zeros(len(raw), bool)
        head[heads] = True
        first = np.flatnonzero((mark & ~behind) | head)
        bounds = np.append(first, len(raw)).astype(np.int32)
        pieces = pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(raw))]).dictionary_encode()
        words = pieces.dictionary.to_pylist()
        found = [self._solved(w) for w in words]
        numbers = pieces.indices.to_numpy()
        counts = np.array([c for c, _ in found], np.int64)[numbers]
        totals = np.array([s for _, s in found])[numbers]
        # A text that does not start with a mark gets one.
        lead = np.flatnonzero(head[first] & ~mark[first])
        for k in lead.tolist():
            counts[k], totals[k] = self._solved(b" " + words[numbers[k]])
        at = np.searchsorted(first, offsets)
        sums, score = np.concatenate([[0], np.cumsum(counts)]), np.concatenate([[0.0], np.cumsum(totals)])
        return sums[at[1:]] - sums[at[:-1]], score[at[1:]] - score[at[:-1]]

    def _solved(self, word: bytes) -> tuple[int, float]:
        got = self.known.get(word)
        if got is None:
            got = self.word(word.decode().replace(" ", MARK))
            if len(word) <= _LONGEST_WORD and len(self.known) < _MOST_WORDS:
                self.known[word] = got
        return got


def counter(path: str) -> Counter:
    if path not in _COUNTERS:
        _COUNTERS[path] = Counter(vocabulary(path))
    return _COUNTERS[path]


_SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("path_score", pa.float64())])


def _count(path: str):
    def run(batches):
        tool = counter(path)
        for batch in slices(batches, 1):
            if batch.num_rows:
                n, score = tool.column(batch.column(1))
                yield pa.record_batch([batch.column(0), pa.array(n), pa.array(score)], schema=_SCHEMA)

    return run


def count(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Per document: doc_id, n_tokens and the score of the best path."""
    return docs.select("doc_id", "text").mapInArrow(_count(file_of(VOCABULARY, path)), "doc_id long, n_tokens long, path_score double")
