"""Benchmark decontamination with an FM-index per training shard.

Each task cuts the documents it scans into shards of at most ``SHARD_WORDS`` words and
builds, per shard, a word-level FM-index: suffix order by prefix doubling, the
Burrows-Wheeler transform in a wavelet matrix, and suffix positions sampled at
every ``SAMPLE``-th text position.  All benchmark windows are searched backwards
together through wavelet ranks; occurrences are located by walking to the nearest
sample, and the hit word spans of a document are merged.  A text longer than a shard
is cut into parts that overlap by a window less one word, so a shard's size, and the
memory of its index, has a bound whatever the texts are.  No document leaves its
task, so the operator needs no shuffle of documents.

The windows of the benchmark are built by Spark, distinct with their items, and
written by hash as block files of about ``BLOCK_BYTES`` of benchmark text to the shared
folder.  A task holds one block at a time beside its shard's index, and the
marks of all blocks are merged, so neither the driver nor a task holds the benchmark.

Null and wordless texts have no words, no hits and are not contaminated; an item
of fewer than ``window`` words (but not none) is one window; repeated item ids
pool their windows; a null item id marks words but is not listed.
"""

from __future__ import annotations

import hashlib
import math
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import fresh_path, materialize, ranges, read_file, release, slices, write_file
from ._words import WordColumn, words

WINDOW = 13
SAMPLE = 8
SHARD_WORDS = 200_000
BLOCK_BYTES = 16_000_000


class WaveletMatrix:
    """Ranks over an integer sequence, one bit vector per bit of a symbol."""

    def __init__(self, seq: np.ndarray, sigma: int):
        self.bits = max(1, int(sigma - 1).bit_length())
        self.n = len(seq)
        self.levels: list[tuple[np.ndarray, np.ndarray, int]] = []
        for b in range(self.bits - 1, -1, -1):
            bit = (seq >> b & 1).astype(bool)
            words_ = np.packbits(np.concatenate([bit, np.zeros(-len(bit) % 64 + 64, bool)]), bitorder="little").view("<u8")
            ones = np.concatenate([[0], np.cumsum(np.bitwise_count(words_), dtype=np.int64)]).astype(np.int32)
            zeros = self.n - int(bit.sum())
            self.levels.append((words_, ones, zeros))
            seq = np.concatenate([seq[~bit], seq[bit]])

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Occurrences of each symbol before each position."""
        low, pos = np.zeros(len(at), np.int64), at.astype(np.int64)
        for k, (words_, ones, zeros) in enumerate(self.levels):
            bit = (symbol >> (self.bits - 1 - k) & 1).astype(bool)
            a, b = _ones(words_, ones, low), _ones(words_, ones, pos)
            low, pos = np.where(bit, zeros + a, low - a), np.where(bit, zeros + b, pos - b)
        return pos - low

    def access(self, at: np.ndarray) -> np.ndarray:
        symbol, pos = np.zeros(len(at), np.int64), at.astype(np.int64)
        for words_, ones, zeros in self.levels:
            bit = (words_[pos >> 6] >> (pos & 63).astype(np.uint64) & np.uint64(1)).astype(bool)
            a = _ones(words_, ones, pos)
            symbol, pos = symbol << 1 | bit, np.where(bit, zeros + a, pos - a)
        return symbol


def _ones(words_: np.ndarray, ones: np.ndarray, at: np.ndarray) -> np.ndarray:
    block = at >> 6
    mask = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
    return ones[block] + np.bitwise_count(words_[block] & mask)


def suffix_order(text: np.ndarray) -> np.ndarray:
    """Suffix array by prefix doubling; only suffixes still tied are sorted again.

    ``text`` must end in a symbol that occurs once, smaller than all others.
    """
    n = len(text)
    bits = max(1, int(text.max()).bit_length())
    width = max(1, 62 // bits)
    padded = np.concatenate([text, np.zeros(width, text.dtype)]).astype(np.int64)
    key = np.zeros(n, np.int64)
    for k in range(width):
        key = key << bits | padded[k : k + n]
    order = np.argsort(key, kind="stable")
    new = np.concatenate([[True], key[order[1:]] != key[order[:-1]]])
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    h = width
    while True:
        last = np.concatenate([new[1:], [True]])
        tied = np.flatnonzero(~(new & last))
        if not len(tied):
            return order
        rows = order[tied]
        follow = np.where(rows + h < n, rank[np.minimum(rows + h, n - 1)], -1)
        own = rank[rows]
        again = np.argsort(own * (n + 1) + follow + 1, kind="stable")
        rows, own, follow = rows[again], own[again], follow[again]
        order[tied] = rows
        fresh = np.concatenate([[True], (own[1:] != own[:-1]) | (follow[1:] != follow[:-1])])
        new[tied] = fresh
        rank[rows] = np.maximum.accumulate(np.where(fresh, tied, 0))
        h *= 2


class FMIndex:
    """FM-index of documents in a row, each ended by a separator of its own."""

    def __init__(self, vocabulary: list[bytes], numbers: np.ndarray, sizes: np.ndarray):
        self.vocabulary = dict(zip(vocabulary, range(len(vocabulary))))
        # Separators take the smallest numbers; the last one is the smallest of all.
        d = len(sizes)
        text = np.empty(len(numbers) + d, np.int32)
        body = np.ones(len(text), bool)
        ends = np.cumsum(sizes + 1) - 1
        body[ends] = False
        text[ends] = np.arange(d - 1, -1, -1)
        text[body] = numbers + d
        self.separators, self.starts, self.n = d, ends - sizes, len(text)
        order = suffix_order(text).astype(np.int32)
        sigma = d + len(self.vocabulary)
        # All separators are one symbol of the transform: patterns never hold one.
        bwt = np.maximum(text[order - 1] - d + 1, 0)
        self.matrix = WaveletMatrix(bwt, len(self.vocabulary) + 1)
        counts = np.bincount(text, minlength=sigma)
        self.before = np.concatenate([[0], d + np.concatenate([[0], np.cumsum(counts[d:])])])
        self.marked = order % SAMPLE == 0
        # A walk must not step over a separator, whose rank is not kept: sample document starts too.
        first = np.zeros(self.n, bool)
        first[self.starts] = True
        self.marked |= first[order]
        self.sampled_before = np.concatenate([[0], np.cumsum(self.marked)]).astype(np.int32)
        self.samples = order[self.marked]

    def symbols(self, vocabulary: list[bytes]) -> np.ndarray:
        """Symbol of each word in this index; 0 where it does not occur."""
        return np.fromiter((self.vocabulary.get(w, -1) + 1 for w in vocabulary), np.int64, len(vocabulary))

    def search(self, patterns: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row ranges of right-aligned patterns (symbols, 0 for padding), by backward search."""
        low, high = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.n, np.int64)
        width = patterns.shape[1]
        live = np.arange(len(patterns))
        for k in range(width):
            live = live[(lengths[live] > k) & (low[live] < high[live])] if k else live[lengths > 0]
            if not len(live):
                break
            c = patterns[live, width - 1 - k]
            base = self.before[c]
            low[live] = base + self.matrix.rank(c, low[live])
            high[live] = base + self.matrix.rank(c, high[live])
        high[lengths == 0] = 0
        return low, np.maximum(high, low)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text position of each row, by steps to the nearest sampled one."""
        rows, steps = rows.copy(), np.zeros(len(rows), np.int64)
        todo = np.flatnonzero(~self.marked[rows])
        while len(todo):
            c = self.matrix.access(rows[todo])
            rows[todo] = self.before[c] + self.matrix.rank(c, rows[todo])
            steps[todo] += 1
            todo = todo[~self.marked[rows[todo]]]
        return self.samples[self.sampled_before[rows]].astype(np.int64) + steps


class Phrases:
    """Distinct windows of one block of the benchmark, each with its items."""

    def __init__(self, windows: list[tuple[list[bytes], list[str]]], window: int):
        self.window = window
        number: dict[bytes, int] = {}
        rows = [[number.setdefault(w, len(number)) for w in ws] for ws, _ in windows]
        self.vocabulary = list(number)
        self.lengths = np.array([len(t) for t in rows], np.int64)
        self.rows = np.zeros((len(rows), window), np.int32)
        for k, t in enumerate(rows):
            self.rows[k, window - len(t) :] = t
        self.items = [items for _, items in windows]

    def hits(self, index: FMIndex):
        """Occurrences in one shard: text position, length, document and window of each."""
        symbols = index.symbols(self.vocabulary)
        patterns = symbols[self.rows]
        pad = np.arange(self.window)[None, :] < self.window - self.lengths[:, None]
        whole = ((patterns > 0) | pad).all(axis=1)
        at = np.flatnonzero(whole)
        low, high = index.search(patterns[at], self.lengths[at])
        count = high - low
        which = np.repeat(at, count)
        place = index.locate(ranges(low, count))
        doc = np.searchsorted(index.starts, place, "right") - 1
        return place, self.lengths[which], doc, which


def parts(sizes: np.ndarray, most: int, overlap: int) -> Iterator[list[tuple[int, int, int]]]:
    """Shards: lists of (document, first word, end) of at most ``most`` words together."""
    held, used = [], 0
    for d, n in enumerate(sizes.tolist()):
        low = 0
        while n:
            if used >= most - overlap:
                yield held
                held, used = [], 0
            high = min(n, low + most - used)
            held.append((d, low, high))
            used += high - low
            if high == n:
                break
            low = max(low + 1, high - overlap)
    if held:
        yield held


class Blocks:
    """The block files, of which one is in memory."""

    def __init__(self, paths: list[str]):
        self.paths, self.open = paths, (None, None)

    def __iter__(self) -> Iterator[Phrases]:
        # The one that is open comes first.
        for path in sorted(self.paths, key=lambda p: p != self.open[0]):
            if path != self.open[0]:
                self.open = None, None
                self.open = path, pickle.loads(read_file(path))
            yield self.open[1]


def scan_shard(texts: pa.Array, blocks, window: int, shard_words: int):
    """Per document: number of words, merged hit word spans and the set of items that occur."""
    column = WordColumn(texts)
    sizes, first = column.counts, column.edges[:-1]
    vocabulary, numbers = column.numbered()
    numbers = numbers.astype(np.int32)
    marks = np.zeros(len(numbers) + 1, np.int32)
    seen: list[set] = [set() for _ in sizes]
    for shard in parts(sizes, max(shard_words, 2 * window), window - 1):
        owner, low, high = (np.array(x, np.int64) for x in zip(*shard))
        begin = first[owner] + low
        whole = (high - low).sum() == len(numbers)  # the parts of one shard never overlap
        index = FMIndex(vocabulary, numbers if whole else numbers[ranges(begin, high - low)], high - low)
        for block in blocks:
            place, length, part, which = block.hits(index)
            at = begin[part] + place - index.starts[part]
            np.add.at(marks, at, 1)
            np.add.at(marks, at + length, -1)
            for d, w in set(zip(owner[part].tolist(), which.tolist())):
                seen[d].update(block.items[w])
        del index
    cover = np.cumsum(marks[:-1]) > 0
    # Spans end with their document.
    last = np.zeros(len(cover), bool)
    last[(first + sizes - 1)[sizes > 0]] = True
    begins = np.flatnonzero(cover & np.concatenate([[True], ~cover[:-1] | last[:-1]])) if len(cover) else np.zeros(0, np.int64)
    ends = np.flatnonzero(cover & np.concatenate([~cover[1:] | last[:-1], [True]])) + 1 if len(cover) else begins
    owner = np.searchsorted(first, begins, "right") - 1
    removal: list[list[tuple[int, int]]] = [[] for _ in sizes]
    for d, b, e in zip(owner.tolist(), begins.tolist(), ends.tolist()):
        removal[d].append((b - int(first[d]), e - int(first[d])))
    return sizes, removal, seen


_SCHEMA = pa.schema([
    ("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_hit", pa.int64()), ("n_items", pa.int64()), ("items_sha256", pa.string()),
    ("contaminated", pa.bool_()), ("items", pa.list_(pa.string())), ("spans", pa.list_(pa.list_(pa.int64()))),
])
RESULT = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, items array<string>, spans array<array<long>>"


def _scanner(paths: list[str], window: int, shard_words: int, share: int):
    def scan(batches):
        blocks = Blocks(paths)
        for part in slices(batches, 1, 7 * shard_words):
            sizes, removal, seen = scan_shard(part.column(1), blocks, window, shard_words)
            hit = hit_words(removal)
            names = [sorted(x) for x in seen]
            digests = [hashlib.sha256(",".join(x).encode()).hexdigest() for x in names]
            contaminated = (hit > 0) & (share * hit >= sizes)
            columns = [part.column(0), sizes, hit, [len(x) for x in names], digests, contaminated, names, [[list(s) for s in x] for x in removal]]
            yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, _SCHEMA.types)], schema=_SCHEMA)
        release()

    return scan


def hit_words(removal: list[list[tuple[int, int]]]) -> np.ndarray:
    return np.array([sum(e - b for b, e in spans) for spans in removal], np.int64)


def _windows(window: int):
    """(window's words, item) of every item's windows."""
    schema = pa.schema([("words", pa.binary()), ("item", pa.string())])

    def run(batches):
        for batch in slices(batches, 1):
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ws = words((text or "").encode())
                for low in range(0, max(1, len(ws) - window + 1) if ws else 0, 10_000):
                    some = [b" ".join(ws[k : k + window]) for k in range(low, min(low + 10_000, max(1, len(ws) - window + 1)))]
                    yield pa.record_batch([pa.array(some, pa.binary()), pa.array([item] * len(some), pa.string())], schema=schema)

    return run


def _writer(folder: str, window: int):
    """One block file of the windows of a partition, sorted by their words; a row with its path."""

    def run(batches):
        windows: list[tuple[list[bytes], list[str]]] = []
        last = None
        for batch in batches:
            for key, item in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if key != last:
                    windows.append((key.split(), []))
                    last = key
                if item is not None:
                    windows[-1][1].append(item)
        if windows:
            yield pa.record_batch([[write_file(folder, "block", ".bin", pickle.dumps(Phrases(windows, window)))]], names=["path"])

    return run


def phrase_blocks(benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> list[str]:
    """Write the benchmark's distinct windows as block files; their paths, one for each ``block_bytes`` of its text."""
    size = benchmark.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, math.ceil(size / block_bytes))
    found = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text").mapInArrow(_windows(window), "words binary, item string").distinct()
    dealt = found.repartition(blocks, "words").sortWithinPartitions("words", "item")
    written = materialize(dealt.mapInArrow(_writer(fresh_path(benchmark.sparkSession, "phrases"), window), "path string"), "phrase-blocks")
    return [r["path"] for r in written.collect()]


def find(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, share: int = 20, shard_words: int = SHARD_WORDS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per document: words, hit words, items, contamination and the merged spans of words to remove.

    A document is contaminated if it has a hit word and ``share`` times its hit
    words reach its words (20: at least 5 percent).
    """
    paths = phrase_blocks(benchmark, window, block_bytes)
    return docs.select("doc_id", "text").mapInArrow(_scanner(paths, window, shard_words, share), RESULT)


def keep_clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, share: int = 20, shard_words: int = SHARD_WORDS) -> DataFrame:
    """The documents that are not contaminated, with all their columns, in one pass."""
    paths, at = phrase_blocks(benchmark, window), docs.columns.index("text")

    def keep(batches):
        blocks = Blocks(paths)
        for part in slices(batches, at, 7 * shard_words):
            sizes, removal, _ = scan_shard(part.column(at), blocks, window, shard_words)
            hit = hit_words(removal)
            yield part.filter(pa.array((hit == 0) | (share * hit < sizes)))
        release()

    return docs.mapInArrow(keep, docs.schema)
