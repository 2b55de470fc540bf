"""Runs of repeated words: the harmonic grid of periods with LCE queries on suffix arrays.

For each period p the grid has the places p, 2p, 3p ...; a run of period p that is
four periods long covers four of them.  At a pair of places jp and (j+1)p, the
longest common extension (LCE) forward and backward gives the whole stretch in
which words p apart are equal.  All pairs of all periods are about n log n.

LCE forward is the least entry between two suffixes in the array of common
prefixes (suffix array, range-minimum table), LCE backward the same over the
reversed words.  A pair whose first words differ has LCE 0, and a run of four
periods has three such pairs in a row, so only places with three equal pairs are
asked, and only documents that have one get an index.

Each task indexes documents together, about ``INDEX_WORDS`` words at a time, with
a separator of its own behind each, so that no extension leaves a document.  No
row is shuffled.  A document of more words has an index of its own, about 200
bytes a word.

Rows: a null text has no words.  Null and repeated ids are rows like others.  An
empty table gives no rows.  Other columns are not read.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ._shared import release, slices, spans, string_buffers

LEAST, PERIODS = 6, 4
INDEX_WORDS = 1 << 18
#: LCE queries answered at once.
_ASK = 1 << 18

_SPACE = np.zeros(256, bool)
_SPACE[list(b" \t\n\x0b\x0c\r")] = True


def word_ids(column: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of all texts in a row: their numbers, how many each text has, the distinct words."""
    offsets, raw = string_buffers(column)
    word = ~_SPACE[raw]
    start = word.copy()
    start[1:] &= ~word[:-1]
    heads = offsets[:-1][offsets[:-1] < len(raw)]
    start[heads] |= word[heads]
    first = np.flatnonzero(start)
    bounds = np.append(np.cumsum(word)[first] - 1, word.sum()).astype(np.int32)
    words = pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(bounds), pa.py_buffer(raw[word])])
    coded = words.dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), np.diff(np.searchsorted(first, offsets)), coded.dictionary


class Extensions:
    """LCE queries over a sequence: suffix array by doubling, common prefixes of neighbours, range minima."""

    def __init__(self, seq: np.ndarray):
        n = len(seq)
        rank = np.unique(seq, return_inverse=True)[1].astype(np.int64)
        levels, step = [rank.astype(np.int32)], 1
        while True:
            key = rank * (n + 1)
            key[: n - step] += rank[step:] + 1
            order = np.argsort(key, kind="stable")
            ahead = key[order]
            new = np.empty(n, np.int64)
            new[order] = np.concatenate([[0], np.cumsum(ahead[1:] != ahead[:-1])])
            rank = new
            if rank[order[-1]] == n - 1:
                break
            levels.append(rank.astype(np.int32))
            step *= 2
        self.place = rank
        # Common prefix of each suffix and the next in order, from the ranks of 2^k words each, longest first.
        a, b = order[:-1].copy(), order[1:].copy()
        common = np.zeros(max(0, n - 1), np.int32)
        for k in range(len(levels) - 1, -1, -1):
            inside = np.maximum(a, b) < n
            same = inside.copy()
            same[inside] = levels[k][a[inside]] == levels[k][b[inside]]
            common[same] += 1 << k
            a[same] += 1 << k
            b[same] += 1 << k
        del levels
        self.minima = [common]
        while 2 << (len(self.minima) - 1) <= len(common):
            half, last = 1 << (len(self.minima) - 1), self.minima[-1]
            self.minima.append(np.minimum(last[:-half], last[half:]))

    def common(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Length of the longest common prefix of the suffixes at i and j, i and j different."""
        x, y = self.place[i], self.place[j]
        low, high = np.minimum(x, y), np.maximum(x, y)
        level = np.frexp((high - low).astype(np.float64))[1] - 1
        out = np.empty(len(i), np.int64)
        for k in np.unique(level):
            own = level == k
            table = self.minima[k]
            out[own] = np.minimum(table[low[own]], table[high[own] - (1 << k)])
        return out


def grid(seq: np.ndarray, ends: np.ndarray, lengths: np.ndarray, least: int = LEAST, periods: int = PERIODS) -> tuple[np.ndarray, np.ndarray]:
    """(place, period) of grid pairs whose words and those of the ``periods`` - 2 pairs after are equal.

    ``seq`` holds the documents, longest first, each with a separator behind; period
    p is asked only of those that are long enough for it.
    """
    places, found = [], []
    needs = np.maximum(least, periods * np.arange(1, int(lengths[0]) // periods + 1)) if len(lengths) else np.zeros(0, np.int64)
    long_enough = np.searchsorted(-lengths, -needs, "right")
    for p, many in enumerate(long_enough, 1):
        if not many:
            break
        column = seq[: ends[many - 1] : p]
        same = column[1:] == column[:-1]
        if len(same) < periods - 1:
            continue
        row = same[: len(same) - periods + 2].copy()
        for k in range(1, periods - 1):
            row &= same[k : k + len(row)]
        at = np.flatnonzero(row)
        if len(at):
            places.append(at * p)
            found.append(np.full(len(at), p))
    return (np.concatenate(places), np.concatenate(found)) if places else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def _stretches(seq: np.ndarray, place: np.ndarray, period: np.ndarray, least: int, periods: int) -> np.ndarray:
    """Rows (start, end, period) of the runs around grid pairs, those with their smallest period."""
    forward, backward = Extensions(seq), Extensions(seq[::-1])
    n, found = len(seq), []
    for a in range(0, len(place), _ASK):
        i, p = place[a : a + _ASK], period[a : a + _ASK]
        ahead = forward.common(i, i + p)
        # From the pair itself backward, so that no place before the first is asked.
        back = backward.common(n - 1 - i, n - 1 - i - p)
        start, end = i - back + 1, i + p + ahead
        keep = end - start >= np.maximum(least, periods * p)
        found.append(np.unique(np.stack([start[keep], end[keep], p[keep]], 1), axis=0))
    rows = np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 3), np.int64)
    # A stretch with several periods of at least two lengths has its smallest one among them.
    first = np.ones(len(rows), bool)
    first[1:] = (rows[1:, :2] != rows[:-1, :2]).any(1)
    return rows[first]


def runs(seqs: list[np.ndarray], least: int = LEAST, periods: int = PERIODS) -> list[np.ndarray]:
    """Per sequence its runs as rows (start, length, period), by start, then period.

    A run is a stretch of the smallest period q and at least max(``least``, ``periods`` * q)
    long that no neighbouring word extends.  ``periods`` is 2 at least.
    """
    out = [np.zeros((0, 3), np.int64)] * len(seqs)
    lengths = np.array([len(s) for s in seqs], np.int64)
    order = np.argsort(-lengths, kind="stable")
    order = order[lengths[order] >= least]
    if not len(order):
        return out

    def joined(some: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The documents with separators, and where each ends with its separator."""
        apart = [x for k, d in enumerate(some) for x in (seqs[d], np.array([-1 - k], np.int64))]
        return np.concatenate(apart), np.cumsum(lengths[some] + 1)

    seq, ends = joined(order)
    place, period = grid(seq, ends, lengths[order], least, periods)
    owner = np.searchsorted(ends, place, "right")
    asked = np.unique(owner)
    # Documents with a pair to ask, in groups that share an index.
    group = (np.cumsum(lengths[order[asked]]) - 1) // INDEX_WORDS
    for g in np.unique(group):
        some = asked[group == g]
        docs = order[some]
        own = np.flatnonzero((owner >= some[0]) & (owner <= some[-1]))
        inside, inside_ends = joined(docs)
        starts = inside_ends - lengths[docs] - 1
        mine = np.searchsorted(some, owner[own])
        at = place[own] - (ends - lengths[order] - 1)[owner[own]] + starts[mine]
        # A pair that crosses into the next document holds a separator: no run.
        fits = at + period[own] < inside_ends[mine] - 1
        rows = _stretches(inside, at[fits], period[own][fits], least, periods)
        who = np.searchsorted(inside_ends, rows[:, 0], "right")
        for k in np.unique(who):
            r = rows[who == k]
            r = np.stack([r[:, 0] - starts[k], r[:, 1] - r[:, 0], r[:, 2]], 1)
            out[docs[k]] = r[np.lexsort((r[:, 2], r[:, 0]))]
    return out


def kept_words(n: int, found: np.ndarray) -> np.ndarray:
    """Numbers of the words that are in no run after its first period."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, found[:, 0] + found[:, 2], 1)
    np.add.at(change, found[:, 0] + found[:, 1], -1)
    return np.flatnonzero(np.cumsum(change[:n]) == 0)


def strongest(found: np.ndarray) -> tuple[int, int, int] | None:
    """(start, length, period) with the greatest length / period; ties to the smaller start, then period."""
    best = None
    for start, length, period in found.tolist():
        if best is None or length * best[2] > best[1] * period:
            best = start, length, period
    return best


def repeat_tail(doc_id: int | None, n: int) -> np.ndarray | None:
    """Which words the query's rewriting puts at each place of a document, if it changes it."""
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    at = np.arange(n)
    at[a:] = a + (at[a:] - a) % p
    return at


RESULT = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string, n_words long, n_kept long, runs array<struct<start: long, length: long, period: long>>"
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
_SCHEMA = pa.schema([
    ("doc_id", pa.int64()), *((n, pa.int64()) for n in ("n_runs", "start", "length", "period", "exponent_milli")), ("runs_sha256", pa.string()), ("collapsed_sha256", pa.string()),
    ("n_words", pa.int64()), ("n_kept", pa.int64()), ("runs", pa.list_(_RUN)),
])


def detect(docs: DataFrame, rewrite=None, least: int = LEAST, periods: int = PERIODS) -> DataFrame:
    """Per document: its runs, the strongest of them, and digests of the runs and of the words that are kept.

    ``rewrite(doc_id, n)`` may give the numbers of the words that stand in for those of
    a document of n words, or None.
    """

    def one(doc_id, at: np.ndarray, words: np.ndarray, found: np.ndarray) -> tuple:
        kept = kept_words(len(at), found)
        best = strongest(found)
        listed = "".join(f"{s},{n},{p}\n" for s, n, p in found.tolist())
        digest = hashlib.sha256(b" ".join(words[at[kept]].tolist())).hexdigest()
        milli = None if best is None else 1000 * best[1] // best[2]
        return doc_id, len(found), *(best or (None, None, None)), milli, hashlib.sha256(listed.encode()).hexdigest(), digest, len(at), len(kept), [dict(zip(("start", "length", "period"), r)) for r in found.tolist()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            ids = batch.column(0).to_pylist()
            numbers, counts, distinct = word_ids(batch.column(1))
            words = np.array([None, *distinct.to_pylist()], object)[1:]
            seqs = []
            for doc_id, a, n in zip(ids, spans(counts)[0], counts):
                seq = numbers[a : a + n]
                other = rewrite(doc_id, int(n)) if rewrite else None
                seqs.append(seq if other is None else seq[other])
            rows = [one(*x) for x in zip(ids, seqs, [words] * len(ids), runs(seqs, least, periods))]
            if rows:
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), _SCHEMA.types)], schema=_SCHEMA)
        release()

    return docs.select(docs.doc_id.cast("long"), "text").mapInArrow(run, RESULT)
