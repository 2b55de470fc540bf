"""Exact top-k BM25 search: an inverted index with block-max WAND pruning, by shards.

Each task builds inverted indexes of the documents it scans: postings by term,
with the largest term part of every list and of every block of ``BLOCK``
documents.  Index files and the term counts of all shards go to the shared folder;
document frequencies and lengths are summed over all shards, so every shard ranks
with global statistics and their top lists merge exactly.

A block of queries goes through the shards of a group in turn, and each query takes
its k-th best score so far along as its threshold.  A shard orders its documents so
that like ones stand in one block.  Its rare terms are posting lists; terms that are
common in a run of ``RUN`` documents are rows of a table of the run, with the largest
part of every row and block.  A query's lists stand rarest first.  The pivot is the
first list from which on all bounds together add a part of the threshold only: where
the lists before it are short, only their documents can enter.  Otherwise the lists
are added up, and the maxima of a document block bound what common terms add: blocks
under the threshold are skipped and their part of the table never read.  In the blocks
that are left the rows are added for many queries at once, as a product of matrices in
place of one cursor step after the other, which raises the threshold for the blocks to
come.  These sums are of single precision; documents that reach the threshold within
its error are scored in full in one fixed term order, rounded to ``DIGITS`` and ranked
by score, then id, so pruning never changes a result.

A query is the set of distinct words of a text; rows of one query id are one query of
all their words.  Null and wordless texts are indexed as empty and match nothing; a
query without words has no rows; rows of one document id are ranked each.  A word is
known by its 64-bit hash: two words that shared one (a chance of about 1e-8 among a
million words) would be one term.
"""

from __future__ import annotations

import io
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._shared import fresh_path, materialize, ranges, read_file, release, slices, write_file
from ._words import WordColumn

K1, B = 1.2, 0.75
BLOCK = 64
SHARD_DOCS = 20_000
SHARD_BYTES = 64_000_000
QUERY_BLOCK = 16_384
GROUP_SHARDS = 8
DIGITS = 6
#: Documents of a run, and from which chance that one of them and a query both have a term, and from how many that have it, it stands in the run's table.
RUN = 1024
COMMON, LEAST = 0.005, 8
#: Cells of a shard's tables, and of the sums of a step of queries, at most.
TABLE_CELLS = 32_000_000
SCORES = 8_000_000
_SLACK = 2e-6
#: The part of the threshold that lists behind the pivot may add.
_PIVOT = 0.5
#: Postings from which on a list is long.
_SHORT = 48


def word_hashes(w: WordColumn) -> np.ndarray:
    """A 64-bit hash of every word, eight bytes at a time; words of up to eight bytes never share one."""
    sizes = np.diff(w.bounds).astype(np.int64)
    padded = np.concatenate([w.bytes, np.zeros(8, np.uint8)])
    at = w.bounds[:-1].astype(np.int64)
    eights = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(padded, 8)[at]).view("<u8")[:, 0] if len(at) else np.zeros(0, np.uint64)
    # Bytes behind the word's end count as zero, which no word has.
    found = _mixed(eights & _KEPT[np.minimum(sizes, 8)])
    more = np.flatnonzero(sizes > 8)
    done = 8
    while len(more):
        eights = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(padded, 8)[at[more] + done]).view("<u8")[:, 0]
        found[more] = _mixed(found[more] * np.uint64(0x9E3779B97F4A7C15) + (eights & _KEPT[np.minimum(sizes[more] - done, 8)]))
        done += 8
        more = more[sizes[more] > done]
    return found.view(np.int64)


def _mixed(x: np.ndarray) -> np.ndarray:
    """One 64-bit number for another, so that near ones stand far apart."""
    for shift, factor in ((33, 0xFF51AFD7ED558CCD), (33, 0xC4CEB9FE1A85EC53)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(33))


_KEPT = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def term_sets(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(term, text number, count) sorted by term then text, and the words of each text.  A term is a word's 64-bit hash."""
    w = WordColumn(column)
    term, text = word_hashes(w), np.repeat(np.arange(len(w.counts)), w.counts)
    # Words come by text, and a stable order keeps that.
    order = np.argsort(term, kind="stable")
    term, text = term[order], text[order]
    fresh = np.concatenate([[True], (term[1:] != term[:-1]) | (text[1:] != text[:-1])]) if len(term) else np.zeros(0, bool)
    heads = np.flatnonzero(fresh)
    return term[heads], text[heads], np.diff(np.append(heads, len(term))), w.counts


def alike(some_terms: np.ndarray, some_docs: np.ndarray, some: int, terms: np.ndarray, docs: np.ndarray, n: int) -> np.ndarray:
    """A new number of each of ``n`` documents, by which those with the same common terms stand together.

    Blocks of like documents have tight maxima.  The common terms are those of the
    first batch; they only change the layout, never a result.
    """
    found, counts = np.unique(some_terms, return_counts=True)
    split = counts * np.maximum(some - counts, 0)
    chosen = np.sort(found[np.argsort(-split, kind="stable")[:64]])
    at = np.minimum(np.searchsorted(chosen, terms), max(0, len(chosen) - 1))
    own = np.flatnonzero(chosen[at] == terms) if len(chosen) else np.zeros(0, np.int64)
    bits = np.zeros((n, max(1, len(chosen))), bool)
    bits[docs[own], at[own]] = True
    weight = np.argsort(np.argsort(-split[np.searchsorted(found, chosen)], kind="stable")) if len(chosen) else np.zeros(1, np.int64)
    order = np.lexsort(bits[:, np.argsort(weight)].T[::-1])
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    return place


class Shard:
    """Postings of some documents."""

    def __init__(self, doc_ids: np.ndarray, lengths: np.ndarray, terms: np.ndarray, starts: np.ndarray, docs: np.ndarray, counts: np.ndarray):
        self.doc_ids, self.lengths, self.terms, self.starts, self.docs, self.counts = doc_ids, lengths, terms, starts, docs, counts

    @classmethod
    def build(cls, parts: list[tuple]) -> "Shard":
        """From (doc ids, term, text, count, words) of consecutive batches."""
        base, terms, docs, counts = 0, [], [], []
        for ids, term, text, count, _ in parts:
            terms.append(term)
            docs.append(text + base)
            counts.append(count)
            base += len(ids)
        term, doc, count = np.concatenate(terms), np.concatenate(docs), np.concatenate(counts)
        place = alike(terms[0], docs[0], len(parts[0][0]), term, doc, base)
        doc, number = place[doc], np.argsort(place, kind="stable")
        order = np.lexsort((doc, term))
        term = term[order]
        first = np.flatnonzero(np.concatenate([[True], term[1:] != term[:-1]])) if len(term) else np.zeros(0, np.int64)
        return cls(np.concatenate([p[0] for p in parts])[number], np.concatenate([p[4] for p in parts])[number], term[first], np.append(first, len(term)), doc[order].astype(np.int32), count[order].astype(np.int32))

    def to_bytes(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, doc_ids=self.doc_ids, lengths=self.lengths, terms=self.terms, starts=self.starts, docs=self.docs, counts=self.counts)
        return out.getvalue()

    @classmethod
    def from_bytes(cls, data: bytes) -> "Shard":
        with np.load(io.BytesIO(data)) as z:
            return cls(*(z[n] for n in ("doc_ids", "lengths", "terms", "starts", "docs", "counts")))

    def weigh(self, mean_length: float) -> "Shard":
        """Term parts with the global mean length, their maxima by list, and by block where a term is common."""
        tf = self.counts.astype(np.float64)
        norm = K1 * (1 - B + B * self.lengths / max(mean_length, 1e-9))
        self.part = tf * (K1 + 1) / (tf + norm[self.docs])
        n = len(self.terms)
        self.most = np.maximum.reduceat(self.part, self.starts[:-1]) if n else np.zeros(0)
        self.blocks = (len(self.doc_ids) + BLOCK - 1) // BLOCK
        self._split()
        # The same postings by document, to score one in full.
        by_doc = np.argsort(self.docs.astype(np.uint16) if len(self.doc_ids) <= 1 << 16 else self.docs, kind="stable")
        self.term_of = np.repeat(np.arange(n, dtype=np.int32), np.diff(self.starts))[by_doc]
        self.part_of = self.part[by_doc]
        self.doc_starts = np.concatenate([[0], np.cumsum(np.bincount(self.docs, minlength=len(self.doc_ids)))])
        self.skipped = self.scored = 0
        return self

    def _split(self) -> None:
        """Postings of terms that are common in a run of documents as a table of the run; the others stay lists."""
        n = len(self.doc_ids)
        run = self.docs // RUN
        fresh = np.concatenate([[True], run[1:] != run[:-1]]) if len(run) else np.zeros(0, bool)
        fresh[self.starts[:-1]] = True
        heads = np.flatnonzero(fresh)
        sizes, run = np.diff(np.append(heads, len(self.docs))), run[heads]
        width = np.minimum(RUN, n - RUN * np.arange((n + RUN - 1) // RUN))
        lists = np.repeat(np.arange(len(self.terms)), np.add.reduceat(fresh, self.starts[:-1], dtype=np.int64)) if len(self.terms) else np.zeros(0, np.int64)
        # How often a document of the run and a query, which is like any document, both have the term.
        both = sizes / width[run] * (np.diff(self.starts)[lists] / max(1, n))
        least = COMMON
        while (chosen := (both >= least) & (sizes >= LEAST)).sum() * RUN > TABLE_CELLS:
            least *= 2
        held = np.repeat(~chosen, sizes)
        before = np.concatenate([[0], np.cumsum(held)])
        self.list_starts = before[self.starts]
        # A document stands in the last bits of a posting, its part in the first ones (``search_all``).
        wide, bits = n > 1 << 16, max(1, (n - 1).bit_length())
        self.whole, self.real, self.low = np.int64 if wide else np.int32, np.float64 if wide else np.float32, (1 << bits) - 1
        self.list_docs, self.list_part = self.docs[held].astype(np.uint32 if wide else np.uint16), self.part[held].astype(np.float32)
        chosen = np.flatnonzero(chosen)
        lists, run = lists[chosen], run[chosen]
        known = np.unique(lists)
        self.common = np.full(len(self.terms), -1, np.int32)
        self.common[known] = np.arange(len(known))
        self.runs = []
        for r in range(len(width)):
            own = np.flatnonzero(run == r)
            at, size = heads[chosen[own]], sizes[chosen[own]]
            read = ranges(at, size)
            blocks = (int(width[r]) + BLOCK - 1) // BLOCK
            table = np.zeros((len(own), blocks * BLOCK), np.float32)
            table[np.repeat(np.arange(len(own)), size), self.docs[read] - r * RUN] = self.part[read]
            slot = np.full(len(known), -1, np.int32)
            slot[self.common[lists[own]]] = np.arange(len(own))
            self.runs.append((r * RUN, slot, table, table.reshape(len(own), blocks, BLOCK).max(2)))
        # Long documents first: they raise the thresholds.
        self.runs.sort(key=lambda x: -float(x[3].sum()))
        #: Sums of packed parts and in single precision are off by less, as a part of themselves.
        self.off = 2.0 ** (bits - (52 if wide else 23)) + (max((len(x[2]) for x in self.runs), default=0) + 8) * 2.0**-23

    def full(self, doc: int, lists: np.ndarray, weight: np.ndarray) -> float:
        """The whole score of a document, added up in the order of terms (``lists`` ascend)."""
        first = self.doc_starts[doc]
        terms = self.term_of[first : self.doc_starts[doc + 1]]
        at = terms.searchsorted(lists)
        at[at == len(terms)] = 0
        own = (terms[at] == lists).nonzero()[0]
        return float((weight[own] * self.part_of[first + at[own]]).sum())

    def search(self, terms: np.ndarray, idf: np.ndarray, k: int, floor: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
        """(document numbers, rounded scores): the top ``k`` here by score, then document id.

        Documents that score less than ``floor`` need not be found.
        """
        for _, docs, scores in self.search_all(Queries.of(terms, idf, np.array([len(terms)])), k, np.array([floor])):
            return docs, scores
        return np.zeros(0, np.int64), np.zeros(0)

    def search_all(self, asked: "Queries", k: int, floors: np.ndarray):
        """(query, document numbers, rounded scores) of every query that has documents here at its floor."""
        if not len(self.terms) or not len(asked.terms):
            return
        at = np.minimum(np.searchsorted(self.terms, asked.terms), len(self.terms) - 1)
        here = np.flatnonzero(self.terms[at] == asked.terms)
        list_of, idf = np.full(len(asked.terms), -1, np.int32), np.zeros(len(self.terms))
        list_of[here], idf[at[here]] = at[here], asked.idf[here]
        # A posting of a list in one number: as a floating-point number it is the weighted part, off by what the document's bits are worth.
        packed = (self.list_part * np.repeat(idf.astype(np.float32), np.diff(self.list_starts))).astype(self.real).view(self.whole)
        packed &= ~self.whole(self.low)
        packed |= self.list_docs.astype(self.whole)
        step = max(1, SCORES // (self.blocks * BLOCK))
        for low in range(0, len(asked.edges) - 1, step):
            yield from self._search_some(asked, list_of, idf, packed, low, min(low + step, len(asked.edges) - 1), k, floors)

    def _search_some(self, asked: "Queries", list_of: np.ndarray, idf: np.ndarray, packed: np.ndarray, low: int, high: int, k: int, floors: np.ndarray):
        n = high - low
        lists = list_of[asked.code[asked.edges[low] : asked.edges[high]]]
        row = np.repeat(np.arange(n), np.diff(asked.edges[low : high + 1]))[lists >= 0]
        lists = lists[lists >= 0]
        edges = np.searchsorted(row, np.arange(n + 1))
        floor = floors[low:high].astype(np.float64)
        # Bounds of each list and all behind it.
        bound = idf[lists] * self.most[lists]
        total = np.append(0.0, np.cumsum(bound))
        rest = total[edges[1:]][row] - total[:-1]
        all_bounds = total[edges[1:]] - total[edges[:-1]]
        asks = (edges[1:] > edges[:-1]) & (all_bounds * (1 + self.off) + _SLACK >= floor)
        # The pivot: from it on, lists may add a part of the threshold only.
        front = rest > _PIVOT * floor[row]
        pivot = np.bincount(row[front], minlength=n)
        sizes = self.starts[lists + 1] - self.starts[lists]
        few = asks & (pivot < np.diff(edges)) & (np.bincount(row[front], sizes[front], n) * 4 <= len(self.doc_ids))
        self.skipped += int((~asks).sum()) * self.blocks
        cands = []
        for q in np.flatnonzero(few):
            some = lists[edges[q] : edges[q] + pivot[q]]
            read = ranges(self.starts[some], self.starts[some + 1] - self.starts[some])
            got = np.bincount(self.docs[read], np.repeat(idf[some], self.starts[some + 1] - self.starts[some]) * self.part[read], len(self.doc_ids))
            behind = rest[edges[q] + pivot[q]]
            found = np.flatnonzero((got > 0) & ((got + behind) * (1 + self.off) + _SLACK >= floor[q]))
            self.skipped += self.blocks - len(np.unique(found // BLOCK))
            cands.append((np.full(len(found), q), found, got[found], got[found] + behind))
        rows = np.flatnonzero(asks & ~few)
        if len(rows):
            cands += self._runs(rows, packed, row, lists, edges, idf, floor, k)
        if not cands:
            return
        who, docs, under, over = (np.concatenate(x) for x in zip(*cands))
        good = over * (1 + self.off) + _SLACK >= floor[who]
        who, docs, under, over = who[good], docs[good], under[good], over[good]
        order = np.lexsort((-over, who))
        who, docs, under, over = who[order], docs[order], under[order] * (1 - self.off), over[order] * (1 + self.off)
        bounds = np.searchsorted(who, np.arange(n + 1))
        for q in np.flatnonzero(np.diff(bounds)):
            own, some = slice(bounds[q], bounds[q + 1]), np.sort(lists[edges[q] : edges[q + 1]])
            found, final = self._best(docs[own], under[own], over[own], some, idf[some], k, floors[low + q])
            if len(found):
                yield low + q, found, final

    def _runs(self, rows: np.ndarray, packed: np.ndarray, row: np.ndarray, lists: np.ndarray, edges: np.ndarray, idf: np.ndarray, floor: np.ndarray, k: int) -> list[tuple]:
        """Documents that reach the threshold by all lists, a step of queries at once; raises ``floor``.

        The lists are added up; in each run the maxima of its blocks in the table bound what common
        terms add, and where that reaches the threshold the table's block is read.
        """
        sums = np.zeros((len(rows), self.blocks * BLOCK), np.float32)
        place = np.full(len(floor), -1)
        place[rows] = np.arange(len(rows))
        starts, sizes = self.list_starts[lists], self.list_starts[lists + 1] - self.list_starts[lists]
        # Short lists of all queries are read at once, long ones as they stand.
        short = np.flatnonzero((sizes < _SHORT) & (place[row] >= 0))
        shorts = packed[ranges(starts[short], sizes[short])]
        at = np.append(0, np.cumsum(sizes[short]))[np.searchsorted(short, edges)]
        long = np.flatnonzero(sizes >= _SHORT)
        long_at = np.searchsorted(long, edges)
        starts, ends = starts[long].tolist(), (starts + sizes)[long].tolist()
        for i, q in enumerate(rows):
            read = [packed[a:b] for a, b in zip(starts[long_at[q] : long_at[q + 1]], ends[long_at[q] : long_at[q + 1]])]
            read = np.concatenate([shorts[at[q] : at[q + 1]], *read])
            sums[i, : len(self.doc_ids)] = np.bincount(read & self.low, read.view(self.real), len(self.doc_ids))
        own = np.flatnonzero((place[row] >= 0) & (self.common[lists] >= 0))
        row, where, weight = place[row[own]], self.common[lists[own]], idf[lists[own]].astype(np.float32)
        tops = sums.reshape(len(rows), -1, BLOCK).max(2)
        best, least, out = np.zeros((len(rows), k), np.float32), floor[rows], []
        if tops.shape[1] >= k:
            np.maximum(least, np.partition(tops, -k, axis=1)[:, -k] * (1 - self.off), out=least)
        for base, slot, table, most in self.runs:
            at = slot[where]
            some = np.flatnonzero(at >= 0)
            w = np.zeros((len(rows), len(table)), np.float32)
            w[row[some], at[some]] = weight[some]
            first = base // BLOCK
            bar = ((least - _SLACK) * (1 - 2 * self.off)).astype(np.float32)
            live = tops[:, first : first + most.shape[1]] + w @ most >= bar[:, None]
            self.skipped += int((~live).sum())
            reached = np.zeros(live.shape, np.float32)
            for b in np.flatnonzero(live.any(0)):
                who = np.flatnonzero(live[:, b])
                score = w[who] @ table[:, b * BLOCK : (b + 1) * BLOCK]
                score += sums[who, base + b * BLOCK : base + (b + 1) * BLOCK]
                reached[who, b] = score.max(1)
                q, d = np.nonzero((score >= bar[who, None]) & (score > 0))
                if len(q):
                    score = score[q, d].astype(np.float64)
                    out.append((rows[who[q]], base + b * BLOCK + d, score, score))
            best = np.partition(np.concatenate([best, reached], 1), -k, axis=1)[:, -k:]
            np.maximum(least, best[:, 0] * (1 - self.off), out=least)
        floor[rows] = least
        return out

    def _best(self, docs: np.ndarray, under: np.ndarray, over: np.ndarray, lists: np.ndarray, weight: np.ndarray, k: int, floor: float) -> tuple[np.ndarray, np.ndarray]:
        """The top ``k`` of documents with bounds of their scores, by falling upper bound: scored in full until none can enter."""
        if len(docs) >= k:
            floor = max(floor, float(np.partition(under, -k)[-k]))
        scores: list[float] = []
        for doc, most in zip(docs.tolist(), over.tolist()):
            if most + _SLACK < floor:
                break
            scores.append(self.full(doc, lists, weight))
            if len(scores) % k == 0:
                floor = max(floor, sorted(scores)[-k])
        self.scored += len(scores)
        docs, final = docs[: len(scores)], np.round(np.array(scores), DIGITS)
        best = np.lexsort((self.doc_ids[docs], -final))[:k]
        best = best[final[best] > 0]
        return docs[best], final[best]


class Queries:
    """Sets of terms: distinct terms in order with their idf, and by number which of them each query has, rarest first."""

    def __init__(self, terms: np.ndarray, idf: np.ndarray, code: np.ndarray, edges: np.ndarray):
        self.terms, self.idf, self.code, self.edges = terms, idf, code, edges

    @classmethod
    def of(cls, terms: np.ndarray, idf: np.ndarray, sizes: np.ndarray) -> "Queries":
        """From the terms of each query, one after the other."""
        distinct, first, code = np.unique(terms, return_index=True, return_inverse=True)
        order = np.lexsort((-idf, np.repeat(np.arange(len(sizes)), sizes)))
        return cls(distinct, idf[first], code[order].astype(np.int32), np.append(0, np.cumsum(sizes)))


_BUILT = pa.schema([("kind", pa.int32()), ("path", pa.string()), ("term", pa.int64()), ("n", pa.int64()), ("words", pa.int64())])


def _builder(folder: str):
    def run(batches):
        held, docs, size = [], 0, 0

        def flush():
            shard = Shard.build(held)
            uri = write_file(folder, "shard", ".npz", shard.to_bytes())
            n = len(shard.terms)
            yield pa.record_batch([[0], [uri], [0], [len(shard.doc_ids)], [int(shard.lengths.sum())]], schema=_BUILT)
            if n:
                yield pa.record_batch([pa.array(np.ones(n, np.int32)), pa.nulls(n, pa.string()), pa.array(shard.terms), pa.array(np.diff(shard.starts)), pa.array(np.zeros(n, np.int64))], schema=_BUILT)

        for batch in slices(batches, 1):
            term, text, count, words = term_sets(batch.column(1))
            held.append((batch.column(0).fill_null(-(2**63)).to_numpy(), term, text, count, words))
            docs += batch.num_rows
            size += batch.column(1).nbytes
            if docs >= SHARD_DOCS or size >= SHARD_BYTES:
                yield from flush()
                held, docs, size = [], 0, 0
        if held:
            yield from flush()

    return run


def build(docs: DataFrame) -> DataFrame:
    """Index files of all documents: rows of shards (kind 0: path, documents, words) and of term counts (kind 1)."""
    folder = fresh_path(docs.sparkSession, "bm25")
    return materialize(docs.select("doc_id", "text").mapInArrow(_builder(folder), "kind int, path string, term long, n long, words long"), "bm25")


def _query_terms(batches):
    schema = pa.schema([("query_id", pa.int64()), ("term", pa.int64())])
    for batch in slices(batches, 1):
        term, text, _, _ = term_sets(batch.column(1))
        yield pa.record_batch([batch.column(0).take(pa.array(text)), pa.array(term)], schema=schema)


def _block_writer(folder: str):
    schema = pa.schema([("block", pa.string())])

    def run(batches):
        held: list[tuple] = []
        n = 0

        def flush():
            ids, sizes, terms, idf = (np.concatenate(x) for x in zip(*held))
            held.clear()
            q, out = Queries.of(terms, idf, sizes), io.BytesIO()
            np.savez(out, ids=ids, terms=q.terms, idf=q.idf, code=q.code, edges=q.edges)
            return pa.record_batch([[write_file(folder, "queries", ".npz", out.getvalue())]], schema=schema)

        for batch in batches:
            at = 0
            while at < batch.num_rows:
                some = batch.slice(at, QUERY_BLOCK - n)
                ids, terms, idf = (some.column(c) for c in range(3))
                held.append((ids.to_numpy(), terms.value_lengths().to_numpy(), terms.flatten().to_numpy(), idf.flatten().to_numpy()))
                at, n = at + some.num_rows, n + some.num_rows
                if n >= QUERY_BLOCK:
                    yield flush()
                    n = 0
        if held:
            yield flush()

    return run


def _searcher(mean_length: float, k: int):
    """The best documents of each query over the shards of a group, one shard after the other."""
    schema = pa.schema([("query_id", pa.int64()), ("doc_id", pa.int64()), ("score", pa.float64())])

    class Block:
        """Queries and their best documents so far."""

        def __init__(self, path: str):
            with np.load(io.BytesIO(read_file(path))) as z:
                self.ids, self.asked = z["ids"], Queries(*(z[n] for n in ("terms", "idf", "code", "edges")))
            self.floors = np.zeros(len(self.ids))
            self.docs, self.scores = [np.zeros(0, np.int64)] * len(self.ids), [np.zeros(0)] * len(self.ids)

        def meet(self, shard: Shard) -> None:
            for q, docs, scores in shard.search_all(self.asked, k, self.floors):
                docs, scores = np.concatenate([self.docs[q], shard.doc_ids[docs]]), np.concatenate([self.scores[q], scores])
                best = np.lexsort((docs, -scores))[:k]
                self.docs[q], self.scores[q] = docs[best], scores[best]
                if len(best) == k:
                    self.floors[q] = self.scores[q][-1]

        def rows(self) -> pa.RecordBatch:
            d, s = np.concatenate(self.docs), np.concatenate(self.scores)
            return pa.record_batch([pa.array(np.repeat(self.ids, [len(x) for x in self.docs])), pa.array(d, mask=d == -(2**63)), pa.array(s)], schema=schema)

    def run(batches):
        unit, block = None, None
        for batch in batches:
            for path, name, u in zip(*(batch.column(c).to_pylist() for c in ("path", "block", "u"))):
                if u != unit:
                    # Rows come by unit: the one before is complete.
                    if block:
                        yield block.rows()
                    unit, block = u, Block(name)
                block.meet(Shard.from_bytes(read_file(path)).weigh(mean_length))
        if block:
            yield block.rows()
        release()

    return run


#: Stands for a null query_id inside the search.
_NO_ID = -(2**63)


def search(index: DataFrame, queries: DataFrame, k: int = 10, parts: int | None = None) -> DataFrame:
    """Top ``k`` documents of every query (query_id, text): query_id, rank, doc_id, score.

    Rows that share an id, or have none, are one query of all their words.
    Queries go in blocks and shards in groups: each work unit is one block with one
    group, and there are as many groups as keep all tasks busy, of ``GROUP_SHARDS`` at most.
    """
    spark = index.sparkSession
    shards = index.where("kind = 0").select("path", "n", "words")
    total, words, files = shards.agg(F.sum("n"), F.sum("words"), F.count("*")).first()
    if not total:
        return spark.createDataFrame([], "query_id long, rank int, doc_id long, score double")
    frequency = index.where("kind = 1").groupBy("term").agg(F.sum("n").alias("df"))
    asked = queries.select(F.coalesce(F.col("query_id").cast("long"), F.lit(_NO_ID)).alias("query_id"), "text")
    terms = asked.mapInArrow(_query_terms, "query_id long, term long").distinct()
    idf = F.log(1 + (F.lit(total) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    wanted = terms.join(frequency, "term").select("query_id", F.struct("term", idf.alias("idf")).alias("t"))
    # A query's terms are at most the distinct words of its text.
    full = wanted.groupBy("query_id").agg(F.collect_list("t").alias("t")).select("query_id", F.col("t.term").alias("terms"), F.col("t.idf").alias("idf"))
    full = full.repartition(max(1, math.ceil(queries.count() / QUERY_BLOCK)))
    blocks = materialize(full.mapInArrow(_block_writer(fresh_path(spark, "bm25-queries")), "block string"), "bm25-blocks")
    n = max(1, blocks.count())
    groups = max(1, min(files, max(math.ceil((parts or spark.sparkContext.defaultParallelism * 3) / n), math.ceil(files / GROUP_SHARDS))))
    # Shards are files of many thousand documents: one row each.
    grouped = shards.select("path", F.pmod(F.row_number().over(Window.orderBy("path")), F.lit(groups)).alias("g"))
    numbered = blocks.select("block", F.row_number().over(Window.orderBy("block")).alias("b"), F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("g"))
    units = grouped.join(numbered, "g").select("path", "block", (F.col("b") * groups + F.col("g")).alias("u"))
    # Ranges, twice as many as there are units, part all units: by hash, several would meet in one task.
    units = units.repartitionByRange(2 * n * groups, "u").sortWithinPartitions("u", "path")
    found = units.mapInArrow(_searcher(words / total, k), "query_id long, doc_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("doc_id"))
    known = F.when(F.col("query_id") != _NO_ID, F.col("query_id")).alias("query_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(known, "rank", "doc_id", "score")
