"""Token-id files compressed by Re-Pair grammars, with random-access decoding.

Documents are range-sorted by id and encoded where they land.  Each task groups
consecutive documents into shards; in every shard frequent neighbouring id pairs
are replaced by nonterminals, the most frequent first, many pairs to a round (a pair
never crosses a document's end), until no pair occurs ``least`` times.  A shard file
holds the rules, the expansion length of every symbol, the remaining symbols and the
documents' bounds, so any slice of any document decodes without touching its
neighbours.

File layout (little-endian): the magic ``RPG2``, six u64 (documents, symbols,
rules, first nonterminal, tokens, bytes of a symbol), then doc ids (i64; a null id is
the smallest i64), document bounds in tokens (u64) and in symbols (u64), expansion
length of each rule (u32), rules (two symbols each), symbols.  A symbol takes two,
three or four bytes, as the shard's largest one needs.

Null texts are empty; repeated doc ids keep one entry per row (ordered by a hash of
the text, then the text, so that rows of one id or without an id may lie in many
tasks); an empty table gives no shard and no row; very long documents are one entry.
"""

from __future__ import annotations

import struct
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._shared import fresh_path, materialize, ranges, read_file, release, slices, write_file
from ._tokens import encoder, file_of

VOCABULARY = "byte_bpe_50k.json"
NULL_ID = -(2**63)
_HASH = np.uint64(0x9E3779B97F4A7C15)
#: Bits of the slots that first tell rare pairs from others.
_SLOTS = 22


def _pairs(seq: np.ndarray, bounds: np.ndarray, fresh: int, least: int, floor: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(distinct pairs, counts, positions with the place of their pair among them, threshold) of the pairs that may reach the threshold.

    Positions are those inside a document with a symbol of at least ``fresh``.  The
    threshold is an eighth of the last one, ``floor``, or of the highest count, and ``least``
    at least.
    """
    hit = np.ones(len(seq) - 1, bool) if not fresh else (seq[:-1] >= fresh) | (seq[1:] >= fresh)
    ends = bounds[1:-1]
    hit[ends[(ends > 0) & (ends < len(seq))] - 1] = False
    at = np.flatnonzero(hit)
    key = seq[at].astype(np.uint64) << np.uint64(32) | seq[at + 1].astype(np.uint64)
    next_ = least
    if len(at) > 1 << 16:
        # Slot counts bound the pairs' counts: most pairs are told to be rare without being sorted.
        slot = (key * _HASH >> np.uint64(64 - _SLOTS)).astype(np.int32)
        slots = np.bincount(slot, minlength=1 << _SLOTS)
        next_ = max(least, min(int(slots.max()) // 8, floor // 8 if floor else len(at)))
        often = slots[slot] >= next_
        at, key = at[often], key[often]
    # Only the distinct pairs are sorted.
    coded = pa.array(key).dictionary_encode()
    distinct = coded.dictionary.to_numpy()
    order = np.argsort(distinct)
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    place = rank[coded.indices.to_numpy()] if len(key) else np.zeros(0, np.int64)
    return distinct[order], np.bincount(place, minlength=len(order)), np.stack([at, place]), next_


def compress(ids: np.ndarray, bounds: np.ndarray, first: int = 50257, least: int = 16):
    """(rules, symbols, bounds in symbols) of ids in documents ``bounds[i]:bounds[i+1]``.

    A round counts pairs and replaces all of those above a threshold; where two
    chosen pairs overlap the more frequent one is replaced, in a run of one pair
    every other.  The threshold falls from an eighth of the most frequent pair's
    count to ``least``.  From then on only pairs with a symbol of the round before are
    counted, for no other can have become frequent, and once more all at the end.
    """
    if len(ids) and int(ids.max()) >= first:
        raise ValueError(f"an id of {int(ids.max())} does not lie below the first nonterminal, {first}")
    seq, bounds = ids.astype(np.uint32), bounds.astype(np.int64)
    rules: list[np.ndarray] = []
    size, fresh, floor = first, 0, 0
    while len(seq) > 1:
        pairs, counts, (at, place), floor = _pairs(seq, bounds, fresh, least, floor)
        top = int(counts.max()) if len(counts) else 0
        if top < floor:
            if floor == least and not fresh:
                break
            fresh = 0  # all pairs once more, or against a lower threshold
            continue
        # Rank 0 is the most frequent pair.
        order = np.argsort(-counts, kind="stable")
        rank = np.empty(len(pairs), np.int64)
        rank[order] = np.arange(len(pairs))
        chosen = counts[place] >= floor
        at, r = at[chosen], rank[place[chosen]]
        index = np.arange(len(at))
        beside = np.concatenate([[False], at[1:] == at[:-1] + 1])
        same = beside & np.concatenate([[False], r[1:] == r[:-1]])
        start = np.maximum.accumulate(np.where(same, 0, index))
        after = np.concatenate([~beside[1:] | (r[:-1] <= r[1:]), [True]])
        before = ~beside | same | np.concatenate([[True], r[1:] < r[:-1]])
        wins = ((index - start) % 2 == 0) & before & after
        at, r = at[wins], r[wins]
        # Pairs that lost most places to others stay as they are.
        won = np.bincount(r, minlength=len(pairs))
        kept = np.flatnonzero(won >= max(2, least // 4))
        if not len(kept):  # cannot be: the best pair wins at half its places at least
            break
        new = np.full(len(pairs), -1, np.int64)
        new[kept] = np.arange(len(kept))
        at, r = at[new[r] >= 0], new[r[new[r] >= 0]]
        seq[at] = (size + r).astype(np.uint32)
        keep = np.ones(len(seq), bool)
        keep[at + 1] = False
        seq, bounds = seq[keep], bounds - np.searchsorted(at + 1, bounds, "left")
        made = pairs[order[kept]]
        rules.append(np.stack([made >> np.uint64(32), made & np.uint64(0xFFFFFFFF)], 1).astype(np.uint32))
        fresh = size if floor == least else 0
        size += len(kept)
    return (np.concatenate(rules) if rules else np.zeros((0, 2), np.uint32)), seq, bounds


def _narrow(values: np.ndarray, width: int) -> bytes:
    return np.ascontiguousarray(values.astype("<u4").reshape(-1, 1).view(np.uint8)[:, :width]).tobytes()


def _widened(data: bytes, count: int, at: int, width: int) -> np.ndarray:
    out = np.zeros((count, 4), np.uint8)
    out[:, :width] = np.frombuffer(data, np.uint8, count * width, at).reshape(count, width)
    return out.view("<u4").ravel()


def expansion_lengths(rules: np.ndarray, first: int) -> np.ndarray:
    """Ids that each nonterminal stands for; a rule only names earlier symbols."""
    out = np.ones(first + len(rules), np.int64)
    for k, (a, b) in enumerate(rules.tolist()):
        out[first + k] = out[a] + out[b]
    return out


@dataclass
class Shard:
    """One shard file, opened for whole or random-access decoding."""

    doc_ids: np.ndarray
    token_bounds: np.ndarray
    symbol_bounds: np.ndarray
    rules: np.ndarray
    lengths: np.ndarray
    symbols: np.ndarray
    first: int

    @classmethod
    def of(cls, doc_ids: np.ndarray, ids: np.ndarray, bounds: np.ndarray, first: int) -> "Shard":
        rules, symbols, symbol_bounds = compress(ids, bounds, first)
        return cls(doc_ids, bounds, symbol_bounds, rules, expansion_lengths(rules, first), symbols, first)

    def to_bytes(self) -> bytes:
        top = self.first + len(self.rules)
        width = 2 if top <= 1 << 16 else 3 if top <= 1 << 24 else 4
        head = b"RPG2" + struct.pack("<6Q", len(self.doc_ids), len(self.symbols), len(self.rules), self.first, int(self.token_bounds[-1]), width)
        parts = (self.doc_ids.astype("<i8"), self.token_bounds.astype("<u8"), self.symbol_bounds.astype("<u8"), self.lengths[self.first :].astype("<u4"))
        return head + b"".join(p.tobytes() for p in parts) + _narrow(self.rules, width) + _narrow(self.symbols, width)

    @classmethod
    def from_bytes(cls, data: bytes) -> "Shard":
        if data[:4] != b"RPG2":
            raise ValueError("not a Re-Pair shard")
        docs, symbols, rules, first, _, width = struct.unpack_from("<6Q", data, 4)
        at, got = 52, []
        for kind, count in (("<i8", docs), ("<u8", docs + 1), ("<u8", docs + 1), ("<u4", rules)):
            got.append(np.frombuffer(data, kind, count, at))
            at += got[-1].nbytes
        lengths = np.concatenate([np.ones(first, np.int64), got[3].astype(np.int64)])
        own = _widened(data, 2 * rules, at, width).reshape(-1, 2)
        return cls(got[0], got[1].astype(np.int64), got[2].astype(np.int64), own, lengths, _widened(data, symbols, at + 2 * rules * width, width), first)

    def table(self) -> tuple[np.ndarray, np.ndarray]:
        """All rules written out in full, in a row, and where each starts."""
        if not hasattr(self, "_table"):
            size = self.lengths[self.first :]
            starts = np.concatenate([np.arange(self.first), self.first + np.cumsum(size) - size]).astype(np.int64)
            flat = np.empty(self.first + int(size.sum()), np.uint32)
            flat[: self.first] = np.arange(self.first)
            for k, (a, b) in enumerate(self.rules.tolist()):
                at, m, n = starts[self.first + k], self.lengths[a], self.lengths[b]
                flat[at : at + m] = flat[starts[a] : starts[a] + m]
                flat[at + m : at + m + n] = flat[starts[b] : starts[b] + n]
            self._table = flat, starts
        return self._table

    def expand(self, symbols: np.ndarray) -> np.ndarray:
        flat, starts = self.table()
        return flat[ranges(starts[symbols], self.lengths[symbols])]

    def document(self, k: int, low: int = 0, high: int | None = None) -> np.ndarray:
        """Ids ``low:high`` of the k-th document, expanding only the symbols that cover them."""
        symbols = self.symbols[self.symbol_bounds[k] : self.symbol_bounds[k + 1]]
        ends = np.cumsum(self.lengths[symbols])
        total = int(ends[-1]) if len(ends) else 0
        low, high = min(low, total), total if high is None else min(high, total)
        if high <= low:
            return np.zeros(0, np.uint32)
        a, b = np.searchsorted(ends, low, "right"), np.searchsorted(ends, high, "left") + 1
        before = int(ends[a - 1]) if a else 0
        return self.expand(symbols[a:b])[low - before : high - before]


def _writer(path: str, end_id: int, folder: str, shard_tokens: int):
    def write(batches):
        from pyspark import TaskContext

        part, number = TaskContext.get().partitionId(), 0
        tok = encoder(path)
        first = max(tok.tokenizer.get_vocab_size(), end_id + 1)
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def flush():
            nonlocal number
            doc_ids, ids, counts = (np.concatenate(x) for x in zip(*held))
            held.clear()
            bounds = np.concatenate([[0], np.cumsum(counts)])
            uri = write_file(folder, f"part-{part:06d}-{number:05d}", ".rpg", Shard.of(doc_ids, ids, bounds, first).to_bytes())
            number += 1
            return pa.record_batch({"part": [part], "number": [number - 1], "path": [uri], "n_docs": [len(doc_ids)], "n_tokens": [int(bounds[-1])]}, _MANIFEST_ARROW)

        for batch in slices(batches, 1):
            ids, counts = tok.encode_column(batch.column(1))
            out = np.full(len(ids) + len(counts), end_id, np.uint32)
            ends = np.cumsum(counts + 1) - 1
            body = np.ones(len(out), bool)
            body[ends] = False
            out[body] = ids
            held.append((batch.column(0).fill_null(NULL_ID).to_numpy(), out, counts + 1))
            if sum(len(x[1]) for x in held) >= shard_tokens:
                yield flush()
        if held:
            yield flush()
        release()

    return write


_MANIFEST_ARROW = pa.schema([("part", pa.int64()), ("number", pa.int64()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())])
_MANIFEST = "part long, number long, path string, n_docs long, n_tokens long"


def write(docs: DataFrame, vocabulary: str | None = None, end_id: int = 0, shard_tokens: int = 1 << 22, folder: str | None = None) -> DataFrame:
    """Encode ``docs`` (doc_id, text), write shard files in ascending doc_id order, return the manifest.

    The manifest has a row per shard: path, n_docs, n_tokens and ``start``, the
    ids of all shards before it.
    """
    spark = docs.sparkSession
    folder = folder or fresh_path(spark, "tokens")
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("h", F.xxhash64("text")).repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h", "text").select("doc_id", "text")
    shards = materialize(rows.mapInArrow(_writer(file_of(VOCABULARY, vocabulary), end_id, folder, shard_tokens), _MANIFEST), "token-manifest")
    # One row per shard: a few thousand even for very large tables, so one task may sum them up.
    before = Window.orderBy("part", "number").rowsBetween(Window.unboundedPreceding, -1)
    return shards.withColumn("start", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))


def _digests(batches):
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])
    for batch in batches:
        for uri, start in zip(batch.column("path").to_pylist(), batch.column("start").to_pylist()):
            shard = Shard.from_bytes(read_file(uri))
            ids = shard.expand(shard.symbols).astype("<u4")
            b = shard.token_bounds
            raw = memoryview(ids.tobytes())
            crc = [zlib.crc32(raw[4 * low : 4 * high]) for low, high in zip(b[:-1].tolist(), b[1:].tolist())]
            doc_ids = pa.array(shard.doc_ids, mask=shard.doc_ids == NULL_ID)
            yield pa.record_batch([doc_ids, pa.array(start + b[:-1]), pa.array(np.diff(b)), pa.array(crc, pa.int64())], schema=schema)


def read_digests(manifest: DataFrame) -> DataFrame:
    """Decode every shard file: a row per document with its place, size and checksum of ids."""
    n = max(1, manifest.count())
    dealt = manifest.select("path", "start").repartition(n, "path")
    return dealt.mapInArrow(_digests, "doc_id long, start long, n_tokens long, ids_crc32 long")
