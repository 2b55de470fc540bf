"""Cross-entropy difference of two matched n-gram models.

A target and a background model share one vocabulary (every word of their
documents, unless the caller asks for the most frequent ones) and one
interpolation, and differ only in their counts.  The score of a document is its
mean loss per word under the target model less that under the background model:
low values are like the target.

A document that is one of those counted is scored without its own counts (leave one
out), under the background as under the target: it is judged by the others, so
only texts that occur again, whole or in part, are well known to a model.

All counts are exact and cover all documents; nothing of them is held in one
place.  Tasks cut their rows into shards of about ``SHARD`` words, write a shard's
words and its distinct words and bigrams to the shared folder.  Those are added up
by key in parts whose number follows the input, and each shard gets back the counts
of its own keys.  Words travel as hashes of 64 bits; each part compares
the words themselves, and if two share a hash all is counted again with another.

Words outside the vocabulary are one unknown symbol.  Null and wordless texts have
no words and losses of 0.  With no target documents the target model is uniform.
Repeated rows count and are scored each.
"""

from __future__ import annotations

import math
import pickle
from dataclasses import dataclass
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import discard, fresh_path, materialize, read_file, release, slices, write_file
from ._words import WordColumn

MIX = 0.6
SHARD = 4_000_000
#: Words that are scored at once, a document at least.
STEP = 300_000
#: Bytes of text behind one part of the counts.
PART_BYTES = 16_000_000
#: In place of hashes: words outside the vocabulary, the start of a text, and the first half of a single word's key.
UNKNOWN, START, SINGLE = 0, 1, 2


@dataclass
class Models:
    """What both models are counted on, and the vocabulary if it is not every word."""

    background: DataFrame
    target: DataFrame | Column
    words: list[bytes] | None


def _count_words(batches):
    schema = pa.schema([("word", pa.binary()), ("n", pa.int64())])
    held: list[pa.Array] = []
    size = 0

    def flush():
        found = pa.chunked_array(held).value_counts()
        return pa.record_batch([found.field("values"), found.field("counts")], schema=schema)

    for batch in slices(batches, 0):
        # Words of the batch, then of the task's run, are added up here.
        words = WordColumn(batch.column(0)).array()
        held.append(words)
        size += len(words)
        if size > 4_000_000:
            yield flush()
            held, size = [], 0
    if held:
        yield flush()


def train(background: DataFrame, target: DataFrame | Column, vocabulary: int | None = None) -> Models:
    """Both models from documents (text); their counts are made with the scores.

    ``target`` is a table, or the condition on rows of the background that are target too.
    """
    words = None
    if vocabulary is not None:
        counted = background.select("text").mapInArrow(_count_words, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
        words = [bytes(r["word"]) for r in counted.orderBy(F.desc("n"), "word").limit(vocabulary).collect()]
    return Models(background, target, words)


def word_hash(word: bytes, seed: int) -> int:
    return int.from_bytes(blake2b(word, digest_size=8, salt=seed.to_bytes(8, "little")).digest(), "little")


def _packed(values: np.ndarray) -> bytes:
    raw = np.ascontiguousarray(values).tobytes()
    return len(raw).to_bytes(8, "little") + pa.compress(raw, "zstd", asbytes=True)


def _unpacked(data: bytes, kind) -> np.ndarray:
    return np.frombuffer(pa.decompress(data[8:], int.from_bytes(data[:8], "little"), "zstd", asbytes=True), kind)


class Shard:
    """Words of some documents, in order: numbers into ``hashes``, whose last entry is the start of a text."""

    def __init__(self, hashes: np.ndarray, ids: np.ndarray, counts: np.ndarray, parts: int):
        self.counts, size = counts, len(hashes)
        before = np.empty(len(ids), np.int64)
        before[1:] = ids[:-1]
        before[(np.cumsum(counts) - counts)[counts > 0]] = size - 1
        code, self.pair_of, pairs = np.unique(before * size + ids, return_inverse=True, return_counts=True)
        self.before, self.word = code // size, code % size
        self.ids, self.size = ids, size
        single = np.bincount(ids, minlength=size)
        single[-1] = (counts > 0).sum()
        self.n = np.concatenate([single, pairs])
        self.first = np.concatenate([np.full(size, SINGLE, np.uint64), hashes[self.before]])
        self.second = np.concatenate([hashes, hashes[self.word]])
        mixed = (self.first * np.uint64(0x9E3779B97F4A7C15) ^ self.second) * np.uint64(0xD6E8FEB86659FD93)
        part = (mixed >> np.uint64(32)).astype(np.int64) % parts
        self.order = np.argsort(part, kind="stable")
        self.edges = np.searchsorted(part[self.order], np.arange(parts + 1))

    def counted(self, chosen: np.ndarray) -> np.ndarray:
        """Counts of all keys over the ``chosen`` documents."""
        if not chosen.any():
            return np.zeros_like(self.n)
        token = np.repeat(chosen, self.counts)
        single = np.bincount(self.ids[token], minlength=self.size)
        single[-1] = (self.counts[chosen] > 0).sum()
        return np.concatenate([single, np.bincount(self.pair_of[token], minlength=len(self.word))])

    def keys_of(self, part: int) -> np.ndarray:
        return self.order[self.edges[part] : self.edges[part + 1]]


_EMITTED = "part int, shard string, keys string, start long, length long"


def _emit(folder: str, scored: bool, background: bool, parts: int, seed: int, vocabulary):
    """Write the keys of each shard, in slices by part, and if it is ``scored`` its words; rows are doc_id, text, in_target."""
    schema = pa.schema([("part", pa.int32()), ("shard", pa.string()), ("keys", pa.string()), ("start", pa.int64()), ("length", pa.int64())])

    def run(batches):
        known = None if vocabulary is None else set(vocabulary.value)

        def flush():
            words = list(numbers)
            hashes = np.fromiter((UNKNOWN if w == b"" else word_hash(w, seed) for w in words), np.uint64, len(words))
            hashes = np.append(hashes, np.uint64(START))
            every, counts = np.concatenate(ids), np.concatenate(lengths)
            shard = Shard(hashes, every, counts, parts)
            both = (shard.n if background else np.zeros_like(shard.n)), shard.counted(np.concatenate(targets))
            name = None
            if scored:
                docs = pa.chunked_array(keys, pa.int64()).combine_chunks()
                chosen = np.concatenate(targets)
                name = write_file(folder, "words", ".bin", pickle.dumps((docs, counts, chosen, _packed(hashes), _packed(every.astype(np.int32)))))
            data, ends = [], [0]
            for p in range(parts):
                at = shard.keys_of(p)
                if len(at):
                    said = b" ".join(words[k] for k in at[at < len(words)].tolist())
                    n = [_packed(x[at].astype(np.uint32)) for x in both]
                    data.append(pickle.dumps((_packed(shard.first[at]), shard.second[at].tobytes(), *n, said)))
                    ends.append(ends[-1] + len(data[-1]))
            keyed = np.flatnonzero(np.diff(shard.edges)).astype(np.int32)
            file = write_file(folder, "keys", ".bin", b"".join(data))
            ends = np.array(ends)
            yield pa.record_batch([pa.array(keyed), pa.array([name] * len(keyed), pa.string()), pa.array([file] * len(keyed)), pa.array(ends[:-1]), pa.array(np.diff(ends))], schema=schema)

        numbers: dict[bytes, int] = {}
        keys, ids, lengths, targets, size = [], [], [], [], 0
        for batch in slices(batches, 1):
            w = WordColumn(batch.column(1))
            distinct, at = w.numbered()
            if known is not None:
                distinct = [x if x in known else b"" for x in distinct]
            here = np.fromiter((numbers.setdefault(x, len(numbers)) for x in distinct), np.int64, len(distinct))
            keys.append(batch.column(0))
            ids.append(here[at] if len(at) else np.zeros(0, np.int64))
            lengths.append(w.counts.astype(np.int64))
            targets.append(batch.column(2).to_numpy(zero_copy_only=False).astype(bool))
            size += len(at)
            if size > SHARD:
                yield from flush()
                numbers, keys, ids, lengths, targets, size = {}, [], [], [], [], 0
        if keys:
            yield from flush()

    return run


_COUNTED = "shard string, part int, background binary, target binary, distinct long, background_words long, target_words long, clashes long"


def _add_up(table: pa.Table) -> pa.Table:
    """Sums of one part's keys, for each shard in the order of its own keys, and the part's share of the totals."""
    part = table.column("part")[0].as_py()
    shards = table.column("shard").to_pylist()
    places = zip(*(table.column(c).to_pylist() for c in ("keys", "start", "length")))
    firsts, seconds, *counts, words = zip(*(pickle.loads(read_file(*x)) for x in places))
    seconds = [np.frombuffer(x, np.uint64) for x in seconds]
    first, second = np.concatenate([_unpacked(x, np.uint64) for x in firsts]), np.concatenate(seconds)
    here = [np.concatenate([_unpacked(x, np.uint32) for x in side]) for side in counts]
    lengths = np.array([len(x) for x in seconds])

    order = np.lexsort((second, first))
    a, b = first[order], second[order]
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    group = np.empty(len(a), np.int64)
    group[order] = np.cumsum(new) - 1
    background, target = (np.bincount(group, n).astype(np.int64) for n in here)

    key = b[new]
    word = (a[new] == SINGLE) & (key != START)
    in_use = word & (key != UNKNOWN) & (background + target > 0)
    clashes, said = 0, {}
    ends = np.cumsum(lengths)
    for k, text in enumerate(words):
        own = slice(ends[k] - lengths[k], ends[k])
        single = second[own][(first[own] == SINGLE) & (second[own] != START) & (second[own] != UNKNOWN)]
        # Only the unknown symbol, of hash 0, has no bytes.
        for h, x in zip(single.tolist(), text.split(), strict=True):
            clashes += said.setdefault(h, x) != x
    rows = [(None, part, None, None, int(in_use.sum()), int(background[word].sum()), int(target[word].sum()), clashes)]
    for k, shard in enumerate(shards):
        if shard is not None:
            mine = group[ends[k] - lengths[k] : ends[k]]
            rows.append((shard, part, _packed(background[mine]), _packed(target[mine]), 0, 0, 0, 0))
    types = (pa.string(), pa.int32(), pa.binary(), pa.binary(), *[pa.int64()] * 4)
    names = [c.split()[0] for c in _COUNTED.split(", ")]
    return pa.table([pa.array(list(v), t) for v, t in zip(zip(*rows), types)], names=names)


def losses(single: np.ndarray, history: np.ndarray, pair: np.ndarray, total: np.ndarray, size: int) -> np.ndarray:
    """Loss in nats of words by their own count, that of the word before and that of both: bigram and unigram chances, mixed."""
    alone = (single + 1) / (total + size)
    chance = np.where(history > 0, MIX * pair / np.maximum(history, 1) + (1 - MIX) * alone, alone)
    return -np.log(chance)


_SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("target_loss", pa.float64()), ("background_loss", pa.float64()), ("difference", pa.float64())])


def _occurrences(of: np.ndarray, what: np.ndarray) -> np.ndarray:
    """How often each token's ``what`` occurs in its document."""
    _, at, counts = np.unique(of * (int(what.max()) + 1) + what, return_inverse=True, return_counts=True)
    return counts[at]


def _score(parts: int, size: int, totals: dict[str, int], leave_out: bool):
    def run(table: pa.Table) -> pa.Table:
        docs, counts, chosen, hashes, ids = pickle.loads(read_file(table.column("shard")[0].as_py()))
        hashes, ids = _unpacked(hashes, np.uint64), _unpacked(ids, np.int32).astype(np.int64)
        shard = Shard(hashes, ids, counts, parts)
        known = {}
        for model in ("target", "background"):
            known[model] = n = np.zeros(len(shard.n), np.int64)
            for p, data in zip(table.column("part").to_pylist(), table.column(model).to_pylist()):
                n[shard.keys_of(p)] = _unpacked(data, np.int64)
        ends = np.cumsum(counts)
        means = {model: np.zeros(len(counts)) for model in known}
        low = 0
        while low < len(counts):
            start = int(ends[low] - counts[low])
            high = max(low + 1, int(np.searchsorted(ends, start + STEP, "right")))
            some, stop = slice(low, high), int(ends[high - 1])
            low = high
            if stop == start:
                continue
            pair, sizes = shard.pair_of[start:stop], counts[some]
            of = np.repeat(np.arange(len(sizes)), sizes)
            own_word, own_pair = _occurrences(of, shard.word[pair]), _occurrences(of, pair)
            first = (ends[some] - sizes - start)[sizes > 0]
            own_history = np.concatenate([[1], own_word[:-1]])
            own_history[first] = 1
            for model, n in known.items():
                # The document's own counts, where it is one of the model's.
                own = (np.ones(len(sizes), bool) if model == "background" else chosen[some]) & leave_out
                take, total = own[of], totals[model] - np.where(own, sizes, 0)
                each = losses(n[shard.word[pair]] - own_word * take, n[shard.before[pair]] - own_history * take, n[len(hashes) + pair] - own_pair * take, total[of], size)
                means[model][some] = np.bincount(of, each, len(sizes)) / np.maximum(sizes, 1)
        target, background = means["target"], means["background"]
        release()
        return pa.table([docs, pa.array(counts), pa.array(target), pa.array(background), pa.array(target - background)], schema=_SCHEMA)

    return run


def score(docs: DataFrame, models: Models) -> DataFrame:
    """Per document: words, mean loss under each model and their difference.

    The background itself, given as the same DataFrame, is read once for both.
    """
    spark = docs.sparkSession
    same = docs is models.background
    # (documents, are they scored, are they background, are they target)
    if isinstance(models.target, DataFrame):
        flag, sides = F.lit(False), [(models.target, False, False, F.lit(True))]
    else:
        flag, sides = F.coalesce(models.target, F.lit(False)), []
    sides += [(docs, True, True, flag)] if same else [(models.background, False, True, flag), (docs, True, False, F.lit(False))]
    size = sum(d.agg(F.sum(F.octet_length("text"))).first()[0] or 0 for d, *_ in sides)
    parts = max(32, math.ceil(size / PART_BYTES))
    vocabulary = None if models.words is None else spark.sparkContext.broadcast(models.words)
    for seed in range(8):
        folder = fresh_path(spark, "shards")
        emitted = None
        for d, scored, background, chosen in sides:
            key = F.col("doc_id") if scored else F.lit(None)
            one = d.select(key.cast("long").alias("doc_id"), "text", chosen.alias("in_target")).mapInArrow(_emit(folder, scored, background, parts, seed, vocabulary), _EMITTED)
            emitted = one if emitted is None else emitted.unionByName(one)
        # Written, so that the shards named in it are those of tasks that Spark committed.
        emitted = materialize(emitted, "ngrams")
        counted = materialize(emitted.repartition(parts, "part").groupBy("part").applyInArrow(_add_up, _COUNTED), "counts")
        found = counted.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("distinct", "background_words", "target_words", "clashes"))).first()
        if not found["clashes"]:
            break
    else:
        raise RuntimeError("words share hashes under every seed")
    totals = {"target": found["target_words"], "background": found["background_words"]}
    back = counted.where("shard is not null").select("shard", "part", "background", "target").repartition(parts, "shard")
    return back.groupBy("shard").applyInArrow(_score(parts, found["distinct"] + 1, totals, same), "doc_id long, n_words long, target_loss double, background_loss double, difference double")


#: Up to so many ids of good documents go to all tasks; a long each.
BROADCAST_IDS = 8_000_000


def with_target(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """All documents, with ``in_target`` for those labelled good.

    The ids of the good ones are broadcast where their number has been counted as at
    most ``BROADCAST_IDS``; more are joined by a shuffle.
    """
    good = labels.where("quality = 1").select("doc_id").distinct().withColumn("in_target", F.lit(True))
    few = good.count() <= BROADCAST_IDS
    return docs.select("doc_id", "text").join(F.broadcast(good) if few else good, "doc_id", "left")
