"""Exact Jaccard self-join of word n-gram sets by PartEnum signatures, and its components.

Sets of sizes in one band (and those just below it that may still be similar to
one in it) share a Hamming bound ``k``: similar sets differ in at most ``k``
shingles.  The shingle domain is dealt by hash to first-level partitions of three
second-level ones each.  Of ``k // 2 + 1`` first-level partitions one at least holds
one difference or none, so two of its three second-level partitions are the same
in both sets: the three subsets of two are enumerated, and a subset's content is
a signature.  For each set ``k`` is the bound for its own size and the largest
partner it can have, and first-level partitions in which fewer than two second-
level ones are filled do not count.

Shingles that very many documents share would make signatures common.  They are
found over all documents (each task counts its own, the counts are summed) and
dealt to no partition.  A set that has too few usable partitions left emits the
signatures of all its shingles too, and if even those are too few (very small
sets), subsets of one shingle each.

Candidates are never all pairs of a group.  Equal sets are one node, and signatures
shared by the same nodes one bucket.  First each node meets the four first nodes of
its buckets; the nearest that its parity sketch does not rule out is verified on the
sets, and components are built.  Only in buckets that still span several components
do nodes of different ones meet, in tiles of bounded size: first the nearest pair of
each two components, at last, where that pair was not similar, the others that the
sketches do not rule out.  All links are verified on the sets of 64-bit shingle hashes.

Documents without words have no shingles and link with nothing; those of fewer
than five words have one; null texts are empty.  Repeated ids are a document per
row; a row without an id links as any other, takes its component's smallest id
and has none where the component has none.
"""

from __future__ import annotations

import itertools
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.components import connected_components, joined_components
from ._shared import discard, materialize, ranges, release, slices
from ._words import WordColumn

N = 5
SKETCH_BITS = 512
_M = np.uint64(0x9E3779B97F4A7C15)
_ROOT = np.uint64(0xD6E8FEB86659FD93)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _M
    return x ^ (x >> np.uint64(29))


def shingle_sets(texts: pa.Array, n: int = N) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    import xxhash

    column = WordColumn(texts, keep_punctuation=True)
    vocabulary, numbers = column.numbered()
    words = np.fromiter(map(xxhash.xxh3_64_intdigest, vocabulary), np.uint64, len(vocabulary))[numbers]
    count = max(0, len(words) - n + 1)
    rolled = np.full(count, _ROOT, np.uint64)
    for k in range(n):
        rolled = mix(rolled ^ words[k : k + count])
    out = []
    for low, high in zip(column.edges[:-1].tolist(), column.edges[1:].tolist()):
        if high - low >= n:
            out.append(np.unique(rolled[low : high - n + 1]))
        elif high > low:
            one = np.full(1, _ROOT + np.uint64(high - low), np.uint64)
            for w in words[low:high]:
                one = mix(one ^ w)
            out.append(one)
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def node_of(shingles: np.ndarray) -> int:
    """64-bit number of a set."""
    import xxhash

    return xxhash.xxh3_64_intdigest(shingles.tobytes()) - 2**63


@dataclass(frozen=True)
class Bands:
    """Size bands for a similarity of ``num / den``."""

    num: int = 80
    den: int = 100

    def bounds(self, most: int = 1 << 34) -> list[tuple[int, int]]:
        """(smallest, largest) size of each band; each spans about 1 / similarity squared."""
        out, low = [], 1
        while low < most:
            high = max(low, low * self.den**2 // self.num**2)
            out.append((low, high))
            low = high + 1
        return out

    def allowed(self, both: int) -> int:
        """The most shingles in which similar sets of ``both`` shingles together differ."""
        return both * (self.den - self.num) // (self.den + self.num)


@dataclass(frozen=True)
class Widespread:
    """Hashes of widespread shingles in ascending order, and the rank of each by its count."""

    hashes: np.ndarray
    ranks: np.ndarray

    def find(self, shingles: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(is it widespread, where in ``hashes``) of each shingle."""
        if not len(self.hashes):
            return np.zeros(len(shingles), bool), np.zeros(len(shingles), np.int64)
        at = np.minimum(np.searchsorted(self.hashes, shingles), len(self.hashes) - 1)
        return self.hashes[at] == shingles, at


#: Second-level partitions of a first-level one, and how many of them a signature leaves out.
SECOND, LEFT_OUT = 3, 1
_SUBSETS = list(itertools.combinations(range(SECOND), SECOND - LEFT_OUT))


@dataclass
class Tags:
    """The (set, band) combinations of some sets: what each must be enumerated for."""

    owner: np.ndarray
    band: np.ndarray
    bound: np.ndarray
    firsts: np.ndarray

    @classmethod
    def of(cls, sizes: np.ndarray, bands: Bands, bounds: list[tuple[int, int]]) -> "Tags":
        found = []
        for band, (low, high) in enumerate(bounds):
            own = np.flatnonzero((bands.num * low <= bands.den * sizes) & (sizes <= high) & (sizes > 0))
            if not len(own):
                continue
            # Partners are at most ``high`` and size / similarity large; the number of partitions is the band's.
            bound = bands.allowed(sizes[own] + np.minimum(high, sizes[own] * bands.den // bands.num))
            own, bound = own[bound > 0], bound[bound > 0]  # sets that may differ in nothing are equal, and so one node
            least = bands.allowed(2 * high) // (LEFT_OUT + 1) + 1
            found.append((own, np.full(len(own), band), bound, np.full(len(own), least + least // 8 + 1)))
        return cls(*(np.concatenate(x).astype(np.int64) if found else np.zeros(0, np.int64) for x in (zip(*found) if found else ((),) * 4)))

    @property
    def needed(self) -> np.ndarray:
        """Of so many first-level partitions one at least holds no more than ``LEFT_OUT`` differences."""
        return self.bound // (LEFT_OUT + 1) + 1

    def only(self, chosen: np.ndarray) -> "Tags":
        return Tags(self.owner[chosen], self.band[chosen], self.bound[chosen], self.firsts[chosen])


def enumerated(shingles: np.ndarray, sizes: np.ndarray, tags: Tags, kind: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(signatures, tag of each, usable first-level partitions of each tag) of sets in a row.

    A signature is the content of two of the three second-level partitions of one
    first-level partition.  A partition with two that are not empty is usable; a
    tag emits every content that is not empty up to its last needed usable one.
    """
    starts = np.cumsum(sizes) - sizes
    length = sizes[tags.owner]
    element = shingles[ranges(starts[tags.owner], length)]
    tag = np.repeat(np.arange(len(length)), length)
    base = np.cumsum(tags.firsts) - tags.firsts
    total = int(tags.firsts.sum())
    place = mix(element + tags.band[tag].astype(np.uint64) * np.uint64(2) + np.uint64(kind))
    cell = (base[tag] + (place % tags.firsts[tag].astype(np.uint64)).astype(np.int64)) * SECOND + ((place >> np.uint64(40)) % np.uint64(SECOND)).astype(np.int64)
    content = np.zeros(total * SECOND, np.uint64)
    np.add.at(content, cell, mix(element ^ _ROOT))
    filled = (np.bincount(cell, minlength=total * SECOND) > 0).reshape(total, SECOND)
    content = content.reshape(total, SECOND)
    usable = filled.sum(1) > LEFT_OUT
    owner = np.repeat(np.arange(len(length)), tags.firsts)
    running = np.concatenate([[0], np.cumsum(usable)])
    before = running[:-1] - running[base][owner]
    wanted = before < tags.needed[owner]
    position = np.arange(total) - base[owner]
    sigs, of = [], []
    for number, subset in enumerate(_SUBSETS):
        at = np.flatnonzero(wanted & filled[:, list(subset)].any(1))
        where = (position[at] * 16 + number * 2 + kind).astype(np.uint64) + (tags.band[owner[at]].astype(np.uint64) << np.uint64(48))
        joint = mix(where)
        for column in subset:
            joint = mix(joint ^ mix(content[at, column] + np.uint64(column + 1)))
        sigs.append(joint)
        of.append(owner[at])
    counts = running[base + tags.firsts] - running[base] if len(base) else np.zeros(0, np.int64)
    return np.concatenate(sigs), np.concatenate(of), counts


def signatures(sets: list[np.ndarray], common: Widespread, bands: Bands, bounds: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """All signatures of some sets, and the number of the set that each belongs to."""
    sizes = np.array([len(s) for s in sets], np.int64)
    tags = Tags.of(sizes, bands, bounds)
    if not len(tags.owner):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    every = np.concatenate(sets)
    known, at = common.find(every)
    rare_sizes = np.bincount(np.repeat(np.arange(len(sets)), sizes)[~known], minlength=len(sets))
    sig, of, usable = enumerated(every[~known], rare_sizes, tags, 0)
    out = [(sig, tags.owner[of])]
    short = tags.only(np.flatnonzero(usable < tags.needed))
    if len(short.owner):
        # Too few usable partitions without the widespread shingles: once more with all of them.
        sig, of, usable = enumerated(every, sizes, short, 1)
        out.append((sig, short.owner[of]))
        starts = np.cumsum(sizes) - sizes
        for tag in np.flatnonzero(usable < short.needed).tolist():
            # Too few in any case: subsets of one shingle each, as many as make one of them shared.
            owner, bound = int(short.owner[tag]), int(short.bound[tag])
            own = slice(starts[owner], starts[owner] + sizes[owner])
            often = every[own][known[own]][np.argsort(common.ranks[at[own][known[own]]], kind="stable")] if len(common.ranks) else every[:0]
            least = len(sets[owner]) - -(-len(sets[owner]) * bands.num // bands.den) + 1
            ranked = np.concatenate([every[own][~known[own]], often])[: min(bound + 1, least)]
            out.append((mix(ranked ^ np.uint64((int(short.band[tag]) << 40) + 1)), np.full(len(ranked), owner)))
    return np.concatenate([x for x, _ in out]), np.concatenate([x for _, x in out])


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


_DOC = pa.schema([("kind", pa.int32()), ("id", pa.int64()), ("n", pa.int64()), ("node", pa.int64()), ("sketch", pa.binary())])
_DOC_SQL = "kind int, id long, n long, node long, sketch binary"
#: Nodes that a task remembers, and shingles that it counts at once.
_REMEMBERED, _COUNTED = 200_000, 2_000_000


def _profile(least: int, n: int):
    """Rows of documents (kind 0: doc id, set size, node, sketch) and of widespread shingles (kind 1: hash, count in this task)."""

    def run(batches):
        seen: set[int] = set()
        held: list[np.ndarray] = []
        size = 0

        def widespread():
            values, counts = np.unique(np.concatenate(held), return_counts=True)
            often = counts >= least
            k = int(often.sum())
            return pa.record_batch([pa.array(np.ones(k, np.int32)), pa.array(_signed(values[often])), pa.array(counts[often].astype(np.int64)), pa.array(np.zeros(k, np.int64)), pa.nulls(k, pa.binary())], schema=_DOC)

        for batch in slices(batches, 1):
            sets = shingle_sets(batch.column(1), n)
            nodes = [node_of(s) for s in sets]
            for s, node in zip(sets, nodes):
                if node not in seen and len(s):
                    held.append(s)
                    size += len(s)
            seen.update(nodes)
            if len(seen) > _REMEMBERED:
                seen.clear()
            columns = [np.zeros(len(sets), np.int32), batch.column(0), [len(s) for s in sets], nodes, [sketch_of(s) for s in sets]]
            yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, _DOC.types)], schema=_DOC)
            if size > _COUNTED:
                yield widespread()
                held, size = [], 0
        if held:
            yield widespread()
        release()

    return run


def _emit(shared, bands: Bands, n: int):
    schema = pa.schema([("sig", pa.int64()), ("node", pa.int64())])

    def run(batches):
        common, bounds = shared.value, bands.bounds()
        seen: set[int] = set()
        for batch in slices(batches, 0, 1_000_000):
            sets, nodes = [], []
            for s in shingle_sets(batch.column(0), n):
                node = node_of(s)
                if len(s) and node not in seen:
                    seen.add(node)
                    sets.append(s)
                    nodes.append(node)
            if len(seen) > _REMEMBERED:
                seen.clear()
            if sets:
                sig, of = signatures(sets, common, bands, bounds)
                if len(sig):
                    yield pa.record_batch([pa.array(_signed(sig)), pa.array(np.array(nodes, np.int64)[of])], schema=schema)
        release()

    return run


_OPEN = 65_536


def _buckets(batches):
    """Rows (bucket, node) of the signatures that several nodes share, from rows sorted by (sig, node).

    Signatures shared by the very same nodes are one bucket, named by those nodes;
    one of more than ``_OPEN`` nodes keeps the name of its signature and streams by.
    """
    schema = pa.schema([("bucket", pa.int64()), ("node", pa.int64())])
    sig, node = np.zeros(0, np.int64), np.zeros(0, np.int64)
    streamed: int | None = None

    def rows(bucket, nodes):
        return pa.record_batch([pa.array(bucket), pa.array(nodes)], schema=schema)

    for batch in itertools.chain(batches, [None]):
        if batch is not None:
            if not batch.num_rows:
                continue
            sig, node = np.concatenate([sig, batch.column(0).to_numpy()]), np.concatenate([node, batch.column(1).to_numpy()])
        if not len(sig):
            continue
        fresh = np.concatenate([[True], (sig[1:] != sig[:-1]) | (node[1:] != node[:-1])])
        sig, node = sig[fresh], node[fresh]
        starts = np.flatnonzero(np.concatenate([[True], sig[1:] != sig[:-1]]))
        sizes = np.diff(np.append(starts, len(sig)))
        done = len(starts) if batch is None else len(starts) - 1
        if streamed is not None and sig[0] == streamed:
            # More of a bucket that is too large to be held; the latest node stays, to tell repetitions.
            upto = sizes[0] if done else sizes[0] - 1
            if upto > 1 or (upto and done):
                yield rows(np.full(upto, streamed), node[:upto])
            if not done:
                sig, node = sig[upto:], node[upto:]
                continue
            starts, sizes, done = starts[1:], sizes[1:], done - 1
            streamed = None
            if not len(starts):
                sig, node = sig[:0], node[:0]
                continue
        keep = np.flatnonzero(sizes[:done] > 1)
        if len(keep):
            name = np.add.reduceat(mix(node.view(np.uint64)), starts)[keep] ^ mix(sizes[keep].astype(np.uint64))
            name, first = np.unique(mix(name), return_index=True)
            keep = keep[first]
            yield rows(np.repeat(_signed(name), sizes[keep]), node[ranges(starts[keep], sizes[keep])])
        low = starts[done] if done < len(starts) else len(sig)
        sig, node = sig[low:], node[low:]
        if len(sig) > _OPEN:
            streamed = int(sig[0])
            yield rows(sig[:-1], node[:-1])
            sig, node = sig[-1:], node[-1:]
    release()


def sketch_of(shingles: np.ndarray) -> bytes:
    """Parities of the shingle counts of cells, at least as many cells as shingles.

    Two sketches, folded to the length of the shorter, differ in no more bits than
    the sets in shingles.
    """
    bits = max(SKETCH_BITS, 1 << max(0, len(shingles) - 1).bit_length())
    counts = np.bincount(((shingles >> np.uint64(17)) & np.uint64(bits - 1)).astype(np.int64), minlength=bits)
    return np.packbits(counts & 1, bitorder="little").tobytes()


class Sketches:
    """Sketches of several lengths: a longer one is folded to the length of the other."""

    def __init__(self, sketches: list[bytes]):
        self.lengths = np.array([len(s) for s in sketches], np.int64)
        #: By length: the sketches of at least that length, folded to it, and the place of each among them.
        self.at: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        rows, table = np.zeros(0, np.int64), np.zeros((0, 0), np.uint64)
        for size in sorted(set(self.lengths.tolist()), reverse=True):
            while len(rows) and table.shape[1] * 8 > size:
                half = table.shape[1] // 2
                table = table[:, :half] ^ table[:, half:]
            own = np.flatnonzero(self.lengths == size)
            mine = np.frombuffer(b"".join(sketches[k] for k in own.tolist()), np.uint64).reshape(len(own), -1)
            rows, table = np.concatenate([rows, own]), np.concatenate([table, mine]) if len(rows) else mine
            place = np.zeros(len(sketches), np.int64)
            place[rows] = np.arange(len(rows))
            self.at[size] = place, table

    def apart(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Bits in which the sketches x and y differ."""
        out = np.zeros(len(x), np.int64)
        shorter = np.minimum(self.lengths[x], self.lengths[y])
        for size, (place, table) in self.at.items():
            own = np.flatnonzero(shorter == size)
            step = max(1, 8_000_000 // size)
            for low in range(0, len(own), step):
                some = own[low : low + step]
                out[some] = np.bitwise_count(table[place[x[some]]] ^ table[place[y[some]]]).sum(1, dtype=np.int64)
        return out


def likely(bands: Bands, x: np.ndarray, y: np.ndarray, sizes: np.ndarray, sketches: Sketches) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The pairs (x, y) that sizes and sketches do not rule out, and how far apart their sketches are."""
    fits = (sizes[x] * bands.num <= sizes[y] * bands.den) & (sizes[y] * bands.num <= sizes[x] * bands.den)
    x, y = x[fits], y[fits]
    far = sketches.apart(x, y)
    fits = far * (bands.den + bands.num) <= (sizes[x] + sizes[y]) * (bands.den - bands.num)
    return x[fits], y[fits], far[fits]


#: The nodes of a bucket that all others meet first, and the most rows of a bucket in one tile.
CENTRES, TILE = 4, 1_024


def _to_centres(bands: Bands):
    """(a, b, far): each node with the nearest of its bucket's first nodes, from rows sorted by bucket and a hash."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("far", pa.int64())])

    def run(batches):
        carried: pa.Table | None = None  # the first rows of the bucket at the end of the batch before
        for batch in batches:
            for low in range(0, batch.num_rows, 50_000):
                part = batch.slice(low, 50_000)
                old = len(carried) if carried is not None else 0
                table = pa.Table.from_batches([part]) if carried is None else pa.concat_tables([carried, pa.Table.from_batches([part])])
                bucket, node, size = (table.column(c).to_numpy() for c in ("bucket", "node", "n"))
                starts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
                group = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(bucket))))
                rank = np.arange(len(bucket)) - starts[group]
                x = np.concatenate([np.flatnonzero((rank > k) & (np.arange(len(rank)) >= old)) for k in range(CENTRES)])
                y = np.concatenate([starts[group[(rank > k) & (np.arange(len(rank)) >= old)]] + k for k in range(CENTRES)])
                x, y, far = likely(bands, x, y, size, Sketches(table.column("sketch").to_pylist()))
                order = np.lexsort((y, far, x))
                first = order[np.concatenate([[True], x[order][1:] != x[order][:-1]])] if len(order) else order
                if len(first):
                    yield pa.record_batch([pa.array(node[x[first]]), pa.array(node[y[first]]), pa.array(far[first])], schema=schema)
                carried = table.slice(int(starts[-1]), CENTRES)
        release()

    return run


_ACROSS = pa.schema([("ca", pa.int64()), ("cb", pa.int64()), ("far", pa.int64()), ("a", pa.int64()), ("b", pa.int64()), ("more", pa.int32())])


def _across(bands: Bands, every: bool):
    """Likely pairs of nodes of different components, from rows sorted by bucket and tile pair.

    Of two components only the nearest pair of a tile is given, and if there are
    ``more``; ``every`` gives all.
    """

    def pairs(table, starts, sizes):
        node, comp, tile, low, high, n = (table.column(c).to_numpy() for c in ("node", "comp", "tile", "low", "high", "n"))
        rank = ranges(np.zeros(len(sizes), np.int64), sizes)
        begin = np.repeat(starts, sizes)
        x, y = np.repeat(np.arange(len(rank)), rank), ranges(begin, rank)
        fits = (comp[x] != comp[y]) & ((low[x] == high[x]) | (tile[x] != tile[y]))
        x, y, far = likely(bands, x[fits], y[fits], n, Sketches(table.column("sketch").to_pylist()))
        turn = comp[x] > comp[y]
        x, y = np.where(turn, y, x), np.where(turn, x, y)
        ca, cb, a, b = comp[x], comp[y], node[x], node[y]
        more = np.zeros(len(ca), np.int32)
        order = np.lexsort((b, a, far, cb, ca))
        ca, cb, far, a, b = (v[order] for v in (ca, cb, far, a, b))
        if len(ca):
            new = np.concatenate([[True], (ca[1:] != ca[:-1]) | (cb[1:] != cb[:-1]) | (every & ((a[1:] != a[:-1]) | (b[1:] != b[:-1])))])
            head = np.flatnonzero(new)
            last = np.append(head[1:], len(ca)) - 1
            more = ((a[last] != a[head]) | (b[last] != b[head])).astype(np.int32)
            ca, cb, far, a, b = (v[head] for v in (ca, cb, far, a, b))
        return pa.record_batch([pa.array(v) for v in (ca, cb, far, a, b, more)], schema=_ACROSS)

    def run(batches):
        rest: pa.Table | None = None
        for batch in itertools.chain(batches, [None]):
            parts = [] if rest is None else [rest]
            table = pa.concat_tables(parts + ([] if batch is None else [pa.Table.from_batches([batch])])) if parts or batch is not None else None
            if table is None or not len(table):
                continue
            table = table.combine_chunks()
            keys = [table.column(c).to_numpy() for c in ("bucket", "low", "high")]
            new = np.zeros(len(table), bool)
            new[0] = True
            for k in keys:
                new[1:] |= k[1:] != k[:-1]
            starts = np.flatnonzero(new)
            ends = np.append(starts[1:], len(table))
            if batch is not None:
                rest = table.slice(int(starts[-1]))
                starts, ends = starts[:-1], ends[:-1]
            work = np.cumsum((ends - starts) ** 2)
            at = 0
            while at < len(starts):  # groups of about a million pairs at a time, one group at least
                upto = max(at + 1, int(np.searchsorted(work, (work[at - 1] if at else 0) + 2_000_000, "right")))
                low, high = int(starts[at]), int(ends[upto - 1])
                found = pairs(table.slice(low, high - low), starts[at:upto] - low, ends[at:upto] - starts[at:upto])
                if found.num_rows:
                    yield found
                at = upto
        release()

    return run


_SET = pa.schema([("doc_id", pa.int64()), ("node", pa.int64()), ("shingles", pa.binary())])


def _slot(ids: np.ndarray, bits: int) -> np.ndarray:
    return (mix(ids.astype(np.int64).view(np.uint64)) % np.uint64(bits)).astype(np.int64)


def _marks(bits: int):
    def run(batches):
        seen = np.zeros(bits, bool)
        for batch in batches:
            seen[_slot(batch.column(0).to_numpy(), bits)] = True
        yield pa.record_batch([[np.packbits(seen).tobytes()]], names=["bits"])

    return run


def marks(ids: DataFrame, most_bits: int = 1 << 27):
    """A broadcast bit map of ids (not null), of 16 bits an id and 16 MB at most: it only spares rows a join, which decides."""
    bits = min(most_bits, max(1 << 16, 1 << (16 * ids.count()).bit_length()))
    total = np.zeros(bits // 8, np.uint8)
    for row in ids.coalesce(8).mapInArrow(_marks(bits), "bits binary").toLocalIterator():
        total |= np.frombuffer(row["bits"], np.uint8)
    return ids.sparkSession.sparkContext.broadcast((bits, total))


def _sets(shared, n: int):
    """(doc_id, node, shingles) of the rows whose id is marked or null; a task gives one set of rows without an id once."""

    def run(batches):
        bits, packed = shared.value
        nameless: set[int] = set()
        for batch in slices(batches, 1):
            at = _slot(batch.column(0).fill_null(0).to_numpy(), bits)
            wanted = (packed[at >> 3] >> (7 - (at & 7)) & 1).astype(bool) | np.asarray(batch.column(0).is_null())
            batch = batch.filter(pa.array(wanted))
            if batch.num_rows:
                sets = shingle_sets(batch.column(1), n)
                nodes, fresh = [node_of(s) for s in sets], []
                for k, i in enumerate(batch.column(0).to_pylist()):
                    if i is not None or nodes[k] not in nameless:
                        fresh.append(k)
                    if i is None and len(nameless) < _REMEMBERED:
                        nameless.add(nodes[k])
                columns = [batch.column(0).take(pa.array(fresh, pa.int64())), [nodes[k] for k in fresh], [sets[k].tobytes() for k in fresh]]
                yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, _SET.types)], schema=_SET)
        release()

    return run


def _verify(bands: Bands):
    def run(batches):
        # A few sets at a time are Python objects; they may be long.
        for batch in slices(batches, 2, 4_000_000):
            keep = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                a, b = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                if len(a) > len(b):
                    a, b = b, a
                at = np.searchsorted(b, a)
                same = int((b[np.minimum(at, len(b) - 1)] == a).sum())
                keep.append(bands.den * same >= bands.num * (len(a) + len(b) - same))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return run


#: Rows of ids up to which a table, once counted, goes to all tasks; more are joined by a shuffle.
_FEW = 1_000_000


def verified(pairs: DataFrame, sets: DataFrame, bands: Bands, heavy: int = 500) -> DataFrame:
    """The pairs (a, b) of a written table that are similar.

    Few pairs are broadcast, so that of the sets only those in a pair are shuffled.
    A node with more than ``heavy`` partners is copied to several tasks.
    """
    small = F.broadcast if pairs.count() <= _FEW else lambda df: df
    loads = pairs.groupBy("b").agg(F.ceil(F.count("*") / heavy).cast("int").alias("parts"))
    salted = pairs.join(loads, "b").withColumn("salt", F.pmod(F.xxhash64("a"), F.col("parts")).cast("int"))
    one = sets.withColumnRenamed("node", "a").join(small(salted), "a")
    other = sets.select(F.col("node").alias("b"), F.col("shingles").alias("other")).join(small(loads), "b")
    dealt = other.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    both = one.join(dealt.hint("shuffle_merge"), ["b", "salt"])
    return both.select("a", "b", "shingles", "other").mapInArrow(_verify(bands), "a long, b long")


def _tiled(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows of the buckets that span several components, dealt by bucket and pair of tiles.

    A bucket of more than ``TILE`` rows is split by hash into tiles, and each pair
    of tiles is a unit of its own.
    """
    named = rows.join(labels.withColumnRenamed("component", "comp"), "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    mixed = named.groupBy("bucket").agg(F.min("comp").alias("one"), F.max("comp").alias("other"), F.ceil(F.count("*") / TILE).cast("int").alias("tiles")).where("one < other")
    left = named.join(mixed.select("bucket", "tiles"), "bucket").withColumn("tile", F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int"))
    met = left.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    keyed = met.select("bucket", F.least("tile", "with").alias("low"), F.greatest("tile", "with").alias("high"), "tile", "node", "comp", "n", "sketch")
    return keyed.repartition("bucket", "low", "high").sortWithinPartitions("bucket", "low", "high")


def join_components(docs: DataFrame, similarity: tuple[int, int] = (80, 100), n: int = N, common_least: int = 8, common_most: int = 200_000) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id (smallest doc id linked), its set's node and component (a node).

    ``common_least`` is the count within one task's run of texts from which a
    shingle is widespread; at most ``common_most`` of them are set aside (they
    only change how many candidates there are, never the result).
    """
    spark, bands = docs.sparkSession, Bands(*similarity)
    profile = materialize(docs.select("doc_id", "text").mapInArrow(_profile(common_least, n), _DOC_SQL), "profile")
    members = profile.where("kind = 0").select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), "node")
    top = profile.where("kind = 1").groupBy("id").agg(F.sum("n").alias("c")).orderBy(F.desc("c"), "id").limit(common_most)
    found = np.array([r["id"] for r in top.orderBy("c", "id").select("id").collect()], np.int64).view(np.uint64)
    order = np.argsort(found)
    shared = spark.sparkContext.broadcast(Widespread(found[order], order))
    sigs = docs.select("text").mapInArrow(_emit(shared, bands, n), "sig long, node long")
    dealt = sigs.repartition("sig").sortWithinPartitions("sig", "node")
    buckets = materialize(dealt.mapInArrow(_buckets, "bucket long, node long"), "buckets")
    shared.unpersist()

    sketched = profile.where("kind = 0").select("node", "n", "sketch").dropDuplicates(["node"])
    rows = materialize(buckets.distinct().join(sketched, "node"), "bucket-rows")
    discard(buckets)
    needed = rows.select("node").distinct()
    # Of equal sets the row of the smallest id stands for all; a null is it only where there is no other.
    where = materialize(members.join(needed, "node", "left_semi").groupBy("node").agg(F.min("doc_id").alias("doc_id")), "needed")
    chosen = marks(where.where("doc_id is not null").select("doc_id"))
    made = docs.select("doc_id", "text").mapInArrow(_sets(chosen, n), "doc_id long, node long, shingles binary")
    nodes = where.count()
    least = where.withColumnRenamed("doc_id", "least")
    here = made.join(F.broadcast(least) if nodes <= _FEW else least, "node").where(F.col("doc_id").eqNullSafe(F.col("least")))
    sets = materialize(here.select("node", "shingles"), "sets")
    if sets.count() > nodes:  # rows of one id and text, or of one text without an id
        again, sets = sets, materialize(sets.dropDuplicates(["node"]), "sets")
        discard(again)
    chosen.unpersist()

    order = [F.col("bucket"), F.xxhash64("node"), F.col("node")]
    near = rows.repartition("bucket").sortWithinPartitions(*order).mapInArrow(_to_centres(bands), "a long, b long, far long")
    first = materialize(near.groupBy("a").agg(F.min(F.struct("far", "b")).alias("m")).select("a", "m.b"), "pairs")
    edges = materialize(verified(first, sets, bands), "edges")
    # A written table: each plan that reads labels holds a scan and not all that led to them.
    labels = materialize(connected_components(edges, "a", "b"), "labels")
    for every in (False, True):
        met = _tiled(rows, labels).mapInArrow(_across(bands, every), "ca long, cb long, far long, a long, b long, more int")
        one = F.struct("far", "a", "b")
        if every:
            pairs = met.select("a", "b", F.lit(0).alias("more")).distinct()
        else:
            best = met.groupBy("ca", "cb").agg(F.min(one).alias("m"), F.max(one).alias("w"), F.max("more").alias("more"))
            pairs = best.select("m.a", "m.b", F.when(F.col("m") != F.col("w"), 1).otherwise(F.col("more")).alias("more"))
        pairs = materialize(pairs, "pairs")
        links = materialize(verified(pairs.select("a", "b"), sets, bands), "edges")
        if not links.isEmpty():
            last, labels = labels, joined_components(labels, links, "a", "b", _FEW)
            discard(last)
        if pairs.where("more > 0").isEmpty():
            break
    grouped = members.where("n_shingles > 0").groupBy("node").agg(F.min("doc_id").alias("least"))
    named = grouped.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    classes = materialize(named.join(least, "component").select("node", "component", "component_id"), "classes")
    discard(rows, sets, where)
    out = members.join(classes, "node", "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"), "node", "component")


def _nodes(n: int, at: int, name: str):
    """The rows with the node of their text behind them."""

    def run(batches):
        for batch in slices(batches, at):
            nodes = pa.array([node_of(s) for s in shingle_sets(batch.column(at), n)], pa.int64())
            yield pa.record_batch([*batch.columns, nodes], names=[*batch.schema.names, name])

    return run


def keep_one(docs: DataFrame) -> DataFrame:
    """One document of each component (that of the smallest id) and all without shingles, with all their columns.

    Of rows that share that id, and in components without any id, the first by all
    columns in turn stays.
    """
    found = join_components(docs)
    alone = found.groupBy("doc_id").agg(F.count("*").alias("rows")).where("doc_id is not null and rows = 1").select("doc_id")
    best = found.where("doc_id = component_id").select("doc_id").join(alone, "doc_id", "left_semi")
    kept = docs.join(best, "doc_id", "left_semi").select(*docs.columns)
    # Rows without an id of their own: told apart by their sets.
    # Names that no column of the documents has.
    mark = "_"
    while any(c.startswith(mark) for c in docs.columns):
        mark += "_"
    own, node, component, least, size, of, place = (f"{mark}{c}" for c in ("id", "node", "component", "least", "n", "node_of", "turn"))
    names = {"doc_id": own, "node": node, "component": component, "component_id": least, "n_shingles": size}
    odd = found.join(alone, "doc_id", "left_anti").select(*(F.col(c).alias(x) for c, x in names.items())).distinct()
    some = odd.count()
    if not some:
        return kept
    ids = odd.select(own).distinct()
    ids = F.broadcast(ids) if some < 1_000_000 else ids
    rows = docs.join(ids, F.col("doc_id").eqNullSafe(F.col(own)), "left_semi").select(*docs.columns)
    keyed = rows.mapInArrow(_nodes(N, docs.columns.index("text"), of), T.StructType([*docs.schema.fields, T.StructField(of, T.LongType())]))
    named = keyed.join(odd, (F.col(of) == F.col(node)) & F.col("doc_id").eqNullSafe(F.col(own))).where(F.col("doc_id").eqNullSafe(F.col(least)) | (F.col(size) == 0))
    # Maps have no order of their own; their text has.
    keys = [F.to_json(F.struct(c.name)) if isinstance(c.dataType, T.MapType) else F.col(c.name) for c in docs.schema.fields]
    firsts = named.where(F.col(size) > 0).withColumn(place, F.row_number().over(Window.partitionBy(component).orderBy(*keys))).where(F.col(place) == 1)
    return kept.unionByName(firsts.select(*docs.columns)).unionByName(named.where(F.col(size) == 0).select(*docs.columns))
