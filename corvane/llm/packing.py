"""Best-fit packing of token sequences, in bulk-synchronous rounds.

Encoding cuts documents into pieces of at most ``capacity`` ids, the items to pack.
Those over half the capacity open a sequence each.  Then rounds follow.  Each
range-sorts all gaps and unplaced items by size (descending, a hash breaking ties,
so one common size spreads over many tasks) and sweeps every range: gaps are
pushed, each item takes the last gap pushed, which is its successor, the smallest
one left that holds it.  What a range cannot match itself is matched across ranges
by rank: a table of counts per range fixes which ranks of left gaps go to which
ranks of left items.  Gaps shrink, and the next round starts; when gaps cannot hold
what is left, the largest items open as many sequences as their sum needs at least
(of items of one size those of the smallest hashes, found by counting hash ranges).
Inside a range the sweep is repeated on what the gaps have left until it places
nothing more, and where every gap holds several of the largest item, inside a range
or across two, a gap takes as many at once: rounds follow the ranges of sizes and
not the number of items in a sequence.

Null and empty texts are one piece that holds the end id alone.  Repeated
documents are packed once per row; an empty table gives no rows.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._shared import discard, materialize, release, slices
from ._tokens import encoder, file_of

VOCABULARY = "word_bpe_49k.json"
CAPACITY = 2048

_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, item long"
_PIECES_ARROW = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32())] + [(n, pa.int64()) for n in ("start", "length", "ids_crc32", "item")])


def with_end(ids: np.ndarray, counts: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all documents in a row, each followed by the end id, and their bounds."""
    out = np.full(len(ids) + len(counts), end_id, np.uint32)
    bounds = np.concatenate([[0], np.cumsum(counts + 1)])
    body = np.ones(len(out), bool)
    body[bounds[1:] - 1] = False
    out[body] = ids
    return out, bounds


def _encoder(path: str, end_id: int, capacity: int):
    def encode(batches):
        from pyspark import TaskContext

        tok = encoder(path)
        number = TaskContext.get().partitionId() << 36
        for batch in slices(batches, 1):
            ids, bounds = with_end(*tok.encode_column(batch.column(1)), end_id)
            raw = memoryview(ids.astype("<u4").tobytes())
            rows: list[tuple] = []
            for doc_id, low, high in zip(batch.column(0).to_pylist(), bounds[:-1].tolist(), bounds[1:].tolist()):
                for k, a in enumerate(range(low, high, capacity)):
                    n = min(capacity, high - a)
                    rows.append((doc_id, k, a - low, n, zlib.crc32(raw[4 * a : 4 * (a + n)]), number))
                    number += 1
            if rows:
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), _PIECES_ARROW.types)], schema=_PIECES_ARROW)
        release()

    return encode


def pieces(docs: DataFrame, vocabulary: str | None = None, end_id: int = 0, capacity: int = CAPACITY) -> DataFrame:
    """Every piece of every document with its checksum and its packing item."""
    return docs.select("doc_id", "text").mapInArrow(_encoder(file_of(VOCABULARY, vocabulary), end_id, capacity), _PIECES)


_SWEPT = "what int, id long, size long, part int, rank long, bin long, gap long"
_SWEPT_ARROW = pa.schema([("what", pa.int32()), ("id", pa.int64()), ("size", pa.int64()), ("part", pa.int32()), ("rank", pa.int64()), ("bin", pa.int64()), ("gap", pa.int64())])
GAP, ITEM, PLACED, OPENED, REST = 0, 1, 2, 3, 4


def _matches(kind: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(items placed, their gaps, items left, gaps left) of rows by size descending, gaps (0) before items (1).

    Depth counts gaps not yet taken; an item takes the latest gap at its depth.
    """
    step = np.where(kind == 0, 1, -1)
    depth = np.cumsum(step)
    # An item that meets no gap leaves the stack empty: measure depth from the lowest point so far.
    floor = np.minimum.accumulate(np.minimum(depth, 0))
    unmatched = (kind == 1) & (np.concatenate([[0], floor[:-1]]) > floor)
    level = depth - floor + (kind == 1)
    live = np.flatnonzero(~unmatched)
    order = live[np.lexsort((live, level[live], floor[live]))] if len(live) else live
    k, lv, fl = kind[order], level[order], floor[order]
    pair = np.zeros(len(order), bool)
    pair[1:] = (k[1:] == 1) & (k[:-1] == 0) & (lv[1:] == lv[:-1]) & (fl[1:] == fl[:-1])
    items, gaps = order[pair], order[np.flatnonzero(pair) - 1]
    free = kind == 0
    free[gaps] = False
    return items, gaps, np.flatnonzero(unmatched), np.flatnonzero(free)


def fill(kind: np.ndarray, ids: np.ndarray, size: np.ndarray):
    """Match items to gaps inside one size range until nothing more is placed.

    Rows come by size descending, gaps before items.  Gives the placed items as (id, size,
    bin, gap before it), what the gaps that took any have left (bin, size), and the
    places of the items and of the gaps that are left.
    """
    items, gaps, left, free = _matches(kind)
    placed = [(ids[items], size[items], ids[gaps], size[gaps])]
    bins, rest = ids[gaps], size[gaps] - size[items]
    while len(left) and len(bins):
        fits = np.flatnonzero(rest >= size[left[-1]])
        if not len(fits):
            break
        fits = fits[np.argsort(rest[fits], kind="stable")]
        each = int(rest[fits[0]] // max(1, size[left[0]]))
        if each > 1:
            # The smallest gap holds several of the largest item: rows of them, smallest gaps first.
            n = min(len(left), each * len(fits))
            owner, row = fits[np.arange(n) // each], left[:n]
            before = np.cumsum(size[row]) - size[row]
            before -= before[np.arange(n) // each * each]
            placed.append((ids[row], size[row], bins[owner], rest[owner] - before))
            rest = rest - np.bincount(owner, size[row], len(rest)).astype(np.int64)
            left = left[n:]
            continue
        both = np.concatenate([np.zeros(len(fits), np.int32), np.ones(len(left), np.int32)])
        sizes = np.concatenate([rest[fits], size[left]])
        order = np.lexsort((both, -sizes))
        some, into, still, _ = _matches(both[order])
        if not len(some):
            break
        row, owner = left[order[some] - len(fits)], fits[order[into]]
        placed.append((ids[row], size[row], bins[owner], rest[owner]))
        rest[owner] -= size[row]
        left = left[order[still] - len(fits)]
    return [np.concatenate(x) for x in zip(*placed)], (bins, rest), left, free


def _sweep(batches):
    """Fill the gaps of one size range; yields the matches, what gaps that took any have left, and by rank the gaps and items that are left."""
    from pyspark import TaskContext

    part = TaskContext.get().partitionId()
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    table = pa.Table.from_batches(held)
    kind, ids, size = (table.column(c).to_numpy() for c in ("what", "id", "size"))
    (item, own, bins, gap), (changed, rest), left, free = fill(kind, ids, size)
    zero = lambda n: np.zeros(n, np.int64)
    for what, a, b, c, d in ((PLACED, item, own, bins, gap), (REST, changed, rest, None, None), (GAP, ids[free], size[free], None, None), (ITEM, ids[left], size[left], None, None)):
        n = len(a)
        if n:
            columns = (np.full(n, what, np.int32), a, b, np.full(n, part, np.int32), np.arange(n), zero(n) if c is None else c, zero(n) if d is None else d)
            yield pa.record_batch([pa.array(x) for x in columns], schema=_SWEPT_ARROW)


def _left(batches):
    """(part, what, n, least, most) of the rows that one task reads: how many, and their sizes."""
    schema = pa.schema([("part", pa.int32()), ("what", pa.int32()), ("n", pa.int64()), ("least", pa.int64()), ("most", pa.int64())])
    counts: dict[tuple[int, int], Left] = {}
    for batch in batches:
        size = batch.column(2).to_numpy()
        key, place, n = np.unique(batch.column(0).to_numpy().astype(np.int64) * 4 + batch.column(1).to_numpy(), return_inverse=True, return_counts=True)
        for j, (k, c) in enumerate(zip(key.tolist(), n.tolist())):
            own = size[place == j]
            counts[k >> 2, k & 3] = _joined(counts.get((k >> 2, k & 3)), (c, int(own.min()), int(own.max())))
    if counts:
        yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*((*k, *v) for k, v in counts.items())), schema)], schema=schema)


#: How many rows a range left, and their least and greatest size.
Left = tuple[int, int, int]


def _joined(a: Left | None, b: Left) -> Left:
    return b if a is None else (a[0] + b[0], min(a[1], b[1]), max(a[2], b[2]))


#: Gaps handed over between ranges, counted, up to which they are broadcast; more are joined by a shuffle.
_FEW = 20_000


def carry(left: dict[tuple[int, int], Left]) -> list[tuple[int, int, int, int, int, int]]:
    """Intervals (item range, first rank, items, gap range, last gap rank, items a gap) across ranges.

    ``left`` has what each range left: (range, 0) gaps and (range, 1) items.  In
    sweep order a range's left items come before its left gaps, so they take gaps
    of earlier ranges, latest first.  Where the smallest gap of a range holds several
    of the largest item, a gap takes that many items in a row at once.
    """
    stack: list[list[int]] = []
    out = []
    for part in sorted({p for p, _ in left}):
        need, _, largest = left.get((part, 1), (0, 0, 0))
        first = 0
        while need and stack:
            top = stack[-1]
            each = max(1, top[2] // max(1, largest))
            n = min(need, top[1] * each)
            out.append((part, first, n, top[0], top[1] - 1, each))
            first, need, top[1] = first + n, need - n, top[1] - math.ceil(n / each)
            if not top[1]:
                stack.pop()
        if (part, 0) in left:
            stack.append([part, *left[part, 0][:2]])
    return out


def one_round(state: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Give every gap one item, or of much smaller ones a row of them; the state after it with the items placed just now, and a table it reads.

    ``state`` has the rows (what, id, size) of gaps (id: their sequence) and items.
    """
    keys = [F.desc("size"), F.asc("what"), F.asc("h")]
    dealt = state.withColumn("h", F.xxhash64("id")).repartitionByRange(*keys).sortWithinPartitions(*keys)
    swept = materialize(dealt.select("what", "id", "size").mapInArrow(_sweep, _SWEPT), "swept")
    # Each task of the next scan counts what it reads: about two rows a range reach the driver.
    left: dict[tuple[int, int], Left] = {}
    for r in swept.where(F.col("what") < PLACED).select("part", "what", "size").mapInArrow(_left, "part int, what int, n long, least long, most long").collect():
        left[r["part"], r["what"]] = _joined(left.get((r["part"], r["what"])), (r["n"], r["least"], r["most"]))
    lines = carry(left) or [(-1, 0, 0, -1, -1, 1)]
    gaps = sum(math.ceil(line[2] / line[5]) for line in lines)
    plan = state.sparkSession.createDataFrame(lines, "to_part int, first long, n long, from_part int, last long, each long")
    plan = F.broadcast(plan.coalesce(1))  # a few rows per task
    rank, wide = F.col("rank"), F.ceil(F.col("n") / F.col("each"))
    wants = swept.where(F.col("what") == ITEM).join(plan, (F.col("part") == F.col("to_part")) & (rank >= F.col("first")) & (rank < F.col("first") + F.col("n")), "left")
    wants = wants.select("id", "size", "rank", "from_part", (F.col("last") - F.floor((rank - F.col("first")) / F.col("each"))).alias("from_rank"))
    offers = swept.where(F.col("what") == GAP).join(plan, (F.col("part") == F.col("from_part")) & (rank <= F.col("last")) & (rank > F.col("last") - wide), "left")
    none = F.lit(None).cast("long")
    free = offers.where("from_part is null").select("what", "id", "size", none.alias("bin"), none.alias("gap"))
    offers = offers.where("from_part is not null").select("from_part", rank.alias("from_rank"), F.col("id").alias("bin"), F.col("size").alias("gap"))
    # The gaps that are handed over are as many as the lines say; few go to all tasks.
    across = wants.where("from_part is not null").join(F.broadcast(offers) if gaps <= _FEW else offers, ["from_part", "from_rank"])
    if any(line[5] > 1 for line in lines):
        # The items of one gap stand behind each other; the last one leaves the smaller gap.
        row = Window.partitionBy("bin").orderBy("rank")
        across = across.withColumn("before", F.coalesce(F.sum("size").over(row.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("closes", F.lead("id").over(row).isNull())
        across = across.withColumn("gap", F.col("gap") - F.col("before"))
    else:
        across = across.withColumn("closes", F.lit(True))
    # The last item of a gap also leaves the smaller gap.
    found = across.withColumn("kind", F.explode(F.when(F.col("closes"), F.array(F.lit(PLACED), F.lit(GAP))).otherwise(F.array(F.lit(PLACED)))))
    after = found.select(
        F.col("kind").alias("what"), F.when(F.col("kind") == GAP, F.col("bin")).otherwise(F.col("id")).alias("id"),
        F.when(F.col("kind") == GAP, F.col("gap") - F.col("size")).otherwise(F.col("size")).alias("size"), "bin", "gap",
    )
    after = after.unionByName(swept.where(F.col("what") == PLACED).select("what", "id", "size", "bin", "gap"))
    after = after.unionByName(swept.where(F.col("what") == REST).select(F.lit(GAP).alias("what"), "id", "size", none.alias("bin"), none.alias("gap")))
    waiting = wants.where("from_part is null").select(F.lit(ITEM).alias("what"), "id", "size", none.alias("bin"), none.alias("gap"))
    return after.unionByName(waiting).unionByName(free).where((F.col("what") != GAP) | (F.col("size") > 0)), swept


def _hash(turn: int) -> F.Column:
    return F.xxhash64("id", F.lit(turn))


#: Bits of a hash that one count tells apart.
_BITS = 12


def nth_hash(items: DataFrame, wanted: int) -> int:
    """The ``wanted``-th smallest hash (column h) by counts of hash ranges: 4,096 rows a step, five steps at most."""
    low = 0  # of the range that holds it, in unsigned hashes
    for used in range(0, 64, _BITS):
        shift = max(0, 64 - used - _BITS)
        unsigned = F.col("h").bitwiseXOR(F.lit(-(2**63)))
        inside = items if not used else items.where(F.shiftrightunsigned(unsigned, 64 - used) == low >> (64 - used))
        counts = inside.groupBy((F.shiftrightunsigned(unsigned, shift) % 2**_BITS if shift + _BITS < 64 else F.shiftrightunsigned(unsigned, shift)).alias("r")).count().collect()
        for r, n in sorted((row["r"] % 2**_BITS, row["count"]) for row in counts):
            if wanted <= n:
                low |= r << shift
                if wanted == n:  # the whole range
                    return low + (1 << shift) - 1 - 2**63
                break
            wanted -= n
    return low - 2**63


def _opens(after: DataFrame, sizes: dict[int, int], wanted: int, turn: int) -> tuple[int, int]:
    """(size, hash) such that ``wanted`` items are larger, or of that size with no greater hash."""
    for size in sorted(sizes, reverse=True):
        if wanted == sizes[size]:
            return size, 2**63 - 1
        if wanted < sizes[size]:
            return size, nth_hash(after.where((F.col("what") == ITEM) & (F.col("size") == size)).select(_hash(turn).alias("h")), wanted)
        wanted -= sizes[size]
    return 0, 2**63 - 1


def place(items: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(item, bin, bin_at) for every item (item, item_size)."""
    spark = items.sparkSession
    state = items.select(F.lit(ITEM).alias("what"), F.col("item").alias("id"), F.col("item_size").alias("size"))
    rounds: list[DataFrame] = []
    cut, most, turn = capacity // 2, -(2**63), 0
    while True:  # a round places an item or opens a sequence
        # Items above the cut (and some of those at it) open a sequence each; what remains fills gaps.
        own = (F.col("what") == ITEM) & ((F.col("size") > cut) | ((F.col("size") == cut) & (_hash(turn) <= most)))
        opened = state.where(own).select(F.lit(OPENED).alias("what"), "id", "size", F.col("id").alias("bin"), F.lit(capacity).cast("long").alias("gap"))
        ready = state.select(F.when(own, GAP).otherwise(F.col("what")).alias("what"), "id", F.when(own, capacity - F.col("size")).otherwise(F.col("size")).alias("size")).where("size > 0")
        done, swept = one_round(ready)
        # One table a round: what was placed or opened in it, and the state after it.
        after = materialize(done.unionByName(opened), "round")
        discard(swept)
        rounds.append(after)
        # At most four kinds of ``capacity`` sizes each.
        tally = after.groupBy("what", "size").count().collect()
        sizes = {r["size"]: r["count"] for r in tally if r["what"] == ITEM}
        if not sizes:
            break
        least, total = min(sizes), sum(k * n for k, n in sizes.items())
        room = sum(r["size"] * r["count"] for r in tally if r["what"] == GAP and r["size"] >= least)
        moved = any(r["what"] == PLACED for r in tally)
        missing = math.ceil((total - room) / capacity)
        if not moved:
            missing = max(missing, 1)
        turn += 1
        cut, most = _opens(after, sizes, missing, turn) if missing > 0 else (capacity, -(2**63))
        state = after.where((F.col("what") == ITEM) | ((F.col("what") == GAP) & (F.col("size") >= least))).select("what", "id", "size")
    paths = sorted({f.rpartition("/")[0] for r in rounds for f in r.inputFiles()})
    every = spark.read.schema(rounds[0].schema).parquet(*paths) if paths else rounds[0]
    return every.where(F.col("what") >= PLACED).select(F.col("id").alias("item"), "bin", (capacity - F.col("gap")).alias("bin_at"))


def pack(docs: DataFrame, vocabulary: str | None = None, end_id: int = 0, capacity: int = CAPACITY) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id and its offset there."""
    cut = materialize(pieces(docs, vocabulary, end_id, capacity), "pieces")
    placed = place(cut.select("item", F.col("length").alias("item_size")), capacity)
    return cut.join(placed, "item").select("doc_id", "piece", "start", "length", "ids_crc32", F.col("bin").alias("sequence_id"), F.col("bin_at").alias("offset"))
