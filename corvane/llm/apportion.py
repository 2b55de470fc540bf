"""Mixing sources to target weights by Sainte-Laguë apportionment, in DataFrame functions only.

A source's words, its documents in seeded order, are cut into shards and these
into blocks of ``BLOCK`` words.  The mix is a house of blocks: its seats go to
the sources by the highest quotients ``target / 1, target / 3, target / 5 ...``,
and a source's seats to its shards by the highest quotients of their words.  A
shard takes its blocks in the order of a seeded hash: all of them once before
any twice.  What a source's blocks differ from its target by, about half a block,
is settled by cutting or adding to one block of one of its shards, so that the
words taken are the target, rounded.

Only a narrow table (id, source, size, hash) is shuffled, by (source, shard); a
source is as many shards as its words need, so a large source is many tasks.

Rows: a null text has no words and is never taken, as are empty ones; a null
source is a source of its own, the last; rows with a null or a repeated id are
rows like others.  An empty table gives no rows.  Other columns are not read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._shared import materialize

#: Words of a block, and of a shard before its last document.
BLOCK = 256
SHARD_WORDS = 1 << 18

WORD = r"[^\x20\x09-\x0D]+"


def _long(c: Column) -> Column:
    return c.cast("long")


def sizes(docs: DataFrame, seed: str = "mix") -> DataFrame:
    """Per row: doc_id, source, size (words), and its place in the seeded order (key; tie for equal ids)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(
        "doc_id", "source", _long(F.regexp_count(text, F.lit(WORD))).alias("size"),
        F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))).alias("key"), F.xxhash64(text).alias("tie"),
    )


def targets(by_source: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """Sources (source, source_size) with their number in code point order, weight and target.

    ``share`` of all sizes is dealt by weight; a target ends at ``most`` times its
    source's size and the excess goes to the others by weight.  Those at their limit
    are the first in the order of limit / weight, up to the first for which the level
    of all that are left is lower.
    """
    every = Window.partitionBy()
    ordered = Window.orderBy("reach", "number")
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("number") % len(weights) + 1).cast("int"))
    out = (
        by_source.withColumn("number", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
        .withColumn("weight", weight).withColumn("limit", most * F.col("source_size")).withColumn("reach", F.col("limit") / F.col("weight"))
        .withColumn("before", F.coalesce(F.sum("limit").over(ordered.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("weights", F.sum("weight").over(ordered.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("level", (share * F.sum("source_size").over(every) - F.col("before")) / F.col("weights"))
        .withColumn("place", F.row_number().over(ordered))
        .withColumn("open", F.min(F.when(F.col("limit") > F.col("weight") * F.col("level"), F.struct("place", "level"))).over(every))
    )
    capped = F.col("open").isNull() | (F.col("place") < F.col("open.place"))
    return out.select("source", "source_size", "number", "weight", F.when(capped, F.col("limit")).otherwise(F.col("weight") * F.col("open.level")).alias("target"))


def sainte_lague(parties: DataFrame, group: list[str], party: str, weight: str, house: Column) -> DataFrame:
    """``parties`` with their ``seats``: the ``house`` highest quotients weight / (2 k - 1) of each group, ties to the smaller party.

    With n parties, a seat below ``weight * (house - n / 2) / all`` is certain and one
    above ``weight * (house + n / 2) / all`` impossible; only the seats between, about
    two a party, are compared.
    """
    every, keys = Window.partitionBy(*group), [*group, party]
    share, n = F.col(weight) / F.sum(weight).over(every), F.count(F.lit(1)).over(every)
    low, high = (_long(F.floor(share * (house + half * n) + 0.5)) for half in (-0.5, 0.5))
    held = (
        parties.where(F.col(weight) > 0).select(*keys, F.col(weight).alias("_w"), _long(house).alias("_house"), F.greatest(low - 1, F.lit(0).cast("long")).alias("_low"), (high + 1).alias("_high"))
        .withColumn("_open", F.col("_house") - F.sum("_low").over(every))
    )
    quotients = held.select(*keys, "_low", "_open", "_w", F.explode(F.sequence(F.col("_low") + 1, F.col("_high"))).alias("_k")).withColumn("_quotient", F.col("_w") / (2 * F.col("_k") - 1))
    place = F.row_number().over(every.orderBy(F.col("_quotient").desc(), party))
    won = quotients.withColumn("_place", place).groupBy(*keys).agg((F.first("_low") + F.count_if(F.col("_place") <= F.col("_open"))).alias("seats"))
    return parties.join(won, keys, "left").withColumn("seats", F.coalesce("seats", F.lit(0).cast("long")))


def _quotas(cells: DataFrame, block: int, most: int) -> DataFrame:
    """Shards (number, shard, words, seats_all, goal) with the words each takes: its quota of blocks, and its part in settling the source's rest."""
    source = Window.partitionBy("number")
    in_order = source.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    dealt = sainte_lague(cells, ["number"], "shard", "words", F.col("seats_all"))
    out = dealt.withColumn("take", F.least(F.col("seats") * block, F.col("words") * most)).withColumn("rest", F.col("goal") - F.sum("take").over(source))
    room = F.when(F.col("rest") > 0, F.col("words") * most - F.col("take")).otherwise(F.col("take"))
    out = out.withColumn("room", room).withColumn("used", F.coalesce(F.sum("room").over(in_order), F.lit(0)))
    part = F.least(F.col("room"), F.greatest(F.abs("rest") - F.col("used"), F.lit(0)))
    return out.select("number", "shard", "words", "seats", (F.col("take") + F.signum("rest").cast("long") * part).alias("take"))


def _blocks(quotas: DataFrame, block: int, seed: str) -> DataFrame:
    """Per shard: how often it is taken whole, and for each block the words taken before it and of it beyond that."""
    shard = Window.partitionBy("number", "shard")
    pieces = quotas.select(
        "number", "shard", "words", _long(F.floor(F.col("take") / F.col("words"))).alias("whole"), (F.col("take") % F.col("words")).alias("more"),
        F.explode(F.sequence(F.lit(0).cast("long"), _long(F.floor((F.col("words") - 1) / block)))).alias("block"),
    ).withColumn("length", F.least(F.lit(block).cast("long"), F.col("words") - F.col("block") * block))
    pick = F.md5(F.concat_ws(":", F.lit(seed), "number", "shard", "block"))
    ranked = shard.orderBy(F.col("length") < block, "pick", "block").rowsBetween(Window.unboundedPreceding, -1)
    taken = F.greatest(F.lit(0).cast("long"), F.least(F.col("length"), F.col("more") - F.coalesce(F.sum("length").over(ranked), F.lit(0))))
    before = F.coalesce(F.sum("t").over(shard.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    pieces = pieces.withColumn("pick", pick).withColumn("t", taken).withColumn("p", before)
    return pieces.groupBy("number", "shard").agg(F.first("words").alias("words"), F.first("whole").alias("whole"), F.sum("t").alias("more"), F.sort_array(F.collect_list(F.struct("block", "p", "t"))).alias("blocks"))


def mix(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: int = 2, block: int = BLOCK, shard_words: int = SHARD_WORDS, seed: str = "mix") -> DataFrame:
    """Per document: source, size, source_size, target (its source's), taken, and what is taken.

    The mix holds the document ``whole`` times and besides the words of ``parts``
    (start, words), so ``taken = whole * size + sum(parts.words)``, at most ``most``
    times the size.  The same rows give the same mix, however they are partitioned.
    """
    rows = materialize(sizes(docs, seed), "sizes")
    sources = targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most)
    house = F.floor(F.sum("target").over(Window.partitionBy()) / block + 0.5)
    sources = sainte_lague(sources.withColumn("house", _long(house)), [], "number", "target", F.col("house"))
    sources = materialize(sources.select(
        F.col("source").alias("name"), "source_size", "number", "target", F.col("seats").alias("seats_all"), _long(F.floor(F.col("target") + 0.5)).alias("goal"),
        F.greatest(F.lit(1).cast("long"), _long(F.ceil(F.col("source_size") / shard_words))).alias("shards"),
    ), "sources")
    placed = rows.join(sources, F.col("source").eqNullSafe(F.col("name")))
    shard = F.conv(F.substring("key", 1, 8), 16, 10).cast("long") % F.col("shards")
    worded = placed.where("size > 0").withColumn("shard", shard)
    cells = worded.groupBy("number", "shard", "seats_all", "goal").agg(F.sum("size").alias("words"))
    blocks = materialize(_blocks(_quotas(cells, block, most), block, seed), "blocks")
    order = Window.partitionBy("number", "shard").orderBy("key", "doc_id", "size", "tie").rowsBetween(Window.unboundedPreceding, -1)
    found = worded.withColumn("at", F.coalesce(F.sum("size").over(order), F.lit(0).cast("long"))).join(blocks, ["number", "shard"])

    def upto(x: Column) -> Column:
        """Words that ``parts`` take before place x of the shard."""
        one = F.get("blocks", _long(F.floor(x / block)).cast("int"))
        return F.when(x >= F.col("words"), F.col("more")).otherwise(one["p"] + F.least(x % block, one["t"]))

    end = F.col("at") + F.col("size")
    first = _long(F.floor(F.col("at") / block))
    touched = F.slice("blocks", (first + 1).cast("int"), (_long(F.floor((end - 1) / block)) - first + 1).cast("int"))
    begins = lambda b: F.greatest(F.col("at"), b["block"] * block)
    part = lambda b: F.struct((begins(b) - F.col("at")).alias("start"), (F.least(end, b["block"] * block + b["t"]) - begins(b)).alias("words"))
    parts = F.filter(F.transform(touched, part), lambda x: x["words"] > 0)
    known = ("doc_id", "source", "size", "source_size", "target")
    taken = found.select(*known, (F.col("whole") * F.col("size") + upto(end) - upto(F.col("at"))).alias("taken"), "whole", parts.alias("parts"))
    empty = placed.where("size = 0").select(*known, F.lit(0).cast("long"), F.lit(0).cast("long"), F.array().cast(taken.schema["parts"].dataType))
    return reduce(DataFrame.union, (taken, empty))
