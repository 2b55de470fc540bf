"""Bounded selection of evidence from the facts of many sources, all in one plan.

Every source's distinct texts are its candidates: at most ``max_candidates`` of them and
``max_bytes``, those of the lowest hashes, so that late text has the same chance as early.
A source whose candidates fit the budget keeps them all.  In others the excerpts are
dealt round robin over the groups (region, field), spread evenly over a group, and
paid from an equal share of the tokens each; what the shares leave pays for those that
did not fit their own, in the order of the groups.

Texts are dealt by source once; ranks and sums are windows by source or group.  Only
excerpts that were dealt out, ``max_excerpts`` of a source at most, ever meet in one row,
and those rows find their texts by source, where they already are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_ITEM = "array<struct<region: string, field: string, at: int, tokens: bigint>>"


def _greedy(items: Column, budget: Column) -> Column:
    """Those of an ordered array that still fit the budget when their turn comes."""
    start = F.struct(F.lit(0).cast("long").alias("spent"), F.array().cast(_ITEM).alias("kept"))
    step = lambda acc, x: F.when(
        x["tokens"] <= budget - acc["spent"], F.struct((acc["spent"] + x["tokens"]).alias("spent"), F.array_append(acc["kept"], x).alias("kept"))
    ).otherwise(acc)
    return F.aggregate(items, start, step, lambda acc: acc["kept"])


def select_evidence(facts: DataFrame, max_excerpts: int = 64, max_tokens: int = 2_048, max_candidates: int = 4_096, max_bytes: int = 1 << 20) -> DataFrame:
    """Selected texts of facts (source, region, field, place, text, tokens): source, region, field, place, text, tokens, repetitions, limits.

    A text counts once, at its first place.  ``limits`` names what was reached:
    candidate_retention, selection_budget.  Null and blank texts are no candidates; null
    regions and fields are empty ones.
    """
    rows = facts.where("source is not null and trim(coalesce(text, '')) <> ''").select("source", F.coalesce("region", F.lit("")).alias("region"), F.coalesce("field", F.lit("")).alias("field"), "place", "text", F.col("tokens").cast("long"))
    # Texts are dealt by source once; all that follows keeps to that.
    first = rows.repartition("source").groupBy("source", "text").agg(F.min(F.struct("place", "region", "field", "tokens")).alias("f"), F.count("*").alias("repetitions"))
    by_hash = Window.partitionBy("source").orderBy("hash", "text")
    upto = by_hash.rowsBetween(Window.unboundedPreceding, 0)
    ranked = first.select("source", "text", "f.*", "repetitions", F.sha2("text", 256).alias("hash")).withColumn("k", F.row_number().over(by_hash)).withColumn("bytes", F.sum(F.octet_length("text")).over(upto))
    whole = Window.partitionBy("source")
    kept = ranked.withColumn("retained", (F.col("k") <= max_candidates) & (F.col("bytes") <= max_bytes)).withColumn("cut", F.count_if(~F.col("retained")).over(whole) > 0).where("retained").drop("hash", "k", "bytes", "retained")
    group = Window.partitionBy("source", "region", "field")
    placed = (
        kept.withColumn("at", F.row_number().over(group.orderBy("place", "text")) - 1).withColumn("size", F.count(F.lit(1)).over(group))
        .withColumn("fits", (F.count(F.lit(1)).over(whole) <= max_excerpts) & (F.sum("tokens").over(whole) <= max_tokens))
    )
    tight = placed.where("not fits").select("source", "region", "field", "at", "tokens", "size")
    # Round robin: the first of every group, then the second of every group, and so on.
    slot = tight.withColumn("slot", F.row_number().over(whole.orderBy("at", "region", "field"))).withColumn("share", F.floor(max_tokens / F.count_if(F.col("at") == 0).over(whole)))
    dealt = slot.withColumn("slots", F.count_if(F.col("slot") <= max_excerpts).over(group)).where("slots > 0")
    spread = F.when(F.col("slots") >= F.col("size"), F.sequence(F.lit(0), F.col("size").cast("int") - 1)).when(F.col("slots") == 1, F.array(F.floor(F.col("size") / 2).cast("int"))).otherwise(
        F.transform(F.sequence(F.lit(0), F.col("slots").cast("int") - 1), lambda i: F.floor(i * (F.col("size") - 1) / (F.col("slots") - 1)).cast("int"))
    )
    chosen = dealt.where((F.col("slots") >= F.col("size")) | F.array_contains(spread, F.col("at")))
    queues = chosen.groupBy("source", "region", "field").agg(F.first("share").alias("share"), F.sort_array(F.collect_list(F.struct("region", "field", "at", "tokens"))).alias("items"))
    paid = queues.withColumn("kept", _greedy(F.col("items"), F.col("share"))).withColumn("pending", F.array_except("items", "kept"))
    spent = lambda items: F.aggregate(items, F.lit(0).cast("long"), lambda s, x: s + x["tokens"])
    sources = paid.groupBy("source").agg(F.flatten(F.collect_list("kept")).alias("kept"), F.sort_array(F.flatten(F.collect_list("pending"))).alias("pending"))
    taken = F.transform(F.concat("kept", _greedy(F.col("pending"), F.col("left"))), lambda x: F.struct(x["region"].alias("region"), x["field"].alias("field"), x["at"].alias("at")))
    out = sources.withColumn("left", max_tokens - spent(F.col("kept"))).select("source", taken.alias("taken"))
    limits = F.array_compact(F.array(F.when(F.col("cut"), "candidate_retention"), F.when(~F.col("fits"), "selection_budget")))
    joined = placed.join(out, "source", "left").where(F.col("fits") | F.array_contains("taken", F.struct("region", "field", "at")))
    return joined.select("source", "region", "field", "place", "text", "tokens", "repetitions", limits.alias("limits"))


def resolve_abbreviations(short: DataFrame, hashes: DataFrame, least: int = 4) -> DataFrame:
    """What abbreviated hashes (abbreviation) stand for among whole ones (hash): abbreviation, status, hash, matches.

    Resolved by exactly one hash that starts with it, else ambiguous or unknown; those
    shorter than ``least`` characters are too_short.  A prefix of ``least`` characters is the join
    key, so no abbreviation meets hashes of other prefixes.  Without regard to case.
    """
    asked = short.where("abbreviation is not null").select(F.lower("abbreviation").alias("abbreviation")).distinct()
    full = hashes.where("hash is not null").select(F.lower("hash").alias("hash")).distinct().withColumn("prefix", F.substring("hash", 1, least))
    found = asked.where(F.length("abbreviation") >= least).withColumn("prefix", F.substring("abbreviation", 1, least)).join(full, "prefix").where(F.startswith("hash", "abbreviation"))
    counted = found.groupBy("abbreviation").agg(F.count("*").alias("matches"), F.min("hash").alias("one"))
    rows = asked.join(counted, "abbreviation", "left").withColumn("matches", F.coalesce("matches", F.lit(0)))
    status = F.when(F.length("abbreviation") < least, "too_short").when(F.col("matches") == 1, "resolved").when(F.col("matches") > 1, "ambiguous").otherwise("unknown")
    return rows.select("abbreviation", status.alias("status"), F.when(F.col("matches") == 1, F.col("one")).alias("hash"), "matches")
