"""Mixing sources to target weights by Sainte-Laguë apportionment, in DataFrame functions.

1. Targets: ``share`` times the sum of all sizes is divided by weight; a source's target
   stops at ``most_epochs`` times its size and the excess is reshared by weight until no
   source is above.
2. Quotas: the total, in blocks of ``block`` tokens, goes to the sources by the highest
   quotients target / (2 j + 1), each source's quota to its shards by the highest
   quotients shard size / (2 j + 1). Only seats that can decide are ranked: the final
   divisor lies within half a seat per party of total / seats, so that all parties
   together rank about three seats each, however many blocks there are.
3. Seeded selection: a shard's documents, ordered by a seeded hash, form a stream of
   tokens that is read up to ``most_epochs`` times; its first quota blocks are taken. A
   document's ``taken`` is the overlap of its tokens with the blocks taken, over all
   passes, so that nothing is taken more often than ``most_epochs`` times.

Hash ranges of doc_id, ``min(4096, rows / 256)`` in every source, split a source of any
share of the rows. A source's shards are runs of ranges, as many as leave a shard
``BLOCKS`` blocks on average, so that rounding to blocks is small against a shard; what a
shard's quota holds above ``most_epochs`` times its size goes to the source's other
shards by their next quotients. Windows run within (source, range) and over the few rows
per source, shard or range. Sizes count ``[^\\x20\\x09-\\x0D]+``; null texts have size 0.
Sources are ordered by code point, null last (a source of its own). Rows that repeat are
documents of their own; those of equal doc_id and size are interchangeable. If all sizes
are 0 nothing is taken; an empty table gives an empty result. Ties of quotients go to the
source that is first by code point, or the shard with the smaller number. Only doc_id,
source and text are read by ``mix``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from cardtrail.llm.common import WORD

WEIGHTS = (5.0, 2.0, 1.0)
#: Blocks that a shard holds on average, at least (fixed value).
BLOCKS = 64
#: The end of one word and the start of the next: where a text can be cut between words.
CUT = r"(?<=[\x20\x09-\x0D])(?=[^\x20\x09-\x0D])"


def source_targets(sizes: DataFrame, share: float = 1.5, most_epochs: int = 2, weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """source, source_size, place (from 1), target of (source, size) rows.

    Water-filling: sources in the order of limit / weight; the first ones stop at their
    limit, the rest share what is left by weight."""
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    weight = F.element_at(F.array(*map(F.lit, weights)), F.pmod(F.col("place") - 1, F.lit(len(weights))) + 1)
    totals = totals.withColumn("place", place).withColumn("weight", weight).withColumn("limit", most_epochs * F.col("source_size").cast("double"))
    everything = Window.partitionBy()
    rising = Window.orderBy(F.col("limit") / F.col("weight"), "place")
    filled = totals.withColumns({
        "aim": share * F.sum("source_size").over(everything),
        "below": F.coalesce(F.sum("limit").over(rising.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)),
        "open_weight": F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(rising.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)),
    })
    level = (F.col("aim") - F.col("below")) / F.col("open_weight")
    # the first source whose limit is above the level that it and all later ones would share
    filled = filled.withColumn("first_level", F.first(F.when(F.col("limit") >= level * F.col("weight"), level), ignorenulls=True)
                               .over(rising.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    target = F.least("limit", F.coalesce(F.col("first_level") * F.col("weight"), F.col("limit")))
    return filled.select("source", "source_size", "place", target.alias("target"))


def apportion(parties: DataFrame, group: list[str], votes: str, seats: str, tie: str) -> DataFrame:
    """``parties`` with a column ``quota``: Sainte-Laguë seats in each group.

    ``seats`` is a column with the group's number of seats. Seat j (from 0) has the
    quotient votes / (2 j + 1); the highest get seats. The divisor lies between
    total / (seats + n/2) and total / (seats - n/2) for n parties, which fixes the first
    seats and rules out late ones; those between are ranked."""
    whole = Window.partitionBy(*group)
    total, n = F.col("_total"), F.col("_n")
    known = parties.withColumns({"_total": F.sum(votes).over(whole), "_n": F.count("*").over(whole)})
    scaled = lambda s: F.col(votes) * s / total
    low = F.when(total > 0, F.greatest(F.lit(0), F.floor(scaled(F.col(seats) - n / 2 - 1) + 0.5) - 1)).otherwise(F.lit(0))
    high = F.when((total > 0) & (F.col(votes) > 0), F.ceil(scaled(F.col(seats) + n / 2 + 1) + 0.5) + 1).otherwise(F.lit(0))
    known = known.withColumns({"_low": low.cast("long"), "_high": F.greatest(low, high).cast("long")})
    known = known.withColumn("_open", F.col(seats) - F.sum("_low").over(whole))
    seat = known.withColumn("_seat", F.explode_outer(F.when(F.col("_high") > F.col("_low"), F.sequence(F.col("_low"), F.col("_high") - 1))))
    by = Window.partitionBy(*group).orderBy((F.col(votes) / (2 * F.col("_seat") + 1)).desc_nulls_last(), tie, "_seat")
    seat = seat.withColumn("_won", (F.col("_seat").isNotNull() & (F.row_number().over(by) <= F.col("_open"))).cast("long"))
    keep = [c for c in parties.columns]
    return seat.groupBy(*keep, "_low").agg(F.sum("_won").alias("_more")).withColumn("quota", F.col("_low") + F.col("_more")).select(*keep, "quota")


def _reshared(parts: DataFrame, most_epochs: int, block: int) -> DataFrame:
    """``parts`` with the tokens that a shard gives (_give): its quota up to its limit,
    then of what limits cut off in its source up to a block, then up to its limit, the
    shards of the highest next quotients first."""
    limit, seats = F.col("_shard_size") * most_epochs, F.col("quota") * block
    whole = Window.partitionBy("_key")
    next_first = whole.orderBy((F.col("_shard_size") / (2 * F.col("quota") + 1)).desc_nulls_last(), "_shard")
    parts = parts.withColumn("_give", F.least(seats, limit)).withColumn("_cut", F.sum(seats - F.col("_give")).over(whole))
    for most in (F.lit(block), limit):
        parts = parts.withColumn("_room", F.least(most, limit - F.col("_give")))
        before = F.coalesce(F.sum("_room").over(next_first.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        parts = parts.withColumns({"_more": F.greatest(F.lit(0), F.least("_room", F.col("_cut") - before)), "_all_room": F.sum("_room").over(whole)})
        parts = parts.withColumns({"_give": F.col("_give") + F.col("_more"), "_cut": F.greatest(F.lit(0), F.col("_cut") - F.col("_all_room"))})
    return parts.drop("_cut", "_room", "_more", "_all_room")


def _plan(rows: DataFrame, share: float, most_epochs: int, block: int, seed: int, weights: tuple[float, ...]) -> DataFrame:
    """``rows`` (doc_id, source, size, ...) with source_size, target and where the
    document's tokens start in its shard's stream (_at), the tokens that the shard gives
    (_give) and the shard's size (_shard_size). A shard's stream is those of its ranges,
    one after the other."""
    count = rows.count()
    ranges = max(1, min(4096, count // 256))
    rows = rows.withColumns({"_order": F.xxhash64(F.lit(seed), "doc_id", "size"), "_range": F.pmod(F.xxhash64("doc_id", F.lit(seed + 1)), F.lit(ranges))})
    sources = source_targets(rows.select("source", "size"), share, most_epochs, weights)
    seats = F.round(F.sum("target").over(Window.partitionBy()) / block).cast("long")
    sources = sources.withColumns({"_all": F.lit(0), "_seats": seats})
    sources = apportion(sources, ["_all"], "target", "_seats", "place").withColumnRenamed("quota", "_source_quota")
    parts = rows.groupBy("source", "_range").agg(F.sum("size").alias("_range_size"))
    key = F.coalesce(F.concat(F.lit("="), "source"), F.lit("null"))
    parts = parts.withColumn("_key", key).join(sources.withColumn("_key", key).drop("source"), "_key")
    shards = F.greatest(F.lit(1), F.least(F.lit(ranges), F.floor(F.col("source_size") / (block * BLOCKS))))
    parts = parts.withColumn("_shard", F.floor(F.col("_range") * shards / ranges).cast("long"))
    parts = parts.groupBy("_key", "_shard", "source_size", "target", "_source_quota").agg(
        F.sum("_range_size").alias("_shard_size"), F.sort_array(F.collect_list(F.struct("_range", "_range_size"))).alias("_ranges"))
    parts = _reshared(apportion(parts, ["_key"], "_shard_size", "_source_quota", "_shard"), most_epochs, block)
    parts = parts.select("*", F.inline("_ranges"))
    earlier = Window.partitionBy("_key", "_shard").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("_from", F.coalesce(F.sum("_range_size").over(earlier), F.lit(0)))
    stream = Window.partitionBy("source", "_range").orderBy("_order", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_within", F.coalesce(F.sum("size").over(stream), F.lit(0))).withColumn("_key", key)
    rows = rows.join(parts.select("_key", "_range", "_from", "_shard_size", "source_size", "target", "_give"), ["_key", "_range"])
    return rows.withColumn("_at", F.col("_from") + F.col("_within"))


def _overlap(epoch: int) -> Column:
    """Tokens of the document that pass ``epoch`` (from 0) takes: the first so many."""
    left = F.col("_give") - epoch * F.col("_shard_size") - F.col("_at")
    return F.greatest(F.lit(0), F.least(F.col("size"), left))


def _sized(docs: DataFrame) -> Column:
    return F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")


def mix(docs: DataFrame, share: float = 1.5, most_epochs: int = 2, block: int = 16, seed: int = 17,
        weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """doc_id, source, size, source_size, target (its source's), taken of every document."""
    rows = docs.select("doc_id", "source", _sized(docs).alias("size"))
    plan = _plan(rows, share, most_epochs, block, seed, weights)
    taken = sum((_overlap(e) for e in range(1, most_epochs)), _overlap(0))
    return plan.select("doc_id", "source", "size", "source_size", "target", taken.cast("long").alias("taken"))


def mixed_documents(docs: DataFrame, share: float = 1.5, most_epochs: int = 2, block: int = 16, seed: int = 17,
                    weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """The mix as documents, with the columns of ``docs``: one row for every pass that
    takes words of a document, holding the words that it takes (the whole text as it is,
    or its first words); ``n_chars`` follows the text. Documents that no pass takes are
    left out."""
    names = docs.columns
    rows = docs.select(F.struct(*names).alias("_doc"), "doc_id", "source", _sized(docs).alias("size"))
    plan = _plan(rows, share, most_epochs, block, seed, weights)
    passes = plan.withColumn("_words", F.explode(F.array(*(_overlap(e) for e in range(most_epochs))))).where("_words > 0")
    text = F.col("_doc.text")
    part = F.when(F.col("_words") >= F.col("size"), text).otherwise(
        F.concat_ws("", F.slice(F.split(F.regexp_replace(text, r"^[\x20\x09-\x0D]+", ""), CUT), F.lit(1), F.col("_words").cast("int"))))
    passes = passes.withColumn("_text", part)
    fresh = {"text": F.col("_text"), "n_chars": F.length("_text").cast("long")}
    return passes.select(*(fresh.get(n, F.col(f"_doc.`{n}`")).alias(n) for n in names))
