"""Source divergence audit: how sources of a language differ in their use of terms.

Terms are runs of letters and of characters beyond ASCII, with A-Z lower-cased. A language
keeps the terms that stand in at least ``min_docs`` of its documents. A group is a
(language, source); p of a kept term is the group's smoothed share of it, 1 + floor(10^9
(count + 2) / (N + 2 V)), and two shares p, q diverge by floor((p - q)^2 / (p + q)).

1. Blocks. A task reads its documents once and builds postings in memory: per group the
   terms' counts, per language the terms' documents. When ``block_postings`` of them are
   held, the block is spilled: its terms are sorted and leave as runs, one per hash shard
   of the terms, in chunks of ``CHUNK`` terms. A posting without a term marks the group.
2. Merge. Each shard's chunks arrive by first term; a heap holds the open chunk of every
   run and merges the runs into frequencies. A term's postings are added up here, and the
   terms of too few documents are left out. At most one chunk per run is open.
3. Shares. One aggregation of the frequencies gives N and V, a join gives every posting
   its p and the language's q. The ten terms that a group overuses most are ranked by a
   window that keeps ten rows per group before it shuffles.
4. Pairs. Two groups without a term both have their least share, p0, so V f(p0, p0') is
   the sum over all kept terms but for corrections. A term of one group corrects it by
   f(p, p0') - f(p0, p0'), which depends on p alone, so a histogram of p per group is
   enough; a term of both corrects it by what is then left. The terms' postings stream
   through tasks that make about ``PAIRS`` pairs at a time and hold one sum per pair of
   groups; the sums leave when ``HELD_SUMS`` of them are held.

All arithmetic is in whole numbers: decimals for p, 64 bits beyond (p is at most 10^9 + 1).
A row of the result exists for every pair of sources, so what is held per source stays
below the result. Hot sources and terms are pre-aggregated in the blocks; a task of the
merge gets a hash shard of the terms, and of a term one posting per run and group.

Defined results: null text, lang and source count as ''; groups without terms have pairs of
value 0 if their language keeps no term; repeated rows and rows without doc_id are documents
of their own; any length of text is read in slices cut between terms. Only text, lang and
source are read. An empty table gives an empty result.
"""

from __future__ import annotations

import heapq
import zlib
from collections import Counter
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cardtrail.llm.common import Scratch, map_arrow

SCALE = 1_000_000_000
CHUNK = 256
PAIRS = 1 << 20
HELD_SUMS = 1_000_000
SLICE = 8 << 20
#: Bytes of terms as they are, A-Z lower-cased, all others a space.
TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))

RUN = pa.schema([("shard", pa.int32()), ("first", pa.binary()), ("langs", pa.list_(pa.string())), ("sources", pa.list_(pa.string())),
                 ("terms", pa.binary()), ("sizes", pa.binary()), ("groups", pa.binary()), ("counts", pa.binary())])
RUN_DDL = "shard int, first binary, langs array<string>, sources array<string>, terms binary, sizes binary, groups binary, counts binary"


def term_slices(text: bytes):
    """The terms of a text, in lists of those of about SLICE bytes."""
    text, start = text.translate(TERM_BYTES), 0
    while len(text) - start > SLICE:
        end = text.find(b" ", start + SLICE)
        if end < 0:
            break
        yield text[start:end].split()
        start = end
    yield (text[start:] if start else text).split()


def postings(docs: DataFrame, shards: int, block_postings: int) -> DataFrame:
    """Runs of term-sorted postings, in chunks."""

    def run(batches):
        groups: dict[tuple[str, str | None], Counter] = {}
        held = 0
        for batch in batches:
            texts = batch.column("text").cast(pa.binary())
            for row, key in enumerate(zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist())):
                counts = groups.setdefault(key, Counter({b"": 0}))
                documents = groups.setdefault((key[0], None), Counter())
                held -= len(counts) + len(documents)
                slices = term_slices(texts[row].as_py())
                terms = next(slices)
                counts.update(terms)
                seen = set(terms)
                for terms in slices:
                    counts.update(terms)
                    seen.update(terms)
                documents.update(seen)
                held += len(counts) + len(documents)
                if held >= block_postings:
                    yield from spilled(groups, shards)
                    groups, held = {}, 0
        yield from spilled(groups, shards)

    rows = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("text", "lang", "source")))
    return map_arrow(rows, run, RUN_DDL)


def spilled(groups: dict, shards: int):
    """Record batches of a block: per shard and chunk the sorted terms and, per term, the
    groups (by place in langs and sources; a language's documents have source null) and
    their numbers."""
    names = list(groups)
    terms = sorted(set().union(*groups.values()))
    number = dict(zip(terms, range(len(terms))))
    shard_of = np.fromiter(map(zlib.crc32, terms), np.int64, len(terms)) % shards
    by_shard = np.argsort(shard_of, kind="stable")
    rank = np.empty(len(terms), np.int64)  # of a term by shard, then by itself
    rank[by_shard] = np.arange(len(terms))
    lengths = [len(counts) for counts in groups.values()]
    ranks = rank[np.fromiter(map(number.__getitem__, chain.from_iterable(groups.values())), np.int64, sum(lengths))]
    order = np.argsort(ranks, kind="stable")
    places = np.repeat(np.arange(len(names)), lengths)[order]
    counts = np.fromiter(chain.from_iterable(counts.values() for counts in groups.values()), np.int64, sum(lengths))[order]
    sizes = np.bincount(ranks, minlength=len(terms)).astype(np.int32)
    ends = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
    bounds = np.searchsorted(shard_of[by_shard], np.arange(shards + 1)).tolist()
    ordered = [terms[i] for i in by_shard.tolist()]
    rows = []
    for shard in range(shards):
        for i in range(bounds[shard], bounds[shard + 1], CHUNK):
            j = min(i + CHUNK, bounds[shard + 1])
            used, place = np.unique(places[ends[i]:ends[j]], return_inverse=True)
            rows.append({
                "shard": shard, "first": ordered[i], "langs": [names[u][0] for u in used], "sources": [names[u][1] for u in used], "terms": b" ".join(ordered[i:j]),
                "sizes": sizes[i:j].tobytes(), "groups": place.astype(np.int32).tobytes(), "counts": counts[ends[i]:ends[j]].tobytes()})
            if len(rows) == 1024:
                yield pa.RecordBatch.from_pylist(rows, schema=RUN)
                rows = []
    yield pa.RecordBatch.from_pylist(rows, schema=RUN)


def _opened(row: dict):
    """(term, [((lang, source), n), ...]) of a chunk, by term."""
    names = list(zip(row["langs"], row["sources"]))
    groups = [names[g] for g in np.frombuffer(row["groups"], dtype=np.int32).tolist()]
    counts = np.frombuffer(row["counts"], dtype=np.int64).tolist()
    at = 0
    for term, size in zip(row["terms"].split(b" "), np.frombuffer(row["sizes"], dtype=np.int32).tolist()):
        yield term, zip(groups[at:at + size], counts[at:at + size])
        at += size


def merged(chunks):
    """(term, {(lang, source): n}) of the terms of one shard, from its chunks by first term.
    A chunk is opened when the heap's least term reaches its first."""
    heap: list = []
    term, sums = None, {}
    for number, row in enumerate(chunks):
        while heap and (row is None or heap[0][0] < row["first"]):
            found, place, numbers, rest = heap[0]
            if found != term:
                if term is not None:
                    yield term, sums
                term, sums = found, {}
            for key, n in numbers:
                sums[key] = sums.get(key, 0) + n
            ahead = next(rest, None)
            if ahead is None:
                heapq.heappop(heap)
            else:
                heapq.heapreplace(heap, (ahead[0], place, ahead[1], rest))
        if row is not None:
            rest = _opened(row)
            found, numbers = next(rest)
            heapq.heappush(heap, (found, number, numbers, rest))
    if term is not None:
        yield term, sums


def frequencies(runs: DataFrame, min_docs: int) -> DataFrame:
    """lang, term, source, n, lang_n (the language's number) of the kept terms' counts above
    0; with source null one row per kept term; with term '' one row per group."""
    kinds = [("lang", pa.string()), ("term", pa.string()), ("source", pa.string()), ("n", pa.int64()), ("lang_n", pa.int64())]

    def rows_of(term, sums):
        if not term:
            yield from ((lang, "", source, 0, 0) for lang, source in sums if source is not None)
            return
        kept = [lang for (lang, source), n in sums.items() if source is None and n >= min_docs]
        if kept:
            word, totals = term.decode(), dict.fromkeys(kept, 0)
            for (lang, source), n in sums.items():
                if source is not None and lang in totals:
                    totals[lang] += n
            for lang, total in totals.items():
                yield lang, word, None, total, total
            yield from ((lang, word, source, n, totals[lang]) for (lang, source), n in sums.items() if source is not None and lang in totals)

    def run(batches):
        schema, out = pa.schema(kinds), []
        for shard in _by_shard(batches):
            for term, sums in merged(shard):
                out += rows_of(term, sums)
                if len(out) >= 10_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*out), kinds)], schema=schema)
                    out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*out), kinds)], schema=schema)

    dealt = runs.repartition("shard").sortWithinPartitions("shard", "first")
    return map_arrow(dealt, run, "lang string, term string, source string, n long, lang_n long")


def _by_shard(batches):
    """The chunks of each shard in turn, each closed by a None."""
    rows = (dict(zip(batch.schema.names, r)) for batch in batches for r in zip(*(c.to_pylist() for c in batch.columns)))
    ahead = next(rows, None)

    def of(shard):
        nonlocal ahead
        while ahead is not None and ahead["shard"] == shard:
            yield ahead
            ahead = next(rows, None)
        yield None

    while ahead is not None:
        yield of(ahead["shard"])


def share(count: Column, n: Column, v: Column) -> Column:
    whole = lambda c: c.cast("decimal(18,0)")
    return F.call_function("div", F.lit(SCALE).cast("decimal(10,0)") * whole(count + 2), whole(n + 2 * v)) + 1


def divergence(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


def common_corrections(priced: DataFrame) -> DataFrame:
    """lang, a, b (a < b), value: over the terms that both sources have, what the one-sided
    corrections leave."""
    kinds = [("lang", pa.string()), ("a", pa.string()), ("b", pa.string()), ("value", pa.int64())]

    def f(p, q):
        return (p - q) ** 2 // (p + q)

    def run(batches):
        codes: dict[tuple[str, str], int] = {}  # of (language, source), as they come
        sums: dict[int, int] = {}               # by code << 32 | greater code

        def emptied():
            names = list(codes)
            rows = [(names[k >> 32][0], *sorted((names[k >> 32][1], names[k & 0xFFFFFFFF][1])), n) for k, n in sums.items()]
            sums.clear()
            for i in range(0, len(rows), 10_000):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows[i:i + 10_000]), kinds)], schema=pa.schema(kinds))

        for batch in batches:
            sizes = batch.column("sources").value_lengths().to_numpy()
            langs, sources = batch.column("lang").dictionary_encode(), batch.column("sources").flatten().dictionary_encode()
            both, place = np.unique(np.repeat(langs.indices.to_numpy(), sizes) * np.int64(len(sources.dictionary)) + sources.indices.to_numpy(), return_inverse=True)
            pairs = (divmod(x, len(sources.dictionary)) for x in both.tolist())
            code = np.array([codes.setdefault((langs.dictionary[x].as_py(), sources.dictionary[y].as_py()), len(codes)) for x, y in pairs], dtype=np.int64)[place]
            p, p0 = batch.column("p").flatten().to_numpy(), batch.column("p0").flatten().to_numpy()
            starts, partners = np.repeat(np.cumsum(sizes) - sizes, sizes), np.repeat(sizes, sizes).astype(np.int64)
            work = np.cumsum(partners) // PAIRS  # entries whose pairs are made at a time
            for piece in np.split(np.arange(len(code)), np.flatnonzero(np.diff(work)) + 1):
                n = partners[piece]
                left = np.repeat(piece, n)
                right = np.arange(len(left)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(starts[piece], n)
                up = code[left] < code[right]
                left, right = left[up], right[up]
                if not len(left):
                    continue
                a, a0, b, b0 = p[left], p0[left], p[right], p0[right]
                value = f(a, b) - f(a, b0) - f(a0, b) + f(a0, b0)
                key = code[left] << 32 | code[right]
                order = np.argsort(key, kind="stable")
                key = key[order]
                first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
                for k, total in zip(key[first].tolist(), np.add.reduceat(value[order], first).tolist()):
                    sums[k] = sums.get(k, 0) + total
                if len(sums) > HELD_SUMS:
                    yield from emptied()
        yield from emptied()

    terms = priced.groupBy("lang", "term").agg(F.collect_list(F.struct("source", "p", "p0")).alias("t")).where(F.size("t") > 1)
    terms = terms.select("lang", F.col("t.source").alias("sources"), F.col("t.p").alias("p"), F.col("t.p0").alias("p0"))
    return map_arrow(terms, run, "lang string, a string, b string, value long").groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))


def source_pairs(groups: DataFrame, priced: DataFrame) -> DataFrame:
    """lang, source, item (another source), value of every ordered pair of a language's
    sources: the sum of their divergence over all kept terms."""
    bars = priced.groupBy("lang", "source", "p").agg(F.count("*").alias("times")).groupBy("lang", "source").agg(F.collect_list(F.struct("p", "times")).alias("bars"))
    one = groups.select("lang", F.col("source").alias("a"), F.col("p0").alias("pa"), "v")
    other = groups.select("lang", F.col("source").alias("b"), F.col("p0").alias("pb"))
    pairs = one.join(other, "lang").where("a <> b")  # as many rows as the result
    pairs = pairs.join(bars.withColumnRenamed("source", "a"), ["lang", "a"], "left")
    least = divergence(F.col("pa"), F.col("pb"))
    corrected = F.aggregate("bars", F.lit(0).cast("long"), lambda sum, bar: sum + bar["times"] * (divergence(bar["p"], F.col("pb")) - least))
    value = F.coalesce(corrected, F.lit(0).cast("long")) + F.when(F.col("a") < F.col("b"), F.coalesce(F.col("v") * least, F.lit(0).cast("long"))).otherwise(0)
    sided = pairs.select("lang", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), value.alias("value"))
    sums = sided.unionByName(common_corrections(priced)).groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    ways = F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item"))))
    return sums.select("lang", "value", ways.alias("way")).select("lang", "way.source", "way.item", "value")


def audit(docs: DataFrame, min_docs: int = 10, top: int = 10, block_postings: int = 500_000, shards: int | None = None) -> DataFrame:
    """lang, source, part (pair or term), item, value, rank of every group."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "divergence")
    shards = shards or 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = scratch.cut(frequencies(postings(docs, shards, block_postings), min_docs), "frequencies")
    sums = scratch.cut(found.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count_if(F.col("term") != "").alias("v")), "sums")
    langs = sums.where("source is null").select("lang", F.col("total").alias("lang_total"), "v")
    groups = sums.where("source is not null").select("lang", "source", "total").join(langs, "lang", "left")
    nothing = F.lit(0).cast("long")
    groups = scratch.cut(groups.withColumn("p0", F.when(F.col("v") > 0, share(nothing, F.col("total"), F.col("v")))), "groups")
    priced = found.where("source is not null and term <> ''").join(groups, ["lang", "source"])
    priced = scratch.cut(priced.select("lang", "term", "source", share(F.col("n"), F.col("total"), F.col("v")).alias("p"), "p0",
                                       share(F.col("lang_n"), F.col("lang_total"), F.col("v")).alias("q")), "priced")
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")

    def ranked(rows: DataFrame, part: str) -> DataFrame:
        return rows.withColumn("rank", F.row_number().over(order)).select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank")

    terms = priced.where("p > q").select("lang", "source", F.col("term").alias("item"), divergence(F.col("p"), F.col("q")).alias("value"))
    return ranked(source_pairs(groups, priced), "pair").unionByName(ranked(terms, "term").where(F.col("rank") <= top))
