"""Near-duplicate components: bottom-k sketches, inverted lists, exact confirmation.

A document's set holds its distinct shingles of ``WIDTH`` words, as 64-bit hashes of one
hash function; its sketch is the ``K`` smallest hashes. Documents of equal sets form a
class (one linear aggregation) and only class representatives go on.

1. Inverted lists. Every retained value is a list of classes. Two sets with a Jaccard
   similarity of 3/4 share about 48 of 64 retained values, and fewer than
   ``NEED`` = 7/16 of them (28 of 64) with a probability below 1e-7; a sketch that holds
   its whole set shares more than that for certain. So a class need only appear on the
   lists of its rarest ``|sketch| - need + 1`` values (rarest first by list length, ties
   by value, one order for all): of two sets that share enough, the first shared value in
   that order is among these for both. Passages that many documents share are frequent
   values and drop out wherever the rest of a document is its own.
2. Groups. Each list names its smallest class as leader, and a class joins the groups of
   the leaders of its lists: at most one row per list entry, never one per pair.
3. Representatives. Of a group of more than ``BLOCK`` classes, all are first compared with
   ``STARS`` of them, and what these join is one cluster, the core: nothing within it need be
   compared again. A family of s near copies of one text so costs about s comparisons.
4. Tiles. A group is cut into blocks of ``BLOCK`` classes by hash, core and rest apart; a
   task compares two blocks, at least one of them of the rest. So every pair is compared
   whose classes aren't known to be connected. A task counts the overlap of sketches, estimates the similarity from the union
   sketch (the values up to the smaller of the two largest retained ones), rejects what
   lies 5 standard errors below 3/4, and confirms the rest on full sets. It returns a
   spanning forest of the confirmed links, not all of them.
5. Components by repeated minima of neighbours' labels with pointer jumping.

All tables stay distributed; each step is written to the shared checkpoint folder.

Defined results: a text is lower-cased in A-Z and cut into words ``[^\\x20\\x09-\\x0D]+``;
fewer than five words make one shingle of the whole sequence; null texts and texts
without words have an empty set, and are linked with nothing. Rows without doc_id take no
part and come back with a null component_id and kept = true. Repeated rows come back as
often as they came. An empty table gives an empty result. Only doc_id and text are read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cardtrail.llm.common import Scratch, map_batches, slices

WIDTH = 5
K = 64
NEED = 7 / 16
BLOCK = 256
STARS = 8
LAST = np.iinfo(np.int64).max

_WORD_HASHES: dict[bytes, int] = {}


def shingle_set(text: str | None) -> np.ndarray:
    """The sorted distinct shingle hashes of a text."""
    words = text.encode().lower().split() if text else []
    if not words:
        return np.zeros(0, dtype=np.int64)
    if len(words) < WIDTH:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), seed=len(words))], dtype=np.uint64).view(np.int64)
    if len(_WORD_HASHES) > 100_000:
        _WORD_HASHES.clear()
    known = _WORD_HASHES
    hashes = list(map(known.get, words))
    if None in hashes:
        for i, h in enumerate(hashes):
            if h is None:
                hashes[i] = known[words[i]] = xxhash.xxh64_intdigest(words[i])
    one = np.array(hashes, dtype=np.uint64)
    mixed = one[:len(one) - WIDTH + 1].copy()
    for k in range(1, WIDTH):
        mixed ^= mixed >> np.uint64(29)
        mixed *= np.uint64(0x9E3779B97F4A7C15)
        mixed += one[k:len(one) - WIDTH + 1 + k]
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        mixed ^= mixed >> np.uint64(shift)
        mixed *= np.uint64(factor)
    mixed ^= mixed >> np.uint64(31)
    return np.unique(mixed.view(np.int64))


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, print_a and print_b (128 bits that stand for the set), sketch."""

    def run(batches):
        for pdf in batches:
            texts = [t or "" for t in pdf["text"]]
            for a, b in slices(texts):
                rows = []
                for text in texts[a:b]:
                    s = shingle_set(text)
                    mark = xxhash.xxh3_128_intdigest(s.tobytes())
                    # a copy: a view would keep the whole set
                    rows.append((len(s), (mark >> 64) - (1 << 63), (mark & (1 << 64) - 1) - (1 << 63), s[:K].copy()))
                out = pd.DataFrame(rows, columns=["n_shingles", "print_a", "print_b", "sketch"])
                out.insert(0, "doc_id", pdf["doc_id"].iloc[a:b].array)
                yield out

    return map_batches(docs.select("doc_id", "text"), run, "doc_id long, n_shingles long, print_a long, print_b long, sketch array<long>")


def prefix_lists(classes: DataFrame) -> DataFrame:
    """(value, class_id) of the lists on which a class must appear, lists of one left out."""
    entries = classes.select("class_id", F.size("sketch").alias("length"), F.explode("sketch").alias("value"))
    shared = entries.groupBy("value").agg(F.count("*").alias("holders")).where("holders > 1")
    rare = (entries.join(shared, "value").groupBy("class_id", "length")
            .agg(F.sort_array(F.collect_list(F.struct("holders", "value"))).alias("shared")))  # at most K entries
    extra = F.size("shared") - F.greatest(F.lit(1), F.ceil(F.col("length") * NEED)).cast("int") + 1
    return rare.where(extra > 0).select("class_id", F.explode(F.slice("shared", F.lit(1), extra)).alias("e")).select(F.col("e.value").alias("value"), "class_id")


def _inverted(sets: list[np.ndarray]) -> tuple:
    """Lists of owners by value: (where each set's entries start, list number of each
    entry, owners by list, where lists start, list lengths)."""
    counts = np.array([len(s) for s in sets])
    values, owners = np.concatenate(sets), np.repeat(np.arange(len(sets)), counts)
    order = np.argsort(values, kind="stable")
    fresh = np.ones(len(values), dtype=bool)
    fresh[1:] = values[order][1:] != values[order][:-1]
    number = np.empty(len(values), dtype=np.int64)
    number[order] = np.cumsum(fresh) - 1
    starts = np.flatnonzero(fresh)
    return np.concatenate([[0], np.cumsum(counts)]), number, owners[order], starts, np.diff(np.append(starts, len(values)))


def _overlaps(inverted: tuple, i: int, m: int) -> np.ndarray:
    """How many values set i shares with each of the m sets."""
    at, number, owners, starts, lengths = inverted
    lists = number[at[i]:at[i + 1]]
    lists = lists[lengths[lists] > 1]
    if not len(lists):
        return np.zeros(m, dtype=np.int64)
    sizes = lengths[lists]
    ends = np.cumsum(sizes)
    return np.bincount(owners[np.repeat(starts[lists] - ends + sizes, sizes) + np.arange(ends[-1])], minlength=m)


def forest(sets: list[np.ndarray], rows: np.ndarray, columns: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of the links (100 * intersection >= 75 * union) between the sets
    numbered ``rows`` and those numbered ``columns``."""
    m = len(sets)
    sizes = np.array([len(s) for s in sets])
    short = [s[:K] for s in sets]
    lengths = np.minimum(sizes, K)
    matrix = np.full((m, K), LAST)
    for i, s in enumerate(short):
        matrix[i, :len(s)] = s
    reach = np.array([s[K - 1] if len(s) > K else LAST for s in sets])
    by_sketch, by_set = _inverted(short), None
    label, edges = np.arange(m), []
    wanted = np.zeros(m, dtype=bool)
    wanted[columns] = True
    for i in rows.tolist():
        shared = _overlaps(by_sketch, i, m)
        maybe = np.flatnonzero(wanted & (shared > 0) & (label != label[i]))
        if not len(maybe):
            continue
        own = np.where(reach[maybe] <= reach[i], np.searchsorted(short[i], reach[maybe], side="right"), lengths[i])
        others = np.where(reach[maybe] <= reach[i], lengths[maybe], (matrix[maybe] <= reach[i]).sum(1))
        whole = (reach[maybe] == LAST) & (reach[i] == LAST)
        own, others = np.where(whole, lengths[i], own), np.where(whole, lengths[maybe], others)
        union = own + others - shared[maybe]
        least = np.where(whole, 0.75 - 1e-9, 0.75 - 5 * np.sqrt(0.1875 / np.maximum(union, 1)))
        maybe = maybe[shared[maybe] >= least * union]
        if not len(maybe):
            continue
        by_set = by_set or _inverted(sets)
        both = _overlaps(by_set, i, m)[maybe]
        linked = maybe[100 * both >= 75 * (sizes[i] + sizes[maybe] - both)]
        for j in linked.tolist():
            if label[i] != label[j]:
                edges.append((i, j))
                label[label == max(label[i], label[j])] = min(label[i], label[j])
    return edges


def _sets(pdf: pd.DataFrame) -> list[np.ndarray]:
    return [np.frombuffer(b, dtype=np.int64) for b in pdf["shingles"]]


def star(pdf: pd.DataFrame) -> pd.DataFrame:
    """The classes of a block (nth below 0) against the representatives of their group
    (nth 0 to STARS - 1): per class, which representatives it is connected with here, as
    bits, and the representatives to link it with."""
    pdf = pdf.sort_values(["nth", "class_id"], ignore_index=True)
    ids, nth = pdf["class_id"].to_numpy(), pdf["nth"].to_numpy()
    edges = forest(_sets(pdf), np.flatnonzero(nth >= 0), np.flatnonzero(nth < 0))
    label, linked = np.arange(len(ids)), [[] for _ in ids]
    for a, b in edges:  # a is a representative
        label[label == max(label[a], label[b])] = min(label[a], label[b])
        linked[b].append(ids[a])
    bits: dict[int, int] = {}
    for i in np.flatnonzero(nth >= 0):
        bits[label[i]] = bits.get(label[i], 0) | 1 << int(nth[i])
    rows = np.flatnonzero(nth < 0)
    return pd.DataFrame({"leader": pdf["leader"].iloc[rows].to_numpy(), "class_id": ids[rows],
                         "bits": np.array([bits.get(label[i], 0) for i in rows], dtype=np.int32), "linked": pd.Series([linked[i] for i in rows], dtype=object)})


def core_of(seen: list[tuple[int, int]]) -> int:
    """The representatives, as bits, of the largest cluster, from (bits, classes): bits
    seen together are one cluster."""
    clusters: list[list[int]] = []
    for bits, count in seen:
        if bits:
            apart = [c for c in clusters if not c[0] & bits]
            for c in clusters:
                if c[0] & bits:
                    bits, count = bits | c[0], count + c[1]
            clusters = [*apart, [bits, count]]
    return max(clusters, key=lambda c: (c[1], c[0]), default=[0])[0]


def stars(members: DataFrame, sets: DataFrame) -> DataFrame:
    """(leader, class_id, bits, linked) of the classes of groups larger than a block."""
    # one representative a hash function: no group meets in one task for them
    least = [F.min(F.struct(F.xxhash64("class_id", F.lit(k)), "class_id"))["class_id"] for k in range(STARS)]
    groups = members.groupBy("leader").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"), F.array_distinct(F.array(*least)).alias("chosen")).where("blocks > 1")
    large = members.join(groups.select("leader", "blocks"), "leader")
    chosen = groups.select("leader", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.posexplode("chosen").alias("nth", "class_id"))
    chosen = chosen.select("leader", "block", "class_id", "nth")
    dealt = large.select("leader", F.pmod(F.xxhash64("class_id"), F.col("blocks")).cast("int").alias("block"), "class_id", F.lit(-1).alias("nth"))
    return dealt.unionByName(chosen).join(sets, "class_id").groupBy("leader", "block").applyInPandas(star, "leader long, class_id long, bits int, linked array<long>")


def tiles(members: DataFrame, starred: DataFrame) -> DataFrame:
    """(leader, low, high, block, class_id): the classes of every two blocks to compare."""

    def cores(batches):
        for pdf in batches:
            yield pd.DataFrame({"leader": pdf["leader"], "core": np.array([core_of([(r["bits"], r["n"]) for r in seen]) for seen in pdf["seen"]], dtype=np.int32)})

    seen = starred.groupBy("leader", "bits").agg(F.count("*").alias("n"))  # at most 2^STARS rows a group
    core = map_batches(seen.groupBy("leader").agg(F.collect_list(F.struct("bits", "n")).alias("seen")), cores, "leader long, core int")
    inside = starred.join(core, "leader").where(F.col("bits").bitwiseAND(F.col("core")) != 0).select("leader", "class_id", F.lit(1).alias("inside"))
    placed = members.join(inside, ["leader", "class_id"], "left").withColumn("inside", F.coalesce("inside", F.lit(0)))
    sizes = placed.groupBy("leader").agg(F.ceil(F.sum(1 - F.col("inside")) / BLOCK).cast("int").alias("rest"), F.ceil(F.sum("inside") / BLOCK).cast("int").alias("cores"))
    placed = placed.join(sizes.where("rest > 0"), "leader")
    part = F.xxhash64("class_id")
    block = F.when(F.col("inside") == 0, F.pmod(part, F.col("rest"))).otherwise(F.col("rest") + F.pmod(part, F.greatest("cores", F.lit(1))))
    cut = placed.withColumn("block", block.cast("int"))
    last = F.when(F.col("inside") == 0, F.col("rest") + F.col("cores")).otherwise(F.col("rest")) - 1
    cut = cut.withColumn("other", F.explode(F.sequence(F.lit(0), last.cast("int"))))
    return cut.select("leader", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "class_id")


def links(members: DataFrame, sets: DataFrame, scratch: Scratch) -> DataFrame:
    """(a, b) spanning the confirmed links within each group of (leader, class_id).

    ``sets`` has class_id and the full set as bytes."""
    starred = scratch.cut(stars(members, sets), "stars")

    def compare(key, pdf):
        low, high = key[1], key[2]
        pdf = pdf.sort_values("class_id", ignore_index=True)
        block, ids = pdf["block"].to_numpy(), pdf["class_id"].to_numpy()
        rows, columns = np.flatnonzero(block == low), np.flatnonzero(block == high)
        edges = forest(_sets(pdf), rows, columns) if len(rows) and len(columns) else []
        return pd.DataFrame({"a": ids[[a for a, _ in edges]], "b": ids[[b for _, b in edges]]})

    compared = tiles(members, starred).join(sets, "class_id").groupBy("leader", "low", "high").applyInPandas(compare, "a long, b long")
    joined = starred.select(F.explode("linked").alias("a"), F.col("class_id").alias("b")).where("a != b")
    return compared.unionByName(joined).distinct()


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, component): the smallest node that each node of ``edges`` (a, b) reaches.

    Every round gives a node the least label among its own and its neighbours', then the
    label of its label; rounds end when no label falls."""
    both = scratch.cut(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = scratch.cut(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("component")), "labels0")
    number = 0
    while True:
        near = (both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near")))
        lower = labels.join(near, "node").select("node", F.col("component").alias("was"), F.least("component", "near").alias("component"))
        lower = scratch.cut(lower, f"lower{number + 1}")
        jump = lower.select(F.col("node").alias("component"), F.col("component").alias("further"))
        labels = scratch.cut(lower.join(jump, "component").select("node", "was", F.col("further").alias("component")), f"labels{number + 1}")
        changed = labels.where("component < was").limit(1).count()
        labels = labels.select("node", "component")
        scratch.drop(f"labels{number}", f"lower{number + 1}")
        number += 1
        if not changed:
            return labels


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable), kept, per row."""
    scratch = Scratch(docs.sparkSession, "neardup")
    wide = scratch.cut(sketches(docs), "sketches")
    prints = ["print_a", "print_b"]
    sketched = scratch.cut(wide.where("doc_id is not null and n_shingles > 0").groupBy(*prints)
                           .agg(F.min("doc_id").alias("class_id"), F.first("sketch").alias("sketch")), "sketched")
    base = scratch.cut(wide.drop("sketch"), "base")
    lists = scratch.cut(prefix_lists(sketched), "lists")
    classes = scratch.cut(sketched.drop("sketch"), "classes")
    scratch.drop("sketches", "sketched")
    leaders = lists.groupBy("value").agg(F.min("class_id").alias("leader"), F.count("*").alias("holders")).where("holders > 1").select("value", "leader")
    members = scratch.cut(lists.join(leaders, "value").select("leader", "class_id").distinct(), "members")

    def full_sets(batches):
        for pdf in batches:
            texts = [t or "" for t in pdf["text"]]
            for a, b in slices(texts):
                yield pd.DataFrame({"class_id": pdf["doc_id"].iloc[a:b], "shingles": [shingle_set(t).tobytes() for t in texts[a:b]]})

    wanted = members.select(F.col("class_id").alias("doc_id")).distinct()
    # the same plan at every size: texts meet the ids wanted by a merge join
    texts = docs.select("doc_id", "text").join(wanted.hint("merge"), "doc_id", "left_semi")
    sets = scratch.cut(map_batches(texts, full_sets, "class_id long, shingles binary").dropDuplicates(["class_id", "shingles"]), "sets")
    found = components(links(members, sets, scratch), scratch)
    scratch.drop("lists", "members", "sets", "stars", "edges")
    of_class = classes.select(*prints, "class_id").join(found.withColumnRenamed("node", "class_id"), "class_id", "left")
    of_class = of_class.select(*prints, F.coalesce("component", "class_id").alias("component"))
    joined = base.join(of_class, prints, "left")
    component = F.when(F.col("n_shingles") > 0, F.when(F.col("doc_id").isNotNull(), F.col("component"))).otherwise(F.col("doc_id"))
    return joined.select("doc_id", "n_shingles", component.alias("component_id"),
                         F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """``docs`` without the rows whose document isn't the first of its component; of
    repeated rows of one doc_id one stays."""
    found = Scratch(docs.sparkSession, "kept").cut(near_duplicates(docs), "found")
    gone = found.where(~F.col("kept")).select("doc_id").distinct()
    left = docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
    repeated = found.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id")
    if repeated.isEmpty():
        return left
    return (left.join(repeated, "doc_id", "left_anti").select(*docs.columns)
            .unionByName(left.join(repeated, "doc_id", "left_semi").dropDuplicates(["doc_id"]).select(*docs.columns)))
